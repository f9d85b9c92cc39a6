"""The rule dimension: every regular-expression rule with what a finding of it carries."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from ..functions.regex import js_to_java
from . import patterns
from .advice import ADVICE

LANGUAGES = {"js": "javascript", "ts": "typescript", "py": "python", "java": "java", "go": "go"}

# Category names of the OWASP list of 2021, with their en dash.
A01, A02, A03, A05, A06, A07 = (
    "A01:2021 – Broken Access Control",
    "A02:2021 – Cryptographic Failures",
    "A03:2021 – Injection",
    "A05:2021 – Security Misconfiguration",
    "A06:2021 – Vulnerable and Outdated Components",
    "A07:2021 – Identification and Authentication Failures",
)


#: Kinds of files that only their own scanner reads.
KINDS = ("dockerfile", "kubernetes", "terraform")


@dataclass(frozen=True)
class Rule:
    """A row of the rule dimension.  snippet: characters of the match that a finding shows (0: all; -1: the trimmed line, -80: 80 of it).  number: its place among all rules."""

    rule_id: str
    name: str
    severity: str
    pattern: str
    flags: str
    languages: tuple[str, ...]
    scanner: str
    owasp: str | None
    cwe: str | None
    snippet: int
    message: str = ""
    fix: str = ""
    number: int = -1
    cis: str | None = None
    java: str = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "java", js_to_java(self.pattern, self.flags))


#: scanner: (category, weakness, snippet)
SCANNERS = {
    "secrets": (A07, "CWE-798", 0),
    "injection": (A03, "CWE-89", 100),
    "xss": (A03, "CWE-79", 0),
    "crypto": (A02, "CWE-327", 0),
    "auth": (A07, "CWE-287", 80),
    "path": (A01, "CWE-22", 60),
    "dockerfile": (A05, "CWE-732", -1),
    "terraform": (A05, "CWE-732", -80),
}
CODE = ("secrets", "injection", "xss", "crypto", "auth", "path")

# Published shapes of credentials (rule id, name, severity, flags, pattern).
SECRETS = (
    ("SEC-01", "AWS Access Key", "critical", "", r"AKIA[0-9A-Z]{16}"),
    ("SEC-02", "Google API Key", "critical", "", r"AIza[0-9A-Za-z_-]{35}"),
    ("SEC-03", "GitHub Token", "critical", "", r"ghp_[0-9a-zA-Z]{36}"),
    ("SEC-04", "Slack Token", "high", "", r"xox[baprs]-[0-9]{10,12}-[0-9]{10,12}-[a-zA-Z0-9]{24,32}"),
    ("SEC-05", "Private Key", "critical", "", r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----"),
    ("SEC-06", "JSON Web Token", "high", "", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    ("SEC-07", "Stripe Secret Key", "critical", "", r"sk_live_[0-9a-zA-Z]{24,}"),
    ("SEC-08", "SendGrid Key", "critical", "", r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}"),
    ("SEC-09", "Twilio Key", "high", "", r"SK[0-9a-f]{32}"),
    ("SEC-10", "Database URL", "high", "", r"(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis)://[^\s:@/]+:[^\s:@/]+@[^\s]+"),
    ("SEC-11", "AWS Secret Key", "critical", "i", r"""aws[_-]?secret[_-]?access[_-]?key\s*[=:]\s*['"]?[A-Za-z0-9/+]{40}"""),
    ("SEC-12", "Google OAuth Client", "high", "", r"[0-9]+-[0-9a-z]{32}\.apps\.googleusercontent\.com"),
    ("SEC-13", "Kakao Key", "high", "i", r"""kakao\w*key\s*[=:]\s*['"][0-9a-f]{32}['"]"""),
    ("SEC-14", "Naver Key", "high", "i", r"""naver\w*(?:id|secret)\s*[=:]\s*['"][A-Za-z0-9_]{10,}['"]"""),
)
# Sections of the container benchmark.
CIS = {"DF001": "4.1", "DF002": "4.3", "DF003": "4.3", "DF004": "4.7", "DF007": "4.6"}
#: Rules that hold when something is absent; they have no match.
ABSENCE = ("DF003", "DF012")


@cache
def rules(scanner: str) -> tuple[Rule, ...]:
    """The rules of a scanner, in the order in which their findings come."""
    owasp, cwe, snippet = SCANNERS[scanner]
    rows = [(*row[:4], "", row[4]) for row in SECRETS] if scanner == "secrets" else getattr(patterns, scanner.upper())
    label = {"dockerfile": "Dockerfile: {}", "terraform": "Terraform: {}"}.get(scanner, "{}")
    out = []
    for i, (rule_id, name, severity, flags, languages, pattern) in enumerate(rows):
        of = tuple(LANGUAGES[x] for x in languages.split(",") if x)
        number = 100 * list(SCANNERS).index(scanner) + i
        out.append(Rule(rule_id, name or label.format(rule_id), severity, pattern, flags, of, scanner, owasp, cwe, snippet, *ADVICE[rule_id], number, CIS.get(rule_id)))
    return tuple(out)


def matched(*scanners: str) -> list[Rule]:
    return [r for s in scanners for r in rules(s) if r.rule_id not in ABSENCE]


RULE = "hit int, rule_no int, scanner string, rule_id string, type string, severity string, owasp_category string, cwe_id string, snippet int, message string, fix string, cis string, pattern string"


def dimension(spark: SparkSession, listed: list[Rule]) -> DataFrame:
    """One row per rule; as long as the list, whatever the data."""
    return spark.createDataFrame([(i, r.number, r.scanner, r.rule_id, r.name, r.severity, r.owasp, r.cwe, r.snippet, r.message, r.fix, r.cis, r.java) for i, r in enumerate(listed)], RULE)
