"""The scan for users of SQL: functions that a session or a catalog keeps, whose bodies are the kernel's own expressions.

    SELECT s.path, f.* FROM sources s, LATERAL scan_code(s.text, s.language) f WHERE f.severity = 'critical'

A lateral call becomes one generator over the caller's rows: no Python, no shuffle, and the optimizer sees through it.  An outer
call (sources without findings too) is ``LEFT JOIN LATERAL scan_code(...) f ON true``; without ``ON true`` Spark makes it an inner one.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .functions.text import SEVERITIES, quoted
from .operators.kernel import fires, matches_sql
from .rules.catalogue import CODE, KINDS, RULE, SCANNERS, Rule, matched

#: What a row of a table function says, as FINDING has it.
ROW = "scanner STRING, rule_id STRING, rule_no INT, match_seq INT, type STRING, severity STRING, line INT, match STRING, message STRING, fix STRING, owasp_category STRING, cwe_id STRING"


MASKED = "concat(substring({0}, 1, 4), '****', right({0}, 3))"


def _rule_sql(rule: Rule) -> str:
    values = {"rule_no": rule.number, "scanner": rule.scanner, "rule_id": rule.rule_id, "type": rule.name, "severity": rule.severity, "owasp_category": rule.owasp, "cwe_id": rule.cwe, "snippet": rule.snippet, "message": rule.message, "fix": rule.fix, "cis": rule.cis, "pattern": rule.java}
    fields = [c.split() for c in RULE.split(", ") if c != "hit int"]
    return f"struct({', '.join(f'CAST({quoted(v) if (v := values[n]) is None or isinstance(v, str) else v} AS {t}) AS {n}' for n, t in fields)})"


def scan_sql(listed: list[Rule], hidden: bool = False, language: str = "language") -> str:
    """SQL of all findings of rules in ``text``, an array of ROW in the order of rules and matches; hidden: secrets show their ends only."""
    hits = ", ".join(f"IF({fires(r)}, {_rule_sql(r)}, NULL)" for r in listed)
    shown = f"IF(r.scanner = 'secrets', {MASKED.format('m.match')}, m.match)" if hidden else "m.match"
    made = {"scanner": "r.scanner", "rule_id": "r.rule_id", "rule_no": "r.rule_no", "match_seq": "m.seq", "type": "r.type", "severity": "r.severity", "line": "m.line", "match": shown, "message": "r.message", "fix": "r.fix", "owasp_category": "r.owasp_category", "cwe_id": "r.cwe_id"}
    row = ", ".join(f"{made[c.split()[0]]} AS {c.split()[0]}" for c in ROW.split(", "))
    found = f"flatten(transform(array_compact(array({hits})), r -> transform({matches_sql('r.')}, m -> struct({row}))))"
    body = f"flatten(transform(array(lower(text)), lowered -> {found}))"
    return body if language == "language" else f"flatten(transform(array({language}), language -> {body}))"


def functions() -> dict[str, tuple[str, str, str]]:
    """name: (parameters, what it returns, body)."""
    rank = " ".join(f"WHEN {quoted(s)} THEN {4 - i}" for i, s in enumerate(SEVERITIES))
    out = {
        "mask_secret": ("secret STRING", "STRING", MASKED.format("secret")),
        "severity_rank": ("severity STRING", "INT", f"CASE severity {rank} END"),
    }
    table = lambda parameters, expression: (parameters, f"TABLE({ROW})", f"SELECT * FROM inline({expression})")
    out["scan_code"] = table("text STRING, language STRING", scan_sql(matched(*CODE), hidden=True))
    for scanner in SCANNERS:
        if scanner in KINDS:
            out[f"scan_{scanner}"] = table("text STRING", scan_sql(matched(scanner), language=quoted(scanner)))
        else:
            out[f"scan_{scanner}"] = table("text STRING, language STRING", scan_sql(matched(scanner), scanner == "secrets"))
    return out


def register(spark: SparkSession, schema: str | None = None) -> list[str]:
    """Creates the functions: temporary ones, or those of a schema of the catalog, which stay; Spark finds table functions in the current schema only, so ``USE`` it before a call.

    ``scan_code`` runs all code scanners and masks secrets; ``scan_secrets`` to ``scan_path`` run one each; ``scan_dockerfile`` and
    ``scan_terraform`` hold the patterns of those files (absent directives are no pattern: the Python interface has these).  A null text gives no rows; a null language counts as any
    other script.  Returns their names.
    """
    names = []
    for name, (parameters, returns, body) in functions().items():
        full = f"{schema}.{name}" if schema else name
        spark.sql(f"CREATE OR REPLACE {'' if schema else 'TEMPORARY '}FUNCTION {full}({parameters}) RETURNS {returns} RETURN {body}")
        names.append(full)
    return names
