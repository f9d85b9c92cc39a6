"""DuckDB SQL for the queries.  Its regular expressions have no lookaround: a rule that needs it matches what stands before it and tests the rest."""

from __future__ import annotations

from ..functions.text import SEVERITIES
from ..operators.dependencies import ADVISORIES
from ..rules.catalogue import CODE as SCANNERS
from ..rules.catalogue import Rule, matched
from .cases import CASES, FIXES, KUBERNETES, KUBERNETES_FINDINGS, PLACES, SCRIPTS
from .corpus import CODE, DOCKERFILE, MANIFESTS, PATHS, TERRAFORM, corpus_sql, literal, picked_sql
from .queries import WORD_RULES, looks_around, own_rules

#: rule: (pattern before the lookaround, condition on what follows the match: rest, or restline up to the line's end)
AROUND = {
    "XSS-01": (r"dangerouslySetInnerHTML\s*=\s*\{\s*\{\s*__html\s*:", "NOT regexp_matches(restline, '(?i)sanitize|DOMPurify|escape')"),
    "XSS-02": (r"\.innerHTML\s*=", "NOT regexp_matches(rest, '^[''\"`]<')"),
    "XSS-03": (r"\.outerHTML\s*=", "NOT regexp_matches(rest, '^[''\"`]<')"),
    "XSS-05": (r"\$\([^)]+\)\.html\s*\(", "NOT regexp_matches(rest, '^[''\"`]<')"),
    "CRY-11": (r"(?:TLSv1|SSLv3|TLS_v1_0|TLS_v1_1)", "NOT regexp_matches(rest, '^_[23]')"),
    "AUT-03": (r"jwt\.sign\s*\([^)]+\)", "NOT regexp_matches(restline, '(?i)expiresIn')"),
    "AUT-04": (r"jwt\.verify\s*\(\s*\w+\s*,\s*\w+\s*\)", r"NOT regexp_matches(rest, '^\s*,')"),
    "AUT-06": (r"cookie\s*\(\s*['\"][^'\"]+['\"]\s*,\s*[^)]*", "true"),
    "AUT-14": (r"oauth.*redirect", "NOT regexp_matches(restline, '(?i)state')"),
    "PTH-07": (r"multer|upload|formidable|busboy", "lower(m) <> 'busboy' OR NOT regexp_matches(restline, '(?i)mimetype|fileFilter')"),
    "PTH-11": (r"(?:readFile|createReadStream)\s*\([^)]+\)", "NOT regexp_matches(restline, '(?i)lstat')"),
    "DF005": (r"apt-get\s+install", "NOT contains(restline, '--no-install-recommends')"),
    "DF009": (r"apk\s+add", "NOT contains(restline, '--no-cache')"),
    "DF010": (r"(?:apt-get|apk|yum)\s+(?:update|upgrade)", "NOT contains(restline, '&&')"),
    "DF015": (r"wget.*", "true"),
    "TF005": (r'resource\s+"aws_s3_bucket"', "NOT regexp_matches(rest, '^[^}]*server_side_encryption_configuration')"),
    "TF006": (r'resource\s+"aws_db_instance"', r"NOT regexp_matches(rest, '^[^}]*storage_encrypted\s*=\s*true')"),
    "TF009": (r'resource\s+"aws_s3_bucket"', r"NOT regexp_matches(rest, '^[^}]*logging\s*\{')"),
}
COMMENT = {
    "injection": "CASE WHEN language = 'python' THEN l LIKE '#%' WHEN language IN ('javascript', 'typescript', 'java', 'go') THEN l LIKE '//%' OR l LIKE '/*%' OR l LIKE '*%' ELSE l LIKE '//%' OR l LIKE '#%' END",
    "dockerfile": "l LIKE '#%'",
    "terraform": "l LIKE '#%' OR l LIKE '//%'",
}
OTHER = "CASE WHEN language = 'python' THEN l LIKE '#%' ELSE l LIKE '//%' OR l LIKE '/*%' OR l LIKE '*%' END"


def _one(rule: Rule) -> str:
    pattern, keep = AROUND.get(rule.rule_id, (rule.pattern, "true"))
    flags = "".join(f for f in "ims" if f in rule.flags)
    pattern = literal((f"(?{flags})" if flags else "") + pattern)
    comment = COMMENT.get(rule.scanner, OTHER)
    cleans = "regexp_matches(lower(whole), 'sanitize|escape|encode|xss|htmlspecialchars|htmlentities')" if rule.scanner == "xss" else "false"
    languages = f"language IN ({', '.join(map(literal, rule.languages))})" if rule.languages else "true"
    shown = "NULL" if looks_around(rule) else {-1: "trim(whole)", -80: "left(trim(whole), 80)", 0: "m"}.get(rule.snippet, f"left(m, {rule.snippet})")
    return f"""
SELECT key, {literal(rule.rule_id)} AS rule_id, {literal(rule.scanner)} AS scanner, {literal(rule.name)} AS type, {literal(rule.severity)} AS severity, {literal(rule.owasp or "")} AS owasp_category, {literal(rule.cwe or "")} AS cwe_id, {rule.number} AS rule_no, CAST(line AS INTEGER) AS line, {shown} AS "match", i
FROM (SELECT *, ltrim(whole, ' ' || chr(9) || chr(13)) AS l, split_part(rest, chr(10), 1) AS restline FROM (
  SELECT *, string_split(text, chr(10))[line] AS whole, substr(text, length(pre) + length(m) + 1) AS rest FROM (
    SELECT *, 1 + length(pre) - length(replace(pre, chr(10), '')) AS line FROM (
      SELECT key, language, text, i, ms[i + 1] AS m, list_aggregate(list_transform(range(i + 1), lambda k: gs[k + 1] || CASE WHEN k < i THEN ms[k + 1] ELSE '' END), 'string_agg', '') AS pre
      FROM (SELECT key, language, text, ms, gs, unnest(range(len(ms))) AS i FROM (SELECT *, regexp_extract_all(text, {pattern}, 0) AS ms, string_split_regex(text, {pattern}) AS gs FROM corpus WHERE {languages}))))))
WHERE ({keep}) AND NOT ({comment}) AND NOT ({cleans})"""


def findings(snippets: tuple, scanners: tuple[str, ...], comment: str = "// order ") -> str:
    """WITH clause that ends in the table ``found``."""
    return f"WITH corpus AS MATERIALIZED ({corpus_sql(snippets, comment)}), found AS MATERIALIZED ({' UNION ALL '.join(_one(r) for r in matched(*scanners))})"


ALL = findings(CODE, ("injection", "xss", "crypto", "auth", "path"))
RANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"


def by_family(snippets: tuple, scanner: str, comment: str) -> str:
    return f"{findings(snippets, (scanner,), comment)} SELECT key, rule_id, severity, line, \"match\", count(*) AS n FROM found GROUP BY ALL"


def has(*needles: str) -> str:
    return "(" + " OR ".join(f"contains(text, {literal(n)})" for n in needles) + ")"


TOOL = f"CASE WHEN {has('import React', 'useState')} THEN 'javascript' WHEN {has(': string', ': number')} THEN 'typescript' WHEN {has('def ', 'import ')} THEN 'python' WHEN {has('public class', 'private void')} THEN 'java' WHEN {has('func ', 'package main')} THEN 'go' ELSE 'javascript' END"
_SCRIPT = has("import ", "export ", "const ", "let ")
SANDBOX = f"CASE WHEN {_SCRIPT} AND {has('interface ', ': string', ': number')} THEN 'typescript' WHEN {_SCRIPT} THEN 'javascript' WHEN {has('def ')} THEN 'python' WHEN {has('public class ', 'private ', 'package ')} THEN 'java' WHEN {has('func ', 'package main')} THEN 'go' ELSE 'javascript' END"
_PATHS = f"(SELECT o_orderkey AS key, {picked_sql(PATHS)} AS file FROM orders)"
_BASE = "list_extract(string_split(file, '/'), -1)"


def values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else literal(v) if isinstance(v, str) else str(v) for v in row) + ")" for row in rows) + ")"


def dockerfile_sql(corpus: str) -> str:
    return f"""WITH corpus AS ({corpus}), lines AS (SELECT key, unnest(range(1, len(ls) + 1)) AS line, ls FROM (SELECT key, string_split(text, chr(10)) AS ls FROM corpus))
SELECT key, 'DF003' AS rule_id, CAST(NULL AS INTEGER) AS line FROM corpus WHERE NOT regexp_matches(text, '(?m)^USER(\\s\\s|\\s([^r\\s]|r[^o]|ro[^o]|roo[^t]|root\\w))')
UNION ALL SELECT key, 'DF012', NULL FROM corpus WHERE NOT regexp_matches(text, '(?m)^HEALTHCHECK')
UNION ALL SELECT key, 'DF-MULTISTAGE', NULL FROM corpus WHERE len(regexp_extract_all(text, '(?m)^FROM')) = 1 AND regexp_matches(text, '(?i)COPY|ADD')
UNION ALL SELECT key, 'DF-ADDCOPY', CAST(line AS INTEGER) FROM lines WHERE trim(ls[line]) LIKE 'ADD %' AND NOT regexp_matches(ls[line], '\\.tar|\\.tgz|https?://')"""


def terraform_sql(corpus: str) -> str:
    return f"""WITH corpus AS ({corpus})
SELECT key, 'TF-PROVIDER' AS rule_id, CAST(NULL AS INTEGER) AS line FROM corpus WHERE NOT regexp_matches(text, '(?s)required_providers\\s*\\{{([^}}]+)\\}}')
UNION ALL SELECT key, 'TF-BACKEND', CAST(1 + length(pre) - length(replace(pre, chr(10), '')) AS INTEGER) FROM (SELECT key, regexp_extract(text, 'backend\\s+"s3"\\s*\\{{([^}}]+)\\}}', 1) AS body, string_split_regex(text, 'backend\\s+"s3"\\s*\\{{([^}}]+)\\}}')[1] AS pre FROM corpus) WHERE body <> '' AND NOT contains(body, 'encrypt')"""


def infrastructure_sql(kinds: dict[str, tuple], texts: int) -> str:
    """Each kind's texts stand in their own place of all texts; findings of the parts, counted."""
    severity = {"DF003": "high", "DF012": "low", "DF-MULTISTAGE": "low", "DF-ADDCOPY": "low", "TF-PROVIDER": "low", "TF-BACKEND": "high"}
    parts, graded = [], values([*severity.items()])
    for kind, practice in (("dockerfile", dockerfile_sql), ("terraform", terraform_sql)):
        snippets, start = kinds[kind]
        corpus = f"SELECT o_orderkey AS key, {literal(kind)} AS language, [{', '.join(literal(t) for _, t in snippets)}][o_orderkey % {texts} - {start} + 1] AS text FROM orders WHERE o_orderkey % {texts} BETWEEN {start} AND {start + len(snippets) - 1}"
        parts.append(f"SELECT scanner, rule_id, severity FROM (WITH corpus AS MATERIALIZED ({corpus}) {' UNION ALL '.join(_one(r) for r in matched(kind))})")
        parts.append(f"SELECT {literal(kind)}, rule_id, severity FROM ({practice(corpus)}) JOIN {graded} g(rule_id, severity) USING (rule_id)")
    start = kinds["kubernetes"][1]
    parts.append(f"SELECT 'kubernetes', rule_id, severity FROM orders JOIN {values([f[:3] for f in KUBERNETES_FINDINGS])} c(n, rule_id, severity) ON o_orderkey % {texts} - {start} = n")
    return f"SELECT scanner, rule_id, severity, count(*) AS n FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL"


def versions_sql() -> str:
    """Parts as lists of one length, and every advisory of a package with every version of it."""
    return """
WITH uses AS (SELECT doc_id, 'p' || doc_id % 997 AS package, concat_ws('.', doc_id % 10, doc_id % 7, CASE WHEN doc_id % 17 = 0 THEN doc_id % 20 || '.0.0.0.0.0.0.0.5' WHEN doc_id % 19 = 0 THEN 'x.0' ELSE CAST(doc_id % 20 AS VARCHAR) END) AS version,
  [doc_id % 10, doc_id % 7, CASE WHEN doc_id % 17 = 0 THEN doc_id % 20 WHEN doc_id % 19 = 0 THEN 0 ELSE doc_id % 20 END, CASE WHEN doc_id % 17 = 0 THEN 5 ELSE 0 END] AS k FROM documents WHERE doc_id IS NOT NULL),
advisories AS (SELECT l_orderkey * 8 + l_linenumber AS id, 'p' || l_partkey % 997 AS package, CASE WHEN l_orderkey % 50 <> 0 THEN [CAST(l_quantity AS BIGINT) % 10, l_linenumber, l_orderkey % 20, 0] END AS lo,
  CASE WHEN l_orderkey % 40 <> 0 THEN [CAST(l_quantity AS BIGINT) % 10 + CAST(l_orderkey % 3 = 0 AS INTEGER), l_linenumber + 1, l_orderkey % 5, 0] END AS hi FROM lineitem)
SELECT doc_id, version, count(*) AS n, max(id) AS last, CAST(sum(id) AS BIGINT) AS ids FROM uses JOIN advisories USING (package) WHERE (lo IS NULL OR lo <= k) AND (hi IS NULL OR k < hi) GROUP BY ALL"""


def scripts_sql() -> dict[str, str]:
    """Hand-made answers for each script, by the remainder of the key."""
    n, kinds, blank, finds = len(SCRIPTS), [], [], []
    for i, (_, pieces, found) in enumerate(SCRIPTS):
        lines = "".join(piece for _, piece in pieces).split("\n")
        kinds.append("".join(kind * len(piece) for kind, piece in pieces))
        blank.append("".join(piece if kind == "." else "".join(c if c == "\n" else " " for c in piece) for kind, piece in pieces))
        finds += [(i, f[0], f[1], f[2], lines[f[1] - 1].strip(), *(f[3:] or (None, None))) for f in found]
    return {
        "script_spans": f"SELECT doc_id AS key, {picked_sql(kinds, 'doc_id')} AS kinds, md5({picked_sql(blank, 'doc_id')}) AS blanked FROM documents",
        "script_finders": f"SELECT doc_id AS key, finder, line, col, code, f.source, names FROM documents JOIN {values(finds)} f(n, finder, line, col, code, source, names) ON doc_id % {n} = n",
        "findings_by_place": f"SELECT doc_id AS key, rule_id, line, place FROM documents JOIN {values(list(PLACES))} f(n, rule_id, line, place) ON doc_id % {n} = n",
    }


IMPORTED = """
WITH items AS (SELECT doc_id AS key, source, n_chars, unnest(range(doc_id % 5)) AS k FROM documents WHERE doc_id % 7 <> 0)
SELECT key, 'sarif' AS scanner, 'src/' || key || '.js' AS file, 'R' || k AS rule_id, CAST(k AS INTEGER) AS match_seq, 'R' || k AS type, ['high', 'medium', 'low', 'medium'][(key + k) % 4 + 1] AS severity, source AS message, CAST(n_chars + k AS INTEGER) AS line, NULL AS "match" FROM items WHERE key % 2 = 0
UNION ALL SELECT key, 'audit', 'r' || key, 'pkg' || k, CAST(k AS INTEGER), 'Vulnerable Package', ['critical', 'medium', 'low', 'low'][(key + k) % 4 + 1], coalesce(source, 'A vulnerability was found.'), NULL, '<' || k FROM items WHERE key % 2 = 1"""


def user_rules_sql() -> str:
    """Words of each line joined with the word of each rule, then the rule's pattern over that line."""
    patterns = " ".join(f"WHEN {k} THEN {literal((f'(?{flags})' if flags else '') + p)}" for k, (flags, p) in enumerate(WORD_RULES))
    return f"""
WITH corpus AS MATERIALIZED (SELECT doc_id, {TOOL} AS language, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
lines AS MATERIALIZED (SELECT doc_id, language, unnest(ls) AS whole, unnest(range(1, len(ls) + 1)) AS line FROM corpus),
words AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\\b[a-z]{{6,}}\\b')) AS w FROM documents),
rules AS MATERIALIZED (SELECT w, replace(CASE ascii(md5(w)) % {len(WORD_RULES)} {patterns} END, '{{}}', w) AS p FROM words ORDER BY md5(w) LIMIT 10000),
tokens AS (SELECT DISTINCT doc_id, language, line, whole, w FROM (SELECT *, lower(unnest(regexp_extract_all(whole, '[A-Za-z0-9_]+'))) AS w FROM lines) SEMI JOIN rules USING (w)),
found AS (SELECT w, doc_id, line, len(regexp_extract_all(whole, p)) AS n FROM (SELECT *, ltrim(whole, ' ' || chr(9) || chr(13)) AS l FROM tokens) JOIN rules USING (w) WHERE NOT ({OTHER}))
SELECT w AS rule_id, CAST(sum(n) AS BIGINT) AS n, count(DISTINCT doc_id) AS files, CAST(sum(n * line) AS BIGINT) AS lines FROM found WHERE n > 0 GROUP BY w"""


def oracle_sql() -> dict[str, str]:
    docker = corpus_sql(DOCKERFILE, "")
    terraform = corpus_sql(TERRAFORM, "")
    manifests = f"SELECT o_orderkey AS key, [{', '.join(literal(a) for a, _ in MANIFESTS)}][o_orderkey % {len(MANIFESTS)} + 1] AS name, [{', '.join(literal(b) for _, b in MANIFESTS)}][o_orderkey % {len(MANIFESTS)} + 1] AS text FROM orders"
    known = "(VALUES " + ", ".join(f"({', '.join(map(literal, row))})" for row in ADVISORIES) + ") a(ecosystem, package, affected, severity)"
    part = lambda v, i: f"coalesce(try_cast(nullif(string_split(regexp_replace({v}, '[\\^~>=<]', '', 'g'), '.')[{i}], '') AS DOUBLE), 0)"
    before = "({a1} < {b1} OR ({a1} = {b1} AND ({a2} < {b2} OR ({a2} = {b2} AND {a3} < {b3}))))".format(**{f"{k}{i}": part(v, i) for k, v in (("a", "version"), ("b", "affected")) for i in (1, 2, 3)})
    short = "CASE WHEN instr(type, ':') > 1 THEN trim(split_part(type, ':', 1)) ELSE type END"
    slug = "lower(cwe_id) || '-' || trim(regexp_replace(regexp_replace(regexp_replace(lower(CASE WHEN instr(type, ':') > 1 THEN split_part(type, ':', 1) ELSE type END), '[^a-z0-9\\s-]', '', 'g'), '\\s+', '-', 'g'), '-+', '-', 'g'))"
    out = {f"findings_{s}": by_family(CODE, s, "// order ") for s in ("injection", "xss", "crypto", "auth", "path", "secrets")}
    out |= {"findings_dockerfile": by_family(DOCKERFILE, "dockerfile", ""), "findings_terraform": by_family(TERRAFORM, "terraform", "")}
    by_id = {r.rule_id: r for r in matched(*SCANNERS, "dockerfile", "terraform")}
    cases = values([(i, c[0], c[3], c[4], by_id[c[0]].owasp, by_id[c[0]].cwe) for i, c in enumerate(CASES)])
    pods = values([(*f[:5], *f[5:]) for f in KUBERNETES_FINDINGS])
    kinds = {"dockerfile": (DOCKERFILE, 0), "terraform": (TERRAFORM, len(DOCKERFILE)), "kubernetes": (KUBERNETES, len(DOCKERFILE) + len(TERRAFORM))}
    texts = len(DOCKERFILE) + len(TERRAFORM) + len(KUBERNETES)
    out |= {
        "rule_cases": f"SELECT o_orderkey AS key, rule_id, line, m AS \"match\", owasp_category, cwe_id FROM orders JOIN {cases} c(n, rule_id, line, m, owasp_category, cwe_id) ON o_orderkey % {len(CASES)} = n",
        "kubernetes_checks": f"SELECT o_orderkey AS key, rule_id, severity, m AS \"match\", pss, name, container, env_var FROM orders JOIN {pods} c(n, rule_id, severity, pss, m, name, container, env_var) ON o_orderkey % {len(KUBERNETES)} = n",
        "infrastructure_scan": infrastructure_sql(kinds, texts),
        "documents_scan": f"WITH corpus AS MATERIALIZED (SELECT doc_id AS key, {TOOL} AS language, text FROM documents WHERE text IS NOT NULL), found AS MATERIALIZED ({' UNION ALL '.join(_one(r) for r in matched(*SCANNERS) + own_rules())}) SELECT rule_id, line, count(*) AS n FROM found GROUP BY ALL",
        "user_rules_scan": user_rules_sql(),
        "version_intervals": versions_sql(),
        "sql_scan": f"{findings(CODE, SCANNERS).replace('o_orderkey', 'doc_id').replace('FROM orders', 'FROM documents')} SELECT scanner, rule_id, severity, CAST({RANK} AS INTEGER) AS grade, count(*) AS n, CAST(sum(line) AS BIGINT) AS lines FROM found WHERE {RANK} >= 2 GROUP BY ALL",
        "imported_reports": IMPORTED,
        "findings_sketched": f"{findings(CODE, ('injection', 'xss', 'crypto', 'auth', 'path')).replace('o_orderkey', 'doc_id').replace('FROM orders', 'FROM documents')} SELECT severity, count(*) AS n, count(DISTINCT key) AS files_exact, count(DISTINCT rule_id) AS rules_exact, true AS files_near, true AS rules_near FROM found GROUP BY severity",
        "sarif_by_file": f"{ALL}, f AS (SELECT *, {slug} AS id, 'f' || key AS file FROM found) SELECT file, CAST(count(DISTINCT id) OVER (PARTITION BY file) AS INTEGER) AS rules, CAST(row_number() OVER (PARTITION BY file ORDER BY rule_no, i) - 1 AS INTEGER) AS place, id, CASE WHEN {RANK} >= 3 THEN 'error' WHEN {RANK} = 2 THEN 'warning' ELSE 'note' END AS level, file AS uri, line FROM f",
        "json_report": f"{ALL} SELECT severity, type, owasp_category AS \"owaspCategory\", cwe_id AS \"cweId\", count(*) AS n, CAST(sum(line) AS BIGINT) AS lines FROM found GROUP BY ALL",
        "owasp_groups": f"{ALL} SELECT owasp_category, count(*) AS n FROM found GROUP BY owasp_category",
        "severity_summary": f"{ALL} SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in SEVERITIES) + " FROM found",
        "severity_by_group": f"{ALL} SELECT severity, count(*) AS n FROM found GROUP BY severity",
        "severity_share": f"{ALL} SELECT severity, n, CAST(sum(n) OVER () AS BIGINT) AS total, CAST(n AS DOUBLE) / sum(n) OVER () * 100 AS percent, CAST(floor(n * 10 / sum(n) OVER () + 0.5) AS INTEGER) AS bar FROM (SELECT severity, count(*) AS n FROM found GROUP BY severity)",
        "owasp_distribution": f"{ALL} SELECT owasp_category, count(*) AS n FROM found GROUP BY owasp_category",
        "type_top8_others": f"{ALL} SELECT CASE WHEN place <= 8 THEN kind ELSE 'Others' END AS kind, CAST(sum(n) AS BIGINT) AS n, count(*) AS kinds FROM (SELECT *, row_number() OVER (ORDER BY n DESC, first) AS place FROM (SELECT {short} AS kind, count(*) AS n, min(('f' || key, rule_no, i)) AS first FROM found GROUP BY 1)) GROUP BY 1",
        "files_over_threshold": f"{ALL} SELECT 'f' || key AS file, count(*) AS n FROM found WHERE {RANK} >= 3 GROUP BY key",
        "first_n_per_severity": f"{ALL} SELECT severity, number, key, rule_id, line, more FROM (SELECT *, row_number() OVER (PARTITION BY severity ORDER BY 'f' || key, rule_no, i) AS number, CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS most, greatest(count(*) OVER (PARTITION BY severity) - most, 0) AS more FROM found) WHERE number <= most",
        "attack_surface": f"{ALL} SELECT bool_or(contains(lower(type), 'injection')) AS injection, bool_or(contains(lower(type), 'xss')) AS xss, bool_or(contains(lower(type), 'auth')) AS auth, bool_or(contains(lower(type), 'secret') OR contains(lower(type), 'key')) AS secrets, bool_or(contains(lower(type), 'crypto') OR contains(lower(type), 'md5') OR contains(lower(type), 'sha1')) AS crypto FROM found",
        "scanner_rollup": f"{ALL} SELECT scanner, severity, count(*) AS n FROM found GROUP BY ROLLUP (scanner, severity)",
        "sarif_stats": f"{ALL} SELECT count(*) AS results, count(DISTINCT {slug}) AS rules, count(DISTINCT key) AS files, count(*) FILTER ({RANK} >= 3) AS errors, count(*) FILTER ({RANK} = 2) AS warnings, count(*) FILTER ({RANK} = 1) AS notes FROM found",
        "sarif_rule_dedup": f"""{ALL}, firsts AS (SELECT id, unnest(arg_min({{'name': type, 'severity': severity, 'owasp': owasp_category, 'cwe': cwe_id}}, ('f' || key, rule_no, i))) FROM (SELECT *, {slug} AS id FROM found) GROUP BY 1)
SELECT id, name, CASE severity WHEN 'critical' THEN 'very-high' ELSE severity END AS precision, CASE severity WHEN 'critical' THEN '9.0' WHEN 'high' THEN '7.0' WHEN 'medium' THEN '5.0' ELSE '3.0' END AS score,
'security,owasp,' || lower(left(owasp, 3)) || ',cwe,' || lower(cwe) || {''.join(f" || CASE WHEN regexp_matches(lower(name), '{w}') THEN ',{t}' ELSE '' END" for t, w in (('injection', 'injection'), ('xss', 'xss'), ('sql', 'sql'), ('secrets', 'secret|key'), ('cryptography', 'crypto'), ('authentication', 'auth'), ('docker', 'docker'), ('kubernetes', 'kubernetes|k8s'), ('terraform', 'terraform')))[4:]} AS tags FROM firsts""",
        "language_detect_tool": f"SELECT lang, count(*) AS n FROM (SELECT {TOOL} AS lang FROM ({corpus_sql(CODE)})) GROUP BY lang",
        "language_detect_sandbox": f"SELECT lang, count(*) AS n FROM (SELECT {SANDBOX} AS lang FROM ({corpus_sql(CODE)})) GROUP BY lang",
        "language_of_documents": f"SELECT doc_id, {TOOL} AS lang FROM documents",
        "iac_routing": f"SELECT key, CASE WHEN b = 'dockerfile' OR b LIKE 'dockerfile.%' THEN 'dockerfile' WHEN b LIKE '%.yml' OR b LIKE '%.yaml' THEN 'kubernetes' WHEN b LIKE '%.tf' OR b LIKE '%.tfvars' THEN 'terraform' ELSE 'code' END AS kind, CASE WHEN b LIKE '%.ts' OR b LIKE '%.tsx' THEN 'typescript' WHEN b LIKE '%.py' THEN 'python' WHEN b LIKE '%.java' THEN 'java' WHEN b LIKE '%.go' THEN 'go' ELSE 'javascript' END AS language FROM (SELECT key, lower({_BASE}) AS b FROM {_PATHS})",
        "file_selection": f"SELECT key, file FROM {_PATHS} WHERE regexp_matches({_BASE}, '\\.(js|ts|py|java|go)$') AND NOT regexp_matches(file, 'node_modules|dist|build|\\.git')",
        "dockerfile_practice": dockerfile_sql(docker),
        "terraform_practice": terraform_sql(terraform),
        "dependency_advisories": f"""WITH manifests AS ({manifests}), npm AS (
  SELECT key, unnest(json_keys(text, '$.' || d)) AS package, d, text FROM manifests, (VALUES ('dependencies'), ('devDependencies')) x(d) WHERE name = 'package.json'), npm_v AS (
  SELECT key, package, json_extract_string(text, '$.' || d || '."' || package || '"') AS version FROM npm n WHERE d = 'devDependencies' OR NOT list_contains(json_keys(text, '$.devDependencies'), package))
SELECT key, ecosystem, package, severity, package || '@' || version AS "match", 'Vulnerable Package: ' || package AS type, 'A06:2021 – Vulnerable and Outdated Components' AS owasp_category, 'CWE-1104' AS cwe_id FROM npm_v JOIN {known} USING (package) WHERE ecosystem = 'npm' AND (affected = '' OR {before})
UNION ALL SELECT key, ecosystem, package, severity, trim(line), 'Vulnerable Python Package: ' || package, NULL, NULL FROM (SELECT key, line, lower(regexp_extract(line, '^([a-zA-Z0-9_-]+)', 1)) AS package FROM (SELECT key, unnest(string_split(text, chr(10))) AS line FROM manifests WHERE name = 'requirements.txt')) JOIN {known} USING (package) WHERE ecosystem = 'pip'
UNION ALL SELECT key, ecosystem, package, severity, package, 'Vulnerable Go Package: ' || package, NULL, NULL FROM manifests JOIN {known} ON contains(text, package) WHERE name = 'go.mod' AND ecosystem = 'go'""",
        "owasp_left_join": f"{findings(CODE, ('xss', 'path'))} SELECT rule_id, d AS owasp_description, e AS cwe_description, count(*) AS n FROM found LEFT JOIN (VALUES ('A03:2021 – Injection', 'Untrusted data reaches an interpreter.'), ('A01:2021 – Broken Access Control', 'Rules of who may do what are not enforced.')) o(c, d) ON c = owasp_category LEFT JOIN (VALUES ('CWE-79', 'Input becomes part of a page.'), ('CWE-22', 'A path leaves its folder.')) w(w, e) ON w = cwe_id GROUP BY ALL",
        "cve_array_join": "WITH f AS (SELECT o_orderkey AS key, unnest([o_custkey, o_orderkey % 100]) AS id FROM orders) SELECT key, count(DISTINCT id) AS n, max(c_acctbal) AS worst FROM f JOIN customer ON c_custkey = id GROUP BY key",
        "secret_masking": "SELECT doc_id, i AS match_seq, left(m, 4) || '****' || right(m, 3) AS shown FROM (SELECT doc_id, unnest(range(len(ms))) AS i, unnest(ms) AS m FROM (SELECT doc_id, regexp_extract_all(text, '(?:password|secret|token|api_key)\\s*=\\s*\"[^\"]{8,}\"', 0) AS ms FROM documents))",
        "script_tags_in_pages": "SELECT page_id, len(regexp_extract_all(html, '(?i)<script', 0)) AS scripts, len(regexp_extract_all(html, 'href=', 0)) AS links FROM pages",
        "events_findings_per_window": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS severity, count(*) AS n FROM events GROUP BY ALL",
        "fix_templates": f"SELECT key, fixed_code, method, fixed_code IS NOT NULL AS success FROM (SELECT o_orderkey AS key, {picked_sql(f[3] for f in FIXES)} AS fixed_code, {picked_sql(f[4] for f in FIXES)} AS method FROM orders)",
        "fix_all_code": f"WITH corpus AS ({corpus_sql(CODE)}) SELECT key, regexp_replace(text, 'eval\\s*\\(\\s*([^)]+)\\s*\\)', 'JSON.parse(\\1)', 'g') AS fixed_code FROM corpus WHERE language = 'javascript' AND regexp_matches(text, 'eval\\s*\\(\\s*([^)]+)\\s*\\)')",
        "diff_lines": f"WITH corpus AS ({corpus_sql(CODE)}), f AS (SELECT key, string_split(text, chr(10)) AS a, string_split(regexp_replace(text, 'eval\\s*\\(\\s*([^)]+)\\s*\\)', 'JSON.parse(\\1)', 'g'), chr(10)) AS b FROM corpus WHERE language = 'javascript' AND regexp_matches(text, 'eval\\s*\\(\\s*([^)]+)\\s*\\)')) SELECT key, list_aggregate(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN a[i] = b[i] THEN '  ' || a[i] || chr(10) ELSE '- ' || a[i] || chr(10) || '+ ' || b[i] || chr(10) END), 'string_agg', '') AS diff FROM f",
    }
    return out | scripts_sql()
