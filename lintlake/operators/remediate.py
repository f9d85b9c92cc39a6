"""Suggested fixes: replacements by finding type and language, and a line diff."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trimmed
from .scripts import SCRIPTS, script_edits, script_spans, spliced

# Finding type, languages, pattern, replacement (Java's $n).
TEMPLATES = (
    ("innerHTML Assignment", "javascript,typescript", r"\.innerHTML\s*=\s*([^;]+)", ".textContent = $1"),
    ("Weak Hash (MD5)", "javascript", r"""crypto\.createHash\s*\(\s*['"]md5['"]\s*\)""", "crypto.createHash('sha256')"),
    ("Weak Hash (MD5)", "python", r"hashlib\.md5\s*\(", "hashlib.sha256("),
    ("Weak Hash (SHA1)", "javascript", r"""crypto\.createHash\s*\(\s*['"]sha1?['"]\s*\)""", "crypto.createHash('sha256')"),
    ("Insecure Random (Math.random)", "javascript,typescript", r"Math\.random\s*\(\s*\)", "crypto.randomBytes(8).toString('hex')"),
    ("AWS Access Key", "javascript", r"""(const|let|var)\s+(\w*[Aa]ws\w*[Kk]ey\w*)\s*=\s*['"]AKIA[A-Z0-9]{16}['"]""", "$1 $2 = process.env.AWS_ACCESS_KEY_ID || ''"),
    ("Google API Key", "javascript", r"""(const|let|var)\s+(\w*[Aa]pi[Kk]ey\w*)\s*=\s*['"]AIza[A-Za-z0-9_-]{35}['"]""", "$1 $2 = process.env.GOOGLE_API_KEY || ''"),
    ("eval() Usage", "javascript", r"eval\s*\(\s*([^)]+)\s*\)", "JSON.parse($1)"),
    ("Disabled SSL Verification", "javascript", r"rejectUnauthorized\s*:\s*false", "rejectUnauthorized: true"),
    ("Disabled SSL Verification", "python", r"verify\s*=\s*False", "verify=True"),
    ("CORS Allow All Origins", "javascript", r"""(?:Access-Control-Allow-Origin|origin)\s*[=:]\s*['"]?\*['"]?""", "origin: process.env.ALLOWED_ORIGIN || 'https://yourdomain.com'"),
    ("JWT No Expiration", "javascript", r"jwt\.sign\s*\(\s*([^,]+),\s*([^)]+)\s*\)", "jwt.sign($1, $2, { expiresIn: '1h' })"),
    ("Path Traversal Risk", "javascript", r"path\.join\s*\(\s*([^,]+),\s*(req\.[^)]+)\s*\)", "path.join($1, path.basename($2))"),
    ("document.write", "javascript", r"document\.write\s*\(\s*([^)]+)\s*\)", "// TODO: build the nodes instead\n// document.write($1)"),
)
QUERY = r"db\.query\s*\(\s*`([^`]*)`\s*\)"
HOLE = r"\$\{([^}]+)\}"


def parameterized(code: Column) -> Column:
    """``db.query(`... ${x} ...`)`` with question marks and a list of parameters; what is around the calls stays."""
    calls, gaps = F.regexp_extract_all(code, F.lit(QUERY), F.lit(1)), F.split(code, QUERY, -1)
    fixed = F.transform(calls, lambda sql: F.concat(F.lit("db.query('"), F.regexp_replace(sql, HOLE, "?"), F.lit("', ["), F.array_join(F.transform(F.regexp_extract_all(sql, F.lit(HOLE), F.lit(1)), trimmed), ", "), F.lit("])")))
    return F.array_join(F.flatten(F.transform(F.arrays_zip(gaps.alias("gap"), fixed.alias("call")), lambda x: F.array(x["gap"], F.coalesce(x["call"], F.lit(""))))), "")


#: Types that scripts are mended for by their tokens, where no template changes anything, and the name without which no token is changed.
REWRITTEN = {"innerHTML Assignment": "innerHTML", "eval() Usage": "eval", "Insecure Random (Math.random)": "random"}


def lexable(code: Column, kind: Column) -> Column:
    """The code if it has the name that a fix by tokens looks for, else null: no other script has to be lexed."""
    return F.coalesce(*(F.when((kind == k) & F.contains(code, F.lit(name)), code) for k, name in REWRITTEN.items()))


def template_edits(code: Column, pattern: Column, made: Callable[[Column], Column]) -> Column:
    """The changes (begin, end, text) that a pattern makes: ``made`` of each of its matches, where it stands."""
    calls, gaps = F.regexp_extract_all(code, pattern, F.lit(0)), F.split(code, pattern, -1)
    before = lambda i: F.aggregate(F.slice(gaps, F.lit(1), i + 1), F.lit(0), lambda n, x: n + F.length(x)) + F.aggregate(F.slice(calls, F.lit(1), i), F.lit(0), lambda n, x: n + F.length(x))
    placed = F.transform(calls, lambda call, i: F.struct(before(i).alias("begin"), call.alias("call")))
    return F.transform(placed, lambda x: F.struct(x["begin"].cast("int").alias("begin"), (x["begin"] + F.length(x["call"])).cast("int").alias("end"), made(x["call"]).alias("text")))


def fixed_in_code(code: Column, kind: Column, language: Column, spans: Column) -> Column:
    """What ``fixed`` gives, with changes only where a match begins in code; ``spans``: of the code, as script_spans tells them."""
    in_code = lambda e: F.exists(spans, lambda s: (s["kind"] == "code") & (s["begin"] <= e["begin"]) & (e["begin"] < s["end"]))
    made = lambda pattern, of: spliced(code, F.filter(template_edits(code, F.lit(pattern), of), in_code))
    out = F.when((kind == "Template Literal SQL") & language.isin("javascript", "typescript"), made(QUERY, parameterized))
    for name, languages, pattern, replacement in TEMPLATES:
        out = out.when((kind == name) & language.isin(*languages.split(",")), made(pattern, lambda call, p=pattern, r=replacement: F.regexp_replace(call, F.lit(p), F.lit(r))))
    return out


def fixed(code: Column, kind: Column, language: Column) -> Column:
    """The code with the fix of this finding type; null if there is none for the language."""
    out = F.when((kind == "Template Literal SQL") & language.isin("javascript", "typescript"), parameterized(code))
    for name, languages, pattern, replacement in TEMPLATES:
        out = out.when((kind == name) & language.isin(*languages.split(",")), F.regexp_replace(code, F.lit(pattern), F.lit(replacement)))
    return out


def line_diff(old: Column, new: Column) -> Column:
    """Line by line, not aligned: two spaces before equal lines, - and + before others; an empty side is not printed."""
    side = lambda x: F.coalesce(x, F.lit(""))
    pairs = F.arrays_zip(F.split(old, "\n").alias("a"), F.split(new, "\n").alias("b"))
    show = lambda sign, x: F.when(side(x) != "", F.concat(F.lit(sign), x, F.lit("\n"))).otherwise("")
    return F.array_join(F.transform(pairs, lambda p: F.when(side(p["a"]) == side(p["b"]), F.concat(F.lit("  "), side(p["a"]), F.lit("\n"))).otherwise(F.concat(show("- ", p["a"]), show("+ ", p["b"])))), "")


# What else to know about some types of findings.
EXPLANATIONS = (
    ("innerHTML Assignment", "Markup from outside can carry script that runs as the page. Set text instead; where markup is needed, clean it, or leave escaping to the framework."),
    ("Template Literal SQL", "Whoever controls a value controls the query. Use prepared statements or a mapper, and allow only values you expect."),
    ("Weak Hash (MD5)", "Collisions can be made in seconds, and tables of hashes are published. Use SHA-256 for data, bcrypt or argon2 for passwords, an HMAC for signatures."),
    ("eval() Usage", "Any code in the string runs with the page's rights. Parse data as JSON, write functions out, or use an evaluator for expressions only."),
)


def explanation(issues: DataFrame) -> Column:
    """A text on an issue: type, severity, line, message, fix, what else is known, category and weakness.

    issues: type, and of severity, message, fix, line, owasp_category, cwe_id what there is.
    """
    has = lambda c, default=None: F.coalesce(F.col(c).cast("string"), F.lit(default)) if c in issues.columns else F.lit(default).cast("string")
    more = F.try_element_at(F.create_map(*(F.lit(x) for pair in EXPLANATIONS for x in pair)), F.col("type"))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("## Finding: "), F.col("type")),
        F.lit(""),
        F.concat(F.lit("**Severity**: "), has("severity", "high")),
        F.concat(F.lit("**Place**: line "), has("line", "?")),
        F.lit(""),
        F.concat(F.lit("**Problem**:\n"), has("message", "A weakness was found.")),
        F.lit(""),
        F.concat(F.lit("**Solution**:\n"), has("fix", "Change the code.")),
        F.concat(F.lit("\n"), more),
        F.concat(F.lit("\n**OWASP**: "), has("owasp_category")),
        F.concat(F.lit("**CWE**: "), has("cwe_id")),
    )


def suggestions(issues: DataFrame, only_code: bool = False) -> DataFrame:
    """issues: code, type, language.  Adds fixed_code (null without a fix), diff, success, method (template, ast or none), explanation and report.

    The templates come first, which are patterns over the whole text; ``only_code``: in scripts they change nothing in strings, templates
    or comments.  Then scripts are mended by their tokens, which never change these.
    """
    code, kind, language = F.col("code"), F.col("type"), F.col("language")
    script, template = language.isin(*SCRIPTS), fixed(code, kind, language)
    if only_code:
        issues = issues.withColumn("__spans", script_spans(F.when(script, code)))
        template = F.when(script, fixed_in_code(code, kind, language, F.col("__spans"))).otherwise(template)
    tried = issues.select("*", explanation(issues).alias("explanation"), F.when(template != code, template).alias("by_template"))
    wanted = F.when(F.col("by_template").isNull() & script, lexable(code, kind))
    tried = tried.withColumn("__edits", script_edits(wanted, kind))
    tried = tried.withColumn("by_rewriting", F.when(F.size("__edits") > 0, spliced(code, F.col("__edits"))))
    tried = tried.withColumn("fixed_code", F.coalesce("by_template", "by_rewriting"))
    method = F.when(F.col("by_template").isNotNull(), "template").when(F.col("by_rewriting").isNotNull(), "ast").otherwise("none")
    out = tried.withColumns({"method": method, "success": F.col("fixed_code").isNotNull(), "diff": F.when(F.col("fixed_code").isNotNull(), line_diff(code, F.col("fixed_code"))).otherwise("")})
    failed = F.concat(F.lit("## No automatic fix\n\nThis finding has to be fixed by hand.\n\n"), F.col("explanation"))
    way = F.when(F.col("method") == "template", "template").otherwise("rewriting")
    done = F.concat(F.lit("## Suggested fix\n\n**Method**: "), way, F.lit("\n\n### Changes\n\n```diff\n"), F.col("diff"), F.lit("```\n\n### Explanation\n\n"), F.col("explanation"), F.lit("\n\n### Fixed code\n\n```"), language, F.lit("\n"), F.col("fixed_code"), F.lit("\n```\n"))
    return out.drop("by_template", "by_rewriting", "__edits", "__spans").withColumn("report", F.when(F.col("success"), done).otherwise(failed))
