"""Matches of rules over whole texts, with their lines: one pass of built-in expressions, no shuffle.

Which rules fire in a text is told first: literals that a match must hold are looked up before any pattern runs.
Then a row per text and rule that fires goes through the rest, so that a row holds one copy of its text however
many rules fire.  A copy with a mark before and after each match tells the rest: what stands between two marks is a match, and split into
lines, a line holds as many first marks as matches begin in it.  That is one run of the pattern, linear in the text and the matches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regex import SPACE, required
from ..functions.text import quoted, severity_rank, trimmed_sql
from ..rules.catalogue import KINDS, RULE, Rule, dimension

# Private-use characters before and after a match, and the one that stands for them in the marked copy of a text that has one.
MARK, END, STAND_IN = chr(0xE000), chr(0xE002), chr(0xE001)
# Words that tell that a line cleans what it shows.
CLEANERS = "sanitize|escape|encode|xss|htmlspecialchars|htmlentities"

FINDING = ["file", "language", "scanner", "rule_id", "rule_no", "match_seq", "type", "severity", "severity_rank", "message", "fix", "line", "match", "owasp_category", "cwe_id", "metadata"]
#: In this order a file's findings come.
ORDER = ["file", "rule_no", "match_seq"]
METADATA = ("rule_id", "cis", "pss", "kind", "name", "namespace", "path", "container", "env_var")
#: What a check that is not a pattern gives for each of its findings.
CHECKED = f"scanner: string, rule_id: string, rule_no: int, type: string, severity: string, message: string, fix: string, line: int, match: string, owasp_category: string, cwe_id: string, metadata: struct<{', '.join(m + ': string' for m in METADATA)}>"
CHECKED_COLUMNS = 12
CHECKS = f"array<struct<{CHECKED}>>"
RULE_COLUMNS = [c.split()[0] for c in RULE.split(", ")]


def metadata(**known: Column) -> Column:
    """A finding's metadata; what is not given is null."""
    return F.struct(*(known.get(m, F.lit(None)).cast("string").alias(m) for m in METADATA))


def _comment_sql(line: str, language: str, scanner: str) -> str:
    """SQL of whether a line begins as a comment does in the scanner's view of the language."""
    begins = lambda signs: f"{line} RLIKE {quoted(f'^[{SPACE}]*(?:{signs})')}"
    slashes = begins(r"//|/\*|\*")
    return (
        f"CASE WHEN {scanner} = 'dockerfile' THEN {begins('#')} WHEN {scanner} = 'terraform' THEN {begins('#|//')} WHEN {language} = 'python' THEN {begins('#')}"
        f" WHEN {scanner} = 'injection' AND {language} NOT IN ('javascript', 'typescript', 'java', 'go') THEN {begins('//|#')} ELSE {slashes} END"
    )


def fires(rule: Rule) -> str:
    """SQL of whether a rule has a match in a text: its language, then the literals of any match, then the pattern."""
    if rule.scanner in KINDS:
        tests = [f"language = {quoted(rule.scanner)}"]
    elif rule.languages:
        tests = [f"language IN ({', '.join(map(quoted, rule.languages))})"]
    else:
        tests = [f"coalesce(language NOT IN ({', '.join(map(quoted, KINDS))}), true)"]
    fold = "i" in rule.flags
    for alternatives in required(rule.pattern):
        held = (f"contains({'lowered' if fold else 'text'}, {quoted(x.lower() if fold else x)})" for x in alternatives)
        tests.append(f"({' OR '.join(held)})")
    return " AND ".join([*tests, f"text RLIKE {quoted(rule.java)}"])


def _chosen(values: Sequence[str], start: int = 0) -> str:
    """SQL of the value whose place is in the column ``hit``: halves of halves, so that a row asks for few places."""
    half = len(values) // 2
    return f"IF(hit < {start + half}, {_chosen(values[:half], start)}, {_chosen(values[half:], start + half)})" if half else values[0]


def matches_sql(rule: str = "", text: str = "text", language: str = "language", begins: bool = False, numbers: str = "", patterns: Sequence[str] = ()) -> str:
    """SQL of a rule's matches in a text, as an array of (seq, line, match, out): those in comment lines are left out, and those of the xss scanner in lines that clean.

    rule: what stands before the names of the rule's fields pattern, scanner and snippet.  begins: with ``begin``, the characters before each match.
    numbers: an array of the numbers of the text's lines, where it is some lines of a text; null where it is all of them.
    patterns: those of all rules, of which the column ``hit`` tells the place; a pattern that is a column is compiled anew for each row that has another than the row before.
    """
    number = f"coalesce(get({numbers}, i), i + 1)" if numbers else "i + 1"
    first, last, pattern, scanner, snippet = quoted(MARK), quoted(END), f"{rule}pattern", f"{rule}scanner", f"{rule}snippet"
    odd = f"(contains({text}, {first}) OR contains({text}, {last}))"
    mark = lambda p: f"regexp_replace(IF({odd}, translate({text}, {quoted(MARK + END)}, {quoted(STAND_IN * 2)}), {text}), {p}, {quoted(MARK + '$0' + END)})"
    marked = _chosen([mark(quoted(p)) for p in patterns]) if patterns else mark(pattern)
    found = f"IF({odd}, regexp_extract_all({text}, {pattern}, 0), transform(slice(split(k, {first}), 2, length(k)), p -> substring_index(p, {last}, 1)))"
    lines = f"filter(transform(split(k, '\\n'), (line, i) -> struct({number} AS line, line AS text)), x -> contains(x.text, {first}))"
    own = f"translate(l.text, {quoted(MARK + END)}, '')"
    place = f"struct(l.line AS line, {_comment_sql(own, language, scanner)} AS comment, {scanner} = 'xss' AND lower({own}) RLIKE '{CLEANERS}' AS cleans, IF({snippet} < 0, {trimmed_sql(own)}, NULL) AS shown)"
    places = f"flatten(transform({lines}, l -> array_repeat({place}, CAST(length(l.text) - length(replace(l.text, {first}, '')) AS int))))"
    shown = f"CASE WHEN {snippet} = -80 THEN substring(z.`1`.shown, 1, 80) WHEN {snippet} < 0 THEN z.`1`.shown WHEN {snippet} > 0 THEN substring(z.`0`, 1, {snippet}) ELSE z.`0` END"
    begin = f"aggregate(transform(slice(split(k, {first}), 1, i + 1), p -> length(p)), -i, (a, b) -> a + b) AS begin, " * begins
    each = f"transform(arrays_zip({found}, {places}), (z, i) -> struct({begin}i AS seq, z.`1`.line AS line, {shown} AS match, z.`1`.comment OR z.`1`.cleans AS out))"
    return f"flatten(transform(filter(array({marked}), k -> contains(k, {first})), k -> filter({each}, m -> NOT m.out)))"


def scan(sources: DataFrame, listed: list[Rule], checks: Column | None = None, begins: bool = False, without: tuple[str, ...] = ()) -> DataFrame:
    """One row per match: the columns of FINDING and the other columns of ``sources`` (file, language, text).

    Rules see the text as a whole, so a match may span lines; its line is where it begins.  Matches in comment
    lines go, and those of the xss scanner in lines that clean.  A null text has no matches.  Rules of Dockerfiles
    and Terraform see texts of that ``language`` only, all others no such text.  ``checks``: an array of further findings
    (CHECKED) of each source.  begins: a column ``__begin`` more, the characters before the match (null for a check).  without: columns that only the checks read.  Other columns that are named like those of FINDING are left out.
    """
    others = [c for c in sources.columns if c not in ("text", *FINDING, *without)]
    rest = F.struct(*(sources[c] for c in others)) if others else F.lit(None).cast("string")
    texts = sources.where(F.col("text").isNotNull()).select("file", "language", "text", rest.alias("rest"), F.lower("text").alias("lowered"), (F.lit(None).cast(CHECKS) if checks is None else checks).alias("checks"))
    # Which rules fire is told in a projection of its own.  The filter in it (of nothing, to nothing) keeps it out of whole-stage code, where all rules would be
    # one method, too long for the JVM to compile; inside the generator they would be interpreted.
    fired = F.concat(F.expr(f"CAST(array({', '.join(f'IF({fires(r)}, {i}, NULL)' for i, r in enumerate(listed))}) AS array<int>)"), F.filter(F.array(F.lit(None).cast("int")), lambda i: i.isNotNull()))
    texts = texts.select("file", "language", "text", "rest", "checks", fired.alias("fired"))
    nothing = F.lit(None).cast(f"struct<{CHECKED}>")
    items = F.transform(F.array_compact("fired"), lambda i: F.struct(i.alias("hit"), nothing.alias("c")))
    if checks is not None:
        items = F.concat(items, F.transform("checks", lambda c: F.struct(F.lit(None).cast("int").alias("hit"), c.alias("c"))))
    known = F.broadcast(dimension(sources.sparkSession, listed))  # a row a rule
    each = texts.select("file", "language", "text", "rest", F.posexplode(items).alias("at", "item"))
    hit = each.select("file", "language", "text", "rest", "at", "item.*").join(known, "hit", "inner" if checks is None else "left")

    return findings_of(hit, others, begins, patterns=[r.java for r in listed])


def findings_of(hit: DataFrame, others: list[str], begins: bool = False, numbers: str = "", patterns: Sequence[str] = ()) -> DataFrame:
    """FINDING and ``others`` (fields of ``rest``) from rows of a text and what fires in it: a rule's fields (hit is not null), or a check's finding ``c``.

    numbers: a column of line numbers, and patterns: those of all rules, as for ``matches_sql``.
    """
    kept = [c for c in RULE_COLUMNS if c != "pattern"]
    each = hit.select("file", "language", "rest", "at", "c", *kept, F.explode_outer(F.expr(f"IF(hit IS NULL, NULL, {matches_sql(begins=begins, numbers=numbers, patterns=patterns)})")).alias("m"))
    each = each.where(F.col("hit").isNull() | F.col("m").isNotNull())
    ids = metadata(rule_id=F.col("rule_id"), cis=F.col("cis"))
    each = each.withColumns({"line": F.col("m.line"), "match": F.col("m.match"), "metadata": F.when(F.col("scanner").isin(*KINDS), ids)})
    own = [c.split(":")[0] for c in CHECKED.split(", ")[: CHECKED_COLUMNS]]
    out = each.select("file", "language", "rest", F.coalesce("m.seq", "at").alias("match_seq"), *([F.col("m.begin").alias("__begin")] if begins else []), *(F.when(F.col("hit").isNull(), F.col("c")[c]).otherwise(F.col(c)).alias(c) for c in own))
    return out.withColumn("severity_rank", severity_rank(F.col("severity"))).select(*FINDING, *(["__begin"] if begins else []), *(F.col("rest")[c].alias(c) for c in others))
