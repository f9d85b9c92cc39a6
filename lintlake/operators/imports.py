"""Reports of other tools as findings: where a tool keeps what is data, a row for each field, so a further tool needs no code.

A row of the mapping: ``tool``; ``field`` (one of FIELDS, or ``items``); ``seq``, the order in which a field's rows are tried; ``path``, a
JSON path; ``value``, what a field is if the path has nothing; ``words``, a map that translates what the path has.  Of ``items``, the rows are
the steps to a report's findings, outermost first: each path leads to an array or to an object, whose members are gone through.  ``@key``
as the path of another field is the name that the innermost object gives the item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SEVERITIES, severity_rank
from .kernel import FINDING, metadata

MAPPING = "tool string, field string, seq int, path string, value string, words map<string, string>"
#: Fields of a finding that a mapping may tell.
FIELDS = ("file", "language", "rule_id", "type", "severity", "message", "fix", "line", "match", "owasp_category", "cwe_id")
#: The largest mapping that is sent to all executors; a longer one is joined as any table.
MOST = 10_000

#: SARIF logs, and audit reports of packages by name: tool, field, seq, path, value, words.
KNOWN = (
    ("sarif", "items", 1, "$.runs", None, None),
    ("sarif", "items", 2, "$.results", None, None),
    ("sarif", "rule_id", 1, "$.ruleId", None, None),
    ("sarif", "type", 1, "$.ruleId", None, None),
    ("sarif", "severity", 1, "$.level", "medium", {"error": "high", "warning": "medium", "note": "low"}),
    ("sarif", "message", 1, "$.message.text", None, None),
    ("sarif", "message", 2, "$.message.markdown", None, None),
    ("sarif", "file", 1, "$.locations[0].physicalLocation.artifactLocation.uri", None, None),
    ("sarif", "line", 1, "$.locations[0].physicalLocation.region.startLine", None, None),
    ("sarif", "match", 1, "$.locations[0].physicalLocation.region.snippet.text", None, None),
    ("audit", "items", 1, "$.vulnerabilities", None, None),
    ("audit", "rule_id", 1, "@key", None, None),
    ("audit", "type", 1, None, "Vulnerable Package", None),
    ("audit", "severity", 1, "$.severity", "low", {"critical": "critical", "high": "high", "moderate": "medium"}),
    ("audit", "message", 1, "$.via[0].title", "A vulnerability was found.", None),
    ("audit", "match", 1, "$.range", None, None),
)

#: Of an item and a step, the items below it; of neither an array nor an object, none.
_BELOW = """coalesce(
    transform(try_variant_get(x.v, s.path, 'array<variant>'), y -> struct(x.k AS k, y AS v)),
    transform(map_entries(try_variant_get(x.v, s.path, 'map<string, variant>')), e -> struct(e.key AS k, e.value AS v)),
    array())"""
_ITEMS = f"aggregate(steps, array(struct(CAST(NULL AS string) AS k, report AS v)), (found, s) -> flatten(transform(found, x -> {_BELOW})))"


def _told(field: str) -> Column:
    """What the first of a field's rows that has something says of an item."""
    have = "IF(r.path = '@key', item.k, try_variant_get(item.v, r.path, 'string'))"
    said = f"transform(filter(fields, f -> f.field = '{field}'), r -> coalesce(IF(r.words IS NULL, {have}, coalesce(try_element_at(r.words, {have}), r.value)), r.value))"
    return F.expr(f"get(filter({said}, x -> x IS NOT NULL), 0)")


def mapping(spark: SparkSession, *more: tuple) -> DataFrame:
    """KNOWN and further rows as a MAPPING."""
    return spark.createDataFrame([*KNOWN, *more], MAPPING)


def by_tool(rows: DataFrame) -> DataFrame:
    """tool, steps, fields: a row per tool."""
    steps = F.expr("array_sort(collect_list(struct(seq, path)) FILTER (WHERE field = 'items'))")
    place = "struct(coalesce({0}.seq, 0), coalesce({0}.path, ''), coalesce({0}.value, ''))".format
    order = f"(a, b) -> CASE WHEN {place('a')} < {place('b')} THEN -1 WHEN {place('a')} > {place('b')} THEN 1 ELSE 0 END"
    fields = F.expr(f"array_sort(collect_list(struct(seq, field, path, value, words)) FILTER (WHERE field <> 'items'), {order})")
    return rows.groupBy("tool").agg(steps.alias("steps"), fields.alias("fields"))


def imported(reports: DataFrame, rows: DataFrame) -> DataFrame:
    """Findings that reports (tool, file, text: JSON) hold, by the rows of a mapping (MAPPING): FINDING columns, the other columns of ``reports``, the CVE ids named in the item as ``cve_ids``, and the item itself as a VARIANT named ``item``.

    Map-only: a report is parsed once, its items are gone through in one expression, no field has a plan of its own, and no Python runs.  ``match_seq`` numbers the
    items of a report; ``scanner`` is the tool.  A field without a row, or of which no row has anything, is null, but for ``file`` (then
    the report's own) and ``severity`` (then low, as for a word that is none of the known four).  Text that is no JSON, null text, and tools without a mapping give no findings;
    ``unmapped`` lists these.  Other columns that are named like those of FINDING, ``cve_ids`` or ``item`` are left out.
    """
    others = [c for c in reports.columns if c not in ("tool", "text", "cve_ids", "item", *FINDING)]
    rest = F.struct(*(reports[c] for c in others)) if others else F.lit(None).cast("string")
    known = by_tool(rows)
    if len(rows.head(MOST + 1)) <= MOST:
        known = F.broadcast(known)
    read = reports.select("tool", F.col("file").alias("own"), rest.alias("rest"), F.try_parse_json("text").alias("report")).where("report IS NOT NULL").join(known, "tool")
    each = read.select("tool", "own", "rest", "fields", F.posexplode(F.expr(_ITEMS)).alias("match_seq", "item"))
    told = each.select("tool", "own", "rest", "match_seq", F.col("item.v").alias("item"), *(_told(f).alias(f) for f in FIELDS))
    graded = F.lower("severity")
    out = told.withColumns({
        "file": F.coalesce("file", "own"), "scanner": F.col("tool"), "rule_no": F.lit(950), "line": F.expr("try_cast(line AS int)"),
        "severity": F.when(graded.isin(*SEVERITIES), graded).otherwise("low"), "metadata": F.when(F.lit(False), metadata()),
        "cve_ids": F.expr(r"array_sort(array_distinct(regexp_extract_all(to_json(item), r'CVE-\d{4}-\d{4,}', 0)))"),
    }).withColumn("severity_rank", severity_rank(F.col("severity")))
    return out.select(*FINDING, *(F.col("rest")[c].alias(c) for c in others), "cve_ids", "item")


def unmapped(reports: DataFrame, rows: DataFrame) -> DataFrame:
    """tool, file, why: the reports that ``imported`` cannot read: ``text`` (no JSON), ``tool`` (no rows of the mapping)."""
    tools = rows.select("tool", F.lit(True).alias("known")).distinct()
    parsed = reports.join(tools, "tool", "left").withColumn("why", F.when(F.try_parse_json("text").isNull(), "text").when(F.col("known").isNull(), "tool"))
    return parsed.where("why IS NOT NULL").select("tool", "file", "why")
