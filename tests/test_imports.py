"""Reports of other tools against a walk over the parsed JSON; sketches against exact counts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lintlake import api
from lintlake.operators import analytics, imports
from lintlake.operators.kernel import FINDING

OWN = (("own", "items", 1, "$.a", None, None), ("own", "items", 2, "$.b", None, None), ("own", "items", 3, "$.c", None, None), ("own", "rule_id", 2, "$.id", None, None), ("own", "rule_id", 1, "$.code", None, None), ("own", "rule_id", 3, "@key", None, None), ("own", "severity", 1, "$.grade", None, {"1": "critical", "2": "high"}))


def below(key, node, path):
    for part in path.split(".")[1:]:
        node = node.get(part) if isinstance(node, dict) else None
    return sorted(node.items()) if isinstance(node, dict) else [(key, x) for x in node] if isinstance(node, list) else []


def walked(report):
    items = [(None, report)]
    for path in ("$.a", "$.b", "$.c"):
        items = [y for k, x in items for y in below(k, x, path)]
    out = []
    for i, (key, v) in enumerate(items):
        d = v if isinstance(v, dict) else {}
        out.append((i, next((str(x) for x in (d.get("code"), d.get("id"), key) if x is not None), None), {"1": "critical", "2": "high"}.get(str(d.get("grade")), "low")))
    return out


def made(rng, depth=0):
    """A tree whose levels are arrays or objects, some of them missing or of another kind."""
    if depth == 3:
        return rng.choice([7, None, {"id": rng.randrange(9)}, {"code": "x", "id": 1, "grade": rng.choice(["1", 2, "z", None])}, {"grade": 1}, {}])
    name, odd = "abc"[depth], rng.random()
    if odd < 0.1:
        return rng.choice([{}, {name: 3}, {name: "s"}, {name: None}, 5])
    kids = [made(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {name: kids if odd < 0.6 else {f"k{i}": k for i, k in enumerate(kids)}}


def test_imports_equal_a_walk(spark):
    rng = random.Random(3)
    reports = {f"f{i}": made(rng) for i in range(200)}
    rows = [("own", f, json.dumps(r), i) for i, (f, r) in enumerate(reports.items())] + [("own", "bad", "{", 0), ("own", "none", None, 0), ("other", "o", "{}", 0)]
    df = spark.createDataFrame(rows, "tool string, file string, text string, extra int")
    got = imports.imported(df, imports.mapping(spark, *OWN))
    assert got.columns == [*FINDING, "extra", "cve_ids", "item"]
    seen = sorted((r.file, r.match_seq, r.rule_id, r.severity) for r in got.select("file", "match_seq", "rule_id", "severity").collect())
    assert seen == sorted((f, *x) for f, r in reports.items() for x in walked(r)) and len(seen) > 100
    lost = imports.unmapped(df, imports.mapping(spark, *OWN))
    assert sorted((r.file, r.why) for r in lost.collect()) == [("bad", "text"), ("none", "text"), ("o", "tool")]


def test_a_long_mapping_is_not_broadcast_and_clashes_go(spark, monkeypatch):
    text = json.dumps({"runs": [{"results": [{"ruleId": "A", "level": "error", "locations": [{"physicalLocation": {"artifactLocation": {"uri": "x.js"}, "region": {"startLine": 4}}}]}, {"ruleId": "B"}]}, {"results": [{"level": "none"}]}]})
    df = spark.createDataFrame([("sarif", "log", text, "mine", 1), ("sarif", "log", text, "mine", 1)], "tool string, file string, text string, severity string, item int")
    want = sorted([("x.js", "A", "high", 4), ("log", "B", "medium", None), ("log", None, "medium", None)] * 2, key=repr)
    for most in (imports.MOST, 3):
        monkeypatch.setattr(imports, "MOST", most)
        got = imports.imported(df, imports.mapping(spark)).select("file", "rule_id", "severity", "line").collect()
        assert sorted(map(tuple, got), key=repr) == want
    assert imports.imported(df.where("false"), imports.mapping(spark)).count() == 0


def test_the_item_is_kept_whole(spark):
    df = spark.createDataFrame([("audit", "r", '{"vulnerabilities": {"p": {"range": "<2", "odd": {"deep": [1, 2]}}}}')], "tool string, file string, text string")
    assert imports.imported(df, imports.mapping(spark)).select(F.expr("variant_get(item, '$.odd.deep[1]', 'int')")).first()[0] == 2


@pytest.mark.parametrize("registers", [10, 14])
def test_sketches_of_scans_merge(spark, tmp_path, registers):
    """Scans overlap by half; each is kept as a table of sketches, and only these are read."""
    for i in range(3):
        found = spark.range(i * 10_000, i * 10_000 + 20_000).select(F.concat(F.lit("f"), "id").alias("file"), F.concat(F.lit("r"), F.col("id") % 37).alias("rule_id"), (F.col("id") % 2).alias("severity"))
        analytics.sketched(found, "severity", registers=registers - (i == 2)).write.parquet(f"{tmp_path}/scan={i}")
    got = {r.severity: r for r in analytics.merged(spark.read.parquet(str(tmp_path)), "severity").collect()}
    assert sorted(got) == [0, 1]
    for r in got.values():
        assert r.n == 30_000 and r.error == pytest.approx(3 * 1.04 / 2 ** ((registers - 1) / 2))
        assert abs(r.files - 20_000) <= r.error * 20_000 and abs(r.rules - 37) <= max(1, r.error * 37)


def test_sketches_of_nothing(spark):
    none = spark.createDataFrame([], "file string, rule_id string, severity string")
    assert analytics.merged(analytics.sketched(none, "severity"), "severity").count() == 0
    nulls = spark.createDataFrame([(None, None, None), (None, "r", None)], "file string, rule_id string, severity string")
    row = analytics.merged(analytics.sketched(nulls, "severity"), "severity").first()
    assert (row.severity, row.n, row.files, row.rules) == (None, 2, 0, 1)


def test_the_report_resolves_ids_of_imported_findings(spark):
    package = lambda *ids: {"severity": "high", "via": [{"title": "t", "url": f"https://x.org/{i}"} for i in ids]}
    text = json.dumps({"vulnerabilities": {"p": package("CVE-2020-0001", "CVE-2021-12345"), "q": package("CVE-2021-12345", "CVE-2021-12345"), "r": package("CVE-1999-9999"), "s": package()}})
    found = api.import_reports(spark.createDataFrame([("audit", "lock", text)], "tool string, file string, text string"))
    assert [r.cve_ids for r in found.orderBy("match_seq").collect()] == [["CVE-2020-0001", "CVE-2021-12345"], ["CVE-2021-12345"], ["CVE-1999-9999"], []]
    known = spark.createDataFrame([("CVE-2020-0001", 9.8), ("CVE-2021-12345", None)], "id string, score double")
    sources = spark.createDataFrame([("a.js", "javascript", "code", "eval(x);")], "file string, language string, kind string, text string")
    lines = "\n".join(r.line for r in api.security_report(sources, "markdown", found, known)["markdown"].collect())
    assert lines.count("CVE-2020-0001** (CVSS: 9.8)") == 1 and lines.count("CVE-2021-12345** (CVSS: N/A)") == 2 and "CVE-1999" not in lines
    assert "eval" in lines and lines.count("Vulnerable Package") >= 4
