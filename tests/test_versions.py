"""Version keys and the binned join against a loop over all pairs."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lintlake.operators import versions


def compared(a, b):
    """-1, 0 or 1 by parts, as versions compare."""

    def number(x):
        try:
            return float(x)
        except ValueError:
            return 0.0

    x, y = ([number(p) for p in "".join(c for c in v if c not in "^~><=").split(".")] for v in (a, b))
    for i in range(max(len(x), len(y))):
        p, q = (z[i] if i < len(z) else 0.0 for z in (x, y))
        if p != q:
            return -1 if p < q else 1
    return 0


def test_keys_sort_as_versions(spark):
    some = ["1", "1.0", "1.0.0", "^1.2", "~1.10.3", "1.2.beta", "", "0", "1..2", "1.-1", "1.2.3.4.5.6.7.8.9.10.11", "1.2.3.4.5.6.7.8.9.10.12", "10.0", "9.99", " 3 ", "x", ">=2.0.0"]
    rows = spark.createDataFrame([(a, b) for a in some for b in some], "a string, b string")
    k, m = versions.version_key(F.col("a")), versions.version_key(F.col("b"))
    for r in rows.select("a", "b", F.when(k < m, -1).when(k == m, 0).otherwise(1).alias("c")).collect():
        assert r.c == compared(r.a, r.b), r


@pytest.mark.parametrize("width", [2, 5, 64])
def test_join_as_by_all_pairs(spark, monkeypatch, width):
    monkeypatch.setattr(versions, "BIN", width)
    rng = random.Random(width)
    version = lambda: ".".join(str(rng.choice([0, 0, 1, 2, 3, 10])) for _ in range(rng.randrange(1, 11)))
    maybe = lambda: None if rng.random() < 0.15 else version()
    uses = [(i, rng.choice(["npm", "pip", None]), rng.choice(["hot", "hot", "a", "b", None, "none"]), maybe(), "mine") for i in range(150)]
    known = [(j, rng.choice(["npm", "pip"]), rng.choice(["hot", "hot", "a", "b"]), maybe(), maybe()) for j in range(120)] + [(120, "npm", "hot", None, None), (120, "npm", "hot", None, None)]
    d = spark.createDataFrame(uses, "id int, ecosystem string, package string, version string, advisory_note string")
    a = spark.createDataFrame(known, "id int, ecosystem string, package string, introduced string, fixed string")
    got = Counter((r.id, r.advisory.id) for r in versions.affected(d, a).collect())

    def holds(v, lo, hi):
        if v is None:
            return lo is None and hi is None
        return (lo is None or compared(lo, v) <= 0) and (hi is None or compared(v, hi) < 0)

    assert got == Counter((u[0], k[0]) for u in uses for k in known if u[1] == k[1] and u[2] == k[2] and holds(u[3], k[3], k[4])) and got
    plan = versions.affected(d, a)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty_tables(spark):
    d, a = spark.createDataFrame([], "ecosystem string, package string, version string"), spark.createDataFrame([], "ecosystem string, package string, introduced string, fixed string")
    one = spark.createDataFrame([("npm", "a", "1")], d.schema)
    assert versions.affected(d, a).count() == versions.affected(one, a).count() == 0
    assert versions.affected(d, spark.createDataFrame([("npm", "a", None, None)], a.schema)).count() == 0


def test_totals_as_by_all_pairs(spark):
    rng = random.Random(7)
    maybe = lambda: rng.choice([None, "1", "1.0", "1.2", "2", "2.5", "3"])
    d = spark.createDataFrame([(i % 40, rng.choice(["npm", None]), rng.choice(["a", "b", None]), maybe()) for i in range(60)], "id int, ecosystem string, package string, version string")
    a = spark.createDataFrame([(j, "npm", rng.choice(["a", "b", None]), maybe(), maybe()) for j in range(80)], "note long, ecosystem string, package string, introduced string, fixed string")
    by = ["id", "version"]
    want = versions.affected(d, a).groupBy(*by).agg(F.count("*").alias("n"), F.max("advisory.note").alias("last"), F.sum("advisory.note").alias("sum"))
    got = versions.affected_totals(d, a, "note").groupBy(*by).agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.sum("sum").alias("sum"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() and [f.dataType for f in got.schema] == [f.dataType for f in want.schema]


def test_totals_join_no_more_for_repeated_rows(spark, monkeypatch):
    joined, held = [], versions._held
    monkeypatch.setattr(versions, "_held", lambda *tables: joined.append(held(*tables)) or joined[-1])
    d = spark.createDataFrame([("npm", "a", "1.5")] * 30, "ecosystem string, package string, version string")
    a = spark.createDataFrame([(j, "npm", "a", "1", "2") for j in range(50)], "note long, ecosystem string, package string, introduced string, fixed string")
    got = versions.affected_totals(d, a, "note").collect()
    assert [(r.n, r.last, r.sum) for r in got] == [(50, 49, 1225)] * 30 and joined[0].count() == 1
