"""What must not grow with the tables: the length of a task, the passes over the findings, what Python is given."""

import json

import pandas as pd
from pyspark.sql import functions as F

from lintlake.functions import lexer, tokens
from lintlake.operators import analytics, iac, kernel, remediate, report
from lintlake.plans import corpus, queries
from lintlake.plans.cases import SCRIPTS
from lintlake.rules.catalogue import matched
from lintlake.sources.files import spread


def test_more_rows_make_more_tasks(spark, tmp_path, monkeypatch):
    table = spark.range(0, 1000, 1, 8)
    assert spread(table, 100).rdd.getNumPartitions() == 10 and spread(table, 1000).rdd.getNumPartitions() == 8
    assert sorted(r.id for r in spread(table, 100).collect()) == list(range(1000))
    spark.range(1000).selectExpr("id AS o_orderkey").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(corpus, "TASK", 50)
    texts = corpus.corpus(spark, str(tmp_path), corpus.CODE)
    assert texts.rdd.getNumPartitions() == 20 and texts.select("key").distinct().count() == 1000


def test_only_scripts_with_the_name_are_lexed(spark):
    rows = [("const a = 1;", "eval() Usage"), ("eval (y)", "eval() Usage"), ("eval(y)", "innerHTML Assignment"), ("a.innerHTML = 1", "innerHTML Assignment"), ("random()", "Weak Hash (MD5)"), (None, "eval() Usage")]
    got = spark.createDataFrame(rows, "code string, kind string").select(remediate.lexable(F.col("code"), F.col("kind")).alias("x")).collect()
    assert [r.x for r in got] == [None, "eval (y)", None, "a.innerHTML = 1", None, None]
    texts = ["".join(p for _, p in pieces) for _, pieces, _ in SCRIPTS]
    own = lexer.spans([t.encode() for t in texts])  # lexed together, as one by one
    for kind, name in remediate.REWRITTEN.items():
        for text, spans in zip(texts, own, strict=True):
            assert tokens.edits(text, kind, spans) == tokens.edits(text, kind)
            assert name in text or not tokens.edits(text, kind)


def test_equal_manifests_are_read_once(monkeypatch):
    read = []
    monkeypatch.setattr(iac, "_parsed", lambda t: read.append(t) or [t.upper()])
    got = iac.yaml_documents.func(pd.Series(["a", "b", None, "a", "b", ""], dtype=object)).tolist()
    assert got == [["A"], ["B"], [], ["A"], ["B"], [""]] and read == ["a", "b", ""]


def test_rules_are_tried_once_and_compiled(spark):
    texts = spark.createDataFrame([("f", "javascript", "eval(x)")], "file string, language string, text string")
    found = kernel.scan(texts, matched("xss"))
    assert [r.rule_id for r in found.select("rule_id").collect()] == ["XSS-13"]
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        plan = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    tried = [line for line in plan if "RLIKE(text#" in line]
    assert len(tried) == 1 and "Generate" not in tried[0] and "Filter" not in tried[0]


def counted(spark):
    """Findings of the corpus's texts, and how many rows were worked out of them so far."""
    rows = [(f"f{i}", language, text) for i, (language, text) in enumerate(corpus.CODE)]
    found = kernel.scan(spark.createDataFrame(rows, "file string, language string, text string"), matched("injection", "xss", "crypto"))
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return found, found.mapInArrow(count, found.schema), seen


def test_first_of_each_works_findings_out_once(spark):
    found, watched, seen = counted(spark)
    first = analytics.first_of_each(watched, {"critical": 2, "high": 1}).collect()
    n, per = found.count(), {r.severity: r.n for r in analytics.by_severity(found).collect()}
    assert seen.value == n
    assert sorted((r.severity, r.number, r.more) for r in first) == sorted([("critical", 1, per["critical"] - 2), ("critical", 2, per["critical"] - 2), ("high", 1, per["high"] - 1)])


def test_json_report_works_findings_out_once(spark):
    found, watched, seen = counted(spark)
    got = queries.public_json(watched).collect()
    assert seen.value == found.count() == sum(r.n for r in got)


def test_rule_of_a_report_is_that_of_its_first_finding(spark):
    found, _, _ = counted(spark)
    one = found.where("rule_id = 'XSS-13'").limit(1)
    rows = one.selectExpr("* EXCEPT (file, severity, type)", "inline(array(struct('b' AS file, 'low' AS severity, 'Eval: x' AS type), struct('a' AS file, 'high' AS severity, 'Eval: y' AS type), struct('c' AS file, 'high' AS severity, 'Eval: x' AS type)))")
    got = report.sarif_rules(rows)
    assert [(r.name, r.properties.precision) for r in got.collect()] == [("Eval: y", "high")]
    plan = got._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert next(i for i, x in enumerate(plan) if "regexp_replace" in x) < max(i for i, x in enumerate(plan) if "Aggregate" in x)


def shown(frame):
    """Its optimized plan, in full."""
    frame.sparkSession.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        return frame._jdf.queryExecution().optimizedPlan().toString()
    finally:
        frame.sparkSession.conf.unset("spark.sql.debug.maxToStringFields")


def test_listed_patterns_are_compiled_once_a_task(spark):
    found, _, _ = counted(spark)
    assert shown(found).count(kernel.MARK + "$0") >= len(matched("injection", "xss", "crypto"))  # each a literal; as a column there is one


def test_sarif_tells_the_id_of_a_finding_once(spark):
    found, _, _ = counted(spark)
    assert shown(report.sarif_by_file(found)).count("[^a-z0-9") == 2  # an id has two branches


def test_sarif_of_missing_values_is_json(spark):
    found, _, _ = counted(spark)
    rows = found.where("rule_id = 'XSS-13'").limit(1).selectExpr("* EXCEPT (file, fix, line, type, cwe_id, match)", "CAST(NULL AS string) AS file", "CAST(NULL AS string) AS fix", "CAST(NULL AS int) AS line", "'a \"b\": c' AS type", "CAST(NULL AS string) AS cwe_id", "'' AS match")
    (got,) = report.sarif_by_file(rows).collect()
    run = json.loads(got.report)["runs"][0]
    assert got.file == "unknown" and [r["name"] for r in run["tool"]["driver"]["rules"]] == ['a "b": c'] and "fixes" not in run["results"][0] and run["results"][0]["locations"][0]["physicalLocation"] == {"artifactLocation": {"uri": "unknown"}}
