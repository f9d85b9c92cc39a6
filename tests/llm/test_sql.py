"""The operators that SQL can express against their SQL: a whole table, and the awkward cases."""

from collections import Counter

import duckdb
import pandas as pd
import pytest

from lintlake.llm import chat, neardup, repeats, runs
from lintlake.llm.queries import oracle_sql, queries

from .cases import docs, texts

SMALL = "/root/testdata/sf0.001"
SQL = oracle_sql()


def same(got, con, name):
    want = con.execute(SQL[name]).to_arrow_table()
    columns = sorted(got.columns)
    assert sorted(want.column_names) == columns
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(tuple(r[c] for c in columns) for r in want.to_pylist())


@pytest.mark.parametrize("name", sorted(SQL))
def test_operator_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    same(queries()[name](spark, SMALL), con, name)


def test_awkward_documents_equal_sql(spark):
    items = [(i, t, s) for i, t, s in texts() if i != 17 and not (t and "\x00" in t)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [x[:2] for x in items])
    same(repeats.repeated_spans(docs(spark, items)), con, "op5_suffix_array_dedup")
    same(runs.digests(runs.run_spans(docs(spark, items), runs.stuttered)), con, "op11_periodic_run_detection")
    known = [x for x in items if x[0] is not None]
    con.execute("DELETE FROM documents WHERE doc_id IS NULL")
    same(neardup.near_duplicates(docs(spark, known)), con, "op6_minhash_near_dedup")


def test_awkward_turns_equal_sql(spark):
    said = [(1, 0, "system", "be </s>"), (1, 1, "user", "a\\b<\\s>"), (1, 2, "assistant", "[INST]"), (1, 2, "assistant", "[INST]é"), (1, None, "user", None), (2, 5, "assistant", ""), (3, 1, "user", "no reply [/INST]"), (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    con = duckdb.connect()
    frame = pd.DataFrame([r for r in said if r[0] != -7], columns=["conv_id", "turn", "role", "text"]).astype({"turn": "Int64"})  # noqa: F841
    con.execute("CREATE TABLE conversations AS SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, role, text FROM frame")
    same(chat.digests(chat.examples(spark.createDataFrame(said, "conv_id long, turn long, role string, text string"))), con, "op9_chat_formatting")
