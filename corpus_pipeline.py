"""A training corpus from raw documents: STAGES in order, each over all that the stage before it kept.

A stage takes (spark, docs, sf_dir) and gives a DataFrame.  Between stages the rows go to a table in
the folder that all executors share, so that a lost executor costs no finished stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lintlake.llm.common import table, written
from lintlake.llm.mixing import taken_documents
from lintlake.llm.neardup import without_near_duplicates
from lintlake.llm.packing import pack
from lintlake.llm.repeats import without_repeats
from lintlake.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the recurrent network finds toxic go.

    Null and empty texts are scored as an empty word; equal rows are kept or go together; without labels of both kinds
    the network is untrained and what stays says nothing.
    """
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest doc_id (five words, similarity 0.8).

    Texts without words, rows without a doc_id and rows that repeat a kept doc_id stay.
    """
    return without_near_duplicates(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that a smaller doc_id has go; n_chars follows, and a document of which nothing is left goes.

    Null and empty texts stay as they are; rows without a doc_id neither lose nor take anything.
    """
    return without_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, twice at most; repeated rows are drawn each, a null source is one of the sources."""
    return taken_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 2048 tokens; a null or empty text is its end id alone, repeated rows are packed each."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("mixing", mixing), ("packing", packing)]

#: A trained network's scores and the packing are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what the stages keep of ``documents``; no rows of an empty table.  Extra columns pass all stages but the last."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
