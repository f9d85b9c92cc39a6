"""Source texts from folders, tables and strings: file, language, kind, text."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import basename, kind_of, language_by_extension, language_by_tool, matches_any

# What a folder scan takes and leaves out unless told otherwise.
INCLUDE = ("*.js", "*.ts", "*.py", "*.java", "*.go")
EXCLUDE = ("node_modules", "dist", "build", ".git")


def routed(texts: DataFrame) -> DataFrame:
    """file and text with language and kind by file name."""
    return texts.select("file", language_by_extension(F.col("file")).alias("language"), kind_of(F.col("file")).alias("kind"), "text")


def folder(spark: SparkSession, path: str, include: tuple[str, ...] = INCLUDE, exclude: tuple[str, ...] = EXCLUDE) -> DataFrame:
    """All files below a path whose name is included and no part of whose path below it is excluded."""
    read = spark.read.option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").text(path, wholetext=True)
    texts = read.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return routed(texts.where(_below(path, include, exclude)))


def _below(path: str, include: tuple[str, ...], exclude: tuple[str, ...]) -> Column:
    root = path.split("://", 1)[-1].rstrip("/")
    return selected(F.element_at(F.split("file", F.lit(r"\Q" + root + r"\E"), 2), -1), include, exclude)


def _is_file(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile()


def listing(spark: SparkSession, path: str, include: tuple[str, ...] = INCLUDE, exclude: tuple[str, ...] = EXCLUDE) -> DataFrame:
    """file: what ``target`` takes of a folder or file, by name alone, so that a file that cannot be read is listed too; no contents are read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("_metadata.file_path").alias("file"))
    return listed if _is_file(spark, path) else listed.where(_below(path, include, exclude))


def unread(listed: DataFrame, sources: DataFrame) -> DataFrame:
    """file: files that are listed but of which the sources have no text."""
    return listed.join(sources.where(F.col("text").isNotNull()).select("file"), "file", "left_anti")


def selected(path: Column, include: tuple[str, ...] = INCLUDE, exclude: tuple[str, ...] = EXCLUDE) -> Column:
    """Whether a path below the scanned folder is taken: its name is included, and neither it nor a folder on the way is excluded."""
    return matches_any(basename(path), list(include)) & ~F.exists(F.split(path, "/"), lambda p: (p != "") & matches_any(p, list(exclude)))


def target(spark: SparkSession, path: str, include: tuple[str, ...] = INCLUDE, exclude: tuple[str, ...] = EXCLUDE) -> DataFrame:
    """A folder's selected files, or a single file whatever its name."""
    return single(spark, path) if _is_file(spark, path) else folder(spark, path, include, exclude)


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Rows of a table that Spark reads in fewer splits than the cluster has cores, dealt out evenly: small tables whose only row group would be one task's work.

    Splits are counted, not files, so that a table of few large files is read as it is.  rows: what a task should get at most, for narrow rows that much is made
    of: a split of keys is some millions of texts, so that a table which grows would make its tasks longer and not more.
    """
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    wanted = max(cores, -(-df.count() // rows) if rows else 0)
    return df.repartition(wanted) if splits < wanted else df


def kept(df: DataFrame) -> DataFrame:
    """The rows, worked out once for all that is read of them: a table below spark.checkpoint.dir; where that is not set, held by the executors."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df.persist()
    path = f"{folder}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def single(spark: SparkSession, path: str) -> DataFrame:
    """One file; neither included nor excluded names count."""
    read = spark.read.text(path, wholetext=True)
    return routed(read.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")))


def inline(spark: SparkSession, code: str, language: str | None = None, file: str = "inline") -> DataFrame:
    """A string as a source; its language is told from the text unless given."""
    texts = spark.createDataFrame([(file, code)], "file string, text string")
    return texts.select("file", (F.lit(language) if language else language_by_tool(F.col("text"))).alias("language"), F.lit("code").alias("kind"), "text")
