"""The same scan over a stream of files, and windowed counts with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import kind_of, language_by_extension
from ..operators.kernel import scan
from ..rules.catalogue import CODE, matched


def arriving(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder as they arrive, with the time of each; a stream of file, language, kind, text, ts."""
    read = spark.readStream.option("wholetext", "true").option("recursiveFileLookup", "true").format("text").load(path)
    texts = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("ts"), F.col("value").alias("text"))
    return texts.select("file", language_by_extension(F.col("file")).alias("language"), kind_of(F.col("file")).alias("kind"), "text", "ts")


def findings(stream: DataFrame) -> DataFrame:
    """Findings of a stream of sources; stateless, so it needs no watermark."""
    return scan(stream.drop("kind"), matched(*CODE))


def per_window(found: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Findings per tumbling window of ts and severity; rows later than the watermark are dropped, which bounds the state."""
    return found.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "severity").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "severity", "n")
