"""What the operators share: reading tables, scratch tables, Arrow batches, words, bounded samples."""

from __future__ import annotations

import hashlib
import itertools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of every contract here: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: The same characters as bytes; ``bytes.split()`` splits at exactly these.
SPACES = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.  Where it is unset, a temporary one in local mode; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or f"file://{tempfile.gettempdir()}/lintlake-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cuts the lineage: writes df as a table in the shared folder and reads it back.

    A lost executor costs the tasks that run at that moment, never the finished table.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=partition_by or [])
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that no later plan reads."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stable_hash(words: list[bytes]) -> np.ndarray:
    """64 bits of each word, the same in every process."""
    ids: dict[bytes, int] = {}
    flat = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    digest = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=8).digest() for w in ids), np.uint64)
    return digest[flat] if len(flat) else np.zeros(0, np.uint64)


def text_bytes() -> Column:
    """UTF-8 bytes of the text; a null text has none."""
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")


def blocks(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices a batch with a ``text`` column so that a slice has about ``most`` bytes of text, one row at least."""
    ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch["text"]), 0), dtype=np.int64))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right"))
        stop = max(stop, start + 1)
        yield batch.slice(start, stop - start)
        start = stop


def encoded(batch: pa.RecordBatch) -> list[bytes]:
    """The texts as UTF-8; a null text is empty."""
    return [x or b"" for x in pa.compute.cast(batch["text"], pa.binary()).to_pylist()]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, most_bytes: int, residue: tuple[int, int] | None = None) -> DataFrame:
    """(doc_id, text, y): at most ``rows`` labelled documents of at most ``most_bytes`` bytes, half of them of each class where there are as many.

    The sample is the lowest by a hash of doc_id, so reruns agree.  residue=(m, r) leaves out
    the rows whose crc32(doc_id as text) mod m is r.  The sample's ids are few (``rows``), which
    bounds what is broadcast.
    """
    wanted = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    if residue:
        wanted = wanted.where(~held_out(*residue))
    parts = [wanted.where(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(rows // 2) for y in (0, 1)]
    ids = written(parts[0].unionByName(parts[1]), "sample").select("doc_id", "y")
    return docs.select("doc_id", "text").where(text_bytes() <= most_bytes).join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"])


def collected(sample: DataFrame) -> list[tuple[bytes, int]]:
    """The bounded sample on the driver, in the order of doc_id."""
    rows = sorted(sample.select("doc_id", "text", "y").collect(), key=lambda r: r.doc_id)
    return [((r.text or "").encode(), int(r.y)) for r in rows]


def held_out(modulus: int, residue: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == residue


def flat(lists: list[list]) -> list:
    return list(itertools.chain.from_iterable(lists))


def best_cut(logit: np.ndarray, y: np.ndarray, share: float, slack: float = 0.0) -> float:
    """The lowest cut between two logits whose F1 of label 1 comes within ``slack`` of the highest, were ``share`` of all rows of that label; 0 without both labels."""
    if not 0 < y.sum() < len(y):
        return 0.0
    order = np.argsort(-logit, kind="stable")
    z, hits = logit[order], np.cumsum(y[order]) * (share / y.mean())
    other = np.cumsum(1 - y[order]) * ((1 - share) / (1 - y.mean()))
    f1 = 2 * hits / (hits + other + hits[-1])
    f1[:-1][z[:-1] == z[1:]] = -1
    k = int(np.flatnonzero(f1 >= f1.max() - slack)[-1])
    return float((z[k] + z[k + 1]) / 2) if k + 1 < len(z) else float(z[k] - 1)


def label_share(labels: DataFrame, label: str, residue: tuple[int, int] | None = None) -> float:
    """How much of the labelled rows has label 1, within 1 and 99 %; residue leaves out the rows that labelled_sample leaves out."""
    if residue:
        labels = labels.where(~held_out(*residue))
    mean = labels.agg(F.avg(F.col(label).cast("double"))).first()[0]
    return min(max(0.5 if mean is None else mean, 0.01), 0.99)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
