"""Ranked lexical search over a bit-sliced impact index.

Documents are indexed in blocks of some thousand.  In a block every term has the impact it gives each document, cut into
bits: slice b of a term is a bitmap of the documents whose impact has bit b.  A query multiplies the slices by the
term's weight and adds those of its terms with bitwise carry arithmetic, 64 documents a machine word and many queries at once; the best
k are found by descending from the most significant slice of the sums.  A task holds one block of the index at
most, and a block hands on k documents a query.

Impacts are free of weights, so that the index is written in one pass without a shuffle; how rare a term is, is
summed over the blocks when it is asked for.
"""

from __future__ import annotations

import math
import string
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, encoded, table, written

#: Documents of a block (a place is 16 bits), and bytes of text after which a block ends.
BLOCK, BLOCK_BYTES = 4096, 16 << 20
#: A term in at least one document of DENSE is stored as bitmaps; in fewer, the places and impacts are a list until they are loaded.
DENSE = 32
IMPACT_BITS = 20
#: Terms of queries that are answered in one pass over the index, and queries whose sums are held together in a task.
BATCH, TOGETHER = 20_000, 32

#: Terms are runs of these characters, A-Z lowered.
TERM = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
_KEPT = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()

INDEX = "block long, term string, df long, doc_ids array<long>, places binary, impacts binary, slices binary"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_KEPT).split()


def words_of(bits: np.ndarray) -> np.ndarray:
    """Bits (last axis: documents) as 64-bit words."""
    bits = np.concatenate([bits, np.zeros((*bits.shape[:-1], -bits.shape[-1] % 64), np.uint8)], axis=-1)
    return np.packbits(bits, axis=-1, bitorder="little").view("<u8")


def _block(number: int, ids: list[int | None], texts: list[bytes], documents: int, words: int) -> Iterator[pa.RecordBatch]:
    """The index rows of one block: a head with its documents by doc_id, then the terms."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    known: dict[bytes, int] = {}
    own = [terms_of(texts[i]) for i in order]
    length = np.array([len(t) for t in own], np.int64)
    flat = np.fromiter((known.setdefault(w, len(known)) for t in own for w in t), np.int64, int(length.sum()))
    key, tf = np.unique(flat * len(own) + np.repeat(np.arange(len(own)), length), return_counts=True)
    term, place = np.divmod(key, len(own))
    m = 100 - 25 + 25 * length * documents // max(words, 1)
    impact = 1_000_000_000 * tf // (1000 * tf + 12 * m[place])
    at = np.append(np.flatnonzero(np.diff(term, prepend=-1)), len(term))
    df, names = np.diff(at), list(known)
    schema = pa.schema([("block", pa.int64()), ("term", pa.string()), ("df", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("places", pa.binary()), ("impacts", pa.binary()), ("slices", pa.binary())])

    def rows(name: list[bytes | None], count: np.ndarray, **columns) -> pa.RecordBatch:
        full = {"block": pa.array([number] * len(name), pa.int64()), "term": pa.array(name, pa.binary()).cast(pa.string()), "df": pa.array(count, pa.int64())} | columns
        return pa.RecordBatch.from_arrays([full.get(f.name, pa.nulls(len(name), f.type)) for f in schema], schema=schema)

    def cut(values: np.ndarray, counts: np.ndarray) -> pa.Array:
        """A binary value for each of the counts, one after the other."""
        ends = np.concatenate([[0], np.cumsum(counts)]) * values.itemsize
        return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values)])

    yield rows([None], [int((length > 0).sum())], doc_ids=pa.array([[ids[i] for i in order]], pa.list_(pa.int64())))
    dense = df * DENSE >= len(own)
    sparse = np.repeat(~dense, df)
    few = np.flatnonzero(~dense)
    if len(few):
        yield rows([names[t] for t in few], df[few], places=cut(place[sparse].astype("<u2"), df[few]), impacts=cut(impact[sparse].astype("<u4"), df[few]))
    often = np.flatnonzero(dense)
    for start in range(0, len(often), 64):
        some = often[start : start + 64]
        values = np.zeros((len(some), len(own)), np.uint32)
        for row, t in enumerate(some):
            values[row, place[at[t] : at[t + 1]]] = impact[at[t] : at[t + 1]]
        slices = words_of(np.stack([(values >> b & 1).astype(np.uint8) for b in range(IMPACT_BITS)], axis=1))
        yield rows([names[t] for t in some], df[some], slices=cut(slices.reshape(-1), np.full(len(some), slices[0].size)))


@dataclass
class Index:
    """rows: the table of blocks and terms; documents: how many have at least one term."""

    rows: DataFrame
    documents: int


def build(docs: DataFrame) -> Index:
    """Indexes every row of ``docs`` (doc_id, text): two passes over the texts, the first of which only counts; no shuffle.

    Null and empty texts have no terms; rows without a doc_id, or that repeat one, are documents of their own; other columns are ignored.
    """
    n = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(TERM)).cast("long")
    total = docs.select(n.alias("n")).agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    documents, words = total.documents, total.words

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for part in blocks(batch):
                for doc_id, text in zip(part["doc_id"].to_pylist(), encoded(part), strict=True):
                    if len(ids) == BLOCK or ids and size + len(text) > BLOCK_BYTES:
                        yield from _block(number, ids, texts, documents, words)
                        number, ids, texts, size = number + 1, [], [], 0
                    ids.append(doc_id)
                    texts.append(text)
                    size += len(text)
        if ids:
            yield from _block(number, ids, texts, documents, words)

    return Index(written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(index, INDEX), "index"), documents)


def load(rows: DataFrame) -> Index:
    """An index from its table."""
    return Index(rows, rows.where("term IS NULL").agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0])


# ---- carry arithmetic


def add(sums: np.ndarray, slices: np.ndarray) -> None:
    """Adds numbers to numbers, both in slices (first axis: bits, the lowest first), in place; the sums have slices enough for the carries."""
    carry = np.zeros_like(sums[0])
    for b in range(len(sums)):
        old = sums[b]
        if b < len(slices):
            half = old ^ slices[b]
            sums[b], carry = half ^ carry, (old & slices[b]) | (half & carry)
        elif carry.any():
            sums[b], carry = old ^ carry, old & carry
        else:
            break


def times(slices: np.ndarray, weights: np.ndarray, bits: int) -> np.ndarray:
    """Numbers in slices (bit, term, word) times a weight for each term: shifted and added once for each bit of the weights."""
    out = np.zeros((bits, *slices.shape[1:]), np.uint64)
    for shift in range(int(weights.max(initial=0)).bit_length()):
        own = np.flatnonzero(weights >> shift & 1)
        if len(own):
            part = out[shift:, own]
            add(part, slices[:, own])
            out[shift:, own] = part
    return out


def laid_out(values: np.ndarray, row: np.ndarray, place: np.ndarray, shape: tuple[int, int, int]) -> np.ndarray:
    """Slices (bit, row, word) of numbers that stand at (row, place)."""
    out = np.zeros(shape, np.uint64)
    word, bit = row * shape[2] + (place >> 6), np.uint64(1) << (place & 63).astype(np.uint64)
    for b in range(shape[0]):
        has = (values >> b & 1).astype(bool)
        np.bitwise_or.at(out[b].reshape(-1), word[has], bit[has])
    return out


def highest(sums: np.ndarray, documents: int, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each query the places of its k highest sums above 0 (of equal ones the lowest places) and these sums.  sums: (bit, query, word).

    From the top slice down: documents that surely are among the best, and those still tied.  If the
    slice's bit leaves more than k, only the tied ones with the bit stay tied; else they are in, and the others stay tied.
    """
    sure = np.zeros_like(sums[0])
    tied = np.broadcast_to(words_of(np.ones(documents, np.uint8)), sure.shape)
    for slice_ in sums[::-1]:
        with_bit = sure | (tied & slice_)
        more = (np.bitwise_count(with_bit).sum(axis=1) > k)[:, None]
        sure, tied = np.where(more, sure, with_bit), np.where(more, tied & slice_, tied & ~slice_)
    out = []
    for q in range(len(sure)):
        found = [np.flatnonzero(np.unpackbits(x[q].view(np.uint8), bitorder="little")) for x in (sure, tied)]
        place = np.concatenate([found[0], found[1][: max(k - len(found[0]), 0)]])
        bits = sums[:, q, place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)
        score = (bits << np.arange(len(sums), dtype=np.uint64)[:, None]).sum(axis=0).astype(np.int64)
        out.append((place[score > 0], score[score > 0]))
    return out


class Block:
    """The rows of one block that hold the terms of a batch of queries."""

    def __init__(self, rows: pa.Table, weights: dict[str, int], bits: int):
        names, head = rows["term"].to_pylist(), None
        self.bits, self.lists, self.weights = bits, {}, weights
        bitmaps, columns = [], [rows[c].combine_chunks() for c in ("places", "impacts", "slices")]
        for i, name in enumerate(names):
            if name is None:
                head = i
            elif columns[2][i].is_valid:
                bitmaps.append(i)
            else:
                self.lists[name] = (np.frombuffer(columns[0][i].as_buffer(), "<u2").astype(np.int64), np.frombuffer(columns[1][i].as_buffer(), "<u4").astype(np.int64))
        self.ids = rows["doc_ids"][head].values.to_pylist()
        self.words = -(-len(self.ids) // 64)
        self.dense = {names[i]: j for j, i in enumerate(bitmaps)}
        shape = (len(bitmaps), IMPACT_BITS, self.words)
        slices = np.frombuffer(b"".join(columns[2][i].as_buffer().to_pybytes() for i in bitmaps), "<u8").reshape(shape).swapaxes(0, 1)
        self.impacts = times(slices, np.array([weights[t] for t in self.dense], np.int64), bits)

    def slices(self, names: list[str]) -> np.ndarray:
        """(bit, term, word) of weighted impacts, and zeros after the last term."""
        lists = [(i, *self.lists[t]) for i, t in enumerate(names) if t in self.lists]
        count = [len(place) for _, place, _ in lists]
        row = np.repeat(np.array([i for i, _, _ in lists], np.int64), count)
        weight = np.repeat(np.array([self.weights[names[i]] for i, _, _ in lists], np.int64), count)
        place, value = (np.concatenate([x[c] for x in lists] or [np.zeros(0, np.int64)]) for c in (1, 2))
        out = laid_out(value * weight, row, place, (self.bits, len(names) + 1, self.words))
        own = [i for i, t in enumerate(names) if t in self.dense]
        out[:, own] = self.impacts[:, [self.dense[names[i]] for i in own]]
        return out

    def best(self, queries: list[dict[str, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Places and scores of each query (term: how often it stands there)."""
        here = [{t: r for t, r in q.items() if t in self.lists or t in self.dense} for q in queries]
        names = sorted({t for q in here for t in q})
        number = {t: i for i, t in enumerate(names)}
        terms = self.slices(names)
        most = max((sum(self.weights[t] * r for t, r in q.items()) for q in here), default=0)
        sums = np.zeros(((most * 10**6).bit_length() + 1, len(queries), self.words), np.uint64)
        top = max((r for q in here for r in q.values()), default=0)
        for shift in range(top.bit_length()):  # a term that stands r times is added once for each bit of r
            own = [[number[t] for t, r in q.items() if r >> shift & 1] for q in here]
            for step in range(max(map(len, own))):
                rows = [x[step] if step < len(x) else len(names) for x in own]
                add(sums[shift:], terms[: len(sums) - shift, rows])
        return highest(sums, len(self.ids), k)


# ---- search


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, repeats): rows of one item_id are one query with the terms of them all."""
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    return items.select("item_id", F.explode(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("repeats"))


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _answered(index: Index, rows: list, k: int) -> DataFrame:
    """item_id, doc_id, score: the best k of each block for each query of a batch."""
    spark = index.rows.sparkSession
    asked = F.broadcast(spark.createDataFrame([(t,) for t in sorted({r.term for r in rows})], "term string").withColumn("asked", F.lit(True)))  # BATCH terms or the terms of one query
    own = index.rows.join(asked, "term", "left").where("asked OR term IS NULL").drop("asked")
    df = own.where("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df")).collect()  # a row a term asked for
    weights = {r.term: weight(index.documents, r.df) for r in df}
    queries: dict[int | None, dict[str, int]] = defaultdict(dict)
    for r in rows:
        if weights.get(r.term):
            queries[r.item_id][r.term] = r.repeats
    items = sorted(queries, key=lambda i: (i is None, i or 0))
    bits = (max(weights.values(), default=0) * 10**6).bit_length() + 1

    def search(rows: pa.Table) -> pa.Table:
        block, out = Block(rows, weights, bits), [[], [], []]
        for start in range(0, len(items), TOGETHER):
            some = items[start : start + TOGETHER]
            for item, (place, score) in zip(some, block.best([queries[i] for i in some], k), strict=True):
                out[0] += [item] * len(place)
                out[1] += [block.ids[p] for p in place]
                out[2] += score.tolist()
        return pa.table({"item_id": pa.array(out[0], pa.int64()), "doc_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.int64())})

    return own.groupBy("block").applyInArrow(search, "item_id long, doc_id long, score long")


def search(index: Index, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k documents with the highest scores above 0 for each item (item_id, text), equal scores by doc_id, nulls last.

    Exact: every block is asked for its own best k.  Items go in batches of some BATCH terms, each one pass over the
    index.  An item without terms (null, empty) or whose terms no document has gives no rows; so does an empty table on either side.
    """
    terms = written(item_terms(items), "items")
    batches = -(-terms.count() // BATCH)
    batch: Column = F.pmod(F.xxhash64("item_id"), F.lit(max(batches, 1)))
    found = index.rows.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    for i in range(batches):
        found = found.union(_answered(index, terms.where(batch == i).collect(), k))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op13_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
