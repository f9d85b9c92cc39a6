"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

What has to be packed is a histogram: how many pieces there are of each length, at most 2048
numbers whatever the corpus.  The reduction fixes sets of one, two or three pieces that provably
dominate every other set with their largest piece, as many times as the histogram allows; best-fit
decreasing packs what is left.  The result is a plan of a few thousand ranges (length, ranks ->
sequences, offset).  Pieces are ranked within their length without any global sort: a running
number within the task that made them, plus the counts of the tasks before it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, table, written

CAPACITY = 2048
VOCABULARY = "byte_bpe_50k"
END_ID = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
Group = tuple[int, list[tuple[int, int]]]


class Encoder:
    """Ids of the byte-level vocabulary.

    Ordinary text goes through the vocabulary's rank form, which gives the same ids as the
    tokenizer file several times faster; texts that spell out a special token go through the file.
    """

    def __init__(self, vocabulary: str):
        import base64

        import tiktoken
        from public_tokenizers import PATTERN, path

        self.file = path(f"{vocabulary}.json")
        with open(path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.slow = None

    def __call__(self, text: str) -> np.ndarray:
        if "<|endoftext|>" in text:
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.file)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=())


def cut_points(n: int, capacity: int) -> list[int]:
    """Starts of a document's pieces, and its end: only the first piece may be shorter than the capacity."""
    return [0, *range(n % capacity or capacity, n, capacity), n]


def _pieces(vocabulary: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = Encoder(vocabulary), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for block in blocks(batch):
                ids, numbers, starts, lengths, sums = [], [], [], [], []
                for doc, text in zip(block["doc_id"].to_pylist(), block["text"].to_pylist(), strict=True):
                    tokens = np.append(encode(text or ""), np.uint32(END_ID)).astype("<u4")
                    points = cut_points(len(tokens), capacity)
                    for i, (a, b) in enumerate(zip(points, points[1:], strict=False)):
                        ids.append(doc)
                        numbers.append(i)
                        starts.append(a)
                        lengths.append(b - a)
                        sums.append(zlib.crc32(tokens[a:b].tobytes()))
                size = np.array(lengths)
                order = np.argsort(size, kind="stable")
                first = np.searchsorted(size[order], size[order], side="left")
                nth = np.empty(len(size), np.int64)
                nth[order] = np.arange(len(size)) - first + seen[size[order]]
                seen += np.bincount(size, minlength=capacity + 1)
                kinds = ((ids, pa.int64()), (numbers, pa.int32()), (starts, pa.int64()), (lengths, pa.int64()), (sums, pa.int64()), ([part] * len(ids), pa.int32()), (nth, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in kinds], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return run


def reduce_by_dominance(count: np.ndarray, capacity: int) -> list[Group]:
    """Fixes dominating sets and takes their pieces out of ``count`` (index: length).  Gives (times, [(length, how many)]).

    For the piece j and the room r that it leaves, with k the largest other piece that fits in r:
    {j} if nothing fits; {j, k} if k fills r, or if no two pieces fit in r; {j, k, b}, b the largest
    piece that fits beside k, if no three pieces fit in r and of any two that do the smaller is at most b.
    Each of these dominates all other sets with j: what any of them has beside j fits into the pieces named.
    """
    fixed: list[Group] = []

    def smallest(n: int, free: np.ndarray) -> int:
        """Sum of the n smallest pieces, or more than any room."""
        total = 0
        for size in np.flatnonzero(free):
            take = min(n, int(free[size]))
            total, n = total + take * int(size), n - take
            if not n:
                return total
        return capacity + 1

    def largest(most: int, free: np.ndarray) -> int:
        fits = np.flatnonzero(free[: most + 1])
        return int(fits[-1]) if len(fits) else 0

    def fix(pieces: list[int]) -> None:
        need = {p: pieces.count(p) for p in pieces}
        times = min(int(count[p]) // n for p, n in need.items())
        for p, n in need.items():
            count[p] -= times * n
        fixed.append((times, sorted(need.items(), reverse=True)))

    changed = True
    while changed:
        changed = False
        for j in range(capacity, 0, -1):
            while count[j]:
                free, room = count.copy(), capacity - j
                free[j] -= 1
                k = largest(room, free)
                if not k:
                    fix([j])
                elif k == room or smallest(2, free) > room:
                    fix([j, k])
                else:
                    free[k] -= 1
                    b = largest(room - k, free)
                    free[k] += 1
                    if not b or smallest(3, free) <= room:
                        break
                    y = largest(room // 2, free)
                    while y > b and (free[y] < 2 or 2 * y > room) and not free[y + 1 : room - y + 1].any():
                        y = largest(y - 1, free)
                    if y > b:
                        break
                    fix([j, k, b])
                changed = True
    return fixed


def best_fit(count: np.ndarray, capacity: int) -> list[Group]:
    """Best-fit decreasing over a histogram: equal pieces go at once into equally full sequences."""
    open_: dict[int, list[Group]] = {}
    for size in range(capacity, 0, -1):
        left = int(count[size])
        while left:
            room = next((r for r in range(size, capacity) if open_.get(r)), capacity)
            times, held = open_[room].pop() if room < capacity else (left, [])
            each = min(room // size, left)
            full = min(times, left // each)
            if full < times and room < capacity:
                open_[room].append((times - full, held))
            open_.setdefault(room - each * size, []).append((full, [*held, (size, each)]))
            left -= full * each
    return [g for groups in open_.values() for g in groups]


def plan(count: np.ndarray, capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Ranges of ranks, sorted by length and first rank, and where their pieces go."""
    left = count.astype(np.int64).copy()
    groups = reduce_by_dominance(left, capacity)
    groups += best_fit(left, capacity)
    used, rows, base = np.zeros(capacity + 1, np.int64), [], 0
    for times, pieces in groups:
        offset = 0
        for size, each in pieces:
            rows.append((size, used[size], base, each, offset))
            used[size] += times * each
            offset += size * each
        base += times
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "lo", "base", "each", "offset"), columns, strict=True)) | {"sequences": np.int64(base)}


def locate(where: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence_id, offset) of pieces by length and rank."""
    row = np.searchsorted((where["length"] << 44) | where["lo"], (length << 44) | rank, side="right") - 1
    index, each = rank - where["lo"][row], where["each"][row]
    return where["base"][row] + index // each, where["offset"][row] + index % each * length


def _place(where: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = locate(where, batch["length"].to_numpy(), batch["rank"].to_numpy())
            kept = [batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and the end id; null and empty texts are the end id alone.  Rows that
    repeat a doc_id are documents of their own.  Only documents longer than the capacity are cut.
    An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    pieces = written(docs.select("doc_id", "text").mapInArrow(_pieces(vocabulary, capacity), PIECES), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a number for each length
        histogram[r.length] = r.n
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    ranked = pieces.join(before, ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return ranked.select(*columns, "rank").mapInArrow(_place(plan(histogram, capacity)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
