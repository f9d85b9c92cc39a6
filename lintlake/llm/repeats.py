"""Removal of byte strings that an earlier document holds, by threshold-bounded interval expansion.

Every window of 50 bytes belongs to the smallest hash among its 20-byte substrings.  Neighbouring
windows with the same smallest hash make a segment of at most 80 bytes, and equal windows, wherever
they are, lie in segments with equal hashes.  So:

1. Chunks of documents send the hashes of their segments to buckets, sorted and packed; a bucket
   tells the chunks which hashes occur in more than one document.
2. Chunks send those segments' distinct strings, each once, to buckets by hash.  A hash with very many
   occurrences is split: its windows go one by one, by their own hashes.
3. A bucket pools equal strings, with their smallest document, and expands a Burrows-Wheeler transform of all
   its distinct strings backward, level by level up to 50; what is left has a common prefix of 50
   bytes.  Each such group's smallest document decides which windows go.
4. Chunks cover the bytes of those windows.

Hashes only deal the work out and pool whole strings: which windows are the same is found by the expansion.
Documents are dealt to chunks once; the three passes over the text read the same exchange.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_bytes
from .suffix import shared_windows

LENGTH, GRAM = 50, 20
#: Bytes of text in a chunk and for a bucket, whatever the size of the table; and of strings that are expanded together.
CHUNK, BUCKET, TOGETHER = 8 << 20, 16 << 20, 1 << 18
SPAN = LENGTH - GRAM + 1
WIDEST = LENGTH + SPAN - 1
#: Occurrences beyond which a hash is split into its windows: some thirty times the strings, so only where a hash would be a tenth of a bucket.
HOT = 20_000
#: Of the strings on their way to buckets: a cell's strings have no order that the shuffle's own compression could use.
CODEC = "zstd"
#: Bytes whose hashes stay in a core's cache together.
STEP = 1 << 15
U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(29))


#: A number for each byte, so that hashes of substrings are sums of products.
LETTERS = _mix(_mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15)))


def window_minima(data: np.ndarray) -> np.ndarray:
    """The smallest hash of a GRAM-byte substring of each LENGTH-byte window."""
    h, size, by = LETTERS[data], 1, 0x9E3779B97F4A7C15
    while size < GRAM:
        ahead = min(size, GRAM - size)
        longer = h[:-ahead] * U(by)
        longer += h[ahead:]
        h, size, by = longer, size + ahead, by * by % (1 << 64)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(29)
    size = 1
    while size < SPAN:
        ahead = min(size, SPAN - size)
        h, size = np.minimum(h[:-ahead], h[ahead:]), size + ahead
    return h


class Segments:
    """The segments of a chunk: where they start in the joined texts, how many windows they have, of which document, and their hash."""

    def __init__(self, texts: list[bytes], ids: list[int | None]):
        self.size = np.array([len(t) for t in texts], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.ids = np.array([0 if i is None else i for i in ids], np.int64)
        known = np.array([i is not None for i in ids], bool)
        start, windows, doc, key = [], [], [], []
        at = 0
        while at < len(texts):
            stop = max(int(np.searchsorted(self.begin, self.begin[at] + (1 << 18))), at + 1)
            lo, hi = int(self.begin[at]), int(self.begin[stop - 1] + self.size[stop - 1])
            if hi - lo >= LENGTH:
                a = np.concatenate([window_minima(self.data[x : min(x + STEP + LENGTH - 1, hi)]) for x in range(lo, hi - LENGTH + 1, STEP)])
                count = np.maximum(self.size[at:stop] - LENGTH + 1, 0) * known[at:stop]
                own = np.flatnonzero(count) + at
                first = self.begin[own] - lo
                last = first + count[own - at]
                new = np.ones(len(a) + 1, bool)
                np.not_equal(a[1:], a[:-1], out=new[1:-1])
                new[first] = new[last] = True
                edges = np.flatnonzero(new)
                low = np.searchsorted(edges, first)
                each = np.searchsorted(edges, last) - low
                within = np.arange(int(each.sum())) + np.repeat(low - np.cumsum(each) + each, each)
                edges, n, of = edges[within], np.diff(edges)[within], np.repeat(own, each)
                if n.max(initial=0) > SPAN:
                    pieces = -(-n // SPAN)
                    part = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                    edges, n, of = np.repeat(edges, pieces) + part * SPAN, np.minimum(np.repeat(n, pieces) - part * SPAN, SPAN), np.repeat(of, pieces)
                start.append(edges + lo)
                windows.append(n)
                key.append(a[edges])
                doc.append(of)
            at = stop
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.start, self.windows, self.doc, self.key = join(start, np.int64), join(windows, np.int64), join(doc, np.int64), join(key, U)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct hashes, sorted; of each the occurrences (up to 32767) times 2, plus 1 if several documents have it."""
        order = np.argsort(self.key)
        key, doc = self.key[order], self.doc[order]
        first = np.flatnonzero(np.diff(key, prepend=~key[:1]) != 0) if len(key) else np.zeros(0, np.int64)
        if not len(first):
            return key, np.zeros(0, np.uint16)
        count = np.diff(np.append(first, len(key)))
        several = np.minimum.reduceat(self.ids[doc], first) != np.maximum.reduceat(self.ids[doc], first)
        return key[first], (np.minimum(count, 32767) * 2 + several).astype(np.uint16)

    def chosen(self, keys: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, ...]:
        """Occurrences of the given hashes (sorted): start, windows, document, hash, hot.  Those of hot hashes are single windows."""
        low = U((1 << 20) - 1)
        near = np.zeros(1 << 20, bool)
        near[keys & low] = True
        some = np.flatnonzero(near[self.key & low])
        at = np.searchsorted(keys, self.key[some]).clip(max=max(len(keys) - 1, 0))
        is_in = keys[at] == self.key[some]
        some, burning = some[is_in], hot[at[is_in]]
        start, windows, doc, key = self.start[some], self.windows[some], self.doc[some], self.key[some]
        each = np.where(burning, windows, 1)
        part = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        return np.repeat(start, each) + part, np.where(np.repeat(burning, each), 1, np.repeat(windows, each)), np.repeat(doc, each), np.repeat(key, each), np.repeat(burning, each)


def string_hash(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64 bits of each string of at most 80 bytes."""
    out = np.empty(len(start), U)
    words = np.frombuffer(data.tobytes() + bytes(96 - len(data) % 8), U)
    tail = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
    for lo in range(0, len(start), 1 << 14):
        s, n = start[lo : lo + (1 << 14)], length[lo : lo + (1 << 14)]
        at, shift = s >> 3, ((s & 7) << 3).astype(U)
        h, word = n.astype(U), words[at]
        for i in range(10):
            following = words[at + (i + 1)]
            here = word >> shift | following << (U(64) - shift)  # a shift by 64 leaves nothing
            h = _mix(h * U(0x9E3779B97F4A7C15) + (here & tail[np.clip(n - 8 * i, 0, 8)]))
            word = following
        out[lo : lo + (1 << 14)] = h
    return out


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values, a place of each, which of them each is)."""
    order = np.argsort(hashes)
    values = hashes[order]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    of = np.empty(len(values), np.int64)
    of[order] = np.cumsum(new) - 1
    return values[new], order[new], of


class Strings:
    """The distinct strings of a chunk's chosen occurrences, sorted by hash of the string, with their smallest document."""

    def __init__(self, segments: Segments, keys: np.ndarray, hot: np.ndarray):
        self.start, self.windows, self.doc, key, burning = segments.chosen(keys, hot)
        hashes = string_hash(segments.data, self.start, self.windows + LENGTH - 1)
        self.hash, index, self.of = _distinct(hashes)
        ids = segments.ids[self.doc]
        self.first = np.full(len(self.hash), np.iinfo(np.int64).max)
        np.minimum.at(self.first, self.of, ids)
        self.several = np.zeros(len(self.hash), bool)
        self.several[self.of[ids != self.first[self.of]]] = True
        self.at, self.n, self.key, self.hot = self.start[index], self.windows[index], key[index], burning[index]


def _texts(rows: pa.Table) -> Segments:
    return Segments([x or b"" for x in rows["text"].cast(pa.binary()).to_pylist()], rows["doc_id"].to_pylist())


def _cells(bucket: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return [(b, order[ends[b] : ends[b + 1]]) for b in range(buckets) if ends[b] < ends[b + 1]]


def _pick(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> bytes:
    base = np.cumsum(length) - length
    return data[np.arange(int(length.sum())) + np.repeat(start - base, length)].tobytes()


def _send_hashes(buckets: int):
    def run(rows: pa.Table) -> pa.Table:
        key, count = _texts(rows).keys()
        cells = _cells((key >> U(40)).astype(np.int64) % buckets, buckets)
        chunk = rows["chunk"][0].as_py()
        columns = [pa.array([b for b, _ in cells], pa.int32()), pa.array([chunk] * len(cells), pa.int64()), pa.array([key[i].tobytes() for _, i in cells], pa.binary()), pa.array([count[i].tobytes() for _, i in cells], pa.binary())]
        return pa.Table.from_arrays(columns, ["bucket", "chunk", "hashes", "counts"])

    return run


def _answer_hashes(rows: pa.Table) -> pa.Table:
    """To each chunk its hashes that several documents have, and whether they are hot."""
    parts = [np.frombuffer(x, U) for x in rows["hashes"].to_pylist()]
    key, count = np.concatenate(parts), np.concatenate([np.frombuffer(x, np.uint16) for x in rows["counts"].to_pylist()])
    source = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    order = np.argsort(key)
    sorted_key = key[order]
    first = np.flatnonzero(np.diff(sorted_key, prepend=~sorted_key[:1]) != 0)
    size = np.diff(np.append(first, len(key)))
    total = np.add.reduceat((count >> 1).astype(np.int64)[order], first)
    several = (size > 1) | (np.maximum.reduceat(count[order] & 1, first) > 0)
    wanted, burning = np.empty(len(key), bool), np.empty(len(key), bool)
    wanted[order], burning[order] = np.repeat(several, size), np.repeat(total > HOT, size)
    out = []
    for i, chunk in enumerate(rows["chunk"].to_pylist()):
        mine = (source == i) if len(parts) < 8 else slice(*np.searchsorted(source, [i, i + 1]))
        k, w, b = key[mine], wanted[mine], burning[mine]
        if w.any():
            out.append((chunk, k[w].tobytes(), b[w].astype(np.uint8).tobytes()))
    return pa.Table.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.binary(), pa.binary()))], ["chunk", "hashes", "hot"])


def _received(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([np.zeros(0, U), *(np.frombuffer(x, U) for x in rows["hashes"].to_pylist())])
    hot = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(x, np.uint8) for x in rows["hot"].to_pylist())]) > 0
    order = np.argsort(keys)
    return keys[order], hot[order]


def _send_strings(buckets: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["bucket", "chunk", "hashes", "meta", "firsts", "data"]
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        out: list[tuple] = []
        if docs.num_rows and answers.num_rows:
            segments = _texts(docs)
            s = Strings(segments, *_received(answers))
            where = np.where(s.hot, s.hash, s.key)
            chunk = docs["chunk"][0].as_py()
            meta = (s.n | s.several.astype(np.int64) << 5 | s.hot.astype(np.int64) << 6).astype(np.uint8)
            for b, i in _cells((where >> U(32)).astype(np.int64) % buckets, buckets):
                out.append((b, chunk, s.key[i].tobytes(), meta[i].tobytes(), pa.compress(s.first[i].tobytes(), CODEC, asbytes=True), pa.compress(_pick(segments.data, s.at[i], s.n[i] + LENGTH - 1), CODEC, asbytes=True)))
        return pa.Table.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)

    return run


def _answer_strings(rows: pa.Table) -> pa.Table:
    """To each chunk its strings with windows that a smaller document has, or that several of its own documents have; a bit a window."""
    key, meta = (np.concatenate([np.frombuffer(x, kind) for x in rows[c].to_pylist()]) for c, kind in (("hashes", U), ("meta", np.uint8)))
    sizes = [len(x) for x in rows["meta"].to_pylist()]
    first = np.frombuffer(b"".join(pa.decompress(x, 8 * n, CODEC, asbytes=True) for x, n in zip(rows["firsts"].to_pylist(), sizes, strict=True)), np.int64)
    n, several, hot = (meta & 31).astype(np.int64), (meta & 32) > 0, (meta & 64) > 0
    length = n + LENGTH - 1
    start = np.cumsum(length) - length
    raw = np.add.reduceat(length, np.cumsum(sizes) - sizes).tolist()
    data = np.frombuffer(b"".join(pa.decompress(x, r, CODEC, asbytes=True) for x, r in zip(rows["data"].to_pylist(), raw, strict=True)), np.uint8)
    hashes = string_hash(data, start, length)
    distinct, index, of = _distinct(hashes)
    least = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(least, of, first)
    known = np.full((len(distinct), SPAN), np.iinfo(np.int64).max)
    own = np.where(hot, hashes, key)[index]
    order = np.argsort(own, kind="stable")  # strings with windows in common have this in common
    order = order[(~hot | several)[index[order]] | (np.bincount(of)[order] > 1)]  # a single window of one document has nothing to be compared with
    upto = np.cumsum(length[index[order]])
    ends = np.flatnonzero(np.append(own[order][1:] != own[order][:-1], True)[: len(order)]) + 1
    batch = (upto[ends - 1] - 1) // TOGETHER
    stops = ends[np.flatnonzero(np.append(batch[1:] != batch[:-1], True)[: len(ends)])]
    for lo, hi in zip(np.append(0, stops)[:-1], stops, strict=True):
        some = order[lo:hi]
        string, offset, same = shared_windows(data, start[index[some]], length[index[some]], LENGTH)
        string = some[string]
        begin = np.flatnonzero(np.diff(same, prepend=same[:1] - 1))
        known[string, offset] = np.repeat(np.minimum.reduceat(least[string], begin), np.diff(np.append(begin, len(same))))
    bits = np.empty((len(n), 4), np.uint8)
    for lo in range(0, len(n), 1 << 14):
        part = slice(lo, lo + (1 << 14))
        goes = (known[of[part]] < first[part, None]) & (np.arange(SPAN) < n[part, None])
        bits[part] = np.packbits(goes, axis=1)
    told = bits.any(axis=1) | several
    out, at = [], 0
    for chunk, size in zip(rows["chunk"].to_pylist(), sizes, strict=True):
        mine = np.flatnonzero(told[at : at + size]) + at
        at += size
        if len(mine):
            out.append((chunk, key[mine].tobytes(), hot[mine].astype(np.uint8).tobytes(), hashes[mine].tobytes(), bits[mine].tobytes()))
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return pa.Table.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["chunk", "hashes", "hot", "strings", "bits"])


def covered(segments: Segments, answers: pa.Table) -> np.ndarray:
    """Whether each byte of the chunk goes."""
    flag = np.zeros(len(segments.data) + LENGTH, np.int8)
    if answers.num_rows:
        keys, hot = _received(answers)
        keys, index = np.unique(keys, return_index=True)
        s = Strings(segments, keys, hot[index])
        told = np.concatenate([np.frombuffer(x, U) for x in answers["strings"].to_pylist()])
        bits = np.concatenate([np.frombuffer(x, np.uint8).reshape(-1, 4) for x in answers["bits"].to_pylist()])
        order = np.argsort(told)
        at = order[np.searchsorted(told, s.hash, sorter=order).clip(max=len(told) - 1)]
        hit = told[at] == s.hash
        goes = np.unpackbits(bits[at], axis=1)[:, :SPAN].astype(bool) & hit[:, None]
        later = segments.ids[s.doc] > s.first[s.of]
        each = (goes[s.of] | later[:, None]) & (np.arange(SPAN) < s.windows[:, None])
        row, offset = np.nonzero(each)
        flag[s.start[row] + offset + LENGTH] = 1
    upto = np.cumsum(flag, dtype=np.int32)
    return upto[LENGTH:] - upto[: len(segments.data)] > 0


def _digests(docs: pa.Table, answers: pa.Table) -> pa.Table:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    if not docs.num_rows:
        return pa.Table.from_arrays([pa.array([], kind) for kind in kinds], names)
    segments = _texts(docs)
    begin, end = segments.begin, segments.begin + segments.size
    gone = covered(segments, answers)
    opens = gone.copy()
    opens[1:] &= ~gone[:-1]
    inner = begin[(segments.size > 0) & (begin > 0)]
    opens[inner] = gone[inner]
    upto = np.zeros(len(gone) + 1, np.int32)
    np.cumsum(gone, dtype=np.int32, out=upto[1:])
    spans = np.diff(np.searchsorted(np.flatnonzero(opens), np.stack([begin, end])), axis=0)[0]
    left = memoryview(segments.data[~gone])
    digests = [hashlib.sha256(left[a:b]).hexdigest() for a, b in zip((begin - upto[begin]).tolist(), (end - upto[end]).tolist(), strict=True)]
    values = (docs["doc_id"].to_pylist(), segments.size, upto[end] - upto[begin], spans, digests)
    return pa.Table.from_arrays([pa.array(v, kind) for v, kind in zip(values, kinds, strict=True)], names)


def _kept(docs: pa.Table, answers: pa.Table):
    if docs.num_rows:
        segments = _texts(docs)
        gone = covered(segments, answers)
        for doc, at, size in zip(docs["doc_id"].to_pylist(), segments.begin.tolist(), segments.size.tolist(), strict=True):
            yield doc, segments.data[at : at + size], ~gone[at : at + size]


def _plan(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents dealt to chunks, and the buckets' answers by chunk."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(text_bytes())).first()[0] or 0
    chunks, buckets = (max(total // most + 1, 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))) for most in (CHUNK, BUCKET))
    dealt = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("long"))
    hashes = dealt.groupBy("chunk").applyInArrow(_send_hashes(buckets), "bucket int, chunk long, hashes binary, counts binary")
    answers = hashes.groupBy("bucket").applyInArrow(_answer_hashes, "chunk long, hashes binary, hot binary")
    strings = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_send_strings(buckets), "bucket int, chunk long, hashes binary, meta binary, firsts binary, data binary")
    return dealt, strings.groupBy("bucket").applyInArrow(_answer_strings, "chunk long, hashes binary, hot binary, strings binary, bits binary")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a 50-byte string that covers it also starts in a document with a smaller doc_id.  A null
    text is empty.  A document with a null doc_id neither loses bytes nor takes others'.  Rows that repeat a
    doc_id are no smaller than each other, so they keep what only they share; they are dealt by their texts,
    so that many of them do not gather in one chunk unless they are equal as a whole.  Equal strings of up to 80
    bytes are pooled by 64-bit hashes.  Empty tables give no rows; other columns are ignored.
    """
    dealt, answers = _plan(docs.select("doc_id", "text"))
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents without their repeated bytes, with their columns; n_chars follows the text, and documents of which nothing is left go.

    What is left of a character that lost some of its bytes is dropped with them.  A null or empty text
    stays as it is; null and repeated doc_ids as in repeated_spans(); an empty table gives no rows.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", F.struct(*(docs[c] for c in others)).alias("rest") if others else F.lit(None).cast("string").alias("rest"))

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        texts, left = [], []
        for old, (_, data, keep) in zip(rows["text"].to_pylist() if rows.num_rows else [], _kept(rows, answers), strict=True):
            text = old if old is None or keep.all() else data[keep].tobytes().decode("utf-8", "ignore")
            texts.append(text)
            left.append(not old or bool(text))
        out = rows.select(["doc_id", "text", "rest"]).set_column(1, "text", pa.array(texts, pa.string()))
        return out.filter(pa.array(left, pa.bool_()))

    dealt, answers = _plan(packed)
    kinds = dict(packed.dtypes)
    cleaned = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, f"doc_id {kinds['doc_id']}, text string, rest {kinds['rest']}")
    length = F.coalesce(F.length("text"), F.lit(0))
    named = {"doc_id": F.col("doc_id"), "text": F.col("text")} | {c: F.col("rest").getField(c) for c in others}
    if "n_chars" in named:
        named["n_chars"] = length.cast(dict(docs.dtypes)["n_chars"])
    return cleaned.select(*(named[c].alias(c) for c in docs.columns))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))
