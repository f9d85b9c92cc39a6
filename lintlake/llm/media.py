"""Media columns: texts kept as baseline JPEG pictures, and dimensions and thumbnail hashes read from pictures."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import blocks, encoded, table
from .jpeg import MOST_ROWS, WIDTH, read, write

FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def padded(text: bytes) -> bytes:
    return text + b" " * (-len(text) % WIDTH or (0 if text else WIDTH))


def to_media(texts: list[bytes]) -> list[bytes]:
    """A file for each text: one picture, or several in a row for a text beyond a picture's height."""
    most = WIDTH * MOST_ROWS
    frames = [[p[a : a + most] for a in range(0, len(p), most)] for p in map(padded, texts)]
    todo = [f for own in frames for f in own]
    pictures: list[bytes] = []
    while len(pictures) < len(todo):  # a megabyte at a time
        at, size = len(pictures), 0
        while at < len(todo) and (not size or size + len(todo[at]) <= 1 << 20):
            size += len(todo[at])
            at += 1
        pictures += write(todo[len(pictures) : at])
    made = iter(pictures)
    return [b"".join(next(made) for _ in own) for own in frames]


def thumbnail_hash(thumb: np.ndarray) -> str:
    """64 bits of brightness against the mean and 64 of left against right, over an 8 x 9 reduction of the thumbnail."""
    rows, columns = (np.arange(8) * thumb.shape[0]) // 8, (np.arange(9) * thumb.shape[1]) // 9
    small = np.add.reduceat(np.add.reduceat(thumb, rows, axis=0, dtype=np.int64), columns, axis=1)
    per = np.outer(np.maximum(np.diff(rows, append=thumb.shape[0]), 1), np.maximum(np.diff(columns, append=thumb.shape[1]), 1))
    grid = small / per
    bits = np.concatenate([(grid[:, :8] > grid[:, :8].mean()).ravel(), (grid[:, 1:] > grid[:, :-1]).ravel()])
    return np.packbits(bits).tobytes().hex()


def outline(pictures: list[tuple[int, int, np.ndarray]]) -> tuple[int, int, int, str]:
    """Of a file's pictures, one below the other: width, height, how many there are, thumbnail hash.  Narrower ones are stretched to the widest."""
    width = max(w for w, _, _ in pictures)
    most = max(thumb.shape[1] for _, _, thumb in pictures)
    thumbs = [t if t.shape[1] == most else t[:, np.arange(most) * t.shape[1] // most] for _, _, t in pictures]
    return width, sum(h for _, h, _ in pictures), len(pictures), thumbnail_hash(np.concatenate(thumbs) if len(thumbs) > 1 else thumbs[0])


def describe(pictures: list[tuple[int, int, np.ndarray]]) -> str:
    """Dimensions of all pictures of a file together, how many there are, and the hash of all their thumbnails."""
    width, height, n, digest = outline(pictures)
    return f"{width}x{height}x{n}:{digest}"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch, 1 << 19):
            texts = encoded(block)
            rows = []
            for text, media, pictures in ((t, m, p) for t, m, p in _read(texts)):
                payload = b"".join(thumb.tobytes() for _, _, thumb in pictures)
                rows.append((len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), describe(pictures)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([block["doc_id"], *columns], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def _read(texts: list[bytes]) -> Iterator[tuple[bytes, bytes, list]]:
    """Texts with their files, and what is read back from the files alone."""
    files = to_media(texts)
    yield from zip(texts, files, read(files), strict=True)


def media_features(docs: DataFrame) -> DataFrame:
    """One row per document: what its stored picture says when it is read back.

    A null or empty text is 192 spaces.  Equal texts have equal files and hashes.  Rows that repeat
    a doc_id are kept each.  An empty table gives no rows; other columns are ignored.
    """
    return docs.select("doc_id", "text").mapInArrow(_features, FEATURES)


def media_column(docs: DataFrame) -> DataFrame:
    """The documents with a ``media`` column of their files instead of the text and of any ``media`` column they had.

    Other columns stay as they are; a null or empty text is a picture of 192 spaces, and an empty table gives no rows.
    """
    kinds = [f"`{c}` {k}" for c, k in docs.dtypes if c not in ("text", "media")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                names = [c for c in block.schema.names if c not in ("text", "media")]
                yield pa.RecordBatch.from_arrays([*(block[c] for c in names), pa.array(to_media(encoded(block)), pa.binary())], [*names, "media"])

    return docs.mapInArrow(run, ", ".join([*kinds, "media binary"]))


def picture_info(media: DataFrame) -> DataFrame:
    """doc_id, width, height, pictures, thumbnail_hash of any table with baseline JPEG files in ``media``; all null for a null or a broken file.

    Rows that repeat a doc_id are read each; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file in batch["media"].to_pylist():
                try:
                    rows.append(outline(read([file])[0]))
                except (ValueError, IndexError, KeyError, TypeError):
                    rows.append((None,) * 4)
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], ["doc_id", "width", "height", "pictures", "thumbnail_hash"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, width int, height int, pictures int, thumbnail_hash string")


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(table(spark, sf_dir, "documents"))
