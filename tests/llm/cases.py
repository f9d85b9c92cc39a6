"""Small tables with the cases that every operator must take: nulls, empty and very long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, chunk string, family string, score string, y string, row string"
LONG = "\n".join(" ".join(f"w{(i * 7 + j * j) % 3001}" for j in range(40)) for i in range(600))


def texts() -> list[tuple[int | None, str | None, str | None]]:
    base = " ".join(f"alpha{i} beta{i % 13} gamma" for i in range(60))
    near = base.replace("alpha17", "other").replace("alpha40", "thing")
    return [
        (1, base, "b"), (2, base, "a"), (3, near, "a"), (4, None, "a"), (5, "", None), (6, " \t\n", None), (7, LONG, "c"), (8, "one", "a"), (9, "ONE", "b"),
        (10, "é ü 汉字 \U0001f600 " * 30, "ß"), (11, "a b\na b\n\nA B\n" * 9, "b"), (12, "x" * 300, "c"), (13, base[:200] + " tail of another kind entirely", None), (14, "\x00\x01 nul <|endoftext|> end", "a"),
        (15, " ".join(["same"] * 400), "b"), (16, "<s>[INST] # * $ % & | < >", "a"), (17, base, None), (17, base, None), (None, base, "a"), (None, None, None), (18, " nbsp line words", "a"),
    ]


def docs(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "c", None, "s", "y", "r") for i, t, s in rows], DOCS).repartition(3)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int, text string, y string")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def crc(text: bytes) -> int:
    return zlib.crc32(text)
