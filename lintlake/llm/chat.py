"""Chat formatting by prefix-target expansion.

Each assistant turn becomes an example of its own: all turns before it as context, and only that
reply under the loss mask.  What follows the last reply (or a conversation without one) becomes a
context-only example, so that nothing of a conversation is lost.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# The template's control strings.  A turn reads <s>[INST]role[/INST]text</s>.
BEGIN, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
#: The first character of a control string, or a backslash.
RISKY = re.compile(r"\\|<(?=/?s>)|\[(?=/?INST\])")
TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.DOTALL)
EXAMPLE = "conv_id long, example int, n_turns long, text string, loss_start long, loss_end long, last boolean"


def escape(text: str) -> str:
    """Breaks control strings by a backslash after their first character and doubles backslashes; reversible."""
    return RISKY.sub(lambda m: m.group() + "\\", text)


def unescape(text: str) -> str:
    return re.sub(r"([\\<\[])\\", r"\1", text)


def render(role: str | None, text: str) -> tuple[str, int]:
    """A turn under the template, and where its text begins in it."""
    head = BEGIN + OPEN + escape(role or "") + CLOSE
    return head + escape(text) + END, len(head)


def read_back(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted example."""
    return [(unescape(role), unescape(body)) for role, body in TURN.findall(text)]


def _examples(conv_id: int, turns: list[tuple[str, str]]) -> Iterator[tuple]:
    prefix, number, expanded = "", 0, True
    for at, (role, text) in enumerate(turns, 1):
        turn, head = render(role, text)
        start = len(prefix) + head
        prefix += turn
        expanded = role == "assistant"
        if expanded:
            yield conv_id, number, at, prefix, start, len(prefix) - len(END), at == len(turns)
            number += 1
    if not expanded:
        yield conv_id, number, len(turns), prefix, 0, 0, True


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and turn; holds one conversation at a time and gives examples out by the megabyte."""
    names = ["conv_id", "example", "n_turns", "text", "loss_start", "loss_end", "last"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
    out: list[tuple] = []
    held = 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds, strict=True)], names)

    current, turns, begun = None, [], False

    def rows() -> Iterator[tuple]:
        nonlocal current, turns, begun
        for batch in batches:
            for *conv, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "own", "role", "text")), strict=True):
                if begun and conv != current:
                    yield from _examples(current[0], turns)
                    turns = []
                current, begun = conv, True
                turns.append((role or "", text or ""))
        if begun:
            yield from _examples(current[0], turns)

    for row in rows():
        out.append(row)
        held += len(row[3])
        if held > 4 << 20:
            yield flush()
            out, held = [], 0
    if out:
        yield flush()


def examples(conversations: DataFrame) -> DataFrame:
    """One row per assistant turn (and a context-only one where turns follow the last reply): conv_id, example, n_turns, text, loss_start, loss_end, last.

    Turns go by ``turn`` (null first; ties by role, then text, nulls first).  A null text or role is
    empty; each row with a null conv_id is a conversation of its own, so that such rows do not gather in
    one place.  An example repeats its context, as the format asks: a conversation's examples grow with the
    square of its length, and a worker holds the turns of one conversation and a few MB of examples.  Empty
    tables give no rows; other columns are ignored.
    """
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("own")
    dealt = conversations.select("conv_id", alone, "turn", "role", "text").repartition("conv_id", "own").sortWithinPartitions("conv_id", "own", "turn", "role", "text")
    return dealt.select("conv_id", "own", "role", "text").mapInArrow(_expand, EXAMPLE)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests per conversation, from formatted examples alone, in the order in which they were expanded."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    loss, chars, formatted = hashlib.sha256(), 0, 0
    for batch in batches:
        out = []
        for conv, text, start, end, last in zip(*(batch[c].to_pylist() for c in ("conv_id", "text", "loss_start", "loss_end", "last")), strict=True):
            reply = unescape(text[start:end])
            loss.update(reply.encode())
            chars += len(reply)
            formatted += len(text)
            if last:
                turns = read_back(text)
                digest = hashlib.sha256("".join(f"{role}\n{body}\n" for role, body in turns).encode()).hexdigest()
                out.append((conv, len(turns), digest, chars, loss.hexdigest(), formatted))
                loss, chars, formatted = hashlib.sha256(), 0, 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds, strict=True)], names)


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation what its formatted examples say when read back.  Takes the output of ``examples`` as it comes."""
    return formatted.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    return digests(examples(said.unionByName(own)))
