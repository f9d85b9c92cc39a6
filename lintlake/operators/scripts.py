"""Scripts by what their characters are: spans, findings with the place they stand in, finders over tokens, edits.

One Arrow UDF a question tells spans, finds or edits; everything after it is built-in expressions on its arrays.
"""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType, StructField, StructType

from ..functions import lexer, tokens
from ..functions.lexer import KINDS, spans
from ..functions.tokens import edits, found
from ..rules.catalogue import Rule
from .kernel import FINDING, scan

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no installed copy of the package

SCRIPTS = ("javascript", "typescript")


def _rows(**fields: DataType) -> ArrayType:
    return ArrayType(StructType([StructField(n, t) for n, t in fields.items()]))


SPANS = _rows(kind=StringType(), begin=IntegerType(), end=IntegerType())
FOUND = _rows(finder=StringType(), line=IntegerType(), column=IntegerType(), code=StringType(), source=StringType(), names=ArrayType(StringType()))
EDITS = _rows(begin=IntegerType(), end=IntegerType(), text=StringType())
#: Bytes of texts that are lexed together.
TOGETHER = 1 << 20

_SPAN, _FOUND, _EDIT = map(to_arrow_type, (SPANS, FOUND, EDITS))


def _lexed(texts: list[str | None]):
    """(text, spans in bytes) of each text, some together; null texts have none."""
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and (stop == start or size < TOGETHER):
            size += len(texts[stop] or "")
            stop += 1
        part = texts[start:stop]
        yield from zip(part, spans([(t or "").encode() for t in part]), strict=True)
        start = stop


@F.arrow_udf(SPANS)
def script_spans(texts: pa.Array) -> pa.Array:
    """The spans of a script in characters, from the first to the last: kind (code, string, template, comment, regex), begin, end."""
    out = []
    for text, own in _lexed(texts.to_pylist()):
        rows, at = [], 0
        for kind, a, z in own:
            size = z - a if text.isascii() else len(text.encode()[a:z].decode())
            rows.append({"kind": KINDS[kind], "begin": at, "end": at + size})
            at += size
        out.append(None if text is None else rows)
    return pa.array(out, _SPAN)


@F.arrow_udf(FOUND)
def script_finds(texts: pa.Array) -> pa.Array:
    """What the finders find in a script: innerHTML, sql, eval, secret and import, with line, column (from 0), the trimmed line, and an import's source and names."""
    return pa.array([None if t is None else found(t, own) for t, own in _lexed(texts.to_pylist())], _FOUND)


@F.arrow_udf(EDITS)
def script_edits(texts: pa.Array, kinds: pa.Array) -> pa.Array:
    """What mends a finding of a type in a script: the replacements of characters begin to end, by place."""
    return pa.array([None if t is None else edits(t, k, own) for (t, own), k in zip(_lexed(texts.to_pylist()), kinds.to_pylist(), strict=True)], _EDIT)


# What they tell is worked out once and then read by lambdas; a call that the optimizer copied into a lambda could not run there.
script_spans, script_edits = script_spans.asNondeterministic(), script_edits.asNondeterministic()


def spliced(text: Column, changes: Column) -> Column:
    """The text with its changes (begin, end, text) made, put together from the gaps; of changes that overlap the one that begins first, and of these the longest, is made."""
    ordered = F.array_sort(changes, lambda a, b: F.when(a["begin"] != b["begin"], a["begin"] - b["begin"]).otherwise(b["end"] - a["end"]))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def put(acc: Column, e: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, e["begin"] - acc["at"])
        made = F.struct(e["end"].alias("at"), F.concat(acc["parts"], F.array(gap, e["text"])).alias("parts"))
        return F.when(e["begin"] >= acc["at"], made).otherwise(acc)

    return F.aggregate(ordered, start, put, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text))))


def mask(text: Column, spans: Column, kinds: tuple[str, ...] = ("string", "template", "comment", "regex")) -> Column:
    """The text with all characters of spans of these kinds as spaces, line ends apart; lines and columns stay."""
    parts = F.transform(spans, lambda s: (lambda piece: F.when(s["kind"].isin(*kinds), F.regexp_replace(piece, r"[^\n]", " ")).otherwise(piece))(F.substring(text, s["begin"] + 1, s["end"] - s["begin"])))
    return F.array_join(parts, "")


def scan_scripts(sources: DataFrame, listed: list[Rule]) -> DataFrame:
    """What ``scan`` gives, and ``place``: the kind of span in which a match begins (null: the source is no script)."""
    script = F.when(F.col("language").isin(*SCRIPTS), F.col("text"))
    others = [c for c in sources.columns if c not in ("text", *FINDING)]
    found = scan(sources.withColumn("__spans", script_spans(script)), listed, begins=True)
    place = F.get(F.filter("__spans", lambda s: (s["begin"] <= F.col("__begin")) & (F.col("__begin") < s["end"])), F.lit(0))["kind"]
    return found.select(*FINDING, *others, place.alias("place"))


def script_findings(sources: DataFrame) -> DataFrame:
    """A row per find of the finders in sources (file, language, text) that are scripts: file, finder, line, column, code, source, names, and the other columns.

    Code that does not parse is searched too; ``)`` before a slash always divides, so a regular expression right after ``if (...)`` is taken for code up
    to the line's end.
    """
    others = [c for c in sources.columns if c not in ("file", "language", "text", "finder", "line", "column", "code", "source", "names")]
    scripts = sources.where(F.col("language").isin(*SCRIPTS) & F.col("text").rlike("(?i)innerHTML|query|execute|sql|eval|Function|key|secret|password|token|import"))
    return scripts.select("file", *others, F.explode(script_finds("text")).alias("f")).select("file", "f.*", *others)


def tokens_of(text: str) -> list[tokens.Token]:
    """The tokens of one script, for interactive use."""
    return tokens.Script(text, lexer.spans([text.encode()])[0]).tokens
