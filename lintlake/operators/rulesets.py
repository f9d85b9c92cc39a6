"""Rules that come as a table of any length: a literal index finds the pairs of texts and rules that may match, by an equi-join.

A rule's pattern tells which literals a match must hold.  A word that must stand in the text as a whole is the key of its rule.  Else, of one literal
of each alternative a gram becomes a key of the rule: up to 7 characters in a row that are letters, digits or underscores, the ones that the fewest other rules use; a literal without three such characters gives
one of its characters, and a pattern without literals the empty key, which every text holds.  A text gives the grams of its
words that a bitmap of all keys lets pass, and the equi-join of grams with keys gives the candidates.  Those are
held against all literals, then against the pattern of the rule's own row, and matches become findings as in any other scan.
Where no match of a pattern leaves its line, the pattern runs over the lines that hold the literals and not over the whole text.
No expression is built for a single rule, no pair is formed that shares no key, and no text is shuffled.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import regex
from ..functions.regex import js_to_java, one_line, required, whole_words
from ..functions.text import quoted
from ..rules.catalogue import KINDS, RULE, Rule
from .kernel import CHECKED, FINDING, RULE_COLUMNS, findings_of

for module in (sys.modules[__name__], regex):
    cloudpickle.register_pickle_by_value(module)  # workers need no installed copy of the package

#: Lengths of the grams inside words.
LENGTHS = (7, 5, 3)
#: What a key begins with that is a whole word.
WHOLE = "="
#: Rules that one pass over the texts looks for; more rules take more passes, and this many are broadcast.
BLOCK = 20_000
#: Bits of the bitmap for each key, and bits at most.
SPARSE, MOST_BITS = 64, 1 << 22

#: What a rule may say; rule_id and pattern it must.
DEFAULTS = {"flags": "''", "languages": "CAST(NULL AS array<string>)", "rule_no": "1000", "scanner": "'rules'", "type": "rule_id", "severity": "'medium'", "owasp_category": "CAST(NULL AS string)", "cwe_id": "CAST(NULL AS string)", "snippet": "0", "message": "''", "fix": "''", "cis": "CAST(NULL AS string)"}
READ = f"{RULE.replace('hit int, ', '')}, languages array<string>, fold boolean, local boolean, literals array<array<string>>, grams array<array<string>>"


def as_table(spark, listed: list[Rule]) -> DataFrame:
    """Rules of the catalogue as a table of rules."""
    rows = [(r.rule_id, r.pattern, r.flags, list(r.languages), r.number, r.scanner, r.name, r.severity, r.owasp, r.cwe, r.snippet, r.message, r.fix, r.cis) for r in listed]
    return spark.createDataFrame(rows, "rule_id string, pattern string, flags string, languages array<string>, rule_no int, scanner string, type string, severity string, owasp_category string, cwe_id string, snippet int, message string, fix string, cis string")


def grams_of(literal: str) -> list[str]:
    """The keys that a text with this literal, lowered, is sure to hold: the longest grams inside its words, else its characters, else the empty key."""
    import re

    lowered = "".join(c.lower() if c.isascii() else " " for c in literal)
    runs = re.findall("[a-z0-9_]+", lowered)
    for q in LENGTHS:
        found = [run[i : i + q] for run in runs for i in range(len(run) - q + 1)]
        if found:
            return sorted(set(found))
    return sorted(set(lowered) - {" "}) or [""]


def keys_of(pattern: str, literals: list[list[str]]) -> list[list[str]]:
    """Of each alternative the keys of which a text with a match holds all: the longest whole word, unless there are longer grams."""
    grams = [grams_of(x) for x in (literals or [[""]])[0]]
    word = max(whole_words(pattern), key=len, default="").lower()
    return [[WHOLE + word]] if len(word) >= max(min(LENGTHS), *(len(g[0]) for g in grams)) else grams


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each rule: its Java pattern, the literals it needs, and the grams of each alternative of the best of them."""
    for batch in batches:
        rows = batch.to_pylist()
        for r in rows:
            flags = r.pop("flags") or ""
            r["literals"] = required(r["pattern"])
            r["fold"] = "i" in flags
            r["local"] = bool(r["literals"]) and one_line(r["pattern"], flags)
            r["grams"] = keys_of(r["pattern"], r["literals"])
            r["pattern"] = js_to_java(r["pattern"], flags)
        schema = pa.schema([(n, {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<array<string>>": pa.list_(pa.list_(pa.string()))}[t]) for n, t in (c.split() for c in READ.split(", "))])
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


@dataclass
class RuleIndex:
    """rules: a row per rule with its ``keys``; rows: how many."""

    rules: DataFrame
    rows: int


def index(rules: DataFrame) -> RuleIndex:
    """Reads a table of rules: rule_id, pattern (as ECMAScript writes it), and of DEFAULTS what there is.

    Rows without a rule_id or pattern are left out, and a rule that is repeated as a whole counts once.  A pattern that Java cannot
    read fails the scan.
    """
    full = rules.where("rule_id IS NOT NULL AND pattern IS NOT NULL").selectExpr("rule_id", "pattern", *(f"coalesce({c}, {d}) AS {c}" if c in rules.columns else f"{d} AS {c}" for c, d in DEFAULTS.items()))
    typed = full.withColumns({"rule_no": F.col("rule_no").cast("int"), "snippet": F.col("snippet").cast("int")})
    read = typed.mapInArrow(_read, READ)
    rule = F.struct(*(c for c in read.columns if c != "grams")).alias("rule")
    each = read.select(rule, F.posexplode("grams").alias("place", "grams")).select("rule", "place", F.explode("grams").alias("gram"))
    shared = each.groupBy("gram").agg(F.count("*").alias("n"))
    best = each.join(shared, "gram").groupBy("rule", "place").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    keyed = best.groupBy("rule").agg(F.sort_array(F.collect_set("gram")).alias("keys")).select("rule.*", "keys")
    kept = keyed.checkpoint() if rules.sparkSession.conf.get("spark.checkpoint.dir", None) else keyed.persist()
    return RuleIndex(kept, kept.count())


def _bitmap(keys: DataFrame) -> tuple[int, str]:
    """How many bits, and SQL of an array of 64-bit words with a bit for each key; as long as MOST_BITS allow, however many rules there are."""
    n = keys.count()
    bits = max(1 << min((SPARSE * max(n, 1)).bit_length(), MOST_BITS.bit_length() - 1), 64)
    place = F.pmod(F.xxhash64("key"), F.lit(bits))
    rows = keys.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(p & 63 AS int)))").alias("bits")).collect()
    words = ["0"] * (bits // 64)
    for r in rows:
        words[r.word] = str(r.bits)
    return bits, f"CAST(split('{','.join(words)}', ',') AS array<bigint>)"


def text_keys(keys: DataFrame, text: str, lowered: str) -> str:
    """SQL of the keys that a text holds, as far as bitmaps of ``keys`` (column key) tell: all that are there, few others, each once."""
    is_whole = F.startswith("key", F.lit(WHOLE)) & (F.length("key") > 1)
    whole, inner = keys.where(is_whole).select(F.substring("key", len(WHOLE) + 1, 1 << 30).alias("key")), keys.where(~is_whole & (F.length("key") >= min(LENGTHS)))
    short = keys.where(F.length("key") < min(LENGTHS)).distinct().collect()  # ASCII characters and the empty key
    found = [f"filter(CAST(array({', '.join(quoted(r.key) for r in short)}) AS array<string>), k -> contains({lowered}, k))"]

    def held(bits: int, bitmap: str) -> str:
        return f"(shiftright(get({bitmap}, CAST(shiftright(pmod(xxhash64(g), {bits}L), 6) AS int)), CAST(pmod(xxhash64(g), 64L) AS int)) & 1) = 1"

    if lengths := sorted(r.n for r in inner.select(F.length("key").alias("n")).distinct().collect()):
        passed = held(*_bitmap(inner))
        grams = [f"flatten(transform(words, t -> filter(transform(sequence(1, greatest(length(t) - {q - 1}, 1)), i -> substring(t, i, {q})), g -> length(g) = {q} AND {passed})))" for q in lengths]
        words = f"array_distinct(regexp_extract_all({lowered}, '[a-z0-9_]{{{lengths[0]},}}', 0))"
        found.append(f"flatten(transform(array({words}), words -> array_distinct(concat({', '.join(grams)}))))")
    if least := whole.agg(F.min(F.length("key"))).first()[0]:
        # Lowered after they are cut out: letters that are ASCII only when lowered are no part of a word.
        words = f"array_distinct(split(lower(array_join(regexp_extract_all({text}, '[A-Za-z0-9_]{{{least},}}', 0), ' ')), ' '))"
        found.append(f"transform(filter({words}, g -> {held(*_bitmap(whole))}), g -> concat({quoted(WHOLE)}, g))")
    return f"concat({', '.join(found)})"


def _candidates(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """Texts, cut into lines, beside the rules of one block that have a key in them, each pair once."""
    keys = rules.select(F.explode("keys").alias("key"))
    held = texts.withColumn("lowered", F.lower("text")).withColumns({"lines": F.split("text", "\n"), "lows": F.split("lowered", "\n"), "held": F.expr(text_keys(keys, "text", "lowered"))})
    found = held.select("file", "language", "rest", "lines", "lows", F.explode("held").alias("key"))
    pairs = found.join(F.broadcast(rules.select(F.explode("keys").alias("key"), "*")), "key")  # BLOCK rules at most
    # The text stands in the first argument too: filters that are inferred from the equality of keys overlook it inside the lambda.
    first = F.get(F.filter(F.when(F.col("lows").isNotNull(), F.col("keys")), lambda k: F.contains(F.array_join("lows", "\n"), k)), F.lit(0))
    return pairs.where((F.size("keys") == 1) | (first == F.col("key")))


def _fits() -> Column:
    """Whether a candidate's rule is for the text's language."""
    kinds = ", ".join(map(quoted, KINDS))
    return F.expr(f"CASE WHEN scanner IN ({kinds}) THEN language = scanner WHEN size(languages) > 0 THEN array_contains(languages, language) ELSE coalesce(language NOT IN ({kinds}), true) END")


def _searched(pairs: DataFrame) -> DataFrame:
    """Candidates with what the pattern is looked up in, once, for the matches: ``text``, and the ``numbers`` of its lines where they are not all.

    Of a rule whose matches stay in a line the lines that hold its literals, else the whole text if it holds them; null if there is nothing.
    """
    holds = lambda text, lowered: f"forall(literals, l -> exists(l, x -> IF(fold, contains({lowered}, lower(x)), contains({text}, x))))"
    whole, lowered = "array_join(lines, '\\n')", "array_join(lows, '\\n')"
    some = f"IF(local, filter(transform(lines, (line, i) -> IF({holds('line', 'get(lows, i)')}, struct(i + 1 AS n, line AS text), NULL)), x -> x IS NOT NULL), NULL)"
    cut = pairs.withColumn("some", F.expr(some))
    text = f"CASE WHEN local THEN IF(size(some) > 0, array_join(some.text, '\\n'), NULL) WHEN {holds(whole, lowered)} THEN {whole} END"
    return cut.withColumns({"text": F.expr(text), "numbers": F.expr("some.n")})


def scan_rules(sources: DataFrame, rules: DataFrame | RuleIndex) -> DataFrame:
    """Findings of a table of rules in ``sources`` (file, language, text): what ``scan`` gives for a list of them, other columns of ``sources`` too.

    Null and empty texts and empty tables give no findings.  Rules go over the texts in blocks of BLOCK; each block is one pass, and what
    it broadcasts is no longer than a block.
    """
    ready = rules if isinstance(rules, RuleIndex) else index(rules)
    others = [c for c in sources.columns if c not in ("text", *FINDING)]
    rest = F.struct(*(sources[c] for c in others)) if others else F.lit(None).cast("string")
    texts = sources.where(F.col("text").isNotNull()).select("file", "language", "text", rest.alias("rest"))
    blocks, found = max(-(-ready.rows // BLOCK), 1), None
    for i in range(blocks):
        block = ready.rules.where(F.pmod(F.xxhash64("rule_id", "pattern"), F.lit(blocks)) == i) if blocks > 1 else ready.rules
        fired = _searched(_candidates(texts, block).where(_fits())).withColumns({"hit": F.lit(0), "at": F.lit(0), "c": F.lit(None).cast(f"struct<{CHECKED}>")})
        own = findings_of(fired.select("file", "language", "text", "numbers", "rest", "at", "c", *RULE_COLUMNS), others, numbers="numbers")
        found = own if found is None else found.unionByName(own)
    return found
