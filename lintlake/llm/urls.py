"""URL filter: rules of hosts and paths, and for the rest a weighted vocabulary counted by an Aho-Corasick automaton.

Host, path and rules are built-in expressions.  The automaton goes once over a lower-cased URL and finds the terms of the
vocabulary wherever they stand; a hit counts if neither neighbour is a letter or digit, and a term counts once.  Every term
has a weight: one strict term reaches the limit by itself, soft ones reach it together.  No shuffle, whatever host is hot.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

LIMIT = 2
STRICT = ("adult", "casino", "cialis", "escorts", "hentai", "malware", "phishing", "porn", "porno", "spam", "viagra", "warez", "xxx")
SOFT = ("ads", "bet", "bets", "bonus", "cheap", "crack", "dating", "farm", "free", "jackpot", "keygen", "loan", "loans", "lottery", "nude", "pills", "poker", "replica", "sex", "slots", "torrent", "track", "win")
#: term: weight.  A parameter of every function here; a vocabulary is held by each task, so it should stay below some million terms.
VOCABULARY = dict.fromkeys(STRICT, LIMIT) | dict.fromkeys(SOFT, 1)


@dataclass(frozen=True)
class UrlRule:
    """Holds for a host and all its subdomains, where the URL's path starts with the rule's."""

    host: str
    path: str
    verdict: str


#: The rules of the query.
RULES = (UrlRule("org", "/", "allow"), UrlRule("example.org", "/es/", "block"), UrlRule("example.org", "/en/1", "block"), UrlRule("com", "/fr/", "allow"), UrlRule("com", "/de/", "block"))


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next slash, question mark, hash or the end, A-Z lowered; empty without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark, hash or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> Column:
    """(length, verdict, rule) of the longest rule that fits, null without one; of equally long ones ``block`` goes before ``allow``."""
    fits = [F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.struct(F.lit(len(r.host + r.path)).alias("length"), F.lit(r.verdict).alias("verdict"), F.lit(r.host + r.path).alias("rule"))) for r in rules]
    return F.array_max(F.array_compact(F.array(*fits))) if fits else F.lit(None).cast("struct<length: int, verdict: string, rule: string>")


def distinct_terms(url: str | None, automaton, lower: dict[int, int] = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)) -> set[str]:
    """The terms that stand in a URL between characters that are neither ASCII letters, digits nor outside ASCII."""
    text, found = (url or "").translate(lower), set()
    inside = lambda i: 0 <= i < len(text) and (text[i].isalnum() or text[i] > "\x7f")
    for last, term in automaton.iter(text):
        if not inside(last - len(term)) and not inside(last + 1):
            found.add(term)
    return found


def counted(vocabulary: dict[str, int] = VOCABULARY, limit: int = LIMIT):
    """A function of a URL column: (weight, strict, soft) of the distinct terms in it; a null URL has none.  An automaton is built once a task."""

    @F.arrow_udf("struct<weight: long, strict: long, soft: long>")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term in vocabulary:
            if term:
                automaton.add_word(term, term)
        automaton.make_automaton()
        for urls in batches:
            terms = [distinct_terms(u, automaton) if len(automaton) else set() for u in urls.to_pylist()]
            strict = [sum(vocabulary[t] >= limit for t in found) for found in terms]
            weight = [sum(vocabulary[t] for t in found) for found in terms]
            soft = [len(found) - s for found, s in zip(terms, strict, strict=True)]
            yield pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (weight, strict, soft)], ["weight", "strict", "soft"])

    return count


def judged(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, vocabulary: dict[str, int] = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict (allow or block), weight, strict, soft.

    The longest rule that fits decides (rule: its host and path); without one (rule: null) a URL is blocked if the weights of the
    distinct terms in it reach ``limit``.  Null and empty URLs and those without ``://`` have an empty host and path and
    fit no rule; a null URL has no terms.  Rows that repeat, or have no page_id, are judged each; an empty table
    gives no rows; other columns of ``pages`` are left out.
    """
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), counted(vocabulary, limit)(F.col("url")).alias("hits"))
    ruled = parts.withColumn("fit", rule_for(F.col("host"), F.col("path"), rules))
    by_terms = F.when(F.col("hits.weight") >= limit, "block").otherwise("allow")
    return ruled.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", by_terms).alias("verdict"), "hits.*")


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))
