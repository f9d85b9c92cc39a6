"""Versions against intervals of advisories: a key that sorts as versions do, and a join by bins that no side has to fit into memory for.

An advisory holds for versions from ``introduced`` on and before ``fixed``; what is null is open.  The key space of a package with many
advisories is cut into bins at some of its own bounds, an interval stands in each bin it reaches into, and a version in one bin.  So a version meets the
advisories of its bin only, by an equi-join.  Only distinct versions are matched, so that a package that is everywhere costs its versions and not its uses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of a package's advisories between two cuts, about.
BIN = 64


def version_key(version: Column) -> Column:
    """An array that sorts as versions do, however many parts they have: the numbers between the dots, what is no number as 0, without zeros at the end, and a zero after all.

    Range signs are left out, as in ``^1.2``.  The last zero makes a version that goes on sort by what follows: after it, or before it where that is negative.
    """
    parts = F.transform(F.split(F.regexp_replace(version, r"[\^~>=<]", ""), r"\."), lambda x: F.coalesce(F.nullif(F.trim(x), F.lit("")).try_cast("double"), F.lit(0.0)))
    last = F.aggregate(F.transform(parts, lambda x, i: F.when(x != 0, i + 1).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b))
    return F.concat(F.slice(parts, F.lit(1), last), F.array(F.lit(0.0)))


def _bin(key: Column, cuts: Column) -> Column:
    """How many cuts stand at or below a key."""
    return F.coalesce(F.size(F.filter(cuts, lambda c: c <= key)), F.lit(0))


def _held(dependencies: DataFrame, advisories: DataFrame) -> DataFrame:
    """__ecosystem, __package, __version, advisory: every distinct version beside every advisory that holds for it."""
    name = ["ecosystem", "package"]
    known = advisories.select(*(F.col(c).alias(f"__{c}") for c in name), version_key(F.col("introduced")).alias("__lo"), version_key(F.col("fixed")).alias("__hi"), F.struct(*advisories.columns).alias("advisory"))
    versions = dependencies.select(*(F.col(c).alias(f"__{c}") for c in name), F.col("version").alias("__version")).distinct()
    versions = versions.withColumn("__key", version_key(F.col("__version")))
    own = ["__ecosystem", "__package"]
    bounds = known.select(*own, F.explode(F.array_compact(F.array("__lo", "__hi"))).alias("bound")).distinct()
    counts = bounds.groupBy(*own).agg(F.count("*").alias("n")).where(F.col("n") > BIN)
    # Some bounds, drawn by their hashes, are the cuts: one in BIN, or one in the root of a package's bounds where these are very many.
    drawn = bounds.join(counts, own).where(F.pmod(F.xxhash64("bound"), F.greatest(F.lit(BIN), F.sqrt("n").cast("long"))) == 0)
    cuts = drawn.groupBy(*own).agg(F.sort_array(F.collect_set("bound")).alias("__cuts"))
    placed = versions.join(cuts, own, "left").select(*own, "__version", "__key", F.when(F.col("__key").isNull(), F.lit(-1)).otherwise(_bin(F.col("__key"), F.col("__cuts"))).alias("__bin"))
    first = F.when(F.col("__lo").isNull(), 0).otherwise(_bin(F.col("__lo"), F.col("__cuts")))
    last = F.when(F.col("__hi").isNull(), F.coalesce(F.size("__cuts"), F.lit(0))).otherwise(_bin(F.col("__hi"), F.col("__cuts")))
    reach = F.when(F.col("__lo").isNull() & F.col("__hi").isNull(), F.concat(F.array(F.lit(-1)), F.sequence(first, last))).when(first <= last, F.sequence(first, last))
    binned = known.join(cuts, own, "left").select(*own, "__lo", "__hi", "advisory", F.explode(reach).alias("__bin"))
    inside = (F.col("__lo").isNull() | (F.col("__lo") <= F.col("__key"))) & (F.col("__hi").isNull() | (F.col("__key") < F.col("__hi")))
    free = F.col("__lo").isNull() & F.col("__hi").isNull()
    return placed.join(binned, [*own, "__bin"]).where(F.coalesce(inside, free)).select(*own, "__version", "advisory")


def _beside(dependencies: DataFrame, held: DataFrame) -> DataFrame:
    """The dependencies beside what is held of their version."""
    return dependencies.join(held, (F.col("ecosystem") == F.col("__ecosystem")) & (F.col("package") == F.col("__package")) & F.col("version").eqNullSafe(F.col("__version")))


def affected(dependencies: DataFrame, advisories: DataFrame) -> DataFrame:
    """Every dependency beside every advisory that holds for it: the columns of ``dependencies`` (ecosystem, package, version and others), and ``advisory``, a struct of all columns of the advisory.

    advisories: ecosystem, package, introduced, fixed and others, any number of rows.  A null version is held by advisories
    without bounds only; rows without an ecosystem or package have none; repeated rows on either side count each; empty tables give no rows.
    """
    joined = _beside(dependencies, _held(dependencies, advisories))
    return joined.select(*(dependencies[c] for c in dependencies.columns), "advisory")


def affected_totals(dependencies: DataFrame, advisories: DataFrame, value: str) -> DataFrame:
    """Every dependency for which an advisory holds, with ``n`` advisories, and ``last`` and ``sum``: the greatest and the sum of their ``value``; the rows count as in ``affected``.

    Totals of equal intervals are made before the join, and totals of a version before the dependencies come to it: what is joined are the distinct
    intervals and versions of a package, however many advisories and uses there are of each.
    """
    totals = lambda n, last, sum_: (F.sum(n).alias("n"), F.max(last).alias("last"), F.sum(sum_).alias("sum"))
    equal = advisories.groupBy("ecosystem", "package", "introduced", "fixed").agg(*totals(F.lit(1), value, value))
    held = _held(dependencies, equal).groupBy("__ecosystem", "__package", "__version").agg(*totals("advisory.n", "advisory.last", "advisory.sum"))
    return _beside(dependencies, held).select(*(dependencies[c] for c in dependencies.columns), "n", "last", "sum")
