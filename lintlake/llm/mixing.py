"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A source's documents fall into blocks by a hash; a fixed bijection permutes the blocks.  The mix takes whole
passes over a source and a part of one more: the block in which that part ends is cut in two, where
the words come nearest to the target, so that the part is a whole number of blocks too.  These block quotas are
split exactly among the output shards by a binary tree: at each node the left half gets a
multivariate-hypergeometric share of what the node holds.  The tree runs over 1024 groups of sources, and within
each group over its sources, which is the same draw.  A shard's quota of a source is a run of the source's
permuted blocks, disjoint from all other shards' runs; what a document is taken for is what the
shards draw of it, and a shard's documents are shuffled locally, by hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, table, written

WEIGHTS = (5, 2, 1)
BLOCK_DOCS = 64
MOST_BLOCKS = 4096
#: Groups of sources; the driver sees one number for each.
GROUPS = 1024
#: The draw takes less than 10**9 blocks in all.
ALL_BLOCKS = 250_000_000
#: Sources (a row of some 300 bytes each) up to which their table is broadcast.
BROADCAST_SOURCES = 100_000
#: Into so many parts a shard is cut for its local shuffle.
SLOTS = 4096


def n_words() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def water_filled(totals: DataFrame, total: float, most: float, weights: tuple[float, ...]) -> DataFrame:
    """Adds source_no and target to (source, words): shares of ``total`` times all words by weight, none above ``most`` times its own words.

    Sources go by code point, a null one last.  In the order of words per weight, the sources that are full come
    first; of the others none is above the level that is left for it.  One row a source, whatever the data.
    """
    everything, by_fill = Window.partitionBy(), Window.partitionBy().orderBy("ratio", "source_no")
    numbered = totals.withColumn("source_no", F.row_number().over(Window.partitionBy().orderBy(F.asc_nulls_last("source"))) - 1)
    weighed = numbered.withColumn("weight", F.get(F.array(*(F.lit(float(w)) for w in weights)), F.col("source_no") % len(weights)))
    filled = weighed.withColumn("full", F.col("words") * float(most)).withColumn("ratio", F.col("full") / F.col("weight"))
    before = F.coalesce(F.sum("full").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
    level = (F.least(F.lit(float(total)), F.lit(float(most))) * F.sum("words").over(everything) - before) / left
    levelled = filled.withColumn("level", level).withColumn("level", F.when(F.col("ratio") > F.col("level"), F.col("level")))
    target = F.when(F.col("level").isNull(), F.col("full")).otherwise(F.max("level").over(everything) * F.col("weight"))
    return levelled.withColumn("target", target).drop("weight", "full", "ratio", "level")


def split_quotas(quotas: np.ndarray, shards: int, seed: list[int], sums: np.ndarray | None = None) -> np.ndarray:
    """(shards, len(quotas)): how much of each quota a shard gets.  The rows' sums are ``sums``, or differ by one at most."""
    out = np.zeros((shards, len(quotas)), np.int64)
    total = int(quotas.sum())
    if sums is None:
        sums = np.array([total // shards + (i < total % shards) for i in range(shards)], np.int64)

    def node(held: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[lo] = held
            return
        mid = (lo + hi) // 2
        rng = np.random.default_rng([*seed, lo, hi])
        share = rng.multivariate_hypergeometric(held, int(sums[lo:mid].sum()), method="marginals") if held.any() else held
        node(share, lo, mid)
        node(held - share, mid, hi)

    node(quotas.astype(np.int64), 0, shards)
    return out


def _split_group(shards: int, seed: int):
    """Of the sources of one group: where each shard's run of blocks ends."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("source_no")
        drawn = split_quotas(pdf["quota"].to_numpy(), shards, [seed, int(pdf["grp"].iloc[0])], np.array(pdf["sums"].iloc[0]))
        return pd.DataFrame({"source_no": pdf["source_no"], "ends": list(np.cumsum(drawn, axis=0).T)})

    return run


def nearest_subset(sizes: list[int], wanted: int) -> list[int]:
    """Indices of the sizes whose sum comes nearest to ``wanted``; sums are sets of bits, in units of some millionths of what is wanted."""
    unit = max(1, wanted // 200_000)
    steps = [1]
    for size in sizes:
        steps.append(steps[-1] | steps[-1] << (size // unit))
    goal = wanted // unit
    below = (steps[-1] & (1 << goal + 1) - 1).bit_length() - 1
    above = steps[-1] >> goal
    at = goal + (above & -above).bit_length() - 1 if above else below
    at = at if at - goal < goal - below else below
    chosen = []
    for i in range(len(sizes) - 1, -1, -1):
        if not steps[i] >> at & 1:
            chosen.append(i)
            at -= sizes[i] // unit
    return chosen


def fill_gap(block: pd.DataFrame, pool: int = 12) -> pd.DataFrame:
    """Of one source's last piece of a block: documents in hashed order, and of those around the end the subset that comes nearest to the target."""
    pdf = block.sort_values(["order_hash", "doc_id", "size"], kind="stable").reset_index(drop=True)
    wanted, upto = int(pdf["gap"].iloc[0]), np.cumsum(pdf["size"].to_numpy())
    first = max(0, int(np.searchsorted(upto, wanted, side="right")) - pool)
    held = int(upto[first - 1]) if first else 0
    around = pdf["size"].iloc[first : first + 2 * pool].tolist()
    chosen = [*range(first), *(first + i for i in nearest_subset(around, wanted - held))]
    return pd.DataFrame({"row_id": pdf["row_id"].iloc[chosen]})


def power_of_two(n: Column, most: int) -> Column:
    """The largest power of two within n and ``most``; 1 at least."""
    return F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(F.least(n.cast("double"), F.lit(float(most))), F.lit(1.0))))).cast("long")


def _cut(sized: DataFrame, place: str, wanted: str) -> DataFrame:
    """source_no, edge, gap, held: the place in which the words of a source, summed by place, come to exceed ``wanted``, how many words before that, and its documents."""
    sums = sized.groupBy("source_no", place).agg(F.sum("size").alias("words"), F.count("*").alias("held"), F.first(wanted).alias("wanted"))
    upto = sums.withColumn("end", F.sum("words").over(Window.partitionBy("source_no").orderBy(place)))  # MOST_BLOCKS rows a source at most
    edge = F.min(F.struct(F.col(place).alias("edge"), (F.col("wanted") - F.col("end") + F.col("words")).alias("gap"), "held"))
    return upto.where(F.col("end") > F.col("wanted")).groupBy("source_no").agg(edge.alias("e")).select("source_no", "e.*")


def mix(docs: DataFrame, total: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, shards: int = 16, seed: int = 7, rows: bool = False) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken, shards (of each copy), order_hash, row_id; with ``rows`` the document itself as ``row``.

    Whole documents are taken, up to ``ceil(most)`` times each; a source's taken words come as near its
    target as a subset of two dozen of its documents can bring them.  Null text has no words; a document
    without words takes part in passes like others.  Sources in order of code points, a null source
    last, take the weights in turn.  There may be any number of sources, and one of them may hold any part
    of all rows: beyond BROADCAST_SOURCES their table is joined by a shuffle whose large partitions can be split.
    Rows that repeat a doc_id with another text are placed on their own, and so are all rows with a null doc_id.
    An empty table gives no rows.  Extra columns are ignored.  Reruns agree.
    """
    spark = docs.sparkSession
    order = F.xxhash64("doc_id", "source", "text", F.lit(seed), F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()))
    kept = [F.struct(*(docs[c] for c in docs.columns)).alias("row")] if rows else []
    base = written(docs.select("doc_id", F.col("source").alias("own_source"), n_words().alias("size"), order.alias("order_hash"), F.monotonically_increasing_id().alias("row_id"), *kept), "mix")
    totals = written(base.groupBy(F.col("own_source").alias("source")).agg(F.sum("size").alias("words"), F.count("*").alias("n")), "sources")
    sources = totals.count()
    beside = F.broadcast if sources <= BROADCAST_SOURCES else lambda df: df
    most_blocks = int(min(MOST_BLOCKS, 2 ** np.floor(np.log2(max(1, ALL_BLOCKS // max(1, sources))))))
    blocks = power_of_two(F.col("n") / BLOCK_DOCS, most_blocks)
    passes = F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words"))).otherwise(0).cast("long")
    plan = water_filled(totals, total, most, weights).withColumns({"passes": passes, "blocks": blocks})
    plan = plan.withColumns({"part": F.round(F.col("target") - F.col("passes") * F.col("words")).cast("long"), "odd": 2 * F.pmod(F.xxhash64("source_no", F.lit(seed)), F.lit(2048)) + 1, "shift": F.pmod(F.xxhash64(F.lit(seed), "source_no"), F.lit(MOST_BLOCKS))})
    plan = written(plan.select("source", "source_no", F.col("words").alias("source_size"), "target", "passes", "part", "blocks", "odd", "shift"), "plan")

    placed = base.join(beside(plan), F.col("own_source").eqNullSafe(F.col("source"))).drop("own_source")
    placed = placed.withColumn("place", F.pmod(F.col("odd") * F.pmod("order_hash", "blocks") + F.col("shift"), F.col("blocks")))  # an odd multiplier permutes a power of two
    last = written(_cut(placed.where("part > 0"), "place", "part").withColumn("pieces", power_of_two(F.col("held") / BLOCK_DOCS, MOST_BLOCKS)).drop("held"), "edges")
    # The block in which the part ends, in pieces of some 64 documents; the piece in which it ends goes to one group.
    inside = placed.join(beside(last), "source_no").where(F.col("place") == F.col("edge")).withColumn("piece", F.pmod(F.shiftright("order_hash", 13), F.col("pieces")))
    cut = written(_cut(inside, "piece", "gap").select("source_no", F.col("edge").alias("last_piece"), F.col("gap").alias("last_gap")), "edges")
    piece = inside.drop("gap").join(beside(cut), "source_no").where(F.col("piece") == F.col("last_piece")).select("source_no", "row_id", "doc_id", "size", "order_hash", F.col("last_gap").alias("gap"))
    chosen = written(piece.groupBy("source_no").applyInPandas(lambda pdf: fill_gap(pdf), "row_id long").withColumn("chosen", F.lit(True)), "chosen")

    edges = plan.select("source_no", "passes", "part", "blocks").join(last.drop("gap"), "source_no", "left").join(cut.drop("last_gap"), "source_no", "left")
    part = F.when(F.col("part") > 0, F.coalesce(F.col("edge") + 1, F.col("blocks") + 1)).otherwise(0)
    quotas = written(edges.select("source_no", "edge", "pieces", "last_piece", (F.col("passes") * (F.col("blocks") + 1) + part).alias("quota"), F.pmod(F.xxhash64("source_no"), F.lit(GROUPS)).alias("grp")), "quotas")
    held = np.zeros(GROUPS, np.int64)
    for r in quotas.groupBy("grp").agg(F.sum("quota").alias("q")).collect():  # a number a group
        held[r.grp] = r.q
    per_group = spark.createDataFrame(list(enumerate(split_quotas(held, shards, [seed]).T.tolist())), "grp long, sums array<long>")
    ends = quotas.join(F.broadcast(per_group), "grp").select("grp", "source_no", "quota", "sums").groupBy("grp").applyInPandas(_split_group(shards, seed), "source_no long, ends array<long>")
    runs = written(quotas.drop("grp").join(ends, "source_no"), "runs")

    near = placed.join(beside(runs), "source_no")
    if sources <= BROADCAST_SOURCES:  # two dozen documents a source
        chosen = F.broadcast(chosen)
    drawn = near.join(chosen, "row_id", "left").withColumn("piece", F.pmod(F.shiftright("order_hash", 13), F.col("pieces")))
    head = (F.col("piece") < F.col("last_piece")) | F.coalesce("chosen", F.lit(False))
    at = F.when(F.col("edge").isNull() | (F.col("place") < F.col("edge")), F.col("place")).when((F.col("place") == F.col("edge")) & head, F.col("edge")).otherwise(F.col("place") + 1)
    drawn = drawn.withColumn("at", at)
    index = lambda i: i * (F.col("blocks") + 1) + F.col("at")
    taken = F.filter(F.sequence(F.lit(0).cast("long"), F.col("passes")), lambda i: index(i) < F.col("quota"))
    drawn = drawn.withColumn("shards", F.transform(taken, lambda i: F.size(F.filter("ends", lambda e: e <= index(i)))))
    copies = F.size("shards")
    return drawn.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), "shards", "order_hash", "row_id", *(["row"] if rows else []))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "shards")


def shuffled(docs: DataFrame, seed: int = 7, **parameters) -> DataFrame:
    """One row for each time the mix takes a document: ``row``, shard, and position (gapless from 0 in the shard, in hashed order).

    Ranks are counted within SLOTS parts of a shard, so that no task holds a whole shard.  Nulls, repeated rows and empty tables as in mix().
    """
    each = mix(docs, seed=seed, rows=True, **parameters).select("row", "order_hash", "row_id", F.posexplode("shards").alias("copy", "shard"))
    each = each.withColumn("key", F.xxhash64("order_hash", "row_id", "copy", F.lit(seed))).withColumn("part", F.pmod(F.col("key"), F.lit(SLOTS)))
    counts = each.groupBy("shard", "part").agg(F.count("*").alias("n"))  # SLOTS rows a shard at most
    starts = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("start"))
    rank = F.row_number().over(Window.partitionBy("shard", "part").orderBy("key", "row_id", "copy"))
    return each.withColumn("rank", rank).join(F.broadcast(starts), ["shard", "part"]).select("row", "shard", (F.col("start") + F.col("rank") - 1).alias("position"))


def taken_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The documents that the mix takes, a row for each time it takes them, with the columns of ``docs``, shard by shard in shuffled order.

    Null texts have no words but stay documents; rows that repeat are drawn each; an empty table gives no rows.
    """
    return shuffled(docs, **parameters).select("row.*")
