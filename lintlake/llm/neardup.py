"""MinHash near-duplicates: universal-hash minima, banding, signature verification, exact confirmation, components.

Rows with the same shingle set are one class from the start.  Class representatives that share a band
are tied to the smallest of the bucket; those that agree so well with it that all their partners must be
tied to it as well are settled, the others of a bucket are compared with each other.  Agreement here is that
of one byte of each minimum: equal minima have equal bytes, so it is never too low.  Ties make families.  A
family is cut into tiles of bounded size; in each, all pairs are compared, by signature and then on full sets, and
all with the family's smallest document, which stands in every tile.  What is linked to that document needs no
further comparison with its like; only the others of a family of several tiles are compared with all tiles.  A tile
gives back a spanning forest of its links: never the pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, encoded, table, written
from .graph import components
from .shingles import BANDS, HASHES, WORDS, shingle_sets, signatures

#: A tile has at most so many documents, or so many shingles.
TILE_DOCS, TILE_SHINGLES = 512, 400_000
#: Ties whose signatures agree less than this far below the threshold are chance.
FAMILY_SLACK = 0.4
#: Rounds of ties to the smallest, while more than a tile of a bucket is unsettled; all that is left then is compared in tiles.
ROUNDS = 4


def _signed(words: int):
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, 1 << 19):
                sets = shingle_sets(encoded(block), words)
                sig = signatures(sets)
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array([x.tobytes() for x in sig], pa.binary())]
                yield pa.RecordBatch.from_arrays([block["doc_id"], *columns], ["doc_id", "n_shingles", "set_digest", "signature"])

    return run


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lowest byte of each minimum."""
    for batch in batches:
        low = np.frombuffer(b"".join(batch["signature"].to_pylist()), np.uint32).reshape(-1, HASHES).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([x.tobytes() for x in low], pa.binary())], ["doc_id", "s"])


def _agree(least: float, settled: float):
    """Pairs of sketches that agree in at least this share of their bytes, and whether they do so in the larger share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(-1, HASHES) for c in ("sx", "sy"))
            share = (x == y).mean(axis=1)
            mask = pa.array(share >= least)
            yield pa.RecordBatch.from_arrays([batch["a"].filter(mask), batch["b"].filter(mask), pa.array(share >= settled).filter(mask)], ["a", "b", "settled"])

    return run


def kin(ids: list[int], side: np.ndarray, sketch: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Ties that join what the pairs of agreeing sketches join.  side: as in forest()."""
    root = np.arange(len(ids))
    out = []
    for i in range(len(ids) - 1):
        rest = np.flatnonzero((root[i + 1 :] != root[i]) & ((side[i + 1 :] != side[i]) | (side[i] == 2))) + i + 1
        for j in rest[(sketch[rest] == sketch[i]).mean(axis=1) >= least]:
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                out.append((ids[i], ids[j]))
    return out


def _kin(least: float):
    def ties(rows: list[tuple]) -> pa.RecordBatch:
        sketch = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(-1, HASHES)
        found = kin([r[3] for r in rows], _sides(rows), sketch, least)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return _by_tile(("bucket", "i", "j", "doc_id", "s", "tile"), ties)


def forest(ids: list[int], side: np.ndarray, sets: list[np.ndarray], percent: int, slack: float) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that join what the links between the sets join, and a label of each set's component.  side: 0 and 1 are compared across only, 2 with all."""
    n = len(ids)
    sig, size = signatures(sets), np.array([len(s) for s in sets], np.int64)
    root = np.unique(ids, return_inverse=True)[1]  # a document that stands on both sides is one
    out = []
    for i in range(n - 1):
        rest = np.arange(i + 1, n)
        rest = rest[(root[rest] != root[i]) & ((side[rest] != side[i]) | (side[i] == 2))]
        small, large = np.minimum(size[rest], size[i]), np.maximum(size[rest], size[i])
        rest = rest[100 * small >= percent * large]
        rest = rest[(sig[rest] == sig[i]).mean(axis=1) >= slack] if len(rest) else rest
        if not len(rest):
            continue
        flat = np.concatenate([sets[j] for j in rest])
        at = np.searchsorted(sets[i], flat).clip(max=len(sets[i]) - 1)
        first = np.cumsum(size[rest]) - size[rest]
        common = np.add.reduceat((sets[i][at] == flat).astype(np.int64), first)
        for j in rest[100 * common >= percent * (size[rest] + size[i] - common)]:
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                out.append((ids[i], ids[j]))
    return out, root


def _sides(rows: list[tuple]) -> np.ndarray:
    return np.array([2 if r[1] == r[2] else int(r[5] == r[2]) for r in rows])


def _by_tile(columns: tuple[str, ...], links):
    """links() of the rows of each tile; the first three columns name the tile, and its rows come one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in columns), strict=True):
                if held and held[-1][:3] != row[:3]:
                    yield links(held)
                    held = []
                held.append(row)
        if held:
            yield links(held)

    return run


def _tiles(words: int, percent: int, slack: float):
    """Links (a, b) of each cell; of a tile by itself also (a, null) for what its links do not join to the family's smallest document.

    Tiles have but that document in common, so within them is where such a join would be.
    """

    def links(rows: list[tuple]) -> pa.RecordBatch:
        sets = shingle_sets([(r[4] or "").encode() for r in rows], words)
        ids = [r[3] for r in rows]
        found, label = forest(ids, _sides(rows), sets, percent, slack)
        if rows[0][1] == rows[0][2]:
            mine = label[ids.index(rows[0][0])]
            found += [(i, None) for i in sorted({i for i, x in zip(ids, label, strict=True) if x != mine})]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return _by_tile(("family", "i", "j", "doc_id", "text", "tile"), links)


def _tiled(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """family, doc_id, tile, tiles: the tile goes by a hash of the document."""
    placed = members.join(sizes, "family").withColumn("tile", F.pmod(F.xxhash64("doc_id"), F.col("tiles")).cast("int"))
    return placed.select("family", "doc_id", "tile", "tiles").dropDuplicates(["doc_id"])


def _tiles_of(members: DataFrame) -> DataFrame:
    return members.groupBy("family").agg(F.ceil(F.greatest(F.count("*") / TILE_DOCS, F.sum("n_shingles") / TILE_SHINGLES)).cast("int").alias("tiles"))


def _paired(tiled: DataFrame, *columns: str) -> DataFrame:
    """Each row once for each pair (i, j) of tiles that its tile is in."""
    other = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return other.select(*columns, F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile")


def _links(docs: DataFrame, cells: DataFrame, run) -> DataFrame:
    """(a, b) of the cells (family, i, j) that documents (doc_id, places: array of i, j, tile) stand in.

    Hashed on the side without texts at every size: texts move once, and are neither sorted nor part of a hash table.
    """
    with_text = docs.select("doc_id", "text").join(cells.hint("shuffle_hash"), "doc_id")
    each = with_text.select("family", "doc_id", "text", F.explode("places").alias("p")).select("family", "doc_id", "text", "p.*")
    return each.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "doc_id").mapInArrow(run, "a long, b long")


def _tied(keyed: DataFrame, sides: DataFrame, slack: float) -> DataFrame:
    """(a, b): ties that join all documents of a bucket whose sketches agree in ``slack`` of their bytes.

    Sketches keep the triangle inequality: if x agrees with the smallest in ``least`` + 1 - ``slack``, all that agree
    with x in ``slack`` agree with the smallest in ``least`` and are tied to it, so x need not be compared again.
    """
    least = min(slack, FAMILY_SLACK)
    found = None
    for _ in range(ROUNDS):
        buckets = keyed.groupBy("bucket").agg(F.min("doc_id").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
        ties = written(keyed.join(buckets, "bucket").where("doc_id != b").select("bucket", F.col("doc_id").alias("a"), "b"), "ties")
        sx, sy = (sides.select(F.col("doc_id").alias(k), F.col("s").alias(f"s{v}")) for k, v in (("a", "x"), ("b", "y")))
        judged = written(ties.select("a", "b").distinct().join(sx, "a").join(sy, "b").select("a", "b", "sx", "sy").mapInArrow(_agree(least, least + 1 - slack), "a long, b long, settled boolean"), "judged")
        agreed = judged.select("a", "b")
        found = found.union(agreed) if found else agreed
        keyed = written(ties.join(judged.where("settled").select("a", "b"), ["a", "b"], "left_anti").select("bucket", F.col("a").alias("doc_id")).distinct(), "unsettled")
        sizes = keyed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
        if (sizes.agg(F.max("n")).first()[0] or 0) <= TILE_DOCS:
            break
    sizes = sizes.select("bucket", F.ceil(F.col("n") / TILE_DOCS).cast("int").alias("tiles"))
    tiled = keyed.join(sizes, "bucket").withColumn("tile", F.pmod(F.xxhash64("doc_id"), F.col("tiles")).cast("int"))
    pairs = _paired(tiled.join(sides, "doc_id"), "bucket", "doc_id", "s")
    return found.union(pairs.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "doc_id").mapInArrow(_kin(slack), "a long, b long"))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * shared shingles >= percent * all their shingles.  Texts without words
    (null, empty, blank) have no shingles and no links.  Rows that repeat a doc_id stand for one
    document of all their links.  A null doc_id has no links and is kept.  Ties do not arise: the
    smallest doc_id of a component is kept.  Empty tables give no rows; other columns are ignored.
    With 32 bands of 4 minima a pair at similarity 0.8 shares a band but for 5 in 100 million.  Pairs whose signatures
    agree far less than they should are not compared further: at similarity 0.8 that is 1 pair in 50,000 among those
    that only the tiles of one bucket tie (4.5 standard deviations), and 1 in 1,000 million in a family's tiles (6).
    A doc_id with several texts is tied by the bands of all of them, and judged by the signature of one.
    """
    threshold = percent / 100
    deviation = (threshold * (1 - threshold) / HASHES) ** 0.5
    slack, surely = threshold - 4.5 * deviation, threshold - 6 * deviation
    signed = written(docs.select("doc_id", "text").mapInArrow(_signed(words), "doc_id long, n_shingles long, set_digest binary, signature binary"), "signatures")
    # A written table on one side and a plain scan on the other: an exchange that holds one large class can be split.
    classes = written(signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).groupBy("set_digest").agg(F.min("doc_id").alias("rep")), "classes")
    classed = signed.join(classes, "set_digest", "left").withColumn("rep", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("rep")))
    known = written(classed.select("doc_id", "n_shingles", "rep", F.when(F.col("doc_id") == F.col("rep"), F.col("signature")).alias("signature")), "known")
    reps = written(known.where("signature IS NOT NULL").dropDuplicates(["doc_id", "signature"]).select("doc_id", "n_shingles", "signature"), "reps")
    band = 4 * HASHES // BANDS
    keyed = reps.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.substring("signature", k * band + 1, F.lit(band)))).alias("band", "minima"))
    keyed = keyed.select("doc_id", F.xxhash64("band", "minima").alias("bucket"))
    sides = written(reps.select("doc_id", "signature").mapInArrow(_sketches, "doc_id long, s binary").groupBy("doc_id").agg(F.first("s").alias("s")), "sides")
    family = components(_tied(keyed, sides, slack)).withColumnRenamed("node", "doc_id").withColumnRenamed("component", "family")
    members = written(reps.select("doc_id", "n_shingles").join(family, "doc_id"), "families")
    tiled = written(_tiled(members, _tiles_of(members)), "tiled")
    run = _tiles(words, percent, surely)
    place = lambda i, j, tile: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), tile.cast("int").alias("tile"))
    # A tile by itself is the cell (i, i); the family's smallest document stands in each of them.
    all_tiles = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda i: place(i, i, i))
    first = tiled.select("family", "doc_id", F.when(F.col("doc_id") == F.col("family"), all_tiles).otherwise(F.array(place(F.col("tile"), F.col("tile"), F.col("tile")))).alias("places"))
    near = written(_links(docs, first, run), "near")
    # Of families of several tiles, what is not linked to the smallest is compared with all tiles: cells (i, -1 - j), tile i of the rest against tile j of all.
    several = tiled.where("tiles > 1")
    rest = near.where("b IS NULL").select(F.col("a").alias("doc_id")).join(several.select("family", "doc_id"), "doc_id")
    rest = written(rest.join(members.select("doc_id", "n_shingles").dropDuplicates(["doc_id"]), "doc_id"), "rest")
    counts = _tiles_of(rest).withColumnRenamed("tiles", "rests")
    of_rest = _tiled(rest, counts.withColumnRenamed("rests", "tiles")).join(several.groupBy("family").agg(F.first("tiles").alias("all")), "family")
    of_rest = of_rest.select("doc_id", F.transform(F.sequence(F.lit(0), F.col("all") - 1), lambda j: place(F.col("tile"), -1 - j, F.col("tile"))).alias("mine"))
    of_all = several.join(counts, "family").withColumn("theirs", F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda i: place(i, -1 - F.col("tile"), -1 - F.col("tile"))))
    cells = of_all.join(of_rest, "doc_id", "left").select("family", "doc_id", F.concat("theirs", F.coalesce("mine", F.array().cast("array<struct<i: int, j: int, tile: int>>"))).alias("places"))
    links = near.union(_links(docs, cells, run))
    # Only representatives are in the graph: a document goes where its class goes.  A doc_id with several classes links them.
    twice = known.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("rep").alias("own"), F.max("rep").alias("last"), (F.count("rep") < F.count("*")).alias("gap")).where("own < last OR gap AND own IS NOT NULL").select("doc_id", "own")
    same = known.join(twice, "doc_id").where("rep != own").select(F.col("rep").alias("a"), F.col("own").alias("b"))
    found = components(links.union(same))
    placed = known.join(twice, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("own", "rep").alias("own"))
    out = placed.join(found, placed.own == found.node, "left").select("doc_id", "n_shingles", F.coalesce("component", "own", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def without_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near-duplicates, with its columns.

    Rows that repeat a kept doc_id all stay, and so do rows without a doc_id and texts without words (null, empty,
    blank); of a group the smallest doc_id stays.  An empty table gives no rows.
    """
    kept = near_duplicates(docs, words, percent).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")
