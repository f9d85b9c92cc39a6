"""Every operator as a Spark job: brute force on the awkward cases, empty tables, clashing names, held-out accuracy."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lintlake.llm import chat, graph, lines, media, mixing, neardup, packing, repeats, rules, sharding, shingles, toxicity

from .cases import docs, labels, texts, words
from .test_pieces import plain_repeated, plain_shingles

SMALL = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def plain_components(items, linked):
    """items: [(id, value)], linked(a, b) -> bool; smallest id reachable by id."""
    ids = {i for i, _ in items if i is not None}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(items):
        for j, b in items[:k]:
            if i is not None and j is not None and linked(a, b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_quality_rules(spark):
    table = docs(spark)
    got = rules.quality_rules(table, labels(spark)).collect()
    want = Counter()
    for i, t, _ in texts():
        n, again = len(words(t)), plain_repeated(t)
        want[(i, n, again, n < 20 or 100 * again > 30 * n)] += 1
    assert Counter((r.doc_id, r.n_words, r.n_repeat_words, r.base_failed) for r in got) == want
    assert all(r.kept == (not r.base_failed) for r in got)  # without labels the trees keep all
    assert rules.quality_rules(docs(spark, []), labels(spark)).count() == 0


def test_quality_rules_learn(spark):
    d, l = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    got = rules.quality_rules(d, l).join(l, "doc_id").where("not base_failed").select("kept", "quality").toPandas()
    assert (got.kept == (got.quality == 1)).mean() > 0.95


@pytest.mark.parametrize("shards", [3, 40])
def test_sharding(spark, shards):
    got = sharding.shard_by_bytes(docs(spark), shards).collect()
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in texts())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and max(by) < shards
    assert sharding.shard_by_bytes(docs(spark, []), shards).count() == 0


def test_sharding_is_even_and_moves_little(spark):
    rng = np.random.default_rng(0)
    sums = rng.integers(1000, 9000, 4096).tolist()
    first = sharding.first_map(40)
    after = sharding.rebalanced(first, sums, 40)
    load = np.bincount(after, weights=sums)
    assert np.ptp(load) < 100 and np.mean(np.array(first) != np.array(after)) < 0.1
    again = sharding.rebalanced(after, sums, 40)
    assert again == after or np.ptp(np.bincount(again, weights=sums)) <= np.ptp(load)
    grown = sharding.rebalanced(after, sums, 41)
    assert all(g == a or g == 40 or np.ptp(np.bincount(grown, weights=sums)) < 400 for g, a in zip(grown, after, strict=True))


def test_slot_map_versions(spark):
    maps = sharding.SlotMap(spark)
    maps.write(1, [0, 0, 1])
    maps.write(2, [0, 1, 1])
    assert rows(maps.read(1)) == [(0, 0), (1, 0), (2, 1)] and rows(maps.read(2)) == [(0, 0), (1, 1), (2, 1)]


def test_sharding_edits_the_latest_map(spark):
    maps = sharding.SlotMap(spark)
    assert maps.latest() == 0
    table = docs(spark, [(i, "x" * (i % 900), "a") for i in range(4000)])
    first = {r.virtual_slot: (r.shard, r.map_version) for r in sharding.shard_by_bytes(table, 4, 64, maps).collect()}
    latest = maps.latest()
    assert latest == 2 and {v for _, v in first.values()} == {2}
    grown = sharding.shard_by_bytes(table, 5, 64, maps).collect()
    assert maps.latest() == 3 and {r.map_version for r in grown} == {3} and {r.shard for r in grown} == set(range(5))
    moved = {r.virtual_slot for r in grown if first[r.virtual_slot][0] != r.shard}
    assert len(moved) < 32
    again = sharding.shard_by_bytes(table, 5, 64, maps).collect()
    assert rows(spark.createDataFrame(again)) == rows(spark.createDataFrame(grown)) and maps.latest() == 3


@pytest.mark.parametrize("stored", [32, 64, 128])
def test_sharding_takes_the_slots_of_the_stored_map(spark, stored):
    maps = sharding.SlotMap(spark)
    maps.write(1, sharding.first_map(4, stored))
    table = docs(spark, [(i, "x" * (i % 90), "a") for i in range(1000)])
    got = sharding.shard_by_bytes(table, 5, 64, maps).collect()
    assert sorted(r.doc_id for r in got) == list(range(1000)) and {r.virtual_slot for r in got} <= set(range(stored))
    assert {r.shard for r in got} == set(range(5)) and len(maps.shards(maps.latest())) == stored


def test_sharding_refuses_a_map_with_a_gap(spark):
    maps = sharding.SlotMap(spark)
    spark.createDataFrame([(1, 0, 0), (1, 2, 1)], "version int, virtual_slot int, shard int").write.parquet(f"{maps.folder}/version=1")
    with pytest.raises(ValueError, match="every slot"):
        sharding.shard_by_bytes(docs(spark), 2, 64, maps)


def test_sharding_places_as_by_a_loop(spark):
    """Slots, placement and places from the hash and the stored map alone."""
    import struct

    import xxhash

    items = [x for x in texts() if x[0] is not None]
    maps = sharding.SlotMap(spark)
    got = sharding.shard_by_bytes(docs(spark, items), 3, 16, maps).collect()
    where, by = maps.shards(maps.latest()), defaultdict(list)
    for i, t, _ in items:
        h = xxhash.xxh64_intdigest(struct.pack("<q", i), seed=42)
        h = h if t is None else xxhash.xxh64_intdigest(t.encode(), seed=h)
        by[h % 16].append((i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 16))  # 16 divides 2**64, so the sign is no matter
    want, filled = [], Counter()
    for slot in range(16):
        for i, crc, size in sorted(by[slot]):
            want.append((i, size, crc, slot, where[slot], filled[where[slot]]))
            filled[where[slot]] += 1
    assert sorted((r.doc_id, r.size, r.text_crc32, r.virtual_slot, r.shard, r.slot) for r in got) == sorted(want)
    loads = [sum(w[1] for w in want if w[4] == s) for s in range(3)]
    before = sharding.first_map(3, 16)
    assert where == sharding.rebalanced(before, [sum(x[2] for x in by[s]) for s in range(16)], 3) and sum(loads) == sum(w[1] for w in want)


def test_sharding_spreads_rows_without_an_id(spark):
    got = sharding.shard_by_bytes(docs(spark, [(None, "same", "a")] * 900 + [(5, f"t{i}", "a") for i in range(900)]), 8).collect()
    assert np.ptp(list(Counter(r.shard for r in got).values())) < 20 and len({r.virtual_slot for r in got}) > 400


def plain_targets(sizes, weights, total, most):
    """Where all sources take what the level times their weight gives them, and ``most`` times their size at most: the level by bisection."""
    goal = min(total, most) * sum(sizes)
    lo, hi = 0.0, most * sum(sizes) + 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(most * s, mid * w) for s, w in zip(sizes, weights, strict=True)) < goal else (lo, mid)
    return [min(most * s, hi * w) for s, w in zip(sizes, weights, strict=True)]


def test_water_filled(spark):
    rng = np.random.default_rng(8)
    for sizes in ([100, 1000, 10], [0, 0], [5], [], rng.integers(0, 4000, 60).tolist()):
        names = [f"s{i:03d}" for i in range(len(sizes))]
        names[-1:] = [None] if names else []
        got = mixing.water_filled(spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, words long"), 1.5, 2.0, (5, 2, 1)).collect()
        got.sort(key=lambda r: r.source_no)
        assert [r.source for r in got] == names
        assert np.allclose([r.target for r in got], plain_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))], 1.5, 2.0))


def test_mixing(spark):
    table = docs(spark)
    got = mixing.mix(table).collect()
    sizes, per = Counter(), Counter()
    for _, t, s in texts():
        sizes[s] += len(words(t))
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((i, s, len(words(t))) for i, t, s in texts())
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    target = dict(zip(names, plain_targets([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5, 2.0), strict=True))
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert r.taken == r.copies * r.size <= 2 * r.size and len(r.shards) == r.copies
        per[r.source] += r.taken
    for s in names:
        assert abs(per[s] - target[s]) <= max([len(words(t)) for _, t, x in texts() if x == s]) / 2 + 1
    assert rows(mixing.mix(table).select("doc_id", "copies")) == rows(mixing.mix(docs(spark)).select("doc_id", "copies"))
    assert mixing.mix(docs(spark, [])).count() == 0
    taken = mixing.taken_documents(table)
    assert taken.columns == table.columns
    assert Counter(r.doc_id for r in taken.collect()) == Counter(i for r in got for i in [r.doc_id] * r.copies)


def test_mixing_shards_and_positions(spark):
    table = docs(spark)
    got = mixing.mix(table, shards=4).collect()
    placed = mixing.shuffled(table, shards=4).select("row.doc_id", "row.text", "shard", "position").collect()
    assert Counter((r.doc_id, s) for r in got for s in r.shards) == Counter((r.doc_id, r.shard) for r in placed)
    by = defaultdict(list)
    for r in placed:
        by[r.shard].append(r.position)
    assert all(sorted(p) == list(range(len(p))) for p in by.values())
    assert mixing.shuffled(docs(spark, [])).count() == 0 and mixing.taken_documents(docs(spark, [])).count() == 0


def test_mixing_is_the_same_with_many_sources(spark, monkeypatch):
    table = docs(spark, [(i, "w " * (i % 7), f"s{i % 400}") for i in range(3000)])
    want = rows(mixing.mix(table).select("doc_id", "taken", "shards"))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 3)
    assert rows(mixing.mix(table).select("doc_id", "taken", "shards")) == want


def test_mixing_of_a_hot_source_and_null_ids(spark):
    items = [(None if i % 3 == 0 else i, f"a b {i} " * (1 + i % 5), "big" if i % 4 else f"s{i % 11}") for i in range(9000)]
    got = mixing.mix(docs(spark, items)).toPandas()
    per = got.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((per.taken - per.target).abs() <= 2).all() and len(got) == 9000


def test_nearest_subset():
    rng = np.random.default_rng(5)
    for _ in range(50):
        sizes, wanted = rng.integers(0, 30, 8).tolist(), int(rng.integers(0, 150))
        best = min(abs(wanted - sum(s for i, s in enumerate(sizes) if m >> i & 1)) for m in range(256))
        assert abs(wanted - sum(sizes[i] for i in set(mixing.nearest_subset(sizes, wanted)))) == best


def test_mixing_comes_near_on_whole_tables(spark):
    got = mixing.op7_mixing(spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "source"), "doc_id").toPandas()
    per = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((per.taken - per.target).abs() <= 0.03 * per.target).all()


def test_packing(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path("byte_bpe_50k.json"))
    got = packing.pack(docs(spark)).collect()
    want = Counter()
    for i, t, _ in texts():
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = packing.cut_points(len(ids), 2048)
        want.update((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert Counter(tuple(r)[:5] for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048
    total = sum(r.length for r in got)
    assert len(by) <= -(-total // 2048) + 1
    assert packing.pack(docs(spark, [])).count() == 0


def test_near_duplicates(spark):
    items = [(i, t) for i, t, _ in texts()]
    for k in (2, 5):
        sets = [(i, plain_shingles(t, k)) for i, t in items]
        by_id = plain_components(sets, lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b))
        got = neardup.near_duplicates(docs(spark), k).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter((i, len(s), by_id.get(i)) for i, s in sets)
        assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    assert neardup.without_near_duplicates(docs(spark, [])).count() == 0
    kept = neardup.without_near_duplicates(docs(spark))
    assert kept.columns == docs(spark).columns
    assert neardup.near_duplicates(docs(spark, [])).count() == 0


def test_near_duplicates_in_many_tiles(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = [f"v{k}" for k in range(80)]
    items = []
    for i in range(120):
        own = list(base)
        for at in rng.integers(0, 80, int(rng.integers(0, 9))):
            own[at] = f"z{rng.integers(0, 40)}"
        items.append((i, " ".join(own), "a"))
    monkeypatch.setattr(neardup, "TILE_DOCS", 25)
    sets = [(i, plain_shingles(t, 2)) for i, t, _ in items]
    want = plain_components(sets, lambda a, b: 100 * len(a & b) >= 80 * len(a | b))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(spark, items)).collect()}
    assert got == want and len(set(want.values())) > 1


def test_near_duplicates_behind_chance_ties(spark, monkeypatch):
    x = [f"u{k}" for k in range(100)]
    y = x[:92] + [f"y{k}" for k in range(8)]
    # In every band that x and y may share there is a smaller doc_id: the words with x's minima of this band, and no others.
    a, b = shingles.universal()
    h = np.array([shingles.shingle_sets([w.encode()], 1)[0][0] for w in x])
    least = [x[int(np.argmin(h * a[k] + b[k]))] for k in range(shingles.HASHES)]
    items = [(k, " ".join(least[4 * k : 4 * k + 4]), "a") for k in range(shingles.BANDS)] + [(900, " ".join(x), "a"), (901, " ".join(y), "a")]
    # More than a tile in one bucket, none of them near another or near the smallest.
    items += [(1000 + k, " ".join(least[:4] + [f"q{k}n{i}" for i in range(12)]), "a") for k in range(60)]
    sets = [(i, plain_shingles(t, 1)) for i, t, _ in items]
    want = plain_components(sets, lambda p, q: 100 * len(p & q) >= 80 * len(p | q))
    assert want[901] == 900
    for most, rounds in ((512, 4), (3, 2)):
        monkeypatch.setattr(neardup, "TILE_DOCS", most)
        monkeypatch.setattr(neardup, "ROUNDS", rounds, raising=False)
        assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(spark, items), 1).collect()} == want


def test_near_duplicates_of_passages(spark):
    rng = np.random.default_rng(6)
    passages = [" ".join(f"p{k}w{i}" for i in range(9)) for k in range(24)]
    items = [(i, " ".join(passages[k] for k in rng.permutation(24)[:10]), "a") for i in range(700)]
    items += [(i, " ".join([*t.split()[:86], "tail", str(i)]), s) for i, (_, t, s) in zip(range(900, 960), items[640:], strict=True)]
    sets = [(i, plain_shingles(t, 1)) for i, t, _ in items]
    want = plain_components(sets, lambda p, q: 100 * len(p & q) >= 80 * len(p | q))
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(spark, items), 1).collect()} == want


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_lose_no_link_of_a_whole_table(spark, k):
    """All pairs of the table by an index from shingles to documents."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {r.doc_id: plain_shingles(r.text, k) for r in d.collect()}
    held = defaultdict(list)
    for i, own in sets.items():
        for x in own:
            held[x].append(i)
    common = Counter()
    for own in held.values():
        common.update((a, b) for n, b in enumerate(own) for a in own[:n])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [(a, b) for (a, b), n in common.items() if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)]
    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(d, k).collect()}
    assert len(links) > 100 and got == {i: find(i) for i in sets}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7), (None, 3), (100, 102)]
    got = dict(rows(graph.components(spark.createDataFrame(edges, "a long, b long"))))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_removed(items):
    held = [(i, (t or "").encode()) for i, t in items]
    first = {}
    for i, b in held:
        if i is not None:
            for j in range(len(b) - 49):
                first[b[j : j + 50]] = min(i, first.get(b[j : j + 50], i))
    for i, b in held:
        gone = [False] * len(b)
        for j in range(len(b) - 49):
            if i is not None and first[b[j : j + 50]] < i:
                gone[j : j + 50] = [True] * 50
        yield i, len(b), sum(gone), sum(g and not p for g, p in zip(gone, [False, *gone], strict=False)), hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()


def repeat_cases():
    rng = np.random.default_rng(4)
    passage = "".join(chr(97 + x) for x in rng.integers(0, 20, 140))
    items = [(i, t, s) for i, t, s in texts() if i != 7]
    for i in range(30, 60):
        a, b = sorted(rng.integers(0, 140, 2).tolist())
        items.append((i, "".join(chr(97 + x) for x in rng.integers(0, 20, 60)) + passage[a:b] + "é" * int(rng.integers(0, 30)) + "x" * int(rng.integers(0, 120)), "a"))
    return items


@pytest.mark.parametrize("hot", [2000, 3])
def test_repeats(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    items = repeat_cases()
    got = repeats.repeated_spans(docs(spark, items))
    assert Counter(map(tuple, got.collect())) == Counter(plain_removed([x[:2] for x in items]))
    assert repeats.repeated_spans(docs(spark, [])).count() == 0


def test_without_repeats(spark):
    items = repeat_cases()
    got = repeats.without_repeats(docs(spark, items))
    assert got.columns == docs(spark, []).columns
    assert all(r.n_chars == len(r.text or "") and r.chunk == "c" for r in got.collect())
    assert repeats.without_repeats(docs(spark, [])).count() == 0
    left = Counter(i for i, n, gone, _, _ in plain_removed([x[:2] for x in items]) if n == 0 or gone < n)
    assert Counter(r.doc_id for r in got.collect()) == left


def test_toxicity(spark):
    got = toxicity.toxicity(docs(spark), labels(spark)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in texts())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert toxicity.toxicity(docs(spark, []), labels(spark)).count() == 0


def test_toxicity_learns(spark):
    rng = np.random.default_rng(0)
    made, marks = [], []
    for i in range(400):
        w = [f"{rng.choice(['ha', 'lo', 'mi', 'ta'])}{rng.choice(['ren', 'sot', 'ka'])}" for _ in range(int(rng.integers(5, 120)))]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                w.insert(int(rng.integers(0, len(w))), str(rng.choice(["vilex", "vilest", "grobba"])))
        made.append((i, " ".join(w), "a"))
        marks.append((i, 1, int(bad), "", ""))
    got = toxicity.toxicity(docs(spark, made), labels(spark, marks)).where("held_out").toPandas()
    assert ((got.doc_id % 4 == 0) == (got.predicted == 1)).mean() > 0.95
    table = docs(spark, made[:30])
    kept = toxicity.without_toxic(table, labels(spark, marks))
    assert kept.columns == table.columns and kept.count() < 30
    assert toxicity.without_toxic(docs(spark, []), labels(spark)).count() == 0


def test_line_quality(spark):
    got = lines.line_quality(docs(spark), labels(spark)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in texts())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert lines.line_quality(docs(spark, []), labels(spark)).count() == 0


def test_line_quality_learns(spark):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = lines.line_quality(d, l).where("held_out").join(l, "doc_id").toPandas()
    assert ((got.predicted == 1) == (got.quality == 1)).mean() > 0.95


@pytest.mark.parametrize("module, residue", [(toxicity, (3, 1)), (lines, (5, 0))])
def test_label_share_leaves_out_held_out_rows(spark, monkeypatch, module, residue):
    aside = {i: zlib.crc32(str(i).encode()) % residue[0] == residue[1] for i in range(1, 60)}
    held = [(i, int(out or i % 4 == 0), int(out or i % 4 == 0), None, None) for i, out in aside.items()]
    monkeypatch.setattr(module, "train", lambda sample, share: share)
    kept = [q for i, q, *_ in held if not aside[i]]
    assert any(aside.values()) and module.fitted(docs(spark), labels(spark, held)) == pytest.approx(sum(kept) / len(kept))


def test_chat(spark):
    said = [(1, 0, "system", "be </s>"), (1, 1, "user", "a\\b"), (1, 2, "assistant", "[INST]"), (1, 2, "assistant", "[INST]"), (1, None, "user", None), (2, 5, "assistant", ""), (3, 1, "user", "no reply"), (None, 1, None, "x"), (None, 2, "assistant", "y"), (None, 1, None, "x"), (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = chat.digests(chat.examples(spark.createDataFrame([(*r, "t") for r in said], "conv_id long, turn long, role string, text string, example string")))
    by = defaultdict(list)
    for k, (c, n, r, t) in enumerate(said):
        by[(c, k if c is None else 0)].append((n is not None, n or 0, r or "", t or ""))
    want = []
    for (c, _), turns in by.items():
        turns.sort()
        spoken = "".join(t for _, _, r, t in turns if r == "assistant")
        want.append((c, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns).encode()).hexdigest(), len(spoken), hashlib.sha256(spoken.encode()).hexdigest()))
    assert Counter(tuple(r)[:5] for r in got.collect()) == Counter(want)
    assert chat.digests(chat.examples(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_media(spark):
    got = media.media_features(docs(spark)).collect()
    want = Counter()
    for i, t, _ in texts():
        p = media.padded((t or "").encode())
        want[(i, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    equal = defaultdict(set)
    for r in got:
        equal[r.payload_sha256].add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in equal.values())
    assert media.media_features(docs(spark, [])).count() == 0
    kept = media.media_column(docs(spark))
    info = media.picture_info(kept).collect()
    assert len(info) == len(texts()) and all(r.width == 1536 and re.fullmatch("[0-9a-f]{32}", r.thumbnail_hash) for r in info)
    assert media.media_column(docs(spark, [])).count() == 0 and media.picture_info(media.media_column(docs(spark, []))).count() == 0
    broken = spark.createDataFrame([(1, b"not a picture"), (2, None)], "doc_id long, media binary")
    assert all(r.width is None for r in media.picture_info(broken).collect())


def test_pipeline_stages_keep_the_columns(spark):
    import corpus_pipeline

    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, d, SMALL), f"test-{name}")
        assert dict(out.dtypes) == dict(d.dtypes) and 0 < out.count()
        d = out
    packed = corpus_pipeline.STAGES[-1][1](spark, d, SMALL)
    assert packed.where("piece = 0").count() == d.count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_toxicity_recall_on_held_out_rows(spark):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(d, l).where("held_out").join(l, "doc_id").toPandas()
    found = got[got.predicted == 1].toxic
    assert found.sum() >= 0.8 * got.toxic.sum() and found.mean() >= 0.95


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    docs(spark, []).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark).select("doc_id", "quality", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_without_labels(spark, tmp_path):
    import corpus_pipeline

    docs(spark).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark).select("doc_id", "quality", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).where("offset < 0").count() == 0
