"""The numpy parts against plain Python."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lintlake.llm import boosting, chat, jpeg, lines, media, mixing, packing, repeats, rules, shingles, suffix, toxicity
from lintlake.llm.common import best_cut

from .cases import LONG, texts, words

ALL = [(t or "").encode() for _, t, _ in texts()]


def plain_repeated(text):
    w = words(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = set()
    for i in range(len(w) - 7):
        if windows[tuple(w[i : i + 8])] > 1:
            hit |= set(range(i, i + 8))
    return len(hit)


@pytest.mark.parametrize("text", [t for _, t, _ in texts()])
def test_statistics(text):
    got = rules.statistics((text or "").encode())[0]
    w = words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    assert got == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, plain_repeated(text))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=60))
def test_repeated_words(w):
    assert rules.repeated([x.encode() for x in w]) == plain_repeated(" ".join(w))


def test_trees_keep_monotone_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = ((x[:, 0] + 0.3 * np.sin(5 * x[:, 0]) - x[:, 1] + rng.normal(size=600)) > 0).astype(float)
    trees = boosting.fit(x, y, np.array([1, -1, 0]), trees=20)
    assert ((trees.probability(x) > 0.5) == y).mean() > 0.75
    for feature, sign in ((0, 1), (1, -1)):
        grid = np.repeat(x[:50], 40, axis=0).reshape(50, 40, 3)
        grid[:, :, feature] = np.linspace(-3, 3, 40)
        logit = trees.logit(grid.reshape(-1, 3)).reshape(50, 40)
        assert (sign * np.diff(logit, axis=1) >= -1e-9).all()


def test_flat_trees_against_a_walk():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 4))
    t = boosting.fit(x, (x[:, 0] * x[:, 1] > 0).astype(float), np.array([0, 0, 1, -1]), trees=12)

    def walk(row, node):
        while t.left[node] != node:
            node = t.left[node] if row[t.feature[node]] <= t.threshold[node] else t.right[node]
        return t.value[node]

    assert np.allclose(t.logit(x), [t.base + sum(walk(row, r) for r in t.roots) for row in x])


def test_first_split_is_the_best_of_all():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 20, (120, 3)).astype(float)
    y = ((x[:, 1] > 11) ^ (rng.random(120) < 0.1)).astype(float)
    t = boosting.fit(x, y, np.zeros(3), trees=1, depth=1)
    p = y.mean()
    best = (-np.inf, 0, 0.0)
    for f in range(3):
        for cut in np.unique(x[:, f])[:-1]:
            goes = x[:, f] <= cut
            if 5 <= goes.sum() <= len(y) - 5:
                gain = sum((y[s] - p).sum() ** 2 / (s.sum() * p * (1 - p) + 1) for s in (goes, ~goes))
                best = max(best, (gain, f, cut))
    root = t.roots[0]
    chosen = x[:, t.feature[root]] <= t.threshold[root]
    assert t.feature[root] == best[1] and (chosen == (x[:, best[1]] <= best[2])).all()


def test_trees_without_both_labels_are_constant():
    assert not len(boosting.fit(np.zeros((0, 3)), np.zeros(0), np.zeros(3)).roots)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=12, max_size=12))
def test_plan_packs_all_and_reduction_loses_nothing(counts):
    capacity = 12
    count = np.array([0, *counts])
    where = packing.plan(count, capacity)
    length = np.repeat(np.arange(capacity + 1), count)
    rank = np.concatenate([np.arange(c) for c in count])
    sequence, offset = packing.locate(where, length, rank)
    placed = sorted(zip(sequence.tolist(), offset.tolist(), length.tolist(), strict=True))
    for (s, o, n), (s2, o2, _) in zip(placed, placed[1:], strict=False):
        assert o2 == (o + n if s2 == s else 0)
    assert all(o + n <= capacity for _, o, n in placed)
    assert len(set(sequence.tolist())) == int(where["sequences"]) if len(length) else True


def least_bins(sizes, capacity):
    """By trying everything."""
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity and bins[k] not in bins[:k]:
                go(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1 :]])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best[0]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 10), max_size=9))
def test_dominance_is_optimal(sizes):
    capacity = 10
    count = np.bincount(sizes, minlength=capacity + 1) if sizes else np.zeros(capacity + 1, int)
    left = count.copy()
    fixed = packing.reduce_by_dominance(left, capacity)
    rest = np.repeat(np.arange(capacity + 1), left).tolist()
    assert sum(t for t, _ in fixed) + least_bins(sorted(rest, reverse=True), capacity) == least_bins(sorted(sizes, reverse=True), capacity)


def test_encoder_gives_the_tokenizers_ids():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    plain, encode = Tokenizer.from_file(path("byte_bpe_50k.json")), packing.Encoder("byte_bpe_50k")
    for _, text, _ in texts():
        assert encode(text or "").tolist() == plain.encode(text or "", add_special_tokens=False).ids


def test_encoder_gives_the_tokenizers_ids_for_every_code_point():
    """All code points beside letters, digits, spaces, quotes and each other, runs of white space and of marks, broken contractions."""
    from public_tokenizers import path
    from tokenizers import Tokenizer

    plain, encode = Tokenizer.from_file(path("byte_bpe_50k.json")), packing.Encoder("byte_bpe_50k")
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    made = []
    for at in range(0, len(points), 128):
        own = [chr(c) for c in points[at : at + 128]]
        made.append("".join(own) + " " + "".join(f"a{c}1 {c}{c}  {c}'s{c}" for c in own[:: 1 if at < 0x3400 else 16]))
    spaces = [chr(c) for c in points if chr(c).isspace() or c in (0x180E, 0x200B, 0x2060, 0xFEFF)]
    rng = np.random.default_rng(3)
    parts = [*spaces, "\u0301", "\u20e3", "x", "9", "\u0660", "'", "'ll", "'RE", "\u00aa", "\u2160", "!", "\U0001f468\u200d\U0001f469", "\U000e0100", "\ufffe"]
    made += ["".join(rng.choice(parts, 60)) for _ in range(2000)] + [s * n for s in spaces for n in (2, 3, 70)] + ["a" * 5000, "\u0301" * 900, "'" * 900, " \n" * 900]
    for text, want in zip(made, plain.encode_batch(made, add_special_tokens=False), strict=True):
        assert encode(text).tolist() == want.ids


def test_only_the_first_piece_is_short():
    assert packing.cut_points(1, 8) == [0, 1] and packing.cut_points(8, 8) == [0, 8]
    assert packing.cut_points(20, 8) == [0, 4, 12, 20] and packing.cut_points(24, 8) == [0, 8, 16, 24]


def test_jpeg_round_trip_and_equal_texts():
    for text, file, pictures in media._read(ALL):
        assert b"".join(t.tobytes() for _, _, t in pictures) == media.padded(text)
        assert len(media.padded(text)) % 192 == 0 and media.padded(text)
        assert file[:2] == b"\xff\xd8" and file[-2:] == b"\xff\xd9"
    one, two = media.to_media([b"abc", LONG.encode(), b"abc"])[::2]
    assert one == two


def test_jpeg_of_several_pictures():
    big = bytes(range(256)) * 6500
    (_, _, pictures) = next(media._read([big]))
    assert len(pictures) == 2 and b"".join(t.tobytes() for _, _, t in pictures) == media.padded(big)


def test_features_are_of_all_pictures(monkeypatch):
    monkeypatch.setattr(media, "MOST_ROWS", 16)
    head = b"head of a long text " * 200
    ends = [head + tail * 3000 for tail in (b" ~", b"~ ", b"AZ")]
    files = jpeg.read(media.to_media(ends))
    assert {len(p) for p in files} == {4}
    found = [media.describe(p) for p in files]
    assert all(f.startswith(f"1536x{sum(p[1] for p in pictures)}x4:") for f, pictures in zip(found, files, strict=True))
    whole = [np.concatenate([t for _, _, t in p]) for p in files]
    assert [f.split(":")[1] for f in found] == [media.thumbnail_hash(w) for w in whole] and len(set(found)) > 1
    assert media.describe(files[0][:1]).split(":")[1] == media.thumbnail_hash(files[0][0][2])


def by_hand(levels, ac, restart):
    """A one-component picture of one row of blocks, written bit by bit; with AC coefficients where ac says so."""
    dc = {v: (c, n) for v, c, n in jpeg.codes(jpeg.DC_BITS, jpeg.DC_VALUES)}
    ac_bits, ac_values = (0, 2, 1) + (0,) * 13, (0x00, 0x01, 0x11)
    act = {v: (c, n) for v, c, n in jpeg.codes(ac_bits, ac_values)}
    scan, bits, before = b"", "", 0

    def flush():
        raw = int((bits + "1" * (-len(bits) % 8)) or "0", 2).to_bytes(-(-len(bits) // 8))
        return raw.replace(b"\xff", b"\xff\x00")

    for i, v in enumerate(levels):
        if restart and i and i % restart == 0:
            scan += flush() + bytes([0xFF, 0xD0 + (i // restart - 1) % 8])
            bits, before = "", 0
        d, before = v - before, v
        k = abs(d).bit_length()
        c, n = dc[k]
        bits += f"{c:0{n}b}" + (f"{d if d > 0 else d + 2**k - 1:0{k}b}" if k else "")
        for _ in range(ac[i]):
            for symbol in (0x01, 0x11):
                c, n = act[symbol]
                bits += f"{c:0{n}b}1"
        c, n = act[0]
        bits += f"{c:0{n}b}"
    scan += flush()
    head = jpeg.header(1, len(levels))
    head = head[: head.index(b"\xff\xc4\x00\x14\x10")] + b"\xff\xc4" + (19 + len(ac_values)).to_bytes(2) + bytes([0x10, *ac_bits, *ac_values]) + (b"\xff\xdd\x00\x04" + restart.to_bytes(2) if restart else b"") + head[head.index(b"\xff\xda") :]
    return head + scan + b"\xff\xd9"


@pytest.mark.parametrize("restart", [0, 1, 3, 5])
def test_jpeg_with_ac_coefficients_and_restarts(restart):
    rng = np.random.default_rng(restart)
    levels, ac = rng.integers(-128, 128, 17).tolist(), rng.integers(0, 4, 17).tolist()
    width, height, thumb = jpeg.read([by_hand(levels, ac, restart)])[0][0]
    assert (width, height) == (17 * 8, 8) and thumb[0].tolist() == [v + 128 for v in levels]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="</s>[INST]\\ a", max_size=60))
def test_escape_round_trip(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text
    assert not any(c in safe for c in (chat.BEGIN, chat.END, chat.OPEN, chat.CLOSE))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "</s>"]), st.text(max_size=20)), min_size=1, max_size=6))
def test_examples_read_back(turns):
    made = list(chat._examples(3, turns))
    assert chat.read_back(made[-1][3]) == turns and [m[-1] for m in made] == [False] * (len(made) - 1) + [True]
    assert [chat.unescape(m[3][m[4] : m[5]]) for m in made if m[5] > m[4] or True][: sum(r == "assistant" for r, _ in turns)] == [t for r, t in turns if r == "assistant"]


def test_split_quotas_add_up():
    quotas = np.array([5000, 3, 0, 411])
    got = mixing.split_quotas(quotas, 16, [7])
    assert (got.sum(axis=0) == quotas).all() and np.ptp(got.sum(axis=1)) <= 1 and (got >= 0).all()
    assert (got == mixing.split_quotas(quotas, 16, [7])).all()
    inner = mixing.split_quotas(np.array([2000, 1500, 1500]), 16, [7, 0], got[:, 0])
    assert (inner.sum(axis=0) == [2000, 1500, 1500]).all() and (inner.sum(axis=1) == got[:, 0]).all()
    assert not mixing.split_quotas(np.zeros(3), 4, [7]).any()


def test_split_quotas_draw_is_hypergeometric():
    draws = np.array([mixing.split_quotas(np.array([30, 10]), 2, [seed])[0] for seed in range(2000)])
    assert (draws.sum(axis=1) == 20).all() and abs(draws[:, 1].mean() - 5) < 0.15
    assert abs(draws[:, 1].var() - 20 * 0.25 * 0.75 * 20 / 39) < 0.2  # n K/N (1 - K/N) (N - n)/(N - 1)


def plain_shingles(text, k):
    w = words(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


@pytest.mark.parametrize("k", [2, 5])
def test_shingle_sets(k):
    plain = [plain_shingles(t, k) for _, t, _ in texts()]
    got = shingles.shingle_sets(ALL, k)
    assert [len(g) for g in got] == [len(p) for p in plain]
    for i in range(len(plain)):
        for j in range(i):
            assert len(np.intersect1d(got[i], got[j])) == len(plain[i] & plain[j])


def test_signatures_estimate_similarity():
    a = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 2000, dtype=np.uint64))
    sig = shingles.signatures([a[:1500], a[300:], a[:0]], 512)
    assert abs((sig[0] == sig[1]).mean() - 1200 / len(a)) < 0.08 and (sig[2] == 0xFFFFFFFF).all()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=14), min_size=1, max_size=8), st.integers(1, 6))
def test_shared_windows(strings, least):
    raw = [s.encode() for s in strings]
    length = np.array([len(s) for s in raw])
    s, o, g = suffix.shared_windows(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(length) - length, length, least)
    want, got = {}, {}
    for i, x in enumerate(raw):
        for j in range(len(x) - least + 1):
            want.setdefault(x[j : j + least], set()).add((i, j))
    for a, b, c in zip(s.tolist(), o.tolist(), g.tolist(), strict=True):
        got.setdefault(c, set()).add((a, b))
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


def test_strings_in_proportion():
    """A passage that ten times the documents hold costs no more strings for each of them."""
    rng = np.random.default_rng(3)
    text = lambda n: bytes(rng.integers(97, 123, n, np.uint8)).decode()
    passage = text(200)

    def strings_a_document(n):
        rows = pa.table({"doc_id": pa.array(range(n), pa.int64()), "text": [text(60) + passage + text(60) for _ in range(n)], "chunk": pa.array([0] * n, pa.int64())})
        sent = repeats._send_strings(4)(rows, repeats._answer_hashes(repeats._send_hashes(1)(rows)))
        return sum(map(len, sent["meta"].to_pylist())) / n

    assert strings_a_document(4000) < 1.2 * strings_a_document(400)


def test_single_windows_are_not_expanded(monkeypatch):
    """Of a hash that is cut into windows, those that one document alone has cost no expansion; the others' answers stay."""
    rng = np.random.default_rng(5)
    text = lambda n: bytes(rng.integers(97, 123, n, np.uint8)).decode()
    passage, expanded = text(80), []
    monkeypatch.setattr(repeats, "HOT", 10)
    monkeypatch.setattr(repeats, "shared_windows", lambda data, start, length, least: expanded.append(len(start)) or suffix.shared_windows(data, start, length, least))
    apart = [text(60) + chr(0x80 + i) + passage + chr(0x80 + i * 64) + text(60) for i in range(25)]  # other bytes before and after the passage
    rows = pa.table({"doc_id": pa.array(range(25), pa.int64()), "text": apart, "chunk": pa.array([0] * 25, pa.int64())})
    strings = repeats._send_strings(997)(rows, repeats._answer_hashes(repeats._send_hashes(1)(rows)))
    answers = pa.concat_tables(repeats._answer_strings(strings.slice(i, 1)) for i in range(strings.num_rows))
    assert sum(expanded) == 31 < sum(map(len, strings["meta"].to_pylist()))
    assert repeats._digests(rows, answers)["n_removed"].to_pylist() == [0] + [80] * 24


def plain_logit(net, words):
    """The network word by word and window by window, with loops over numbers."""
    p, h = net.p, toxicity.HIDDEN
    sig = lambda v: 1 / (1 + np.exp(-v))

    def entry(word):
        bare = word.strip(toxicity.EDGES) or word or b" "
        marked = b"^" + bare + b"$"
        rows = [(marked[i] * 961 + marked[i + 1] * 31 + marked[i + 2]) * 40503 >> 5 & toxicity.CHAR_ROWS - 1 for i in range(len(marked) - 2)]
        return np.concatenate([p["word"][net.vocabulary.get(bare, 0)], sum(p["char"][r] for r in rows) / len(rows)])

    def window(own):
        states = [[], []]
        for d, u in enumerate((p["uf"], p["ub"])):
            state = np.zeros(h)
            for word in own if d == 0 else own[::-1]:
                x = (entry(word) @ p["wx"] + p["b"])[3 * h * d : 3 * h * (d + 1)]
                a = state @ u
                z, r = sig(x[:h] + a[:h]), sig(x[h : 2 * h] + a[h : 2 * h])
                state = z * state + (1 - z) * np.tanh(x[2 * h :] + r * a[2 * h :])
                states[d].append(state)
        both = [np.concatenate(pair) for pair in zip(states[0], states[1][::-1], strict=True)]
        score = np.array([s @ p["v"] for s in both])
        weight = np.exp(score) / np.exp(score).sum()
        return sum(w * (s @ p["w"]) for w, s in zip(weight, both, strict=True)) + p["c"][0]

    words = words or [b""]
    n = len(words)
    starts = [0] if n <= 16 else sorted({*range(0, n - 16, 8), n - 16})
    return float(np.log(sum(np.exp(window(words[s : s + 16])) for s in starts)) - 0.5 * np.log(len(starts)))


def test_network_forward_against_loops():
    net = toxicity.Network({b"bad": 1, b"word": 2}, 11)
    data = [[], [b"bad"], [b"(Bad)", b"x"] * 8, [b"word", b"\xc3\xa9t\xc3\xa9", b"bad", b"..."] * 9, [b"a"] * 17]
    assert np.allclose(net.logits(data), [plain_logit(net, d) for d in data], atol=1e-4)


def test_network_gradient():
    net = toxicity.Network({b"bad": 1, b"word": 2})
    data, y = [[b"a", b"bad", b"word"] * 9, [b"good"] * 5], np.array([1, 0], np.float32)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    grad = net.gradient(toxicity.Lexicon(data, net.vocabulary, 16), [0, 1], y)
    filled = [t + [b""] * max(0, 16 - len(t)) for t in data]

    def loss():
        z = net.logits(filled).astype(float)
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    rng = np.random.default_rng(0)
    for k in ("wx", "uf", "ub", "v", "w", "c", "b", "word"):
        flat = net.p[k].reshape(-1)
        for i in rng.integers(8 if k == "word" else 0, len(flat), 4):
            old = flat[i]
            flat[i] = old + 1e-3
            up = loss()
            flat[i] = old - 1e-3
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-3 - grad[k].reshape(-1)[i]) < 2e-4


def test_windows_cover_all_words_and_overlap():
    for n in (1, 15, 16, 17, 24, 100):
        starts = toxicity.window_starts(n)
        assert set().union(*(range(s, min(s + 16, n)) for s in starts)) == set(range(n))
        assert all(b - a <= 8 for a, b in zip(starts, starts[1:], strict=False))


def test_chain_marginals_against_all_labellings():
    from itertools import product

    rng = np.random.default_rng(2)
    field = lines.Field(3)
    field.weight, field.pair = rng.normal(size=3), rng.normal(size=(2, 2))
    per = np.array([1, 4, 3])
    x = rng.normal(size=(8, 3))
    got, pairs = field.marginals(x, per)
    want, expected, at = [], np.zeros((2, 2)), 0
    for n in per:
        u = x[at : at + n] @ field.weight
        weights = {ys: np.exp(sum(u[i] * y for i, y in enumerate(ys)) + sum(field.pair[a, b] for a, b in zip(ys, ys[1:], strict=False))) for ys in product((0, 1), repeat=int(n))}
        total = sum(weights.values())
        want += [sum(w for ys, w in weights.items() if ys[i]) / total for i in range(n)]
        for ys, w in weights.items():
            for a, b in zip(ys, ys[1:], strict=False):
                expected[a, b] += w / total
        at += n
    assert np.allclose(got, want) and np.allclose(pairs, expected)


def test_best_cut():
    z, y = np.array([3.0, 2.0, 1.0, 0.0]), np.array([1.0, 1.0, 0.0, 0.0])
    assert 1 < best_cut(z, y, 0.5) < 2 and best_cut(z, np.zeros(4), 0.5) == 0


def test_digest_is_of_the_stored_bytes():
    text = b"hello"
    (_, file, pictures) = next(media._read([text]))
    assert hashlib.sha256(pictures[0][2].tobytes()).hexdigest() == hashlib.sha256(text + b" " * 187).hexdigest() and len(file) > 192
