"""Baseline JPEG in numpy: DC-only pictures written and read by whole batches.

Writing: every sample is the DC level of one 8x8 block (quantiser 8, so a block decodes to a flat
square of exactly that value), and the picture's luminance thumbnail is the sample grid itself.
Reading: markers are parsed, stuffing is taken out, and all restart intervals of all pictures with
the same tables are Huffman-decoded side by side, one block of each per step.  AC coefficients,
several components and sampling factors are read as well; only DC levels of the first are kept.
"""

from __future__ import annotations

import struct

import numpy as np

WIDTH, INTERVAL, MOST_ROWS = 192, 64, 8000
# The DC luminance code lengths of the JPEG standard, categories 0 to 11.
DC_BITS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_VALUES = tuple(range(12))
#: One AC symbol is enough where no block has AC coefficients: end of block.
AC_BITS = (1,) + (0,) * 15
AC_VALUES = (0,)


def codes(bits: tuple[int, ...], values: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """(value, code, length) of a Huffman table."""
    out, code, at = [], 0, 0
    for length, n in enumerate(bits, 1):
        for _ in range(n):
            out.append((values[at], code, length))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def lookup(bits: tuple[int, ...], values: tuple[int, ...]) -> tuple[int, np.ndarray, np.ndarray]:
    """(bits to peek at, length by peeked bits, value by peeked bits)."""
    most = max((n for n, b in enumerate(bits, 1) if b), default=1)
    length, value = np.full(1 << most, most, np.uint64), np.zeros(1 << most, np.uint64)
    for v, code, n in codes(bits, values):
        length[code << most - n : code + 1 << most - n] = n
        value[code << most - n : code + 1 << most - n] = v
    return most, length, value


def _level_codes() -> tuple[np.ndarray, np.ndarray]:
    """Code and length of a DC difference (index: difference + 255), the end-of-block bit included."""
    table = {v: (code, n) for v, code, n in codes(DC_BITS, DC_VALUES)}
    value, length = np.zeros(511, np.uint64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        category = abs(d).bit_length()
        code, n = table[category]
        low = d if d >= 0 else d + (1 << category) - 1
        value[d + 255], length[d + 255] = (code << category | low) << 1, n + category + 1
    return value, length


def header(rows: int, width: int = WIDTH) -> bytes:
    def segment(marker: int, body: bytes) -> bytes:
        return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body

    return b"".join(
        (
            b"\xff\xd8",
            segment(0xDB, bytes([0, 8] + [1] * 63)),
            segment(0xC0, struct.pack(">BHHB3B", 8, rows * 8, width * 8, 1, 1, 0x11, 0)),
            segment(0xC4, bytes([0x00, *DC_BITS, *DC_VALUES])),
            segment(0xC4, bytes([0x10, *AC_BITS, *AC_VALUES])),
            segment(0xDD, struct.pack(">H", INTERVAL)),
            segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
        )
    )


def write(frames: list[bytes]) -> list[bytes]:
    """A picture for each frame of samples; a frame's length is a multiple of WIDTH."""
    value, length = _level_codes()
    v = np.frombuffer(b"".join(frames), np.uint8).astype(np.int64).reshape(-1, INTERVAL)
    step = np.diff(v, axis=1, prepend=128) + 255
    bits = length[step]
    pad = -bits.sum(axis=1) % 8
    bits = np.concatenate([bits, pad[:, None]], axis=1)
    what = np.concatenate([value[step], ((1 << pad) - 1).astype(np.uint64)[:, None]], axis=1).ravel()
    size = bits.sum(axis=1) // 8
    first = np.cumsum(size) - size
    bits = bits.ravel()
    at = np.cumsum(bits) - bits
    word = at >> 5
    held = what << (64 - bits - (at & 31)).clip(0, 63).astype(np.uint64)
    held[bits == 0] = 0
    begin = np.flatnonzero(np.diff(word, prepend=-1))
    sums = np.bitwise_or.reduceat(held, begin)
    out = np.zeros(int(word[-1]) + 2, np.uint64)
    out[word[begin]] |= sums >> np.uint64(32)
    out[word[begin] + 1] |= sums & np.uint64(0xFFFFFFFF)
    data = np.frombuffer(out.astype(">u4").tobytes(), np.uint8)[: int(size.sum())]

    per = np.array([len(f) // INTERVAL for f in frames])
    start = np.cumsum(per) - per
    number = np.arange(len(size)) - np.repeat(start, per)
    last = np.zeros(len(size), bool)
    last[start + per - 1] = True
    full = data == 255
    markers = np.cumsum(~last) - ~last
    place = np.arange(len(data)) + np.cumsum(full) - full + 2 * np.repeat(markers, size)
    body = np.zeros(int(place[-1]) + 2, np.uint8)
    body[place] = data
    ends = place[first + size - 1] + 1 + full[first + size - 1]
    body[ends[~last]] = 255
    body[ends[~last] + 1] = 0xD0 + number[~last] % 8
    raw, begins = body.tobytes(), place[first[start]]
    return [header(len(f) // WIDTH) + raw[a:b] + b"\xff\xd9" for f, a, b in zip(frames, begins, ends[last], strict=True)]


def _parse(data: bytes, at: int) -> tuple[dict, int]:
    """Segments of the picture that begins at ``at``, up to its scan; gives its description and where the scan begins."""
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no start of image")
    at += 2
    tables: dict[int, tuple] = {}
    quant: dict[int, int] = {}
    found = {"interval": 0}
    while True:
        marker, n = data[at + 1], int.from_bytes(data[at + 2 : at + 4])
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide])
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                bits = tuple(body[1:17])
                tables[body[0]] = (bits, tuple(body[17 : 17 + sum(bits)]))
                body = body[17 + sum(bits) :]
        elif marker == 0xC0:
            found["height"], found["width"] = struct.unpack(">HH", body[1:5])
            found["parts"] = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])}
        elif 0xC1 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("not a baseline picture")
        elif marker == 0xDD:
            found["interval"] = int.from_bytes(body)
        elif marker == 0xDA:
            order = [(body[1 + 2 * i], tables[body[2 + 2 * i] >> 4], tables[16 + (body[2 + 2 * i] & 15)]) for i in range(body[0])]
            parts = found["parts"]
            single = len(order) == 1
            found["pattern"] = tuple((i, dc, ac) for i, (c, dc, ac) in enumerate(order) for _ in range(1 if single else parts[c][0] * parts[c][1]))
            found["luma"] = (1, 1) if single else parts[order[0][0]][:2]
            most = (1, 1) if single else tuple(max(p[k] for p in parts.values()) for k in (0, 1))
            found["grid"] = tuple(-(-found[side] // (8 * m)) for side, m in zip(("width", "height"), most, strict=True))
            found["quant"] = quant[parts[order[0][0]][2]]
            return found, at


def _decode(words: np.ndarray, at: np.ndarray, mcus: np.ndarray, pattern: tuple) -> np.ndarray:
    """DC levels of the first component: (streams, blocks); streams run side by side, longest first."""
    u = np.uint64
    tables = {id(t): lookup(*t) for _, dc, ac in pattern for t in (dc, ac)}
    total = mcus * len(pattern)
    steps = int(total.max())
    own = [i for i, (c, _, _) in enumerate(pattern) if c == 0]
    out = np.zeros((len(own) * int(mcus.max()), len(at)), np.int32)
    live = np.searchsorted(-total, -np.arange(steps), side="left")
    column = 0
    for step in range(steps):
        n = int(live[step])
        part, dc, ac = pattern[step % len(pattern)]
        most, length, value = tables[id(dc)]
        p = at[:n]
        x = words[p >> 3] << (p & 7).astype(u)
        peek = x >> u(64 - most)
        size, category = length[peek], value[peek]
        x <<= size
        low = ((x >> u(1)) >> (u(63) - category)).astype(np.int32)
        x <<= category
        c = category.astype(np.int32)
        if part == 0:
            out[column, :n] = np.where((low >> np.maximum(c - 1, 0)) > 0, low, low - (1 << c) + 1)
            column += 1
        p += (size + category).astype(np.int64)
        most, length, value = tables[id(ac)]
        peek = x >> u(64 - most)
        p += length[peek].astype(np.int64)
        busy = np.flatnonzero(value[peek])
        if len(busy):  # blocks with AC coefficients: skip runs until the end of the block
            k, symbol = np.zeros(len(busy), np.int64), value[peek[busy]].astype(np.int64)
            while len(busy):
                p[busy] += symbol & 15
                k += (symbol >> 4) + 1
                more = k < 63
                busy, k = busy[more], k[more]
                if not len(busy):
                    break
                x = words[p[busy] >> 3] << (p[busy] & 7).astype(u)
                peek = x >> u(64 - most)
                p[busy] += length[peek].astype(np.int64)
                symbol = value[peek].astype(np.int64)
                more = symbol != 0
                busy, k, symbol = busy[more], k[more], symbol[more]
        at[:n] = p
    return np.cumsum(out, axis=0, out=out).T


def read(files: list[bytes]) -> list[list[tuple[int, int, np.ndarray]]]:
    """Of each file its pictures: (width, height, luminance thumbnail of a sample per block)."""
    data = b"".join(files)
    raw = np.frombuffer(data, np.uint8)
    marks = np.flatnonzero(raw[:-1] == 255)
    after = raw[marks + 1]
    ends = marks[(after != 0) & ~((after >= 0xD0) & (after <= 0xD7))]
    restarts = marks[(after >= 0xD0) & (after <= 0xD7)]
    keep = np.ones(len(raw), bool)
    keep[marks[after == 0] + 1] = False  # stuffing; other segments' bytes are never looked at again
    index = np.cumsum(keep) - keep
    clean = np.concatenate([raw[keep], np.full(16, 255, np.uint8)]).astype(np.uint64)
    words = clean[: len(clean) - 8].copy()
    for i in range(1, 8):
        words = words << np.uint64(8) | clean[i : len(clean) - 8 + i]
    found: list[list] = []
    groups: dict[tuple, list] = {}
    at = 0
    for file in files:
        stop, own = at + len(file), []
        while at < stop:
            picture, scan = _parse(data, at)
            end = int(ends[np.searchsorted(ends, scan)])
            inner = restarts[np.searchsorted(restarts, scan) : np.searchsorted(restarts, end)]
            mcus = picture["grid"][0] * picture["grid"][1]
            interval = picture["interval"] or mcus
            starts = index[np.concatenate([[scan], inner + 2])]
            counts = np.minimum(interval, mcus - interval * np.arange(len(starts)))
            groups.setdefault(picture["pattern"], []).append((picture, starts, counts, own, len(own)))
            own.append(None)
            at = end + 2
        found.append(own)
    for pattern, members in groups.items():
        starts, counts = np.concatenate([m[1] for m in members]) * 8, np.concatenate([m[2] for m in members])
        order = np.argsort(-counts, kind="stable")
        levels = np.empty((len(counts), int(counts.max()) * sum(c == 0 for c, _, _ in pattern)), np.int32)
        levels[order] = _decode(words, starts[order], counts[order], pattern)
        done = 0
        for picture, _, mine, own, slot in members:
            (across, down), (h, v) = picture["grid"], picture["luma"]
            got = levels[done : done + len(mine)]
            done += len(mine)
            flat = got.ravel() if (mine * h * v == got.shape[1]).all() else np.concatenate([g[: m * h * v] for g, m in zip(got, mine, strict=True)])
            grid = flat.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
            thumb = np.clip((grid * picture["quant"] + 4 >> 3) + 128, 0, 255).astype(np.uint8)
            own[slot] = (picture["width"], picture["height"], thumb[: -(-picture["height"] // 8), : -(-picture["width"] // 8)])
    return found
