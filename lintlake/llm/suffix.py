"""Common prefixes of suffixes from a Burrows-Wheeler transform, up to a bound.

The transform is of a collection of short strings, each with an end mark of its own.  From the
intervals of all strings as long as the sort's first names, whole levels of intervals are extended
backward at once: all suffixes that start with w, preceded by the character c, make up the
interval of cw.  An interval of level l whose right neighbour has no value yet proves that the
neighbour shares l - 1 characters with it.  So common prefixes come out in increasing order, and
the expansion stops at the minimum length: what has no value then shares at least that much.
"""

from __future__ import annotations

import numpy as np

U = np.uint64


def first_names(text: np.ndarray, left: np.ndarray, bits: int, depth: int) -> np.ndarray:
    """The first ``depth`` characters of each suffix as a number, with zeros beyond the end mark."""
    name, have, part, size = np.zeros(len(text), U), 0, text.astype(U), 1
    while True:  # runs of 1, 2, 4 ... characters, put together to depth
        if depth & size:
            name[: max(len(text) - have, 0)] |= part[have:] << U(bits * (depth - have - size))
            have += size
        if 2 * size > depth:
            break
        longer = part << U(bits * size)
        longer[: max(len(text) - size, 0)] |= part[size:]
        part, size = longer, 2 * size
    inside = np.array([((1 << bits * k) - 1) << bits * (depth - k) for k in range(depth + 1)], U)
    return name & inside[np.minimum(left, depth)]


def suffix_order(text: np.ndarray, left: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(positions in the order of their suffixes' first ``least`` characters, place of each position, whether a place begins a first name, the length of first names).

    text: ranks of the characters from 1, and 0 for end marks; left: characters up to the string's end mark.
    First names are as long as 64 bits hold, half of ``least`` at most; what is still tied is named by two or three names at a time.
    """
    n = len(text)
    bits = max(int(text.max(initial=0)).bit_length(), 1)
    depth = level = min(64 // bits, max(least // 2, 1))
    name = first_names(text, left, bits, depth)
    order = np.argsort(name)
    name = name[order]
    new = np.ones(n, bool)
    new[1:] = name[1:] != name[:-1]
    first = new.copy()
    place = np.empty(n, np.int64)
    place[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    reach = 3 if n < 1 << 21 else 2  # names that fit 64 bits together
    while depth < least:
        tied = ~new
        tied[:-1] |= ~new[1:]
        slots = np.flatnonzero(tied)
        slots = slots[left[order[slots]] >= depth]  # the others are compared to their end marks: tied for good
        if not len(slots):
            break
        active = order[slots]
        name = place[active]
        if 2 * depth >= least:  # the second name ends where the bound is
            name, depth = name * n + place[active + (least - depth)], least
        else:
            rest = left[active]
            for k in range(1, reach):
                name = name * n + np.where(rest >= k * depth, place[np.minimum(active + k * depth, n - 1)], 0)
            depth *= reach
        by = np.argsort(name)
        active, name = active[by], name[by]
        order[slots] = active
        begins = np.ones(len(name), bool)
        begins[1:] = name[1:] != name[:-1]
        new[slots] = begins
        place[active] = np.maximum.accumulate(np.where(begins, slots, 0))
    place[order] = np.arange(n)
    return order, place, first, level


def bounded_prefixes(order: np.ndarray, place: np.ndarray, text: np.ndarray, left: np.ndarray, first: np.ndarray, level: int, least: int) -> np.ndarray:
    """Whether each suffix shares at least ``least`` characters with the one before it in the order; first, level: as suffix_order() gives them."""
    n = len(order)
    length, begins = left[order], text[order]
    alone = length < level  # with its end mark each is an interval of its own
    known = np.append(first | alone, True)  # end marks share nothing
    owner = np.full(n, -1, np.int32)
    at = np.flatnonzero(length >= level - 1)
    which = np.maximum.accumulate(np.where(first | alone, np.arange(n, dtype=np.int32), 0))[at]
    for _ in range(least - level):
        before = order[at] - 1  # the last character of all is an end mark
        live = text[before] > 0
        to, which = place[before[live]], which[live]  # where the suffix that is longer by one character stands
        if len(to) * 8 > n:
            owner[to] = which
            to = np.flatnonzero(owner >= 0)
            which = owner[to]
            owner[to] = -1
        else:
            by = np.argsort(to)
            to, which = to[by], which[by]
        if not len(to):
            break
        char = begins[to]
        new = np.ones(len(to), bool)
        new[1:] = (to[1:] != to[:-1] + 1) | (which[1:] != which[:-1]) | (char[1:] != char[:-1])
        begin = np.flatnonzero(new)
        lo, hi = to[begin], to[np.append(begin[1:], len(to)) - 1] + 1
        fresh = ~known[hi]
        known[hi[fresh]] = True
        lo, width = lo[fresh], (hi - lo)[fresh]
        which = np.repeat(np.arange(len(lo), dtype=np.int32), width)
        at = np.arange(len(which)) + np.repeat(lo - np.cumsum(width) + width, width)
    return ~known[:n]


def shared_windows(data: np.ndarray, start: np.ndarray, length: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of ``least`` bytes of the strings: (string, offset, group); equal windows have equal groups."""
    size = length + 1
    base = np.cumsum(size) - size
    place = np.arange(int(size.sum()))
    left = (np.repeat(base + length, size) - place).astype(np.int32)
    inside = left > 0
    found = data[(place + np.repeat(start - base, size))[inside]]
    rank = np.cumsum(np.bincount(found, minlength=256) > 0)
    text = np.zeros(len(left), np.min_scalar_type(rank[-1]))
    text[inside] = rank.astype(text.dtype)[found]
    order, place, first, level = suffix_order(text, left, least)
    same = bounded_prefixes(order, place, text, left, first, level, least)
    group = np.cumsum(~same)
    keep = left[order] >= least
    at = order[keep]
    string = np.repeat(np.arange(len(start)), size)[at]
    return string, at - base[string], group[keep]
