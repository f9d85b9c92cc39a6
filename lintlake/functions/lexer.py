"""Code, strings, templates, comments and regular expressions of scripts, told by a table of state transitions over bytes.

A byte's class (which may look one byte ahead) maps every state to the next one, and such maps compose.  So a buffer is cut into
blocks, all blocks are composed side by side in numpy whatever state they start in, their maps are chained, and a second sweep fills in the
states.  Whether a closing brace ends a substitution of a template is beyond a finite table: a first guess is held against a stack of
the braces that stand in code, and from the first wrong brace of a text on it is lexed again with that brace turned.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no installed copy of the package

KINDS = ("code", "string", "template", "comment", "regex")
CODE, STRING, TEMPLATE, COMMENT, REGEX = range(5)

# Classes of bytes.
CLASSES = ("OTHER", "WORD", "SPACE", "NL", "CRLF", "LS", "QUOTE", "DQUOTE", "TICK", "ESC", "SLASH", "SLASH2", "SLASHSTAR", "STARSLASH", "DOLLAR", "OPEN", "SHUT", "KEY", "TWICE", "CLOSE", "RESET", "PAD")
OTHER, WORD, SPACE, NL, CRLF, LS, QUOTE, DQUOTE, TICK, ESC, SLASH, SLASH2, SLASHSTAR, STARSLASH, DOLLAR, OPEN, SHUT, KEY, TWICE, CLOSE, RESET, PAD = range(len(CLASSES))
# States: code where a slash begins a regular expression (FREE) or divides (VALUE); each comment remembers which of them it stands in.
FREE, VALUE, LINE, LINE_V, BLOCK0, BLOCK0_V, BLOCK, BLOCK_V, BLOCK1, BLOCK1_V, SQ, SQ_E, DQ, DQ_E, TPL, TPL_E, TPL_D, RE, RE_E, SET, SET_E = range(21)
STATES = 21
BREAKS = (NL, CRLF, LS)

#: After these words an expression begins.
KEYWORDS = re.compile(rb"(?:(?<![\w$.\x80-\xff])|(?<=\xe2\x80[\xa8\xa9]))(?:return|typeof|instanceof|case|delete|void|throw|new|in|of|do|else|yield|await)(?:(?![\w$\x80-\xff])|(?=\xe2\x80[\xa8\xa9]))")
TWO = re.compile(rb"\+\+|--")
#: A substitution with braces in braces at most; the stack corrects the rest.
PLAIN_HOLE = re.compile(rb"\$\{(?:[^{}`]|\{[^{}`]*\})*\}")
LINE_ENDS = re.compile(rb"\xe2\x80[\xa8\xa9]")


def _table() -> tuple[np.ndarray, np.ndarray]:
    """(class, state) -> next state, and (class, state) -> kind of the byte."""
    step, kind = np.zeros((len(CLASSES), STATES), np.uint8), np.zeros((len(CLASSES), STATES), np.uint8)

    def put(state: int, default: int, of: int, **other: int) -> None:
        step[:, state], kind[:, state] = default, of
        for name, to in other.items():
            step[CLASSES.index(name), state] = to

    for state, line, block in ((FREE, LINE, BLOCK0), (VALUE, LINE_V, BLOCK0_V)):
        put(state, FREE, CODE, WORD=VALUE, SHUT=VALUE, DOLLAR=VALUE, ESC=VALUE, SPACE=state, NL=state, CRLF=state, LS=state, TWICE=state, QUOTE=SQ, DQUOTE=DQ, TICK=TPL, CLOSE=TPL, SLASH=RE if state == FREE else FREE, SLASH2=line, SLASHSTAR=block)
        for c, k in ((QUOTE, STRING), (DQUOTE, STRING), (TICK, TEMPLATE), (CLOSE, TEMPLATE), (SLASH2, COMMENT), (SLASHSTAR, COMMENT), *([(SLASH, REGEX)] if state == FREE else [])):
            kind[c, state] = k
        v = state
        put(LINE + v, LINE + v, COMMENT, NL=state, CRLF=state, LS=state)
        put(BLOCK0 + v, BLOCK + v, COMMENT)
        put(BLOCK + v, BLOCK + v, COMMENT, STARSLASH=BLOCK1 + v)
        put(BLOCK1 + v, state, COMMENT)
        kind[list(BREAKS), LINE + v] = CODE
    for state, escape, end in ((SQ, SQ_E, "QUOTE"), (DQ, DQ_E, "DQUOTE")):
        put(state, state, STRING, **{end: VALUE, "ESC": escape, "NL": VALUE, "CRLF": VALUE})
        put(escape, state, STRING, CRLF=escape)
        kind[[NL, CRLF], state] = CODE
    put(TPL, TPL, TEMPLATE, TICK=VALUE, ESC=TPL_E, DOLLAR=TPL_D)
    put(TPL_E, TPL, TEMPLATE)
    put(TPL_D, FREE, TEMPLATE)
    ends = dict.fromkeys(("NL", "CRLF", "LS"), FREE)
    put(RE, RE, REGEX, SLASH=VALUE, SLASH2=VALUE, SLASHSTAR=VALUE, OPEN=SET, ESC=RE_E, **ends)
    put(RE_E, RE, REGEX, **ends)
    put(SET, SET, REGEX, SHUT=RE, ESC=SET_E, **ends)
    put(SET_E, SET, REGEX, **ends)
    for state in (RE, RE_E, SET, SET_E):
        kind[list(BREAKS), state] = CODE
    step[RESET], kind[RESET] = FREE, CODE
    step[PAD] = np.arange(STATES)
    return step, kind


STEP, KIND = _table()


def _bytes_table() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    for c in range(256):
        if c > 127 or chr(c).isalnum() or chr(c) in "_$)":
            out[c] = WORD
    for chars, c in ((" \t\v\f", SPACE), ("\n\r", NL), ("'", QUOTE), ('"', DQUOTE), ("`", TICK), ("\\", ESC), ("/", SLASH), ("[", OPEN), ("]", SHUT)):
        for x in chars:
            out[ord(x)] = c
    return out


_CLASS = _bytes_table()


def classes(buffer: bytes) -> np.ndarray:
    """The class of each byte."""
    b = np.frombuffer(buffer, np.uint8)
    out, following = _CLASS[b], np.append(b[1:], 0).astype(np.uint8)
    for first, second, c in ((47, 47, SLASH2), (47, 42, SLASHSTAR), (42, 47, STARSLASH), (36, 123, DOLLAR), (13, 10, CRLF)):
        out[(b == first) & (following == second)] = c
    for m in KEYWORDS.finditer(buffer):
        out[m.end() - 1] = KEY
    for m in TWO.finditer(buffer):
        out[m.start() : m.end()] = TWICE
    for m in LINE_ENDS.finditer(buffer):
        out[m.start() : m.end()] = (LS, SPACE, SPACE)
    for m in PLAIN_HOLE.finditer(buffer):
        out[m.end() - 1] = CLOSE
    return out


def states(cls: np.ndarray, start: int = FREE) -> np.ndarray:
    """The state before each byte, and after the last one: maps of blocks, composed side by side, chained, filled in."""
    n = len(cls)
    width = max(int(n**0.5), 16)
    rows = -(-n // width)
    grid = np.concatenate([cls, np.full(rows * width - n, PAD, np.uint8)]).reshape(rows, width).T.copy() if n else np.zeros((0, 0), np.uint8)
    flat, base = STEP.reshape(-1), grid.astype(np.int32) * STATES
    maps = np.tile(np.arange(STATES, dtype=np.uint8), (rows, 1))
    for column in base:
        maps = flat[column[:, None] + maps]
    now, first = start, np.zeros(rows, np.uint8)
    for i, m in enumerate(maps.tolist()):
        first[i], now = now, m[now]
    out = np.zeros((width if n else 0, rows), np.uint8)
    for j, column in enumerate(base):
        out[j] = first
        first = flat[column + first]
    return np.append(out.T.reshape(-1)[:n], np.uint8(now))


def _first_wrong(buffer: bytes, cls: np.ndarray, before: np.ndarray, places: list[int], stack: list[bool]) -> int | None:
    """The first brace whose class is not what the stack says; the stack is kept up to it."""
    for i in places:
        state = before[i]
        if buffer[i] == 123:
            if state in (FREE, VALUE, TPL_D):
                stack.append(bool(state == TPL_D))
        elif state in (FREE, VALUE):
            hole = stack[-1] if stack else False
            if hole != (cls[i] == CLOSE):
                return i
            if stack:
                stack.pop()
    return None


def lex(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each text, state before each byte, kind of each byte) of the texts, each followed by a byte that resets."""
    buffer = b"\0".join(texts) + b"\0"
    ends = np.cumsum([len(t) + 1 for t in texts])
    starts = ends - np.array([len(t) + 1 for t in texts])
    cls = classes(buffer)
    cls[ends - 1] = RESET
    before = states(cls)[:-1]
    b = np.frombuffer(buffer, np.uint8)
    braces = np.flatnonzero((b == 123) | (b == 125))
    for k in range(len(texts)):
        own = braces[np.searchsorted(braces, starts[k]) : np.searchsorted(braces, ends[k])].tolist()
        if own and _first_wrong(buffer, cls, before, own, []) is not None:
            _mend(buffer, cls, before, int(starts[k]), int(ends[k]), own)
    return starts, before, KIND[cls, before]


def _mend(buffer: bytes, cls: np.ndarray, before: np.ndarray, start: int, end: int, braces: list[int], least: int = 256, most: int = 1 << 16) -> None:
    """Lexes one text piece by piece, turning each wrong brace where it is found; pieces grow while nothing is wrong."""
    at, state, stack, piece = start, FREE, [], least
    while at < end:
        stop, kept = min(at + piece, end), list(stack)
        own = states(cls[at:stop], state)
        before[at:stop] = own[:-1]
        wrong = _first_wrong(buffer, cls, before, braces[bisect_left(braces, at) : bisect_left(braces, stop)], kept)
        if wrong is None:
            at, state, stack, piece = stop, int(own[-1]), kept, min(2 * piece, most)
        else:
            cls[wrong] = OTHER if cls[wrong] == CLOSE else CLOSE
            at, state, stack, piece = wrong, int(before[wrong]), kept, least


def spans(texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
    """Of each text the spans (kind, begin, end) in bytes, from the first byte to the last; two strings side by side are two spans."""
    starts, before, kind = lex(texts)
    fresh = np.empty(len(kind), bool)
    fresh[0] = True
    fresh[1:] = kind[1:] != kind[:-1]
    fresh |= (before <= VALUE) & (kind != CODE)
    fresh[starts] = True
    cuts = np.flatnonzero(fresh)
    out, at = [], np.searchsorted(cuts, starts).tolist() + [len(cuts)]
    for k, t in enumerate(texts):
        own = (cuts[at[k] : at[k + 1]] - starts[k]).tolist()
        own = [c for c in own if c < len(t)]
        out.append([(int(kind[starts[k] + a]), a, z) for a, z in zip(own, [*own[1:], len(t)], strict=False)])
    return out
