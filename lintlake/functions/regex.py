"""ECMAScript patterns as Java patterns with the same matches."""

from __future__ import annotations

import re

#: White space of ECMAScript: Java's own class knows six ASCII characters only.
SPACE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
WORD = "[A-Za-z0-9_]"
BREAKS = r"\n\r\u2028\u2029"
EDGE = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
OUTSIDE = {
    r"\s": f"[{SPACE}]",
    r"\S": f"[^{SPACE}]",
    r"\/": "/",
}
INSIDE = {r"\s": SPACE, r"\/": "/", "[": r"\[", "&": r"\&"}


def _edge(before: str, after: str) -> str:
    r"""``\b`` between two pieces: one look suffices where a neighbour is a letter or digit for sure.

    after: the rest of the pattern.  Letters that must follow are looked at first, which few places of a text pass; the look back is dear.
    """
    run = re.match(f"(?:{WORD}(?![?*{{])){{0,4}}", after)[0]
    if run:
        return f"(?={run})(?<!{WORD})"
    return f"(?!{WORD})" if re.fullmatch(WORD, before) else EDGE


def js_to_java(pattern: str, flags: str = "") -> str:
    """Flags: i (case), m (^ and $ at lines), s (the dot takes line breaks)."""
    out, inside, at, before = [], False, 0, ""
    while at < len(pattern):
        piece = pattern[at : at + 2] if pattern[at] == "\\" else pattern[at]
        at += len(piece)
        if inside:
            out.append(INSIDE.get(piece, piece))
            inside = piece != "]"
        elif piece == "[":
            negated = pattern[at : at + 1] == "^"
            out.append("[^" if negated else "[")
            at, inside = at + negated, True
        elif piece == r"\b":
            out.append(_edge(before, pattern[at:]))
        elif piece == "." and "s" not in flags:
            out.append(f"[^{BREAKS}]")
        elif piece == "^" and "m" in flags:
            out.append(f"(?<![^{BREAKS}])")
        elif piece == "$":
            out.append(f"(?![^{BREAKS}])" if "m" in flags else r"\z")
        else:
            out.append(OUTSIDE.get(piece, piece))
        before = piece
    mode = "".join(f for f in "is" if f in flags)
    return (f"(?{mode})" if mode else "") + "".join(out)


GROUP = re.compile(r"\(\?(?:[:=!]|<[=!]|<\w+>)|\(")
TIMES = re.compile(r"(?:[*+?]|\{(\d+)(?:,\d*)?\})\??")
COUNTED = re.compile(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|c[A-Za-z]|[pP]\{[^}]*\}|k<[^>]*>)")
CONTROLS = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\x0b", "0": "\0"}
#: A class of at most so many characters counts as that many alternatives.
SMALL_CLASS = 4


class _Walk:
    """Reads a pattern from left to right and tells, piece by piece, which literals any match of it must hold."""

    def __init__(self, pattern: str):
        self.pattern, self.at = pattern, 0

    def alternatives(self) -> list[list[str]]:
        """Up to a closing bracket or the end: what all branches need; of several branches the best list of each, together."""
        branches = [self.branch()]
        while self.pattern[self.at : self.at + 1] == "|":
            self.at += 1
            branches.append(self.branch())
        if len(branches) == 1:
            return branches[0]
        best = [max(own, key=_shortest, default=None) for own in branches]
        return [[x for own in best for x in own]] if all(best) else []

    def branch(self) -> list[list[str]]:
        found, run = [], ""
        while self.at < len(self.pattern) and self.pattern[self.at] not in "|)":
            needed = self.piece()
            least = self.times()
            literal = needed[0][0] if len(needed) == 1 and len(needed[0]) == 1 and len(needed[0][0]) == 1 and not self.grouped else None
            if literal is not None and least == (1, True):
                run += literal
                continue
            if run:
                found.append([run])
                run = ""
            if least[0] > 0:
                found += needed
        return found + [[run]] * bool(run)

    def times(self) -> tuple[int, bool]:
        """How often the piece before must stand there at least, and whether that is simply once."""
        m = TIMES.match(self.pattern, self.at)
        if not m:
            return 1, True
        self.at = m.end()
        return (0 if m[0][0] in "*?" else 1 if m[0][0] == "+" else int(m[1])), False

    def piece(self) -> list[list[str]]:
        """What one character, class, escape or group needs."""
        sign, self.grouped = self.pattern[self.at], False
        if sign == "(":
            opening = GROUP.match(self.pattern, self.at)[0]
            self.at += len(opening)
            inner = self.alternatives()
            self.at += 1
            self.grouped = True
            return [] if opening in ("(?=", "(?!", "(?<=", "(?<!") else inner
        if sign == "[":
            return self.char_class()
        if sign == "\\":
            char = self.escaped()
            return [[char]] if char else []
        self.at += 1
        return [] if sign in ".^$" else [[sign]]

    def escaped(self) -> str | None:
        """The character that an escape stands for; none for sets, edges and references."""
        m = COUNTED.match(self.pattern, self.at)
        char = self.pattern[self.at + 1 : self.at + 2]
        self.at = m.end() if m else self.at + 2
        if m:
            return chr(int(m[1] or m[2], 16)) if m[1] or m[2] else None
        return CONTROLS.get(char) if char.isalnum() else char

    def char_class(self) -> list[list[str]]:
        self.at += 1
        members, known = [], self.pattern[self.at : self.at + 1] != "^"
        while self.pattern[self.at] != "]":
            if self.pattern[self.at] == "\\":
                char = self.escaped()
            else:
                char = self.pattern[self.at]
                self.at += 1
            known &= char is not None and not (char == "-" and members and self.pattern[self.at] != "]")
            members.append(char)
        self.at += 1
        return [members] if known and 0 < len(members) <= SMALL_CLASS else []


def _shortest(alternatives: list[str]) -> int:
    return min(map(len, alternatives))


def required(pattern: str, most: int = 3) -> list[list[str]]:
    """Literals without which there is no match: of each list a text must hold one.  The ``most`` lists with the longest literals.

    Read off the pattern: runs of characters, small classes, and of alternatives the best list of each.  What may be
    absent, and what stands in a lookaround, counts for nothing; a pattern that cannot be read needs nothing.
    """
    walk = _Walk(pattern)
    try:
        found = walk.alternatives()
    except (IndexError, TypeError):
        return []
    return sorted(found, key=_shortest, reverse=True)[:most] if walk.at == len(pattern) else []


#: What may stand in a pattern of one line: escapes that take no line break, outside and inside classes, and ways to open a group.
ONE_LINE = re.compile(r"\\[bdwS]|\\[^\w\s]|\((?:\?(?:[:=!]|<[=!]|<\w+>))?(?!\?)|[^\\\[\](\x00-\x1f]")
MEMBER = re.compile(r"\\[dw]|\\[^\w\s]|[^\\\x00-\x1f]")
#: What takes the line feed out of a negated class.
FEED = re.compile(r"\\[ns]")


def one_line(pattern: str, flags: str = "") -> bool:
    """Whether it is sure that no match holds a line feed, and that what stands in other lines tells nothing about a match; what is not known is not sure."""
    at = 0
    while at < len(pattern):
        if pattern[at] == "[":
            at += 1
            negated = pattern[at : at + 1] == "^"
            at, without = at + negated, not negated
            while pattern[at : at + 1] != "]":
                feed = FEED.match(pattern, at) if negated else None
                m = feed or MEMBER.match(pattern, at)
                if not m:
                    return False
                at, without = m.end(), without or bool(feed)
            if not without:
                return False
            at += 1
            continue
        m = ONE_LINE.match(pattern, at)
        if not m or (m[0] in "^$" and "m" not in flags) or (m[0] == "." and "s" in flags):
            return False
        at = m.end()
    return True


APART = re.compile(r"\\[bsW]|[\^$]")


def whole_words(pattern: str) -> list[str]:
    """Words (letters, digits and underscores in a row) that any match holds and that are whole words of the text: what stands beside them in the pattern is no such character.

    Looked for outside groups only, and in patterns without branches there.
    """
    walk, pieces = _Walk(pattern), []
    try:
        while walk.at < len(pattern):
            if pattern[walk.at] in "|)":
                return []
            apart = APART.match(pattern, walk.at)
            needed = walk.piece()
            least = walk.times()
            members = needed[0] if len(needed) == 1 and not walk.grouped and least[0] > 0 else []
            if apart and least[0] > 0 or members and not any(re.fullmatch(WORD, c) for c in members):
                pieces.append(" ")
            else:
                pieces.append(members[0] if len(members) == 1 and least == (1, True) else "\0")
    except (IndexError, TypeError):
        return []
    return [run for run in "".join(pieces).split(" ")[1:-1] if re.fullmatch(f"{WORD}+", run)]
