"""What stands in the code of a script: tokens between the lexer's spans, matched brackets, and finders of assignments, calls, declarations and imports.

A finder looks at tokens, so nothing inside strings, comments or regular expressions is found.  It sees one text at a time; the texts come in
Arrow batches.
"""

from __future__ import annotations

import re
import sys
from typing import NamedTuple

from pyspark import cloudpickle

from .lexer import CODE, COMMENT, STRING, TEMPLATE, spans

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no installed copy of the package

PIECE = re.compile(
    r"(?P<name>[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*)|(?P<number>\.?\d(?:[eE][+-]|[\w.])*)|(?P<sign>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|[-+*/%&|^]=|<<|>>|\*\*|[^\s\w$])"
)
ASSIGNS = {"=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="}
PAIRS = {")": "(", "]": "[", "}": "{"}
#: Words that are no names of objects; what stands before them is another expression.
RESERVED = {"return", "typeof", "instanceof", "case", "delete", "void", "throw", "in", "of", "do", "else", "yield", "await", "if", "while", "for", "with", "switch", "const", "let", "var", "function", "class", "default", "export", "extends"}
# Names of methods that run queries, words of queries, names of secrets.
QUERIES = {"query", "execute", "sql"}
QUERY = re.compile("SELECT|INSERT|UPDATE|DELETE|FROM|WHERE", re.I)
SECRET = re.compile("api[_-]?key|secret|password|token", re.I)
EXAMPLE = re.compile(r"example|sample|dummy|test|xxx|your[_-]|placeholder|changeme", re.I)
ESCAPE = re.compile(r"\\(?:u\{[0-9a-fA-F]+\}|u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|\r\n|.)", re.S)


class Token(NamedTuple):
    kind: str  # name, number, sign, string, template or regex
    text: str
    begin: int  # in characters


class Script:
    """The tokens of a text without its comments, the partner of every bracket, and the template that a piece belongs to."""

    def __init__(self, text: str, own: list[tuple[int, int, int]] | None = None):
        self.text, raw = text, text.encode()
        self.tokens: list[Token] = []
        at = 0
        for kind, a, z in spans([raw])[0] if own is None else own:
            piece = raw[a:z].decode()
            if kind == CODE:
                self.tokens += [Token(m.lastgroup, m[0], at + m.start()) for m in PIECE.finditer(piece)]
            elif kind != COMMENT:
                self.tokens.append(Token({STRING: "string", TEMPLATE: "template"}.get(kind, "regex"), piece, at))
            at += len(piece)
        self.partner: dict[int, int] = {}
        stack: list[tuple[str, int]] = []
        for i, t in enumerate(self.tokens):
            opens = t.text if t.kind == "sign" and t.text in "([{" else ""
            shuts = PAIRS.get(t.text, "") if t.kind == "sign" else ""
            if t.kind == "template":
                shuts, opens = "`" * t.text.startswith("}"), "`" * (t.text.endswith("${") and not t.text.endswith("\\${"))
            if shuts:
                if stack and stack[-1][0] == shuts:
                    j = stack.pop()[1]
                    self.partner[i], self.partner[j] = j, i
                elif any(s == shuts for s, _ in stack):  # brackets in between were never closed
                    while stack[-1][0] != shuts:
                        stack.pop()
                    j = stack.pop()[1]
                    self.partner[i], self.partner[j] = j, i
            if opens:
                stack.append((opens, i))
        self.lines = [0]
        self.lines += [m.end() for m in re.finditer("\n", text)]

    def at(self, i: int, *texts: str) -> bool:
        """Whether the token is one of these names or signs."""
        return 0 <= i < len(self.tokens) and self.tokens[i].text in texts and self.tokens[i].kind in ("name", "sign")

    def is_kind(self, i: int, *kinds: str) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind in kinds

    def place(self, i: int) -> tuple[int, int, str]:
        """Line from 1, column from 0, and the trimmed line of a token."""
        import bisect

        begin = self.tokens[i].begin
        line = bisect.bisect_right(self.lines, begin)
        start = self.lines[line - 1]
        stop = self.lines[line] - 1 if line < len(self.lines) else len(self.text)
        return line, begin - start, self.text[start:stop].strip()

    def member_start(self, i: int) -> tuple[int, bool]:
        """Of a member expression whose dot or bracket is token i: its first token, and whether a link on the way is optional."""
        optional, j = self.at(i, "?."), i - 1
        while j >= 0:
            if self.at(j, ")", "]") and j in self.partner:
                k = self.partner[j]
                if self.at(k - 1, "?."):
                    optional, j = True, k - 2
                    continue
                before = k - 1
                if self._ends_value(before):
                    j = before
                    continue
                return self._with_new(k), optional
            if self.is_kind(j, "template"):
                while j in self.partner and self.tokens[j].text.startswith("}"):
                    j = self.partner[j]
                if self._ends_value(j - 1):
                    j -= 1
                    continue
                return self._with_new(j), optional
            if self.at(j - 1, ".", "?."):
                optional |= self.at(j - 1, "?.")
                j -= 2
                continue
            return self._with_new(j), optional
        return max(j, 0), optional

    def _with_new(self, j: int) -> int:
        return j - 1 if self.at(j - 1, "new") else j

    def _ends_value(self, j: int) -> bool:
        """Whether a bracket after token j is a call, an index or a tag of what ends there."""
        return self.is_kind(j, "name") and (self.tokens[j].text not in RESERVED or self.at(j - 1, ".", "?.")) or self.at(j, ")", "]") or self.is_kind(j, "template") and self.tokens[j].text.endswith("`")

    def template_end(self, i: int) -> tuple[int, list[str], int]:
        """Of a template that begins at token i: its last token, its raw pieces, how many substitutions."""
        pieces, holes = [self.tokens[i].text], 0
        while i in self.partner and self.tokens[i].text.endswith("${") and self.partner[i] > i:
            i = self.partner[i]
            pieces.append(self.tokens[i].text)
            holes += 1
        return i, pieces, holes

    def value_ends(self, i: int) -> bool:
        """Whether nothing goes on with the value that ends at token i."""
        if i + 1 >= len(self.tokens) or self.at(i + 1, ",", ";", ")", "}", "]"):
            return True
        later = "\n" in self.text[self.tokens[i].begin + len(self.tokens[i].text) : self.tokens[i + 1].begin]
        return later and self.is_kind(i + 1, "name", "string", "number") and not self.at(i + 1, "in", "instanceof", "as")


def string_value(token: Token) -> str:
    """What a string token stands for; an escape counts as one character."""
    body = token.text[1:-1] if len(token.text) > 1 and token.text[-1] == token.text[0] else token.text[1:]
    return ESCAPE.sub(lambda m: "" if m[0][1] in "\r\n" else m[0][1] if len(m[0]) == 2 else "?", body)


def assignments(s: Script, name: str = "innerHTML") -> list[tuple[int, int]]:
    """(first token, token of the name) of assignments, compound ones too, to a property of this name."""
    out = []
    for i, t in enumerate(s.tokens):
        if t.kind == "name" and t.text == name:
            plain = s.at(i - 1, ".") and s.at(i + 1, *ASSIGNS)
            index = s.at(i - 1, "[") and s.at(i + 1, "]") and s.at(i + 2, *ASSIGNS) and s._ends_value(i - 2)
            if plain or index:
                out.append((s.member_start(i - 1)[0], i))
    return out


def eval_calls(s: Script) -> list[int]:
    """Tokens of ``eval`` that are called by that name alone."""
    out = []
    for i, t in enumerate(s.tokens):
        if t.kind == "name" and t.text == "eval" and s.at(i + 1, "(") and not s.at(i - 1, ".", "?.", "function", "new", "*", "#"):
            shut = s.partner.get(i + 1)
            method = shut is not None and s.at(shut + 1, "{") and "\n" not in s.text[s.tokens[shut].begin : s.tokens[shut + 1].begin]
            if not method:
                out.append(i)
    return out


def random_calls(s: Script) -> list[tuple[int, int]]:
    """(first, last token) of calls of ``Math.random``."""
    return [(i, s.partner[i + 3]) for i in range(len(s.tokens)) if s.at(i, "Math") and not s.at(i - 1, ".", "?.") and s.at(i + 1, ".") and s.at(i + 2, "random") and s.at(i + 3, "(") and i + 3 in s.partner]


def imports(s: Script) -> list[tuple[int, str, list[str]]]:
    """(token, source, names) of import declarations: the default's name, imported names, ``* as name``."""
    out = []
    for i in range(len(s.tokens)):
        if not s.at(i, "import") or s.at(i - 1, ".", "?.") or s.at(i + 1, "(", "."):
            continue
        j, names = i + 1, []
        if s.at(j, "type", "typeof") and (s.at(j + 1, "{", "*") or s.is_kind(j + 1, "name") and not s.at(j + 1, "from") or s.at(j + 2, "from")):
            j += 1
        while j < len(s.tokens) and not s.is_kind(j, "string"):
            if s.at(j, "*") and s.at(j + 1, "as"):
                names.append(f"* as {s.tokens[j + 2].text}" if j + 2 < len(s.tokens) else "")
                j += 3
            elif s.at(j, "{"):
                shut = s.partner.get(j)
                if shut is None:
                    j = len(s.tokens)
                    continue
                fresh = True
                for k in range(j + 1, shut):
                    kind_word = s.at(k, "type") and s.is_kind(k + 1, "name") and not s.at(k + 1, "as")
                    if fresh and s.is_kind(k, "name") and not kind_word:
                        names.append(s.tokens[k].text)
                        fresh = False
                    elif fresh and s.is_kind(k, "string"):
                        fresh = False
                    fresh = fresh or s.at(k, ",")
                j = shut + 1
            elif s.at(j, "from", ",") and (s.at(j, ",") or s.is_kind(j + 1, "string")):
                j += 1
            elif s.is_kind(j, "name") and j == i + 1 or s.is_kind(j, "name") and s.at(j - 1, "type", "typeof"):
                names.append(s.tokens[j].text)
                j += 1
            else:
                j = len(s.tokens)
        if j < len(s.tokens):
            out.append((i, string_value(s.tokens[j]), [n for n in names if n]))
    return out


def query_calls(s: Script) -> list[int]:
    """First tokens of calls of a query method whose first argument is a template with substitutions and words of a query."""
    out = []
    for i, t in enumerate(s.tokens):
        if t.kind != "name" or t.text not in QUERIES:
            continue
        plain = s.at(i - 1, ".") and s.at(i + 1, "(")
        index = s.at(i - 1, "[") and s.at(i + 1, "]") and s.at(i + 2, "(") and s._ends_value(i - 2)
        first = i + 2 if plain else i + 3
        if not (plain or index) or not s.is_kind(first, "template") or not s.tokens[first].text.startswith("`"):
            continue
        last, pieces, holes = s.template_end(first)
        start, optional = s.member_start(i - 1)
        if holes and s.at(last + 1, ",", ")") and not optional and any(QUERY.search(p) for p in pieces):
            out.append(start)
    return out


def secrets(s: Script) -> list[int]:
    """Tokens of names that say secret and are declared, or are keys, with a string of more than ten characters that is no example."""

    def tells(name: int, value: int) -> bool:
        return s.is_kind(name, "name") and SECRET.search(s.tokens[name].text) is not None and s.is_kind(value, "string") and len(string_value(s.tokens[value])) > 10 and not EXAMPLE.search(string_value(s.tokens[value]))

    out = []
    for i in range(len(s.tokens)):
        if s.at(i, "const", "let", "var") and not s.at(i - 1, ".", "?."):
            out += [name for name, value in _declared(s, i + 1) if tells(name, value)]
        elif s.at(i, "{") and i in s.partner:
            j = i + 1
            while j < s.partner[i]:
                if s.at(j - 1, "{", ",") and s.at(j + 1, ":") and tells(j, j + 2) and s.at(j + 3, ",", "}"):
                    out.append(j)
                j = s.partner[j] + 1 if j in s.partner and s.partner[j] > j else j + 1
    return sorted(out)


def _declared(s: Script, j: int) -> list[tuple[int, int]]:
    """(name, string) of the declarators from token j on that are initialised by one string."""
    out = []
    while s.is_kind(j, "name") or s.at(j, "{", "["):
        name, j = j, s.partner.get(j, j) + 1
        depth_end = lambda k: s.at(k, ",", ";", ")", "}", "]")
        while j < len(s.tokens) and not s.at(j, "=") and not depth_end(j):  # an annotated type
            j = s.partner[j] + 1 if j in s.partner and s.partner[j] > j else j + 1
        if s.at(j, "="):
            if s.value_ends(j + 1):
                out.append((name, j + 1))
            j += 1
            while j < len(s.tokens) and not depth_end(j):
                ended = s.value_ends(j) and not s.at(j + 1, ",")
                j = s.partner[j] + 1 if j in s.partner and s.partner[j] > j else j + 1
                if ended:
                    break
        if not s.at(j, ","):
            break
        j += 1
    return out


def found(text: str, own: list[tuple[int, int, int]] | None = None) -> list[dict]:
    """All that the finders find, by place: finder, line, column, code, source and names of imports."""
    s, out = Script(text, own), []

    def put(finder: str, i: int, source: str | None = None, names: list[str] | None = None) -> None:
        line, column, code = s.place(i)
        out.append({"finder": finder, "line": line, "column": column, "code": code, "source": source, "names": names})

    for i, _ in assignments(s):
        put("innerHTML", i)
    for i in query_calls(s):
        put("sql", i)
    for i in eval_calls(s):
        put("eval", i)
    for i in range(len(s.tokens)):
        if s.at(i, "new") and not s.at(i - 1, ".", "?.") and s.at(i + 1, "Function") and not s.at(i + 2, ".", "[", "?."):
            put("eval", i)
    for i in secrets(s):
        put("secret", i)
    for i, source, names in imports(s):
        put("import", i, source, names)
    return sorted(out, key=lambda x: (x["line"], x["column"], x["finder"]))


def edits(text: str, kind: str, own: list[tuple[int, int, int]] | None = None) -> list[dict]:
    """The second way of fixing a script: what to put in place of which characters for a finding of this type."""
    s, out = Script(text, own), []

    def put(i: int, j: int, new: str) -> None:
        out.append({"begin": s.tokens[i].begin, "end": s.tokens[j].begin + len(s.tokens[j].text), "text": new})

    # The types that are mended so, and what replaces what.
    if kind == "innerHTML Assignment":
        for _, i in assignments(s):
            put(i, i, "textContent")
    elif kind == "eval() Usage":
        for i in eval_calls(s):
            put(i, i, "JSON.parse")
    elif kind == "Insecure Random (Math.random)":
        for i, j in random_calls(s):
            put(i, j, "crypto.randomBytes(8).toString('hex')")
        if out and not any(source == "crypto" for _, source, _ in imports(s)):
            top = text.index("\n") + 1 if text.startswith("#!") and "\n" in text else 0
            out.append({"begin": top, "end": top, "text": "import * as crypto from 'crypto';\n"})
    return sorted(out, key=lambda e: (e["begin"], e["end"]))
