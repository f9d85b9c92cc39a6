"""Spans against a character-by-character loop, finders and edits on hand-made scripts."""

import random

import pytest
from pyspark.sql import functions as F

from lintlake.functions import lexer, tokens
from lintlake.operators import remediate, scripts
from lintlake.operators.kernel import FINDING, scan
from lintlake.rules.catalogue import matched

KEYWORDS = {"return", "typeof", "instanceof", "case", "delete", "void", "throw", "new", "in", "of", "do", "else", "yield", "await"}
BREAKS = "\n\r  "


def in_word(c):
    return c not in BREAKS and (c.isalnum() or c in "_$" if c.isascii() else True)


def by_loop(t):
    """A letter for each character, one after the other, with an explicit stack of braces."""
    out, i, n, stack, free = [""] * len(t), 0, len(t), [], True

    def upto(j, letter):
        nonlocal i
        out[i:j] = letter * (j - i)
        i = j

    def template():
        while i < n:
            if t[i] == "\\":
                upto(min(i + 2, n), "t")
            elif t[i] == "`":
                upto(i + 1, "t")
                return False
            elif t[i : i + 2] == "${":
                upto(i + 2, "t")
                stack.append("hole")
                return True
            else:
                upto(i + 1, "t")
        return False

    while i < n:
        c, two = t[i], t[i : i + 2]
        if two == "//":
            upto(min([t.find(b, i) for b in BREAKS if b in t[i:]], default=n), "c")
        elif two == "/*":
            j = t.find("*/", i + 2)
            upto(n if j < 0 else j + 2, "c")
        elif c in "'\"":
            upto(i + 1, "s")
            while i < n and t[i] not in "\n\r":
                done = t[i] == c
                upto(min(i + (3 if t[i : i + 3] == "\\\r\n" else 2 if t[i] == "\\" else 1), n), "s")
                if done:
                    break
            free = False
        elif c == "`":
            upto(i + 1, "t")
            free = template()
        elif c == "/" and free:
            upto(i + 1, "r")
            inside = False
            while i < n and t[i] not in BREAKS:
                x = t[i]
                upto(i + 1, "r")
                if x == "\\" and i < n and t[i] not in BREAKS:
                    upto(i + 1, "r")
                elif x in "[]":
                    inside = x == "["
                elif x == "/" and not inside:
                    free = False
                    break
        elif c == "{":
            stack.append("brace")
            upto(i + 1, ".")
            free = True
        elif c == "}":
            hole = bool(stack) and stack.pop() == "hole"
            upto(i + 1, "t" if hole else ".")
            free = template() if hole else True
        elif two in ("++", "--"):
            upto(i + 2, ".")
        elif c in " \t\v\f" + BREAKS:
            upto(i + 1, ".")
        elif in_word(c):
            j, dotted = i, t[i - 1 : i] == "."
            while j < n and in_word(t[j]):
                j += 1
            free = t[i:j] in KEYWORDS and not dotted
            upto(j, ".")
        else:
            upto(i + 1, ".")
            free = c not in ")]\\"
    return "".join(out)


def by_table(texts):
    out = []
    for t, own in zip(texts, lexer.spans([t.encode() for t in texts]), strict=True):
        raw = t.encode()
        out.append("".join(".stcr"[k] * len(raw[a:z].decode()) for k, a, z in own))
    return out


def test_spans_of_fuzzed_texts_as_by_a_loop():
    rng = random.Random(11)
    bits = ["'", '"', "`", "${", "{", "}", "/", "//", "/*", "*/", "*", "\\", "\n", "\r\n", "\r", "[", "]", "(", ")", "a", "return", " ", "+", "++", "=", "é", " ", "x1", ".", "in", "$", ";"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(4000)]
    texts += ["".join(rng.choice(["`", "${", "{", "}", "a", "'"]) for _ in range(rng.randrange(60))) for _ in range(2000)]
    texts += ["".join(rng.choice(bits[:17]) for _ in range(3000)), "`${ {a: `${ {b: {c: 1}} }`} }` / 2 " * 60, ""]
    assert by_table(texts) == [by_loop(t) for t in texts]
    assert by_table(texts[:50]) == [by_table([t])[0] for t in texts[:50]]  # texts lexed together do not touch each other


def test_states_of_blocks_are_chained():
    cls = lexer.classes(b"a = `x${ /[/]'/.test(b) }'y` // z\n" * 500)
    state, want = lexer.FREE, []
    for c in cls.tolist():
        want.append(state)
        state = int(lexer.STEP[c, state])
    assert lexer.states(cls).tolist() == [*want, state]
    assert lexer.states(cls[:0], lexer.SQ).tolist() == [lexer.SQ]


def finds(text):
    return [(f["finder"], f["line"], f["column"]) for f in tokens.found(text)]


@pytest.mark.parametrize("text, want", [
    ("a.innerHTML = b.innerHTML = c", [("innerHTML", 1, 0), ("innerHTML", 1, 14)]), ("a.innerHTML == b; a.innerHTML => c; x = a.innerHTML", []), ("new Foo().innerHTML ||= 1", [("innerHTML", 1, 0)]), ("  f(a)[0]?.b(c).innerHTML\n = 1", [("innerHTML", 1, 2)]),
    ("foo[innerHTML] = 1; [innerHTML] = q", [("innerHTML", 1, 0)]), ("`a${b}`.innerHTML = 1", [("innerHTML", 1, 0)]), ("return this.el.innerHTML = 1", [("innerHTML", 1, 7)]), ("(a || b).innerHTML = 1", [("innerHTML", 1, 0)]), ("a.innerHTML", []), (".innerHTML = 1", [("innerHTML", 1, 0)]),
    ("eval?.(x); eval; new eval(x); x.eval(y); ({ eval(a) { } })", []), ("eval\n(a)\n{ }", [("eval", 1, 0)]), ("new Function.prototype.x()", []), ("a = /eval(x)/.test(b); eval(`${eval(c)}`)", [("eval", 1, 23), ("eval", 1, 31)]),
    ("db.query(`SELECT ${a}`.trim())", []), ("db.query(`select ${a}`)", [("sql", 1, 0)]), ("query(`SELECT ${a}`)", []), ("db.query(x, `SELECT ${a}`)", []), ("db.query(`hello ${a}`)", []), ("x(db.sql(`a \\${b} FROM`))", []),
    ("const token = 'abcdefghijk'", [("secret", 1, 6)]), ("const token = 'abcdefghij'", []), ("let x = f(1,\n 2), secret = 'abcdefghijkl'", [("secret", 2, 5)]), ("const { token = 'abcdefghijkl' } = x", []), ("token = 'abcdefghijkl'", []), ("var a = 1\ntoken = 'abcdefghijkl'", []),
    ("const password = 'abcdefghijkl' + x", []), ("({ 'token': 'abcdefghijkl', api_key: 'abc\\u0041defghij' })", [("secret", 1, 28)]), ("let apiKey: string | null = 'abcdefghijkl'", [("secret", 1, 4)]), ("const token = 'sample-abcdefgh'", []),
    ("import", []), ("import x", []), ("import {", []), ("import type from 'a'", [("import", 1, 0)]), ("import('a'); import.meta.url; x.import", []), ("import a, * as b from 'c'", [("import", 1, 0)]), ("", []), ("}}))]] `${", []), ("'", []),
])
def test_finders_on_hand_made_scripts(text, want):
    assert finds(text) == want


def test_names_of_imports():
    text = "import type from 'a'\nimport d, { default as e, type F, \"s\" as g, type as h } from \"b\\x41\"; import { } from 'c'; import type G from 'd'"
    assert [(f["source"], f["names"]) for f in tokens.found(text)] == [("a", ["type"]), ("b?", ["d", "default", "F", "type"]), ("c", []), ("d", ["G"])]


def test_spans_masks_and_places_as_columns(spark):
    rows = [(1, "javascript", "é = 'ü'; el.innerHTML = v // el.innerHTML = w"), (2, "javascript", None), (3, "typescript", ""), (4, "python", "el.innerHTML = v"), (5, "javascript", "x = `\n${ eval(a) }eval(b)`\n# eval(c)")]
    sources = spark.createDataFrame([(f"f{i}", lang, t, i, "p") for i, lang, t in rows], "file string, language string, text string, place_no int, begin string")
    told = {r.file: r for r in sources.select("file", scripts.script_spans("text").alias("s"), scripts.mask(F.col("text"), scripts.script_spans("text")).alias("m")).collect()}
    assert [tuple(s) for s in told["f1"].s] == [("code", 0, 4), ("string", 4, 7), ("code", 7, 26), ("comment", 26, 45)] and told["f2"].s is None and told["f3"].s == []
    assert told["f1"].m == "é =    ; el.innerHTML = v" + " " * 20 and told["f5"].m == "x =  \n   eval(a)" + " " * 10 + "\n# eval(c)"
    got = scripts.scan_scripts(sources, matched("xss"))
    assert sorted((r.file, r.rule_id, r.line, r.place) for r in got.collect()) == [("f1", "XSS-02", 1, "code"), ("f1", "XSS-02", 1, "comment"), ("f5", "XSS-13", 2, "code"), ("f5", "XSS-13", 2, "template"), ("f5", "XSS-13", 3, "code")]
    assert got.drop("place").count() == scan(sources, matched("xss")).count() and set(got.columns) == {*FINDING, "place_no", "begin", "place"}
    assert scripts.script_findings(sources).select("file", "finder", "line", "place_no").collect()[-1] == ("f5", "eval", 2, 5)


def test_spliced_changes(spark):
    rows = [(1, "abcdef", [(1, 2, "X"), (4, 6, "")]), (2, "abcdef", [(2, 5, "Z"), (2, 3, "no"), (4, 6, "no"), (0, 0, "<"), (6, 6, ">")]), (3, "aé😀b", [(2, 3, "y")]), (4, "abc", []), (5, None, [(0, 1, "x")])]
    frame = spark.createDataFrame(rows, "id int, t string, e array<struct<begin: int, end: int, text: string>>")
    assert dict(map(tuple, frame.select("id", scripts.spliced(F.col("t"), F.col("e"))).collect())) == {1: "aXcd", 2: "<abZf>", 3: "aéyb", 4: "abc", 5: None}


def test_fixes_only_in_code(spark):
    code = "el.innerHTML = v; // el.innerHTML = w\nlog('x.innerHTML = 1');"
    sql = "db.query(`SELECT ${a}`); // db.query(`SELECT ${b}`)"
    issues = spark.createDataFrame([(code, "innerHTML Assignment", "javascript"), (sql, "Template Literal SQL", "typescript"), ("verify=False # verify=False", "Disabled SSL Verification", "python"), ("// eval(x)", "eval() Usage", "javascript")], "code string, type string, language string")
    kept = {r.type: (r.fixed_code, r.method) for r in remediate.suggestions(issues, only_code=True).collect()}
    assert kept == {
        "innerHTML Assignment": ("el.textContent = v; // el.innerHTML = w\nlog('x.innerHTML = 1');", "template"), "Template Literal SQL": ("db.query('SELECT ?', [a]); // db.query(`SELECT ${b}`)", "template"),
        "Disabled SSL Verification": ("verify=True # verify=True", "template"), "eval() Usage": (None, "none"),
    }
    everywhere = {r.type: r.fixed_code for r in remediate.suggestions(issues).collect()}
    assert everywhere["eval() Usage"] == "// JSON.parse(x)" and "// el.textContent" in everywhere["innerHTML Assignment"]
