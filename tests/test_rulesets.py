"""Rules from a table: equal to the list of rules, complete for patterns with few literals or none, plans without nested loops."""

from collections import Counter

import pytest

from lintlake.functions.regex import one_line, required, whole_words
from lintlake.operators import kernel, rulesets
from lintlake.plans.corpus import CODE, DOCKERFILE, TERRAFORM, corpus
from lintlake.rules.catalogue import CODE as SCANNERS
from lintlake.rules.catalogue import Rule, matched

SMALL = "/root/testdata/sf0.001"
TEXTS = [
    ("a", "javascript", "x = foo(1);\nBar baz\n# é ü"), ("b", "python", "# foo\nfoo_bar FOO"), ("c", None, "Straße €5 İstanbul 12-34"), ("d", "dockerfile", "FROM foo"), ("e", "go", None), ("f", "go", ""),
    ("g", "go", "a.b.c(d)\nK kelvin BAZBAR" + " pad" * 500),
]
PATTERNS = [
    ("none", r"\d+-\d+", ""), ("short", r"\(\w\)", ""), ("letters", "ba|Ba", ""), ("fold", "bazbar|foo_", "i"), ("case", "FOO", ""), ("euro", "€5", ""), ("sharp", "straße", "i"), ("dot", r"^FROM\s+f", "m"),
    ("long", "kelvin bazbar", "i"), ("set", "[fb]oo?", ""), ("maybe", "(?:foo)?bar", ""), ("twice", "foo", ""), ("star", "pad(?: pad)*", ""), ("empty", "", ""), ("look", "foo(?!_)", ""), ("dotted", r"a\.b\.c", ""),
]


def as_rules(patterns):
    return [Rule(i, i, "medium", p, f, (), "rules", None, None, 0, "m", "f", 7) for i, p, f in patterns]


def rows(frame, columns):
    return Counter(tuple(map(str, r)) for r in frame.select(*columns).collect())


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame([(*t, 5, "k") for t in TEXTS], "file string, language string, text string, extra long, key string")


def test_all_rules_of_the_catalogue_as_a_table(spark):
    texts, listed = corpus(spark, SMALL, (*CODE, *DOCKERFILE, *TERRAFORM)), matched(*SCANNERS, "dockerfile", "terraform")
    got = rulesets.scan_rules(texts, rulesets.as_table(spark, listed))
    assert rows(got, [*kernel.FINDING, "key"]) == rows(kernel.scan(texts, listed), [*kernel.FINDING, "key"])
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("block", [20_000, 4])
def test_odd_patterns_as_by_the_list(spark, sources, monkeypatch, block):
    monkeypatch.setattr(rulesets, "BLOCK", block)
    listed = as_rules(PATTERNS)
    table = rulesets.as_table(spark, listed)
    got = rulesets.scan_rules(sources, table.union(table.where("rule_id = 'twice'")))
    want = rows(kernel.scan(sources, listed), [*kernel.FINDING, "extra", "key"])
    assert rows(got, [*kernel.FINDING, "extra", "key"]) == want
    assert {k[3] for k in want} >= {"none", "short", "letters", "fold", "case", "euro", "set", "star"}


def test_least_columns_and_missing_values(spark, sources):
    table = spark.createDataFrame([("r", "foo", "i"), (None, "foo", None), ("s", None, None), ("t", "Bar", None)], "rule_id string, pattern string, flags string")
    got = rulesets.scan_rules(sources, table)
    assert Counter((r.file, r.rule_id, r.line, r.match, r.severity, r.type) for r in got.collect()) == Counter([("a", "r", 1, "foo", "medium", "r"), ("a", "t", 2, "Bar", "medium", "t"), ("b", "r", 2, "foo", "medium", "r"), ("b", "r", 2, "FOO", "medium", "r")])


def test_empty_tables(spark, sources):
    none = spark.createDataFrame([], "rule_id string, pattern string")
    assert rulesets.scan_rules(sources, none).count() == 0
    assert rulesets.scan_rules(sources.where("false"), rulesets.as_table(spark, as_rules(PATTERNS))).count() == 0


@pytest.mark.parametrize("pattern, want", [
    ("abc", [["abc"]]), ("a|bc", [["a", "bc"]]), ("a|", []), ("(?:ab)+c?", [["ab"]]), ("ab*", [["a"]]), ("x{2,}y{0,3}z", [["x"], ["z"]]), ("(?=ab)cd", [["cd"]]), ("(?<!ab)c", [["c"]]), ("[ab]c", [["a", "b"], ["c"]]),
    ("[^ab]c", [["c"]]), ("[a-c]d", [["d"]]), ("[a-]d", [["a", "-"], ["d"]]), (r"\x41B\n", [["AB\n"]]), (r"\w\d\bq", [["q"]]), (r"\p{Lu}q\k<n>", [["q"]]), (r"\cAq", [["q"]]), ("(a", []), ("a)", []), ("[ab", []), (r"a\.b", [["a.b"]]), ("", []),
])
def test_literals_that_a_match_must_hold(pattern, want):
    assert sorted(required(pattern)) == sorted(want)


def test_keys_of_literals():
    assert rulesets.grams_of("innerHTML") == ["innerht", "nerhtml", "nnerhtm"]
    assert rulesets.grams_of("a.bcd(") == ["bcd"] and rulesets.grams_of("a.b") == [".", "a", "b"] and rulesets.grams_of("é") == [""] and rulesets.grams_of("") == [""]


@pytest.mark.parametrize("pattern, flags, want", [
    (r"\bword[.,]", "", True), (r"^a$", "m", True), (r"^a$", "", False), ("a.b", "", True), ("a.b", "s", False), (r"a\sb", "", False), (r"[^a]b", "", False), (r"[^\sa]b", "", True), (r"[^\na]b", "", True), (r"[\s]b", "", False),
    (r"a(?!\n)", "", False), ("a(?![^b])", "", False), ("a(?!b)", "", True), (r"\x0a", "", False), ("a\nb", "", False), ("[\t-~]", "", False), (r"[\]x]b", "", True), (r"(?s:a.b)", "", False), (r"\Da", "", False), (r"a\Wb", "", False), ("[ab", "", False),
])
def test_patterns_that_stay_in_a_line(pattern, flags, want):
    assert one_line(pattern, flags) is want


@pytest.mark.parametrize("pattern, want", [
    (r"\bword\b", ["word"]), (r"\bword[.,]", ["word"]), (r"a\.b_c\.d", ["b_c"]), (r"^From\s+f", ["From"]), (r"\bword[.a]", []), (r"\bword\.?", []), (r"\bwords?\b", []), (r"\bwo+\b", []), (r"\b(?:foo)\b", []), (r"x|\bfoo\b", []), (r"(?:\bfoo\b)?x", []),
    (r"\bab\b\s*\bcd\b", ["ab", "cd"]), (r"\bfoo(?=x)", []), ("foo", []), (r"(\bfoo\b", []),
])
def test_words_that_are_whole_in_the_text(pattern, want):
    assert whole_words(pattern) == want


LINES = [
    ("a", "go", "foo bar\nx\n  // foo.\nfoo foo, FOO.\n\nfoo"), ("b", "go", "\u212afoo \u0130foo foo\u00e9\r\nfoo\r"), ("c", "go", "foobar foo_ 1foo\nfoo"), ("d", "go", "\ue000foo\n\n\ue002foo. x"), ("e", "go", "foo\nbar"), ("f", "xss", "\n\nbar\n"), ("g", "go", "Foo\u2028foo"),
]
OF_LINES = [("whole", r"\bfoo\b", ""), ("stop", r"\bfoo[.,]", "i"), ("fold", r"\bFOO\b", "i"), ("start", r"^foo", "m"), ("end", "foo$", "m"), ("over", r"foo\s+bar", ""), ("dot", "foo.*", ""), ("kelvin", "\u212afoo", "i"), ("both", "foo[^\\n]*bar", ""), ("not", r"foo[^x]bar", "")]


def test_lines_and_whole_words_as_by_the_list(spark):
    sources, listed = spark.createDataFrame(LINES, "file string, language string, text string"), as_rules(OF_LINES)
    got = rulesets.scan_rules(sources, rulesets.as_table(spark, listed))
    want = rows(kernel.scan(sources, listed), kernel.FINDING)
    assert rows(got, kernel.FINDING) == want and {k[3] for k in want} == {r[0] for r in OF_LINES}


LINE_BY_LINE = "x foo\nfoobar\ny\nfoo, foo\nz"


def test_patterns_run_over_the_lines_that_hold_the_literals(spark):
    texts = spark.createDataFrame([("a", "go", LINE_BY_LINE, None), ("b", "go", "foobar", None)], "file string, language string, text string, rest string")
    index = rulesets.index(rulesets.as_table(spark, as_rules([("in", r"\bfoo[.,]", ""), ("over", r"foo\sy", ""), ("none", r"\bfoo=", "")])))
    pairs = rulesets._candidates(texts, index.rules)
    assert sorted((r.file, r.rule_id) for r in pairs.collect()) == [("a", "in"), ("a", "none"), ("a", "over"), ("b", "over")]
    got = {(r.file, r.rule_id): (r.text, r.numbers) for r in rulesets._searched(pairs).collect()}
    assert got["a", "in"] == ("foo, foo", [4]) and got["a", "none"] == (None, []) and got["a", "over"] == (LINE_BY_LINE, None) and got["b", "over"] == (None, None)
