"""Mode ``regex``: what patterns ask for, the plan by trigrams against all pairs, and patterns that are none."""

import random
import re

import pytest

from taxolink.operators import match as M
from taxolink.operators import regex_index as X


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        ("^ab", []), ("abc", [["abc"]]), ("^Foo bar$", [["foo"], ["oo "], ["o b"], [" ba"], ["bar"]]), ("a.cdef", [["cde"], ["def"]]), ("abcd?e", [["abc"]]), ("abcd+e", [["abc"], ["bcd"]]), ("abc*", []), ("(abc)?def", [["def"]]),
        ("(abc)+def", [["abc"], ["def"]]), ("(?:foo|bar)baz", [["bar", "foo"], ["baz"]]), ("foo|ba", []), ("foo|bar", [["bar", "foo"]]), (r"foo\.bar", [["foo"], ["oo."], ["o.b"], [".ba"], ["bar"]]), (r"foo\d{3}bar", [["foo"], ["bar"]]),
        ("[abc]foo", [["foo"]]), ("[]a]foo", []), ("[a&&b]foo", []), ("(?i)FOO", [["foo"]]), ("(?iu)FOO", []), ("(?x)f o o", []), ("foo(?=bar)", []), (r"\Qfoo\E", []), (r"foo\1", []), ("abc{2}d", [["abc"]]), ("abc{0,2}d", []), ("foo(", []), ("foo)", []), ("", []),
        ("É漢字x", [["É漢字"], ["漢字x"]]),
    ],
)
def test_covers(pattern, want):
    assert X.covers(pattern) == sorted({tuple(sorted(c)) for c in want})


def some_pattern(r):
    part = lambda: r.choice(["foo", "Bar", "ba", "z", ".", r"\.", r"\d", "[a-c]", "[^x]", "(foo|bar)", "(?:ab|cde)+", "q?", "o{2}", "(z(oo|ee)k)?", "^", "$", " ", "é"])
    text = "".join(part() for _ in range(r.randint(1, 5)))
    return r.choice(["", "", "(?i)"]) + (text if r.random() < 0.8 else f"{text}|{part()}{part()}")


def test_same_as_all_pairs(spark):
    r = random.Random(4)
    patterns = [(i, r.choice([some_pattern(r), some_pattern(r), "a(", "[", "*x", None])) for i in range(400)]
    values = [(i, "".join(r.choice(["foo", "FOO", "bar", "Ba", "z", "zook", ".", "7", "cde", "ab", " ", "é", "É", "oo"]) for _ in range(r.randint(0, 5)))) for i in range(200)] + [(-1, None)]
    left, right = spark.createDataFrame(patterns, "id int, value string"), spark.createDataFrame(values, "id int, value string")
    want = set()
    for i, p in patterns:
        try:
            found = p is not None and re.compile(p.strip(), re.ASCII)  # cases and classes as in Java
        except re.error:
            continue
        want |= {(i, j) for j, v in values if found and v is not None and found.search(v.strip())}
    assert X.covers(r"foo\b") == [("foo",)]  # borders of words differ between the two, so they are not compared here
    for options in ({"few": 0}, {"few": 1000}, {"few": 0, "block": 20}):
        got = [tuple(x) for x in M.match(left, right, "regex", **options).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert len(want) > 500
    bad = {(x["id"], x["value"]) for x in M.invalid_patterns(left).collect()}
    assert bad == {(i, p) for i, p in patterns if p in ("a(", "[", "*x")}


def test_flags_and_nothing(spark):
    left, right = spark.createDataFrame([(1, "FOO"), (2, "a(")], "id int, value string"), spark.createDataFrame([(7, "a foo")], "id int, value string")
    assert [tuple(x) for x in M.match(left, right, "regex", flags="i", few=0).collect()] == [(1, 7)]
    assert M.match(left.where("id = 2"), right, "regex").count() == 0
    assert M.match(left, right.limit(0), "regex", few=0).count() == 0


def test_many_patterns(spark):
    """100,000 patterns and 20,000 values: each pattern is tried on a few values, not on all."""
    patterns = spark.range(100_000).selectExpr("id", "concat('^item ', id % 1000, ' of box ', id, '$') as value")
    values = spark.range(20_000).selectExpr("id", "concat('item ', id % 1000, ' of box ', id) as value")
    got = M.match(patterns, values, "regex")
    assert got.where("left_id = right_id").count() == got.count() == 20_000


def test_long_grams():
    """Longer runs have covers of their own; what is certain stays certain."""
    assert X.covers("^Ab#0*12345$", X.SIZES) == [("123",), ("12345",), ("234",), ("345",), ("ab#",)]
    assert X.covers("(abcde|xyz)", X.SIZES) == [("abc", "xyz")]


def test_patterns_that_are_alike_are_not_broadcast(spark):
    """Patterns that compress well reach no broadcast, and few values are tried for each."""
    n = 30_000
    patterns = spark.range(n).selectExpr("id", "concat('Customer#0*', 100000 + id, '$') as value")
    values = spark.range(n).selectExpr("id", "concat('Customer#000', 100000 + id) as value")
    got = M.match(patterns, values, "regex")
    assert got.where("left_id = right_id").count() == got.count() == n
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
