"""Operators against brute force, worked cases and properties."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from taxolink.operators import aggregate as A
from taxolink.operators import graph as G
from taxolink.operators import joins as J
from taxolink.operators import links as L
from taxolink.operators import match as M
from taxolink.operators import notes as NT
from taxolink.operators import ordered as O
from taxolink.operators import profile as P
from taxolink.operators import versions as V


def test_hierarchical_fill(spark):
    rows = [(1, "ID", "", "a"), (2, "", "AM", "b"), (3, "", "", ""), (4, "PR", None, "c"), (5, "", "AC", ""), (6, None, None, "d")]
    df = spark.createDataFrame(rows, "r long, f string, c string, s string")
    for parts in (1, 2, 7):
        got = O.hierarchical_fill(df, ["f", "c", "s"], "r", parts)
        want = [("ID", None, "a"), ("ID", "AM", "b"), ("ID", "AM", "b"), ("PR", None, "c"), ("PR", "AC", None), ("PR", "AC", "d")]
        assert [tuple(r)[1:] for r in got.orderBy("r").collect()] == want
        assert O.hierarchical_fill(got, ["f", "c", "s"], "r", parts).orderBy("r").collect() == got.orderBy("r").collect()


def test_forward_fill_is_the_plain_window(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice("ab"), rnd.choice([None, None, str(i)])) for i in range(300)]
    got = O.forward_fill(spark.createDataFrame(rows, "i long, k string, v string"), "v", "i", ["k"], 7).orderBy("i").collect()
    last = {}
    for (i, k, v), r in zip(rows, got, strict=True):
        last[k] = v or last.get(k)
        assert (r["i"], r["v"]) == (i, last[k])


@pytest.mark.parametrize("order", ["sparse", "text", "two columns"])
def test_ordered_by_anything(spark, order):
    """Order keys 10**9 apart, texts, and two columns give the rows of a plain window, with null keys, values of several types and one hot key."""
    rnd = random.Random(5)
    rows = [(i, rnd.choice(["hot", "hot", "b", None]), rnd.choice([None, None, None, f"v{i}"]), rnd.choice([None, None, float(i)])) for i in range(500)]
    key = {"sparse": F.col("i") * 10**9, "text": F.format_string("%05d", "i"), "two columns": F.floor(F.col("i") / 50)}[order]
    by = ["o", "i"] if order == "two columns" else ["o"]
    df = spark.createDataFrame(rows, "i long, k string, v string, x double").withColumn("o", key).withColumn("s", F.when(F.col("v").isNotNull(), F.struct("v", "x", F.timestamp_seconds("i").alias("t"))))
    for c, keys in (("v", []), ("s", ["k"]), ("x", ["k"])):
        w = Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
        want = [str(r) for r in df.withColumn(c, F.last(c, ignorenulls=True).over(w)).orderBy("i").collect()]
        for parts in (1, 9):
            assert [str(r) for r in O.forward_fill(df, c, by, keys, parts).orderBy("i").collect()] == want
    w = Window.orderBy(*by)
    want = [str(r) for r in df.withColumn("prev", F.lag(F.struct("k", "x")).over(w)).withColumn("next", F.lead(F.struct("k", "x")).over(w)).orderBy("i").collect()]
    for parts in (1, 9):
        assert [str(r) for r in O.neighbours(df, ["k", "x"], by, parts).orderBy("i").collect()] == want


def test_rows_about_ends(spark):
    """Keys 10**9 apart do not make partitions smaller: as many rows reach the driver as there are partitions, and partitions are about equal."""
    ranged = O.cut(spark.range(20_000).select((F.col("id") * 10**9).alias("o"), F.when(F.col("id") % 7 == 0, F.col("id")).alias("v")), "o", parts=8)
    assert len(O._ends(ranged, ["v"], [])) == 8
    assert ranged.groupBy("_p").count().agg(F.max("count")).first()[0] < 2 * 20_000 / 8


def test_header_pairs_and_last_row(spark):
    rows = [(1, "1", "T"), (2, "", "D"), (3, "x", "row"), (4, "y", "row"), (5, "2", "last")]
    for parts in (1, 2, 5):
        got = O.header_pairs(spark.createDataFrame(rows, "r long, c string, t string"), "c", "t", "r", parts).orderBy("r").collect()
        assert [(r["c"], r["head_title"], r["head_text"]) for r in got] == [("x", "T", "D"), ("y", "T", "D"), ("2", "T", "D")]


def test_keep_first_and_last(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 1, "z")], "k string, r long, v string")
    assert {(r["k"], r["v"]) for r in O.keep_first(df, ["k"], ["r"]).collect()} == {("a", "y"), (None, "z")}
    assert {(r["k"], r["v"]) for r in O.keep_last(df, ["k"], ["r"]).collect()} == {("a", "x"), (None, "z")}


WORDS = ["access control", "Access  Control policy", "audit", "audit log", "log audit!", "", " ", "policy", None, "access-control", "a.b", "(x"]


def brute(mode, t):
    import re

    tokens = lambda s: set(re.split(r"[\W_]+", s.strip().lower()))
    return {
        "exact": lambda a, b: a.strip() == b.strip(),
        "array-contains": lambda a, b: a.strip() in re.split(r"[,\s]+", b.strip()),
        "jaccard": lambda a, b: len(tokens(a) & tokens(b)) / len(tokens(a) | tokens(b)) >= t,
        "seqratio": lambda a, b: SequenceMatcher(None, a.strip().lower(), b.strip().lower()).ratio() >= t,
    }[mode]


@pytest.mark.parametrize("mode, t", [("exact", None), ("array-contains", None), ("jaccard", 0.3), ("jaccard", 0.5), ("jaccard", 1.0), ("seqratio", 0.4), ("seqratio", 0.8)])
def test_match_is_brute_force(spark, mode, t):
    df = spark.createDataFrame(list(enumerate(WORDS)), "id long, value string")
    got = M.match(df, df, mode, **({"threshold": t} if t else {})).select("left_id", "right_id").collect()
    want = [(i, j) for i, a in enumerate(WORDS) for j, b in enumerate(WORDS) if a is not None and b is not None and brute(mode, t)(a, b)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_match_regex_and_unknown(spark):
    df = spark.createDataFrame([(1, "^a"), (2, "LOG")], "id long, value string")
    values = spark.createDataFrame([(1, "audit log"), (2, "Log"), (3, None)], "id long, value string")
    assert sorted(map(tuple, M.match(df, values, "regex", flags="i").collect())) == [(1, 1), (2, 1), (2, 2)]
    with pytest.raises(ValueError):
        M.match(df, values, "other")


def test_match_regex_in_blocks(spark):
    """Many patterns are tested in several blocks with the same result as in one."""
    patterns = spark.createDataFrame([(i, f"^v{i}$|x{i % 7}y") for i in range(60)], "id long, value string")
    values = spark.createDataFrame([(i, f"v{i}") for i in range(80)] + [(100 + i, f"a x{i}y") for i in range(7)], "id long, value string")
    one, many = (sorted(map(tuple, M.match(patterns, values, "regex", block=n).collect())) for n in (1000, 9))
    assert one == many and len(one) == 120


@pytest.mark.parametrize("t", [0.6, 0.75])
def test_seqratio_of_a_table(spark, sf_dir, t):
    """The names of all parts, and odd ones, against each other: all pairs by brute force."""
    names = [r["p_name"] for r in spark.read.parquet(f"{sf_dir}/part.parquet").select("p_name").distinct().collect()] + ["", "a", "ÄÖ ÄÖ", "a" * 300, "İstanbul", "😀 part", "ALMOND Antique"]
    df = spark.createDataFrame([(n, n) for n in names], "id string, value string")
    got = {(r["left_id"], r["right_id"]): r["score"] for r in M.match(df, df, "seqratio", threshold=t).collect()}
    ratio = lambda a, b: SequenceMatcher(None, a.strip().lower(), b.strip().lower()).ratio()
    assert got == pytest.approx({(a, b): r for a in names for b in names if (r := ratio(a, b)) >= t})


def test_recommendation_of_documented_profiles(spark):
    """The published profiles of frameworks; where the tree says "2 or 3" the profiles decide, and one that the tree cannot reach (rare, without versioned chains) falls to 1."""
    rows = [
        ("800-53", "ad_hoc", "managed", "immutable", "structured_incomplete", "conservative", "incremental", "soft_delete", "submission_based", 3), ("CSF", "ad_hoc", "managed", "additive", "structured_incomplete", "conservative", "major", "soft_delete", "submission_based", 2),
        ("CIS", "ad_hoc", "unrestricted", "evolving", "prose_only", "radical", "incremental", "none", "delegated", 1), ("ATTACK", "biannual", "rare", "evolving", "structured_complete", "dynamic", "none", "versioned_chain", "self_maintained", 4),
        ("D3FEND", "continuous", "managed", "immutable", "structured_incomplete", "frozen", "none", "soft_delete", "self_maintained", 3), ("ENGAGE", "ad_hoc", "rare", "immutable", "structured_incomplete", "frozen", "none", "soft_delete", "delegated", 1),
        ("stable", "annual", "forbidden", "unstable", "structured_complete", "frozen", "none", "none", "delegated", 6),
    ]
    names = ["id", "release_cadence", "breaking_change_policy", "id_stability", "changelog_format", "hierarchy_stability", "scope_expansion", "deprecation_mechanism", "crosswalk_maintenance", "want"]
    got = V.recommend(spark.createDataFrame(rows, names)).collect()
    assert all(r["valid"] and r["scd_type"] == r["want"] for r in got)
    assert not V.recommend(spark.createDataFrame([("x", None, *rows[0][2:])], ", ".join(f"{n} {'int' if n == 'want' else 'string'}" for n in names))).first()["valid"]


def test_nearest_ties(spark):
    left = spark.createDataFrame([("q", "a b"), ("none", "zz")], "id string, value string")
    right = spark.createDataFrame([("a c",), ("a d",)], "value string")
    assert [tuple(r) for r in M.nearest(left, right, 0.3).collect()] == [("q", "a d", pytest.approx(1 / 3))]


def test_link_pass_both_is_symmetric(spark):
    s = spark.createDataFrame([("a",), ("b",)], "id string")
    t = spark.createDataFrame([("x",), ("y",)], "id string")
    pairs = J.mapping_pairs(spark.createDataFrame([(" a", "x "), ("b", "y"), ("b", "gone"), (None, "x"), ("c", "x")], "l string, r string"), "l", "r")
    e = J.link_pass(s, "id", t, "id", pairs, J.LinkPass("m", "S", "T")).select("src_id", "dst_id").collect()
    assert sorted(map(tuple, e)) == [("a", "x"), ("b", "y"), ("x", "a"), ("y", "b")]


def test_mapping_ids(spark):
    m = spark.createDataFrame([("PM-09", "AC-01"), ("M1", "D3-A [x](u)<br>D3-B [y](u)")], "l string, r string")
    assert ("PM-9", "AC-1") in set(map(tuple, J.mapping_pairs(m, "l", "r", normalize=True).collect()))
    assert {r["right_id"] for r in J.mapping_pairs(m, "l", "r", id_pattern=r"D3-[A-Z]+").collect()} == {"D3-A", "D3-B"}


def test_related_split_or_not(spark):
    df = spark.createDataFrame([("AC-1", "AC-2, AC-3"), ("AC-2", None)], "id string, r string")
    assert J.related(df, "id", "r").count() == 2
    assert J.related(df, "id", "r", split=False).count() == 1


def test_list_merge(spark):
    notes = spark.createDataFrame([("n", ["b", "a"]), ("m", None)], "path string, links array<string>")
    new = spark.createDataFrame([("n", ["c", "a"]), ("gone", ["x"])], "path string, links array<string>")
    flat = {r["path"]: r["links"] for r in A.merge_lists(notes, new, ["path"]).collect()}
    assert flat == {"n": ["a", "b", "c"], "m": []}
    deep = {r["path"]: r["links"] for r in A.merge_lists(notes, new, ["path"], nested=True).collect()}
    assert deep["n"] == [{"link": x} for x in ("b", "a", "c", "a")]


@pytest.mark.parametrize("values, want", [(["1", "0", "1"], "number"), (["yes", "no", "x", "no", "yes"], "boolean"), (["a,b", "c,d"], "array"), (["a", "1d"], "string"), ([], "string"), (["0x1", "Infinity", "1e2"], "number")])
def test_type_inference(spark, values, want):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([*values, ""])], "row long, v string")
    got = P.profile(df, "row").first()
    assert (got["type"], got["has_empty"], got["n_distinct"], got["samples"]) == (want, True, len(set(values)), values[:5])


def test_patterns_first_one_counts(spark):
    df = spark.createDataFrame([(i, f"AC-{i}", f"{i}.1", "x", "a,b") for i in range(30)], "row long, a string, b string, c string, d string")
    assert [(r["col"], r["pattern"]) for r in P.patterns(df, "row").orderBy("pos").collect()] == [("a", "control_id"), ("b", "cis_control"), ("d", "comma_list")]


def test_typed_link_forms(spark):
    text = '\n'.join(['fw.a:: [[AC-2|alias]] {"k": "v"}', 'fw.b:: [[AC-2]]', '[fw.c:: True]', '(fw.d:: 9)', '[fw.e:: [[AC-2]] {9}]', 'fw.f:: "quoted"', 'fw.g:: [text](AC-3)', 'plain text'])
    df = spark.createDataFrame([("n", text)], "path string, text string")
    got = {r["field"]: (r["target"], r["alias"], r["value"], r["json"]) for r in L.typed_links(df).collect()}
    assert got == {
        "fw.a": ("AC-2", "alias", None, {"k": "v"}), "fw.b": ("AC-2", None, "true", None), "fw.c": (None, None, "True", None), "fw.d": (None, None, "9", None),
        "fw.e": ("AC-2", None, "9", None), "fw.f": (None, None, "quoted", None), "fw.g": ("AC-3", "text", "true", None),
    }


def test_audit(spark):
    notes = spark.createDataFrame([("a.md", "[[AC-1]] [[AC 2 x|y]] [[zzz]]")], "path string, text string")
    nodes = spark.createDataFrame([("AC-1",), ("AC-2",)], "name string")
    got = {r["target"]: r["suggestion"] for r in L.audit(notes, nodes).collect()}
    assert got == {"AC 2 x": "AC-2", "zzz": None}


def test_frontmatter(spark):
    df = spark.createDataFrame([("---\na: 1\nb: 'x y'\nlist:\n  - q\n---\nbody\n---\nmore",), ("no header",)], "text string")
    a, b = L.split_note(df).withColumn("h", L.header_pairs(F.col("header"))).collect()
    assert (a["h"], a["body"]) == ({"a": "1", "b": "x y"}, "body\n---\nmore")
    assert (b["header"], b["body"]) == (None, "no header")


def test_composition_table(spark):
    make = lambda rel: spark.createDataFrame([("a", "b", rel, 0.5, None)], "left_id string, right_id string, relation string, confidence double, dated date")
    second = lambda rel: spark.createDataFrame([("b", "c", rel, 0.5, None)], "left_id string, right_id string, relation string, confidence double, dated date")
    for p, q, want in [("equal", "intersects", "intersects"), ("subset", "subset", "subset"), ("subset", "superset", "unknown"), ("none", "superset", "none"), ("superset", "none", "unknown")]:
        assert G.compose(make(p), second(q)).first()["relation"] == want


def test_reachable_to_the_end(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(12, 3)], "src_id long, dst_id long")
    starts = spark.createDataFrame([(0,)], "id long")
    hops = lambda *limit: {r["node"]: r["hops"] for r in G.reachable(spark, edges, starts, *limit).collect()}
    assert hops() == {i: i for i in range(13)}
    assert hops(4) == {i: i for i in range(5)}


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i != 20], "src_id long, dst_id long")
    nodes = spark.createDataFrame([(i,) for i in range(42)], "id long")
    got = {r["id"]: r["component"] for r in G.components(spark, edges, nodes).collect()}
    assert got == {i: 0 if i <= 20 else 21 if i <= 40 else 41 for i in range(42)}


def test_scd_and_rename(spark):
    h = spark.createDataFrame([(1, "a", "t0", None), (2, "b", "t0", None)], "k long, v string, valid_from string, valid_to string")
    new = spark.createDataFrame([(1, "a"), (2, "c"), (3, "d")], "k long, v string")
    got = V.scd2(h, new, "k", ["v"], F.lit("t1"))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, "a", "t0", None), (2, "b", "t0", "t1"), (2, "c", "t1", None), (3, "d", "t1", None)]))
    assert V.scd3(h.select("k", "v"), new, "k", "v").where("k = 2").first()["previous_v"] == "b"
    assert V.scd6(got, "k", ["v"]).where("valid_to is not null").first()["current_v"] == "c"
    assert V.as_of(got.withColumn("valid_from", F.col("valid_from")), F.lit("t0")).count() == 2
    gone = spark.createDataFrame([("x1", "access control"), ("x2", "audit")], "id string, value string")
    come = spark.createDataFrame([("y1", "Access control"), ("y2", "other")], "id string, value string")
    alias = spark.createDataFrame([("x2", "y2")], "old_id string, new_id string")
    assert sorted(map(tuple, V.renamed(gone, come, alias).collect())) == [("x1", "y1", "similar"), ("x2", "y2", "alias")]


def test_column_roles(spark):
    m = NT.from_roles([("L1", "hierarchy", ""), ("T", "title", ""), ("L2", "hierarchy", ""), ("A", "frontmatter", "a"), ("x", "skip", "")])
    assert (list(m.levels), m.title, m.frontmatter) == (["L1", "L2"], "T", {"A": "a"})


def test_write_plan_modes(spark):
    new = spark.createDataFrame([("p", "new", 1), ("p", "newer", 2), ("q", "new", 3)], "path string, body string, source_row long")
    old = spark.createDataFrame([("p", "old", 0)], "path string, body string, source_row long")
    for mode, body, status in (("skip", "old", "skipped"), ("replace", "newer", "replaced"), ("error", "old", "error")):
        notes, results = NT.write_plan(new, old, mode)
        assert {r["path"]: r["body"] for r in notes.collect()} == {"p": body, "q": "new"}
        assert {r["path"]: r["status"] for r in results.collect()} == {"p": status, "q": "created"}
    with pytest.raises(ValueError):
        NT.write_plan(new, old, "other")


def test_compare_columns(spark):
    a = spark.createDataFrame([("t", "Id"), ("t", "Name")], "tbl string, name string")
    b = spark.createDataFrame([("t", "ID"), ("t", "Extra")], "tbl string, name string")
    assert {(r["name"], r["status"]) for r in M.compare_columns(a, b).collect()} == {("Id", "matched"), ("Name", "missing"), ("Extra", "extra")}


def test_empty_tables(spark):
    e = spark.createDataFrame([], "r long, a string, b string")
    assert O.hierarchical_fill(e, ["a", "b"], "r").count() == 0
    assert O.header_pairs(e, "a", "b", "r").count() == 0
    assert P.profile(e, "r").count() == 0
    ids = e.select(F.col("a").alias("id"), F.col("b").alias("value"))
    for mode in M.MODES:
        assert M.match(ids, ids, mode).count() == 0


def test_values_in_one_pass(spark):
    """Links are parsed once, moved once by note, and their pattern is not run again for each group; null notes take no defaults."""
    text = 'fw:: [[A]] {"kind": "root", "w": "1"}\nfw.kind:: [[A]] "own"\nfw.w:: [[B|b]] {"w": "2"}\nfw.note:: "d"\nfw:: {"kind": "dk"}\nfw.x:: 9\nother.y:: true\n'
    notes = spark.createDataFrame([("n1", text), (None, 'fw.a:: [[A]] "1"\nfw.b:: "2"')], "path string, text string")
    got = L.merged_values(L.link_values(L.typed_links(notes)))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("regexp_extract_all") <= 2 and "regexp_extract(" not in plan
    rows = {(r["path"], r["framework"], r["target"]): r["props"] for r in got.collect()}
    assert rows == {("n1", "fw", "A"): {"kind": "own", "w": "1", "note": "d", "x": "9"}, ("n1", "fw", "B"): {"w": "2", "kind": "dk", "note": "d", "x": "9"}, (None, "fw", "A"): {"a": "1"}}
