"""Chains of mappings, one-to-one renames, restructures, timers and names, against brute force."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from taxolink.functions import names as N
from taxolink.operators import graph as G
from taxolink.operators import intervals as I
from taxolink.operators import joins as J
from taxolink.operators import match as M
from taxolink.operators import versions as V
from taxolink.streaming import jobs, keyed, timers

MAPPING = "left_id string, right_id string, relation string, confidence double"


def brute_chains(rows):
    base = {}
    for a, b, r, c in rows:
        if a and b and a != b and r in G.RELATIONS and c is not None and 0 <= c <= 1:
            base[a, b, r] = max(c, base.get((a, b, r), -1.0))
    best = {k: (-c, 1, ()) for k, c in base.items()}
    front = dict(best)
    while front:
        found = {}
        for (a, b, r), (n, hops, via) in front.items():
            for (x, y, s), c in base.items():
                rel = G.COMPOSED.get((r, s))
                if x == b and y != a and rel:
                    found[a, y, rel] = min(found.get((a, y, rel), (9.0,)), (n * c, hops + 1, (*via, b)))
        front = {k: v for k, v in found.items() if k not in best or v[0] < best[k][0]}
        best |= front
    return {(*k, round(-n, 9), hops, via) for k, (n, hops, via) in best.items()}


def test_chains_with_cycles(spark):
    """Cycles, hubs, mappings that repeat, unusable rows; a chain of 15."""
    r = random.Random(2)
    rows = [(r.choice("abcdefg"), r.choice("abcdefg"), r.choice(G.RELATIONS[:4]), r.choice([1.0, 0.9, 0.5, 0.25])) for _ in range(25)]
    rows += [(f"n{i}", f"n{i + 1}", "equal", 0.5) for i in range(15)] + [(None, "a", "equal", 1.0), ("a", "b", None, 1.0), ("a", "b", "equal", 2.0), ("a", "b", "likes", 1.0), ("a", "c", "equal", None)]
    got = G.derive(spark, spark.createDataFrame(rows + rows[:5], MAPPING)).collect()
    assert {(x["src_id"], x["dst_id"], x["relation"], round(x["confidence"], 9), x["hops"], tuple(x["via"])) for x in got} == brute_chains(rows)
    assert len(got) == len(brute_chains(rows)) and max(x["hops"] for x in got) == 15
    assert max(x["hops"] for x in G.derive(spark, spark.createDataFrame(rows, MAPPING), max_hops=4).collect()) == 4
    assert G.derive(spark, spark.createDataFrame([], MAPPING)).count() == 0


def test_chains_that_end_are_left_alone(spark, monkeypatch):
    """Layers: a round writes what it found, once; nothing that is known is written again, and no round runs where no chain can go on."""
    rows = [(f"n{i % 2}", f"c{i}", "equal", 0.9) for i in range(6)] + [(f"c{i % 6}", f"o{i}", G.RELATIONS[i % 4], 0.5 + i / 100) for i in range(20)]
    rows += [(f"o{i % 20}", f"p{i % 7}", G.RELATIONS[i % 3], 0.8) for i in range(60)]
    written, staged = [], G.staged
    monkeypatch.setattr(G, "staged", lambda s, df: written.append(df.columns) or staged(s, df))
    for few in (G.FEW_EDGES, 0):
        written.clear()
        monkeypatch.setattr(G, "FEW_EDGES", few)
        got = G.derive(spark, spark.createDataFrame(rows, MAPPING)).collect()
        assert {(x["src_id"], x["dst_id"], x["relation"], round(x["confidence"], 9), x["hops"], tuple(x["via"])) for x in got} == brute_chains(rows)
        assert len(written) == 3  # the mappings, chains of two hops and of three


def test_known_rows_of_other_starts_are_not_compared(spark, monkeypatch):
    """With many starts too, and with ends that are shared by more rows than a hash table may hold."""
    rows = [(1, 10 + i, "equal", 0.9) for i in range(6)] + [(10 + i % 6, 20 + i, G.RELATIONS[i % 4], 0.5 + i / 100) for i in range(20)] + [(20 + i % 20, 50 + i % 7, G.RELATIONS[i % 3], 0.8) for i in range(60)]
    plans, staged = [], G.staged
    monkeypatch.setattr(G, "staged", lambda s, df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or staged(s, df))
    monkeypatch.setattr(G, "FEW_EDGES", 0)
    for hot in (G.HOT_ROWS, 0):
        plans.clear()
        monkeypatch.setattr(G, "HOT_ROWS", hot)
        got = G.derive(spark, spark.createDataFrame(rows, MAPPING.replace("id string", "id long"))).collect()
        assert {(x["src_id"], x["dst_id"], x["relation"], round(x["confidence"], 9), x["hops"], tuple(x["via"])) for x in got} == brute_chains(rows)
        assert len(plans) == 3 and all("LeftSemi" in p for p in plans[1:])


def test_coded_ids_sort_as_text(spark):
    from taxolink.plans import derived_queries as D

    numbers = [0, 1, 10, 100, 12, 120, 2, 19, 9, 99, 999_999, 123_456_789_012, 10**14, 10**15 - 1]
    df = spark.createDataFrame([(a, n) for a in "NCOP" for n in numbers], "a string, n long")
    coded = F.coalesce(*(F.when(F.col("a") == a, D._coded(a, F.col("n"))) for a in "NCOP"))
    got = df.select(F.concat("a", "n").alias("text"), coded.alias("code")).select("*", D._text(F.col("code")).alias("back")).collect()
    assert all(x["back"] == x["text"] for x in got) and len({x["code"] for x in got}) == len(got)
    for a in "NCOP":
        assert [x["text"] for x in sorted(got, key=lambda x: x["code"]) if x["text"][0] == a] == sorted(x["text"] for x in got if x["text"][0] == a)
    assert spark.range(1).select(D._coded("C", F.lit(None).cast("long")).alias("c")).first()["c"] is None
    for bad in (-1, 10**15):
        with pytest.raises(Exception, match="digits"):
            spark.createDataFrame([(bad,)], "n long").select(D._coded("C", F.col("n"))).collect()


def test_four_frameworks(spark):
    """Tables of the shape CRI, CSF, 800-53, ATT&CK: a relation that is known only through two hubs, and what rests on each hub."""
    rows = [("CRI-1", "CSF-1", "equal", 1.0), ("CRI-2", "CSF-1", "subset", 0.8), ("CSF-1", "AC-2", "subset", 0.5), ("CSF-1", "AC-3", "intersects", 1.0), ("AC-2", "T1078", "subset", 0.9), ("AC-3", "T1078", "equal", 0.1)]
    derived = G.derive(spark, spark.createDataFrame(rows, MAPPING))
    far = {(x["src_id"], x["relation"]): (round(x["confidence"], 6), x["via"]) for x in derived.where("dst_id = 'T1078' and hops = 3").collect()}
    assert far == {("CRI-1", "subset"): (0.45, ["CSF-1", "AC-2"]), ("CRI-1", "intersects"): (0.1, ["CSF-1", "AC-3"]), ("CRI-2", "subset"): (0.36, ["CSF-1", "AC-2"])}
    assert {x["via"]: x["n_derived"] for x in G.blast_radius(derived).collect()} == {"CSF-1": 6, "AC-2": 3, "AC-3": 2}


def test_one_to_one(spark):
    r = random.Random(7)
    for n in (0, 200):
        pairs = {(f"o{r.randrange(30)}", f"n{r.randrange(30)}"): r.choice([0.8, 0.9, r.random()]) for _ in range(n)}
        got = {(x["old_id"], x["new_id"]) for x in V.one_to_one(spark.createDataFrame([(*k, s) for k, s in pairs.items()], "old_id string, new_id string, score double")).collect()}
        want, old, new = set(), set(), set()
        for s, o, m in sorted((-s, o, m) for (o, m), s in pairs.items()):
            if o not in old and m not in new:
                want.add((o, m))
                old.add(o)
                new.add(m)
        assert got == want


def test_no_new_id_twice(spark):
    """Two removed parts with the same title, one added; properties tell; aliases go first, and once."""
    side = lambda *rows: spark.createDataFrame(rows, "id string, value string, owner string, level int")
    none = spark.createDataFrame([], "old_id string, new_id string")
    old, new = side(("p1", "Access Control", "a", 1), ("p2", "access-control", "b", 2)), side(("q1", "Access control", "b", 2))
    assert [tuple(x) for x in V.renamed(old, new, none, 0.8).collect()] == [("p1", "q1", "similar")]
    assert [tuple(x) for x in V.renamed(old, new, none, 0.8, ["owner", "level"]).collect()] == [("p2", "q1", "similar")]
    aliases = spark.createDataFrame([("p1", "q1"), ("p2", "q1"), ("gone", "q1")], "old_id string, new_id string")
    assert [tuple(x) for x in V.renamed(old, new, aliases, 0.8).collect()] == [("p1", "q1", "alias")]
    assert V.renamed(old, side(("q1", "Access control", None, None)), none, 0.8, ["owner", "level"]).count() == 0


def test_restructured(spark):
    pairs = [("a", "x"), ("b", "x"), ("c", "y"), ("c", "z"), ("d", "u"), ("d", "v"), ("e", "u"), ("f", "w"), ("f", "w"), ("g", "t"), ("h", "t"), (None, "t")]
    got = V.restructured(spark, spark.createDataFrame(pairs, "old_id string, new_id string"), spark.createDataFrame([("g",), ("f",)], "old_id string"))
    assert {x["component"]: tuple(x)[1:] for x in got.collect()} == {"a": ("merge", 2, 1, 2, 0), "c": ("split", 1, 2, 2, 0), "d": ("restructure", 2, 2, 3, 0), "f": ("rename", 1, 1, 1, 1), "g": ("restructure", 2, 1, 2, 1)}


def test_parts_do_not_pass_through_the_driver(spark, monkeypatch):
    """No join of the parts of a graph, nor of any round that finds them, is a broadcast, however small its sides are."""
    plans, real = [], type(spark.range(1)).checkpoint
    monkeypatch.setattr(type(spark.range(1)), "checkpoint", lambda df, *a: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, *a))
    got = V.restructured(spark, spark.range(40).selectExpr("id as old_id", "id div 2 as new_id"), spark.range(3).selectExpr("id as old_id"))
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 2 and not any("Broadcast" in p for p in plans)
    assert {(r["kind"], r["n_moved"]) for r in got.collect()} == {("merge", 2), ("restructure", 1), ("merge", 0)} and got.count() == 20


def test_timers(spark, tmp_path):
    """Without a further record evidence goes fresh, stale, expired as the watermark passes; a newer record starts again, an older one changes nothing."""
    day = lambda n: date(2024, 1, 1) + timedelta(n)
    at = lambda n: datetime(2024, 1, 1, 12) + timedelta(n)
    schema = "k string, ts timestamp, collected date, expires date"
    batches = [
        [("a", at(0), day(0), day(60)), ("b", at(0), day(0), day(60)), ("n", at(0), day(0), None), ("x", None, day(0), day(1))],
        [("clock", at(35), None, None)],
        [("b", at(36), day(36), day(200)), ("a", at(-3), day(0), day(500))],
        [("clock", at(70), None, None)],
        [("clock", at(300), None, None)],
    ]
    src, out = str(tmp_path / "in"), f"file://{tmp_path}/out"
    before = spark.conf.get(timers._STORE, None)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = jobs.file_stream(spark, src, spark.createDataFrame([], schema).schema)
        timers.run_timeline(timers.freshness_timeline(stream, "k", "collected", "expires", "ts"), out, f"{out}-checkpoint").awaitTermination()
    assert spark.conf.get(timers._STORE, None) == before
    got = spark.read.option("basePath", out).parquet(out).where("k <> 'clock'").select("k", "freshness", F.date_format("changed", "MM-dd HH").alias("t")).collect()
    night = lambda n: f"{day(n):%m-%d} 00"
    noon = lambda n: f"{day(n):%m-%d} 12"
    want = {("a", "fresh", noon(0)), ("a", "stale", night(30)), ("a", "expired", night(61)), ("b", "fresh", noon(0)), ("b", "stale", night(30)), ("b", "fresh", noon(36)), ("b", "stale", night(170)), ("b", "expired", night(201)), ("n", "not-set", noon(0))}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_names_are_unique(spark):
    one = lambda *names: N.rename(spark.range(1).selectExpr(*(f"1 as `{n}`" for n in names)), "lowercase").columns
    assert one("a", "a_2", "A") == ["a", "a_2", "a_3"]
    assert one("a", "A", "a_2") == ["a", "a_3", "a_2"]
    assert one("B", "b", "b ") == ["b", "b_2", "b "]


def test_hot_ids_are_reduced_first(spark):
    """One id in a third of the links and more: the right sides of the anti-joins hold every id once."""
    nodes = spark.range(100).selectExpr("id as node_id")
    edges = spark.range(30_000).selectExpr("id as src_id", "if(id % 3 > 0, 7, id % 50) as dst_id")
    assert {r["node_id"] for r in G.orphans(nodes, edges).collect()} == set(range(50, 100)) | {i for i in range(50) if not any(x % 3 == 0 and x % 50 == i for x in range(300)) and i != 7}
    assert {r["id"] for r in J.unmapped(nodes, "node_id", edges.selectExpr("dst_id as left_id")).collect()} == {r["node_id"] for r in G.orphans(nodes, edges).collect()}
    for plan in (G.orphans(nodes, edges), J.unmapped(nodes, "node_id", edges.selectExpr("dst_id as left_id"))):
        assert plan._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") >= 1


def test_intervals(spark):
    """A tree 1,000 deep with branches, cut into few and many partitions: subtrees and sums as by closure; null amounts count 0."""
    r = random.Random(3)
    paths = [[f"{i:04d}" for i in range(n + 1)] for n in range(1000)]
    for n in range(300):
        paths.append([*r.choice(paths)[: r.randrange(1, 900)], f"x{n}"])
    nodes = spark.createDataFrame([(p[-1], p, r.choice([None, 1, 2, 5])) for p in paths], "node_id string, path array<string>, n int").repartition(7)
    want = {x["ancestor"]: (x["nodes"], x["n"]) for x in G.closure(nodes).join(nodes.select("node_id", "n"), "node_id").groupBy("ancestor").agg(F.count("*").alias("nodes"), F.sum(F.coalesce("n", F.lit(0))).alias("n")).collect()}
    for parts in (1, 9):
        labels = I.intervals(nodes, amount="n", parts=parts)
        got = labels.collect()
        assert {x["node_id"]: (x["last"] - x["pre"] + 1, x["total"]) for x in got} == want
        assert sorted(x["pre"] for x in got) == list(range(1300))
    some = spark.createDataFrame([("0500",), ("x7",)], "id string")
    subtree = {(x["root"], x["node_id"]) for x in I.below(labels, some).collect()}
    assert subtree == {(x["ancestor"], x["node_id"]) for x in G.closure(nodes).where("ancestor in ('0500', 'x7')").collect()}
    assert I.intervals(nodes.limit(0)).count() == 0


def test_intervals_of_forests(spark):
    """Several roots, an ancestor without a row, amounts that are no whole numbers."""
    rows = [("a", ["a"], 0.5), ("b", ["a", "b"], 1.0), ("d", ["a", "c", "d"], 2.0), ("e", ["e"], 4.0)]
    got = I.intervals(spark.createDataFrame(rows, "node_id string, path array<string>, n double"), amount="n", parts=3).collect()
    assert {x["node_id"]: (x["depth"], x["pre"], x["last"], x["total"]) for x in got} == {"a": (1, 0, 2, 3.5), "b": (2, 1, 1, 1.0), "d": (3, 2, 2, 2.0), "e": (1, 3, 3, 4.0)}


def test_ingest_by_state(spark, tmp_path):
    """New keys only, the first row of each; a small batch looks up its own keys, though 5,000 are known."""
    src, out = str(tmp_path / "in"), f"file://{tmp_path}/out"
    schema = "k string, o int, v string"
    looked_up = []
    for rows in ([(f"k{i}", 1, "a") for i in range(5000)], [("k7", 0, "b"), ("new", 2, "x"), ("new", 1, "y"), (None, None, "n"), (None, 3, "m")], [("new", 0, "z"), (None, 0, "q")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        run = keyed.ingest_by_state(jobs.file_stream(spark, src, spark.createDataFrame([], schema).schema), out, "k", ["o"], f"{out}-checkpoint")
        run.awaitTermination()
        looked_up.append(sum(p["stateOperators"][0]["customMetrics"]["rocksdbGetCount"] for p in run.recentProgress if p["stateOperators"]))
    got = keyed.ingested_rows(spark, out, spark.createDataFrame([], schema).schema).collect()
    assert len(got) == 5002 and {(r["k"], r["v"]) for r in got if r["k"] is None or r["k"] in ("k7", "new")} == {("k7", "a"), ("new", "y"), (None, "m")}
    assert looked_up[0] >= 5000 and looked_up[1] < 100 and looked_up[2] < 100


def test_positions_bound_the_overlap(spark):
    """The same pairs as brute force, from fewer candidates than by prefixes alone; one word is in every text."""
    r = random.Random(11)
    words = ["the", *(f"w{i}" for i in range(30))]
    rows = [(i, " ".join({"the", *r.sample(words, r.randint(1, 9))})) for i in range(250)] + [(-1, ""), (-2, None)]
    df = spark.createDataFrame(rows, "id int, value string")
    sets = {i: set(v.split()) for i, v in rows if v}
    for t in (0.5, 0.8):
        got = {(x["left_id"], x["right_id"]) for x in M.match(df, df, "jaccard", threshold=t).collect()}
        want = {(i, j) for i, a in sets.items() for j, b in sets.items() if len(a & b) >= t * len(a | b) - 1e-12}
        assert {p for p in got if -1 not in p} == want
        a, b = (M._tokens(df.select(F.col("value").alias(n)).where(f"{n} <> ''"), n) for n in ("left", "right"))
        few, many = (M._near(spark, a, b, t, positions).count() for positions in (True, False))
        assert few < many


def test_csv_blocks_disk(spark, sf_dir, tmp_path, monkeypatch):
    """The files grow with the rows, not with 4,000 bytes a row, and rows are still numbered through."""
    from taxolink.plans import derived_queries as D

    monkeypatch.setattr(D.G, "shared_root", lambda spark: f"file://{tmp_path}/out")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate")
    orders.crossJoin(spark.range(40).withColumnRenamed("id", "i")).selectExpr("o_orderkey * 40 + i as o_orderkey", "o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    got = D.csv_blocks(spark, str(tmp_path)).groupBy("year").agg(F.count("*").alias("n"), F.min("source_row").alias("a"), F.max("source_row").alias("b"), F.count_distinct("source_row").alias("d")).collect()
    assert all(r["a"] == 1 and r["b"] == r["d"] == r["n"] for r in got) and sum(r["n"] for r in got) == 40 * orders.count()
    assert 50e6 < sum(f.stat().st_size for f in tmp_path.glob("out/**/*.txt")) < 80e6


def test_configs_go_to_all_tasks(spark):
    """Tables meet few configs by broadcast, so that no task holds all tables of one config."""
    from taxolink.operators import profile as P

    one = lambda name, key: spark.createDataFrame([(k, ["a", "b"], ["a", "b"], 2, "s", "x*") for k in name], f"{key} string, names array<string>, normal array<string>, n_columns int, source_type string, file_pattern string")
    configs = one(["c", "d"], "config").withColumn("last_used", F.lit("2024-01-01").cast("date"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = P.match_configs(one(["t", "u"], "tbl"), configs, F.lit("2024-01-02").cast("date"))
        assert got._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") == 2
        assert {tuple(r) for r in got.collect()} == {(t, c, 70) for t in "tu" for c in "cd"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_partitions_by_rows(spark):
    """Rows that compress well are dealt by their number; results are the same."""
    assert [J.parts(n) for n in (0, 1, J.TASK_ROWS, J.TASK_ROWS + 1)] == [1, 1, 1, 2]
    edges = spark.range(1000).selectExpr("'a' as src_fw", "id % 10 as src_id", "'b' as dst_fw", "id % 3 as dst_id")
    assert [tuple(r) for r in J.link_counts(edges, distinct=True, n_parts=7).collect()] == [("a", 30)]
    history = spark.createDataFrame([(1, "x", 1, None), (2, "y", 1, None), (2, "z", 0, 1)], "k int, s string, valid_from int, valid_to int")
    new = spark.createDataFrame([(1, "w"), (3, "v")], "k int, s string")
    rows = lambda *n: sorted(map(tuple, V.scd6(V.scd2(history, new, "k", ["s"], F.lit(2), *n), "k", ["s"], *n).select("k", "s", "valid_from", F.coalesce("valid_to", F.lit(-1)), F.coalesce("current_s", F.lit(""))).collect()))
    assert rows(5) == rows() and len(rows(5)) == 5


def test_reachable_from_many_starts(spark, monkeypatch):
    """Edges of few nodes go to all tasks, those of many are shuffled; both give the same."""
    edges = spark.createDataFrame([*((f"s{i}", f"m{i % 3}") for i in range(200)), ("m0", "top"), ("m1", "top"), ("m2", "top"), ("top", "top")], "src_id string, dst_id string")
    starts = spark.createDataFrame([(f"s{i}",) for i in range(200)], "id string")
    rows = lambda: sorted(map(tuple, G.reachable(spark, edges, starts).collect()))
    few = rows()
    monkeypatch.setattr(G, "FEW_EDGES", 0)
    assert few == rows() and len(few) == 600
