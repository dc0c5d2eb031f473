"""Hierarchies and link graphs: closure, roll-up, chains, integrity, coverage, composition (2.15)."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

#: Relations of a mapping and how two of them compose; every pair that is not here composes to ``unknown``.
RELATIONS = ("equal", "subset", "superset", "intersects", "none")
COMPOSED = {
    **{("equal", r): r for r in RELATIONS},
    **{(r, "equal"): r for r in RELATIONS},
    ("subset", "subset"): "subset",
    ("superset", "superset"): "superset",
    ("subset", "none"): "none",
    ("none", "superset"): "none",
}
#: Edges, or starts of chains, that are sent to all tasks, at most.
FEW_EDGES = 10_000
#: Hops after which the pairs seen so far are written as one table, so that plans of long chains stay small.
CUT_HOPS = 10


def closure(nodes: DataFrame, node: str = "node_id", path: str = "path") -> DataFrame:
    """``node_id, ancestor, distance`` from paths; every node is its own ancestor at distance 0."""
    return nodes.select(F.col(node).alias("node_id"), F.size(path).alias("_n"), F.posexplode(path).alias("_i", "ancestor")).select("node_id", "ancestor", (F.col("_n") - 1 - F.col("_i")).alias("distance"))


def roll_up(nodes: DataFrame, counts: DataFrame, node: str = "node_id", path: str = "path") -> DataFrame:
    """``ancestor, n``: the sum of ``counts(node_id, n)`` over each node and all below it."""
    return closure(nodes, node, path).join(counts, "node_id").groupBy("ancestor").agg(F.sum("n").alias("n"))


def level_totals(df: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Counts for every prefix of the level columns."""
    return df.rollup(*levels).agg(F.count("*").alias("n"))


def chain(first: DataFrame, *more: DataFrame) -> DataFrame:
    """``start, end, hops, n_paths`` over mapping tables ``(left_id, right_id)`` of fixed number.

    Paths to the same pair are counted after each hop, so the table has one row per pair, not per path.
    """
    got = first.groupBy(F.col("left_id").alias("start"), F.col("right_id").alias("end")).agg(F.count("*").alias("n_paths"))
    for step in more:
        s = step.groupBy("left_id", "right_id").agg(F.count("*").alias("m"))
        got = got.join(s, F.col("end") == F.col("left_id")).groupBy("start", "right_id").agg(F.sum(F.col("n_paths") * F.col("m")).alias("n_paths")).withColumnRenamed("right_id", "end")
    return got.withColumn("hops", F.lit(1 + len(more)))


def shared_folder(spark: SparkSession) -> None:
    """Checkpoints go where ``spark.checkpoint.dir`` says; a local folder is made only where it is unset and Spark runs in this process alone."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_root(spark))


def shared_root(spark: SparkSession) -> str:
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (root or "file://" + tempfile.mkdtemp(prefix="taxolink-")).rstrip("/")


def staged(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df`` written below the shared folder as columns, which are far smaller than the rows of ``checkpoint()``, and read back."""
    path = f"{shared_root(spark)}/taxolink-{uuid.uuid4().hex}/staged"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def reachable(spark: SparkSession, edges: DataFrame, starts: DataFrame, max_hops: int | None = None) -> DataFrame:
    """``start, node, hops``: the least number of hops from each start; cycles end as seen pairs are dropped.

    Goes on until no pair is new; only a caller that gives ``max_hops`` gets nodes up to that many hops away.
    Edges of up to ``FEW_EDGES`` that a round can use go to all tasks: many starts may stand at a few nodes, whose rows would meet in a few tasks otherwise.
    """
    shared_folder(spark)
    e = edges.select(F.col("src_id").alias("_s"), F.col("dst_id").alias("_d")).distinct()
    seen = front = starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).alias("hops")).distinct()
    for hop in count(1) if max_hops is None else range(1, max_hops + 1):
        ahead = e.join(front.select("node").distinct(), F.col("_s") == F.col("node"), "left_semi")
        if ahead.limit(FEW_EDGES + 1).count() <= FEW_EDGES:
            ahead = F.broadcast(ahead)
        else:
            ahead = e
        step = front.join(ahead, F.col("node") == F.col("_s")).select("start", F.col("_d").alias("node")).distinct()
        front = step.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("hops", F.lit(hop)).checkpoint()
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if hop % CUT_HOPS == 0:
            seen = seen.checkpoint()
    return seen


def components(spark: SparkSession, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, component``: the least id that each of ``nodes(id)`` is connected with, whatever the direction of ``edges(src_id, dst_id)``.

    In every round each node takes the least label around it, then its label's label, so a path of length n needs about log n rounds.
    Joins are merges by hint: ids and labels that are much alike are small where they are compressed, and would pass through the driver to be broadcast.
    """
    shared_folder(spark)
    pair = edges.select(F.col("src_id").alias("a"), F.col("dst_id").alias("b"))
    both = pair.unionByName(pair.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct().checkpoint()
    label = nodes.select("id", F.col("id").alias("component")).distinct()
    while True:
        around = both.join(label.hint("merge"), F.col("b") == F.col("id")).groupBy("a").agg(F.min("component").alias("near"))
        near = label.join(around.hint("merge"), F.col("id") == F.col("a"), "left").select("id", "component", F.least("component", F.coalesce("near", "component")).alias("low"))
        jump = near.join(near.select(F.col("id").alias("_i"), F.col("low").alias("_l")).hint("merge"), F.col("low") == F.col("_i"), "left")
        after = jump.select("id", F.col("component").alias("was"), F.least("low", F.coalesce("_l", "low")).alias("component")).checkpoint()
        label = after.select("id", "component")
        if after.where("was <> component").isEmpty():
            return label


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("node_id").alias("dst_id")), "dst_id", "left_anti")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that nothing links to.  Linked ids are reduced to one each first, as a hub may have very many links."""
    return nodes.join(edges.select(F.col("dst_id").alias("node_id")).distinct(), "node_id", "left_anti")


def asymmetric(edges: DataFrame) -> DataFrame:
    """Edges without their reverse."""
    e = edges.select("src_id", "dst_id").distinct()
    return e.join(e.select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id")), ["src_id", "dst_id"], "left_anti")


def stale(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges ``(src_id, dst_id, checked)`` older than the last change of an endpoint in ``nodes(node_id, changed)``."""
    end = lambda side: nodes.select(F.col("node_id").alias(side), F.col("changed").alias(f"{side}_changed"))
    got = edges.join(end("src_id"), "src_id", "left").join(end("dst_id"), "dst_id", "left")
    return got.where(F.col("checked") < F.greatest("src_id_changed", "dst_id_changed")).select(*edges.columns)


def coverage(nodes: DataFrame, edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group (and in all): nodes, nodes with a link, and their share."""
    linked = edges.select(F.col("dst_id").alias("node_id"), F.lit(1).alias("_l")).distinct()
    got = nodes.join(linked, "node_id", "left").rollup(*by).agg(F.count("*").alias("n_nodes"), F.count("_l").alias("n_linked"))
    return got.withColumn("share", F.round(F.col("n_linked") / F.col("n_nodes"), 6))


def matrix(edges: DataFrame, frameworks: Sequence[str]) -> DataFrame:
    """Links by source and target framework, one column per target."""
    return edges.groupBy("src_fw").pivot("dst_fw", list(frameworks)).count().fillna(0)


def _composed(first: Column, second: Column) -> Column:
    """The relation of two mappings in a row."""
    table = F.create_map(*(F.lit(x) for (p, q), r in COMPOSED.items() for x in (f"{p}>{q}", r)))
    return F.coalesce(F.try_element_at(table, F.concat_ws(">", first, second)), F.lit("unknown"))


def compose(first: DataFrame, second: DataFrame) -> DataFrame:
    """A -> C from A -> B -> C: ``src_id, dst_id, relation, confidence, via, dated`` from ``(left_id, right_id, relation, confidence, dated)``.

    Confidence is the product, the date the older one, and ``via`` the way it was derived.
    """
    b = second.select(F.col("left_id").alias("_hub"), F.col("right_id").alias("dst_id"), F.col("relation").alias("_r"), F.col("confidence").alias("_c"), F.col("dated").alias("_d"))
    got = first.join(b, F.col("right_id") == F.col("_hub"))
    return got.select(F.col("left_id").alias("src_id"), "dst_id", _composed(F.col("relation"), F.col("_r")).alias("relation"), (F.col("confidence") * F.col("_c")).alias("confidence"), F.col("right_id").alias("via"), F.least("dated", "_d").alias("dated"))


#: Rows that end at one entry, at most, for a join to keep the rows of a partition as a hash table; beyond it rows are sorted, and the entry can be split.
HOT_ROWS = 100_000


def _composed_codes(first: Column, second: Column) -> Column:
    """``_composed`` of codes: twice the place in ``RELATIONS``, and one more where the end of the (second) mapping has mappings of its own; null for ``unknown``."""
    place = {r: i for i, r in enumerate(RELATIONS)}
    codes = [2 * place[COMPOSED[p, q]] + on if (p, q) in COMPOSED else None for p in RELATIONS for _ in (0, 1) for q in RELATIONS for on in (0, 1)]
    return F.get(F.array(*(F.lit(c).cast("int") for c in codes)), first * (2 * len(RELATIONS)) + second)


def derive(spark: SparkSession, mappings: DataFrame, max_hops: int | None = None) -> DataFrame:
    """``src_id, dst_id, relation, confidence, hops, via``: everything that chains of ``mappings(left_id, right_id, relation, confidence)`` of any length say.

    A chain's relation is composed from left to right and must be known at every step; its confidence is the product.  Of all chains with one start, end and relation the
    most confident counts, of equal ones the shortest, then the one with the smallest ``via``, which lists the entries between.  Mappings themselves are chains
    of one hop.  Chains do not end where they start; ids, relations or confidences that are null, and confidences outside 0 to 1, take no part.

    A fixpoint: each round extends only what the last one found or improved, and of that only what ends at an entry that has mappings of its own.  A confidence never grows along a
    chain, so a cycle improves nothing and the rounds end.  A round keeps one row per start, end and relation, however many chains there are; both sides of its join are written
    tables, so a hub with very many mappings can be split.  What is known is written again only where a round
    has improved some of it, and only rows of the round's starts are compared.

    Relation and the mark of ends with mappings of their own are one number ``_k`` (see ``_composed_codes``).  Mappings are dealt by their left entry once a round, for the step and for what is
    known of the starts; so that Spark shares that shuffle, both read the same columns and filters.
    """
    key = ["dst_id", "src_id", "_k"]  # ends first, as they differ most: rows are sorted by it
    relations = F.array(*map(F.lit, RELATIONS))
    ok = mappings.where((F.col("left_id") != F.col("right_id")) & F.col("relation").isin(*RELATIONS) & F.col("confidence").between(0, 1))  # none of them is null then
    hubs = mappings.select(F.col("left_id").alias("dst_id")).where("dst_id IS NOT NULL").distinct().withColumn("_on", F.lit(1))
    one = ok.groupBy(F.col("left_id").alias("src_id"), F.col("right_id").alias("dst_id"), (2 * F.array_position(relations, F.col("relation")) - 2).cast("int").alias("_k")).agg(F.max("confidence").alias("confidence"))
    base = staged(spark, one.join(hubs.hint("shuffle_hash"), "dst_id", "left").select("src_id", "dst_id", (F.col("_k") + F.coalesce("_on", F.lit(0))).alias("_k"), "confidence"))
    base = base.where("src_id IS NOT NULL AND dst_id IS NOT NULL AND _k IS NOT NULL")
    known = [base]
    best = front = base.withColumn("hops", F.lit(1)).withColumn("via", F.array().cast(f"array<{base.schema['dst_id'].dataType.simpleString()}>"))
    for hop in count(2) if max_hops is None else range(2, max_hops + 1):
        front = front.where("_k % 2 = 1")
        if front.isEmpty():
            break
        chains = front.select(F.col("src_id").alias("_from"), F.col("dst_id").alias("_hub"), F.col("_k").alias("_first"), F.col("confidence").alias("_c"), "via")
        if front.groupBy("dst_id").count().agg(F.max("count")).first()[0] <= HOT_ROWS:
            chains = chains.hint("shuffle_hash")
        longer = base.join(chains, F.col("src_id") == F.col("_hub")).where(F.col("_from") != F.col("dst_id")).select("dst_id", F.col("_from").alias("src_id"), _composed_codes(F.col("_first"), F.col("_k")).alias("_k"), (-F.col("_c") * F.col("confidence")).alias("n"), "via", "_hub")
        found = longer.where("_k IS NOT NULL").groupBy(*key).agg(F.min(F.struct("n", F.array_append("via", F.col("_hub")).alias("v"))).alias("b"))
        starts = front.select("src_id").distinct()
        starts = F.broadcast(starts) if starts.limit(FEW_EDGES + 1).count() <= FEW_EDGES else starts.hint("shuffle_hash")
        was = reduce(DataFrame.unionByName, (t.join(starts, "src_id", "left_semi").select(*key, F.col("confidence").alias("_was")) for t in known))
        better = found.join(was, key, "left").where(F.col("_was").isNull() | (-F.col("b.n") > F.col("_was")))
        front = staged(spark, better.select("src_id", "dst_id", "_k", (-F.col("b.n")).alias("confidence"), F.lit(hop).alias("hops"), F.col("b.v").alias("via"), F.col("_was").isNotNull().alias("_again")))
        again, front = front.where("_again").select(*key), front.drop("_again")
        if not again.isEmpty():
            best = staged(spark, best.join(again, key, "left_anti"))
            known = [best]
        best, known = best.unionByName(front), [*known, front]
        if hop % CUT_HOPS == 0:
            best = staged(spark, best)
            known = [best]
    return best.select("src_id", "dst_id", F.get(relations, F.shiftright("_k", 1)).alias("relation"), "confidence", "hops", "via")


#: A mapping row: required fields first.
MAPPING = "subject string, predicate string, object string, justification string, confidence double, author string, dated date, tool string, modifier string"


def valid_mappings(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(valid, quarantined)`` of mapping rows with the fields of ``MAPPING``; quarantined ones say in ``problems`` what is wrong.

    Subject, predicate, object and justification are required, the predicate is a known relation, confidence is within 0 and 1, and the only modifier is ``Not``.
    Fields that the table lacks count as null.
    """
    have = lambda c: F.col(c) if c in rows.columns else F.lit(None)
    tests = {
        **{f"no {c}": have(c).isNull() for c in ("subject", "predicate", "object", "justification")},
        "unknown predicate": ~have("predicate").isin(*RELATIONS),
        "confidence": ~have("confidence").between(0, 1),
        "modifier": have("modifier") != "Not",
    }
    found = rows.withColumn("problems", F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in tests.items())), lambda x: x.isNotNull()))
    return found.where(F.size("problems") == 0).drop("problems"), found.where(F.size("problems") > 0)


def blast_radius(derived: DataFrame) -> DataFrame:
    """Derived mappings that rest on each hub entry; ``via`` holds one hub (``compose``) or all hubs of a chain (``derive``)."""
    if isinstance(derived.schema["via"].dataType, ArrayType):
        derived = derived.select(F.explode(F.when(F.size("via") < 2, F.col("via")).otherwise(F.array_distinct("via"))).alias("via"))
    return derived.groupBy("via").agg(F.count("*").alias("n_derived"))
