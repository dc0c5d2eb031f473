"""Differences between versions and how they are applied (2.16)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolink.operators import graph as G
from taxolink.operators import match as M
from taxolink.operators.graph import shared_folder


def _hash(columns: Sequence[str]) -> Column:
    return F.xxhash64(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in columns))


def node_diff(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str], kind: str | None = None) -> DataFrame:
    """``key, change``: added, removed, type_changed or properties_changed; unchanged nodes have no row.  Only hashes move."""
    side = lambda df, n: df.select(key, _hash(columns).alias(f"_h{n}"), (F.col(kind) if kind else F.lit(None)).cast("string").alias(f"_t{n}"))
    got = side(old, 0).join(side(new, 1), key, "full")
    change = F.when(F.col("_h0").isNull(), "added").when(F.col("_h1").isNull(), "removed").when(~F.col("_t0").eqNullSafe(F.col("_t1")), "type_changed").when(F.col("_h0") != F.col("_h1"), "properties_changed")
    return got.select(key, change.alias("change")).where("change is not null")


def edge_diff(old: DataFrame, new: DataFrame, kind: str = "relation", columns: Sequence[str] = ()) -> DataFrame:
    """``src_id, dst_id, change`` between two edge tables with one row per pair."""
    side = lambda df, n: df.select("src_id", "dst_id", F.col(kind).alias(f"_t{n}"), (_hash(columns) if columns else F.lit(0)).alias(f"_h{n}"), F.lit(1).alias(f"_p{n}"))
    got = side(old, 0).join(side(new, 1), ["src_id", "dst_id"], "full")
    change = F.when(F.col("_p0").isNull(), "added").when(F.col("_p1").isNull(), "removed").when(~F.col("_t0").eqNullSafe(F.col("_t1")), "type_changed").when(F.col("_h0") != F.col("_h1"), "properties_changed")
    return got.select("src_id", "dst_id", change.alias("change")).where("change is not null")


def moved(parents: DataFrame) -> DataFrame:
    """``node_id, old_parent, new_parent`` from a diff of parent edges ``(src_id: node, dst_id: parent, change)``."""
    gone = parents.where("change = 'removed'").select(F.col("src_id").alias("node_id"), F.col("dst_id").alias("old_parent"))
    come = parents.where("change = 'added'").select(F.col("src_id").alias("node_id"), F.col("dst_id").alias("new_parent"))
    return gone.join(come, "node_id")


def one_to_one(pairs: DataFrame) -> DataFrame:
    """Of ``pairs(old_id, new_id, score)`` those that a greedy walk keeps: best score first (ties: smaller old, then new id), no id twice.

    Rounds of pairs that are the best of both their ids, which is what the walk keeps, too; what they leave goes into the next round.  Every round is two
    grouped minima and joins with at most one row per id.
    """
    shared_folder(pairs.sparkSession)
    rest, kept = pairs.select((-F.col("score")).alias("n"), "old_id", "new_id").distinct().checkpoint(), []
    while not rest.isEmpty():
        best = lambda side: rest.groupBy(side).agg(F.min(F.struct("n", "old_id", "new_id")).alias("b")).select("b.*")  # noqa: B023, E731
        both = best("old_id").join(best("new_id"), ["n", "old_id", "new_id"]).checkpoint()
        kept.append(both)
        rest = rest.join(both.select("old_id"), "old_id", "left_anti").join(both.select("new_id"), "new_id", "left_anti").checkpoint()
    out = reduce(DataFrame.unionByName, kept) if kept else rest
    return out.select("old_id", "new_id", (-F.col("n")).alias("score"))


def renamed(removed: DataFrame, added: DataFrame, aliases: DataFrame, threshold: float = 0.8, properties: Sequence[str] = (), title_weight: float = 0.6) -> DataFrame:
    """``old_id, new_id, how``: by the alias table first, then by similarity; no id is used twice.  Inputs have ``id, value`` (the title) and ``properties``.

    The score is ``title_weight`` times the titles' token Jaccard plus the rest times the share of properties that both have and that are equal, of those that either has;
    without properties the Jaccard alone.  Pairs of at least ``threshold`` are kept one to one.  A pair cannot reach the threshold with a Jaccard below
    (threshold - rest) / title_weight, so the candidates of that threshold are all there are.
    """
    rest = 1 - title_weight if properties else 0.0
    least = (threshold - rest) / (1 - rest)
    if least <= 0:
        raise ValueError("the threshold must be above the weight of the properties: below it titles need not have anything in common")
    known = aliases.join(removed.select(F.col("id").alias("old_id")), "old_id", "left_semi").join(added.select(F.col("id").alias("new_id")), "new_id", "left_semi")
    known = one_to_one(known.select("old_id", "new_id", F.lit(1.0).alias("score"))).select("old_id", "new_id", F.lit("alias").alias("how"))
    open_ = removed.join(known.select(F.col("old_id").alias("id")), "id", "left_anti")
    free = added.join(known.select(F.col("new_id").alias("id")), "id", "left_anti")
    pairs = M.match(open_, free, "jaccard", threshold=least - 1e-12)
    if properties:
        side = lambda df, i: df.select(F.col("id").alias(f"{'left' if not i else 'right'}_id"), F.struct(*(F.col(f"`{p}`").cast("string").alias(p) for p in properties)).alias(f"p{i}"))
        pairs = pairs.join(side(open_, 0), "left_id").join(side(free, 1), "right_id")
        a, b = (lambda p: F.col("p0")[p]), (lambda p: F.col("p1")[p])
        one = lambda test: F.when(test, 1).otherwise(0)
        equal = reduce(Column.__add__, (one(F.coalesce(a(p) == b(p), F.lit(False))) for p in properties))
        either = reduce(Column.__add__, (one(a(p).isNotNull() | b(p).isNotNull()) for p in properties))
        pairs = pairs.withColumn("score", title_weight * F.col("score") + rest * F.when(either > 0, equal / either).otherwise(0.0))
    similar = one_to_one(pairs.where(F.col("score") >= threshold - 1e-12).select(F.col("left_id").alias("old_id"), F.col("right_id").alias("new_id"), "score"))
    return known.unionByName(similar.select("old_id", "new_id", F.lit("similar").alias("how")))


def reshaped(pairs: DataFrame) -> DataFrame:
    """``id, kind, n``: merges (several old ids, one new) and splits (one old id, several new) of ``(old_id, new_id)``."""
    p = pairs.select("old_id", "new_id").distinct()
    count = lambda by, kind: p.groupBy(F.col(by).alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit(kind).alias("kind"), "n")
    return count("new_id", "merge").unionByName(count("old_id", "split"))


def restructured(spark: SparkSession, pairs: DataFrame, moves: DataFrame | None = None) -> DataFrame:
    """``component, kind, n_old, n_new, n_links, n_moved`` of the connected parts of the alias graph ``(old_id, new_id)``; ``component`` is the part's smallest old id.

    One old and one new id are a rename, several old ones with one new a merge, one with several new a split, several with several a restructure.  ``moves(old_id)`` are old ids that
    have another parent now: a merge or split in which some ids moved and others did not takes its subtree apart and is a restructure, too.
    """
    ids = lambda side: F.concat(F.lit(f"{side}:"), F.col(f"{side}_id").cast("string"))
    p = pairs.where("old_id is not null and new_id is not null").select("old_id", "new_id").distinct()
    # "new" sorts before "old", so parts are named by joining back, not by the label itself.
    edges = p.select(ids("old").alias("src_id"), ids("new").alias("dst_id"))
    nodes = edges.select(F.explode(F.array("src_id", "dst_id")).alias("id")).distinct()
    label = G.components(spark, edges, nodes)
    moved = (moves.select("old_id").distinct() if moves is not None else p.select("old_id").where("false")).withColumn("m", F.lit(1))
    olds = p.groupBy("old_id").agg(F.count("*").alias("links")).withColumn("id", ids("old")).join(label.hint("merge"), "id").join(moved.hint("merge"), "old_id", "left")
    news = p.select("new_id").distinct().withColumn("id", ids("new")).join(label.hint("merge"), "id")
    got = olds.groupBy("component").agg(F.min("old_id").alias("first"), F.count("*").alias("n_old"), F.sum("links").alias("n_links"), F.count("m").alias("n_moved")).join(news.groupBy("component").agg(F.count("*").alias("n_new")).hint("merge"), "component")
    shape = F.when((F.col("n_old") > 1) & (F.col("n_new") > 1), "restructure").when(F.col("n_old") > 1, "merge").when(F.col("n_new") > 1, "split").otherwise("rename")
    torn = shape.isin("merge", "split") & (F.col("n_moved") > 0) & (F.col("n_moved") < F.col("n_old"))
    return got.select(F.col("first").alias("component"), F.when(torn, "restructure").otherwise(shape).alias("kind"), "n_old", "n_new", "n_links", "n_moved")


def strategies(changes: DataFrame, rules: DataFrame) -> DataFrame:
    """``changes(fw, node_id, change)`` with their ``strategy``: of ``rules(fw, node_id, change, strategy)`` the most specific one.

    Null in a rule means any.  Levels: node and change, framework and change, change, default; each is an equi-join.
    """
    got, found = changes, []
    levels = (("fw", "node_id", "change"), ("fw", "change"), ("change",), ())
    for i, keys in enumerate(levels):
        rest = [k for k in levels[0] if k not in keys]
        rule = rules.where(" and ".join([f"{k} is not null" for k in keys] + [f"{k} is null" for k in rest])).groupBy(*keys).agg(F.min("strategy").alias(f"_s{i}"))
        got = got.join(rule, list(keys), "left") if keys else got.withColumn(f"_s{i}", F.lit(rule.first()[0]))  # the default is one value
        found.append(f"_s{i}")
    return got.select(*changes.columns, F.coalesce(*found).alias("strategy"))


def scd1(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows overwrite old ones with the same key."""
    return current.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def scd2(history: DataFrame, new: DataFrame, key: str, columns: Sequence[str], at: Column, n_parts: int | None = None) -> DataFrame:
    """The next history ``(key, columns, valid_from, valid_to)``: changed and removed rows are closed at ``at``, changed and new ones opened.

    With ``n_parts`` (see ``joins.parts``) both sides are dealt by key into so many partitions.
    """
    if n_parts:
        history, new = history.repartition(n_parts, key), new.repartition(n_parts, key)
    open_, closed = history.where("valid_to is null"), history.where("valid_to is not null")
    n = new.select(F.col(key).alias("_k"), _hash(columns).alias("_h1"))
    marked = open_.withColumn("_h0", _hash(columns)).join(n, F.col(key) == F.col("_k"), "left")
    same = F.coalesce(F.col("_h0") == F.col("_h1"), F.lit(False))
    kept = marked.withColumn("valid_to", F.when(~same, at)).select(*history.columns)
    o = open_.select(F.col(key).alias("_k"), _hash(columns).alias("_h0"))
    fresh = new.withColumn("_h1", _hash(columns)).join(o, F.col(key) == F.col("_k"), "left").where(~F.coalesce(F.col("_h0") == F.col("_h1"), F.lit(False)))
    opened = fresh.select(key, *columns, at.alias("valid_from"), F.lit(None).cast(history.schema["valid_to"].dataType).alias("valid_to"))
    return closed.unionByName(kept).unionByName(opened.select(*history.columns))


def scd3(current: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """Each row keeps the value that ``column`` had before in ``previous_<column>``."""
    was = current.select(key, F.col(column).alias("_was"))
    return new.join(was, key, "left").withColumn(f"previous_{column}", F.when(~F.col("_was").eqNullSafe(F.col(column)), F.col("_was"))).drop("_was")


def scd6(history: DataFrame, key: str, columns: Sequence[str], n_parts: int | None = None) -> DataFrame:
    """A version history with every row's current values beside its own, dealt by key into ``n_parts`` if given."""
    if n_parts:
        history = history.repartition(n_parts, key)
    now = history.where("valid_to is null").select(key, *(F.col(c).alias(f"current_{c}") for c in columns))
    return history.join(now, key, "left")


def as_of(history: DataFrame, valid: Column, recorded: Column | None = None) -> DataFrame:
    """Rows valid at a time, and (with ``recorded_from``, ``recorded_to``) known at another."""
    inside = lambda a, b, t: (F.col(a) <= t) & (F.col(b).isNull() | (t < F.col(b)))
    got = history.where(inside("valid_from", "valid_to", valid))
    return got if recorded is None else got.where(inside("recorded_from", "recorded_to", recorded))


def replay(events: DataFrame, key: str, state: Sequence[str], order: Sequence[str], until: Column, time: str) -> DataFrame:
    """The last state of each key at a time: a grouped maximum over the log."""
    return events.where(F.col(time) <= until).groupBy(key).agg(F.max_by(F.struct(*state), F.struct(*order)).alias("_s")).select(key, "_s.*")


#: The fields that say how a framework changes, and what they may hold.
EVOLUTION = {
    "release_cadence": ("ad_hoc", "annual", "biannual", "quarterly", "continuous"),
    "breaking_change_policy": ("forbidden", "rare", "managed", "unrestricted"),
    "id_stability": ("immutable", "additive", "evolving", "unstable"),
    "changelog_format": ("none", "prose_only", "structured_incomplete", "structured_complete"),
    "hierarchy_stability": ("frozen", "conservative", "dynamic", "radical"),
    "scope_expansion": ("none", "incremental", "major", "metamorphic"),
    "deprecation_mechanism": ("none", "soft_delete", "versioned_chain", "forward_migration"),
    "crosswalk_maintenance": ("self_maintained", "submission_based", "pivot_hub", "delegated"),
}


def recommend(df: DataFrame, archive_only: Column | None = None) -> DataFrame:
    """``scd_type`` (6, 4, 3, 2, 1 or 0) and ``valid`` from the fields of ``EVOLUTION``, by the documented tree; ``valid`` is false where a field is null or unknown.

    The document leaves two choices open.  "2 or 3": immutable ids give 3 (an alias column is enough), additive ones 2, as its own profiles have it.  "1 or 0":
    1, but 0 where the caller says that a table is only archived.
    """
    breaking, ids = F.col("breaking_change_policy"), F.col("id_stability")
    rule = (
        F.when((breaking == "forbidden") & (F.col("changelog_format") == "structured_complete"), 6)
        .when(breaking.isin("rare", "managed") & (F.col("deprecation_mechanism") == "versioned_chain"), 4)
        .when((breaking == "managed") & (ids == "immutable"), 3)
        .when((breaking == "managed") & (ids == "additive"), 2)
        .when(archive_only if archive_only is not None else F.lit(False), 0)
        .otherwise(1)
    )
    known = F.lit(True)
    for name, values in EVOLUTION.items():
        known = known & F.coalesce(F.col(name).isin(*values), F.lit(False))
    return df.withColumn("scd_type", rule).withColumn("valid", known)


def review_queue(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """Edges at an id that was removed or whose type changed, with what happened to which end."""
    hit = changes.where(F.col("change").isin("removed", "type_changed"))
    end = lambda side: edges.join(hit.select(F.col("node_id").alias(side), "change"), side).select("src_id", "dst_id", F.lit(side).alias("end"), "change")
    return end("src_id").unionByName(end("dst_id"))
