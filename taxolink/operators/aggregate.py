"""Tags, multi-maps, link lists, folders and counts (2.6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolink.functions import text as T


def tags(df: DataFrame, key: str, cols: Sequence[str], out: str = "tags") -> DataFrame:
    """Per key all tags of all cells, distinct, in order, joined by a space.  Tags are exploded first, so repeated ones are dropped before the shuffle."""
    each = df.select(key, F.explode(F.split(F.concat_ws(" ", *cols), r"\s+")).alias("_t")).where("_t <> ''").distinct()
    return each.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("_t")), " ").alias(out))


def multi_map(df: DataFrame, left: str, right: str, order: str) -> DataFrame:
    """``left -> [right, ...]`` in order, duplicates kept."""
    pairs = df.select(T.blank_to_null(F.col(left)).alias("left_id"), T.blank_to_null(F.col(right)).alias("right_id"), order).dropna(subset=["left_id", "right_id"])
    return pairs.groupBy("left_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "right_id"))), lambda x: x["right_id"]).alias("right_ids"))


def link_lists(edges: DataFrame, keys: Sequence[str] = ("src_fw", "src_id", "prop"), item: str = "rendered") -> DataFrame:
    """Per note and property the distinct link texts in order: one shuffle, of sets that are already partial."""
    return edges.groupBy(*keys).agg(F.array_sort(F.collect_set(item)).alias("links"))


def merge_lists(notes: DataFrame, new: DataFrame, key: Sequence[str], nested: bool = False, link_key: str = "link") -> DataFrame:
    """``notes(key, links)`` with the items of ``new(key, links)`` added.

    Flat lists become a sorted set union; nested ones keep the old entries and append ``{link: text}`` for every new item, duplicates
    too.  Keys without a note are left out, as there is no note to write to.
    """
    added = new.withColumnRenamed("links", "_new")
    got = notes.join(added, list(key), "left")
    none = F.array().cast("array<string>")
    if nested:
        wrap = lambda arr: F.transform(F.coalesce(arr, none), lambda x: F.create_map(F.lit(link_key), x))
        return got.withColumn("links", F.concat(wrap(F.col("links")), wrap(F.col("_new")))).drop("_new")
    return got.withColumn("links", F.array_sort(F.array_union(F.coalesce("links", none), F.coalesce("_new", none)))).drop("_new")


def folder_children(paths: DataFrame, path: str = "path") -> DataFrame:
    """``folder, parent, children``: every folder and its distinct child names in order; the root's parent is null."""
    parts = F.split(path, "/")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i - 1), "/").alias("folder"), F.element_at(parts, i).alias("child")))
    each = paths.select(F.explode(steps).alias("s")).select("s.folder", "s.child").distinct()
    got = each.groupBy("folder").agg(F.array_sort(F.collect_list("child")).alias("children"))
    return got.select("folder", F.when(F.col("folder") != "", T.parent_path(F.col("folder"))).alias("parent"), "children")


def status_counts(results: DataFrame, started: str | None = None, ended: str | None = None) -> DataFrame:
    """Rows per status of a run and, where the results have the times of each row, from its first start to its last end, ``seconds``."""
    spent = [(F.unix_micros(F.max(ended)) - F.unix_micros(F.min(started))) / 1e6] if started and ended else []
    return results.groupBy("status").agg(F.count("*").alias("n"), *(c.alias("seconds") for c in spent))
