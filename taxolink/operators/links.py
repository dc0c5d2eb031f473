"""Links inside note text: extraction, typed links, priority merge and inbound queries (2.14), and the link audit (JN-10, JN-11)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from taxolink.functions import text as T
from taxolink.operators import match as M

#: The target of a wiki link, up to its alias.
WIKILINK = r"\[\[([^\]|]+)"
#: Fixed value: a typed link, `key.sub:: target metadata`, bare or in brackets or parentheses.
TYPED = (
    r"[\[(]?([A-Za-z][\w-]*(?:\.\w+)*)::[ \t]*"
    r"(?:\[\[([^|\]]+)(?:\|([^\]]+))?\]\]|\[([^\]]+?)\]\(([^)]+?)\)|([^\"\[\]()\s{}]+))?"
    r"[ \t]*(?:(\{[^}]*\})|\"([^\"]+)\")?"
)


def wikilinks(notes: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """``key, target``: one row for each link in the whole text, frontmatter included."""
    return notes.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(WIKILINK), F.lit(1))).alias("target"))


def note_index(notes: DataFrame, path: str = "path") -> DataFrame:
    """``name, path``: base name of each note that is not hidden; of equal names the last path counts."""
    name = T.base_name(F.col(path))
    return notes.select(name.alias("name"), F.col(path).alias("path")).where(~F.col("name").startswith(".")).groupBy("name").agg(F.max("path").alias("path"))


def split_note(notes: DataFrame, text: str = "text") -> DataFrame:
    """``header`` and ``body`` of each note; text without a header is all body."""
    parts = F.split(F.col(text), "---\n", 3)
    has = F.col(text).startswith("---\n") & (F.size(parts) == 3)
    return notes.withColumn("header", F.when(has, parts[1])).withColumn("body", F.when(has, parts[2]).otherwise(F.col(text)))


def header_pairs(header: Column) -> Column:
    """A map of the scalar ``key: value`` lines of a frontmatter header."""
    lines = F.filter(F.split(header, "\n"), lambda x: x.rlike(r"^[^\s:#-][^:]*:\s*\S"))
    entries = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^([^:]+):", 1).alias("key"), F.regexp_extract(x, r"""^[^:]+:\s*["']?(.*?)["']?\s*$""", 1).alias("value")))
    return F.map_from_entries(F.array_distinct(entries))


def nested_header(notes: DataFrame, header: str = "header", out: str = "properties") -> DataFrame:
    """``notes`` with the whole frontmatter header, nested parts and lists included, as JSON; null where there is none or it is no YAML mapping.

    Scalars other than numbers, booleans and nulls become text.  Parsed in Arrow batches by PyYAML, which must be installed where tasks run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        import yaml

        def parsed(text: str | None) -> str | None:
            try:
                got = yaml.load(text, getattr(yaml, "CSafeLoader", yaml.SafeLoader)) if text else None
            except yaml.YAMLError:
                return None
            return json.dumps(got, default=str, ensure_ascii=False) if isinstance(got, dict) else None

        for batch in batches:
            yield batch.append_column(out, pa.array(map(parsed, batch.column(header).to_pylist()), pa.string()))

    return notes.mapInArrow(run, StructType([*notes.schema.fields, StructField(out, StringType())]))


def broken_links(notes: DataFrame, nodes: DataFrame, key: str = "path", text: str = "text", name: str = "name") -> DataFrame:
    """Links whose target is no known note name."""
    return wikilinks(notes, key, text).join(nodes.select(F.col(name).alias("target")), "target", "left_anti").select(key, "target")


def audit(notes: DataFrame, nodes: DataFrame, key: str = "path", text: str = "text", name: str = "name") -> DataFrame:
    """Distinct broken targets with the number of links and the nearest known name, if one is near."""
    broken = broken_links(notes, nodes, key, text, name).groupBy("target").agg(F.count("*").alias("n_links"))
    near = M.nearest(broken.select(F.col("target").alias("id"), F.col("target").alias("value")), nodes.select(F.col(name).alias("value")))
    return broken.join(near, F.col("target") == F.col("left_id"), "left").select("target", "n_links", "suggestion", "score")


def typed_links(notes: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """``key, pos, field, target, alias, value, json``: one row for each typed link of each line.

    A link without any value means true; ``json`` is a map of the metadata object.
    """
    line = notes.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line", "t")).where(F.contains("t", F.lit("::")))
    found = line.select(key, "line", F.posexplode_outer(F.regexp_extract_all("t", F.lit(f"({TYPED})"), F.lit(1))).alias("nth", "m")).where("m is not null")
    # Outer, as Spark would put the pattern into a filter as well, and run it twice.  All groups by one run of the pattern.  A line holds no line break, so that is what stands between them; groups without a match are empty.
    groups = F.regexp_replace("m", f"^{TYPED}", "\n".join(f"${i}" for i in range(1, 9)))
    found = found.select(key, "line", "nth", F.explode(F.array(F.split(groups, "\n"))).alias("g"))
    part = lambda i: F.nullif(F.col("g")[i - 1], F.lit(""))
    meta, quoted, plain = part(7), part(8), part(6)
    is_value = plain.isNotNull() & meta.isNull() & quoted.isNull() & (T.is_number(plain) | F.lower(plain).isin("true", "false"))
    return found.select(
        key,
        F.struct("line", "nth").alias("pos"),
        part(1).alias("field"),
        F.coalesce(part(2), part(5), F.when(~is_value, plain)).alias("target"),
        F.coalesce(part(3), F.when(part(5).isNotNull(), part(4))).alias("alias"),
        F.when(is_value, plain).when(quoted.isNotNull(), quoted).when(meta.rlike(r'^\{[^:"]*\}$'), F.trim(F.regexp_replace(meta, r"[{}]", ""))).when(meta.isNull(), F.lit("true")).alias("value"),
        F.when(~meta.rlike(r'^\{[^:"]*\}$'), F.from_json(meta, "map<string,string>")).alias("json"),
    )


def link_values(typed: DataFrame, key: str = "path") -> DataFrame:
    """``key, framework, target, name, value, priority, pos`` of typed links: one row for each value they set.

    ``fw.name:: value`` sets ``name``; ``fw.name:: {json}`` and ``fw:: {json}`` set every key of the object.  Priorities
    (1 wins): with a target, an explicit value 1, an implied true 2, an object below a key 3, an object at the root 4; without
    one, in the same order, 5, 6, 7 and 8.
    """
    parts = F.split("field", r"\.")
    leaf = F.when(F.size(parts) > 1, F.element_at(parts, -1))
    later = F.when(F.col("target").isNull(), 4).otherwise(0)
    one = lambda name, value, first: F.struct(name.alias("name"), value.alias("value"), (first + later).alias("priority"))
    single = F.array(one(F.coalesce(leaf, F.lit("value")), F.col("value"), F.when(F.col("value") == "true", 2).otherwise(1)))
    many = F.transform(F.map_entries("json"), lambda e: one(e["key"], e["value"], F.when(leaf.isNotNull(), 3).otherwise(4)))
    # One pass over the links: an object is as many values as it has keys.
    each = typed.select(key, parts[0].alias("framework"), "target", "pos", F.explode_outer(F.when(F.col("json").isNull(), single).otherwise(many)).alias("_v")).where("_v is not null")
    return each.select(key, "framework", "target", "_v.name", "_v.value", "_v.priority", "pos")


def merged_values(values: DataFrame, key: str = "path", by: Sequence[str] = ("framework",)) -> DataFrame:
    """Per note, framework and target one map of values: the best priority wins each name, later text wins a tie.

    Values without a target are defaults of the note; they fill what a target does not set itself.
    """
    keys = [key, *by]
    # Dealt by note once: both groupings and the window keep that order, so values are moved and sorted once.
    named = values.repartition(*keys).groupBy(*keys, "target", "name").agg(F.max_by("value", F.struct(-F.col("priority"), "pos")).alias("value"))
    props = named.groupBy(*keys, "target").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("props"))
    given = reduce(Column.__and__, (F.col(k).isNotNull() for k in keys))
    own = props.withColumn("_d", F.first(F.when(F.col("target").isNull() & given, F.col("props")), ignorenulls=True).over(Window.partitionBy(*keys))).where("target is not null")
    fill = F.map_filter(F.coalesce("_d", F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(F.map_keys("props"), k))
    return own.select(*keys, "target", F.map_concat("props", fill).alias("props"))


def inbound(edges: DataFrame, node: str) -> DataFrame:
    """All edges into one node; the filter reaches the scan."""
    return edges.where(F.col("dst_id") == node)


def inbound_below(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """``folder, n_links``: inbound links of every folder and all that lies below it; ``paths(node_id, path)``, path an array.

    Links are counted per node before they meet the ancestors, so a node with many links is one row.
    """
    per_node = edges.groupBy(F.col("dst_id").alias("node_id")).agg(F.count("*").alias("n"))
    each = paths.select("node_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.array_join(F.slice("path", F.lit(1), i), "/"))).alias("folder"))
    return each.join(per_node, "node_id").groupBy("folder").agg(F.sum("n").alias("n_links"))


def inbound_by_framework(edges: DataFrame) -> DataFrame:
    return edges.groupBy("dst_fw", "dst_id").agg(F.count("*").alias("n_links"))


def pivoted(edges: DataFrame, row: str, category: str, value: str, categories: Sequence[str]) -> DataFrame:
    """One row per node, one column per category with the sum of its values; categories are given, so no pass is spent to find them."""
    return edges.groupBy(row).pivot(category, list(categories)).agg(F.sum(value))


def relations(edges: DataFrame, row: str, fields: Sequence[str], limit_order: str) -> DataFrame:
    """Nested form of the same: per node an ordered list of structs."""
    return edges.groupBy(row).agg(F.array_sort(F.collect_list(F.struct(limit_order, *fields))).alias("relations"))


def view(notes: DataFrame, where: Column, by: Sequence[str], **measures: Column) -> DataFrame:
    """A property view: notes that satisfy ``where``, grouped, with named aggregates."""
    return notes.where(where).groupBy(*by).agg(*(c.alias(n) for n, c in measures.items()))
