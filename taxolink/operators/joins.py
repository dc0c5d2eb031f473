"""Equi-joins between frameworks and mapping tables, and the link pass made of them (2.5, 3.3)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from taxolink.functions import text as T


#: Rows of a task where a shuffle is sized by rows.
TASK_ROWS = 250_000


def parts(rows: int) -> int:
    """Partitions for so many rows.  Shuffles are sized by compressed bytes otherwise, and rows that are much alike need many times those in memory."""
    return max(1, -(-rows // TASK_ROWS))


def join_keep_left(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """A join whose right side first loses the columns that the left has, so no suffixes arise."""
    return left.join(right.drop(*(c for c in right.columns if c in left.columns and c not in on)), list(on), how)


def join_on_derived(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, suffixes: tuple[str, str]) -> DataFrame:
    """A left join on computed keys; names that both sides have get the suffixes."""
    both = set(left.columns) & set(right.columns)
    named = lambda df, suffix: df.select(*(F.col(f"`{c}`").alias(c + suffix if c in both else c) for c in df.columns if c != "_k"), "_k")
    a = named(left.withColumn("_k", left_key), suffixes[0]).withColumnRenamed("_k", "merge_key")
    b = named(right.withColumn("_k", right_key), suffixes[1])
    return a.join(b, F.col("merge_key") == F.col("_k"), "left").drop("_k")


def bridge_chain(start: DataFrame, *steps: tuple[DataFrame, Sequence[str]]) -> DataFrame:
    """``start`` left-joined with one table after the other; Catalyst broadcasts the bridges that are small."""
    for right, on in steps:
        start = join_keep_left(start, right, on)
    return start


def label_join(left: DataFrame, right: DataFrame, left_label: str, right_label: str) -> DataFrame:
    """A left join on text labels, stripped, whatever their type."""
    slim = right.drop(*(c for c in right.columns if c in left.columns and c != right_label))
    slim = slim.withColumn("_k", T.strip(F.col(right_label))).drop(right_label)
    return left.join(slim, T.strip(F.col(left_label)) == F.col("_k"), "left").drop("_k")


def premerge(core: DataFrame, mapping: DataFrame, core_key: str, left: str, right: str, keep_left: bool = False, keep_right: bool = True) -> DataFrame:
    """``core`` with the mapping's two columns; either can be left out again."""
    two = mapping.select(F.col(left).alias("_l"), F.col(right).alias("_r"))
    got = core.join(two, F.col(core_key) == F.col("_l"), "left")
    add = [F.col("_l").alias(left)] * keep_left + [F.col("_r").alias(right)] * keep_right
    return got.select(*(f"`{c}`" for c in core.columns), *add)


def mapping_pairs(mapping: DataFrame, left: str, right: str, id_pattern: str | None = None, normalize: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """``left_id, right_id`` of a mapping table, stripped and without nulls.

    With ``id_pattern`` a right cell may hold many ids in markup, and every match is one.  Numeric ids stay numbers, and are joined as such.
    """
    form = T.normalize_id if normalize else lambda c: c
    text = {f.name: isinstance(f.dataType, StringType) for f in mapping.schema.fields}
    clean = lambda c, is_text: form(T.blank_to_null(F.col(c))) if is_text or normalize else F.col(c)
    rights = F.explode(F.regexp_extract_all(F.col(right).cast("string"), F.lit(id_pattern), F.lit(0))) if id_pattern else F.col(right)
    got = mapping.select(F.col(left).alias("left_id"), rights.alias("right_id"), *keep)
    return got.select(clean("left_id", text[left]).alias("left_id"), clean("right_id", bool(id_pattern) or text[right]).alias("right_id"), *keep).dropna(subset=["left_id", "right_id"])


def mapped_edges(source: DataFrame, source_id: str, pairs: DataFrame) -> DataFrame:
    """An edge for every source row and right id of its id: ``src_id, dst_id``, and what else ``pairs`` carries."""
    return source.select(F.col(source_id).alias("src_id")).join(pairs.withColumnRenamed("left_id", "src_id").withColumnRenamed("right_id", "dst_id"), "src_id")


def existing(edges: DataFrame, targets: DataFrame, target_id: str) -> DataFrame:
    """Edges whose target exists; the join is semi, so targets need not be unique."""
    return edges.join(targets.select(F.col(target_id).alias("dst_id")), "dst_id", "left_semi")


def missing(edges: DataFrame, targets: DataFrame, target_id: str) -> DataFrame:
    """Edges whose target does not exist."""
    return edges.join(targets.select(F.col(target_id).alias("dst_id")), "dst_id", "left_anti")


def related(df: DataFrame, id_col: str, cell: str, split: bool = True) -> DataFrame:
    """Edges from a cell that lists related ids; ``split=False`` takes the cell as one id."""
    ids = F.filter(F.split(F.col(cell), r"[,;\s]+"), lambda x: x != "") if split else F.array(T.blank_to_null(F.col(cell)))
    return df.select(F.col(id_col).alias("src_id"), F.explode(ids).alias("dst_id")).where("dst_id is not null")


@dataclass(frozen=True)
class LinkPass:
    """One link pass between two frameworks: names and Columns only."""

    name: str
    source_fw: str
    target_fw: str
    #: Where link texts go: ``source``, ``target`` or ``both``.
    write_to: str = "both"
    prop: str = "related_frameworks"
    prefix: str = ""
    alias: bool = False
    markdown: bool = False


def directed(edges: DataFrame, link: LinkPass) -> DataFrame:
    """Edges as they are written: ``link_name, src_fw, src_id, dst_fw, dst_id, prop, rendered``; ``both`` has each edge twice.

    One scan feeds both directions: each row explodes into its one or two directions.  Ids of different types become text.
    """
    if edges.schema["src_id"].dataType != edges.schema["dst_id"].dataType:
        edges = edges.withColumns({c: F.col(c).cast("string") for c in ("src_id", "dst_id")})
    one = lambda a, i, b, j: F.struct(F.lit(a).alias("src_fw"), F.col(i).alias("src_id"), F.lit(b).alias("dst_fw"), F.col(j).alias("dst_id"))
    ways = []
    if link.write_to in ("source", "both"):
        ways.append(one(link.source_fw, "src_id", link.target_fw, "dst_id"))
    if link.write_to in ("target", "both"):
        ways.append(one(link.target_fw, "dst_id", link.source_fw, "src_id"))
    got = edges.select(F.explode(F.array(*ways)).alias("e")).select(F.lit(link.name).alias("link_name"), "e.*", F.lit(link.prop).alias("prop"))
    return got.withColumn("rendered", T.framework_link(F.col("dst_id"), link.prefix, link.alias, link.markdown))


def link_pass(source: DataFrame, source_id: str, target: DataFrame, target_id: str, pairs: DataFrame, link: LinkPass, n_parts: int | None = None) -> DataFrame:
    """The whole pass: right ids of each source id, existing targets only, written in the directions asked for.

    With ``n_parts`` (see ``parts``) sources and pairs are dealt by id into so many partitions.
    """
    sources = source.select(F.col(source_id).cast(pairs.schema["left_id"].dataType).alias("id")).distinct()
    targets = target.select(F.col(target_id).cast(pairs.schema["right_id"].dataType).alias("id"))
    if n_parts:
        sources, pairs = sources.repartition(n_parts, "id"), pairs.repartition(n_parts, "left_id")
    return directed(existing(mapped_edges(sources, "id", pairs), targets, "id"), link)


def link_counts(edges: DataFrame, distinct: bool = False, n_parts: int | None = None) -> DataFrame:
    """Links per framework; ``distinct`` counts a repeated edge once, in ``n_parts`` partitions if given."""
    if distinct:
        edges = edges.select("src_fw", "src_id", "dst_fw", "dst_id")
        edges = (edges.repartition(n_parts, *edges.columns) if n_parts else edges).distinct()
    return edges.groupBy(F.col("src_fw").alias("fw")).agg(F.count("*").alias("n_links"))


def unmapped(nodes: DataFrame, node_id: str, pairs: DataFrame, side: str = "left_id") -> DataFrame:
    """Distinct ids of ``nodes`` that the mapping's side lacks."""
    return nodes.select(F.col(node_id).alias("id")).distinct().join(pairs.select(F.col(side).alias("id")).distinct(), "id", "left_anti")


def stack(tables: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """All frameworks as one table with a column ``fw``; columns that one lacks are null."""
    first, *rest = (df.withColumn("fw", F.lit(name)) for name, df in tables)
    for df in rest:
        first = first.unionByName(df, allowMissingColumns=True)
    return first
