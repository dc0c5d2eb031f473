"""Note tables: column roles, paths, frontmatter, body, provenance, and writing with a conflict mode (2.2, 2.3, 2.10)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxolink.functions import text as T

#: Version of the provenance block.
SCHEMA_VERSION = 1


@dataclass(frozen=True)
class NoteMapping:
    """What the columns of a table become."""

    base: str = ""
    levels: Sequence[str] = ()
    #: Column -> output key.
    frontmatter: Mapping[str, str] = field(default_factory=dict)
    links: Sequence[str] = ()
    #: Column -> body format.
    body: Mapping[str, str] = field(default_factory=dict)
    title: str | None = None
    file_template: str | None = None
    tags: Sequence[str] = ()
    framework: str = ""
    version: str = ""


def from_roles(roles: Sequence[tuple[str, str, str]], **options) -> NoteMapping:
    """A mapping from ``(column, role, output)``; hierarchy levels are numbered by order of appearance."""
    of = lambda role: [(c, o) for c, r, o in roles if r == role]
    title = next((c for c, _ in of("title")), None)
    return NoteMapping(levels=[c for c, _ in of("hierarchy")], frontmatter=dict(of("frontmatter")), links=[c for c, _ in of("link")], body={c: "text" for c, _ in of("body")}, title=title, **options)


def frontmatter(columns: Mapping[str, str], omit_empty: bool = True) -> Column:
    """A map of output key to text; blank values are left out."""
    keys = F.array(*(F.lit(k) for k in columns.values()))
    values = F.array(*(T.blank_to_null(F.col(f"`{c}`")) if omit_empty else T.as_text(F.col(f"`{c}`")) for c in columns))
    return F.map_filter(F.map_from_arrays(keys, values), lambda _, v: v.isNotNull())


def nested(columns: Mapping[str, str], style: str = "flat", by: str = ".") -> Column:
    """A struct of the columns: ``flat``, ``dot_to_nest`` (dots make structs) or ``group_by_prefix`` (one struct per prefix before ``_``)."""
    tree: dict = {}
    for c, key in columns.items():
        parts = key.split(by) if style == "dot_to_nest" else key.split("_", 1) if style == "group_by_prefix" else [key]
        here = tree
        for p in parts[:-1]:
            here = here.setdefault(p, {})
        here[parts[-1]] = F.col(f"`{c}`")

    def made(node: dict) -> Column:
        return F.struct(*((made(v) if isinstance(v, dict) else v).alias(k) for k, v in node.items()))

    return made(tree)


def extras(columns: Sequence[str], used: Sequence[str], name=lambda c: c) -> Column:
    """All unmapped columns as a map under normal names."""
    rest = [c for c in columns if c not in used]
    return F.map_filter(F.map_from_arrays(F.array(*(F.lit(name(c)) for c in rest)), F.array(*(T.blank_to_null(F.col(f"`{c}`")) for c in rest))), lambda _, v: v.isNotNull())


def provenance(m: NoteMapping, source: Column, row: Column, columns: Sequence[str], **known: str) -> Column:
    """The provenance struct; fields that are not known are null and drop out of its JSON."""
    lit = lambda k: F.lit(known.get(k)).cast("string")
    return F.struct(
        F.lit(SCHEMA_VERSION).alias("schemaVersion"), T.source_id(columns, row, m.frontmatter).alias("sourceId"), F.lit(m.framework).alias("framework"), F.lit(m.version or None).cast("string").alias("frameworkVersion"),
        lit("import_id").alias("importId"), lit("config_id").alias("configId"), lit("imported_at").alias("importedAt"), F.array(*(F.lit(k) for k in m.frontmatter.values())).cast("array<string>").alias("importedProperties"), source.alias("sourceFile"), row.cast("long").alias("sourceRow"),
    )


def render(df: DataFrame, m: NoteMapping, row: str, source: str = "", **known: str) -> DataFrame:
    """``path, fw, node_id, frontmatter (JSON), body, provenance (JSON), source_row``: one projection, after all joins."""
    name = [T.template(m.file_template, df.columns)] if m.file_template else []
    name += [F.col(f"`{m.title}`")] if m.title else []
    name += [F.col(f"`{c}`") for c in list(m.frontmatter)[:1]]
    keys = frontmatter(m.frontmatter)
    lists = [F.when(T.blank_to_null(F.col(f"`{c}`")).isNotNull(), F.transform(T.to_list(T.blank_to_null(F.col(f"`{c}`"))), lambda x: T.link(x))).alias(c) for c in m.links]
    tags = T.tag_list([F.col(f"`{c}`") for c in m.tags]) if m.tags else F.lit(None).cast("array<string>")
    head = F.to_json(F.struct(keys.alias("properties"), *lists, tags.alias("tags")))
    heads = [(c, T.body(T.blank_to_null(F.col(f"`{c}`")), how)) for c, how in m.body.items()]
    return df.select(
        T.note_path(m.base, [F.col(f"`{c}`") for c in m.levels], name, F.col(row)).alias("path"), F.lit(m.framework).alias("fw"), T.source_id(df.columns, F.col(row), m.frontmatter).alias("node_id"),
        head.alias("frontmatter"), (T.sections(heads) if heads else F.lit("")).alias("body"), F.to_json(provenance(m, F.lit(source), F.col(row), df.columns, **known)).alias("provenance"), F.col(row).alias("source_row"),
    )


def level_notes(df: DataFrame, code: str, base: str, fields: Mapping[str, str], level: str, level_fields: Mapping[str, Mapping[str, str]], cumulative: bool = False, tags: str | None = None) -> DataFrame:
    """``path, node_id, frontmatter (JSON)`` of a coded hierarchy: a folder for each segment of the code, or for each of its prefixes if ``cumulative``.

    ``fields`` (column -> key) are in every note, those of ``level_fields`` only where the column ``level`` has their value; blank ones are left out.  ``tags`` is a
    column of tags separated by white space; without any the list is empty.
    """
    c = F.col(f"`{code}`")
    folders = T.cumulative_path(c, ".-") if cumulative else T.split_path(c)
    path = F.concat_ws("/", F.lit(base), F.array_join(folders, "/"), F.concat(c, F.lit(".md")))
    none = F.create_map().cast("map<string,string>")
    extra = [F.when(F.col(f"`{level}`") == value, frontmatter(more)).otherwise(none) for value, more in level_fields.items()]
    listed = F.filter(F.split(T.clean(F.col(f"`{tags}`")), r"\s+"), lambda t: t != "") if tags else F.lit(None).cast("array<string>")
    return df.select(path.alias("path"), c.alias("node_id"), F.to_json(F.struct(F.map_concat(frontmatter(fields), *extra).alias("properties"), listed.alias("tags"))).alias("frontmatter"))


def split_errors(df: DataFrame, required: Column, message: str) -> tuple[DataFrame, DataFrame]:
    """Rows that satisfy ``required``, and the others with ``status`` and ``message``."""
    ok = F.coalesce(required, F.lit(False))
    return df.where(ok), df.where(~ok).withColumn("status", F.lit("error")).withColumn("message", F.lit(message))


def write_plan(new: DataFrame, old: DataFrame, mode: str = "skip", key: str = "path") -> tuple[DataFrame, DataFrame]:
    """``(notes, results)`` of writing ``new`` over ``old``; both have ``key``.

    Of new rows with the same path the last by ``source_row`` is written.  ``skip`` keeps the old row,
    ``replace`` takes the new one, ``error`` keeps the old one and reports an error, ``merge`` (rows have a map ``props``) replaces imported keys and keeps the others.
    """
    if mode not in ("skip", "replace", "error", "merge"):
        raise ValueError(f"unknown conflict mode: {mode}")
    from taxolink.operators.ordered import keep_last

    new = keep_last(new, [key], ["source_row"]) if "source_row" in new.columns else new
    held = old.select(key).distinct().withColumn("_held", F.lit(True))
    marked = new.join(held, key, "left").withColumn("_held", F.coalesce("_held", F.lit(False)))
    status = {"skip": "skipped", "replace": "replaced", "error": "error", "merge": "merged"}[mode]
    results = marked.select(key, F.when(F.col("_held"), status).otherwise("created").alias("status"))
    if mode in ("skip", "error"):
        return old.unionByName(marked.where("not _held").drop("_held"), allowMissingColumns=True), results
    if mode == "replace":
        return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True), results
    both = old.select(key, F.col("props").alias("_old")).join(new.select(key, F.col("props").alias("_new")), key, "full")
    none = F.create_map().cast("map<string,string>")
    kept = F.map_filter(F.coalesce("_old", none), lambda k, _: ~F.array_contains(F.map_keys(F.coalesce("_new", none)), k))
    return both.select(key, F.map_concat(kept, F.coalesce("_new", none)).alias("props")), results
