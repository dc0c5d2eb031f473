"""Column profiles, type and pattern inference, fingerprints and config matching over a catalog of tables (2.6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxolink.functions import text as T

#: Share of values that decides a type, and a pattern.
TYPE_SHARE, PATTERN_SHARE = 0.8, 0.7
#: Rows that patterns are looked for in, and values kept as samples.
PATTERN_ROWS, SAMPLES = 20, 5
#: Saved configs that are broadcast, at most.
FEW_CONFIGS = 1_000
#: What boolean text looks like, and the patterns in order of precedence.
BOOLEANS = ("true", "false", "yes", "no", "1", "0")
PATTERNS = (
    ("control_id", r"(?i)^[A-Z]{2,3}-\d+(\(\d+\))?$"),
    ("cis_control", r"^\d+(\.\d+)+$"),
    ("uuid", r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-"),
    ("url", r"(?i)^https?://"),
    ("comma_list", r"^[^,]+,[^,]+"),
)


def unpivot(df: DataFrame, order: str, columns: Sequence[str] | None = None) -> DataFrame:
    """``row, pos, col, val``: one row for each cell; blank cells have a null value."""
    columns = columns or [c for c in df.columns if c != order]
    cells = F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(c).alias("col"), F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")).alias("val")) for i, c in enumerate(columns)))
    return df.select(F.col(order).alias("row"), F.explode(cells).alias("c")).select("row", "c.*")


def inferred_type(n: Column, numbers: Column, booleans: Column, lists: Column, share: float = TYPE_SHARE) -> Column:
    """Number is tested before boolean, so a 0/1 column is a number."""
    return F.when(n == 0, "string").when(numbers / n >= share, "number").when(booleans / n >= share, "boolean").when(lists / n >= share, "array").otherwise("string")


def profile(df: DataFrame, order: str, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """One row per column, in column order: samples, inferred type, whether it has blanks, distinct values.

    Two grouped passes over cells: the least ``SAMPLES`` cells come from a bounded aggregate per map task, so no
    column's values are gathered; distinct values are counted after a grouping of (column, value), or approximately with ``exact=False``.
    """
    cells = unpivot(df, order, columns)
    x = F.col("val")
    is_ = lambda p: F.sum(F.coalesce(p, F.lit(False)).cast("long"))
    stats = cells.groupBy("pos", "col").agg(
        F.count("val").alias("n"),
        (F.count("val") < F.count("*")).alias("has_empty"),
        is_(T.is_number(x)).alias("_num"),
        is_(F.lower(T.strip(x)).isin(*BOOLEANS)).alias("_bool"),
        is_(F.contains(T.strip(x), F.lit(","))).alias("_list"),
        *([] if exact else [F.approx_count_distinct("val").alias("n_distinct")]),
    )
    if exact:
        distinct = cells.where("val is not null").groupBy("pos", "val").agg(F.lit(1).alias("_")).groupBy("pos").agg(F.count("*").alias("n_distinct"))
        stats = stats.join(distinct, "pos", "left").fillna(0, ["n_distinct"])
    firsts = first_values(cells, SAMPLES)
    kind = inferred_type(F.col("n"), F.col("_num"), F.col("_bool"), F.col("_list"))
    return stats.join(firsts, "pos", "left").select("pos", "col", F.coalesce("samples", F.array().cast("array<string>")).alias("samples"), kind.alias("type"), "has_empty", "n_distinct")


def first_values(cells: DataFrame, n: int) -> DataFrame:
    """``pos, samples``: the first ``n`` values that are not blank, by row."""
    from taxolink.operators.ordered import samples

    return samples(cells.where("val is not null"), ["pos"], "val", "row", n)


def patterns(df: DataFrame, order: str, columns: Sequence[str] | None = None) -> DataFrame:
    """``pos, col, pattern, examples`` of the columns whose first rows mostly have one of the known patterns; the first one counts."""
    first = df.orderBy(order).limit(PATTERN_ROWS)
    cells = unpivot(first, order, columns).where("val is not null")
    got = cells.groupBy("pos", "col").agg(
        *(F.avg(F.col("val").rlike(p).cast("double")).alias(name) for name, p in PATTERNS),
        F.array_sort(F.collect_list(F.struct("row", "val"))).alias("_v"),  # at most PATTERN_ROWS values
    )
    name = F.coalesce(*(F.when(F.col(n) >= PATTERN_SHARE, F.lit(n)) for n, _ in PATTERNS))
    test = F.coalesce(*(F.when(F.col("pattern") == n, F.lit(p)) for n, p in PATTERNS))
    named = got.withColumn("pattern", name).where("pattern is not null").withColumn("_p", test)
    return named.select("pos", "col", "pattern", F.slice(F.expr("transform(filter(_v, x -> x.val rlike _p), x -> x.val)"), 1, 3).alias("examples"))


def table_patterns(cells: DataFrame) -> DataFrame:
    """``tbl, col, pattern`` for many tables at once, given as ``cells(tbl, col, row, val)``: as ``patterns``, over the first rows of each table.

    Only the first rows' numbers are ranked, ``PATTERN_ROWS`` per table and map task at most; shares are grouped with partial sums, so a long table is no large group.
    """
    from taxolink.operators.ordered import samples

    first = samples(cells.select("tbl", "row").distinct(), ["tbl"], "row", "row", PATTERN_ROWS).select("tbl", F.explode("samples").alias("row"))
    near = cells.where("val is not null").join(first, ["tbl", "row"])
    shares = near.groupBy("tbl", "col").agg(*(F.avg(F.col("val").rlike(p).cast("double")).alias(name) for name, p in PATTERNS))
    return shares.select("tbl", "col", F.coalesce(*(F.when(F.col(n) >= PATTERN_SHARE, F.lit(n)) for n, _ in PATTERNS)).alias("pattern")).where("pattern is not null")


def file_pattern(name: Column) -> Column:
    """``NIST_800-53_rev5.csv`` -> ``nist*****rev*``: separators, then digits, become stars."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(name), r"\.[^.]+$", ""), r"[_\-\s]+", "*"), r"\d+", "*")


def fingerprints(columns: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """One row per table of a catalog ``columns(tbl, pos, name, source_type, file_name)``: names, normal names, count, file pattern.

    With ``found(tbl, col, pattern)``, as ``table_patterns`` gives it, also ``patterns``: which columns hold values of a known form.  A table has as many rows here as it has
    columns, so a group is never large.
    """
    got = columns.groupBy("tbl", "source_type", "file_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("names"))
    norm = F.transform("names", lambda n: F.regexp_replace(F.trim(F.lower(n)), "[^a-z0-9]", "_"))
    out = got.select("tbl", "source_type", "names", norm.alias("normal"), F.size("names").alias("n_columns"), file_pattern(F.col("file_name")).alias("file_pattern"))
    if found is None:
        return out
    known = found.groupBy("tbl").agg(F.array_sort(F.collect_list(F.struct("col", "pattern"))).alias("patterns"))
    return out.join(known, "tbl", "left").withColumn("patterns", F.coalesce("patterns", F.array().cast("array<struct<col:string,pattern:string>>")))


def match_configs(tables: DataFrame, configs: DataFrame, now: Column, least: int = 30) -> DataFrame:
    """Scored pairs of ``tables`` and saved ``configs`` (both fingerprints; configs have ``config`` and ``last_used``), best first per table.

    Points (fixed values): columns in common over the larger count above 0.8 or 0.5 give 40 or 25; a larger share of
    normal names 15; equal counts 10, within two 5; equal type 5; a common column or pattern of the samples 15; a
    common part of the file pattern 10; used within seven days 5; at most 100 in all.
    Candidates share a normal column name, which is an equi-join on exploded names: without one a pair has at most 10 + 5 + 10 + 5
    points (and 15 for a shared pattern), so pairs sharing a pattern or file part are met by those too.
    """
    t = tables.select("tbl", "names", "normal", "n_columns", "source_type", "file_pattern", *([c for c in ("patterns",) if c in tables.columns]))
    has = "patterns" in tables.columns and "patterns" in configs.columns
    none = F.array().cast("array<struct<col:string,pattern:string>>")
    t = t.withColumn("patterns", F.col("patterns") if has else none)
    c = configs.select("config", "last_used", *(F.col(x).alias("c_" + x) for x in ("names", "normal", "n_columns", "source_type", "file_pattern")), (F.col("patterns") if has else none).alias("c_patterns"))
    cues = lambda normal, pats, file: F.array_distinct(F.concat(F.transform(normal, lambda n: F.concat(F.lit("c:"), n)), F.transform(pats, lambda p: F.concat(F.lit("p:"), p["pattern"])), F.transform(F.filter(F.split(F.coalesce(file, F.lit("")), r"\*"), lambda x: x != ""), lambda x: F.concat(F.lit("f:"), x))))
    a = t.select("tbl", F.explode(cues(F.col("normal"), F.col("patterns"), F.col("file_pattern"))).alias("cue"))
    b = c.select("config", F.explode(cues(F.col("c_normal"), F.col("c_patterns"), F.col("c_file_pattern"))).alias("cue"))
    # Saved configs are few: a table of them by cue or name goes to all tasks, as all tables would meet in one task for each config otherwise.
    few = configs.limit(FEW_CONFIGS + 1).count() <= FEW_CONFIGS
    to_all = F.broadcast if few else (lambda df: df)
    pairs = a.join(to_all(b), "cue").select("tbl", "config").distinct().join(t, "tbl").join(to_all(c), "config")
    larger = F.greatest("n_columns", "c_n_columns")
    exact = F.size(F.array_intersect("names", "c_names")) / larger
    normal = F.size(F.array_intersect("normal", "c_normal")) / larger
    gap = F.abs(F.col("n_columns") - F.col("c_n_columns"))
    field = lambda arr, f: F.transform(arr, lambda p: p[f])
    shared = F.arrays_overlap(field(F.col("patterns"), "col"), field(F.col("c_patterns"), "col")) | F.arrays_overlap(field(F.col("patterns"), "pattern"), field(F.col("c_patterns"), "pattern"))
    parts = lambda p: F.filter(F.split(F.coalesce(p, F.lit("")), r"\*"), lambda x: x != "")
    points = (
        F.when(exact > 0.8, 40).when(exact > 0.5, 25).otherwise(0)
        + F.when(normal > exact, 15).otherwise(0)
        + F.when(gap == 0, 10).when(gap <= 2, 5).otherwise(0)
        + F.when(F.col("source_type").eqNullSafe(F.col("c_source_type")), 5).otherwise(0)
        + F.when(F.coalesce(shared, F.lit(False)), 15).otherwise(0)
        + F.when(F.arrays_overlap(parts(F.col("file_pattern")), parts(F.col("c_file_pattern"))), 10).otherwise(0)
        + F.when(F.datediff(now, "last_used") < 7, 5).otherwise(0)
    )
    return pairs.withColumn("score", F.least(points, F.lit(100))).where(F.col("score") > least).select("tbl", "config", "score").orderBy("tbl", F.desc("score"), "config")


def estimate(df: DataFrame, levels: Sequence[str], links: Sequence[str]) -> DataFrame:
    """One row: notes, folders (distinct path prefixes and the base) and links (items of link cells) that ``df`` would give."""
    parts = F.filter(F.array(*(F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")) for c in levels)), lambda x: x.isNotNull())
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    folders = df.select(F.explode(F.when(F.size(parts) > 0, prefixes)).alias("p")).distinct().agg((F.count("*") + 1).alias("folders")) if levels else None
    items = lambda c: F.coalesce(F.when(F.length(c) > 0, F.size(F.split(c, "[,;]", -1))), F.lit(0))
    n_links = sum((items(F.col(f"`{c}`").cast("string")) for c in links), F.lit(0))
    totals = df.agg(F.count("*").alias("notes"), F.coalesce(F.sum(n_links), F.lit(0)).cast("long").alias("links"))
    joined = totals.withColumn("folders", F.lit(1) if folders is None else folders.scalar())
    return joined.select("notes", F.col("folders").cast("long").alias("folders"), "links")


def config_roles(config: DataFrame, columns: DataFrame) -> DataFrame:
    """``name, role, output``: what a saved mapping says of each column of ``columns(name)``, ignoring case.

    ``config(column, role, output)``; of several roles the later in hierarchy, frontmatter, link, body counts, and title only if there is no
    other; columns without a role are ``skip``.
    """
    place = F.array_position(F.array(*map(F.lit, ("title", "hierarchy", "frontmatter", "link", "body"))), F.col("role"))
    best = config.groupBy(F.lower("column").alias("k")).agg(F.max(F.struct(place.alias("p"), "role", "output")).alias("b"))
    return columns.join(best, F.lower("name") == F.col("k"), "left").select("name", F.coalesce("b.role", F.lit("skip")).alias("role"), F.coalesce("b.output", "name").alias("output"))
