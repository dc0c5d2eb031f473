"""Readers: delimited text, JSON, several sheets, notes (2.1).  Cells stay text; the order of rows can be kept."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

DELIMITERS = ",;\t|"
#: Lines that a delimiter is chosen from.
SNIFF_LINES = 50


def detect_delimiter(spark: SparkSession, path: str, choices: str = DELIMITERS) -> str:
    """The delimiter that occurs in most of the first lines, and most evenly; a comma if none does."""
    lines = spark.read.text(path).where("value <> ''").limit(SNIFF_LINES)
    counts = lines.select(*(F.regexp_count("value", F.lit(f"\\Q{d}\\E")).alias(f"d{i}") for i, d in enumerate(choices)))
    row = counts.agg(*(F.struct(F.avg((F.col(f"d{i}") > 0).cast("int")), -F.coalesce(F.stddev(f"d{i}"), F.lit(0.0)), F.avg(f"d{i}")).alias(f"d{i}") for i in range(len(choices)))).first()
    scores = [(tuple(x if x is not None else 0.0 for x in row[i]), -i) for i in range(len(choices))]
    best, at = max(scores)
    return choices[-at] if best[0] > 0 else ","


def read_csv(spark: SparkSession, path: str | Sequence[str], sep: str | None = ",", columns: Sequence[str] | None = None, multi_line: bool = True, trim_names: bool = True, provenance: bool = False) -> DataFrame:
    """Delimited text with a header; every cell is text, blank lines are skipped, quoted delimiters are honoured.

    ``columns`` gives the schema, and saves the pass over the header.  ``multi_line=False`` lets large files be read in parallel if no cell
    holds a line break.  ``provenance`` adds ``source_file`` and ``source_row`` (1-based, in file order).
    """
    first = path if isinstance(path, str) else path[0]
    sep = sep or detect_delimiter(spark, first)
    reader = spark.read.option("header", True).option("sep", sep).option("multiLine", multi_line).option("escape", '"').option("mode", "PERMISSIVE")
    if columns:
        reader = reader.schema(StructType([StructField(c, StringType()) for c in columns])).option("enforceSchema", True)
    df = reader.csv(path)
    names = [c.strip() for c in df.columns] if trim_names else df.columns
    if not provenance:
        return df.toDF(*names)
    return numbered(df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))).toDF(*names, "source_file", "source_row")


def numbered(df: DataFrame) -> DataFrame:
    """``df`` (with ``_file``, ``_block`` last) with ``source_file`` and ``source_row``, 1-based within its file.

    A block's rows are read by one task one after the other, so their ids have no gaps: a row's place is its id less the least of its block.  Rows are counted per
    block, the counts are summed over the few blocks and met by broadcast, so rows are neither shuffled nor sorted.
    """
    part = F.shiftright("_id", 33)
    inner = df.withColumn("_id", F.monotonically_increasing_id())
    sizes = inner.groupBy("_file", "_block", part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_id").alias("_least"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_file").orderBy("_block", "_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("_file").alias("_f"), F.col("_block").alias("_b"), F.col("_part").alias("_p"), (before - F.col("_least") + 1).alias("_shift"))
    got = inner.join(F.broadcast(starts), (F.col("_file") == F.col("_f")) & (F.col("_block") == F.col("_b")) & (part == F.col("_p")))
    return got.select(*(f"`{c}`" for c in df.columns if c not in ("_file", "_block")), F.col("_file").alias("source_file"), (F.col("_id") + F.col("_shift")).alias("source_row"))


def promote_header(df: DataFrame, order: str, n: int) -> DataFrame:
    """Row ``n`` (0-based, in order) becomes the header; rows up to it go.  Only that row is collected."""
    cols = [c for c in df.columns if c != order]
    top = df.orderBy(order).limit(n + 1).collect()
    head = max(top, key=lambda r: r[order])
    names = [(head[c] or "").strip() or c for c in cols]
    return df.where(F.col(order) > head[order]).select(*(F.col(f"`{c}`").alias(x) for c, x in zip(cols, names, strict=True)), order)


def read_json(spark: SparkSession, path: str, root: str | None = None, schema: StructType | str | None = None, multi_line: bool = True) -> DataFrame:
    """Records of a JSON array, or of the array at the dotted path ``root``."""
    reader = spark.read.option("multiLine", multi_line).option("primitivesAsString", True)
    df = (reader.schema(schema) if schema else reader).json(path)
    return df.select(F.explode(root).alias("_r")).select("_r.*") if root else df


def read_any(spark: SparkSession, path: str, **options) -> DataFrame:
    """Reader by file extension: csv, tsv, json, jsonl, parquet or orc."""
    ext = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ext in ("csv", "tsv", "txt"):
        return read_csv(spark, path, **({"sep": "\t"} if ext == "tsv" else {}) | options)
    if ext in ("json", "jsonl", "ndjson"):
        return read_json(spark, path, **({"multi_line": False} if ext != "json" else {}) | options)
    if ext in ("parquet", "orc"):
        return spark.read.format(ext).load(path)
    raise ValueError(f"no reader for {path}")


def read_sheets(spark: SparkSession, sheets: dict[str, str], views: bool = True, **options) -> dict[str, DataFrame]:
    """Several named tables, each also a temporary view if asked for."""
    got = {name: read_any(spark, path, **options) for name, path in sheets.items()}
    for name, df in got.items():
        if views:
            df.createOrReplaceTempView(name)
    return got


def read_notes(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """``path, text`` of every note below a folder; Spark gives paths in URI form, which is undone."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True)
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return df.select(path.alias("path"), F.col("value").alias("text"))
