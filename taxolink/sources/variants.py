"""Records of mixed shape as ``VARIANT`` (SRC-8, SRC-10): no pass over the data for a schema, and no value lost to one.

A reader that infers a schema reads everything once and gives a field one type; where records disagree, values become text or null.  Here each record is parsed on its own and
keeps what it has; a field is taken out by path, with a type or as text, when it is asked for.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_records(spark: SparkSession, path: str, root: str | None = None, whole_files: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(records, quarantined)``: ``record`` (VARIANT) of every line, or of every file, and ``text`` of those that are no JSON; blank lines are skipped.

    ``root`` is the dotted path of an array whose items are the records; texts without such an array have none.
    """
    text = spark.read.text(path, wholetext=whole_files).where(F.trim("value") != "")
    parsed = text.select(F.col("value").alias("text"), F.try_parse_json("value").alias("record"))
    good = parsed.where("record is not null").select("record")
    if root:
        good = good.select(F.explode(F.try_variant_get("record", f"$.{root}", "array<variant>")).alias("record"))
    return good, parsed.where("record is null").select("text")


def fields(records: DataFrame, wanted: Mapping[str, str], record: str = "record") -> DataFrame:
    """The fields ``name -> dotted path`` of every record as text, whatever their types; objects and lists are JSON, missing ones and nulls are null."""
    return records.select(*(F.try_variant_get(record, f"$.{path}", "string").alias(name) for name, path in wanted.items()))


def typed(records: DataFrame, wanted: Mapping[str, tuple[str, str]], record: str = "record") -> DataFrame:
    """The fields ``name -> (dotted path, type)``; a value that has another type is null there, and still in ``record``, which stays."""
    return records.select(*(F.try_variant_get(record, f"$.{path}", kind).alias(name) for name, (path, kind) in wanted.items()), record)


def shapes(records: DataFrame, path: str, record: str = "record") -> DataFrame:
    """``shape, n``: which types a field has, and how often."""
    one = F.schema_of_variant(F.try_variant_get(record, f"$.{path}", "variant"))
    return records.groupBy(F.coalesce(one, F.lit("missing")).alias("shape")).agg(F.count("*").alias("n"))
