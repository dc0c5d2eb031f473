"""Incremental ingest and running link counts as Structured Streaming (2.11)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from taxolink.operators.evidence import STALE_DAYS, freshness
from taxolink.operators.ordered import keep_first


def file_stream(spark: SparkSession, path: str, schema: StructType, kind: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """Files of a folder, or one file, as a stream (a single file has to be named by a pattern)."""
    path = f"{path[:-1]}[{path[-1]}]" if path.endswith(f".{kind}") else path
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.format(kind).load(path)


def ingest_new(stream: DataFrame, out: str, key: str, order: Sequence[str], checkpoint: str, parts: int = 64) -> StreamingQuery:
    """Append the rows whose key the table at ``out`` does not have; of a batch's rows with one key the first counts.

    Beside the rows, below ``out``/rows, each batch writes the keys that it adds, below ``out``/keys, in parts by hash; a later batch reads the parts that its own
    keys fall into, and of them the key column alone.  Every batch has folders of its own that are overwritten if it is repeated, and
    batches before it are what is known: so a restart after any failure gives the same table.
    """
    schema = stream.schema
    keys = f"{schema[key].name} {schema[key].dataType.simpleString()}, part int, batch long"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = keep_first(batch, [key], order).withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")).persist()
        touched = [r["part"] for r in rows.select("part").distinct().collect()]  # at most ``parts``
        fresh = rows
        if batch_id and touched:
            # Folders of later batches cannot exist but as remains of this one's failed try, so they are left out.
            known = spark.read.schema(keys).parquet(f"{out}/keys").where(F.col("part").isin(touched) & (F.col("batch") < batch_id)).select(key)
            fresh = rows.join(known, key, "left_anti")
        # Keys first: ``part`` and ``batch`` are folders, and only this batch's are overwritten.
        fresh.select(key, "part").withColumn("batch", F.lit(batch_id).cast("long")).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("part", "batch").parquet(f"{out}/keys")
        fresh.drop("part").select(*schema.names).write.mode("overwrite").parquet(f"{out}/rows/batch={batch_id}")
        rows.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested(spark: SparkSession, out: str, schema: StructType) -> DataFrame:
    """The table that ``ingest_new`` wrote."""
    return spark.read.schema(schema).option("basePath", f"{out}/rows").parquet(f"{out}/rows").select(*schema.names)


def running_counts(stream: DataFrame, by: Sequence[str]) -> DataFrame:
    """Links per framework so far; use output mode ``update`` or ``complete``."""
    return stream.groupBy(*by).agg(F.count("*").alias("n_links"))


def windowed_counts(stream: DataFrame, time: str, by: Sequence[str], every: str = "1 day", late: str = "1 day") -> DataFrame:
    """Links per window; windows close (and their state goes) when the watermark passes them."""
    return stream.withWatermark(time, late).groupBy(F.window(time, every), *by).agg(F.count("*").alias("n_links")).select(F.col("window.start").alias("start"), *by, "n_links")


def run_to_folder(stream: DataFrame, out: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """The rows that each batch changes (mode ``update``) or adds (``append``), written to a folder of the batch's own below ``out``; state is what the watermark leaves."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, out: str, schema: StructType, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """The last row of each key that ``run_to_folder`` wrote; ``order`` decides within a batch."""
    rows = spark.read.schema(StructType([*schema.fields, StructField("batch", IntegerType())])).option("basePath", out).parquet(out)
    return keep_first(rows, list(keys), ["batch", *order], last=True).drop("batch")


def freshness_changes(stream: DataFrame, key: str, collected: str, expires: str, time: str, late: str = "1 day", window: int = STALE_DAYS) -> DataFrame:
    """``key, freshness, changed``: how fresh each key's evidence was when its newest record came, at event time; running state is one row per key.

    A record may come late by ``late``; of a key's records the one with the latest ``time`` counts.
    """
    newest = stream.withWatermark(time, late).groupBy(key).agg(F.max_by(F.struct(collected, expires, time), time).alias("_n"))
    n = F.col("_n")
    return newest.select(key, freshness(n[collected], n[expires], F.to_date(n[time]), window).alias("freshness"), n[time].alias("changed"))
