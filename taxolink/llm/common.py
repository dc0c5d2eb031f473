"""Helpers that the operators share: shared scratch tables, words, key cleaning and size checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words in the query contracts: space and \t \n \v \f \r, nothing else.
SPACE = r"\x20\x09-\x0D"
#: The most rows a side may have to be broadcast by hand; a side over it is joined by shuffle.
BROADCAST_ROWS = 20_000
#: A key that more than one in so many rows have is hot, so there are never more hot keys than this.
HOT_KEYS = 10_000
#: Rows and bytes of one Arrow batch; long texts make larger batches costly.
BATCH_ROWS, BATCH_BYTES = 256, 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a new local one where it is unset and Spark runs in this process alone."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="taxolink-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    """Where this application's own tables go, below the shared folder."""
    return f"{shared_dir(spark)}/taxolink-{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete the tables that this application has written so far; for callers that need no DataFrame made from them any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def unused(name: str, *tables: DataFrame) -> str:
    """``name``, with underscores until no column of the tables has it."""
    taken = {c.lower() for df in tables for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def staged(spark: SparkSession, df: DataFrame, name: str, *partition_by: str, **options: str) -> DataFrame:
    """``df`` written to the shared folder and read back: the lineage is cut, and a lost executor costs nothing.  ``options`` are the writer's."""
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}/{name}"
    writer = df.write.options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Keep Arrow batches of whole texts small; lowers the session's settings, never raises them."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = int(spark.conf.get(key).rstrip("bB"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to have at most ``rows`` rows, else unchanged."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def join_hot(spark: SparkSession, left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """``left`` joined (inner or left) with ``right``, which has at most one row per key, so that no key's rows meet in one task.

    Keys of more than one in ``HOT_KEYS`` rows are joined by broadcast, of about ``HOT_KEYS`` rows of ``right`` at most; rows with a null key go with
    them; all others are joined by shuffle.  Keys are told by their hashes, which come to the driver.  ``counts(*on, n)`` has the number of rows of each
    key, or of some keys, all hot ones among them; all three are read more than once and should be tables.
    """
    if counts is None:
        counts = left.groupBy(*on).agg(F.count("*").alias("n"))
    set_ = F.expr(" and ".join(f"`{c}` is not null" for c in on))
    limit = F.greatest(F.lit(1), F.floor(counts.agg(F.sum("n")).scalar() / HOT_KEYS))  # so there are fewer than ``HOT_KEYS`` above it
    hot = [r["h"] for r in counts.where((F.col("n") > limit) & set_).select(F.xxhash64(*on).alias("h")).collect()]
    if not hot and how == "inner":
        return left.join(right, on)
    apart = set_ & F.expr(f"xxhash64({', '.join(f'`{c}`' for c in on)}) in ({', '.join(map(str, hot)) or 'null'})")
    apart = F.coalesce(apart, F.lit(False))
    few = F.broadcast(right.where(apart))
    if how == "inner":
        return left.where(apart).join(few, on).unionByName(left.where(~apart).join(right, on))
    apart_or_null = apart | ~set_
    return left.where(apart_or_null).join(few, on, "left").unionByName(left.where(~apart_or_null).join(right, on, "left"))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(u, v)``: one row ``(node, component)`` per node, component its smallest node.

    Alternates large-star and small-star steps until only stars are left, about log(n) rounds; every round is a
    grouped minimum and a join on Spark, with its result written to the shared folder.  Nodes without an
    edge are not returned.  Self-loops, repeated and reversed edges change nothing.
    """

    def star(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = staged(spark, both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "low")
        large = join_hot(spark, both.where("v > u"), low.drop("n"), ["u"], counts=low).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = staged(spark, large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "down")
        least = staged(spark, down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        small = join_hot(spark, down, least.drop("n"), ["u"], counts=least).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        return staged(spark, small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")

    def settled(e: DataFrame) -> bool:
        """Whether every larger node has one edge, and to a node that has none of its own."""
        several = e.groupBy("u").agg(F.count("*").alias("c")).where("c > 1").select("u")
        return several.unionByName(e.join(e.select(F.col("v").alias("u")), "u", "left_semi").select("u")).isEmpty()

    start = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    out = staged(spark, start, "edges")
    while not settled(out):
        out = star(out)
    nodes = out.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = out.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(roots.join(nodes, "node", "left_anti"))
