"""Operator 1, mixing sources to target weights.

Sizes are summed per source, each source gets a target and from it a repetition rate, and every document
is emitted ``floor(rate)`` times plus one hash-seeded Bernoulli copy with the rate's fraction as its
probability.  Only DataFrame functions are used.

How it runs at scale: a size is one regular-expression count over the text, taken once and written with the row's source and draw key as a narrow
table; texts are never shuffled by source.  Sums per source are partially aggregated before the shuffle, which makes a source with
a third of all rows harmless.  The table of rates has one row per source.  It is broadcast only when it
is counted to be small; otherwise it is joined by shuffle, hot sources apart (``join_hot``).  The windows over sources run in one task: a row
per source, not per document.

The Bernoulli seed of a source is one of ``N_SEEDS`` fixed ones: the copies that each would give are summed over
all documents and the seed nearest to the target is used.  Every document keeps its probability under a
given seed, reruns agree, and very long documents do not throw a source off its target.

Null text has size 0 and a null source is a source of its own.  A size-0 document gets copies like any other
but adds nothing to the sums.  A document's draw hangs on its id and text.  Rows that repeat both (a null id like any other) draw by their place in
the table too, so that a large group of them is not taken or left as one.  With no words at all every target is 0 and nothing is taken; an empty table
gives no rows.  Long texts count whole.  Columns of any name pass through ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taxolink.llm.common import BROADCAST_ROWS, join_hot, n_words, staged, table, unused

#: How many times a source may be repeated at most.
MAX_REPEATS = 3.0
#: Weights of the query, dealt to the sources in code-point order.
CYCLE = (1, 2, 3)
#: Seeds tried for the copies that a rate's fraction gives.
N_SEEDS = 32


def targets(sizes: DataFrame, total: Column | None = None, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """``sizes(source, weight, size)`` with a ``target``: shares of the total by weight, capped, the excess reshared.

    Resharing until no source is above its cap is the same as filling to one level: target = min(cap, weight
    * level).  With sources ordered by cap / weight, the level that holds once the first k are capped is
    (total - their caps) / (weights of the rest); the right one is the first that the next source's own cap / weight reaches.
    The windows run over one row per source, never over documents.
    """
    w = Window.orderBy("_tl_full", "source")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    cap = F.col("size") * F.lit(float(max_repeats))
    ordered = (
        sizes.withColumn("_tl_cap", cap)
        .withColumn("_tl_full", F.col("_tl_cap") / F.col("weight"))
        .withColumn("_tl_total", (F.sum("size").over(everything) if total is None else total).cast("double"))
        .withColumn("_tl_caps", F.coalesce(F.sum("_tl_cap").over(before), F.lit(0.0)))
        .withColumn("_tl_rest", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("_tl_level", (F.col("_tl_total") - F.col("_tl_caps")) / F.col("_tl_rest"))
    )
    first = F.min(F.when(F.col("_tl_full") >= F.col("_tl_level"), F.struct("_tl_full", (-F.col("_tl_level")).alias("level")))).over(everything)
    level = -first["level"]
    filled = ordered.withColumn("target", F.least("_tl_cap", F.coalesce(level, F.col("_tl_cap")) * F.when(level.isNull(), F.lit(1.0)).otherwise(F.col("weight"))))
    return filled.drop("_tl_cap", "_tl_full", "_tl_total", "_tl_caps", "_tl_rest", "_tl_level")


def cycled_weights(sources: DataFrame, cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """``source`` with weights 1, 2, 3, 1, ... in code-point order, null last."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), (place % len(cycle) + 1).cast("int")).cast("double"))


def sized(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(rows, again)``: the written ``id, source, size, key, place`` of each row, and the keys that more than one row has."""
    rows = staged(spark, docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), draw_key(id_col, text_col).alias("key"), place().alias("place")), "sizes")
    again = staged(spark, rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "again")
    return rows, again


def draw_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))


def place() -> Column:
    """A row's place in its table: the same on every run that splits the table alike."""
    return F.monotonically_increasing_id()


def with_draw(spark: SparkSession, rows: DataFrame, again: DataFrame, key: str = "key", place: str = "place", out: str = "draw") -> DataFrame:
    """``rows`` with their draw, the key, mixed with the place where the key is one of ``again``."""
    mark = unused("_tl_again", rows)
    marks = again.select(F.col("key").alias(key), F.lit(True).alias(mark))
    small = again.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    met = rows.join(F.broadcast(marks), key, "left") if small else join_hot(spark, rows, marks, [key], "left", again.withColumnRenamed("key", key))
    return met.withColumn(out, F.when(F.col(mark), F.xxhash64(key, place)).otherwise(F.col(key))).drop(mark)


def _extra(draw: Column, seed: Column, fraction: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(seed, draw), 11).cast("double") / F.lit(float(1 << 53)) < fraction).cast("long")


def rates(spark: SparkSession, docs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """One row per source: ``source, weight, size, target, rate, seed``, written.  ``docs`` has ``draw, source, size``."""
    sizes = docs.groupBy("source").agg(F.sum("size").alias("size"))
    if weights is None:
        weighed = cycled_weights(sizes)
    else:
        weighed = sizes.join(weights.select(F.col("source").alias("_tl_s"), F.col("weight").cast("double")), F.col("source").eqNullSafe(F.col("_tl_s")), "left").drop("_tl_s").fillna(0.0, ["weight"])
    got = staged(spark, targets(weighed.where("weight > 0")).withColumn("rate", F.when(F.col("size") > 0, F.least(F.col("target") / F.col("size"), F.lit(MAX_REPEATS))).otherwise(0.0)), "rates")
    fraction = F.col("rate") - F.floor("rate")
    each = with_rates(spark, docs, got.select("source", "rate")).select("source", "draw", "size", fraction.alias("fraction"), F.explode(F.sequence(F.lit(0), F.lit(N_SEEDS - 1))).alias("seed"))
    per_seed = each.groupBy("source", "seed").agg(F.sum(_extra(F.col("draw"), F.col("seed"), F.col("fraction")) * F.col("size")).alias("extra"))
    miss = F.abs(F.col("extra") + F.floor("rate") * F.col("size") - F.col("target"))
    off = per_seed.join(got.select(F.col("source").alias("_tl_s"), "size", "target", "rate"), F.col("source").eqNullSafe(F.col("_tl_s"))).groupBy("source").agg(F.min(F.struct(miss.alias("off"), "seed"))["seed"].alias("seed"))
    return staged(spark, got.join(off.withColumnRenamed("source", "_tl_s"), F.col("source").eqNullSafe(F.col("_tl_s"))).drop("_tl_s"), "rates")


def with_rates(spark: SparkSession, docs: DataFrame, rates: DataFrame, source: str = "source") -> DataFrame:
    """``docs`` with their source's row of ``rates``; sources without one go."""
    if rates.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        own = rates.withColumnRenamed("source", "_tl_source")
        return docs.join(F.broadcast(own), F.col(source).eqNullSafe(F.col("_tl_source"))).drop("_tl_source")
    # The null source, if any, is one row; all others meet by shuffle, hot ones apart.
    null = rates.where("source is null").withColumnRenamed("source", "_tl_source")
    null = docs.where(F.col(source).isNull()).join(F.broadcast(null), F.col(source).eqNullSafe(F.col("_tl_source"))).drop("_tl_source")
    return join_hot(spark, docs, rates.withColumnRenamed("source", source), [source]).unionByName(null)


def copies(rate: str, seed: str, draw: str) -> Column:
    return F.floor(rate) + _extra(F.col(draw), F.col(seed), F.col(rate) - F.floor(rate))


def mix(spark: SparkSession, docs: DataFrame, weights: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as the mix takes it, columns unchanged.

    ``weights(source, weight)`` are relative; a source that it lacks is left out.  None means ``CYCLE``.
    """
    rows, again = sized(spark, docs, id_col, source_col, text_col)
    key, at, draw, rate, seed, copy = (unused(f"_tl_{c}", docs) for c in ("key", "place", "draw", "rate", "seed", "copy"))
    found = rates(spark, with_draw(spark, rows, again), weights).select("source", F.col("rate").alias(rate), F.col("seed").alias(seed))
    drawn = with_draw(spark, docs.withColumn(key, draw_key(id_col, text_col)).withColumn(at, place()), again, key, at, draw)
    return with_rates(spark, drawn, found, source_col).withColumn(copy, F.explode(F.array_repeat(F.lit(0), copies(rate, seed, draw).cast("int")))).select(*docs.columns)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, again = sized(spark, table(spark, sf_dir, "documents"))
    drawn = with_draw(spark, rows, again)
    rate = rates(spark, drawn).select("source", F.col("size").alias("source_size"), "target", "rate", "seed")
    return with_rates(spark, drawn, rate).select(F.col("id").alias("doc_id"), "size", "source_size", "target", (copies("rate", "seed", "draw") * F.col("size")).cast("long").alias("taken"))
