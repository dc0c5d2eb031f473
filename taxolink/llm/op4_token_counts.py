"""Operator 4, token counts through a digest cache.

A text's key is the SHA-256 of its normalised content (null becomes empty; nothing else, as any other change could
change the count) with the digest of the tokenizer file.  Keys are joined to the stored counts; only distinct texts
without a count are encoded, once each, and appended to the cache, which is a Parquet table partitioned by tokenizer digest.

How it runs at scale: what is looked up in the cache are digests, each once.  Texts of missing digests are reduced to one by a grouped
``any_value`` with partial aggregation, so a group of copies sends at most one text per map task, and move once, by digest; where
few digests are missing, only their texts move.  Counts return by a join of narrow rows on the digest, hot ones apart (``join_hot``).

The library encodes each distinct piece of text once per worker (see ``tokens``).

Null and empty texts count 0 tokens, very long ones count whole; rows that repeat an id, and rows with a null id, stay rows of their own.  An empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolink.llm.common import BROADCAST_ROWS, join_hot, scratch_dir, small_batches, staged, table
from taxolink.llm.op3_token_files import tokenizer_path
from taxolink.llm.tokens import ByteCounts, opened

#: Counts above this are flagged.
LIMIT = 512
CACHE = "digest string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def read_cache(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame | None:
    """The stored counts for one tokenizer version, None if there are none yet."""
    path = f"{cache.rstrip('/')}/tokenizer={tokenizer_digest(tokenizer)}"
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    exists = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)
    return spark.read.schema(CACHE).parquet(path) if exists else None


def keyed(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``(rows, digests)``, written: ``id, n_bytes, digest`` of every row, and ``digest, n`` with the number of its rows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = staged(spark, docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("digest")), "rows")
    return rows, staged(spark, rows.groupBy("digest").agg(F.count("*").alias("n")), "digests")


def add_missing(spark: SparkSession, docs: DataFrame, digests: DataFrame, tokenizer: str, cache: str, text_col: str = "text") -> None:
    """Encode the distinct texts of ``docs`` whose digest is in ``digests`` but not in the cache, and append their counts."""
    small_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts, known = docs.select(F.sha2(text, 256).alias("digest"), text.alias("text")), read_cache(spark, cache, tokenizer)
    distinct = lambda df: df.groupBy("digest").agg(F.any_value("text").alias("text"))
    if known is None:
        misses = distinct(texts)
    else:
        missing = staged(spark, digests.select("digest").join(known.select("digest"), "digest", "left_anti"), "missing")
        n = missing.limit(BROADCAST_ROWS + 1).count()
        if not n:
            return
        misses = distinct(texts.join(F.broadcast(missing), "digest", "left_semi")) if n <= BROADCAST_ROWS else distinct(texts).join(missing, "digest", "left_semi")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = opened(ByteCounts, tokenizer)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(list(count(batch.column("text").to_pylist())), pa.int64())], ["digest", "n_tokens"])

    misses.mapInArrow(encode, CACHE).write.mode("append").parquet(f"{cache.rstrip('/')}/tokenizer={tokenizer_digest(tokenizer)}")


def count_tokens(spark: SparkSession, docs: DataFrame, tokenizer: str, cache: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, n_tokens`` of every row of ``docs``; new counts are appended to ``cache`` first."""
    rows, digests = keyed(spark, docs, id_col, text_col)
    add_missing(spark, docs, digests, tokenizer, cache, text_col)
    # Two runs at once may both store a text; its counts are equal, and one is taken.
    found = staged(spark, digests.select("digest").join(read_cache(spark, cache, tokenizer), "digest").groupBy("digest").agg(F.min("n_tokens").alias("n_tokens")), "found")
    return join_hot(spark, rows, found, ["digest"], counts=digests).select(id_col, "n_bytes", "n_tokens")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts with an empty cache of its own and counts twice: the first pass encodes all distinct texts, the second finds them all in the cache."""
    cache = f"{scratch_dir(spark)}/{uuid.uuid4().hex}/token_counts"
    docs, tokenizer = table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("byte_bpe_50k.json")
    add_missing(spark, docs, keyed(spark, docs, "doc_id", "text")[1], tokenizer, cache)
    return count_tokens(spark, docs, tokenizer, cache).withColumn("over_limit", F.col("n_tokens") > LIMIT)
