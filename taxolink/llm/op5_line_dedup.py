"""Operator 5, dropping lines that many documents share.

Lines are exploded, normalised and hashed; the distinct documents of each hash are counted; a line whose key reaches
the threshold is dropped everywhere except in the largest document id that holds it; documents are
reassembled by position.  Only DataFrame functions are used.

How it runs at scale: long lines are written once as narrow rows of document, position and a 16-byte hash.  Documents of a hash are counted by two
partially aggregated groupings, so a line that every document holds never meets in one task; hot hashes are joined apart (``join_hot``).  What goes
back to a document are the positions of its dropped lines, in order; its text moves once, to meet them, and the lines between dropped positions are
put together again, in time linear in the text.

Two independent 64-bit hashes identify a key: at 10^12 distinct lines one would collide.

A null or empty text is one empty line.  Rows that share an id count as one document, and each keeps its own lines (a row is known by its id and
its text's hash).  Rows with a null id keep all lines and are not counted, as no id says which of them is largest.  An empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolink.llm.common import HOT_KEYS, ascii_lower, join_hot, staged, table

#: Shorter keys are never dropped (code points).
MIN_CHARS = 40
#: A key in so many documents is shared.
MIN_DOCS = 5

ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, i AS pos, l AS line,
         translate(trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l,
               unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)),
hot AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT lines.*, hot.k IS NOT NULL AND doc_id <> keeper AS dropped FROM lines LEFT JOIN hot ON lines.k = hot.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """Stripped, A-Z lower-cased.  ``lower`` does that to pure ASCII and is faster than ``translate``."""
    key = F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.octet_length(line) == F.length(line), F.lower(key)).otherwise(ascii_lower(key))


def key_hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit("taxolink"), key).alias("b"))


def line_hashes(text: Column, min_chars: int) -> Column:
    """The hash of every line's key, null if the key is too short; each step is evaluated once per line."""
    keys = F.transform(lines_of(text), lambda x: F.when(F.length(x) >= min_chars, line_key(x)))
    return F.transform(keys, lambda k: F.when(F.length(k) >= min_chars, key_hash(k)))


def long_lines(spark: SparkSession, docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, h, pos, a, b``, written: the place and the hash of each long line of ``docs(doc_id, text)``; ``h`` is the text's hash."""
    each = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("h"), F.posexplode(line_hashes(F.col("text"), min_chars)).alias("pos", "k"))
    return staged(spark, each.where("k is not null").select("doc_id", "h", "pos", "k.a", "k.b"), "lines")


def shared_keys(spark: SparkSession, lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``a, b, n, n_docs, keeper``, written, of the keys that are in ``min_docs`` documents, and of all hot ones: lines, documents, largest document."""
    hot = lines.count() // HOT_KEYS
    per_doc = lines.groupBy("a", "b", "doc_id").agg(F.count("*").alias("c"))
    return staged(spark, per_doc.groupBy("a", "b").agg(F.sum("c").alias("n"), F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper")).where((F.col("n_docs") >= min_docs) | (F.col("n") > hot)), "shared")


def without(text: Column, drop: Column) -> Column:
    """``text`` less the lines at the 0-based positions ``drop`` (in order): the stretches between them, joined."""

    def stretches(lines: Column) -> Column:
        spans = F.arrays_zip(F.concat(F.array(F.lit(0)), F.transform(drop, lambda i: i + 1)).alias("a"), F.concat(drop, F.array(F.size(lines))).alias("b"))
        return F.flatten(F.transform(spans, lambda s: F.slice(lines, s["a"] + 1, s["b"] - s["a"])))

    return F.array_join(F.transform(F.array(lines_of(text)), stretches)[0], "\n")  # the outer transform splits the text once


def drop_shared_lines(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc_id, kept_text, n_lines, n_dropped`` of every row of ``docs``."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    lines = long_lines(spark, docs, min_chars)
    keys = shared_keys(spark, lines, min_docs)
    shared = keys.where(F.col("n_docs") >= min_docs).select("a", "b", "keeper")
    gone = join_hot(spark, lines, shared, ["a", "b"], counts=keys).where("doc_id <> keeper")
    drops = staged(spark, gone.groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("pos")).alias("drop")), "drops")
    joined = docs.withColumn("h", F.xxhash64("text")).join(drops, ["doc_id", "h"], "left")
    text = F.coalesce("text", F.lit(""))
    return joined.select(
        "doc_id",
        F.when(F.col("drop").isNull(), text).otherwise(without(text, F.col("drop"))).alias("kept_text"),
        F.size(lines_of(text)).cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_shared_lines(spark, table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
