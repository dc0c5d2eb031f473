"""Operator 8, exact top-k search with one KD-tree per shard.

Vectors become integers, floor(256 * x), and are dealt evenly into shards.  Each shard is split at
medians of its widest dimension down to leaves of ``LEAF`` rows, and every node keeps the tight box of its
rows.  For a query the largest inner product inside a box is the sum over dimensions of max(q lo, q hi).  Nodes
are visited best first; the search ends when the next bound is below the k-th score.  Bounds equal to it are
still visited where the node has an id small enough to win the tie, so ties go to the smaller id, and a vector that very many rows share costs little.

The k-th score travels between shards in two rounds: every query first searches one shard, and its k-th score goes with it to all the
others, where whole subtrees are below it.

How it runs at scale: queries are a stated set that meets all rows, so the work is queries times rows.  Trees are written once, one row per
shard, and stay where they are.  Queries come in waves of about ``WAVE_BYTES``; a wave is broadcast, and every task runs it against the
shards that it reads, so no vector is shuffled after the trees are planted and nothing is sent per pair of shard and query but at most k
hits.  A wave and its k-th scores are all that the driver holds; its broadcast is destroyed before the next one.

Vectors that are null or hold null or non-finite components take no part, nor do rows with a null
id.  Vectors of another length than the query's are not its candidates.  Every row is a row of its own, also where it repeats an id or a vector: each
row whose id is asked for is a query, and all rows but itself are its candidates.  Empty tables give no rows, vectors may have any length, and
other columns are not read.  Scores are exact while they fit a long.
"""

from __future__ import annotations

import heapq
import pickle
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taxolink.llm.common import staged, table

K = 5
#: Every row whose id this divides is a query.
EVERY = 50
LEAF, SHARD_ROWS = 64, 8_192
#: Shards are no smaller than this for the sake of more tasks.
LEAST_SHARD_ROWS = 1_024
#: Tasks that plant trees at most; a task holds one shard at a time.
MOST_TASKS = 4_096
#: Bytes of the query vectors in one wave, and queries whose bounds are computed at once.
WAVE_BYTES, BLOCK_ROWS = 8 << 20, 256

ORACLE_SQL = r"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


class Tree:
    """A KD-tree over the rows of one shard; ``marks`` tell rows with equal ids apart."""

    def __init__(self, ids: np.ndarray, marks: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        order, spans, children, lows, highs, least = np.arange(len(ids)), [], [], [], [], []

        def grow(a: int, b: int) -> int:
            node, part = len(spans), rows[order[a:b]]
            spans.append((a, b))
            children.append(None)
            lows.append(part.min(axis=0))
            highs.append(part.max(axis=0))
            least.append(int(ids[order[a:b]].min()))
            if b - a > leaf and rows.shape[1]:
                dim = int(np.argmax(highs[node] - lows[node]))
                middle = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(part[:, dim], middle, kind="introselect")]
                children[node] = (grow(a, a + middle), grow(a + middle, b))
            return node

        grow(0, len(ids))
        self.ids, self.marks, self.rows, self.spans, self.children = ids[order], marks[order], rows[order], spans, children
        self.low, self.high, self.least = np.stack(lows), np.stack(highs), least

    def search(self, queries: list[tuple[int, int | None]], vectors: np.ndarray, k: int) -> Iterator[list[tuple[int, int]]]:
        """For each query, as ``(mark, k-th score known so far or None)``, the best ``(score, vec_id)`` of this shard that can still count."""
        exact = float(np.abs(vectors).max(initial=0)) * float(np.abs(self.rows).max(initial=0)) * max(1, self.rows.shape[1]) < 2**52
        kind = np.float64 if exact else np.int64  # doubles are exact here and faster
        rows, q = self.rows.astype(kind), vectors.astype(kind)
        bounds = np.maximum(q, 0) @ self.high.astype(kind).T + np.minimum(q, 0) @ self.low.astype(kind).T
        for (own, known), vector, bound in zip(queries, q, bounds, strict=True):
            best: list[tuple[int, int]] = []  # a heap: the worst of the best is first
            floor = -np.inf if known is None else known
            todo = [(-bound[0], 0)]
            while todo and -todo[0][0] >= floor:
                node = heapq.heappop(todo)[1]
                if len(best) == k and (bound[node], -self.least[node]) <= best[0]:
                    continue  # at best as good as the worst of the best, and no smaller id
                if self.children[node]:
                    for child in self.children[node]:
                        if bound[child] >= floor:
                            heapq.heappush(todo, (-bound[child], child))
                    continue
                a, b = self.spans[node]
                scores = rows[a:b] @ vector
                for i in np.flatnonzero(scores >= floor):
                    if self.marks[a + i] != own:
                        entry = (int(scores[i]), -int(self.ids[a + i]))
                        if len(best) < k:
                            heapq.heappush(best, entry)
                        elif entry > best[0]:
                            heapq.heapreplace(best, entry)
                if len(best) == k:
                    floor = max(floor, best[0][0])
            yield [(s, -i) for s, i in best]


def integers(embedding: Column) -> Column:
    return F.transform(embedding, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long"))


def usable(df: DataFrame, is_query: Column, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, mark, asked, e, dim`` of the rows that take part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    e = F.col(vector_col)
    return df.where(F.col(id_col).isNotNull() & e.isNotNull() & F.forall(e, finite)).select(
        F.col(id_col).cast("long").alias("vec_id"), F.monotonically_increasing_id().alias("mark"), F.coalesce(is_query, F.lit(False)).alias("asked"), integers(e).alias("e"), F.size(e).alias("dim")
    )


def _matrix(vectors: list) -> np.ndarray:
    return np.stack(vectors).astype(np.int64) if len(vectors) else np.zeros((0, 0), np.int64)


def _narrow(rows: np.ndarray) -> np.ndarray:
    return rows.astype(np.min_scalar_type(int(-np.abs(rows).max(initial=1)) - 1))


class Wave(NamedTuple):
    """Queries of one length: their marks, vectors, first shards and the k-th scores known so far."""

    marks: np.ndarray
    vectors: np.ndarray
    homes: np.ndarray
    known: list[int | None]


def search_shards(trees: DataFrame, wave: Broadcast, k: int, home: bool) -> DataFrame:
    """``query, vec_id, score``: hits of the wave's queries in their first shards (``home``), or in all others."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, shard, blob in batch[["dim", "shard", "tree"]].itertuples(index=False):
                if dim not in wave.value:
                    continue
                w: Wave = wave.value[dim]
                here = np.flatnonzero((w.homes == shard) == home)
                tree = pickle.loads(blob) if len(here) else None
                for at in range(0, len(here), BLOCK_ROWS):
                    some = here[at : at + BLOCK_ROWS]
                    asked = [(w.marks[i], w.known[i]) for i in some]
                    flat = [(mark, vec_id, score) for (mark, _), best in zip(asked, tree.search(asked, w.vectors[some], k), strict=True) for score, vec_id in best]
                    yield pd.DataFrame(flat, columns=["query", "vec_id", "score"]).astype("int64")

    return trees.mapInPandas(run, "query long, vec_id long, score long")


def top_k(spark: SparkSession, vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows of ``vectors`` where ``is_query``, against all rows."""
    rows = staged(spark, usable(vectors, is_query, id_col, vector_col), "vectors")
    n = rows.count()
    n_shards = max(1, -(-n // shard_rows), min(2 * spark.sparkContext.defaultParallelism, -(-n // LEAST_SHARD_ROWS)))
    # Dealt by the hash of a row's own mark: repeated ids or vectors spread over all shards.
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("mark"), F.lit(n_shards)).cast("int"))

    def plant(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(pdf["vec_id"].to_numpy(np.int64), pdf["mark"].to_numpy(np.int64), _narrow(_matrix(pdf["e"].to_list())))
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "tree": [pickle.dumps(tree)]})

    planted = dealt.select("dim", "shard", "vec_id", "mark", "e").repartition(min(n_shards, MOST_TASKS), "dim", "shard").groupBy("dim", "shard").applyInPandas(plant, "dim int, shard int, tree binary")
    trees = staged(spark, planted, "trees")
    asked = rows.where("asked")
    n_waves = max(1, -(-(asked.agg(F.sum(8 * F.col("dim").cast("long"))).first()[0] or 0) // wave_bytes))
    waves = staged(spark, asked.withColumn("wave", F.pmod(F.xxhash64("mark"), F.lit(n_waves)).cast("int")).select("wave", "dim", "mark", "e"), "waves", "wave")
    hits: list[DataFrame] = []
    for i in range(n_waves):
        by_dim: dict[int, list] = defaultdict(list)
        for r in waves.where(F.col("wave") == i).select("dim", "mark", "e").collect():
            by_dim[r["dim"]].append((r["mark"], r["e"]))
        wave = {d: Wave(marks := np.array([m for m, _ in x], np.int64), _narrow(_matrix([e for _, e in x])), marks % n_shards, [None] * len(x)) for d, x in by_dim.items()}
        for home in (True, False):
            shared = spark.sparkContext.broadcast(wave)
            hits.append(staged(spark, search_shards(trees, shared, k, home), "hits"))
            shared.destroy()
            if home:
                kth = {r["query"]: r["score"] for r in hits[-1].groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("score")).where(F.col("n") >= k).collect()}
                wave = {d: w._replace(known=[kth.get(int(m)) for m in w.marks]) for d, w in wave.items()}
    found = reduce(DataFrame.unionByName, hits).join(asked.select(F.col("mark").alias("query"), F.col("vec_id").alias("query_id")), "query")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)
