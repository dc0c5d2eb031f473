"""Operator 9, a quality classifier by Bradley-Terry pairwise ranking.

Every document has a feature vector from its whole text.  From labelled documents, preference pairs (one of
quality 1, one of quality 0) are drawn, and weights w are learned so that P(a preferred to b) =
sigmoid(w . (x_a - x_b)), by Newton steps on the logistic loss of feature differences.  A document's strength is w . x.
The threshold is a quantile of the labelled strengths, at the share of documents labelled 0; strengths are
mapped to scores so that this quantile gets ``CUT``.

How it runs at scale: the model is learned from every labelled document that is not held out.  Their feature vectors are dealt by the hash of their ids into parts of about ``PART`` rows and
written.  In its part, each document of either label is in preference pairs: with all of the other label where these are few, else with at least ``PARTNERS`` (the smaller label's rows
repeat).  Means, deviations and the gradient and Hessian of every Newton step are sums over all parts, added in their order; a part sends about 24 KB to the driver for a step.
The threshold is the exact quantile of all labelled strengths, found by counts in ever narrower bins.  Scoring is one pass, without a shuffle.

Inputs of a score are features of the text alone.  Null text is empty text; an empty text has
zero features and is scored like any other, a very long one is read whole.  An empty table gives no rows; repeated rows get equal scores;
other columns of any name pass through ``keep_good``.  Rows with a null id are scored, and count as held out.  If an
id is labelled more than once, its least label holds.  Labels that are null or not 0 or 1 are left out.  Without
labels of both kinds nothing can be learned: every score is 0.5.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from taxolink.llm.common import small_batches, table, unused
from taxolink.operators.graph import shared_folder

#: Labelled documents that are paired with each other, about.
PART = 20_000
#: Pairs of a document at least, and pairs of a part up to which it gets more.
PARTNERS, PAIRS = 3, 50_000
#: Bins of a pass over the strengths, and rows of one bin that are sorted.
BINS, FEW = 1_000, 10_000
#: The score at the threshold.
CUT = 0.3
#: Ids whose crc32 modulo this is 0 are held out.
FOLDS = 5
#: Weight of the penalty on w, per pair.
PENALTY = 1e-4
MARKS = "!#$%&*|?.,:;\"'()<>=/\\@_-+~^{}[]"
N_FEATURES = 22 + len(MARKS)


def features(text: str | None) -> list[float]:
    """Shape and repetition of a whole text; every entry is a bounded share or the log of a size."""
    text = text or ""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * N_FEATURES
    counts = Counter(words)
    lines = text.split("\n")
    upper = sum(map(str.isupper, words))
    letters = sum(map(str.isalpha, words))
    lengths = list(map(len, words))
    top = counts.most_common(3)
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    long_lines = [x for x in lines if len(x) > 20]
    bare = sum(lengths)
    share = [text.count(m) / bare for m in MARKS]
    marked = sum(share)
    log_n = np.log1p(n)
    return [
        log_n,
        len(counts) / n,
        np.log1p(len(counts)) / log_n,
        len(set(zip(words, words[1:], strict=False))) / max(1, n - 1),
        same / n,
        top[0][1] / n,
        sum(c for _, c in top) / n,
        upper / n,
        letters / n,
        sum(map(str.istitle, words)) / n,
        sum(map(str.isdigit, words)) / n,
        min(bare / n, 40.0) / 10,
        sum(x <= 3 for x in lengths) / n,
        sum(x >= 12 for x in lengths) / n,
        max(lengths) / bare,
        np.log1p(len(lengths) / len(lines)),
        len(set(long_lines)) / max(1, len(long_lines)),
        sum(not w[-1].isalnum() for w in words) / n,
        sum(not w[0].isalnum() for w in words) / n,
        text.count("\n") / chars,
        marked,
        float(marked > 0.1),
        *share,
    ]


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    #: The strength at the threshold, and the spread that maps strengths to scores.
    middle: float
    spread: float

    def strengths(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((self.strengths(x) - self.middle) / self.spread, -50, 50) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-z))


def step_sums(d: np.ndarray, w: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, gradient and Hessian of the pairs with differences ``d``, without the penalty."""
    p = 1 / (1 + np.exp(-np.clip(d @ w, -50, 50)))
    return len(d), d.T @ (1 - p), (d * (p * (1 - p))[:, None]).T @ d


def newton(size: int, sums: Callable[[np.ndarray], tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """The weights of least penalised loss; ``sums`` are those of ``step_sums`` over all pairs."""
    w = np.zeros(size)
    for _ in range(25):
        n, gradient, hessian = sums(w)
        step = np.linalg.solve(hessian / n + 2 * PENALTY * np.eye(size), gradient / n - 2 * PENALTY * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def part_pairs(z: np.ndarray, y: np.ndarray, means: np.ndarray) -> np.ndarray:
    """Differences good - bad in which every row takes part; ``means`` (of label 0, of label 1) stand for a label that the part lacks."""
    good, bad = (z[y == k] if (y == k).any() else means[k : k + 1] for k in (1, 0))
    many, few = max(len(good), len(bad)), min(len(good), len(bad))
    rounds = min(few, max(PARTNERS, PAIRS // many))
    i, shift = np.arange(many), max(1, few // rounds)
    return np.concatenate([good[(i if len(good) == many else i + k * shift) % len(good)] - bad[(i + k * shift if len(good) == many else i) % len(bad)] for k in range(rounds)])


def fit_pairs(x: np.ndarray, y: np.ndarray, n_pairs: int = PAIRS, seed: int = 0) -> Model | None:
    """A model from feature rows ``x`` and labels ``y`` in {0, 1} at hand, by ``n_pairs`` drawn pairs; None without both labels.  ``learn`` does it for tables, with every row."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, n_pairs)] - z[rng.choice(bad, n_pairs)]
    w = newton(x.shape[1], lambda w: step_sums(d, w))
    s = z @ w
    middle = float(np.quantile(s, len(bad) / len(s), method="midpoint"))
    return Model(mean, scale, w, middle, max(1e-9, float(s.std()) / 2))


def feature_table(docs: DataFrame) -> DataFrame:
    """``doc_id, x`` of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([features(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.mapInArrow(run, "doc_id long, x array<double>")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def labelled(docs: DataFrame, labels: DataFrame, label_col: str = "quality") -> DataFrame:
    """``doc_id, x, y``: the rows of ``docs(doc_id, x)`` that have a label and are not held out."""
    y = F.col(label_col).try_cast("double")  # tested before it becomes an integer: 0.7 is no label
    known = labels.where(y.isin(0.0, 1.0)).select(F.col("doc_id").cast("long").alias("doc_id"), y.cast("int").alias("y")).where(~held_out(F.col("doc_id")))
    return docs.join(known.groupBy("doc_id").agg(F.min("y").alias("y")), "doc_id")


def _in_parts(rows: DataFrame, fields: str, f: Callable[[np.ndarray, np.ndarray], list]) -> DataFrame:
    """One row per part of ``rows(part, x, y)``, which are its partitions: ``part`` and what ``f(x, y)`` gives."""
    names = ["part", *(x.split()[0] for x in fields.split(","))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, xs, ys = 0, [], []
        for batch in batches:
            if batch.num_rows:
                part = batch.column("part")[0].as_py()
                xs.append(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                ys.append(batch.column("y").to_numpy(zero_copy_only=False))
        if xs:
            yield pa.RecordBatch.from_arrays([pa.array([part]), *(pa.array([v]) for v in f(np.concatenate(xs), np.concatenate(ys)))], names)

    return rows.mapInArrow(run, f"part long, {fields}")


def _moments(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and squared deviations of all parts together, from theirs."""
    n, mean, dev = 0, 0.0, 0.0
    for m, a, d in parts:
        if m:
            gap = a - mean
            n, mean, dev = n + m, mean + gap * (m / (n + m)), dev + d + gap * gap * (n * m / (n + m))
    return n, mean, dev


def learn(rows: DataFrame) -> Model | None:
    """A model from all of ``rows(doc_id, x, y)``; None without both labels.  The same for the same rows, in whatever order they come."""
    shared_folder(rows.sparkSession)
    rows = rows.checkpoint()
    n_parts = max(1, round(rows.count() / PART))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(n_parts))
    rows = rows.withColumn("part", part).repartitionById(n_parts, F.col("part").cast("int")).sortWithinPartitions(F.xxhash64("doc_id", F.lit(1)), "doc_id", "x").select("part", "x", "y").checkpoint()

    def moments(x: np.ndarray, y: np.ndarray) -> list:
        got = []
        for k in (0, 1):
            own = x[y == k]
            mean = own.mean(axis=0) if len(own) else np.zeros(x.shape[1])
            got += [len(own), mean, ((own - mean) ** 2).sum(axis=0)]
        return got

    got = sorted(_in_parts(rows, "n0 long, m0 array<double>, d0 array<double>, n1 long, m1 array<double>, d1 array<double>", moments).collect())
    each = [_moments([(r[f"n{k}"], np.array(r[f"m{k}"]), np.array(r[f"d{k}"])) for r in got]) for k in (0, 1)]
    if not each[0][0] or not each[1][0]:
        return None
    n, mean, dev = _moments(each)
    scale = np.sqrt(dev / n)
    scale = np.where(scale > 1e-9, scale, 1.0)
    normal = lambda x: np.clip((x - mean) / scale, -8, 8)
    centres, size = normal(np.array([each[0][1], each[1][1]])), len(mean)

    def sums(w: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        def one(x: np.ndarray, y: np.ndarray) -> list:
            m, gradient, hessian = step_sums(part_pairs(normal(x), y, centres), w)
            return [m, gradient, hessian.ravel()]

        found = sorted(_in_parts(rows, "n long, g array<double>, h array<double>", one).collect())
        return sum(r["n"] for r in found), np.sum([r["g"] for r in found], axis=0), np.sum([r["h"] for r in found], axis=0).reshape(size, size)

    w = newton(size, sums)

    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, size)
            yield pa.RecordBatch.from_arrays([pa.array(normal(x) @ w)], ["s"])

    s = rows.select("x").mapInArrow(strengths, "s double").checkpoint()
    at = each[0][0] * (n - 1) // n
    middle = (kth(s, at) + kth(s, at + 1)) / 2
    spread = s.agg(F.stddev_pop("s")).first()[0]
    return Model(mean, scale, w, middle, max(1e-9, spread / 2))


def kth(s: DataFrame, k: int) -> float:
    """The value of ``s(s double)`` at place ``k`` from 0 in ascending order: counts in bins, of which one is cut again, until it has few rows or one value."""
    while True:
        low, high, n = s.agg(F.min("s"), F.max("s"), F.count("*")).first()
        if low == high:
            return low
        if n <= FEW:
            return sorted(r[0] for r in s.collect())[k]
        place = F.least(F.floor((F.col("s") - low) / (high - low) * BINS), F.lit(BINS - 1))
        for r in s.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min("s").alias("low"), F.max("s").alias("high")).orderBy("bin").collect():
            if k < r["n"]:
                s = s.where(F.col("s").between(r["low"], r["high"]))
                break
            k -= r["n"]


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality") -> Model | None:
    """Learn from all labelled rows of ``docs(doc_id, text)`` that are not held out."""
    return learn(labelled(feature_table(docs), labels, label_col))


def score(docs: DataFrame, model: Model | None, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a further column ``out``, a name that it does not have; all other columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            values = model.scores(np.array([features(t) for t in texts])) if model and texts else np.full(len(texts), 0.5)
            yield batch.append_column(out, pa.array(values))

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(out, DoubleType())]))


def score_features(rows: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, score`` of ``rows(doc_id, x)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else None
            values = model.scores(x) if model and x is not None else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values)], ["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double")


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score ``CUT`` or more, columns unchanged."""
    small_batches(spark)
    model = fit(docs.select("doc_id", "text"), labels)
    name = unused("score", docs)
    return score(docs, model, out=name).where(F.col(name) >= CUT).drop(name)


def op9_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    shared_folder(spark)
    docs = feature_table(table(spark, sf_dir, "documents").select("doc_id", "text")).checkpoint()
    got = score_features(docs, learn(labelled(docs, table(spark, sf_dir, "labels"))))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
