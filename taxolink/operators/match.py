"""Matching records by value: five modes (JN-8), nearest candidate (JN-11), schema matching (JN-13, JN-14, JN-16).

``match`` returns pairs ``left_id, right_id`` (and a ``score`` where there is one).  Every mode has a plan of
its own, and none compares all pairs where an index on equal values can stand for the comparison.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from taxolink.functions import text as T
from taxolink.operators import regex_index as X
from taxolink.operators.graph import shared_folder

#: Patterns up to this many are tried on all values.
FEW_PATTERNS = 100
#: Match modes by name.
MODES: dict = {}


def mode(name: str):
    def add(f):
        MODES[name] = f
        return f

    return add


def match(left: DataFrame, right: DataFrame, how: str = "exact", **options) -> DataFrame:
    """Pairs of ``left(id, value)`` and ``right(id, value)`` that match; nulls never do, and values are stripped first."""
    if how not in MODES:
        raise ValueError(f"unknown match mode: {how}")
    side = lambda df, name: df.select(F.col("id").alias(f"{name}_id"), T.strip(F.col("value")).alias(name)).where(F.col(name).isNotNull())
    return MODES[how](side(left, "left"), side(right, "right"), **options)


@mode("exact")
def _exact(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, F.col("left") == F.col("right")).select("left_id", "right_id")


@mode("array-contains")
def _contains(left: DataFrame, right: DataFrame) -> DataFrame:
    """The left value is one of the right's items: items are exploded and met by equality."""
    items = right.select("right_id", F.explode(F.array_distinct(F.split("right", r"[,\s]+", -1))).alias("item"))
    return left.join(items, F.col("left") == F.col("item")).select("left_id", "right_id")


def _patterns(left: DataFrame, flags: str) -> DataFrame:
    """Distinct ``left`` values with the pattern ``p`` that they stand for."""
    return left.select("left").distinct().withColumn("p", F.concat(F.lit(f"(?{flags})" if flags else ""), F.col("left")))


def invalid_patterns(left: DataFrame, flags: str = "") -> DataFrame:
    """``id, value`` of the rows of ``left`` whose value is no pattern; mode ``regex`` leaves them out."""
    p = F.concat(F.lit(f"(?{flags})" if flags else ""), T.strip(F.col("value")))
    return left.where(F.col("value").isNotNull() & ~X.valid(p)).select("id", "value")


@mode("regex")
def _regex(left: DataFrame, right: DataFrame, flags: str = "", block: int = 10_000, block_bytes: int = 8 << 20, few: int = FEW_PATTERNS) -> DataFrame:
    """The left value is a pattern that occurs in the right.  Values that are no patterns match nothing (see ``invalid_patterns``).

    Patterns of which something is known that every match holds meet the values with that trigram only (see ``regex_index``).  The others, and all where there are
    but ``few``, go to all tasks in blocks of about ``block`` patterns and ``block_bytes``; with more than one block, each one's hits are
    written (to the checkpoint folder) before the next one comes.  Patterns and values are distinct, so equal texts are tested once.
    Joins that grow with both tables are merges by hint: patterns that are much alike are small where they are compressed, and would be broadcast for that.
    """
    shared_folder(left.sparkSession)
    patterns = _patterns(left, flags).where(X.valid(F.col("p"))).checkpoint()
    values, hits = right.select("right").distinct(), []
    open_ = patterns
    if patterns.limit(few + 1).count() > few:
        values = values.checkpoint()
        covers = X.pattern_covers(patterns, "p").checkpoint()
        hits.append(_by_trigrams(patterns, values, covers))
        open_ = patterns.join(covers.select("p").distinct().hint("merge"), "p", "left_anti")
    size = open_.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("p")), F.lit(0)).alias("b")).first()
    n = max(-(-size["n"] // block), -(-size["b"] // block_bytes))
    for i in range(n):
        some = values.join(F.broadcast(open_.where(F.pmod(F.xxhash64("left"), F.lit(n)) == i)), F.expr("right rlike p")).select("left", "right")
        hits.append(some.checkpoint() if n > 1 else some)
    if not hits:
        return left.sparkSession.createDataFrame([], StructType([left.schema["left_id"], right.schema["right_id"]]))
    return left.join(reduce(DataFrame.unionByName, hits).hint("merge"), "left").join(right.hint("merge"), "right").select("left_id", "right_id")


def _by_trigrams(patterns: DataFrame, values: DataFrame, covers: DataFrame) -> DataFrame:
    """``left, right`` for the patterns with a cover: each one's rarest cover picks the values on which it is tried."""
    grams = X.value_grams(values, "right").join(covers.select("gram").distinct().hint("merge"), "gram", "left_semi").checkpoint()
    count = grams.groupBy("gram").agg(F.count("*").alias("n"))
    weight = covers.join(count.hint("merge"), "gram", "left").groupBy("p", "cover").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    best = weight.groupBy("p").agg(F.min_by("cover", F.struct("n", "cover")).alias("cover"))
    # Written, so that the join below has no aggregate in its stages and a frequent trigram's rows can be split.
    rare = covers.join(best.hint("merge"), ["p", "cover"]).join(patterns.hint("merge"), "p").select("left", "p", "gram").checkpoint()
    return rare.join(grams.hint("merge"), "gram").where(F.expr("right rlike p")).select("left", "right").distinct()


def _tokens(df: DataFrame, name: str) -> DataFrame:
    """Distinct values as sets of numbered tokens, the rarest first, with their size."""
    return df.select(name).distinct().select(name, T.word_set(F.col(name)).alias("set")).withColumn("n", F.size("set"))


@mode("jaccard")
def _jaccard(left: DataFrame, right: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Token sets with |a ∩ b| / |a ∪ b| >= threshold.

    Exact prefix filter: with tokens ordered from rare to frequent, two sets that reach the threshold share one of their first
    n - ceil(t n) + 1 tokens, so only those are exploded and joined; sizes must be within the threshold of each other.  Exact positional filter: at the first token that two sets share, at
    places i and j, they can share at most 1 + min(na - i, nb - j); what cannot reach the threshold goes inside the join, before full sets
    meet.  Full sets decide.  Distinct values are compared, ids are joined back.  Token counts are written first, so that a frequent token's rows can be split.
    """
    if threshold <= 0:
        raise ValueError("threshold must be above 0: at 0 every pair matches")
    a, b = _tokens(left, "left"), _tokens(right, "right")
    near = _near(left.sparkSession, a, b, threshold).select("left", "right").distinct()
    sized = near.join(a.select("left", F.col("set").alias("sa")), "left").join(b.select("right", F.col("set").alias("sb")), "right")
    both = F.size(F.array_intersect("sa", "sb"))
    scored = sized.withColumn("score", both / (F.size("sa") + F.size("sb") - both)).where(F.col("score") >= threshold).select("left", "right", "score")
    return left.join(scored, "left").join(right, "right").select("left_id", "right_id", "score")


def _near(spark: SparkSession, a: DataFrame, b: DataFrame, threshold: float, positions: bool = True) -> DataFrame:
    """Candidates ``left, right`` by a shared token of both prefixes, once for each; ``positions`` says whether the positional filter is used."""
    shared_folder(spark)
    count = a.select("set").unionByName(b.select("set")).select(F.explode("set").alias("token")).groupBy("token").agg(F.count("*").alias("df")).checkpoint()

    def prefixes(side: DataFrame, name: str) -> DataFrame:
        ranked = side.select(name, "n", F.explode("set").alias("token")).join(count, "token").groupBy(name, "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("ranked"))
        keep = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
        return ranked.select(name, F.col("n").alias(f"n_{name}"), F.posexplode(F.slice("ranked", F.lit(1), keep.cast("int"))).alias(f"at_{name}", "t")).withColumn("token", F.col("t.token")).drop("t")

    na, nb = F.col("n_left"), F.col("n_right")
    fits = F.least(na, nb) >= threshold * F.greatest(na, nb) - 1e-9
    if positions:
        most = 1 + F.least(na - 1 - F.col("at_left"), nb - 1 - F.col("at_right"))
        fits = fits & (most >= threshold / (1 + threshold) * (na + nb) - 1e-9)
    return prefixes(a, "left").join(prefixes(b, "right"), "token").where(fits)


@mode("seqratio")
def _seqratio(left: DataFrame, right: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``difflib`` ratio >= threshold of lower-cased distinct values.

    ratio = 2 M / (la + lb), and M is at most the number of characters, as a multiset, that both have.  So a pair shares at least t / (2 - t) of the
    characters of either side, and the same exact prefix filter as for token sets holds: with (character, occurrence) pairs ordered from rare to
    frequent, both share one among their first la - ceil(la t / (2 - t)) + 1.  A pair is made where its first shared one is, inside the join, with lengths within
    the bound; ``difflib`` decides in Arrow batches after a count of shared characters.  Two empty texts are equal.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    part = threshold / (2 - threshold)

    def characters(df: DataFrame, c: str) -> DataFrame:
        low = F.col("low")
        times = lambda x: F.length(low) - F.length(F.replace(low, x, F.lit("")))
        each = F.flatten(F.transform(F.array_distinct(F.split(low, "")), lambda x: F.transform(F.sequence(F.lit(1), times(x)), lambda k: F.concat(x, k.cast("string")))))
        return df.select(c).distinct().withColumn("low", F.lower(c)).select(c, "low", F.length("low").alias("n"), F.when(F.length("low") == 0, F.array(F.lit(""))).otherwise(each).alias("set"))

    a, b = characters(left, "left"), characters(right, "right")
    shared_folder(left.sparkSession)
    df = a.select("set").unionByName(b.select("set")).select(F.explode("set").alias("token")).groupBy("token").agg(F.count("*").alias("df")).checkpoint()

    def prefixes(side: DataFrame, c: str) -> DataFrame:
        ranked = side.select(c, "low", "n", F.explode("set").alias("token")).join(df, "token").groupBy(c, "low", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("ranked"))
        keep = F.greatest(F.col("n") - F.ceil(F.col("n") * part - 1e-9) + 1, F.lit(1))
        first = ranked.select(F.col(c), F.col("low").alias("l" + c), F.col("n").alias("n" + c), F.transform(F.slice("ranked", F.lit(1), keep.cast("int")), lambda x: x["token"]).alias("p" + c))
        return first.withColumn("token", F.explode("p" + c))

    fits = 2 * F.least("nleft", "nright") >= threshold * (F.col("nleft") + F.col("nright"))
    once = F.col("token") == F.array_intersect("pleft", "pright")[0]
    near = prefixes(a, "left").join(prefixes(b, "right"), "token").where(fits & once).select("left", "right", "lleft", "lright")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter
        from difflib import SequenceMatcher

        for batch in batches:
            scores = []
            for x, y in zip(batch.column("lleft").to_pylist(), batch.column("lright").to_pylist(), strict=True):
                n = len(x) + len(y)
                shared = (Counter(x) & Counter(y)).total()
                scores.append(-1.0 if n and 2 * shared < threshold * n else SequenceMatcher(None, x, y).ratio())
            yield pa.RecordBatch.from_arrays([batch.column("left"), batch.column("right"), pa.array(scores, pa.float64())], ["left", "right", "score"])

    scored = near.mapInArrow(run, "left string, right string, score double").where(F.col("score") >= threshold)
    return left.join(scored, "left").join(right, "right").select("left_id", "right_id", "score")


def nearest(left: DataFrame, right: DataFrame, threshold: float = 0.4) -> DataFrame:
    """For each left ``id`` the right value with the best token Jaccard of at least ``threshold``; ties go to the larger text.

    ``left_id, suggestion, score``; ids without a candidate have no row.  A grouped maximum, so no window over a hot id.
    """
    pairs = match(left, right.select(F.col("value").alias("id"), "value").distinct(), "jaccard", threshold=threshold)
    best = pairs.groupBy("left_id").agg(F.max(F.struct("score", "right_id")).alias("b"))
    return best.select("left_id", F.col("b.right_id").alias("suggestion"), F.col("b.score").alias("score"))

def compare_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    """``tbl, name, status`` of two catalogs ``(tbl, name)``: matched, missing (only in a) or extra (only in b), ignoring case."""
    one = lambda df, n: df.select("tbl", F.lower("name").alias("k"), F.col("name").alias(n)).groupBy("tbl", "k").agg(F.min(n).alias(n))
    both = one(a, "a").join(one(b, "b"), ["tbl", "k"], "full")
    status = F.when(F.col("a").isNull(), "extra").when(F.col("b").isNull(), "missing").otherwise("matched")
    return both.select("tbl", F.coalesce("a", "b").alias("name"), status.alias("status"))



def fuzzy_columns(a: DataFrame, b: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``name, suggestion, score``: for each distinct name of catalog ``a(name)`` the most similar one of ``b(name)``."""
    one = lambda df: df.select(F.col("name").alias("id"), F.regexp_replace("name", r"(?<=[a-z0-9])(?=[A-Z])", " ").alias("value")).distinct()
    pairs = match(one(a), one(b), "jaccard", threshold=threshold)
    best = pairs.groupBy("left_id").agg(F.max(F.struct("score", "right_id")).alias("b"))
    return best.select(F.col("left_id").alias("name"), F.col("b.right_id").alias("suggestion"), F.col("b.score").alias("score"))
