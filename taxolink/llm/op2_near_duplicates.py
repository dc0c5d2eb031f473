"""Operator 2, near duplicates by fast similarity sketching.

A document is the set of its distinct word shingles.  Its sketch of ``BANDS * ROWS`` coordinates is filled in rounds
(Dahlgaard, Knudsen, Thorup, "Fast Similarity Sketching", 2017): in round i every shingle is hashed to
a bin and a value, empty bins take the least value, and the rounds end once all bins are full; from round t
on, round t + j throws every shingle into bin j, so 2t rounds always suffice.  Equal coordinates of two sketches
estimate the Jaccard similarity with the concentration of t independent draws.  Bands of the
sketch propose pairs, and a pair is linked only if the full sets reach the threshold.

How it runs at scale:

* Documents with equal sets share one class, whose smallest id stands for it; thousands of exact
  copies become one row before anything is paired.
* In a bucket (one value of one band) every member is compared with one leader, not with
  every other.  Verified links are joined into components, and after ``STAR_ROUNDS`` leaders only
  members of *different* components that still share a bucket are compared with each other.  The
  leader is the member that shares most places in buckets, which is nearest to all others.  So
  a bucket of any size is handled completely, without a cap, and a large group of near copies
  costs about its size.
  Buckets with the same members are compared once.  Where many members of one bucket are left, they are compared in blocks of bounded size, by
  products of 0/1 matrices over full sets, which return links only.
* A pair must also pass a test on a few bits of all coordinates of both sketches, the same one for pairs of every kind; in joins
  it stands inside the join, so pairs that only share a passage are never made.
* What moves: 16-byte digests and band values per document; texts move once, to become the sets of those that share a bucket at all.  A leader's set
  moves once per ``GROUP`` of its members, not once per pair.  Hot buckets, leaders, classes and components are joined apart (``join_hot``).

A pair at similarity s is proposed unless all 32 bands miss: (1 - s^5)^32, 3e-6 at 0.8 and 7e-9 at 0.85; the test
on bits refuses it with probability 3e-6 at 0.8, and less above.

Null, empty and white-space-only texts have an empty set and are linked with nothing.  Texts with fewer words than a
shingle are one shingle; very long ones are read whole.  Rows that share an id are compared each by its own text.  Rows with a null id are kept and
linked with nothing (``component_id`` is null).  An empty table gives no rows; columns of any name pass through ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolink.llm.common import components, join_hot, small_batches, staged, table, unused

#: Words in a shingle and similarity, unless the caller says otherwise.
WORDS, THRESHOLD = 5, 80
BANDS, ROWS = 32, 5
#: Bits of each coordinate that go with a document to its buckets, and the deviations that a pair may be off in them.
BITS, DEVIATIONS = 3, 4.5
#: Leaders that the members of a bucket are compared with before the rest is compared.
STAR_ROUNDS = 1
#: Buckets of so many members are paired in a join; larger ones in blocks of so many members and set items.  Results do not hang on it.
SMALL_BUCKET, BLOCK_MEMBERS, BLOCK_ITEMS = 32, 256, 200_000
#: Members that meet their leader in one group.
GROUP = 32
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)

ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
items AS (SELECT doc_id, hash(x) AS x FROM (SELECT doc_id, unnest(s) AS x FROM sets)),
shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT u, v FROM shared JOIN sizes p ON u = p.doc_id JOIN sizes q ON v = q.doc_id
  WHERE 100 * c >= 80 * (p.n + q.n - c)),
twoway AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT doc_id AS u, doc_id AS r FROM sizes UNION SELECT b.v, reach.r FROM reach JOIN twoway b ON b.u = reach.u),
low AS (SELECT u AS doc_id, min(r) AS component_id FROM reach GROUP BY u)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sizes JOIN low USING (doc_id)
"""


def shingles(text: str | None, words: int) -> set[bytes]:
    """Distinct shingles of lower-cased (A-Z) words; ``bytes.split`` splits at exactly the contract's white space."""
    w = (text or "").encode("utf-8", "replace").lower().split()
    if len(w) <= words:
        return {b" ".join(w)} if w else set()
    if words == 2:
        return {a + b" " + b for a, b in zip(w, w[1:], strict=False)}
    return {b" ".join(x) for x in zip(*(w[i:] for i in range(words)), strict=False)}


def hashes(text: str | None, words: int) -> np.ndarray:
    """The sorted 64-bit hashes of a text's shingles."""
    from xxhash import xxh3_64_intdigest

    s = shingles(text, words)
    return np.sort(np.fromiter(map(xxh3_64_intdigest, s), np.uint64, len(s)))


def shared_items(a: np.ndarray, b: np.ndarray) -> int:
    """The size of the intersection of two sorted sets."""
    if len(a) < len(b):
        a, b = b, a
    return int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum()) if len(b) else 0


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketches(sets: list[np.ndarray], size: int) -> np.ndarray:
    """Fast similarity sketches, one row of ``size`` values for each set of 64-bit hashes; empty sets stay ``EMPTY``."""
    out = np.full((len(sets), size), EMPTY, np.uint64)
    flat = out.reshape(-1)
    items = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for i in range(2 * size):
        if not len(items):
            break
        x = _mixed(items, (i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        bins = ((x >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64) if i < size else np.full(len(x), i - size)
        place = owner * size + bins
        free = flat[place] == EMPTY  # a bin filled in an earlier round has a smaller value
        np.minimum.at(flat, place[free], ((x << np.uint64(32)) | (x >> np.uint64(32)))[free])
        more = (out == EMPTY).any(axis=1)[owner]
        if not more.all():
            items, owner = items[more], owner[more]
    return out


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band of each sketch."""
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(sketch), 1))
    for r in range(rows):
        key = _mixed(key * np.uint64(0xD6E8FEB86659FD93) + sketch[:, r::rows][:, :bands], r)
    return key


def packed_bits(sketch: np.ndarray) -> np.ndarray:
    """``BITS`` bits of every coordinate, as rows of 64-bit integers."""
    low = (_mixed(sketch, 77)[:, :, None] >> np.arange(BITS, dtype=np.uint64) & np.uint64(1)).astype(np.uint8).reshape(len(sketch), -1)
    raw = np.packbits(low, axis=1)
    return np.pad(raw, ((0, 0), (0, -raw.shape[1] % 8))).view(np.int64)


def most_differing_bits(size: int, threshold: int) -> int:
    """Bits that differ at most between sketches of sets that reach the threshold, but for ``DEVIATIONS`` standard deviations.

    Of ``size`` coordinates a binomial number differ, and each bit of those differs with probability 1/2.
    """
    p = 1 - threshold / 100
    mean = size * p * BITS / 2
    return int(mean + DEVIATIONS * (size * (p * (1 - p) * BITS**2 / 4 + p * BITS / 4)) ** 0.5)


def sketch_table(docs: DataFrame, words: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, h, n, d1, d2, keys, bits`` of ``docs(doc_id, h, text)``: set size, digest of the set, band keys, packed bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            sets = [hashes(t, words) for t in batch.column("text").to_pylist()]
            digests = np.frombuffer(b"".join(xxh3_128_digest(s.tobytes()) for s in sets), ">i8").reshape(-1, 2).astype(np.int64)
            sketch = sketches(sets, bands * rows)
            lists = [
                pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.reshape(-1)))
                for x in (band_keys(sketch, bands, rows).view(np.int64), packed_bits(sketch))
            ]
            n = np.array([len(s) for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(n), pa.array(digests[:, 0]), pa.array(digests[:, 1]), *lists], ["doc_id", "h", "n", "d1", "d2", "keys", "bits"])

    return docs.select("doc_id", "h", "text").mapInArrow(run, "doc_id long, h long, n long, d1 long, d2 long, keys array<long>, bits array<long>")


def set_table(spark: SparkSession, docs: DataFrame, classes: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """``node, items``, written: the sorted 64-bit hashes of the full set of each class of ``nodes(node)``, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([hashes(t, words).tobytes() for t in batch.column("text").to_pylist()], pa.binary())], ["node", "items"])

    wanted = classes.join(nodes.distinct(), "node", "left_semi").select("node", F.col("rep").alias("doc_id"), F.col("rep_h").alias("h"))
    texts = docs.join(wanted, ["doc_id", "h"]).groupBy("node").agg(F.any_value("text").alias("text"))  # rows that repeat id and text give one
    return staged(spark, texts.mapInArrow(run, "node long, items binary"), "sets")


def verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The ``pairs(u, v, c)`` whose full sets of shingles reach the threshold; ``u`` has about ``c`` pairs.

    Pairs of one ``u`` come together in groups of about ``GROUP``, with the set of ``u`` once, ahead of those of each ``v``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = np.empty(0, np.uint64)
        for batch in batches:
            us, vs = [], []
            for u, v, raw in zip(*(batch.column(c).to_pylist() for c in ("u", "v", "items")), strict=True):
                items = np.frombuffer(raw, np.uint64)
                if v is None:
                    left = items
                    continue
                both = shared_items(left, items)
                if both and 100 * both >= threshold * (len(left) + len(items) - both):
                    us.append(u)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    parts = F.ceil(F.col("c") / GROUP)
    parted = pairs.select("u", parts.alias("parts"), F.pmod(F.xxhash64("v"), parts).alias("part"), "v")
    followers = parted.join(sets.withColumnRenamed("node", "v"), "v").select("u", "parts", "part", "v", "items")
    heads = parted.select("u", "parts", "part").distinct().join(sets.withColumnRenamed("node", "u"), "u").select("u", "parts", "part", F.lit(None).cast("long").alias("v"), "items")
    met = heads.unionByName(followers).repartition("u", "parts", "part").sortWithinPartitions("u", "parts", "part", F.col("v").asc_nulls_first())
    return met.select("u", "v", "items").mapInArrow(run, "u long, v long")


def overlaps(a: list[np.ndarray], b: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """The sizes of all intersections of two lists of sorted sets, by products of 0/1 matrices over the items that both lists have."""
    xs, ys = np.concatenate(a), np.concatenate(b)
    common = np.intersect1d(xs, ys)
    out = np.zeros((len(a), len(b)), np.int64)
    rows, cols = [], []
    for items, sets, made in ((xs, a, rows), (ys, b, cols)):
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(common, items), max(len(common) - 1, 0))
        hit = common[at] == items if len(common) else np.zeros(len(items), bool)
        order = np.argsort(at[hit], kind="stable")
        made += [owner[hit][order], at[hit][order]]
    for start in range(0, len(common), width):
        left, right = (np.zeros((len(s), min(width, len(common) - start)), np.float32) for s in (a, b))
        for m, (owner, at) in ((left, rows), (right, cols)):
            i, j = np.searchsorted(at, [start, start + width])
            m[owner[i:j], at[i:j] - start] = 1
        out += (left @ right.T).astype(np.int64)  # one product's sums are at most ``width``, which float32 holds exactly
    return out


def block_links(spark: SparkSession, members: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links ``(u, v)`` between members of different components in large buckets ``(key, node, component, bits, c, items)``.

    A bucket is cut into blocks of bounded size, and every pair of blocks is one row: a task holds two blocks, computes all intersections of
    their full sets at once and returns the links alone.  Pairs are neither made as rows nor left out.
    """
    most = most_differing_bits(BANDS * ROWS, threshold)
    n_blocks = F.ceil(F.greatest(F.col("c") / BLOCK_MEMBERS, F.col("items") / BLOCK_ITEMS)).cast("int")
    placed = members.select("key", "node", "component", "bits", n_blocks.alias("n_blocks"), F.pmod(F.xxhash64("node"), n_blocks).cast("int").alias("block"))
    filled = placed.join(sets, "node").groupBy("key", "n_blocks", "block").agg(F.collect_list(F.struct("node", "component", "bits", "items")).alias("a"))
    filled = staged(spark, filled, "blocks")
    left = filled.withColumn("block", F.explode(F.sequence("block", F.col("n_blocks") - 1)))
    met = left.join(filled.select("key", "block", F.col("a").alias("b")), ["key", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                sides = [batch.column(c)[i].as_py() for c in "ab"]
                a, b = ([np.frombuffer(m["items"], np.uint64) for m in side] for side in sides)
                both = overlaps(a, b)
                size = np.array([len(s) for s in a])[:, None] + np.array([len(s) for s in b])[None, :]
                ok = (both > 0) & (100 * both >= threshold * (size - both))
                ok &= np.array([m["component"] for m in sides[0]])[:, None] != np.array([m["component"] for m in sides[1]])[None, :]
                p, q = (np.array([m["bits"] for m in side], np.int64) for side in sides)
                ok &= np.bitwise_count((p[:, None, :] ^ q[None, :, :]).view(np.uint64)).sum(axis=2) <= most
                u, v = (np.array([m["node"] for m in side], np.int64) for side in sides)
                x, y = np.nonzero(ok)
                yield pa.RecordBatch.from_arrays([pa.array(u[x]), pa.array(v[y])], ["u", "v"])

    return met.select("a", "b").mapInArrow(run, "u long, v long")


def class_table(spark: SparkSession, sketched: DataFrame) -> DataFrame:
    """The distinct sets, written: ``node, d1, d2, rep, rep_h, rows, n, keys, bits``; ``rep`` is the smallest id, ``rep_h`` that row's text hash."""
    known = sketched.where("n > 0 and doc_id is not null")
    grouped = known.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "h")).alias("r"), F.count("*").alias("rows"), *(F.any_value(c).alias(c) for c in ("n", "keys", "bits")))
    return staged(spark, grouped.select(F.monotonically_increasing_id().alias("node"), "d1", "d2", F.col("r.doc_id").alias("rep"), F.col("r.h").alias("rep_h"), "rows", "n", "keys", "bits"), "classes")


def linked_classes(spark: SparkSession, docs: DataFrame, classes: DataFrame, words: int, threshold: int) -> DataFrame:
    """``node, component`` of the classes that are linked with another one."""
    buckets = classes.select("node", F.explode("keys").alias("key"))
    crowded = staged(spark, buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "crowded")
    shared = staged(spark, join_hot(spark, buckets, crowded.withColumnRenamed("n", "c"), ["key"], counts=crowded), "shared")
    # Who shares most places in buckets is most like all others, so it leads: one leader then links most of a large group.
    of = classes.select("node", "n", "bits").join(shared.groupBy("node").agg(F.sum("c").alias("degree")), "node")
    members = staged(spark, shared.drop("c").join(of, "node"), "members")
    sets = set_table(spark, docs, classes, members.select("node"), words)
    tested, found = None, None

    def close(a: str, b: str) -> Column:
        """Sizes within the threshold of each other, and sketches no further apart than it allows; a test inside the join."""
        differ = " + ".join(f"bit_count(bits{a}[{i}] ^ bits{b}[{i}])" for i in range(-(-BANDS * ROWS * BITS // 64)))
        return F.expr(f"100 * least(n{a}, n{b}) >= {threshold} * greatest(n{a}, n{b}) and {differ} <= {most_differing_bits(BANDS * ROWS, threshold)}")

    def in_components() -> DataFrame:
        if found is None:
            return members.withColumn("component", F.col("node"))
        return staged(spark, members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "open")

    def test(pairs: DataFrame) -> DataFrame:
        """The links among the untested ``pairs(u, v, c)``, ``u`` the one of higher degree."""
        nonlocal tested
        pairs = pairs.groupBy("u", "v").agg(F.max("c").alias("c"))
        pairs = staged(spark, pairs if tested is None else pairs.join(tested, ["u", "v"], "left_anti"), "pairs")
        tested = pairs.select("u", "v") if tested is None else tested.unionByName(pairs.select("u", "v"))
        return staged(spark, verified(pairs, sets, threshold), "links")

    def joined(links: DataFrame) -> DataFrame:
        """The components so far, joined by new ``links(u, v)``."""
        return components(spark, links if found is None else links.unionByName(found.select(F.col("node").alias("u"), F.col("component").alias("v"))))

    for _ in range(STAR_ROUNDS):
        open_ = in_components()
        best = F.max(F.struct("degree", (-F.col("node")).alias("first"), "n", "component", "bits"))
        leaders = open_.groupBy("key").agg(best.alias("l"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("c")).where("lo < hi")
        leaders = staged(spark, leaders.select("key", "c", (-F.col("l.first")).alias("u"), F.col("l.n").alias("n2"), F.col("l.bits").alias("bits2"), F.col("l.component").alias("component2")), "leaders")
        found = joined(test(join_hot(spark, open_, leaders, ["key"], counts=crowded).where(F.expr("component <> component2") & close("", "2")).select("u", F.col("node").alias("v"), "c")))
    open_ = in_components()
    prints = (F.bit_xor(F.xxhash64("node")).alias("p1"), F.bit_xor(F.xxhash64(F.lit("b"), "node")).alias("p2"))
    mixed = open_.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("c"), F.sum("n").alias("items"), *prints).where("lo < hi")
    once = staged(spark, mixed.groupBy("p1", "p2", "c", "items").agg(F.min("key").alias("key")).select("key", "c", "items"), "mixed")  # buckets of the same members count once
    rest = staged(spark, join_hot(spark, open_, once, ["key"], counts=once.select("key", F.col("c").alias("n"))), "rest")
    small = rest.where(F.col("c") <= SMALL_BUCKET).select("key", "node", "degree", "n", "bits", "component")
    other = small.toDF("key", *(f"{c}2" for c in small.columns[1:]))
    leads = F.expr("degree > degree2 or (degree = degree2 and node < node2)")
    links = test(small.join(other, "key").where(leads & (F.col("component") != F.col("component2")) & close("", "2")).select(F.col("node").alias("u"), F.col("node2").alias("v"), F.lit(SMALL_BUCKET).alias("c")))
    large = rest.where(F.col("c") > SMALL_BUCKET)
    if not large.isEmpty():
        links = links.unionByName(staged(spark, block_links(spark, large, sets, threshold), "links"))
    return joined(links)


def grouped(spark: SparkSession, docs: DataFrame, words: int, threshold: int) -> DataFrame:
    """``doc_id, h, n, component, component_id`` of the rows of ``docs(doc_id, h, text)``; component is null where nothing can be linked."""
    small_batches(spark)
    sketched = staged(spark, sketch_table(docs, words), "sketches")
    classes = class_table(spark, sketched)
    found = linked_classes(spark, docs.where("doc_id is not null"), classes, words, threshold)
    placed = staged(spark, classes.select("node", "d1", "d2", "rep").join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")
    least = staged(spark, placed.groupBy("component").agg(F.min("rep").alias("component_id")), "least")
    labelled = staged(spark, join_hot(spark, placed, least, ["component"]).select("d1", "d2", "component", "component_id"), "labelled")
    rows = sketched.select("doc_id", "h", "n", "d1", "d2")
    able = F.expr("n > 0 and doc_id is not null")
    linked = join_hot(spark, rows.where(able), labelled, ["d1", "d2"], counts=classes.select("d1", "d2", F.col("rows").alias("n"))).drop("d1", "d2")
    alone = rows.where(~able).drop("d1", "d2").withColumn("component", F.lit(None).cast("long")).withColumn("component_id", F.col("doc_id"))
    return linked.unionByName(alone)


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row; documents whose sets reach ``threshold`` percent are linked."""
    got = grouped(spark, docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text")), words, threshold)
    return got.select("doc_id", F.col("n").alias("n_shingles"), "component_id").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(spark: SparkSession, docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs(doc_id, text, ...)`` with one row of each group of near duplicates, columns unchanged.

    The row of the group's smallest id stays (of several, that with the least text hash).  Rows without words stay, of those that share id and text
    one; rows with a null id all stay.
    """
    h, row = unused("_tl_h", docs), unused("_tl_row", docs)
    rows = staged(spark, grouped(spark, docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text"), words, threshold).where("doc_id is not null"), "groups")
    first = rows.where("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "h")).alias("r")).select("r.doc_id", "r.h")
    kept = first.unionByName(rows.where("component is null").select("doc_id", "h").distinct())
    times = rows.groupBy("doc_id", "h").agg(F.count("*").alias("n"))
    kept = staged(spark, kept.join(times, ["doc_id", "h"]).withColumnRenamed("h", h), "kept")
    hashed = docs.withColumn(h, F.xxhash64("text"))
    once = hashed.join(kept.where("n = 1"), ["doc_id", h], "left_semi").select(*docs.columns)
    again = hashed.join(kept.where("n > 1"), ["doc_id", h], "left_semi").groupBy("doc_id", h).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias(row)).select(f"{row}.*")
    return once.unionByName(again).unionByName(docs.where("doc_id is null"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"), words=2)
