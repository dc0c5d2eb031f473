"""Operator 11, phrase collocations by FM-indexes over words.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends, and the words of about half a million neighbouring symbols make one shard.  A shard's
FM-index is the last-to-first mapping of its word ids, sorted as deep as phrases get.  A phrase is an interval of rows.  It is extended by one word to the left
through the mapping and to the right through its inverse, for all phrases at once, which gives the counts of all extensions on either side; phrases grow in both
directions in turn.  (The inverse splits an interval as a second index of the reversed words would, so there is none.)  Counts are summed across shards.

Few phrases are frequent, but each shard sees only its own counts.  So phrases are counted level by level, and a phrase of k words is extended only if it, and
its other part of k words, may be frequent: shards send each phrase as a 32-bit key of one of ``parts`` tables with its count, keys whose counts sum to less than the
threshold cannot be frequent, and the others come back as a bit filter of ``FILTER_BITS`` at most.  Equal keys of different phrases and full filters only let more phrases
through; the last pass sends the phrases that are left as texts, and their exact sums decide.

How it runs at scale: the texts are read once, the indexes, 4 bytes a word and each shard's words, are written to the shared folder and read once per level.  What moves are keys and
counts, packed by table, never texts.  The driver holds one filter per level, of 16 MB at most, whatever the data; memory of a task grows with one shard or with
one text where that is longer.  Phrases meet the counts of their parts in ``join_hot``, as many begin with the same word.

A null language is ``und``, null and empty texts have no words, texts are read whole and a long one may span shards, repeated rows and ids count again, an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taxolink.llm.common import broadcast_if_small, join_hot, small_batches, staged, table

#: The least count of a phrase, its most words, and the phrases returned per language.
LEAST, LONGEST, TOP = 100, 5, 2000
#: Symbols of a shard, about.
SHARD = 1 << 19
#: Bits of a level's filter: for each frequent key, and at most in all.
BITS_PER_KEY, FILTER_BITS = 32, 1 << 27
#: Keys of one table, about, and the most tables.
PART_KEYS, MOST_PARTS = 4_000_000, 8192
#: Keys that a task holds before it adds up equal ones and sends them; bytes of one Arrow batch.
HELD_KEYS, BATCH = 1 << 20, 4 << 20
#: Row groups of the index hold a shard or two, as readers and writers hold whole row groups.
ROW_GROUPS = {"parquet.block.size": str(4 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}
#: Parts of a language that are ranked apart before they meet.
PIECES_OF_LANG = 64

#: What ends a piece becomes a byte that no text has.
_END = b"\xff"
_CUT = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", _END * 10)
INDEX = "langs array<string>, n_words array<long>, words binary, lang binary, hashes binary, counts binary, lf binary"
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)  # odd multipliers of the phrase hash
_SPREAD = 40503  # keys of different tables fall on different bits


def pieces(text: str) -> list[bytes]:
    """The words of a text, with ``_END`` between pieces."""
    return text.encode().lower().translate(_CUT).replace(_END, b" \xff ").split()  # bytes split at just ASCII white space


# -- the index of one shard


def last_to_first(symbols: np.ndarray, depth: int) -> np.ndarray:
    """For each rotation of ``symbols``, in an order by ``depth`` symbols at least, the place of the one that begins a symbol earlier."""
    n, rank, known = len(symbols), symbols.astype(np.int64), 1
    while True:
        key = rank * (n + 1) + np.roll(rank, -known)
        order = np.argsort(key)
        known *= 2
        if known >= depth:
            break
        new = np.ones(n, bool)
        new[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    return place[order - 1]


def build(symbols: np.ndarray, vocabulary: list[tuple[int, bytes]], langs: list[str], n_words: Sequence[int], depth: int) -> dict:
    """The row of one shard; symbol 0 ends pieces, symbol i is ``vocabulary[i - 1]`` (language, word)."""
    import xxhash

    seeds = [xxhash.xxh64_intdigest(lang) for lang in langs]
    return {
        "langs": langs, "n_words": list(n_words), "words": b" ".join([w for _, w in vocabulary]), "lang": np.array([k for k, _ in vocabulary], np.int32).tobytes(),
        "hashes": np.array([0, *(xxhash.xxh64_intdigest(w, seed=seeds[k]) for k, w in vocabulary)], np.uint64).tobytes(),
        "counts": np.bincount(symbols, minlength=len(vocabulary) + 1).astype(np.int32).tobytes(), "lf": last_to_first(symbols, depth).tobytes(),
    }


def shards(rows: Iterator[tuple[str, str]], size: int, depth: int) -> Iterator[dict]:
    """The shards of ``(language, text)`` rows, each closed at the end of a piece."""
    parts: list[np.ndarray] = []
    held, vocabularies, n_words, number = 0, {}, {}, count(1)

    def close() -> dict:
        langs = sorted(vocabularies)
        order = sorted((i, k, w) for k, lang in enumerate(langs) for w, i in vocabularies[lang].items() if i)
        return build(np.concatenate([[0], *parts]), [(k, w) for _, k, w in order], langs, [n_words[lang] for lang in langs], depth)

    for lang, text in rows:
        words = pieces(text)
        at = 0
        while at < len(words):
            to = len(words)
            if to - at > size - held:  # the shard is full at the end of the piece that reaches its size
                try:
                    to = words.index(_END, at + size - held) + 1
                except ValueError:
                    pass
            if lang not in vocabularies:
                vocabularies[lang], n_words[lang] = defaultdict(number.__next__, {_END: 0}), 0
            some = words[at:to]
            ids = np.fromiter(map(vocabularies[lang].__getitem__, some), np.int64, len(some))
            n_words[lang] += int(np.count_nonzero(ids))
            parts += [ids, np.zeros(1, np.int64)]
            held, at = held + len(some) + 1, to
            if held >= size:
                yield close()
                parts, held, vocabularies, n_words, number = [], 0, {}, {}, count(1)
    if held:
        yield close()


class Shard:
    """One row of the index, with the phrases found so far."""

    def __init__(self, row: dict):
        self.row = row
        self.counts, self.hash = np.frombuffer(row["counts"], np.int32).astype(np.int64), np.frombuffer(row["hashes"], np.uint64)
        if "lf" in row:
            self.lf = np.frombuffer(row["lf"], np.int32)
            self.next = np.empty(len(self.lf), np.int32)  # the place of the rotation that begins a symbol later
            self.next[self.lf] = np.arange(len(self.lf), dtype=np.int32)
            self.symbol = np.repeat(np.arange(len(self.counts), dtype=np.int32), self.counts)  # the first symbol of each rotation, in order

    def spelled(self, p: Phrases) -> tuple[list[str], list[str]]:
        """The language and text of each phrase."""
        words, lang = self.row["words"].split(b" "), np.frombuffer(self.row["lang"], np.int32)
        return [self.row["langs"][k] for k in lang[p.words[:, 0] - 1].tolist()], [b" ".join([words[i - 1] for i in r]).decode() for r in p.words.tolist()]

    def level_one(self) -> Phrases:
        h = self.hash[1:]
        none = np.zeros(len(h), np.uint64)
        return Phrases(np.arange(1, len(self.counts), dtype=np.int32)[:, None], np.cumsum(self.counts)[:-1], self.counts[1:], h, none, none)

    def extended(self, p: Phrases, left: bool, filter_: Filter) -> Phrases:
        """All phrases longer by one word whose two shorter parts pass ``filter_``, which all of ``p`` do."""
        k = p.words.shape[1]
        begin = np.cumsum(p.size) - p.size
        which = np.repeat(np.arange(len(p.size), dtype=np.int32), p.size)
        row = np.arange(len(which)) + np.repeat(p.lo - begin, p.size)
        if left:  # the mapping leads to rotations that begin with the new word; equal ones lie together
            to = self.lf[row]
            word = self.symbol[to]
            order = np.argsort(which.astype(np.int64) * len(self.counts) + word)
            which, word, row = which[order], word[order], to[order]
        else:  # the interval's rows are ordered by the word that follows the phrase
            behind = row
            for _ in range(k):
                behind = self.next[behind]
            word = self.symbol[behind]
        if not len(row):
            return p.where(np.zeros(0, np.int64)).longer()
        new = np.ones(len(row), bool)
        new[1:] = (which[1:] != which[:-1]) | (word[1:] != word[:-1])
        new = np.flatnonzero(new)
        lo, size = np.minimum.reduceat(row, new).astype(np.int64), np.diff(np.append(new, len(row)))
        which, word = which[new], word[new]
        h, full = self.hash[word], p.full[which]
        if left:
            part = h * np.uint64(pow(int(_STEP), k - 1, 1 << 64)) + p.head[which]
            hashes = h * np.uint64(pow(int(_STEP), k, 1 << 64)) + full, part, full
        else:
            part = p.tail[which] * _STEP + h
            hashes = full * _STEP + h, full, part
        ok = np.flatnonzero((word > 0) & filter_.passes(part))
        words, column = p.words[which[ok]], word[ok][:, None]
        return Phrases(np.hstack([column, words] if left else [words, column]), lo[ok], size[ok], *(x[ok] for x in hashes))

    def phrases(self, filters: list[Filter], levels: int) -> Iterator[Phrases]:
        """Phrases of 1, 2, ... ``levels`` words; those of k words pass the first k filters, as far as there are so many."""
        got = self.level_one()
        for k in range(1, levels + 1):
            if k > 1:
                got = self.extended(got, k % 2 == 1, filters[k - 2])  # to the right and to the left in turn
            if k <= len(filters):
                got = got.where(filters[k - 1].passes(got.full))
            yield got


class Phrases:
    """Phrases of one length: their words, intervals, and the hashes of the whole, without the last and without the first word."""

    def __init__(self, words, lo, size, full, head, tail):
        self.words, self.lo, self.size, self.full, self.head, self.tail = words, lo, size, full, head, tail

    def where(self, ok: np.ndarray) -> Phrases:
        return Phrases(*(x[ok] for x in (self.words, self.lo, self.size, self.full, self.head, self.tail)))

    def longer(self) -> Phrases:
        """None of these, but with a word more."""
        return Phrases(np.zeros((0, self.words.shape[1] + 1), np.int32), self.lo, self.size, self.full, self.head, self.tail)


def keys(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """``(part, key)``: the table of a phrase and its 32-bit key there."""
    mixed = (hashes ^ (hashes >> np.uint64(29))) * _MIX
    mixed ^= mixed >> np.uint64(32)
    return (mixed & np.uint64(0xFFFFFFF)).astype(np.int64) % parts, (mixed >> np.uint64(32)).astype(np.uint32).view(np.int32)


class Filter:
    """Bits of the keys that may be frequent."""

    def __init__(self, bits: np.ndarray, parts: int):
        self.bits, self.parts = bits, parts

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        part, key = keys(hashes, self.parts)
        at = (key + part * _SPREAD) % (64 * len(self.bits))
        return (self.bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


# -- Spark


def index(spark: SparkSession, docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, size: int = SHARD) -> DataFrame:
    """The shards' indexes, one row per shard, written."""
    small_batches(spark, size=BATCH)
    kind = pa.schema([("langs", pa.list_(pa.string())), ("n_words", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("words", "lang", "hashes", "counts", "lf"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((lang, text) for b in batches for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if text)
        for row in shards(rows, size, longest - 1):
            yield pa.RecordBatch.from_pylist([row], kind)

    lang = F.coalesce(F.col(lang_col), F.lit("und"))
    return staged(spark, docs.select(lang.alias("lang"), F.col(text_col).alias("text")).mapInArrow(run, INDEX), "index", **ROW_GROUPS)


def over_shards(found: DataFrame, schema: str, run: Callable[[Iterator[Shard]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """What ``run`` gives for the shards of each partition."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(Shard(row) for batch in batches for i in range(batch.num_rows) for row in batch.slice(i, 1).to_pylist())

    return found.mapInArrow(each, schema)


def may_be_frequent(spark: SparkSession, found: DataFrame, filters: list, k: int, parts: int, least: int) -> np.ndarray:
    """The bits of the keys of ``k`` words whose counts sum to ``least`` or more."""

    def packed_keys(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        """One row for each table, with its keys and their counts."""
        both, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        n = np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)
        part, key = both >> 32, both.astype(np.uint32).view(np.int32)
        own = np.unique(part)
        cuts = np.append(np.searchsorted(part, own), len(part)).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.ListArray.from_arrays(cuts, pa.array(key)), pa.ListArray.from_arrays(cuts, pa.array(n))], ["part", "key", "n"])

    def counted(found: Iterator[Shard]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for shard in found:
            *_, p = shard.phrases([f.value for f in filters], k)
            part, key = keys(p.full, parts)
            held.append((part << 32 | key.view(np.uint32), p.size))
            n += len(key)
            if n >= HELD_KEYS:
                yield packed_keys(held)
                held, n = [], 0
        if n:
            yield packed_keys(held)

    packed = over_shards(found.select("hashes", "counts", *(["lf"] if k > 1 else [])), "part int, key array<int>, n array<long>", counted)
    # Rows are dealt by table, which is enough for the sums by table and key.
    each = packed.repartition("part").select("part", F.explode(F.arrays_zip("key", "n")).alias("e")).select("part", "e.key", "e.n")
    sums = staged(spark, each.groupBy("part", "key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("part", "key"), "frequent")
    size = min(FILTER_BITS, 1 << (64 + BITS_PER_KEY * sums.count()).bit_length())
    bit = sums.select(F.expr(f"pmod(key + part * {_SPREAD}L, {size}L)").alias("bit"))
    words = bit.groupBy((F.col("bit") / 64).cast("long").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def phrase_counts(spark: SparkSession, found: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """``lang, k, phrase, f`` of all phrases of 1 to ``longest`` words that occur ``least`` times or more, written."""
    n = found.select(F.sum(F.octet_length("lf")).alias("n")).first()["n"] or 0
    parts = int(min(MOST_PARTS, max(32, n // 4 // PART_KEYS)))
    filters = []
    # In a large corpus nearly every pair is of frequent words, so pairs are counted without a look at the words' filter.
    everything = spark.sparkContext.broadcast(Filter(np.full(1, 0xFFFFFFFFFFFFFFFF, np.uint64), parts))
    for k in range(1, longest + 1):
        bits = may_be_frequent(spark, found, [everything] if k == 2 else filters, k, parts, least)
        filters.append(spark.sparkContext.broadcast(Filter(bits, parts)))
        if not bits.any():
            break

    def packed_texts(held: dict[str, dict[str, int]]) -> Iterator[pa.RecordBatch]:
        """One row for each table and language, with sorted phrases, which compress well, and their counts."""
        for lang, counts in held.items():
            tables = defaultdict(list)
            for phrase in sorted(counts):
                tables[zlib.crc32(phrase.encode()) % parts].append(phrase)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(tables), pa.int32()), pa.array([lang] * len(tables)), pa.array(["\n".join(t) for t in tables.values()]), pa.array([[counts[p] for p in t] for t in tables.values()], pa.list_(pa.int64()))], ["part", "lang", "phrases", "f"]
            )

    def spelled(found: Iterator[Shard]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
        for shard in found:
            for p in shard.phrases([x.value for x in filters], len(filters)):
                for lang, phrase, f in zip(*shard.spelled(p), p.size.tolist(), strict=True):
                    held[lang][phrase] += f
            if sum(map(len, held.values())) >= HELD_KEYS // 4:
                yield from packed_texts(held)
                held.clear()
        yield from packed_texts(held)

    packed = over_shards(found, "part int, lang string, phrases string, f array<long>", spelled)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sums of each table, one table at a time."""

        def frequent() -> pa.RecordBatch:
            rows = [(lang, phrase.count(" ") + 1, phrase, n) for (lang, phrase), n in sums.items() if n >= least]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 4, (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], ["lang", "k", "phrase", "f"])

        now, sums = None, defaultdict(int)
        for batch in batches:
            for part, lang, phrases, f in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now:
                    yield frequent()
                    now, sums = part, defaultdict(int)
                for phrase, n in zip(phrases.split("\n"), f, strict=True):  # no phrase has a line end
                    sums[lang, phrase] += n
        yield frequent()

    # A table holds at most one phrase in ``least`` of its share of the words, for each length, and the few that the filters let through.
    out = staged(spark, packed.repartition("part").sortWithinPartitions("part").mapInArrow(summed, "lang string, k int, phrase string, f long"), "phrases")
    for f in (*filters, everything):
        f.destroy()
    return out


def scored(spark: SparkSession, counts: DataFrame, totals: DataFrame) -> DataFrame:
    """``lang, phrase, a, l, r, n, score, left_max, right_max`` of all phrases of two words or more: the cut that scores least, and the counts of the most frequent
    phrases with one more word on the left or right (0: none that is frequent)."""
    words = F.split("phrase", " ")
    part = lambda of, to: F.array_join(F.slice(words, of, to), " ")
    cut = F.col("cut")
    cuts = staged(spark, counts.where("k >= 2").select("lang", "phrase", "k", F.col("f").alias("a"), F.explode(F.expr("sequence(1, k - 1)")).alias("cut")).withColumn("first", part(F.lit(1), cut)).withColumn("rest", part(cut + 1, F.col("k") - cut)).drop("k"), "cuts")
    l = counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))  # noqa: E741
    r = counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    with_l = staged(spark, join_hot(spark, cuts, l, ["lang", "first"]).drop("first"), "with_l")
    with_r = join_hot(spark, with_l, r, ["lang", "rest"]).drop("rest").join(broadcast_if_small(totals), "lang")
    # Whole numbers up to 38 digits: a and n below 10**17, their parts' product below 10**36.
    whole = lambda c: f"cast({c} as decimal(17, 0))"
    score = F.expr(f"{whole('a')} * {whole('n')} * cast(1000 as decimal(4, 0)) div ({whole('l')} * {whole('r')})")
    best = with_r.withColumn("s", score).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("s", "cut", "l", "r")).alias("b"))
    longer = counts.where("k >= 3")
    side = lambda of, name, other: longer.select("lang", part(F.lit(of), F.col("k") - 1).alias("phrase"), F.col("f").alias(name), F.lit(None).cast("long").alias(other))
    most = side(2, "left_max", "right_max").unionByName(side(1, "right_max", "left_max")).groupBy("lang", "phrase").agg(F.max("left_max").alias("left_max"), F.max("right_max").alias("right_max"))
    got = best.join(most, ["lang", "phrase"], "left").fillna(0, ["left_max", "right_max"])
    return got.select("lang", "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), "n", F.col("b.s").alias("score"), "left_max", "right_max")


def collocations(spark: SparkSession, docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, lang_col: str = "lang", text_col: str = "text", size: int = SHARD) -> DataFrame:
    """The ``top`` phrases of each language, without those that a longer one of the same count contains."""
    found = index(spark, docs, lang_col, text_col, longest, size)
    totals = staged(spark, found.select(F.explode(F.arrays_zip("langs", "n_words")).alias("e")).groupBy(F.col("e.langs").alias("lang")).agg(F.sum("e.n_words").alias("n")), "totals")
    all_ = scored(spark, phrase_counts(spark, found, least, longest), totals)
    # A longer candidate that occurs as often has, between, one that is longer by one word and occurs as often.
    free = all_.where("greatest(left_max, right_max) < a")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rank = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    few = rank(free.withColumn("piece", F.pmod(F.xxhash64("phrase"), F.lit(PIECES_OF_LANG))), "lang", "piece").drop("rank", "piece")
    return rank(few, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of all ``documents``, by language."""
    return collocations(spark, table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM piece),
total AS (SELECT lang, sum(len(w)) AS n FROM worded GROUP BY lang),
gram AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM worded, generate_series(1, 5) AS s(k), LATERAL (SELECT unnest(generate_series(1, len(w) - k + 1)) AS i)),
counted AS (SELECT lang, k, phrase, count(*) AS f FROM gram GROUP BY ALL HAVING count(*) >= 100),
cut AS (
  SELECT lang, phrase, k, f AS a, c, array_to_string(string_split(phrase, ' ')[1:c], ' ') AS first, array_to_string(string_split(phrase, ' ')[c + 1:], ' ') AS rest
  FROM counted, LATERAL (SELECT unnest(generate_series(1, k - 1)) AS c) WHERE k >= 2),
scored AS (
  SELECT cut.lang, cut.phrase, a, c, l.f AS l, r.f AS r, n, (1000::HUGEINT * a * n::HUGEINT) // (l.f::HUGEINT * r.f) AS score
  FROM cut JOIN counted l ON l.lang = cut.lang AND l.phrase = first JOIN counted r ON r.lang = cut.lang AND r.phrase = rest JOIN total ON total.lang = cut.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inside AS (
  SELECT lang, f, array_to_string(string_split(phrase, ' ')[i:j], ' ') AS phrase
  FROM counted, LATERAL (SELECT i, unnest(generate_series(i + 1, k)) AS j FROM (SELECT unnest(generate_series(1, k - 1)) AS i)) WHERE k >= 3 AND j - i + 1 < k),
hidden AS (SELECT b.lang, b.phrase FROM best b JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.f >= 100 * b.a),
free AS (SELECT * FROM best ANTI JOIN hidden USING (lang, phrase))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM free QUALIFY rank <= 2000
"""
