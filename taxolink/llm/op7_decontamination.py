"""Operator 7, benchmark decontamination by pigeonhole edit matching.

Texts are normalised to lower-cased words of letters and digits with single spaces.  A test item of
length m may differ by k edits (``ERROR_RATE`` of m, fewer for short items) from a passage anywhere in a document.  It is cut into k + 1
pieces; k edits can touch at most k of them, so one piece must occur unchanged.  All pieces of a block of items
are looked up in one pass over the text by an Aho-Corasick automaton, and around every hit the least edit
distance of the whole item to a passage is computed by Myers' bit-parallel algorithm (Python integers hold the bit vectors of any item).

Items of fewer than ``MIN_WORDS`` words and ``MIN_CHARS`` characters have no room for edits: they are found exactly, from word border to
word border.  Between characters of scripts that are written without spaces every place is a border.

How it runs at scale: the distinct normal forms of the items are a table, cut by hash into blocks of about ``BLOCK_CHARS`` characters.  One block at a
time comes to the driver and is broadcast, so both have a fixed bound however large the test set is; documents are never shuffled, each is read
once per block, whole, and what a block gives is written before its broadcast goes and the next one comes.  Items with one normal form are looked for
once; their ids are joined to what was found.  Hits of one item at nearly the same place are verified once, in a window of at most m + 4 k
characters around each hit.

A document is reported once for each item that it holds, with the least distance.  Null and empty texts hold nothing; empty tables of either kind
find nothing.  Only items without a letter or digit match nothing: an item of one common word is in every document that has the word.  Items
with the same normal form are all reported.  Rows that repeat an id are reported per row, and null ids are
reported as null.  Columns of any name pass through ``decontaminate``.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolink.llm.common import broadcast_if_small, small_batches, staged, table

ERROR_RATE = 0.06
#: Pieces are at least so long; an item's error budget shrinks until they are.
MIN_PIECE = 12
#: Items with fewer words and fewer characters than these are matched exactly, at word borders.
MIN_WORDS, MIN_CHARS = 8, 40
#: Characters of normalised items in one block, about.
BLOCK_CHARS = 4_000_000

_WORD = re.compile(r"[^\W_]+")
#: Scripts without spaces between words: Thai and Lao, Burmese, Khmer, kana, Han.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")


def normal(text: str | None) -> str:
    return " ".join(_WORD.findall((text or "").lower()))


def budget(m: int, rate: float = ERROR_RATE, min_piece: int = MIN_PIECE) -> int:
    return max(0, min(int(m * rate), m // min_piece - 1))


def is_short(item: str) -> bool:
    return item.count(" ") + 1 < MIN_WORDS and len(item) < MIN_CHARS


def is_border(text: str, at: int) -> bool:
    """Whether a word of the normal form ``text`` may begin or end before position ``at``."""
    return at in (0, len(text)) or " " in text[at - 1 : at + 1] or bool(_UNSPACED.search(text, at - 1, at + 1))


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """``item`` cut into k + 1 pieces of nearly equal length: (offset, piece)."""
    cuts = [i * len(item) // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Pattern:
    """Myers' bit-parallel matcher for one item."""

    def __init__(self, item: str):
        self.m, self.peq = len(item), defaultdict(int)
        for i, c in enumerate(item):
            self.peq[c] |= 1 << i

    def least(self, text: str) -> tuple[int, int]:
        """The least edit distance of the item to any substring of ``text``, and that substring's (first) end."""
        full, top = (1 << self.m) - 1, 1 << (self.m - 1)
        pv, mv, score, best = full, 0, self.m, (self.m, 0)
        get = self.peq.get
        for j, c in enumerate(text, 1):
            eq = get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | ~(xh | pv) & full
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph = ph << 1 & full  # row 0 stays 0: the passage may begin anywhere
            mh = mh << 1 & full
            pv = mh | ~(xv | ph) & full
            mv = ph & xv
            if score < best[0]:
                best = (score, j)
        return best


class Matcher:
    """All occurrences of a block of items ``[(number, normal form)]`` in texts."""

    def __init__(self, items: Iterable[tuple[int, str]], rate: float = ERROR_RATE, min_piece: int = MIN_PIECE):
        import ahocorasick

        self.items: dict[str, list[int]] = defaultdict(list)
        for item_id, item in items:
            self.items[item].append(item_id)
        self.short = set(filter(is_short, self.items))
        self.budget = {item: 0 if item in self.short else budget(len(item), rate, min_piece) for item in self.items}
        self.patterns: dict[str, Pattern] = {}
        where: dict[str, list[tuple[str, int]]] = defaultdict(list)
        for item in self.items:
            for at, piece in pieces(item, self.budget[item]):
                where[piece].append((item, at))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in where.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if where:
            self.automaton.make_automaton()

    def __call__(self, text: str | None) -> dict[int, int]:
        """``{number: least distance}`` of the items in ``text``."""
        text, spots = normal(text), defaultdict(set)
        if not text or not self.items:
            return {}
        for end, (n, uses) in self.automaton.iter(text):
            for item, at in uses:
                if item not in self.short or (is_border(text, end - n + 1) and is_border(text, end + 1)):
                    spots[item].add(end - n + 1 - at)
        found = {}
        for item, starts in spots.items():
            k, reach, best = self.budget[item], -1, None
            for s in sorted(starts):
                a, b = max(0, s - 2 * k), s + len(item) + 2 * k
                if b <= reach:
                    continue
                # Neighbouring starts share a window; it begins where this start's does and ends k after the last that is near.
                reach = max(b, s + len(item) + 2 * k + k)
                if text[s : s + len(item)] == item:
                    best = 0
                    break
                if k:
                    d, _ = self.patterns.setdefault(item, Pattern(item)).least(text[a:reach])
                    if d <= k and (best is None or d < best):
                        best = d
            if best is not None:
                found.update(dict.fromkeys(self.items[item], best))
        return found


def normal_forms(spark: SparkSession, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(forms, members)``, written: ``number, form`` of the distinct normal forms of ``items(item_id, text)``, and ``item_id, number``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array([normal(t) for t in batch.column("text").to_pylist()], pa.string())], ["item_id", "form"])

    each = items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, form string").where("form <> ''")
    each = staged(spark, each, "items")
    forms = staged(spark, each.select("form").distinct().withColumn("number", F.monotonically_increasing_id()), "forms")
    return forms, staged(spark, each.join(forms, "form").select("item_id", "number"), "members")


def per_block(spark: SparkSession, forms: DataFrame, block_chars: int, run: Callable[[Broadcast, bool], None]) -> None:
    """Call ``run(block, last)`` with each block of ``forms`` in turn; all but the last block's broadcasts are destroyed after it."""
    n = max(1, -(-(forms.agg(F.sum(F.length("form"))).first()[0] or 0) // block_chars))
    blocks = staged(spark, forms.withColumn("block", F.pmod(F.xxhash64("form"), F.lit(n)).cast("int")), "blocks", "block")
    for i in range(n):
        shared = spark.sparkContext.broadcast([(r["number"], r["form"]) for r in blocks.where(F.col("block") == i).select("number", "form").collect()])
        run(shared, i == n - 1)
        if i < n - 1:
            shared.destroy()


def contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, item_id, distance``: which documents hold which items of ``items(item_id, text)``."""
    small_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    forms, members = normal_forms(spark, items)
    found: list[DataFrame] = []

    def search(block: Broadcast, last: bool) -> None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            match = Matcher(block.value, rate)
            for batch in batches:
                rows = [(doc_id, number, d) for doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text")), strict=True) for number, d in match(text).items()]
                columns = zip(*rows, strict=True) if rows else ([], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32()), strict=True)], ["doc_id", "number", "distance"])

        hits = docs.mapInArrow(run, "doc_id long, number long, distance int")
        found.append(hits if last else staged(spark, hits, "hits"))

    per_block(spark, forms, block_chars, search)
    return reduce(DataFrame.unionByName, found).join(broadcast_if_small(members), "number").select("doc_id", "item_id", "distance")


def decontaminate(spark: SparkSession, docs: DataFrame, items: DataFrame, text_col: str = "text", rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` whose text holds no item, columns unchanged; decided row by row, so no join is needed."""
    small_batches(spark)

    def without(block: Broadcast, last: bool) -> None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            match = Matcher(block.value, rate)
            for batch in batches:
                yield batch.filter(pa.array([not match(t) for t in batch.column(text_col).to_pylist()], pa.bool_()))

        nonlocal docs
        kept = docs.mapInArrow(run, docs.schema)
        docs = kept if last else staged(spark, kept, "kept")

    per_block(spark, normal_forms(spark, items)[0], block_chars, without)
    return docs


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only contaminated documents have rows: one for each benchmark item in it."""
    return contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
