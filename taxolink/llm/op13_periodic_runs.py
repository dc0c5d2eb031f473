"""Operator 13, periodic runs of words by enhanced suffix arrays.

A run is a stretch of words with smallest period q and length >= max(LEAST, TIMES * q) that no neighbouring word extends.  For every batch of texts
one suffix array, its inverse and its LCP array are made (words count as different in different texts, so no comparison leaves a text).  An LCP interval
of depth d holds the suffixes that share d words; of each two neighbouring parts of an interval the smaller one's suffixes i are taken, and i + d and
i - d looked up in the inverse: if it lies in the other part, the square of period d at the smaller of the two positions cannot be moved to the right.
Squares with one end are moved to the left, the smallest period first, and give one run; multiples of its period add nothing.

How it runs at scale: one pass over the rows, no shuffle, no state between batches.  The suffix array is made by doubling, in which only suffixes that still
share their prefix are sorted again; intervals are bounds found with one stack over the LCP array, without nodes; all else is numpy.  Memory grows with
one batch of at most 256 rows or about 32 MB, or with one text where that is longer.

Null and empty texts have no words and no runs; texts are read whole, whatever their length; rows that repeat an id are rows of their own; a null id
stays null and leaves the words as they are; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolink.llm.common import small_batches, table

#: The least length of a run, in words and in periods.
LEAST, TIMES = 6, 4
#: Suffixes looked up in one go.
CHUNK = 1 << 21


def suffixes(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """``(sa, levels)``: the suffix array, and for each k the ranks of all positions by their first 2**k symbols, with -1 behind the end."""
    n = len(symbols)
    sa = np.argsort(symbols, kind="stable")
    slots, key, levels = np.arange(n), symbols[sa], []
    rank = np.full(n + 1, -1, np.int64)
    while True:
        new = np.ones(len(slots), bool)
        new[1:] = key[1:] != key[:-1]
        rank = rank.copy()
        rank[sa[slots]] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        levels.append(rank)
        alone = new & np.append(new[1:], True)
        slots = slots[~alone]
        if not len(slots):
            return sa, levels
        at = sa[slots]
        key = rank[at] * (n + 1) + rank[at + (1 << (len(levels) - 1))] + 1
        order = np.argsort(key)
        sa[slots], key = at[order], key[order]


def common_prefixes(sa: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """``lcp[k]`` of the suffixes in slots k - 1 and k, 0 at both ends."""
    lcp = np.zeros(len(sa) + 1, np.int64)
    pairs, shared = np.arange(1, len(sa)), []
    for rank in levels:  # those that share 2**k words are among those that share half as many
        pairs = pairs[rank[sa[pairs - 1]] == rank[sa[pairs]]]
        shared.append(pairs)
    for k in reversed(range(len(levels))):
        p = shared[k]
        same = levels[k][sa[p - 1] + lcp[p]] == levels[k][sa[p] + lcp[p]]
        lcp[p[same]] += 1 << k
    return lcp


def interval_bounds(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each k the nearest slot before with an LCP not above, and the nearest one behind with a smaller LCP."""
    values = lcp.tolist()
    before, behind, stack = [0] * len(values), [len(values) - 1] * len(values), [0]
    for k in range(1, len(values) - 1):
        h = values[k]
        while values[stack[-1]] > h:
            behind[stack.pop()] = k
        before[k] = stack[-1]
        stack.append(k)
    return np.array(before), np.array(behind)


def branching_squares(sa: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(start, period)`` of all squares that do not go on by one word to the right, each once, whether primitive or not."""
    isa = np.empty(len(sa) + 1, np.int64)
    isa[sa], isa[-1] = np.arange(len(sa)), -1
    before, behind = interval_bounds(lcp)
    k = np.flatnonzero(lcp)
    depth, lo, hi = lcp[k], before[k], behind[k]
    left = k - lo <= hi - k
    first, size = np.where(left, lo, k), np.where(left, k - lo, hi - k)
    other, end = np.where(left, k, lo), np.where(left, hi, k)
    done, starts, periods = np.cumsum(size), [], []
    at = 0
    while at < len(k):
        to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + CHUNK, "right")))
        n = size[at:to]
        which = np.repeat(np.arange(at, to), n)
        i = sa[first[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)]
        d = depth[which]
        for j in (i + d, i - d):
            slot = isa[np.clip(j, -1, len(sa))]
            hit = np.flatnonzero((slot >= other[which]) & (slot < end[which]) & (j >= 0))
            starts.append(np.minimum(i, j)[hit])
            periods.append(d[hit])
        at = to
    none = np.zeros(0, np.int64)
    return np.concatenate(starts or [none]), np.concatenate(periods or [none])


def runs(symbols: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of at least ``least`` symbols and ``times`` >= 2 periods, ordered."""
    sa, levels = suffixes(symbols)
    start, period = branching_squares(sa, common_prefixes(sa, levels))
    more = np.maximum(least - 2 * period, (times - 2) * period)  # words that the run needs to the left of its last square
    ok = start >= more
    start, period, more = start[ok], period[ok], more[ok]
    # The run is long enough if the first ``more + period`` words from there are those one period later: two blocks of a power of two tell.
    length, x = more + period, start - more
    power = np.frexp(length.astype(float))[1] - 1
    ok = np.zeros(len(start), bool)
    for p in np.unique(power[power < len(levels)]):
        s = np.flatnonzero(power == p)
        rank, a, rest = levels[p], x[s], length[s] - (1 << p)
        ok[s] = (rank[a] == rank[a + period[s]]) & (rank[a + rest] == rank[a + rest + period[s]])
    found: dict[int, list[tuple[int, int]]] = {}
    for s, q in sorted(zip(start[ok].tolist(), period[ok].tolist(), strict=True), key=lambda r: r[1]):
        same_end = found.setdefault(s + 2 * q, [])
        if any(q % p == 0 and s >= first for first, p in same_end):
            continue
        step = q
        while step:  # to the left, in steps that double while they hold and halve where they do not
            if step <= s and np.array_equal(symbols[s - step : s], symbols[s - step + q : s + q]):
                s, step = s - step, 2 * step
            else:
                step //= 2
        same_end.append((s, q))
    return sorted((s, end - s, q) for end, rs in found.items() for s, q in rs)


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds behind its first period, joined by one space."""
    if not found:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, q in found:
        keep[start + q : start + length] = False
    return b" ".join(words[i] for i in np.flatnonzero(keep).tolist())


def batch_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, given as words, by one suffix array over all of them."""
    ids: dict[bytes, int] = defaultdict(count().__next__)
    sizes = np.array([len(w) for w in texts], np.int64)
    symbols = np.fromiter((ids[w] for words in texts for w in words), np.int64, sizes.sum())
    ends = np.cumsum(sizes)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if len(symbols):
        symbols += np.repeat(np.arange(len(texts)), sizes) * len(ids)
        for start, length, q in runs(symbols):
            t = int(np.searchsorted(ends, start, "right"))
            out[t].append((start - int(ends[t] - sizes[t]), length, q))
    return out


def find_runs(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", change: Callable[[int, list[bytes]], list[bytes]] | None = None, listed: bool = False) -> DataFrame:
    """One row per document: ``id, n_runs``, the longest run, digests of all runs and of the text without repeats; with ``listed`` the runs and that text, too.

    ``change(id, words)`` may give other words for a document, before runs are looked for.
    """
    small_batches(spark)
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    if listed:
        schema += ", runs array<struct<start:long,length:long,period:long>>, collapsed string"
    digest = lambda b: hashlib.sha256(b).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [(t or "").encode().split() for t in batch.column(1).to_pylist()]  # bytes split at just the six characters
            if change:
                texts = [w if i is None else change(i, w) for i, w in zip(ids, texts, strict=True)]
            found = batch_runs(texts)
            best = [max(rs, key=lambda r: (r[1], -r[0], -r[2])) if rs else (None, None, None) for rs in found]
            bare = [collapsed(w, rs) for w, rs in zip(texts, found, strict=True)]
            numbers = [[len(rs) for rs in found], [b[0] for b in best], [b[1] for b in best], [b[2] for b in best], [b[1] and 1000 * b[1] // b[2] for b in best]]
            listing = [digest(b"".join(b"%d,%d,%d\n" % r for r in rs)) for rs in found]
            columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in numbers), pa.array(listing), pa.array(list(map(digest, bare)))]
            names = [id_col, "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
            if listed:
                kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
                columns += [pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in rs] for rs in found], kind), pa.array([b.decode() for b in bare])]
                names += ["runs", "collapsed"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def planted(doc_id: int, words: list[bytes]) -> list[bytes]:
    """The contract's periodic tail, for one document in ten."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    times, rest = divmod(n - a, p)
    unit = words[a : a + p]
    return words[:a] + unit * times + unit[:rest]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every whole text of ``documents``, with the contract's planted tails."""
    return find_runs(spark, table(spark, sf_dir, "documents"), change=planted)


#: The whole query: crc32 from its table, matching words q apart as islands, the smallest period of each stretch.
ORACLE_SQL = r"""
WITH step AS (SELECT list_transform(range(256), lambda i: list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
doc AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) AS h
  FROM documents, step),
place AS (SELECT *, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a FROM doc),
unit AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM place),
words AS (SELECT k, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) ELSE w END AS w FROM unit),
flat AS MATERIALIZED (SELECT k, n, unnest(w) AS word, unnest(range(n)) AS i FROM words),
pair AS (SELECT x.k, y.i - x.i AS q, x.i FROM flat x JOIN flat y ON x.k = y.k AND x.word = y.word AND y.i > x.i AND y.i - x.i <= x.n // 4),
island AS (SELECT k, q, min(i) AS s, count(*) + q AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY k, q ORDER BY i) AS g FROM pair) GROUP BY k, q, g),
run AS (SELECT k, s, l, min(q) AS q FROM island WHERE l >= greatest(6, 4 * q) GROUP BY k, s, l),
runs AS (SELECT k, count(*) AS n_runs, list({'s': s, 'l': l, 'q': q} ORDER BY s, q) AS rs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS listed, max({'l': l, 's': -s, 'q': -q}) AS best FROM run GROUP BY k),
kept AS (SELECT words.k, words.doc_id, w, rs, n_runs, listed, best, CASE WHEN rs IS NULL THEN range(n) ELSE list_filter(range(n), lambda i: len(list_filter(rs, lambda r: i >= r.s + r.q AND i < r.s + r.l)) = 0) END AS left_ FROM words LEFT JOIN runs ON runs.k = words.k)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, -best.s AS start, best.l AS length, -best.q AS period, 1000 * best.l // -best.q AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(array_to_string(list_transform(left_, lambda i: w[1 + i]), ' ')) AS collapsed_sha256
FROM kept
"""
