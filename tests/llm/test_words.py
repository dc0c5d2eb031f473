"""Operators 11 and 13 against brute force and SQL."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import compare
import numpy as np
import pytest

from taxolink.llm import op11_collocations as o11
from taxolink.llm import op13_periodic_runs as o13

# -- 11


def brute_collocations(rows, least, longest, top):
    n, f = Counter(), Counter()
    for lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words) if lang is None or lang else 0
            for k in range(1, longest + 1):
                f.update((lang if lang is not None else "und", tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    f = {p: c for p, c in f.items() if c >= least}
    hidden = {(lang, p[i:j]) for (lang, p), c in f.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and c >= f[lang, p[i:j]]}
    out = defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) > 1 and (lang, p) not in hidden:
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1))


def frame(spark, rows):
    return spark.createDataFrame([(lang, text, 1, "k") for lang, text in rows], "lang string, text string, n int, phrase string").repartition(5)


def some_rows(seed, n=400):
    r = random.Random(seed)
    words = ["The", "the", "of", "x", "y1", "É", "é", "ſ", "a\x1cb", "漢字", "z", "q-q", "\x00", "\xa0"]
    fixed = ["one two three four five six", "of the x y1 z", "É é ſ 漢字"]
    for _ in range(n):
        text = "".join(r.choice([r.choice(fixed), *(r.choice(words) for _ in range(4))]) + r.choice([" ", " ", "  ", "\t", " ", ". ", ",", "\n", "!?", "\r\n"]) for _ in range(r.randint(0, 40)))
        yield r.choice(["en", "en", "en", "de", None, "und"]), r.choice([text] * 9 + [None, "", " . "])


@pytest.mark.parametrize(("size", "least", "longest"), [(1 << 21, 20, 5), (50, 20, 5), (700, 3, 4), (300, 8, 2)])
def test_collocations(spark, size, least, longest):
    """Shards of all sizes, also smaller than one text; few and many frequent phrases; ties, repeated rows, nulls."""
    rows = list(some_rows(size))
    rows += rows[:50]
    got = sorted(tuple(r) for r in o11.collocations(spark, frame(spark, rows), least, longest, top=100, size=size).collect())
    want = brute_collocations(rows, least, longest, 100)
    assert got == want and len(want) > 20


def test_full_filters_and_equal_keys(spark, monkeypatch):
    """With filters of 64 bits and one table, nearly everything passes; the rows stay right."""
    monkeypatch.setattr(o11, "FILTER_BITS", 64)
    rows = list(some_rows(3))
    got = sorted(tuple(r) for r in o11.collocations(spark, frame(spark, rows), 20, top=50, size=500).collect())
    assert got == brute_collocations(rows, 20, 5, 50)


def test_large_numbers(spark):
    """Products of more than 64 bits are exact."""
    counts = spark.createDataFrame([("en", 1, "a", 3_000_000_000_001), ("en", 1, "b", 5_000_000_000_003), ("en", 2, "a b", 2_999_999_999_999)], "lang string, k int, phrase string, f long")
    totals = spark.createDataFrame([("en", 90_000_000_000_000_001)], "lang string, n long")
    r = o11.scored(spark, counts, totals).first()
    assert r["score"] == 1000 * 2_999_999_999_999 * 90_000_000_000_000_001 // (3_000_000_000_001 * 5_000_000_000_003)


def test_collocations_empty(spark):
    assert o11.collocations(spark, frame(spark, [("en", "a")]).limit(0)).count() == 0
    assert o11.collocations(spark, frame(spark, [("en", "a b c")])).count() == 0


def test_intervals():
    """The interval of every phrase has its occurrences, whichever side it grew on; intervals do not overlap."""
    r = np.random.default_rng(1)
    symbols = np.concatenate([[0], r.integers(0, 4, 3000), [0]])
    shard = o11.Shard(o11.build(symbols, [(0, b"a"), (0, b"b"), (0, b"c")], ["en"], [3], 4))
    everything = o11.Filter(np.full(2, 0xFFFFFFFFFFFFFFFF, np.uint64), 1)
    for k, p in enumerate(shard.phrases([everything] * 4, 5), 1):
        real = Counter(t for t in (tuple(symbols[i : i + k].tolist()) for i in range(len(symbols) - k + 1)) if 0 not in t)
        assert dict(zip(map(tuple, p.words.tolist()), p.size.tolist(), strict=True)) == real
        if k < 5:
            order = np.argsort(p.lo)
            assert (p.lo[order][1:] >= (p.lo + p.size)[order][:-1]).all()


# -- 13


def brute_runs(words):
    out = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


def test_runs():
    r = random.Random(1)
    for _ in range(1500):
        texts = []
        for _ in range(r.randint(1, 5)):
            words, k = [], r.randint(1, 3)
            while len(words) < r.randint(0, 70):
                words += [b"abc"[x : x + 1] for x in (r.randrange(k) for _ in range(r.randint(1, 5)))] * r.randint(1, 7)
            texts.append(words)
        assert o13.batch_runs(texts) == [brute_runs(w) for w in texts]


def test_long_runs(monkeypatch):
    """One word 200,000 times, Fibonacci words (most squares), and look-ups in small goes."""
    monkeypatch.setattr(o13, "CHUNK", 100)
    assert o13.batch_runs([[b"a"] * 200_000, [b"a"] * 5, []]) == [[(0, 200_000, 1)], [], []]
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 500:
        a, b = b, b + a
    assert o13.batch_runs([b * 5, b]) == [brute_runs(b * 5), brute_runs(b)]


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is not None:
        import zlib

        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def by_text(rows):
    return sorted(map(str, rows))


def test_runs_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = [tuple(r) for r in o13.op13_periodic_runs(spark, sf_dir).collect()]
    assert by_text(got) == by_text(expected(*d) for d in docs)
    assert sum(r[1] > 0 for r in got) > 10


def test_runs_of_odd_rows(spark):
    """Nulls, empty and long texts, white space that is none here, ties of length, repeated ids, an empty table."""
    rows = [(None, "a " * 9), (1, None), (1, ""), (2, " \t\n"), (3, "a\xa0a " * 7), (4, "b b b b b b x c c c c c c"), (4, "b b b b b b x c c c c c c"), (5, "w v " * 1_500), (6, "a\x1ca " * 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as n_runs", "2 as start")
    got = o13.find_runs(spark, docs, change=o13.planted, listed=True)
    assert by_text(tuple(r)[:8] for r in got.collect()) == by_text(expected(*d) for d in rows)
    assert {(r["doc_id"], r["collapsed"], len(r["runs"])) for r in got.where("doc_id = 4").collect()} == {(4, "b x c", 2)}
    assert o13.find_runs(spark, docs.limit(0)).count() == 0


@pytest.mark.parametrize(("module", "name"), [(o11, "op11_collocations"), (o13, "op13_periodic_runs")])
def test_same_rows_as_sql(spark, sf_dir, module, name):
    if not getattr(module, "ORACLE_SQL", None):
        pytest.skip("no SQL")
    assert compare.difference(getattr(module, name)(spark, sf_dir), compare.connect(sf_dir), module.ORACLE_SQL) == ""
