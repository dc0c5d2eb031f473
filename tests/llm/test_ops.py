"""The ten operators against brute-force versions, exact round trips, held-out accuracy and odd inputs."""

import hashlib
import json
import random
import re
import zlib
from collections import defaultdict

import compare
import numpy as np
import pytest
from pyspark import Broadcast, SparkContext
from pyspark.sql import functions as F

from taxolink.llm import op1_mixing as o1
from taxolink.llm import op2_near_duplicates as o2
from taxolink.llm import op3_token_files as o3
from taxolink.llm import op4_token_counts as o4
from taxolink.llm import op5_line_dedup as o5
from taxolink.llm import op6_license_scan as o6
from taxolink.llm import op7_decontamination as o7
from taxolink.llm import op8_exact_top_k as o8
from taxolink.llm import op9_quality as o9
from taxolink.llm import op10_secrets as o10
from taxolink.llm import common, queries, tokens

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls in every column, empty and long texts, repeated rows and ids, and columns with names that operators use inside.
ODD = [
    (1, "Same text of five words here.\nLine", "en", "a", 1), (1, "Same text of five words here.\nLine", "en", "a", 1), (2, None, None, None, None), (3, "", "en", "a", 0), (None, "no id at all", "en", "b", 1),
    (None, None, None, None, None), (4, " \t\n ", "en", None, 1), (5, "word " * 30_000, "en", "b", 1), (6, "Same TEXT of five words here.\nLine", "en", "c", 1), (7, "<|endoftext|> é ½ 漢字 ́x", "zh", "c", 1), (8, "one", "en", "c", 1),
]


def docs_of(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, ODD).withColumn("key", F.lit("k")).withColumn("size", F.lit(1)).withColumn("keys", F.lit(2)).withColumn("rep", F.lit(3)).withColumn("rate", F.lit(9.0)).withColumn("score", F.lit(0.1))


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_of_hot_keys(spark, monkeypatch, how):
    """Hot, null and other keys of one and two columns, with and without partners, give what a plain join gives."""
    monkeypatch.setattr(common, "HOT_KEYS", 50)
    left = common.staged(spark, spark.range(3000).select(F.when(F.col("id") % 3 == 0, 8).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 900).cast("long").alias("a"), (F.col("id") % 2).alias("b"), "id"), "left")
    right = common.staged(spark, spark.range(0, 900, 2).select(F.col("id").alias("a"), F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("b"), (F.col("id") * 2).alias("v")), "right")
    got, want = common.join_hot(spark, left, right, ["a", "b"], how), left.join(right, ["a", "b"], how)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    one = right.where("b = 0").drop("b")
    assert sorted(map(str, common.join_hot(spark, left, one, ["a"], how).collect())) == sorted(map(str, left.join(one, ["a"], how).collect()))


def test_components_are_brute_force(spark):
    """A long chain, a hub with a large number, stars and repeated edges."""
    rnd = random.Random(15)
    edges = [(i, i + 1) for i in range(60)] + [(999, 100 + i) for i in range(80)] + [(rnd.randrange(200, 400), rnd.randrange(200, 400)) for _ in range(110)] + [(5, 5), (6, 5), (6, 5)]
    got = {r["node"]: r["component"] for r in common.components(spark, spark.createDataFrame(edges, "u long, v long")).collect()}
    want = brute_components({x for e in edges for x in e}, edges)
    assert got == {n: c for n, c in want.items() if any(n in e for e in edges if e[0] != e[1])}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, sf_dir, name):
    assert compare.difference(queries.queries()[name](spark, sf_dir), compare.connect(sf_dir), queries.oracle_sql()[name]) == ""


# --- 1 -------------------------------------------------------------------------------------------


def brute_targets(sizes, weights, cap=3.0):
    total, target, open_ = sum(sizes.values()), {}, set(sizes)
    left = total
    while open_:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if level * weights[s] > cap * sizes[s]}
        if not full:
            target |= {s: level * weights[s] for s in open_}
            break
        for s in full:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mix_targets(spark):
    rnd = random.Random(1)
    for _ in range(4):
        sizes = {f"s{i:02d}": rnd.choice([0, 1, 10, 100, 5000]) for i in range(rnd.randint(1, 9))}
        weights = {s: float(i % 3 + 1) for i, s in enumerate(sorted(sizes))}
        df = spark.createDataFrame([(s, weights[s], n) for s, n in sizes.items()], "source string, weight double, size long")
        got = {r["source"]: r["target"] for r in o1.targets(df).collect()}
        assert got == pytest.approx(brute_targets(sizes, weights))


def test_mix_query(spark, sf_dir, documents):
    rows = o1.op1_mix_sources(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(documents)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")) for i, d in documents.items()}
    total = defaultdict(int)
    for i, d in documents.items():
        total[d["source"]] += size[i]
    want = brute_targets(total, {s: float(i % 3 + 1) for i, s in enumerate(sorted(total))})
    taken = defaultdict(int)
    for r in rows:
        s = documents[r["doc_id"]]["source"]
        assert (r["size"], r["source_size"], r["target"]) == (size[r["doc_id"]], total[s], pytest.approx(want[s]))
        assert r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
    # Ten documents a source: no choice of whole documents comes nearer than a part of one.
    largest = {s: max(size[i] for i, d in documents.items() if d["source"] == s) for s in want}
    assert all(abs(taken[s] - want[s]) <= max(0.05 * want[s], largest[s] / 2) for s in want)
    assert sorted(rows) == sorted(o1.op1_mix_sources(spark, sf_dir).collect())


def test_mix_odd(spark, odd):
    got = o1.mix(spark, odd)
    assert got.columns == odd.columns
    first, again = (sorted(map(str, o1.mix(spark, odd).select("doc_id", "source").collect())) for _ in range(2))
    assert first == again
    assert o1.mix(spark, odd.where("false")).count() == 0
    weights = spark.createDataFrame([("a", 1.0), (None, 2.0)], "source string, weight double")
    assert {r["source"] for r in o1.mix(spark, odd, weights).select("source").distinct().collect()} <= {"a", None}


def test_mix_of_repeated_rows_and_null_ids(spark, tmp_path):
    """Groups of rows that no id or text tells apart are not taken or left as one; sizes and targets count them; the empty table gives no rows."""
    rows = [(None, "ten words of one text that many rows do hold", "en", "a", 1)] * 600 + [(7, "the same id and the same text", "en", "b", 1)] * 300 + [(i, "w " * (i % 40 + 1), "en", "c", 1) for i in range(300)] + [(5000, None, None, None, None), (5001, "", "en", "a", 0)]
    docs_of(spark, rows).withColumn("key", F.lit("k")).withColumn("rate", F.lit(1)).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = o1.op1_mix_sources(spark, f"file://{tmp_path}").collect()
    assert len(got) == len(rows)
    size = {"a": 6000, "b": 2100, "c": sum(i % 40 + 1 for i in range(300)), None: 0}
    want = brute_targets(size, {"a": 1.0, "b": 2.0, "c": 3.0, None: 1.0})
    taken = defaultdict(int)
    for r in got:
        taken[r["source_size"]] += r["taken"]
        assert r["taken"] <= 3 * r["size"]
    for s in "abc":
        assert abs(taken[size[s]] - want[s]) <= 40
    docs_of(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert o1.op1_mix_sources(spark, f"file://{tmp_path}/none").count() == 0


# --- 2 -------------------------------------------------------------------------------------------


def brute_links(texts, words, threshold):
    sets = {i: o2.shingles(t, words) for i, t in texts.items()}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def brute_components(nodes, links):
    low = {n: n for n in nodes}
    while True:
        before = dict(low)
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
        if low == before:
            return low


def test_sketch_agreement_estimates_similarity():
    rnd = np.random.default_rng(0)
    pool = rnd.integers(0, 2**63, 4000).astype(np.uint64)
    for n, m, both in ((1000, 1000, 600), (30, 30, 20), (1, 1, 1), (1, 1, 0), (3, 2000, 3)):
        a, b = pool[:n], np.concatenate([pool[:both], pool[2000 : 2000 + m - both]])
        s = o2.sketches([np.sort(a), np.sort(b), np.empty(0, np.uint64)], 1000)
        assert (s[:2] != o2.EMPTY).all() and (s[2] == o2.EMPTY).all()
        assert abs((s[0] == s[1]).mean() - both / (n + m - both)) < 0.07


def test_overlaps_are_intersections():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 300, n).astype(np.uint64)) for n in (0, 1, 40, 200, 250, 5)]
    for width in (7, 4096):
        assert (o2.overlaps(sets, sets[::-1], width) == [[len(np.intersect1d(a, b)) for b in sets[::-1]] for a in sets]).all()
    assert (o2.overlaps(sets[:1], sets[:1]) == 0).all()


@pytest.mark.parametrize("small, block", [(32, 256), (1, 8)])
def test_near_duplicates_of_large_groups(spark, monkeypatch, small, block):
    """Chains of drifting copies, one group of copies and texts that share much but not enough; the second run compares all buckets in blocks."""
    monkeypatch.setattr(o2, "SMALL_BUCKET", small)
    monkeypatch.setattr(o2, "BLOCK_MEMBERS", block)
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, text = [], [rnd.choice(vocabulary) for _ in range(60)]
    for i in range(150):
        rows.append((i, " ".join(text)))
        text = list(text)
        text[rnd.randrange(60)] = rnd.choice(vocabulary)
    rows += [(1000 + i, "copy of one text") for i in range(50)]
    base = [rnd.choice(vocabulary) for _ in range(50)]
    for i in range(60):
        rows.append((2000 + i, " ".join(base[:40] + [rnd.choice(vocabulary) for _ in range(10)])))
    rnd.shuffle(rows)
    got = {r["doc_id"]: r for r in o2.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()}
    want = brute_components([i for i, _ in rows], brute_links(dict(rows), 2, 80))
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (i == want[i]) for i, r in got.items())


def test_near_duplicates_odd(spark, odd):
    got = o2.near_duplicates(spark, odd).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got}
    assert by[6]["component_id"] == 1 and not by[6]["kept"] and by[2]["component_id"] == 2 and by[3]["kept"] and by[4]["n_shingles"] == 0
    assert all(r["kept"] and r["component_id"] is None for r in got if r["doc_id"] is None)
    kept = o2.keep_one(spark, odd)
    assert kept.columns == odd.columns
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(map(str, [1, 2, 3, 4, 5, 7, 8, None, None]))
    assert o2.near_duplicates(spark, odd.where("false")).count() == 0
    assert o2.keep_one(spark, odd.where("false")).count() == 0


def test_keep_one_of_rows_that_share_an_id(spark):
    """Rows that share an id go only if another row of their own group stays."""
    rows = [(1, "a b c d e f", "x"), (1, "quite another text of seven words", "y"), (1, "a b c d e f", "z"), (2, "A B C D E F", "x"), (3, "quite another text of seven words", "x"), (4, "alone with its own words here", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _tl_h string")
    kept = o2.keep_one(spark, docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(1, "a b c d e f"), (1, "quite another text of seven words"), (4, "alone with its own words here")]


# --- 3, 4 ----------------------------------------------------------------------------------------


def test_memo_is_the_library():
    rnd = random.Random(2)
    alphabet = "abAB'sdtrelvm  \t\n\n_-.,!?0129éßÑİı’“²½¼ªºЖ漢字かカ가_^`|́ "
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(1500)] + ["a<|endoftext|>b", "", "don't we'll I'M 'tis"]
    words, counts = tokens.WordIds(o3.tokenizer_path("word_bpe_49k.json")), tokens.ByteCounts(o3.tokenizer_path("byte_bpe_50k.json"))
    assert list(words(texts)) == [words.whole([t])[0] for t in texts]
    assert list(counts(texts)) == [len(counts.whole([t])[0]) // 4 for t in texts]


def test_other_tokenizers_go_to_the_library(tmp_path):
    """A file whose normalizer or pre-tokenizer is another one is not cut here."""
    texts = ["Don't split ME like that, 123 times", "naïve  spaces\n", ""]
    changed = {}
    for name, part, value in (("byte_bpe_50k.json", "pre_tokenizer", {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}), ("byte_bpe_50k.json", "normalizer", {"type": "Lowercase"}), ("word_bpe_49k.json", "normalizer", None)):
        with open(o3.tokenizer_path(name), encoding="utf-8") as f:
            changed = json.load(f) | {part: value}
        path = tmp_path / "other.json"
        path.write_text(json.dumps(changed))
        for kind in (tokens.WordIds, tokens.ByteCounts):
            t = kind(str(path))
            assert not t.known
            whole = [np.asarray(e.ids, "<u4").tobytes() for e in t.tokenizer.encode_batch(texts, add_special_tokens=False)]
            assert list(t(texts)) == (whole if kind is tokens.WordIds else [len(w) // 4 for w in whole])
    assert tokens.WordIds(o3.tokenizer_path("word_bpe_49k.json")).known and not tokens.WordIds(o3.tokenizer_path("byte_bpe_50k.json")).known


def test_memo_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_BYTES", 200_000)
    t = tokens.WordIds(o3.tokenizer_path("word_bpe_49k.json"))
    for i in range(40):
        list(t(["漢字" * 2000 + str(i), "base64" * 1000 + "x" * i]))
        assert t.held < 400_000


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 1000])
def test_planes_round_trip(bits, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
    for x in (ids, ids % 1000):
        assert (o3.from_planes(o3.to_planes(x, bits), n) == x).all()


@pytest.mark.parametrize("block_ids, bits", [(8, False), (64, True), (o3.BLOCK_IDS, False)])
def test_token_files(spark, odd, block_ids, bits):
    """Documents that cross blocks, are longer than many, or have only the end id."""
    path = o3.tokenizer_path("word_bpe_49k.json")
    got = o3.read_documents(o3.write_tokens(spark, odd.where("doc_id is null or doc_id <> 5 or length(text) < 99"), path, block_ids=block_ids, bits=bits), with_ids=True).orderBy("start").collect()
    encode = tokens.WordIds(path)
    rows = sorted((r for r in ODD if r[0] != 5), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    assert len(got) == len(rows)
    for r, g in zip(rows, got, strict=True):
        ids = encode.whole([r[1] or ""])[0] + np.asarray([2], "<u4").tobytes()
        assert (g["doc_id"], g["start"], g["n_tokens"], g["ids_crc32"], bytes(g["ids"])) == (r[0], start, len(ids) // 4, zlib.crc32(ids), ids)
        start += len(ids) // 4
    blocks = o3.write_tokens(spark, odd, path, block_ids=max(block_ids, 64), bits=bits)
    every = b"".join(bytes(r["ids"]) for r in o3.read_documents(blocks, with_ids=True).orderBy("start").collect())
    assert len(every) > 4 * 30_000
    for first, count in ((0, 5), (3, 200), (70, 1), (len(every) // 4 - 3, 99), (10**9, 5)):
        got = o3.read_range(blocks, first, count).orderBy("start").collect()
        assert b"".join(bytes(r["ids"]) for r in got) == every[4 * first : 4 * (first + count)]
    assert o3.read_documents(o3.write_tokens(spark, odd.where("false"), path)).count() == 0


def test_token_query(spark, sf_dir, documents):
    encode, start = tokens.WordIds(o3.tokenizer_path("word_bpe_49k.json")), 0
    for r in sorted(o3.op3_token_files(spark, sf_dir).collect(), key=lambda r: r["doc_id"]):
        ids = encode.whole([documents[r["doc_id"]]["text"] or ""])[0] + np.asarray([2], "<u4").tobytes()
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4


def test_token_counts(spark, sf_dir, documents):
    count = tokens.ByteCounts(o3.tokenizer_path("byte_bpe_50k.json"))
    for r in o4.op4_token_counts(spark, sf_dir).collect():
        text = documents[r["doc_id"]]["text"] or ""
        n = len(count.whole([text])[0]) // 4
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 512)


def test_token_cache(spark, odd, tmp_path):
    """A second call encodes only what is new; odd inputs have counts."""
    path, cache = o3.tokenizer_path("byte_bpe_50k.json"), f"file://{tmp_path}/cache"
    first = o4.count_tokens(spark, odd.where("doc_id < 5"), path, cache).collect()
    n = o4.read_cache(spark, cache, path).count()
    assert {r["doc_id"]: r["n_tokens"] for r in first}[2] == 0 and n == 3
    again = o4.count_tokens(spark, odd, path, cache)
    assert again.count() == len(ODD)
    stored = o4.read_cache(spark, cache, path)
    assert stored.count() == stored.select("digest").distinct().count() == len({r[1] or "" for r in ODD})
    assert o4.count_tokens(spark, odd.where("false"), path, cache).count() == 0


# --- 5, 6, 7 -------------------------------------------------------------------------------------


def test_line_dedup_odd(spark, odd):
    line = "A shared line that is longer than forty characters, with É"
    rows = [(i, f"own {i}\n  {line.upper().replace('É', 'É')} \n{line}", "en", "a", 1) for i in range(10, 16)] + [(10, line, "en", "a", 1), (None, line, "en", "a", 1)]
    got = o5.drop_shared_lines(spark, odd.select("doc_id", "text").unionByName(docs_of(spark, rows).select("doc_id", "text"))).collect()
    by = {(r["doc_id"], r["n_lines"]): r for r in got}
    assert by[10, 3]["kept_text"] == "own 10" and by[10, 3]["n_dropped"] == 2 and by[15, 3]["n_dropped"] == 0
    assert by[10, 1]["kept_text"] == "" and by[10, 1]["n_dropped"] == 1
    assert by[2, 1]["kept_text"] == "" and by[3, 1]["n_dropped"] == 0
    assert all(not r["n_dropped"] for r in got if r["doc_id"] is None)
    assert o5.drop_shared_lines(spark, odd.where("false")).count() == 0


def test_license_scan(spark):
    rows = [
        (1, "r/LICENSE", "Released under the MIT License."), (2, "r/src/a.py", "code of no licence name\nlong prose about nothing at all"), (3, "r/src/deep/b.py", "import everything\nalpha = beta + gamma * delta\n\nLicensed under the Apache License, Version 2.0.\nfor each one of many values do something else with it"),
        (4, "r/src/deep/c.py", None), (5, None, "plain"), (6, "other/d.py", ""), (7, "r/sub/COPYING", "This work is licensed under the GNU General Public License, version 3."), (8, "r/sub/x/y.c", "int main"), (None, "r/z", "some ordinary words"),
        (9, "other/e.py", "the licence of this very long sentence names nothing that could be matched with any notice in the list"),
    ]
    got = {r["doc_id"]: (r["license"], r["basis"]) for r in o6.scan_licenses(spark, spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {1: ("MIT", "file"), 2: ("MIT", "inherited"), 3: ("Apache-2.0", "header"), 4: ("MIT", "inherited"), 5: (None, "none"), 6: (None, "none"), 7: ("GPL-3.0", "file"), 8: ("GPL-3.0", "inherited"), None: ("MIT", "inherited"), 9: (None, "none")}


def test_license_odd(spark):
    """A licence file at the root speaks for all below; nulls, ties, repeated rows, an empty table, long texts and further columns."""
    code = "first = second + third\nfor each in every: print(each)\n"
    rows = [
        (1, "LICENSE", (o6.TEXTS / "MIT.txt").read_text(), "x"), (2, "src/a.py", code, "x"), (2, "src/a.py", code, "x"), (3, "a.py", None, None), (4, "src/deep/er/b.py", "", "x"), (None, None, None, None),
        (5, "lib/COPYING", (o6.TEXTS / "Apache-2.0.txt").read_text(), "x"), (6, "lib/x/y.py", code * 20_000, "x"), (7, "two/c.py", "MIT License\nISC License\n" + code * 9, "x"), (None, "src/d.py", code, "x"),
    ]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string, folder string").withColumn("key", F.lit("k")).withColumn("b", F.lit(1))
    got = sorted((str(r["doc_id"]), str(r["path"]), str(r["license"]), r["basis"]) for r in o6.scan_licenses(spark, files).collect())
    assert got == sorted([
        ("1", "LICENSE", "MIT", "file"), ("2", "src/a.py", "MIT", "inherited"), ("2", "src/a.py", "MIT", "inherited"), ("3", "a.py", "MIT", "inherited"), ("4", "src/deep/er/b.py", "MIT", "inherited"), ("None", "None", "None", "none"),
        ("5", "lib/COPYING", "Apache-2.0", "file"), ("6", "lib/x/y.py", "Apache-2.0", "inherited"), ("7", "two/c.py", "ISC", "header"), ("None", "src/d.py", "MIT", "inherited"),
    ])
    assert o6.scan_licenses(spark, files.where("false")).count() == 0


def test_license_forms(spark):
    """SPDX lines, titles, notices over several lines and whole texts; and lines that name no known licence."""
    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n#\nimport os"
    text = lambda name: (o6.TEXTS / f"{name}.txt").read_text().replace("<year>", "2019").replace("<copyright holders>", "Some Body")
    code = "first = second + third\nfor each in every: print(each)\nreturn nothing\n"
    want = [
        ("// SPDX-License-Identifier: MIT\n" + code, "MIT"), ("SPDX-License-Identifier: Apache-2.0\n" + code, "Apache-2.0"), ("SPDX-License-Identifier: BSD-3-Clause\n" + code, "BSD-3-Clause"), ("SPDX-License-Identifier: GPL-2.0-or-later\n" + code, "GPL-2.0"),
        ("SPDX-License-Identifier: MIT-0\n" + code, None), ("SPDX-License-Identifier: Zlib\n" + code, None), ("MIT License\n" + code, "MIT"), ("The MIT License (MIT)\n" + code, "MIT"), ("GNU GENERAL PUBLIC LICENSE Version 2, June 1991\n" + code, "GPL-2.0"),
        ("ISC License\n" + code, "ISC"), ("Eclipse Public License - v 2.0\n" + code, "EPL-2.0"), ("GNU Affero General Public License, version 3\n" + code, "AGPL-3.0"), (gpl, "GPL-3.0"), ("Copyright 2020 Some Body. All rights reserved.\n" + code, None), ("The driver must hold a valid license for version 2.\n" + code, None),
        *((text(n), n) for n in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "Unlicense")),
    ]
    files = spark.createDataFrame([(i, f"d{i}/f.txt", t) for i, (t, _) in enumerate(want)], "doc_id long, path string, text string")
    got = {r["doc_id"]: (r["license"], r["basis"]) for r in o6.scan_licenses(spark, files).collect()}
    assert [got[i][0] for i in range(len(want))] == [w for _, w in want]
    assert all(got[i][1] == "file" for i in range(15, len(want)))


def test_license_query(spark, sf_dir, documents):
    phrase = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Released under the MIT License.": "MIT"}
    got = {r["doc_id"]: r for r in o6.op6_license_scan(spark, sf_dir).collect()}
    assert set(got) == set(documents)
    for i, d in documents.items():
        found = {v for k, v in phrase.items() if k in (d["text"] or "").split("\n")}
        assert (got[i]["license"] in found and got[i]["basis"] in ("header", "file")) if found else got[i]["basis"] in ("none", "inherited")


def brute_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_myers_is_edit_distance():
    rnd = random.Random(4)
    for _ in range(300):
        item, text = ("".join(rnd.choice("abc ") for _ in range(rnd.randint(1, n))) for n in (90, 120))
        assert o7.Pattern(item).least(text)[0] == brute_distance(item, text)


def test_matcher_is_brute_force():
    rnd = random.Random(6)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 6))) for _ in range(40)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(8, 25)))) for i in range(20)]
    match = o7.Matcher(items)
    for _ in range(120):
        _, item = rnd.choice(items)
        broken = list(item)
        for _ in range(rnd.randint(0, o7.budget(len(item)) + 2)):
            at = rnd.randrange(len(broken))
            broken[at : at + 1] = rnd.choice([[], [rnd.choice("abcz")], [broken[at], rnd.choice("abcz")]])
        text = o7.normal(" ".join(rnd.choice(words) for _ in range(30)) + " " + "".join(broken) + " " + " ".join(rnd.choice(words) for _ in range(30)))
        want = {i: d for i, x in items if (d := brute_distance(x, text)) <= o7.budget(len(x))}
        assert match(text) == want


def test_decontamination_odd(spark, odd, sf_dir):
    items = spark.createDataFrame([(1, "Too short"), (2, None), (3, "this item has more than eight words in it, you see"), (4, "This item has more than eight words in it you SEE!")], "item_id long, text string")
    docs = odd.unionByName(odd.limit(1).withColumn("doc_id", F.lit(50).cast("long")).withColumn("text", F.lit("before. This item has more then eight words\nin it, you see; after")))
    assert sorted((r["doc_id"], r["item_id"], r["distance"]) for r in o7.contaminated(spark, docs, items).collect()) == [(50, 3, 1), (50, 4, 1)]
    kept = o7.decontaminate(spark, docs, items)
    assert kept.columns == docs.columns and kept.count() == len(ODD)
    assert o7.decontaminate(spark, docs, items.where("false")).count() == len(ODD) + 1
    assert o7.contaminated(spark, docs.where("false"), items).count() == 0
    assert o7.contaminated(spark, docs, items.where("false")).count() == 0


def test_decontamination_in_blocks(spark, monkeypatch):
    """Many small blocks give what one gives, and no more than one broadcast is alive while the next one is made."""
    rnd = random.Random(12)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6))) for _ in range(60)]
    made = [(i, " ".join(rnd.choice(words) for _ in range(12))) for i in range(12)]
    items = spark.createDataFrame(made + [(100, made[3][1].upper()), (101, None)], "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(rnd.choice(words) for _ in range(9)) + " " + made[i % 12][1] + " " + made[i % 5][1]) for i in range(30)] + [(99, "clean")], "doc_id long, text string")
    alive, most = set(), []

    def broadcast(self, value, make=SparkContext.broadcast):
        b = make(self, value)
        alive.add(id(b))
        most.append(len(alive))
        return b

    def destroy(self, *args, drop=Broadcast.destroy):
        alive.discard(id(self))
        drop(self, *args)

    one = sorted(map(tuple, o7.contaminated(spark, docs, items).collect()))
    kept = sorted(r["doc_id"] for r in o7.decontaminate(spark, docs, items).collect())
    monkeypatch.setattr(SparkContext, "broadcast", broadcast)
    monkeypatch.setattr(Broadcast, "destroy", destroy)
    assert sorted(map(tuple, o7.contaminated(spark, docs, items, block_chars=120).collect())) == one and (3, 100, 0) in one
    assert len(most) > 3 and max(most) == 1
    alive.clear()
    assert sorted(r["doc_id"] for r in o7.decontaminate(spark, docs, items, block_chars=120).collect()) == kept == [99]
    assert max(most) == 1


def test_decontamination_short_items(spark):
    """Short items are found exactly, at word borders; long items of few words as any other."""
    long = "水的沸点随着海拔升高而降低请解释其中的原因并举出两个生活中的例子说明这一现象如何影响烹饪时间以及人们怎样应对"
    items = spark.createDataFrame([(1, "Who wrote Hamlet?"), (2, long), (3, "水的沸点是多少？"), (4, "art"), (5, "?!"), (6, None)], "item_id long, text string")
    texts = ["So: who wrote HAMLET, then", "who wrote hamlets", "start of the cart", "State of the art.", f"前面的话{long[:20]}很{long[21:]}后面的话", "请问水的沸点是多少呢", "水的沸点是多", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(map(tuple, o7.contaminated(spark, docs, items).collect())) == [(0, 1, 0), (3, 4, 0), (4, 2, 1), (5, 3, 0)]
    assert sorted(r["doc_id"] for r in o7.decontaminate(spark, docs, items).collect()) == [1, 2, 6, 7]


def test_decontamination_query(spark, sf_dir, documents):
    items = {r["item_id"]: o7.normal(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    exact = {(i, k) for i, d in documents.items() for k, x in items.items() if x.count(" ") >= 7 and x in o7.normal(d["text"])}
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in o7.op7_decontamination(spark, sf_dir).collect()}
    assert exact == {k for k, d in got.items() if d == 0} and exact
    for k in sorted(items)[::8]:  # every document against some items, without pieces and windows
        pattern, most = o7.Pattern(items[k]), o7.budget(len(items[k]))
        near = {i: d for i, doc in documents.items() if (d := pattern.least(o7.normal(doc["text"]))[0]) <= most}
        assert near == {i: d for (i, item), d in got.items() if item == k}


# --- 8 -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("shard_rows, wave_bytes", [(7, 200), (50, 1 << 20)])
def test_top_k_is_brute_force(spark, monkeypatch, shard_rows, wave_bytes):
    """Ties, repeated ids and rows, unusable and empty vectors, several lengths, columns with names that the operator uses inside; many waves or one."""
    monkeypatch.setattr(o8, "LEAST_SHARD_ROWS", shard_rows)
    rnd = random.Random(7)
    rows = [(i, [rnd.choice([-1.0, -0.5, 0.0, 0.25, 0.5]) for _ in range(6)]) for i in range(120)] + [(200 + i, [0.5] * 6) for i in range(30)]
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (None, [0.5] * 6), (350, [0.1, 0.2]), (7, rows[7][1]), (400, [0.5] * 6), (450, [])]
    rows += [(50, rows[3][1]), (50, rows[3][1]), (500, [0.3, 0.4])] + [(600 + i, [rnd.uniform(-1, 1) for _ in range(700)]) for i in range(0, 60, 25)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("mark", F.lit("x")).withColumn("shard", F.lit(1)).withColumn("dim", F.lit(2))
    usable = [(n, i, [int(np.floor(256 * float(np.float32(x)))) for x in e]) for n, (i, e) in enumerate(rows) if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    want = []
    for n, q, v in usable:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), c) for m, c, w in usable if m != n and len(w) == len(v))[:5]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(scores)]
    got = [tuple(r) for r in o8.top_k(spark, df, F.col("vec_id") % 50 == 0, shard_rows=shard_rows, wave_bytes=wave_bytes).select("query_id", "rank", "vec_id", "score").collect()]
    assert sorted(got) == sorted(want)


def test_top_k_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert o8.top_k(spark, df, F.col("vec_id") % 50 == 0).count() == 0


# --- 9, 10 ---------------------------------------------------------------------------------------


def test_quality_held_out(spark, sf_dir):
    got = o9.op9_quality_scores(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert np.mean([r["predicted"] == r["quality"] for r in held]) >= 0.95


def test_pairs_reach_the_least_loss():
    """The weights minimise the penalised logistic loss of feature differences; the threshold is the quantile at the share of label 0."""
    rng = np.random.default_rng(5)
    y = (rng.random(300) < 0.7).astype(int)
    x = rng.normal(size=(300, 6)) + y[:, None] * np.array([1.0, -0.5, 0, 0, 2.0, 0.1])
    m = o9.fit_pairs(x, y, n_pairs=4000, seed=3)
    z = np.clip((x - m.mean) / m.scale, -8, 8)
    draw = np.random.default_rng(3)
    d = z[draw.choice(np.flatnonzero(y == 1), 4000)] - z[draw.choice(np.flatnonzero(y == 0), 4000)]
    loss = lambda w: np.log1p(np.exp(-d @ w)).mean() + o9.PENALTY * w @ w
    steps = [m.weights + e for e in (*np.eye(6) * 1e-3, *np.eye(6) * -1e-3)]
    assert all(loss(m.weights) < loss(w) for w in steps)
    assert np.mean(m.strengths(x) < m.middle) == pytest.approx(np.mean(y == 0), abs=0.01)
    assert ((m.scores(x) >= o9.CUT) == (m.strengths(x) >= m.middle - 1e-9)).all()


def test_quality_query_is_the_model(spark, sf_dir, documents):
    """Scores are the model's of each whole text, whatever its place in the table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = o9.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    for r in o9.op9_quality_scores(spark, sf_dir).collect():
        assert r["score"] == pytest.approx(float(model.scores(np.array([o9.features(documents[r["doc_id"]]["text"])]))[0]))


def test_every_label_counts(spark):
    """Moments, pairs and threshold are those of all labelled rows, of more than one part, in whatever order they come."""
    rng = np.random.default_rng(1)
    n = 45_000
    y = (rng.random(n) < 0.8).astype(int)
    x = np.column_stack([rng.normal(size=n) + y, rng.normal(size=n) - 0.5 * y, np.full(n, 0.3)])
    rows = spark.createDataFrame([(i, v, k) for i, (v, k) in enumerate(zip(x.tolist(), y.tolist(), strict=True))], "doc_id long, x array<double>, y int")
    m = o9.learn(rows)
    assert m.mean == pytest.approx(x.mean(axis=0)) and m.scale == pytest.approx([*x.std(axis=0)[:2], 1.0])
    s = m.strengths(x)
    assert m.middle == pytest.approx(np.quantile(s, (y == 0).mean(), method="midpoint"), abs=1e-12) and m.spread == pytest.approx(s.std() / 2)
    again = o9.learn(rows.orderBy(F.desc("doc_id")))
    assert (again.weights == m.weights).all() and again.middle == m.middle
    values = spark.createDataFrame([(float(v),) for v in np.concatenate([s, np.full(12_000, 0.25)])], "s double")
    ranked = np.sort(np.concatenate([s, np.full(12_000, 0.25)]))
    assert [o9.kth(values, k) for k in (0, 20_000, len(ranked) - 1)] == [ranked[0], ranked[20_000], ranked[-1]]


@pytest.mark.parametrize("counts", [(1, 1), (3, 500), (900, 40), (0, 20), (20, 0)])
def test_pairs_of_a_part(counts):
    """Each row is in a pair, all pairs where they are few, and the mean stands for a label that is missing."""
    y = np.repeat([0, 1], counts)
    z = np.arange(len(y), dtype=float)[:, None] * np.where(y == 1, 1, -10_000)[:, None]
    d = o9.part_pairs(z, y, np.array([[-5e7], [5e3]]))
    if min(counts):
        assert {float(v) for v in d[:, 0]} == {float(a - b) for a in z[y == 1][:, 0] for b in z[y == 0][:, 0]}
    else:
        assert len(d) == sum(counts)


def test_labels_that_are_none(spark):
    """0.7 is no label, nor is 7; ids with several labels take the least."""
    docs = spark.createDataFrame([(i, "word " * (i + 1)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0.7 if i % 2 else 7.0) for i in range(40)], "doc_id long, quality double")
    assert o9.fit(docs, labels) is None


def test_quality_odd(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int")
    kept = o9.keep_good(spark, odd, none)
    assert kept.columns == odd.columns and kept.count() == len(ODD)
    some = spark.createDataFrame([(1, 1), (1, 1), (2, None), (5, 0), (6, 1), (8, 0), (None, 1), (3, 7)], "doc_id long, quality int")
    got = o9.score(odd, o9.fit(odd.select("doc_id", "text"), some), out="quality_score").collect()
    assert len(got) == len(ODD) and all(0 <= r["quality_score"] <= 1 for r in got)
    assert o9.score(odd.where("false"), None, out="quality_score").count() == 0


def brute_base(text):
    found = []
    for k, (kind, pattern, group, least) in enumerate(o10.BASE):
        flags = re.I | re.A if kind == "assign" else 0
        found += [(m.start(), k, m.end(), kind) for m in re.finditer(pattern, text, flags) if len(m[group]) >= least]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found)]


def test_base_spans():
    rnd = random.Random(8)
    parts = ["password", "secret: token: ", "API_KEY", "=", '"', " ", ":", "AKIA", "ABCDEFGH1234567890", "0123456789abcdef01234567", "abc", "x", "é", "ſecret=abcdefgh", "Token='a.b-c_d='", "\n"]
    for _ in range(2000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        assert [f"{k}:{a}:{b}" for k, a, b, _ in o10.base_spans(text)] == brute_base(text)


def test_automata_know_their_format():
    rnd = random.Random(9)
    make = lambda: "ghp" + "".join(rnd.choice("0123456789abcdef") for _ in range(20))
    a = o10.Automaton([make() for _ in range(200)])
    assert len(a.next) < 200
    assert np.mean([a.accepts(make()) for _ in range(200)]) > 0.8
    assert not any(map(a.accepts, ["thisisanordinarylongword", "0123456789012345", "ghp" + "z" * 20, "configuration_of_things"]))


def test_formats_held_out(sf_dir):
    """Unseen credentials of formats mixed within one kind are found (0.9 or more), what else stands in the documents is not."""
    import duckdb

    rnd = random.Random(3)
    any_of = lambda n, letters: "".join(rnd.choice(letters) for _ in range(n))
    low, digits, hexa = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
    formats = [
        lambda: "Q" + any_of(9, digits), lambda: "ghp_" + any_of(24, hexa), lambda: any_of(24, low.upper() + digits), lambda: "sk-" + any_of(20, low + low.upper() + digits),
        lambda: "-".join(any_of(n, hexa) for n in (8, 4, 4, 4, 12)), lambda: f"xoxb-{any_of(11, digits)}-{any_of(24, low + digits)}",
    ]
    texts = [t or "" for (t,) in duckdb.sql(f"SELECT text FROM '{sf_dir}/documents.parquet'").fetchall()]
    words = sorted({w for t in texts for w in o10._ORDINARY.findall(t)}, key=o10._hash)[: o10.SAMPLE]
    grammar = o10.grammar_of({"assign": [f() for f in formats for _ in range(40)]}, words)
    recall = [np.mean([grammar.accepts(f()) for _ in range(200)]) for f in formats]
    assert np.mean(recall) >= 0.95 and min(recall) >= 0.9
    others = {v for t in texts for *_, v in o10.candidate_spans(t, o10.base_spans(t))} | {"2023-11-05", "192.168.100.20", "index.html", "foo_bar_baz", "v1.2.3-rc1", "/usr/local/bin", "12345678", "ABCDEFGH", "some-hyphen-word"}
    assert len(others) > 1000 and not [v for v in others if grammar.accepts(v)]


def test_secret_query(spark, sf_dir, documents):
    for r in o10.op10_secret_scan(spark, sf_dir).collect():
        base = brute_base(documents[r["doc_id"]]["text"] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s and not s.startswith("grammar")] == base
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex")]


def test_added_spans_are_brute_force(spark):
    """All candidates of all texts under models that are fitted here, from the same values in one pass."""
    rnd = random.Random(14)
    make = lambda: "tk_" + "".join(rnd.choice("0123456789abcdefghijklmnopqrstuvwxyz") for _ in range(20))
    words = ["ordinary", "Sentences", "without", "anything", "particular", "2024-01-05", "www.example.org", "some_name", "v1.2.3"]
    texts = {i: " ".join([*rnd.choices(words, k=9), *([f"token={make()}"] if i % 2 else []), *([make()] if i % 5 == 0 else []), *([make()[:-1]] if i % 7 == 0 else [])]) for i in range(120)}
    found = {i: o10.base_spans(t) for i, t in texts.items()}
    values = {kind: sorted({v for spans in found.values() for k, *_, v in spans if k == kind}, key=lambda v: (o10._hash(v), v))[: o10.SAMPLE] for kind, *_ in o10.BASE}
    ordinary = sorted({w for t in texts.values() for w in o10._ORDINARY.findall(t)}, key=lambda v: (o10._hash(v), v))[: o10.SAMPLE]
    grammar = o10.grammar_of(values, ordinary)
    want = {i: [(a, b) for a, b, v in o10.candidate_spans(t, found[i]) if grammar.accepts(v)] for i, t in texts.items()}
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["added"]] for r in o10.find_secrets(spark, spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == want and sum(map(len, want.values())) >= 20 and not any(len(texts[i][a:b]) != 23 for i, spans in want.items() for a, b in spans)


def test_secrets_added(spark, odd):
    rnd = random.Random(10)
    make = lambda: "".join(rnd.choice("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(24))
    rows = [(i, f"token = {make()}", "en", "a", 1) for i in range(100, 160)] + [(200 + i, f"some words {make()} and more", "en", "a", 1) for i in range(20)]
    got = {r["doc_id"]: r for r in o10.find_secrets(spark, docs_of(spark, rows)).collect()}
    assert sum(len(got[200 + i]["added"]) for i in range(20)) >= 18
    assert all(not r["added"] and not r["base"] for r in o10.find_secrets(spark, odd).collect())
    assert o10.find_secrets(spark, odd.where("false")).count() == 0


def test_secrets_short_or_over_a_base_span(spark):
    """A learned format is found below 16 characters, and where a base span covers a part of the run only."""
    rnd = random.Random(11)
    digits = lambda n, of: "".join(rnd.choice(of) for _ in range(n))
    short, long = lambda: "Q" + digits(9, "0123456789"), lambda: "ghp_" + digits(24, "0123456789abcdef")
    rows = [(i, f"token = {short()}", "en", "a", 1) for i in range(100, 160)] + [(i, f"secret: {long()}", "en", "a", 1) for i in range(200, 260)]
    rows += [(300 + i, f"some {short()} words", "en", "a", 1) for i in range(20)] + [(400 + i, f"some {long()} words", "en", "a", 1) for i in range(20)]
    got = {r["doc_id"]: r for r in o10.find_secrets(spark, docs_of(spark, rows)).collect()}
    assert sum([(s["start"], s["end"]) for s in got[300 + i]["added"]] == [(5, 15)] for i in range(20)) >= 18
    assert sum([(s["start"], s["end"]) for s in got[400 + i]["added"]] == [(5, 33)] for i in range(20)) >= 18
    assert [s["kind"] for s in got[400]["base"]] == ["hex"]
    assert not any(got[i]["added"] for i in (*range(100, 160), *range(200, 260)))
