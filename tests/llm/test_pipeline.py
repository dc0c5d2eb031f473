"""The pipeline against the decisions of its operators, stage by stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from taxolink.llm import op2_near_duplicates as o2
from taxolink.llm import op7_decontamination as o7
from taxolink.llm import op9_quality as o9
from taxolink.llm.common import staged


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for name, stage in P.STAGES:
        docs.append(staged(spark, stage(spark, docs[-1], sf_dir), name))
    return docs


def ids(df):
    return [r["doc_id"] for r in df.select("doc_id").collect()]


def test_columns(stages):
    assert all(d.columns == stages[0].columns for d in stages[:-1])


def test_quality_rejects(spark, sf_dir, stages):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    want = {r["doc_id"] for r in o9.score(stages[0], o9.fit(stages[0].select("doc_id", "text"), labels)).where(f"score >= {o9.CUT}").collect()}
    assert set(ids(stages[1])) == want
    assert 0 < len(want) < stages[0].count()


def test_one_of_each_group(stages):
    texts = {r["doc_id"]: o2.shingles(r["text"], 5) for r in stages[1].collect()}
    kept = set(ids(stages[2]))
    linked = lambda a, b: bool(a & b) and 100 * len(a & b) >= 80 * len(a | b)
    parent = {i: i for i in texts}
    for _ in range(9):
        for i in sorted(texts):
            for j in texts:
                if linked(texts[i], texts[j]):
                    parent[i] = parent[j] = min(parent[i], parent[j])
    assert kept == {i for i in texts if parent[i] == i}


def test_no_benchmark_left(spark, sf_dir, stages):
    items = [(r["item_id"], o7.normal(r["text"])) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    match = o7.Matcher(items)
    assert set(ids(stages[3])) == {r["doc_id"] for r in stages[2].collect() if not match(r["text"])}


def test_copies_and_tokens(stages):
    from collections import Counter

    copies = Counter(ids(stages[4]))
    assert set(copies) <= set(ids(stages[3])) and max(copies.values()) <= 3
    assert Counter(ids(stages[5])) == copies
    rows = stages[5].orderBy("start").collect()
    assert [r["start"] for r in rows] == [sum(x["n_tokens"] for x in rows[:i]) for i in range(len(rows))]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, columns with names that operators use inside."""
    rows = [
        (1, "Same text of five words here.\nLine", "en", "a", 1), (1, "Same text of five words here.\nLine", "en", "a", 1), (1, "Another text under the same id as two rows above", "en", "a", 1), (2, None, None, None, None), (3, "", "en", "a", 0),
        (None, "no id at all", "en", "b", 1), (None, None, None, None, None), (4, " \t\n ", "en", None, 1), (5, "word " * 30_000, "en", "b", 1), (6, "Same TEXT of five words here.\nLine", "en", "c", 1), (7, "<|endoftext|> é ½ 漢字 ́x", "zh", "c", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumn("score", F.lit(0.1)).withColumn("_tl_h", F.lit("h")).withColumn("_tl_draw", F.lit(2)).withColumn("number", F.lit(1))


@pytest.mark.parametrize("name", [name for name, _ in P.STAGES])
def test_stages_on_odd_and_empty_tables(spark, sf_dir, odd, name):
    stage = dict(P.STAGES)[name]
    got = stage(spark, odd, sf_dir)
    rows, before = got.collect(), odd.collect()
    empty = stage(spark, odd.where("false"), sf_dir)
    assert empty.count() == 0 and empty.columns == got.columns
    if name == "token_files":
        assert len(rows) == len(before) and sorted(r["n_tokens"] for r in rows)[:4] == [1, 1, 1, 1]
        return
    assert got.columns == odd.columns and set(map(str, rows)) <= set(map(str, before))
    if name == "near_duplicates":
        assert sorted((str(r["doc_id"]), (r["text"] or "")[:7]) for r in rows) == sorted([("1", "Same te"), ("1", "Another"), ("2", ""), ("3", ""), ("None", "no id a"), ("None", ""), ("4", " \t\n "), ("5", "word wo"), ("7", "<|endof")])
    if name == "decontamination":
        assert len(rows) == len(before)
