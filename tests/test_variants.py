"""Records of mixed shape, and files of several blocks."""

from pyspark.sql import functions as F

from taxolink.sources import readers as R
from taxolink.sources import variants as V


def test_conflicting_types_keep_their_values(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "v": 5}\n{"id": "x", "v": {"a": [1, null]}}\n\n{"id": null}\n{oops\n{"id": 2, "v": "5"}\n[1]\n{"v": true}\n')
    good, bad = V.read_records(spark, str(tmp_path))
    assert [r["text"] for r in bad.collect()] == ["{oops"]
    got = {(r["id"], r["v"], r["a"]) for r in V.fields(good, {"id": "id", "v": "v", "a": "v.a[0]"}).collect()}
    assert got == {("1", "5", None), ("x", '{"a":[1,null]}', "1"), (None, None, None), ("2", "5", None), (None, "true", None)} and good.count() == 6
    numbers = V.typed(good, {"v": ("v", "int")}).select("v", F.expr("to_json(record)").alias("j")).collect()
    assert {r["j"] for r in numbers if r["v"] is None} >= {'{"id":"x","v":{"a":[1,null]}}'} and (5 in {r["v"] for r in numbers})
    assert {r["shape"]: r["n"] for r in V.shapes(good, "v").collect()} == {"BIGINT": 1, "STRING": 1, "BOOLEAN": 1, "missing": 2, "OBJECT<a: ARRAY<BIGINT>>": 1}


def test_items_of_an_array(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"data":\n {"rows": [{"k": 1}, {"k": [2]}, 3]}}')
    (tmp_path / "c.json").write_text('{"data": {"rows": 7}}')
    good, bad = V.read_records(spark, str(tmp_path), "data.rows", whole_files=True)
    assert sorted(str(r["k"]) for r in V.fields(good, {"k": "k"}).collect()) == ["1", "None", "[2]"] and bad.count() == 0


def test_row_numbers_over_blocks(spark, tmp_path):
    """One file, read in many pieces."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    (tmp_path / "t.csv").write_text("id,pad\n" + "".join(f"{i},{'y' * (i % 90)}\n" for i in range(1, 30_001)))
    try:
        spark.conf.set(key, str(100_000))
        got = R.read_csv(spark, str(tmp_path / "t.csv"), multi_line=False, provenance=True)
        assert got.select("id").rdd.getNumPartitions() > 1 and spark.read.text(str(tmp_path / "t.csv")).rdd.getNumPartitions() > 5
        assert got.where("id <> source_row").count() == 0 and got.agg(F.countDistinct("source_row")).first()[0] == 30_000
    finally:
        spark.conf.set(key, before)
