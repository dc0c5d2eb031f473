"""Readers, writers and streams."""

import json

import pytest
from pyspark.sql import functions as F

from taxolink.sources import readers as R
from taxolink.sources import sinks as S
from taxolink.streaming import jobs as J


def read(spark, tmp_path, text, **options):
    path = tmp_path / "x.csv"
    path.write_text(text)
    return R.read_csv(spark, f"file://{path}", **options)


@pytest.mark.parametrize(
    "text, columns, rows",
    [
        ("Name,ID,Description\nAlice,1,Test\nBob,2,Another", ["Name", "ID", "Description"], [("Alice", "1", "Test"), ("Bob", "2", "Another")]),
        ("  Name  , ID ,Description\nAlice,1,Test", ["Name", "ID", "Description"], [("Alice", "1", "Test")]),
        ("Col1,Col2,Col3\n", ["Col1", "Col2", "Col3"], []),
        ('A,B\nAlice,"Has a, comma"', ["A", "B"], [("Alice", "Has a, comma")]),
        ("Name,ID\nAlice,1\n\nBob,2\n\n", ["Name", "ID"], [("Alice", "1"), ("Bob", "2")]),
        ('A,B\nx,"say ""hi""\nthere"', ["A", "B"], [("x", 'say "hi"\nthere')]),
    ],
)
def test_csv(spark, tmp_path, text, columns, rows):
    df = read(spark, tmp_path, text)
    assert df.columns == columns and [tuple(r) for r in df.collect()] == rows


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_delimiter(spark, tmp_path, sep):
    df = read(spark, tmp_path, f"a{sep}b\n1{sep}2\n", sep=None)
    assert df.columns == ["a", "b"]


def test_source_rows(spark, tmp_path):
    df = read(spark, tmp_path, "a\n" + "\n".join(f"v{i}" for i in range(50)), provenance=True, multi_line=False)
    assert [(r["a"], r["source_row"]) for r in df.orderBy("source_row").collect()] == [(f"v{i}", i + 1) for i in range(50)]


def test_source_rows_of_a_split_file(spark, tmp_path):
    """A file that is read in many blocks is numbered through; a second file begins anew."""
    for name, n in (("a", 3000), ("b", 1200)):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{name}.csv").write_text("v,w\n" + "\n".join(f"{name}{i},{'x' * 20}" for i in range(n)) + "\n")
    keys = {"spark.sql.files.maxPartitionBytes": "8192", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        df = R.read_csv(spark, f"file://{tmp_path}/in", provenance=True, multi_line=False)
        assert spark.read.text(f"file://{tmp_path}/in").rdd.getNumPartitions() > 5
        got = {(r["source_file"].rsplit("/", 1)[1][0], r["source_row"], r["v"]) for r in df.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {(name, i + 1, f"{name}{i}") for name, n in (("a", 3000), ("b", 1200)) for i in range(n)}


def test_export_of_names_that_are_equal_when_cut(spark, tmp_path):
    long = "the same thirty-one characters at the start"
    tables = {long + " 1": spark.range(3), long + " 2": spark.range(7), long.upper(): spark.range(2), "short": spark.range(1)}
    paths = S.export(tables, f"file://{tmp_path}/x")
    assert len(set(paths.values())) == 4 and all(len(p.rsplit("/", 1)[1]) <= S.NAME_LENGTH for p in paths.values())
    assert {name: spark.read.parquet(p).count() for name, p in paths.items()} == {name: df.count() for name, df in tables.items()}


def test_paths_with_signs(spark, tmp_path):
    notes = spark.createDataFrame([("a b/c+d #1%.md", "{}", "text")], "path string, frontmatter string, body string")
    S.write_files(notes, f"file://{tmp_path}/out")
    assert R.read_notes(spark, f"file://{tmp_path}/out").first()["path"].endswith("/a b/c+d #1%.md")
    with pytest.raises(Exception, match="leaves the folder"):
        S.write_files(notes.withColumn("path", F.lit("../x.md")), f"file://{tmp_path}/out")


def test_ingest_repeated_batch(spark, tmp_path):
    """A batch that ran before and left its folders behind is done again with the same result."""
    schema = "id long, n long"
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    for k, rows in enumerate(([(1, 1), (1, 0), (2, 0)], [(2, 5), (3, 1)], [(4, 0), (1, 9), (3, 0)])):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        for _ in range(2):  # a new checkpoint makes the first batch run over what is there
            J.ingest_new(J.file_stream(spark, source, spark.createDataFrame([], schema).schema), out, "id", ["n"], f"file://{tmp_path}/c{k if k < 2 else 1}", parts=3).awaitTermination()
        if k == 0:
            assert sorted(map(tuple, J.ingested(spark, out, spark.createDataFrame([], schema).schema).collect())) == [(1, 0), (2, 0)]
    got = sorted(map(tuple, J.ingested(spark, out, spark.createDataFrame([], schema).schema).collect()))
    assert [i for i, _ in got] == [1, 2, 3, 4]


def test_header_at_row(spark):
    df = spark.createDataFrame([(0, "title", None), (1, "Id", " Name "), (2, "1", "x")], "r long, _c0 string, _c1 string")
    got = R.promote_header(df, "r", 1)
    assert got.columns == ["Id", "Name", "r"] and [tuple(r) for r in got.collect()] == [("1", "x", 2)]


def test_json_and_routing(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"rows": [{"control_id": "1.1"}, {"control_id": 1.2}]}))
    got = R.read_any(spark, f"file://{tmp_path}/a.json", root="rows")
    assert [r["control_id"] for r in got.collect()] == ["1.1", "1.2"]
    (tmp_path / "b.csv").write_text("x\n1\n")
    assert set(R.read_sheets(spark, {"s1": f"file://{tmp_path}/b.csv"})) == {"s1"} and spark.table("s1").count() == 1
    with pytest.raises(ValueError):
        R.read_any(spark, "x.bin")


def test_note_files(spark, tmp_path):
    notes = spark.createDataFrame([("a/b.md", "{}", "text", "f"), ("c.md", '{"x":"1"}', "t", "f")], "path string, frontmatter string, body string, fw string")
    S.write_files(notes, str(tmp_path / "out"))
    got = {r["path"].rsplit("/out/")[-1]: r["text"] for r in R.read_notes(spark, f"file://{tmp_path}/out").collect()}
    assert got == {"a/b.md": "---\n{}\n---\n\ntext\n", "c.md": '---\n{"x":"1"}\n---\n\nt\n'}
    assert S.export({"a name that is far too long for a sheet": notes}, f"file://{tmp_path}/x").popitem()[1].endswith("/a_name_that_is_far_too_long_for")
