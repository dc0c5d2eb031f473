"""Merges into a note table, and note files in two phases: what fails or is killed leaves things as they were."""

import os
import signal
import subprocess
import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from taxolink.sources import note_files as NF
from taxolink.sources import note_store as S
from taxolink.sources.note_files import DRAFTS, NoteFiles

ROOT = str(Path(__file__).resolve().parent.parent)


def frame(spark, rows):
    return spark.createDataFrame(rows, "path string, body string, source_row long")


def held(spark, root):
    return {(r["path"], r["body"]) for r in S.read_table(spark, root).collect()}


def test_modes_touch_their_parts_only(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    with pytest.raises(ValueError, match="no note table"):
        S.read_table(spark, root)
    first = S.merge(spark, frame(spark, [(f"p{i}", "old", i) for i in range(200)]), root, parts=16)
    assert first.where("status = 'created'").count() == 200
    before = S._manifest(S._Folder(spark, root))[1]["parts"]
    assert len(before) == 16
    got = S.merge(spark, frame(spark, [("p1", "new", 1), ("x", "a", 1), ("x", "b", 2)]), root, "replace")
    assert {tuple(r) for r in got.collect()} == {("p1", "replaced"), ("x", "created")}
    after = S._manifest(S._Folder(spark, root))[1]["parts"]
    assert 1 <= sum(before[p] != after[p] for p in before) <= 2
    assert held(spark, root) == {(f"p{i}", "new" if i == 1 else "old") for i in range(200)} | {("x", "b")}
    assert {r["status"] for r in S.merge(spark, frame(spark, [("p1", "z", 1)]), root, "skip").collect()} == {"skipped"}
    assert {r["status"] for r in S.merge(spark, frame(spark, [("p1", "z", 1)]), root, "error").collect()} == {"error"}
    more = frame(spark, [("y", "c", 1)]).withColumn("extra", F.lit(7))
    S.merge(spark, more, root)
    assert S.read_table(spark, root).where("extra = 7").count() == 1 and S.read_table(spark, root).count() == 202
    full = held(spark, root)
    assert S.vacuum(spark, root) > 0 and held(spark, root) == full
    S.merge(spark, frame(spark, []), root)
    assert held(spark, root) == full
    with pytest.raises(ValueError, match="rows without"):
        S.merge(spark, frame(spark, [(None, "a", 1)]), root)


def test_failed_merge_and_two_at_once(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/t"
    S.merge(spark, frame(spark, [("a", "1", 1)]), root)
    bad = frame(spark, [("a", "2", 1), ("b", "2", 1)]).withColumn("body", F.when(F.col("path") == "b", F.raise_error("stop").cast("string")).otherwise(F.col("body")))
    with pytest.raises(Exception, match="stop"):
        S.merge(spark, bad, root, "replace")
    assert held(spark, root) == {("a", "1")}
    one = S._manifest(S._Folder(spark, root))
    monkeypatch.setattr(S, "_manifest", lambda folder: one)  # both have read the same manifest
    S.merge(spark, frame(spark, [("c", "1", 1)]), root)
    with pytest.raises(Exception, match="(?i)exist"):
        S.merge(spark, frame(spark, [("d", "1", 1)]), root)
    monkeypatch.undo()
    assert held(spark, root) == {("a", "1"), ("c", "1")}


def test_killed_merge(spark, tmp_path):
    """A process that is killed while its parts are being written leaves the table as it was."""
    root = f"file://{tmp_path}/t"
    S.merge(spark, frame(spark, [("a", "1", 1)]), root)
    code = f"""
from pyspark.sql import SparkSession, functions as F
from taxolink.sources import note_store as S
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
new = spark.createDataFrame([("a", "2", 1), ("b", "2", 1)], "path string, body string, source_row long")
def slow(batches):
    import time
    open({str(tmp_path / "writing")!r}, "w").close()
    for b in batches:
        time.sleep(60)
        yield b
S.write_plan = lambda new, old, mode, key, plan=S.write_plan: (lambda n, r: (n.mapInArrow(slow, n.schema), r))(*plan(new, old, mode, key))
S.merge(spark, new, {root!r}, "replace")
"""
    job = subprocess.Popen([sys.executable, "-c", code], env={**os.environ, "PYTHONPATH": ROOT}, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, start_new_session=True)
    try:
        for _ in range(600):
            if (tmp_path / "writing").exists() or job.poll() is not None:
                break
            time.sleep(0.2)
        assert job.poll() is None
    finally:
        os.killpg(job.pid, signal.SIGKILL)
        job.wait()
    assert held(spark, root) == {("a", "1")}
    S.merge(spark, frame(spark, [("b", "3", 1)]), root)
    assert held(spark, root) == {("a", "1"), ("b", "3")}


def tree(root):
    return {str(p.relative_to(root)): p.read_text() for p in Path(root).rglob("*") if p.is_file()}


def test_note_files(spark, tmp_path):
    spark.dataSource.register(NoteFiles)
    root = tmp_path / "notes"
    rows = lambda *r: spark.createDataFrame(r, "path string, content string").repartition(3)
    write = lambda df, mode: df.write.format("note-files").mode(mode).save(str(root))
    write(rows(("a/1.md", "x"), ("a/2.md", None), ("b.md", "é")), "append")
    assert tree(root) == {"a/1.md": "x", "a/2.md": "", "b.md": "é"}
    write(rows(("a/1.md", "y"), ("c/d/e.md", "z")), "append")
    assert tree(root) == {"a/1.md": "y", "a/2.md": "", "b.md": "é", "c/d/e.md": "z"}
    before = tree(root)
    bad = rows(*((f"n{i}.md", "n") for i in range(50)), ("bad.md", "q")).withColumn("content", F.when(F.col("path") == "bad.md", F.raise_error("stop").cast("string")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="stop"):
        write(bad, "append")
    assert tree(root) == before and not (root / DRAFTS).exists()
    for path in ("../x.md", "a/../../x.md", f"{DRAFTS}/x"):
        with pytest.raises(Exception, match="leaves the folder"):
            write(rows((path, "x")), "append")
    assert tree(root) == before
    write(rows(("only.md", "1")), "overwrite")
    assert tree(root) == {"only.md": "1"}


def test_note_files_by_tasks(spark, tmp_path):
    """The driver moves and lists no files: folders of several levels, repeated moves, failures, and names that readers leave out."""
    root = f"file://{tmp_path}/notes"
    rows = lambda *r: spark.createDataFrame(r, "path string, content string").repartition(3)
    back = lambda **how: {r["path"]: r["content"].decode() for r in NF.read_files(spark, root, **how).collect()}
    assert NF.write_files(rows(("a/1#+ %.md", "x"), ("a/b/2.md", None), ("c.txt", "é"), ("a/_d.md", "q"), (".e/f.md", "q")), root) == 5
    assert back() == {"a/1#+ %.md": "x", "a/b/2.md": "", "c.txt": "é"} and set(back(suffix=".md")) == {"a/1#+ %.md", "a/b/2.md"}
    assert NF.write_files(rows(("c.txt", "new"), ("a/3.md", "y")), root) == 2 and NF.write_files(rows().limit(0), root) == 0
    before = tree(tmp_path / "notes")
    assert back() == {"a/1#+ %.md": "x", "a/b/2.md": "", "c.txt": "new", "a/3.md": "y"} and not (tmp_path / "notes" / DRAFTS).exists()
    bad = rows(*((f"n{i}.md", "n") for i in range(50)), ("bad.md", "q")).withColumn("content", F.when(F.col("path") == "bad.md", F.raise_error("stop").cast("string")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="stop"):
        NF.write_files(bad, root)
    assert tree(tmp_path / "notes") == before and not (tmp_path / "notes" / DRAFTS).exists()
    job = NF.NoteWriter(root, False)
    done = job.write(iter([{"path": "r/1.md", "content": "1"}, {"path": "r/2.md", "content": "2"}]))
    (tmp_path / "notes" / "r").mkdir()
    (tmp_path / "notes" / DRAFTS / job.job / done.folder.rsplit("/", 1)[1] / "0").rename(tmp_path / "notes" / "r" / "1.md")  # an attempt that ended here
    job.publish(done.folder)
    assert {p: back()[p] for p in ("r/1.md", "r/2.md")} == {"r/1.md": "1", "r/2.md": "2"}
