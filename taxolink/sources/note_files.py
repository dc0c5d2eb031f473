"""Note files with a commit (SNK-4): a writer of Spark's Python data source interface, and for very many files the same two phases, and the way back, as jobs of Spark.

Tasks write their files into a folder of the job below ``_drafts``, under the tasks' own names.  When all tasks have ended, the driver moves the files of those attempts that
count to their places; an aborted job, and an attempt that was repeated, leave nothing.  Use::

    spark.dataSource.register(NoteFiles)
    notes.select("path", "content").write.format("note-files").mode("append").save(root)

``root`` is a folder or URI of a file system that all executors share.  Mode ``overwrite`` also removes the files that were there and that this job has not written.

A data source ends on the driver, which moves all files itself.  ``write_files`` lets tasks move them instead, and ``read_files`` lets tasks list the folders and read the files; the
driver then handles one row per task and no paths.
"""

from __future__ import annotations

import json
import posixpath
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from taxolink.operators.graph import staged

DRAFTS = "_drafts"
#: Files moved at a time when a job ends.
MOVES = 32
#: Files of a task, about, and rows of a batch that it returns.
TASK_FILES, BATCH_FILES = 20_000, 256


def _open(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if ":/" in root else f"file://{posixpath.abspath(root)}")


@dataclass
class Written(WriterCommitMessage):
    """What an attempt of a task has written: the list of its paths is in a file of its own, so that messages stay small."""

    folder: str
    files: int


class NoteWriter(DataSourceWriter):
    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite, self.job = root, overwrite, uuid.uuid4().hex
        files, base = _open(root)
        # Attempts do not make this folder themselves, so one that is still running when the job has been aborted finds none and leaves nothing.
        files.create_dir(posixpath.join(base, DRAFTS, self.job), recursive=True)

    def write(self, iterator: Iterator[Row]) -> Written:
        files, base = _open(self.root)
        folder = posixpath.join(base, DRAFTS, self.job, uuid.uuid4().hex)
        files.create_dir(folder, recursive=False)
        paths = []
        for row in iterator:
            path = posixpath.normpath("/" + row["path"].lstrip("/"))[1:]
            if path != row["path"].strip("/") or not path or path.split("/")[0] == DRAFTS:
                raise ValueError(f"path leaves the folder: {row['path']}")
            with files.open_output_stream(posixpath.join(folder, str(len(paths)))) as f:
                f.write((row["content"] or "").encode())
            paths.append(path)
        with files.open_output_stream(posixpath.join(folder, "paths")) as f:
            f.write(json.dumps(paths).encode())
        return Written(folder, len(paths))

    def publish(self, folder: str) -> None:
        """Move the files of one task to their places; a repeated call goes on where the one before it ended."""
        from pyarrow import fs

        files, base = _open(self.root)
        with files.open_input_stream(posixpath.join(folder, "paths")) as f:
            paths = json.loads(f.read())
        for inside in sorted({posixpath.dirname(p) for p in paths}):
            files.create_dir(posixpath.join(base, inside), recursive=True)
        for i, p in enumerate(paths):
            draft, target = posixpath.join(folder, str(i)), posixpath.join(base, p)
            try:
                files.move(draft, target)
            except OSError:
                there = [x.type != fs.FileType.NotFound for x in files.get_file_info([draft, target])]
                if there != [False, True]:
                    raise

    def commit(self, messages: list[Written | None]) -> None:
        files, base = _open(self.root)
        done: set[str] = set()
        with ThreadPoolExecutor(MOVES) as pool:
            for m in messages:  # one task's list at a time
                if m is None:
                    continue
                with files.open_input_stream(posixpath.join(m.folder, "paths")) as f:
                    paths = json.loads(f.read())
                for folder in sorted({posixpath.dirname(p) for p in paths}):
                    files.create_dir(posixpath.join(base, folder), recursive=True)
                list(pool.map(lambda p: files.move(posixpath.join(m.folder, str(p[0])), posixpath.join(base, p[1])), enumerate(paths)))  # noqa: B023
                done |= set(paths) if self.overwrite else set()
        if self.overwrite:
            from pyarrow import fs

            for info in files.get_file_info(fs.FileSelector(base, recursive=True)):
                inside = posixpath.relpath(info.path, base)
                if info.type == fs.FileType.File and inside not in done and inside.split("/")[0] != DRAFTS:
                    files.delete_file(info.path)
        self._clear(files, base)

    def abort(self, messages: list[Written | None]) -> None:
        files, base = _open(self.root)
        self._clear(files, base)

    def _clear(self, files, base: str) -> None:
        from pyarrow import fs

        drafts = posixpath.join(base, DRAFTS)
        own = posixpath.join(drafts, self.job)
        for _ in range(10):  # an attempt that is ending may put a file into a folder that is being removed
            if files.get_file_info(own).type == fs.FileType.NotFound:
                break
            try:
                files.delete_dir(own)
            except OSError:
                time.sleep(0.1)
        if files.get_file_info(drafts).type != fs.FileType.NotFound and not files.get_file_info(fs.FileSelector(drafts)):
            files.delete_dir(drafts)


class NoteFiles(DataSource):
    """Rows ``path, content`` as files."""

    @classmethod
    def name(cls) -> str:
        return "note-files"

    def schema(self) -> str:
        return "path string, content string"

    def writer(self, schema: StructType, overwrite: bool) -> NoteWriter:
        if not {"path", "content"} <= set(schema.names):
            raise ValueError("note files need the columns path and content")
        return NoteWriter(self.options["path"], overwrite)


def tasks(files: int, at_least: int = 8) -> int:
    """Tasks that write or read so many files."""
    return max(at_least, -(-files // TASK_FILES))


def write_files(notes: DataFrame, root: str) -> int:
    """``notes(path, content)`` as files below ``root``, added to those that are there; returns how many.  Repeated paths are one file.

    Partitions of ``notes`` are the tasks of both phases: in the first they write drafts, in the second, which starts when all drafts are there, each list of drafts is moved.  If the
    first fails nothing is moved; drafts are removed in any case.
    """
    job = NoteWriter(root, False)

    def draft(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = job.write({"path": p, "content": c} for b in batches for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        yield pa.RecordBatch.from_pydict({"folder": [done.folder], "files": [done.files]})

    try:
        done = notes.select("path", "content").mapInArrow(draft, "folder string, files long").collect()  # a row for each task
        folders = [r["folder"] for r in done if r["files"]]
        if folders:
            notes.sparkSession.sparkContext.parallelize(folders, len(folders)).foreach(job.publish)
    finally:
        job.abort([])
    return sum(r["files"] for r in done)


def read_files(spark: SparkSession, root: str, suffix: str = "") -> DataFrame:
    """``path`` (below ``root``) ``, content`` (binary) of every file below ``root`` whose name ends in ``suffix``; names that begin with ``_`` or a dot are left out.

    Folders are listed by tasks, one level after the other, and files are read in tasks of about ``TASK_FILES``.
    """
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, base = _open(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = [x for x in files.get_file_info(fs.FileSelector(posixpath.join(base, folder))) if x.base_name[:1] not in "._"]
                inner = [x.type == fs.FileType.Directory for x in found]
                yield pa.RecordBatch.from_pydict({"path": pa.array([posixpath.join(folder, x.base_name) for x in found], pa.string()), "folder": pa.array(inner, pa.bool_())})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _open(root)

        def content(path: str) -> bytes:
            with files.open_input_stream(posixpath.join(base, path)) as f:
                return f.read()

        for batch in batches:
            paths = batch.column(0).to_pylist()
            for i in range(0, len(paths), BATCH_FILES):
                some = paths[i : i + BATCH_FILES]
                yield pa.RecordBatch.from_pydict({"path": pa.array(some, pa.string()), "content": pa.array(map(content, some), pa.binary())})

    folders, found, n = spark.createDataFrame([("",)], "path string"), [], 1
    while n:
        level = staged(spark, folders.repartition(min(n, spark.sparkContext.defaultParallelism * 8)).mapInArrow(listed, "path string, folder boolean"))
        found.append(level.where(~F.col("folder") & F.endswith("path", F.lit(suffix))).select("path"))
        folders = level.where("folder").select("path")
        n = folders.count()
    paths = found[0]
    for more in found[1:]:
        paths = paths.unionByName(more)
    return paths.repartition(tasks(paths.count())).mapInArrow(read, "path string, content binary")
