"""Writers: note tables, note files, sets of tables (2.2)."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

#: The longest name that a table of an export keeps.
NAME_LENGTH = 31


def write_notes(notes: DataFrame, path: str, mode: str = "overwrite", by: str = "fw") -> None:
    """The note table, one folder per framework; ``overwrite`` is a full refresh."""
    notes.write.mode(mode).partitionBy(by).parquet(path)


def note_text(notes: DataFrame) -> DataFrame:
    """``path, content``: frontmatter (JSON is YAML) between rules, then the body."""
    return notes.select("path", F.concat(F.lit("---\n"), F.col("frontmatter"), F.lit("\n---\n\n"), F.col("body"), F.lit("\n")).alias("content"))


def write_files(notes: DataFrame, root: str) -> None:
    """One file per note below ``root``, a folder or URI of a file system that all executors share.

    A file is written under a name of its own and then moved in place, so a repeated task leaves whole files only.
    """

    def write(rows: Iterable[Row]) -> None:
        import posixpath
        import uuid

        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(root if "://" in root else f"file://{posixpath.abspath(root)}")
        for r in rows:
            target = posixpath.normpath(posixpath.join(base, r["path"].lstrip("/")))
            if not target.startswith(posixpath.normpath(base) + "/"):
                raise ValueError(f"path leaves the folder: {r['path']}")
            files.create_dir(posixpath.dirname(target), recursive=True)
            draft = f"{target}.{uuid.uuid4().hex}"
            with files.open_output_stream(draft) as f:
                f.write(r["content"].encode("utf-8"))
            files.move(draft, target)

    note_text(notes).foreachPartition(write)


def short_names(names: Iterable[str]) -> dict[str, str]:
    """Each name in at most ``NAME_LENGTH`` file-safe characters; names that would be the same (whatever their case) end in a number."""
    out: dict[str, str] = {}
    for name in names:
        safe = re.sub(r"[^\w.-]+", "_", name)
        short, n, taken = safe[:NAME_LENGTH], 1, {s.lower() for s in out.values()}
        while short.lower() in taken:
            n += 1
            short = f"{safe[: NAME_LENGTH - len(str(n)) - 1]}~{n}"
        out[name] = short
    return out


def export(tables: Mapping[str, DataFrame], root: str, kind: str = "parquet") -> dict[str, str]:
    """Every table below ``root`` under its (cut) name; returns name -> path."""
    out = {name: f"{root}/{short}" for name, short in short_names(tables).items()}
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        (writer.option("header", True) if kind == "csv" else writer).format(kind).save(out[name])
    return out
