"""A note table that is merged into (SNK-2, SNK-7, SNK-8): hash parts, and a manifest that says where each part is.

Below the table's folder every merge writes the parts it touches into a folder of its own and then a new manifest, whose name is the next number.  Readers take the
highest number.  So a merge rewrites touched parts only, and one that fails or is killed at any point leaves the table as it was; of two at the same
time one gets the number and the other fails.  Folders that no manifest names any more are removed by ``vacuum``.

The folder may be in any file system that Spark reaches: manifests go through Hadoop's API, data through Spark.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from taxolink.operators.notes import write_plan

#: Hash parts of a new table.
PARTS = 64
_PART = "_part"


class _Folder:
    """The table's folder through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.files = self.path().getFileSystem(self.conf)

    def path(self, *names: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join((self.root, *names)))

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return sorted(s.getPath().getName() for s in self.files.listStatus(at)) if self.files.exists(at) else []

    def read(self, *names: str) -> str:
        stream = self.files.open(self.path(*names))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def publish(self, text: str, *names: str) -> None:
        """A whole file under a name that must be free."""
        draft, target = self.path(*names[:-1], f".{uuid.uuid4().hex}"), self.path(*names)
        out = self.files.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        options = self.jvm.org.apache.hadoop.fs.Options.Rename
        array = self.jvm.java.lang.reflect.Array.newInstance(options.NONE.getDeclaringClass(), 1)
        self.jvm.java.lang.reflect.Array.set(array, 0, options.NONE)
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.conf).rename(draft, target, array)


def _manifest(folder: _Folder) -> tuple[int, dict | None]:
    """The newest manifest and its number; ``(0, None)`` for a table that does not exist yet."""
    known = [n for n in folder.names("manifest") if n.endswith(".json") and not n.startswith(".")]
    return (int(known[-1][:-5]), json.loads(folder.read("manifest", known[-1]))) if known else (0, None)


def _rows(spark: SparkSession, root: str, manifest: dict, parts: list[int] | None = None) -> DataFrame:
    schema = StructType.fromJson(manifest["schema"])
    wanted = {p: f for p, f in manifest["parts"].items() if parts is None or int(p) in parts}
    by_folder: dict[str, list[str]] = {}
    for part, name in wanted.items():
        by_folder.setdefault(name, []).append(f"{root}/data/{name}/{_PART}={part}")
    # One scan: the folders are the table's parts, at most as many as it has.
    paths = [p for ps in by_folder.values() for p in ps]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_table(spark: SparkSession, root: str) -> DataFrame:
    """The table as its newest manifest has it."""
    _, manifest = _manifest(_Folder(spark, root))
    if manifest is None:
        raise ValueError(f"no note table at {root}")
    return _rows(spark, root.rstrip("/"), manifest)


def merge(spark: SparkSession, new: DataFrame, root: str, mode: str = "skip", key: str = "path", parts: int = PARTS) -> DataFrame:
    """Write ``new`` into the table at ``root`` and return ``key, status`` of its rows; modes as in ``notes.write_plan``.

    Only the parts that the new keys fall into are read and written.  Rows with a null key are an error.  ``parts`` counts for a new table only.  Columns that one side lacks
    are null there.  In mode ``merge`` the table holds ``key`` and ``props``.
    """
    root, folder = root.rstrip("/"), _Folder(spark, root)
    number, manifest = _manifest(folder)
    manifest = manifest or {"parts": {}, "of": parts, "schema": None}
    part = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(manifest["of"])).cast("int")
    touched = [r["p"] for r in new.select(F.when(F.col(key).isNotNull(), part).alias("p")).distinct().collect()]  # at most as many as there are parts, and null
    if None in touched:
        raise ValueError(f"rows without {key}")
    old = _rows(spark, root, manifest, touched) if manifest["schema"] else new.where("false")
    if mode == "merge":
        new, old = (df.select(key, "props", *(["source_row"] if "source_row" in df.columns else [])) for df in (new, old))
    notes, results = write_plan(new, old, mode, key)
    name = f"{number + 1:08d}-{uuid.uuid4().hex}"
    # Results are what the plan says about the table before; they are written too, as the table changes under a plan that is run later.
    results.write.parquet(f"{root}/results/{name}")
    notes.withColumn(_PART, part).repartition(F.col(_PART)).write.partitionBy(_PART).parquet(f"{root}/data/{name}")
    written = {n.partition("=")[2] for n in folder.names(f"data/{name}") if n.startswith(f"{_PART}=")}
    held = {p: f for p, f in manifest["parts"].items() if int(p) not in touched} | dict.fromkeys(sorted(written, key=int), name)
    schema = _widened(manifest["schema"] and StructType.fromJson(manifest["schema"]), notes.schema)
    folder.publish(json.dumps({"of": manifest["of"], "parts": held, "schema": schema.jsonValue(), "results": name}), "manifest", f"{number + 1:08d}.json")
    return spark.read.schema(results.schema).parquet(f"{root}/results/{name}")


def _widened(old: StructType | None, new: StructType) -> StructType:
    """All columns of both, nullable: parts that were not touched may lack the new ones."""
    fields = {f.name: f for f in (*(old or []), *new)}
    out = StructType()
    for f in fields.values():
        out.add(f.name, f.dataType, True)
    return out


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Remove the data and results that the last ``keep`` manifests do not name, and older manifests; returns how many folders went.

    For a time when no merge runs: one that has written its parts but no manifest yet would lose them.
    """
    folder = _Folder(spark, root.rstrip("/"))
    known = [n for n in folder.names("manifest") if n.endswith(".json") and not n.startswith(".")]
    used, gone = set(), 0
    for n in known[-keep:]:
        m = json.loads(folder.read("manifest", n))
        used |= {*m["parts"].values(), m["results"]}
    for n in known[:-keep]:
        folder.files.delete(folder.path("manifest", n), False)
    for kind in ("data", "results"):
        for n in folder.names(kind):
            if n not in used:
                folder.files.delete(folder.path(kind, n), True)
                gone += 1
    return gone
