"""Hierarchies as intervals (GRF-1, GRF-2): a node's number in pre-order and that of the last node below it.

Sorted by path, a node stands right before everything below it.  So one range sort gives every node a place, its subtree is the range from its own place to its last one,
and what a subtree adds up to is a difference of running sums: one row per node, whatever the depth, where a closure has one per node and ancestor.

A subtree ends where a path shares less with the one before it than the node's depth.  Each partition gives its number of rows, its sum, and the places at which a new least
share is reached (at most as many as the depth); the driver goes over these from the last partition to the first, and every partition then closes its open subtrees with what comes after it.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from taxolink.operators.ordered import beside, cut


def intervals(nodes: DataFrame, node: str = "node_id", path: str = "path", amount: str | None = None, parts: int | None = None) -> DataFrame:
    """``node, depth, pre, last`` and, with ``amount``, ``total``: the sum of that column over the node and all below it (null counts as 0).

    ``path`` is the array of ids from the root to the node itself; no two nodes have the same.  A node whose ancestors have no row of their own is under those that do.
    """
    whole = amount is None or nodes.schema[amount].dataType.typeName() not in ("double", "float", "decimal")
    kind, zero = (pa.int64(), 0) if whole else (pa.float64(), 0.0)
    value = F.lit(0) if amount is None else F.coalesce(F.col(amount), F.lit(0))
    ranged = beside(cut(nodes.select(F.col(node), F.col(path).alias("_path"), value.cast("long" if whole else "double").alias("_amount")), "_path", parts=parts), ["_path"])
    before = F.coalesce(F.col("prev._path"), F.array().cast(nodes.schema[path].dataType))
    differs = F.array_position(F.zip_with("_path", before, lambda a, b: a.eqNullSafe(b)), False)
    ranged = ranged.select(F.col(node), F.size("_path").alias("_depth"), F.when(differs > 0, differs - 1).otherwise(F.size("_path")).cast("int").alias("_common"), "_amount", "_p")

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, total, least, marks = None, 0, zero, 1 << 31, []
        for b in batches:
            for common, a in zip(b.column("_common").to_pylist(), b.column("_amount").to_pylist(), strict=True):
                if common < least:
                    least = common
                    marks.append((common, n, total))
                n, total = n + 1, total + a
            if b.num_rows:
                part = b.column("_p")[0].as_py()
        if part is not None:
            columns = list(zip(*marks, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([total], kind), pa.array([columns[0]], pa.list_(pa.int32())), pa.array([columns[1]], pa.list_(pa.int64())), pa.array([columns[2]], pa.list_(kind))], ["_p", "n", "total", "depths", "places", "sums"])

    money = "long" if whole else "double"
    found = sorted(ranged.mapInArrow(summary, f"_p int, n long, total {money}, commons array<int>, places array<long>, sums array<{money}>").toArrow().to_pylist(), key=lambda r: r["_p"])
    begins, place, total = {}, 0, zero
    for r in found:
        begins[r["_p"]] = place, total
        place, total = place + r["n"], total + r["total"]
    end = place, total
    behind: dict[int, list[tuple[int, int, float]]] = {}
    after: list[tuple[int, int, float]] = []  # (share, place, sum before it) of each new least share behind a partition
    for r in reversed(found):
        behind[r["_p"]] = after
        at, before = begins[r["_p"]]
        own = [(d, at + i, before + s) for d, i, s in zip(r["commons"], r["places"], r["sums"], strict=True)]
        after = own + [m for m in after if m[0] < own[-1][0]]
    shared = ranged.sparkSession.sparkContext.broadcast((begins, behind, end))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, depths, commons, starts, part = [], [], [], [], None
        for b in batches:
            if b.num_rows:
                part = b.column("_p")[0].as_py()
                ids.append(b.column(0))
                depths += b.column("_depth").to_pylist()
                commons += b.column("_common").to_pylist()
                starts += b.column("_amount").to_pylist()
        if part is None:
            return
        begins_, behind_, end_ = shared.value
        place, running = begins_[part]
        last, totals, stack = [0] * len(depths), [zero] * len(depths), []

        def close(i: int, at: int, sum_: float) -> None:
            last[i], totals[i] = at - 1, sum_ - starts[i]

        for i, common in enumerate(commons):
            while stack and depths[stack[-1]] > common:
                close(stack.pop(), place + i, running)
            stack.append(i)
            starts[i], running = running, running + starts[i]
        rest = behind_[part]
        least = [-m[0] for m in rest]  # ascending, as shares fall
        for i in stack:
            k = bisect_right(least, -depths[i])  # the first share below the depth
            close(i, *(rest[k][1:] if k < len(rest) else end_))
        table = pa.table([pa.chunked_array(ids), pa.array(depths, pa.int32()), pa.array(range(place, place + len(depths)), pa.int64()), pa.array(last, pa.int64()), pa.array(totals, kind)], [node, "depth", "pre", "last", "total"])
        yield from table.to_batches(max_chunksize=10_000)

    fields = [StructField("pre", LongType()), StructField("last", LongType()), StructField("total", LongType() if whole else DoubleType())]
    schema = StructType([nodes.schema[node], StructField("depth", ranged.schema["_depth"].dataType), *fields])
    got = ranged.mapInArrow(label, schema)
    return got if amount is not None else got.drop("total")


def below(labels: DataFrame, ids: DataFrame, node: str = "node_id") -> DataFrame:
    """``root, node``: for each of ``ids(id)``, a list small enough to broadcast, the nodes of its subtree, itself included."""
    roots = labels.join(F.broadcast(ids.select(F.col("id").alias(node)).distinct()), node).select(F.col(node).alias("root"), F.col("pre").alias("_a"), F.col("last").alias("_b"))
    return labels.join(F.broadcast(roots), F.col("pre").between(F.col("_a"), F.col("_b"))).select("root", node)
