"""Ordered operators: fills, carries, neighbours, header pairs and order-safe deduplication (2.6, 2.7, 2.8).

Spark rows have no order, so each operator takes order columns, of any type that sorts.  A window without a key would put a
whole table into one task.  Here rows are cut into range partitions of about equal size (keys first, then order) and sorted, which is the
only shuffle; each partition gives one row about its ends; the driver goes over these, one for each partition, and every partition then
runs over its rows once with what reaches it from before or behind.  Neither a hot key nor gaps in the order make a partition larger.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from taxolink.operators.graph import shared_folder


def cut(df: DataFrame, order: str | Sequence[str], keys: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """``df`` in range partitions of about equal rows, sorted, with each row's partition in ``_p``; written to the checkpoint folder, so that every pass sees the same cut."""
    shared_folder(df.sparkSession)
    by = [F.col(f"`{c}`") for c in (*keys, *([order] if isinstance(order, str) else order))]
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_p", F.spark_partition_id()).checkpoint()


def _same(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Whether two columns are equal, null being equal to null."""
    both = pc.and_(pc.is_null(a), pc.is_null(b))
    return pc.or_(pc.fill_null(pc.equal(a, b), False), both).to_numpy(zero_copy_only=False)


def _starts(keys: list[pa.Array], before: list | None) -> np.ndarray:
    """Whether each row begins another group than the row before it; ``before`` has the keys of the row before the first, None if there is none."""
    n = len(keys[0]) if keys else 0
    new = np.zeros(n, bool)
    for i, k in enumerate(keys):
        if n:
            new[1:] |= ~_same(k[1:], k[:-1])
            new[0] |= before is None or not _same(k[:1], before[i])[0]
    return new


def _one(column: pa.ChunkedArray) -> pa.Array:
    """A column as one array."""
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def _ends(ranged: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> list[pa.RecordBatch]:
    """One row for each partition that has rows: ``_p``, its first and last keys, and for each column the last value within its last group.

    ``_one`` says that the partition has one group only.
    """
    kinds = [ranged.schema[c] for c in columns]
    fields = [StructField("_p", IntegerType()), StructField("_one", IntegerType())]
    fields += [StructField(f"_{w}{i}", ranged.schema[k].dataType) for w in "fl" for i, k in enumerate(keys)] + [StructField(f"_v{i}", k.dataType) for i, k in enumerate(kinds)]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = part = values = None
        single = True
        for b in batches:
            if not b.num_rows:
                continue
            ks = [b.column(k) for k in keys]
            new = _starts(ks, last)
            if first is None:
                first, part, values = [k[:1] for k in ks], b.column("_p")[:1], [b.column(c)[:0] for c in columns]
                new[:1] = False
            if new.any():
                single, since = False, int(np.flatnonzero(new)[-1])
                values = [v[:0] for v in values]
            else:
                since = 0
            for i, c in enumerate(columns):
                found = np.flatnonzero(b.column(c)[since:].is_valid().to_numpy(zero_copy_only=False))
                if len(found):
                    values[i] = b.column(c).slice(since + int(found[-1]), 1)
            last = [k[-1:] for k in ks]
        if first is not None:
            filled = [v if len(v) else pa.nulls(1, v.type) for v in values]
            yield pa.RecordBatch.from_arrays([part, pa.array([int(single)], pa.int32()), *first, *last, *filled], names)

    rows = ranged.select("_p", *(F.col(f"`{c}`") for c in dict.fromkeys((*keys, *columns)))).mapInArrow(run, StructType(fields)).toArrow()
    return sorted((rows.slice(i, 1) for i in range(rows.num_rows)), key=lambda r: r.column("_p")[0].as_py())


def fill_down(ranged: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """A cut table with each of ``columns`` filled with the last value before within equal ``keys``; it stays cut."""
    arriving: dict[int, tuple[list, list]] = {}
    state: tuple[list, list] | None = None
    for r in _ends(ranged, columns, keys):
        column = lambda name: _one(r.column(name)).take([0])  # noqa: B023, E731  a copy, not a view of all rows
        p, first, last, values = column("_p")[0].as_py(), [column(f"_f{i}") for i in range(len(keys))], [column(f"_l{i}") for i in range(len(keys))], [column(f"_v{i}") for i in range(len(columns))]
        goes_on = state is not None and all(_same(a, b)[0] for a, b in zip(first, state[0], strict=True))
        if goes_on:
            arriving[p] = state
            if column("_one")[0].as_py():
                values = [v if v[0].is_valid else w for v, w in zip(values, state[1], strict=True)]
        state = last, values
    shared = ranged.sparkSession.sparkContext.broadcast(arriving)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = carry = None
        for b in batches:
            if not b.num_rows:
                continue
            if carry is None:
                before, values = shared.value.get(b.column("_p")[0].as_py(), (None, [pa.nulls(1)] * len(columns)))
                carry = [v.cast(b.column(c).type) for v, c in zip(values, columns, strict=True)]
            at = np.arange(b.num_rows)
            new = _starts([b.column(k) for k in keys], before) if keys else np.zeros(b.num_rows, bool)
            out = {}
            for i, c in enumerate(columns):
                column = b.column(c)
                valid = column.is_valid().to_numpy(zero_copy_only=False)
                last = np.maximum.accumulate(np.where(valid | new, at, -1))  # -1: what arrived
                index = np.where(last < 0, 0, last + 1)
                missing = (last >= 0) & ~valid[last]
                out[c] = pa.concat_arrays([carry[i], column]).take(pa.array(index, mask=missing))
                carry[i] = out[c][-1:]
            before = [b.column(k)[-1:] for k in keys]
            yield pa.RecordBatch.from_arrays([out.get(n, b.column(n)) for n in b.schema.names], b.schema.names)

    return ranged.mapInArrow(run, ranged.schema)


def forward_fill(df: DataFrame, col: str, order: str | Sequence[str], keys: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """``col`` with nulls replaced by the last value before them, within equal ``keys`` (null keys are a group of their own)."""
    return fill_down(cut(df, order, keys, parts), [col], keys).drop("_p")


def hierarchical_fill(df: DataFrame, cols: Sequence[str], order: str | Sequence[str], parts: int | None = None) -> DataFrame:
    """Blanks become null, the first column is filled down, each further one within groups of the filled columns before it."""
    for c in cols:
        df = df.withColumn(c, F.nullif(F.col(f"`{c}`"), F.lit("")))
    for i, c in enumerate(cols):
        df = forward_fill(df, c, order, cols[:i], parts)
    return df


def conditional_carry(df: DataFrame, value: str, when_blank: str, out: str, order: str | Sequence[str], parts: int | None = None) -> DataFrame:
    """``out``: the value of the last row whose ``when_blank`` is blank, carried down."""
    marked = df.withColumn(out, F.when(F.coalesce(F.trim(F.col(f"`{when_blank}`")), F.lit("")) == "", F.col(f"`{value}`")))
    return forward_fill(marked, out, order, (), parts)


def beside(ranged: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A cut table with ``prev`` and ``next``: structs of ``cols`` of the row before and after, null at the ends; it stays cut."""
    row = F.struct(*(F.col(f"`{c}`") for c in cols))
    marked = ranged.withColumn("prev", row).withColumn("next", F.col("prev"))
    kind = marked.schema["prev"].dataType
    ends = StructType([StructField("_p", IntegerType()), StructField("first", kind), StructField("last", kind)])

    def tips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for b in batches:
            if b.num_rows:
                first = first or (b.column("_p")[:1], b.column("prev")[:1])
                last = b.column("prev")[-1:]
        if first:
            yield pa.RecordBatch.from_arrays([*first, last], ["_p", "first", "last"])

    rows = marked.select("_p", "prev").mapInArrow(tips, ends).toArrow()
    known = sorted((rows.column("_p")[i].as_py(), i) for i in range(rows.num_rows))
    firsts, lasts = _one(rows.column("first")), _one(rows.column("last"))
    around = {p: (lasts.take([known[k - 1][1]]) if k else None, firsts.take([known[k + 1][1]]) if k + 1 < len(known) else None) for k, (p, _) in enumerate(known)}
    shared = ranged.sparkSession.sparkContext.broadcast(around)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = before = None

        def done(b: pa.RecordBatch, before: pa.Array | None, behind: pa.Array | None) -> pa.RecordBatch:
            own = b.column("prev")
            one = lambda x: (pa.nulls(1) if x is None else x).cast(own.type)
            columns = {"prev": pa.concat_arrays([one(before), own[:-1]]), "next": pa.concat_arrays([own[1:], one(behind)])}
            return pa.RecordBatch.from_arrays([columns.get(n, b.column(n)) for n in b.schema.names], b.schema.names)

        for b in batches:
            if not b.num_rows:
                continue
            if held is None:
                before = shared.value[b.column("_p")[0].as_py()][0]
            else:
                yield done(held, before, b.column("prev")[:1])
                before = held.column("prev")[-1:]
            held = b
        if held is not None:
            yield done(held, before, shared.value[held.column("_p")[0].as_py()][1])

    # Both may be null now, which a struct of columns never is.
    return marked.mapInArrow(run, StructType([StructField(f.name, f.dataType) if f.name in ("prev", "next") else f for f in marked.schema]))


def neighbours(df: DataFrame, cols: Sequence[str], order: str | Sequence[str], parts: int | None = None) -> DataFrame:
    """``df`` with ``prev`` and ``next``: structs of ``cols`` of the row before and after, null at the ends."""
    return beside(cut(df, order, (), parts), cols).drop("_p")


def header_pairs(df: DataFrame, control: str, title: str, order: str | Sequence[str], parts: int | None = None) -> DataFrame:
    """Two-row headers: a row with a control before one without gives ``head_title`` and ``head_text`` to the rows that follow.

    Both header rows go.  The last row never begins a pair.
    """
    has = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    n = beside(cut(df, order, (), parts), (control, title))
    begins = has(F.col(control)) & F.col("next").isNotNull() & ~has(F.col("next")[control])
    ends = F.col("prev").isNotNull() & has(F.col("prev")[control]) & ~has(F.col(control))
    marked = n.withColumn("_h", F.when(begins, F.struct(F.col(control).alias("c"), F.col(title).alias("t"), F.col("next")[title].alias("d")))).withColumn("_end", ends)
    filled = fill_down(marked.drop("prev", "next").withColumn("_begin", F.col("_h").isNotNull()), ["_h"])
    return filled.where("not _begin and not _end").select(*(f"`{c}`" for c in df.columns), F.col("_h.c").alias("head_control"), F.col("_h.t").alias("head_title"), F.col("_h.d").alias("head_text"))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], last: bool = False) -> DataFrame:
    """The first (or last) row of each key.  A grouped minimum, so a hot key is reduced before it is shuffled; ``order`` must be total."""
    pick = F.max_by if last else F.min_by
    row = pick(F.struct(*(F.col(f"`{c}`") for c in df.columns)), F.struct(*order))
    return df.groupBy(*(F.col(f"`{k}`") for k in keys)).agg(row.alias("_row")).select("_row.*")


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    return keep_first(df, keys, order, last=True)


def samples(df: DataFrame, keys: Sequence[str], value: str, order: str, n: int = 5) -> DataFrame:
    """The first ``n`` values of each key in order, as ``samples``.

    Only ``n`` rows per key and map task are shuffled: ranks are taken inside pieces of a key first, then over what is left.
    """
    w = lambda *by: Window.partitionBy(*by).orderBy(order, value)
    part = df.select(*keys, value, order).withColumn("_p", F.spark_partition_id())
    near = part.withColumn("_k", F.row_number().over(w(*keys, "_p"))).where(F.col("_k") <= n)
    best = near.withColumn("_k", F.row_number().over(w(*keys))).where(F.col("_k") <= n)
    return best.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", F.col(value).alias("v")))), lambda x: x["v"]).alias("samples"))


def head(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)
