"""Operator 3, token ids as bit-plane shuffled binary blocks.

Documents are range-partitioned by id, encoded, ended with ``END_ID`` and packed into blocks of ``BLOCK_IDS``
ids.  A block's ids are transposed into byte planes (all low bytes, then all second bytes, ...) or
bit planes, each plane is compressed with zstandard, and planes that are all zero are stored empty.  A file is a Parquet table
whose rows are blocks; the columns beside the planes are the chunk index (first id of the block, number of
ids, and for every document piece its place), so a reader of a range of ids finds the blocks that hold it and decodes no others (``read_range``).

How it runs at scale: one range shuffle of the texts, then everything up to the written file is local to a
shard; a shard holds one block in memory.  Reading back is local to a block, except for documents that
cross a block's border (at most two per block), whose pieces meet again by document.  The
global start of a document is its start in the shard plus the shard's own start, from one row per shard.

The library encodes each distinct piece of text once per worker (see ``tokens``).

Null and empty texts have only the end id; a very long text runs over as many blocks as it needs.  Null ids sort first; rows that repeat an id stay rows
of their own, ordered by text.  An empty table makes an empty file; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taxolink.llm.common import broadcast_if_small, small_batches, staged, table
from taxolink.llm.tokens import WordIds, opened

#: Appended to every document.
END_ID = 2
#: Ids in a block; a multiple of 8.
BLOCK_IDS = 65_536
BLOCKS = (
    "shard int, block int, first_id long, n_ids int, planes array<binary>, "
    "docs array<struct<doc_id: long, doc: long, doc_start: long, doc_ids: long, offset: int, count: int>>"
)

_DOC = pa.struct([("doc_id", pa.int64()), ("doc", pa.int64()), ("doc_start", pa.int64()), ("doc_ids", pa.int64()), ("offset", pa.int32()), ("count", pa.int32())])
_BLOCK_SCHEMA = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int32()), ("planes", pa.list_(pa.binary())), ("docs", pa.list_(_DOC))])
_PIECE_SCHEMA = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("doc", pa.int64()), ("doc_start", pa.int64()), ("n_tokens", pa.int64()), ("crc", pa.int64()), ("part", pa.binary()), ("block_at", pa.int32())])


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def to_planes(ids: np.ndarray, bits: bool = False, level: int = 3) -> list[bytes]:
    """The zstandard-compressed planes of unsigned 32-bit ids: 4 byte planes or 32 bit planes, low first."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=level).compress
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    rows = np.ascontiguousarray(raw.T)
    if bits:
        rows = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1, bitorder="little")
    return [squeeze(r.tobytes()) if r.any() else b"" for r in rows]


def from_planes(planes: Iterable[bytes], n: int) -> np.ndarray:
    """The ids that ``to_planes`` was given."""
    import zstandard

    expand, planes = zstandard.ZstdDecompressor().decompress, list(planes)
    width = n if len(planes) == 4 else (n + 7) // 8
    rows = np.stack([np.frombuffer(expand(p), np.uint8) if len(p) else np.zeros(width, np.uint8) for p in planes]) if n else np.zeros((len(planes), 0), np.uint8)
    if len(planes) == 32:
        rows = np.packbits(np.unpackbits(rows, axis=1, bitorder="little", count=n).T, axis=1, bitorder="little").T
    return np.ascontiguousarray(rows.T).reshape(-1).view("<u4")


def encode_blocks(docs: DataFrame, tokenizer: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS, bits: bool = False) -> DataFrame:
    """``docs(doc_id, text)`` as block rows in ascending ``doc_id`` order; a shard is a range of ids."""
    end = np.asarray([end_id], "<u4").tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = opened(WordIds, tokenizer), TaskContext.get().partitionId()
        block, done, doc = 0, 0, 0
        held, pieces = bytearray(), []

        def flush() -> pa.RecordBatch:
            nonlocal block, done, pieces
            cut = bytes(held[: 4 * block_ids])
            del held[: 4 * block_ids]
            n = len(cut) // 4
            row = [[shard], [block], [done], [n], [to_planes(np.frombuffer(cut, "<u4"), bits)], [pieces]]
            block, done, pieces = block + 1, done + n, []
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, _BLOCK_SCHEMA, strict=True)], schema=_BLOCK_SCHEMA)

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist()), strict=True):
                ids += end
                total, start, at = len(ids) // 4, done + len(held) // 4, 0
                while at < total:
                    count = min(total - at, block_ids - len(held) // 4)
                    pieces.append({"doc_id": doc_id, "doc": doc, "doc_start": start, "doc_ids": total, "offset": len(held) // 4, "count": count})
                    held += ids[4 * at : 4 * (at + count)]
                    at += count
                    if len(held) == 4 * block_ids:
                        yield flush()
                doc += 1
        if held:
            yield flush()

    # Without a partition count, adaptive execution may join small neighbouring ranges; their order stays.
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ranged.mapInArrow(pack, BLOCKS)


def shard_starts(blocks: DataFrame) -> DataFrame:
    """``shard, shard_start``: the ids before each shard.  The window runs over one row per shard."""
    shards = blocks.groupBy("shard").agg(F.sum(F.col("n_ids").cast("long")).alias("_n"))
    return shards.select(F.col("shard"), F.coalesce(F.sum("_n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shard_start"))


def read_range(blocks: DataFrame, first: int, count: int) -> DataFrame:
    """``start, ids``: the ids from place ``first`` on, ``count`` of them at most, in pieces of one block each (little-endian unsigned 32-bit).

    The index alone is read to find the blocks, whose numbers then go to the scan as filters on its columns.
    """
    begin = F.col("shard_start") + F.col("first_id")
    index = blocks.select("shard", "block", "first_id", "n_ids").join(broadcast_if_small(shard_starts(blocks)), "shard").select("shard", "block", begin.alias("begin"), "n_ids")
    needed = index.where((F.col("begin") < first + count) & (F.col("begin") + F.col("n_ids") > first)).collect()  # as many as the range has blocks
    places = {(r["shard"], r["block"]): r["begin"] for r in needed}
    shards, numbers = sorted({s for s, _ in places}), sorted({b for _, b in places})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, block, n, planes in zip(*(batch.column(c).to_pylist() for c in ("shard", "block", "n_ids", "planes")), strict=True):
                if (at := places.get((shard, block))) is not None:
                    a, b = max(0, first - at), min(n, first + count - at)
                    yield pa.RecordBatch.from_arrays([pa.array([at + a], pa.int64()), pa.array([from_planes(planes, n)[a:b].tobytes()], pa.binary())], ["start", "ids"])

    near = blocks.where(F.col("shard").isin(shards) & F.col("block").isin(numbers)) if places else blocks.where("false")
    return near.select("shard", "block", "n_ids", "planes").mapInArrow(run, "start long, ids binary")


def read_documents(blocks: DataFrame, with_ids: bool = False) -> DataFrame:
    """Documents of a written block table: ``doc_id, start, n_tokens, ids_crc32`` and, if asked for, ``ids`` (binary).

    The checksum runs over the decoded ids, so it proves the round trip.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw, rows = from_planes(row["planes"], row["n_ids"]).tobytes(), []
                for d in row["docs"]:
                    part = raw[4 * d["offset"] : 4 * (d["offset"] + d["count"])]
                    inside = d["count"] == d["doc_ids"]
                    rows.append((row["shard"], d["doc_id"], d["doc"], d["doc_start"], d["doc_ids"], zlib.crc32(part) if inside else None, part if with_ids or not inside else None, row["block"]))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECE_SCHEMA, strict=True)], schema=_PIECE_SCHEMA)

    pieces = blocks.select("shard", "block", "n_ids", "planes", "docs").mapInArrow(
        unpack, "shard int, doc_id long, doc long, doc_start long, n_tokens long, crc long, part binary, block_at int"
    )
    starts = shard_starts(blocks)
    whole = pieces.where("crc is not null").select("shard", "doc_id", "doc_start", "n_tokens", "crc", "part")
    # Only documents that cross a block's border are grouped: their pieces in order, one document per group.
    joined = F.expr("aggregate(array_sort(collect_list(struct(block_at, part))), cast('' as binary), (a, x) -> concat(a, x.part))")
    crossing = pieces.where("crc is null").groupBy("shard", "doc", "doc_id", "doc_start", "n_tokens").agg(joined.alias("part")).select("shard", "doc_id", "doc_start", "n_tokens", F.crc32("part").alias("crc"), "part")
    got = whole.unionByName(crossing).join(broadcast_if_small(starts), "shard")
    cols = ["doc_id", (F.col("doc_start") + F.col("shard_start")).alias("start"), "n_tokens", F.col("crc").alias("ids_crc32")]
    return got.select(*cols, *([F.col("part").alias("ids")] if with_ids else []))


def write_tokens(spark: SparkSession, docs: DataFrame, tokenizer: str, path: str | None = None, **options) -> DataFrame:
    """Encode ``docs`` into the block format at ``path`` (None: the shared folder) and return the written table."""
    small_batches(spark)
    blocks = encode_blocks(docs, tokenizer, **options)
    if path is None:
        return staged(spark, blocks, "tokens")
    blocks.write.mode("overwrite").parquet(path)
    return spark.read.schema(blocks.schema).parquet(path)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_documents(write_tokens(spark, docs, tokenizer_path("word_bpe_49k.json")))
