"""Incremental ingest by keyed state (STM-1): which keys are known is state in RocksDB, so a batch looks up its own keys and nothing else.

``jobs.ingest_new`` keeps the known keys as a table and reads the parts that a batch's keys fall into, which is all of them once a batch has some hundred keys.  Here what is
read grows with the batch, however many keys there are; the price is a call of Python for each key of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from taxolink.streaming.jobs import run_to_folder
from taxolink.streaming.timers import rocks_store


class KeepFirst(StatefulProcessor):
    """Of a key's rows in the first batch that has it the least one by ``order`` (nulls last); nothing of later ones."""

    def __init__(self, order: Sequence[str]):
        self.order = list(order)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "known boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if self.known.exists():
            for _ in rows:  # the rest of the group has to be taken
                pass
            return
        self.known.update((True,))
        yield min(rows, key=lambda r: [(r[c] is None, r[c] if r[c] is not None else 0) for c in self.order])

    def close(self) -> None:
        pass


def new_keys(stream: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The rows of keys that no earlier batch had, one for each; a null key is a key."""
    return stream.groupBy(key).transformWithState(KeepFirst(order), stream.schema, "Append", "None")


def ingest_by_state(stream: DataFrame, out: str, key: str, order: Sequence[str], checkpoint: str) -> StreamingQuery:
    """Append the rows of new keys below ``out``, a folder for each batch, which is overwritten if the batch is repeated; ``ingested_rows`` reads them."""
    with rocks_store(stream.sparkSession):
        return run_to_folder(new_keys(stream, key, order), out, checkpoint, "append")


def ingested_rows(spark: SparkSession, out: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).option("basePath", out).parquet(out).select(*schema.names)
