"""Freshness of evidence that moves with time (STM-3): event-time timers per key.

Evidence turns stale and expires without a further record: when the watermark passes the day from which it is stale, and the day after its expiry, a timer tells so.
State is one row per key and at most two timers; it lives in RocksDB, so keys need not fit in memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType, TimestampType

from taxolink.operators.evidence import STALE_DAYS
from taxolink.streaming.jobs import run_to_folder

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_DAY_MS = 86_400_000
_EPOCH = date(1970, 1, 1)


@contextmanager
def rocks_store(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB; the session's own setting comes back after it."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)


def _day_ms(day: date) -> int:
    return (day - _EPOCH).days * _DAY_MS


def _moment(us: int) -> datetime:
    return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=us)


def status(collected: date | None, expires: date | None, today: date, window: int) -> str:
    """As ``evidence.freshness``."""
    if collected is None or expires is None:
        return "not-set"
    return "expired" if expires < today else "stale" if expires - timedelta(window) <= today else "fresh"


class FreshnessTimers(StatefulProcessor):
    """One row whenever a key's freshness changes: by a newer record, or by time."""

    def __init__(self, key: str, window: int):
        self.key, self.window = key, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "us long, collected date, expires date, told string")

    def _told(self, key, us: int, collected: date | None, expires: date | None, day: date, at: int, before: str | None) -> Iterator[Row]:
        now = status(collected, expires, day, self.window)
        self.newest.update((us, collected, expires, now))
        if now != before:
            yield Row(**{self.key: key[0], "freshness": now, "changed": _moment(at)})

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        low = lambda d: d or date.min
        us, collected, expires = max(((r["_us"], r["_collected"], r["_expires"]) for r in rows), key=lambda r: (r[0], low(r[1]), low(r[2])))
        known = self.newest.get() if self.newest.exists() else None
        if known is not None and (known[0], low(known[1]), low(known[2])) >= (us, low(collected), low(expires)):
            return
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if collected is not None and expires is not None:
            for at in {_day_ms(expires - timedelta(self.window)), _day_ms(expires + timedelta(1))}:
                if 1000 * at > us:
                    self.handle.registerTimer(at)
        yield from self._told(key, us, collected, expires, _moment(us).date(), us, known[3] if known is not None else None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = 1000 * expiredTimerInfo.getExpiryTimeInMs()
        us, collected, expires, told = self.newest.get()
        yield from self._told(key, us, collected, expires, _moment(at).date(), at, told)

    def close(self) -> None:
        pass


def freshness_timeline(stream: DataFrame, key: str, collected: str, expires: str, time: str, late: str = "1 day", window: int = STALE_DAYS) -> DataFrame:
    """``key, freshness, changed``: a row for every change of a key's freshness, by a record or as the watermark passes; days are UTC days.

    Of a key's records the one with the latest ``time`` counts (then the later dates); one that is older than what is known changes nothing.  Rows without a time are left out.
    """
    kept = stream.where(F.col(time).isNotNull()).select(F.col(key), F.unix_micros(F.col(time).cast("timestamp")).alias("_us"), F.col(collected).alias("_collected"), F.col(expires).alias("_expires"), F.col(time).cast("timestamp").alias("_time"))
    out = StructType([stream.schema[key], StructField("freshness", StringType()), StructField("changed", TimestampType())])
    return kept.withWatermark("_time", late).groupBy(key).transformWithState(FreshnessTimers(key, window), out, "Update", "EventTime")


def run_timeline(timeline: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """The changes, written by batch below ``out``."""
    with rocks_store(timeline.sparkSession):
        return run_to_folder(timeline, out, checkpoint)
