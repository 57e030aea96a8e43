"""Reading keyed streams until a sentinel: state a key, in event order.

Rows wait until the watermark has passed them, as an earlier one may still come; then they go out in order up to the first with the sentinel,
and the key is closed: what comes later is not even kept. State is a list of waiting rows and a flag a key, in RocksDB beside the checkpoint, so
a query that is started again goes on where it ended. Rows the watermark has passed before they came are late; they are
dropped and counted (:func:`late_rows`).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import BooleanType, StructField, StructType

from lodestone.store import scratch

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _millis(t: datetime) -> int:
    """Whole milliseconds since 1970, upwards. A time without a zone is one of this machine's, as Spark hands them over."""
    since = t.astimezone(UTC) - datetime(1970, 1, 1, tzinfo=UTC)
    return -(-(since.days * 86_400_000_000 + since.seconds * 1_000_000 + since.microseconds) // 1000)


class UntilSentinel(StatefulProcessor):
    """Rows of a key up to its first sentinel, that one left out."""

    def __init__(self, schema: StructType, time: str, order: str, value: str, sentinel: str):
        self.schema, self.time, self.order, self.value, self.sentinel = schema, time, order, value, sentinel

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.closed = handle.getValueState("closed", StructType([StructField("closed", BooleanType())]))
        self.waiting = handle.getListState("waiting", self.schema)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if not self.closed.exists():
            new = [tuple(r) for r in rows]
            if new:
                self.waiting.appendList(new)
                self._wake(new)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.closed.exists():
            return
        t, o, v = (self.schema.fieldNames().index(c) for c in (self.time, self.order, self.value))
        now, due, later = timerValues.getCurrentWatermarkInMs(), [], []
        for r in map(tuple, self.waiting.get()):
            (due if _millis(r[t]) <= now else later).append(r)
        for r in sorted(due, key=lambda r: (r[t], r[o])):
            if r[v] == self.sentinel:
                self.closed.update((True,))
                self.waiting.clear()
                return
            yield Row(**dict(zip(self.schema.fieldNames(), r, strict=True)))
        if later:
            self.waiting.put(later)
            self._wake(later)
        else:
            self.waiting.clear()

    def _wake(self, rows: list[tuple]) -> None:
        """One timer, for the earliest row: the watermark may pass others with it, the rest set the next."""
        at = self.schema.fieldNames().index(self.time)
        self.handle.registerTimer(min(_millis(r[at]) for r in rows))

    def close(self) -> None:
        pass


def until_sentinel(stream: DataFrame, key: str, time: str, order: str, value: str, sentinel: str, delay: str) -> DataFrame:
    """Of every key the rows before its first one with the sentinel, by ``time`` and ``order``; rows up to ``delay`` behind the latest are waited for.
    The columns are those of ``stream``. Rows without a time are dropped, a null key is a key. Needs RocksDB state (:func:`keyed_state`)."""
    timed = stream.filter(F.col(time).isNotNull()).withWatermark(time, delay)
    return timed.groupBy(key).transformWithState(UntilSentinel(stream.schema, time, order, value, sentinel), stream.schema, "Append", "EventTime")


@contextmanager
def keyed_state(spark: SparkSession):
    """Streams that start within keep their state in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark had passed them, over the batches that the query still knows of."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def replay_until_sentinel(events: DataFrame, tick: DataFrame, key: str, time: str, order: str, value: str, sentinel: str, delay: str) -> DataFrame:
    """What the stream ``events`` yields when it is read to its end and time then moves on past its last row.

    The query runs to the end of what is there, stops, and is started again from its checkpoint when ``tick``, one row of a later time,
    has been added; so every waiting row is passed.
    """
    spark, place = events.sparkSession, scratch(events.sparkSession, "sentinel")
    ticks, out = f"{place}/ticks", f"{place}/out"
    tick.limit(0).write.parquet(ticks)
    both = events.union(spark.readStream.schema(events.schema).parquet(ticks))
    rows = until_sentinel(both, key, time, order, value, sentinel, delay)
    with keyed_state(spark):
        for _ in range(2):
            query = rows.writeStream.option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start(out, format="parquet")
            query.awaitTermination()
            tick.write.mode("append").parquet(ticks)
    return spark.read.schema(events.schema).parquet(out)
