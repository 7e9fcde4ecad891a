"""Items of a queue as a keyed stream: each item's last status, failures and retry timer, in Spark's state store."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lexarena.sources.tables import TableStore, once
from lexarena.streaming.metrics import read_stream, run_available

STATE = "item string, kind string, status string, attempts long, delay double, updated timestamp, tie long"
NEVER_LATE = "36500 days"
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
FILE_ROWS = 500_000  # events of a file that replay_in_parts lets arrive
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ItemStates(StatefulProcessor):
    """One row of kind 'state' for each item of a batch, and one of kind 'retry' when a failed item's wait is over.

    The last event of an item is the one with the greatest (time, tie), whenever it arrives; failures are
    counted over all its events. A failed item with at most `most` failures gets a timer, `base` seconds for
    each failure and `limit` at most; any later event of the item takes it back. Waits count from the
    event in event time, from the batch in processing time.
    """

    def __init__(self, failed: str = "failed", most: int = 3, base: float = 2.0, limit: float = 10.0, event_time: bool = False):
        self.failed, self.most, self.base, self.limit, self.event_time = failed, most, base, limit, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.item = handle.getValueState("item", "status string, attempts long, micros long, tie long")

    def _row(self, key: tuple, kind: str, status: str, attempts: int, micros: int, tie: int) -> Row:
        return Row(item=key[0], kind=kind, status=status, attempts=attempts, delay=min(attempts * self.base, self.limit), updated=EPOCH + timedelta(microseconds=micros), tie=tie)

    def _waits(self, status: str | None, attempts: int) -> bool:
        """Whether an item in that state has been given a timer."""
        return status == self.failed and attempts <= self.most

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # each call of the state or the timers goes to the JVM and back: an item without a timer has none listed
        status, attempts, micros, tie = self.item.get() or (None, 0, None, None)
        waited = self._waits(status, attempts)
        for row in rows:
            attempts += row.status == self.failed
            if micros is None or (row.micros, row.tie) > (micros, tie):
                status, micros, tie = row.status, row.micros, row.tie
        self.item.update((status, attempts, micros, tie))
        for timer in list(self.handle.listTimers()) if waited else ():
            self.handle.deleteTimer(timer)
        if self._waits(status, attempts):
            start = micros // 1000 if self.event_time else timerValues.getCurrentProcessingTimeInMs()
            self.handle.registerTimer(start + int(1000 * min(attempts * self.base, self.limit)))
        yield self._row(key, "state", status, attempts, micros, tie)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        status, attempts, micros, tie = self.item.get()
        if status == self.failed:
            yield self._row(key, "retry", status, attempts, micros, tie)

    def close(self) -> None:
        pass


@contextmanager
def rocks(spark: SparkSession):
    """Queries started in here keep their state in RocksDB, which keyed state needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def item_stream(events: DataFrame, key: str, time: str, tie: str, status: str, late: str | None = None, **rules) -> DataFrame:
    """The stream of ItemStates rows of an event stream.

    late: how late events may be; a later one is dropped. Waits are over when the watermark passes them.
    None: waits are in processing time and no event is too late; such a query never runs out of batches,
    so it is one to keep running. Null keys are an item of their own.
    """
    at = F.col(time).cast("timestamp")
    rows = events.select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item"), at.alias("at"), F.coalesce(F.unix_micros(at), F.lit(0)).alias("micros"),
        F.coalesce(F.col(tie).cast("long"), F.lit(-1)).alias("tie"), F.coalesce(F.col(status).cast("string"), F.lit("")).alias("status"))
    if late is not None:
        rows = rows.withWatermark("at", late)
    mode = "ProcessingTime" if late is None else "EventTime"
    return rows.groupBy("item").transformWithState(ItemStates(event_time=late is not None, **rules), STATE, "Update", mode)


def follow_items(store: TableStore, name: str, stream: DataFrame, checkpoint: str, run: Callable[..., StreamingQuery] = run_available) -> StreamingQuery:
    """Run an item stream into the store's table `name`, each batch appended once, whatever is replayed."""
    sink = once(store, name, lambda rows, number: {name: ("append", rows.withColumn("batch", F.lit(number).cast("long")))})
    with rocks(store.spark):
        return run(stream, sink, checkpoint, mode="update")


def last_states(store: TableStore, name: str) -> DataFrame:
    """The last state row of each item in the store: that of its last batch."""
    rows = store.read(name).where("kind = 'state'")
    last = Window.partitionBy("item").orderBy(F.desc("batch"))
    return rows.withColumn("_rank", F.row_number().over(last)).where("_rank = 1").drop("_rank", "kind", "tie", "batch")


def replay_in_parts(events: DataFrame, folder: str, parts: int = 4, **columns) -> DataFrame:
    """An event table as files that arrive in two halves, followed by a stream that is stopped between them and started again.

    A half is parts / 2 batches; a batch is as many files of about FILE_ROWS events as it takes, so that no task writes a whole part.
    """
    spark = events.sparkSession
    store, landing = TableStore(spark, f"{folder}/store"), f"{folder}/landing"
    files = max(1, math.ceil(events.count() / (parts * FILE_ROWS)))
    dealt = events.withColumn("_half", F.pmod(F.xxhash64(*events.columns), F.lit(2)))
    for half in (0, 1):
        dealt.where(F.col("_half") == half).drop("_half").repartition(parts // 2 * files).write.mode("append").parquet(landing)
        stream = item_stream(read_stream(spark, landing, events, files), late=NEVER_LATE, **columns)
        follow_items(store, "states", stream, f"{folder}/checkpoint")
    return last_states(store, "states")
