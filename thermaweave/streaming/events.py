"""Events from a stream of exceeding days."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..config import CELL
from ..session import Files, deliver

DAY_MS = 86_400_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def session_events(exceeding: DataFrame, min_duration: int = 5, max_gap: int = 2, keys: Sequence[str] = CELL, time: str = "time", late: str = "3 days") -> DataFrame:
    """Sessions of exceeding days by calendar: days further apart than max_gap + 1 begin a new one.

    Windows that touch are merged, so the session gap is max_gap + 1 days. On a gap-free axis this equals the batch
    result; an event that is still open when the stream ends is emitted once a later day moves the watermark past it.
    Works on a batch too. Rows later than the watermark are dropped.
    """
    rows = exceeding.withColumn("_at", F.to_timestamp(F.to_date(time)))
    rows = rows.withWatermark("_at", late) if rows.isStreaming else rows
    found = rows.groupBy(*keys, F.session_window("_at", f"{max_gap + 1} days").alias("_w")).agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"))
    days = F.datediff("_last", "_first") + 1
    return found.select(*keys, F.to_date("_first").alias("event_start"), F.to_date("_last").alias("event_end"), days.alias("duration")).where(F.col("duration") >= min_duration)


class _Tracker(StatefulProcessor):
    """Open event of a cell by axis position: (start, last)."""

    def __init__(self, min_duration: int, max_gap: int):
        self.min_duration, self.max_gap = min_duration, max_gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        kind = StructType([StructField("start", LongType()), StructField("last", LongType())])
        self.state = handle.getValueState("open", kind)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows))["t_idx"]
        days, ends = sorted(found.dropna().astype("int64").tolist()), bool(found.isna().any())
        held = self.state.get() if self.state.exists() else None
        out = []
        start, last = held or (None, None)
        for t in days:
            if start is None:
                start = t
            elif t - last > self.max_gap + 1:
                if last - start + 1 >= self.min_duration:
                    out.append((*key, start, last, last - start + 1))
                start = t
            last = t if last is None or t > last or start == t else last
        if ends:
            if start is not None and last - start + 1 >= self.min_duration:
                out.append((*key, start, last, last - start + 1))
            self.state.clear()
        elif start is not None:
            self.state.update((start, last))
        yield pd.DataFrame(out, columns=[*CELL, "start_idx", "end_idx", "duration"])

    def close(self) -> None:
        pass


def tracked_events(exceeding: DataFrame, min_duration: int = 5, max_gap: int = 2) -> DataFrame:
    """Events by axis position (lat_idx, lon_idx, t_idx of exceeding days) with one open event of state a cell.

    Needs the RocksDB state store. An event is emitted by the first exceeding day behind its gap; the last one of each
    cell stays in the state until a row of the cell without t_idx flushes it (flush_rows gives one a cell).
    """
    schema = StructType([StructField("lat_idx", IntegerType()), StructField("lon_idx", IntegerType()), StructField("start_idx", LongType()), StructField("end_idx", LongType()), StructField("duration", LongType())])
    return exceeding.groupBy(*CELL).transformWithStateInPandas(statefulProcessor=_Tracker(min_duration, max_gap), outputStructType=schema, outputMode="Append", timeMode="None")


def flush_rows(cells: DataFrame, schema: StructType) -> DataFrame:
    """A row a cell that ends its series: tracked_events then emits what is open there. schema: that of the stream."""
    keys = cells.select(*CELL).distinct()
    return keys.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in CELL else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


class _Closing(StatefulProcessor):
    """Open runs of a key, (first, last) as days since 1970. A timer closes those that no row can reach any more.

    A key has a timer at the end of its earliest run only: each firing closes all runs that the watermark has passed and
    sets the next timer. Rows, not data frames, go in and out, as a key has few of them.
    """

    def __init__(self, min_duration: int, max_gap: int, keys: Sequence[str]):
        self.min_duration, self.max_gap, self.keys = min_duration, max_gap, list(keys)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getListState("runs", StructType([StructField("first", LongType()), StructField("last", LongType())]))

    def _end(self, run: tuple[int, int]) -> int:
        """When the first day begins that can't be bridged."""
        return (run[1] + self.max_gap + 2) * DAY_MS

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        days = {r.day_number for r in rows} - {None}
        if not days:
            return
        held = [(int(a), int(z)) for a, z in self.runs.get()]
        merged: list[tuple[int, int]] = []
        for first, last in sorted([*held, *((d, d) for d in days)]):
            if merged and first - merged[-1][1] <= self.max_gap + 1:
                merged[-1] = (merged[-1][0], max(merged[-1][1], last))
            else:
                merged.append((first, last))
        if merged != held:
            self.runs.put(merged)
        ends = self._end(merged[0])
        if not held or ends < self._end(held[0]):  # else a timer is there, at this time or before it
            self.handle.registerTimer(ends)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        runs = [(int(a), int(z)) for a, z in self.runs.get()]
        held = [r for r in runs if self._end(r) > now]
        if not held:
            self.runs.clear()
        elif len(held) < len(runs):
            self.runs.put(held)
        if held:
            self.handle.registerTimer(self._end(held[0]))
        event = Row(*self.keys, "first", "last")
        yield from (event(*key, *r) for r in runs if self._end(r) <= now and r[1] - r[0] + 1 >= self.min_duration)

    def close(self) -> None:
        pass


def timed_events(exceeding: DataFrame, min_duration: int = 5, max_gap: int = 2, keys: Sequence[str] = CELL, time: str = "time", late: str = "3 days", clock: DataFrame | None = None) -> DataFrame:
    """keys, event_start, event_end, duration (calendar days) from a stream of exceeding days.

    An event is emitted when its gap expires: a timer in event time fires as soon as the watermark passes the last day
    that could extend it, and its state goes with it. Rows may come in any order within `late`; later ones are dropped.
    What moves the watermark are the days of all keys, and those of clock, a stream with a column of the same name: as
    a series ends, one row of it, so many days further, closes what is still open. State: open runs of a key. Needs the
    RocksDB state store (run_to_end() sets it).
    """
    deliver(exceeding.sparkSession)
    rows = exceeding.select(*keys, F.to_timestamp(F.to_date(time)).alias("seen_at"), F.unix_date(F.to_date(time)).cast("long").alias("day_number"))
    if clock is not None:
        kinds = {f.name: f.dataType for f in rows.schema}
        ticks = clock.select(*[F.lit(None).cast(kinds[k]).alias(k) for k in keys], F.to_timestamp(F.to_date(time)).alias("seen_at"), F.lit(None).cast("long").alias("day_number"))
        rows = rows.unionByName(ticks)
    schema = StructType([*(StructField(f.name, f.dataType) for f in rows.select(*keys).schema), StructField("first", LongType()), StructField("last", LongType())])
    grouped = rows.withWatermark("seen_at", late).groupBy(*keys)
    found = grouped.transformWithState(statefulProcessor=_Closing(min_duration, max_gap, keys), outputStructType=schema, outputMode="Append", timeMode="EventTime")
    day = lambda c: F.date_from_unix_date(F.col(c).cast("int"))
    return found.select(*keys, day("first").alias("event_start"), day("last").alias("event_end"), (F.col("last") - F.col("first") + 1).cast("int").alias("duration"))


def write_batch(batch: DataFrame, path: str, number: int) -> None:
    batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def write_batches(found: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Starts a stream that writes each of its batches as a folder of its own, named by the batch.

    A batch that runs again after a failure takes the place of what it left, so each event is there once.
    """
    return found.writeStream.foreachBatch(lambda batch, number: write_batch(batch, path, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_batches(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What write_batches() has written; nothing yet: no rows."""
    Files(spark, path).make()
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def run_to_end(found: DataFrame, path: str, checkpoint: str) -> None:
    """write_batches() over all that the source has, from where the checkpoint stands; state lives in RocksDB."""
    spark, name = found.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    try:
        query = write_batches(found, path, checkpoint)
    finally:
        spark.conf.set(name, before)
    query.awaitTermination()


def close_series(spark: SparkSession, folder: str, last: str, days: int, time: str = "time") -> None:
    """One row for timed_events()'s clock, so many days behind the last day of a series that goes no further."""
    spark.sql(f"SELECT date_add(DATE '{last}', {int(days)}) AS `{time}`").coalesce(1).write.mode("append").parquet(folder)
