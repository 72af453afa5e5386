"""Event streams: windowed counts, late and repeated events, and stalls kept in state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from assize.sources.shared import shared_folder

EVENT = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf_dir: str, files_per_batch: int = 1000) -> DataFrame:
    """The events table as a stream; `at` is its event time as a timestamp, which watermarks need."""
    rows = spark.readStream.schema(EVENT).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", files_per_batch).parquet(sf_dir)
    return rows.withColumn("at", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str, out: str | None = None) -> DataFrame:
    """What a stream has written once its present input is used up, as a batch. In complete mode, its last answer.

    With the folder of an earlier call as `out`, the stream goes on from that call's state."""
    spark = stream.sparkSession
    out = out or shared_folder(spark)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows" if mode == "complete" else f"{out}/rows/epoch={epoch}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows").select(stream.columns)


def delivered(parts: list[DataFrame], job: Callable[[DataFrame], DataFrame], settings: dict[str, str] | None = None) -> DataFrame:
    """What `job` has appended after each of `parts` (rows of EVENT) was delivered and used up in turn: its state and its
    watermark go on from one delivery to the next. `settings` hold for the stream alone, in a session of its own."""
    spark = parts[0].sparkSession
    at, out, rows = shared_folder(spark), shared_folder(spark), None
    own = spark
    if settings:
        own = spark.newSession()
        for name, value in {"spark.sql.session.timeZone": spark.conf.get("spark.sql.session.timeZone"), "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions"), **settings}.items():
            own.conf.set(name, value)
    for part in parts:
        part.select(*(f.split(" ")[0] for f in EVENT.split(", "))).write.mode("append").parquet(at)
        stream = own.readStream.schema(EVENT).parquet(at).withColumn("at", F.col("ts").cast("timestamp"))
        rows = drained(job(stream), "append", out)
    return spark.read.schema(rows.schema).parquet(f"{out}/rows").select(rows.columns)


def tumbling_counts(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events and their value by tumbling window and type."""
    return _windowed(events.withWatermark("at", late), F.window("at", size))


def sliding_counts(events: DataFrame, size: str = "1 day", slide: str = "12 hours", late: str = "1 hour") -> DataFrame:
    return _windowed(events.withWatermark("at", late), F.window("at", size, slide))


def _windowed(events: DataFrame, window) -> DataFrame:
    out = events.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "cents")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """A user's events in sessions that end after a gap."""
    out = events.withWatermark("at", late).groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), "n")


def distinct_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once, whatever is delivered again within the watermark."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])


def stalled_events(events: DataFrame, fp: Callable | None = None, threshold: int = 2, key: str = "user_id") -> DataFrame:
    """(key, event_id, run): events whose fingerprint has come `threshold` times in a row for their key.

    The last fingerprint and its run are kept in state; each batch is ordered by (ts, event_id). An event behind a later
    batch can't be put into a run that has gone on: it counts when it arrives."""
    marked = events.withColumn("fp", fp(F.col("event_type")) if fp else F.col("event_type")).select(key, "ts", "event_id", "fp")

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, run = state.get if state.exists else ("", 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        hits = []
        for event, mark in zip(rows["event_id"], rows["fp"]):
            if mark:
                run = run + 1 if mark == last else 1
                last = mark
                if run >= threshold:
                    hits.append((event, run))
        state.update((last, run))
        yield pd.DataFrame({key: [group[0]] * len(hits), "event_id": [h[0] for h in hits], "run": [h[1] for h in hits]})

    return marked.groupBy(key).applyInPandasWithState(step, f"{key} bigint, event_id bigint, run int", "last string, run int", "append", GroupStateTimeout.NoTimeout)


#: transformWithState keeps its state in this store.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class _OrderedStalls(StatefulProcessor):
    """Events of a key wait until the watermark has passed them, and are counted in the order of (ts, event_id)."""

    def __init__(self, key: str, threshold: int, forget_us: int | None):
        self.key, self.threshold, self.forget = key, threshold, forget_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at bigint, event bigint, fp string")
        self.run = handle.getValueState("run", "at bigint, last string, run int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        come = [(int(at), int(event), fp) for frame in rows for at, event, fp in zip(frame["micros"], frame["event_id"], frame["fp"])]
        self.waiting.appendList(come)
        # One timer for the earliest is enough: each release sets the next.
        self.handle.registerTimer(min(c[0] for c in come) // 1000 + 1)
        yield self._hits(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        ready, rest = [r for r in rows if r[0] <= passed], [r for r in rows if r[0] > passed]
        at, last, run = self.run.get() if self.run.exists() else (0, "", 0)
        hits = []
        for at, event, fp in ready:
            if fp:
                run = run + 1 if fp == last else 1
                last = fp
                if run >= self.threshold:
                    hits.append((event, run))
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        else:
            self.waiting.clear()
        if not rest and self.forget is not None and passed >= at + self.forget:
            self.run.clear()
        elif ready:
            self.run.update((at, last, run))
            if not rest and self.forget is not None:
                self.handle.registerTimer((at + self.forget) // 1000 + 1)
        yield self._hits(key, hits)

    def _hits(self, key, hits) -> pd.DataFrame:
        return pd.DataFrame({self.key: pd.Series([key[0]] * len(hits), dtype="int64"), "event_id": pd.Series([h[0] for h in hits], dtype="int64"), "run": pd.Series([h[1] for h in hits], dtype="int32")})

    def close(self) -> None:
        pass


def ordered_stalls(events: DataFrame, late: str = "1 day", threshold: int = 2, key: str = "user_id", forget: str | None = None) -> DataFrame:
    """(key, event_id, run) as `stalled_events`, whatever the order of delivery: an event waits in state until the watermark,
    `late` behind the newest event, has passed it, and is then put in its place by event time. What comes behind the watermark is
    dropped. A key without events for `forget` of event time loses its run; without `forget` it keeps it.

    State holds a key's events of the time `late`, and a row for each key. Needs STATE_STORE; blank prints change nothing."""
    rows = events.withWatermark("at", late).select(key, "at", F.unix_micros("at").alias("micros"), "event_id", F.col("event_type").alias("fp"))
    forget_us = None if forget is None else int(pd.Timedelta(forget).total_seconds() * 1_000_000)
    return rows.groupBy(key).transformWithStateInPandas(_OrderedStalls(key, threshold, forget_us), f"{key} bigint, event_id bigint, run int", "append", "eventTime")


def end_mark(spark: SparkSession, at: str = "2100-01-01 00:00:00") -> DataFrame:
    """A delivery of one event of no user far ahead: it moves the watermark past all events, so that none waits any longer."""
    return spark.sql(f"select -1L as event_id, timestamp_ntz '{at}' as ts, -1L as user_id, '' as event_type, 0.0D as value, '' as props")
