"""Streaming operators. Each takes and returns a streaming (or, where it has no state of its own, also a batch) DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import SparkRuntimeException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from risklake.functions.scalars import half_up
from risklake.sources.lineage import shared_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """The events table, one file or a folder of parts, as a file stream: a pattern may name either, a path of a stream a folder alone."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name[:-1]}[{name[-1]}]")


def _fresh(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/replay-{uuid.uuid4().hex}"


def replay(stream: DataFrame, mode: str, at: str | None = None) -> DataFrame:
    """Run a stream over all that is there and return what it wrote, for tests and batch comparison. Rows, state and offsets go to a
    fresh folder in the shared one, or to `at`; no row reaches the driver. In complete mode the last batch has all rows."""
    spark = stream.sparkSession
    at = at or _fresh(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
    done: list[str] = []

    def write(rows: DataFrame, batch: int) -> None:
        # A batch that is run again replaces its own rows.
        rows.write.mode("overwrite").parquet(f"{at}/batch-{batch}")
        done.append(f"{at}/batch-{batch}")

    if mode == "append":
        spark.createDataFrame([], stream.schema).write.parquet(f"{at}/rows")
        writer.format("parquet").option("path", f"{at}/rows").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{at}/rows")
    writer.foreachBatch(write).start().awaitTermination()
    kept = sorted(set(done)) if mode == "update" else done[-1:]
    return spark.read.schema(stream.schema).parquet(*kept) if kept else spark.createDataFrame([], stream.schema)


def progress_latest(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Latest phase of each scan and whether it is a final one; the latest by time, then by event."""
    return stream.withWatermark("ts", late).groupBy("scan_id").agg(F.max_by("route", F.struct("ts", "event_id")).alias("phase"), F.max("ts").alias("seen"), F.count("*").alias("events"))


def owner_feed(stream: DataFrame, owners: DataFrame) -> DataFrame:
    """owners(scan_id, subscriber): a stream-static join."""
    return stream.join(owners, "scan_id").select("event_id", "ts", "scan_id", "subscriber", "route")


#: Request limits: name, minutes of a window, most requests in it; fixed.
LIMITS = (("global", 15, 200), ("auth", 15, 20), ("scans", 60, 30), ("otp", 10, 5))


class FirstHit(StatefulProcessor):
    """Windows that open at a key's first event and last `width`; those with more than `most` events come out when they close.

    Events wait in state until the watermark has passed them, so that they are counted in order of time whatever order they come in; a
    timer is set to the first that waits, or to the end of the open window. A key whose window has closed and that has nothing waiting
    has no state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "start long, n long, width long, most long")
        self.waiting = handle.getListState("waiting", "at long")

    def _wake(self, at: int) -> None:
        """A timer at a time in microseconds, the only one of the key."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(-(-at // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            times = [int(t.value // 1000) for t in batch["ts"]]
            self.waiting.appendList([(t,) for t in times])
            first = min([*times, first] if first is not None else times)
            width, most = int(batch["width"].iloc[0]), int(batch["most"].iloc[0])
        waiting = min(t[0] for t in self.waiting.get())
        if not self.open.exists():
            self.open.update((-1, 0, width, most))
        start, _, width, _ = self.open.get()
        self._wake(min(waiting, start + width) if start >= 0 else waiting)
        yield self._rows(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        times = sorted(t[0] for t in self.waiting.get()) if self.waiting.exists() else []
        start, n, width, most = self.open.get()
        closed = []
        for at in [t for t in times if t <= passed]:
            if start >= 0 and at < start + width:
                n += 1
                continue
            if start >= 0 and n > most:
                closed.append((start, n))
            start, n = at, 1
        later = [t for t in times if t > passed]
        if start >= 0 and start + width <= passed:
            if n > most:
                closed.append((start, n))
            start, n = -1, 0
        if later:
            self.waiting.put([(t,) for t in later])
        elif self.waiting.exists():
            self.waiting.clear()
        if later or start >= 0:
            self.open.update((start, n, width, most))
            self._wake(min([*later[:1], *([start + width] if start >= 0 else [])]))
        else:
            self.open.clear()
        yield self._rows(key, closed)

    @staticmethod
    def _rows(key, closed: list[tuple[int, int]]) -> pd.DataFrame:
        return pd.DataFrame({"limit": pd.Series([key[0]] * len(closed), dtype=object), "scan_id": pd.Series([int(key[1])] * len(closed), dtype="int64"), "start": pd.to_datetime([s for s, _ in closed], unit="us"), "n": pd.Series([n for _, n in closed], dtype="int64")})

    def close(self) -> None:
        pass


def rate_violations(stream: DataFrame, limits: DataFrame, late: str = "10 minutes") -> DataFrame:
    """limits(limit, route or null for every route, minutes, most): a small table. Keys with more events of a limit's route in a window than
    it allows; windows open at a key's first event, come out once, and leave no state."""
    asked = F.broadcast(limits.select("limit", F.col("route").alias("_route"), (F.col("minutes").cast("long") * 60_000_000).alias("width"), F.col("most").cast("long").alias("most")))
    met = stream.withWatermark("ts", late).join(asked, F.col("_route").isNull() | (F.col("_route") == F.col("route"))).select("limit", "scan_id", "ts", "width", "most")
    return met.groupBy("limit", "scan_id").transformWithStateInPandas(statefulProcessor=FirstHit(), outputStructType="limit string, scan_id long, start timestamp, n long", outputMode="append", timeMode="eventTime")


def lifecycle(stream: DataFrame) -> DataFrame:
    return stream.groupBy("route").agg(F.count("*").alias("n"))


def _end(window: str) -> Column:
    return F.col(f"{window}.end") + F.expr("INTERVAL 1 MICROSECOND")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Bursts of each scan, closed after an idle gap; an event without a time is a burst of its own, without times. session_window lets an
    event at a burst's very end join it, so its gap is a microsecond shorter."""
    never = F.lit(None).cast("timestamp")
    timed = stream.withWatermark("ts", late).groupBy(F.session_window("ts", f"{gap} -1 microseconds").alias("w"), "scan_id").agg(F.count("*").alias("events")).select("scan_id", F.col("w.start").alias("start"), _end("w").alias("end"), "events")
    return timed.unionByName(stream.filter(F.col("ts").isNull()).select("scan_id", never.alias("start"), never.alias("end"), F.lit(1).cast("long").alias("events")))


def open_sessions(spark: SparkSession, state: str) -> DataFrame:
    """The bursts that a checkpoint of `sessions` holds: those that the watermark has not closed."""
    try:
        held = spark.read.format("statestore").load(state)
    except SparkRuntimeException as e:
        if e.getCondition() != "STDS_COMMITTED_BATCH_UNAVAILABLE":
            raise
        return spark.createDataFrame([], "scan_id long, start timestamp, end timestamp, events long")  # a stream of no batch
    return held.select("value.scan_id", F.col("value.session_window.start").alias("start"), _end("value.session_window").alias("end"), F.col("value.count").alias("events"))


def replay_sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """All bursts of a replay: those that came out once closed, and those still open when the stream ends."""
    at = _fresh(stream.sparkSession)
    return replay(sessions(stream, gap, late), "append", at).unionByName(open_sessions(stream.sparkSession, f"{at}/state"))


def sliding_errors(stream: DataFrame, window: str = "6 hours", step: str = "2 hours", late: str = "1 hour") -> DataFrame:
    counted = stream.withWatermark("ts", late).groupBy(F.window("ts", window, step).alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("status_code") >= 500).alias("errors"))
    return counted.select(F.col("w.start").alias("start"), "n", half_up(F.col("errors") / F.col("n"), 4).alias("error_rate"))


class Ring(StatefulProcessor):
    """Keeps a key's newest events by time (a list of at most `keep`) and emits the state of the ring after each batch."""

    def __init__(self, keep: int, least: int):
        self.keep, self.least = keep, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", "ts timestamp, event_id long, ms double, failed int")
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame(list(self.ring.get()) if self.ring.exists() else [], columns=["ts", "event_id", "ms", "failed"])
        n = self.seen.get()[0] if self.seen.exists() else 0
        for batch in rows:
            n += len(batch)
            fresh = pd.DataFrame({"ts": batch["ts"], "event_id": batch["event_id"], "ms": batch["response_time_ms"], "failed": (batch["status_code"] >= 500).astype("int32")})
            held = pd.concat([held, fresh]) if len(held) else fresh
            held = held.sort_values(["ts", "event_id"]).tail(self.keep)
        self.seen.update((int(n),))
        self.ring.put([(t.to_pydatetime(), int(e), float(m), int(f)) for t, e, m, f in held.itertuples(index=False)])
        if n >= self.least:
            rate, mean = float(held["failed"].mean()), float(held["ms"].mean())
            yield pd.DataFrame({"route": [key[0]], "seen": [n], "error_rate": [round(rate, 4)], "mean_ms": [round(mean, 3)], "bottleneck": [rate > 0.05 or mean > 1500]})

    def close(self) -> None:
        pass


def traffic_alarm(stream: DataFrame, keep: int = 100, least: int = 50) -> DataFrame:
    """Error rate and mean latency of each route's last events; keep=1000, least=1 is the latency ring."""
    return stream.groupBy("route").transformWithStateInPandas(
        statefulProcessor=Ring(keep, least), outputStructType="route string, seen long, error_rate double, mean_ms double, bottleneck boolean", outputMode="update", timeMode="none"
    )


class Heartbeat(StatefulProcessor):
    """A key is stuck if no event follows for `minutes` of event time; each event moves its timer."""

    def __init__(self, minutes: int):
        self.wait = minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = max(batch["ts"].max().value // 1_000_000 for batch in rows)
        if self.last.exists():
            latest = max(latest, self.last.get()[0])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.last.update((latest,))
        self.handle.registerTimer(latest + self.wait)
        yield pd.DataFrame({"scan_id": pd.Series([], dtype="int64"), "last_seen": pd.Series([], dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"scan_id": [int(key[0])], "last_seen": [int(self.last.get()[0])]})
        self.last.clear()

    def close(self) -> None:
        pass


def stuck(stream: DataFrame, minutes: int = 30, late: str = "1 minute") -> DataFrame:
    watched = stream.withWatermark("ts", late).groupBy("scan_id")
    return watched.transformWithStateInPandas(statefulProcessor=Heartbeat(minutes), outputStructType="scan_id long, last_seen long", outputMode="append", timeMode="eventTime")
