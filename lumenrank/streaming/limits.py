"""Stateful operators over event logs: as windows over a table, and as structured streams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..sources.shared import new_folder


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def sliding_count(events: DataFrame, key: str, seconds: int, most: int) -> DataFrame:
    """``events`` with ``n``, events of the key in the time before, itself included and the
    window's far end not, and ``retry_after`` seconds once there are ``most``."""
    t = micros(F.col("ts"))
    w = Window.partitionBy(key).orderBy(t).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    counted = events.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("__oldest", F.min(t).over(w))
    wait = F.ceil((F.col("__oldest") + seconds * 1_000_000 - t) / 1_000_000)
    return counted.withColumn("retry_after", F.when(F.col("n") >= most, wait.cast("long"))).drop("__oldest")


def failure_streaks(events: DataFrame, key: str, failed: Column, trip: int) -> DataFrame:
    """(key, longest, trips): the longest run of failures, and how many runs reach ``trip``."""
    order = Window.partitionBy(key).orderBy("ts", "event_id")
    marked = events.withColumn("__f", failed.cast("int")).withColumn("__ok", F.sum(F.when(failed, 0).otherwise(1)).over(order))
    runs = marked.where("__f = 1").groupBy(key, "__ok").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy(key).agg(F.max("n").alias("longest"), F.count_if(F.col("n") >= trip).alias("trips"))


def within_budget(events: DataFrame, key: str, cost: Column, cap: float) -> DataFrame:
    """Events while the key's running total stays within the cap, with that total."""
    order = Window.partitionBy(key).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("spent", F.sum(cost).over(order)).where(F.col("spent") <= cap)


def last_state(events: DataFrame, key: str) -> DataFrame:
    """The last event of each key."""
    last = F.max_by(F.struct("event_id", "event_type", "ts"), F.struct("ts", "event_id"))
    return events.groupBy(key).agg(last.alias("s"), F.count(F.lit(1)).alias("events")).select(key, "s.event_id", "s.event_type", "events")


def unexpired(entries: DataFrame, now: Column) -> DataFrame:
    """Entries of a cache that still hold, the newest of each key."""
    live = entries.where(F.col("expires_at") > now)
    return live.groupBy("key").agg(F.max_by("value", "expires_at").alias("value"), F.max("expires_at").alias("expires_at"))


def windowed_counts(stream: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling counts and sums by type; the same code for a stream and for a table."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if timed.isStreaming else timed
    return timed.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))


def _track(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    last, n = state.get if state.exists else (0, 0)
    for b in batches:
        n += len(b)
        last = max(last, int(b.event_id.max()))
    state.update((last, n))
    yield pd.DataFrame({"user_id": [key[0]], "last_event": [last], "events": [n]})


def progress_stream(stream: DataFrame) -> DataFrame:
    """Exact last state a key, kept between batches: (user_id, last_event, events) at each update."""
    return stream.groupBy("user_id").applyInPandasWithState(_track, "user_id long, last_event long, events long", "last long, n long", "update", "NoTimeout")


class SlidingLimit(StatefulProcessor):
    """Per key the times of its events that a later one may still count, with a timer that ends them: in ``seconds`` after the last one
    a key is forgotten, whatever the number of keys. A batch's events are counted with all that came with them or before."""

    def __init__(self, seconds: int, most: int):
        self.micros, self.most = seconds * 1_000_000, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "t long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["t", "event_id"])
        known = [r[0] for r in self.times.get()] if self.times.exists() else []
        t, seen = new.t.to_numpy(), np.sort(np.concatenate((np.array(known, np.int64), new.t.to_numpy())))
        first = np.searchsorted(seen, t - self.micros, "right")
        n = np.searchsorted(seen, t, "right") - first
        wait = -((t - self.micros - seen[first]) // 1_000_000)
        # events older than the watermark no longer come
        self.times.put([(int(x),) for x in seen[seen > timerValues.getCurrentWatermarkInMs() * 1000 - self.micros]])
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(int(seen[-1] + self.micros) // 1000 + 1)
        yield pd.DataFrame({"key": [key[0]] * len(new), "event_id": new.event_id.to_numpy(), "n": n, "retry_after": pd.array(np.where(n >= self.most, wait, -1), "Int64")}).assign(retry_after=lambda x: x.retry_after.where(x.n >= self.most))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.times.clear()
        return iter([])

    def close(self) -> None:
        pass


def sliding_limit_stream(stream: DataFrame, key: str, seconds: int, most: int, late: str = "0 seconds") -> DataFrame:
    """``sliding_count`` over a stream of (key, event_id, ts): (key, event_id, n, retry_after) for each event, once. Events up to
    ``late`` behind are counted where they belong, in time for those that come with or after them; n of a null key is of its own events."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed = stream.select(F.col(key).alias("key"), "event_id", F.col("ts").cast("timestamp").alias("at")).withWatermark("at", late).select("key", "event_id", "at", micros(F.col("at")).alias("t"))
    kind = stream.schema[key].dataType.simpleString()
    out = f"key {kind}, event_id {stream.schema['event_id'].dataType.simpleString()}, n long, retry_after long"
    return timed.groupBy("key").transformWithStateInPandas(SlidingLimit(seconds, most), out, "append", "EventTime")


def run_available(spark: SparkSession, folder: str, schema: StructType, plan, mode: str = "complete", checkpoint: str | None = None, files_at_once: int | None = None) -> DataFrame:
    """Run a streaming plan over the files of a folder that are there now, ``files_at_once`` a batch; its result as a table.

    Each batch is written as a table of its own in the shared folder, over what a failed attempt at
    it left, beside the checkpoint; nothing passes through the driver. In complete mode the last batch
    is the result, in update and append mode all of them are, with ``batch``.
    """
    base = new_folder(spark, "stream")
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    stream = plan((source if files_at_once is None else source.option("maxFilesPerTrigger", files_at_once)).parquet(folder))
    done: list[int] = []

    def save(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{base}/rows/batch={batch}")
        done.append(batch)

    query = stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", checkpoint or f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if not done:
        empty = spark.createDataFrame([], stream.schema)
        return empty if mode == "complete" else empty.withColumn("batch", F.lit(0).cast("long"))
    read = lambda n: spark.read.schema(stream.schema).parquet(f"{base}/rows/batch={n}")
    if mode == "complete":
        return read(max(done))
    out = [read(n).withColumn("batch", F.lit(n).cast("long")) for n in sorted(set(done))]
    return reduce(DataFrame.unionByName, out)
