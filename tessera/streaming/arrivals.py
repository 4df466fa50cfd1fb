"""Streams: frames against what their video has kept, arriving files, windows over events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import CLUSTER_BITS, FRAME_BATCH
from ..operators.frames import first_seen
from ..operators.merge import keep_old


class _Kept(StatefulProcessor):
    """Of each video how many frames were seen and which were kept, each with the number of its batch, until it is idle for a while."""

    def __init__(self, bits: int, batch: int, idle: int | None) -> None:
        self.bits, self.batch, self.idle = bits, batch, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "n bigint")
        self.kept = handle.getListState("kept", "h bigint, batch bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = pd.concat(list(rows)).sort_values(["seq", "h"], kind="stable")
        n = self.seen.get()[0] if self.seen.exists() else 0
        kept = list(self.kept.get())
        hashes, batches = ([int(r[k]) for r in kept] for k in (0, 1))
        number = (n + np.arange(len(frames))) // self.batch
        stay = np.zeros(len(frames), bool)
        own = frames["h"].to_numpy(np.int64)
        for b in np.unique(number):
            some = number == b
            before = np.array([h for h, k in zip(hashes, batches) if k < b], np.int64)
            stay[some] = first_seen(own[some], before, self.bits)
            fresh = own[some][stay[some]].tolist()
            hashes += fresh
            batches += [int(b)] * len(fresh)
        self.seen.update((int(n + len(frames)),))
        new = list(zip(hashes, batches))[len(kept) :]
        if new:
            self.kept.appendList(new)
        if self.idle is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        yield frames[stay]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        self.kept.clear()
        return iter(())

    def close(self) -> None:
        pass


def drop_repeats(frames: DataFrame, bits: int = CLUSTER_BITS, batch: int = FRAME_BATCH, idle: float | None = None) -> DataFrame:
    """A stream of frames (video, seq, h, ...) without those near a frame kept from an earlier batch of their video.

    The rows are those of operators.frames.drop_repeats() however the stream is cut into micro-batches, as long as the frames of a
    video come by seq: a frame is told to stay or go when it comes, since only earlier batches count. State is kept in
    RocksDB for each video: a number for each frame that stayed, of some FRAMES_MOST samples. With ``idle`` it ends after so many seconds
    without a frame, and what comes later starts anew; the engine then goes on with batches without rows to look at the clock,
    so that this is for queries that are stopped, and None for those that end when all is read. Frames without a hash are dropped.
    """
    spark = frames.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    known = frames.where("h is not null")
    return known.groupBy("video").transformWithStateInPandas(_Kept(bits, batch, None if idle is None else int(idle * 1000)), frames.schema, "append", "None" if idle is None else "ProcessingTime")


def files(spark: SparkSession, folder: str, kind: str = "binaryFile") -> DataFrame:
    """Files as they arrive; the stream's checkpoint knows which were seen."""
    schema = spark.read.format(kind).load(folder).schema if kind != "binaryFile" else "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format(kind).schema(schema).load(folder)


def into_stage(stages, name: str, key: str) -> Callable[[DataFrame, int], None]:
    """A merge for upsert(): rows whose ``key`` the stage doesn't hold are added to it."""

    def merge(batch: DataFrame, _: int) -> None:
        batch = batch.dropDuplicates([key])
        stages.add(name, keep_old(stages.load(name), batch, key) if name in stages.done() else batch)

    return merge


def upsert(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str):
    """All that has arrived, batch by batch through ``merge``, then stop."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = "1 hour") -> DataFrame:
    """Events and their values by type and window; ``late``: how long a stream waits for stragglers."""
    events = events.withWatermark("ts", late) if late and events.isStreaming else events
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "1 hour") -> DataFrame:
    """A row a session of a user: its events lie less than ``gap`` apart; ``late``: how long a stream waits for stragglers."""
    events = events.withWatermark("ts", late) if late and events.isStreaming else events
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def sliding(events: DataFrame, width: str = "1 hour", slide: str = "15 minutes", late: str | None = "1 hour") -> DataFrame:
    """Events and their largest value by type and overlapping windows; ``late``: how long a stream waits for stragglers, and drops what comes later."""
    events = events.withWatermark("ts", late) if late and events.isStreaming else events
    counts = events.groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("highest"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "highest")


def distinct(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """One row for each ``keys``, which may be null. A stream (with ts) keeps a key for ``late`` after its row: another row of it is dropped
    as long as it comes within that time, and what is older than the watermark is dropped too. A batch has one for all its rows."""
    if not events.isStreaming:
        return events.dropDuplicates(keys)
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
