"""Frames of videos: sampling, blur, duplicates, statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CLUSTER_BITS, FRAME_BATCH, FRAME_BLUR_SHARE, FRAME_INTERVAL, FRAME_SHARPNESS_MIN, FRAMES_MOST
from ..sources.shared import cut
from .ranking import percentiles


def step(fps: Column, duration: Column, interval: float = FRAME_INTERVAL, most: int = FRAMES_MOST) -> Column:
    """Frames from one sample to the next: the interval is stretched where it would give more than ``most``."""
    every = F.when(duration / interval > most, duration / most).otherwise(F.lit(interval))
    return F.greatest(F.lit(1), F.bround(every * fps)).cast("long")


def relative_blur(frames: DataFrame, video: str = "video") -> DataFrame:
    """``frames`` (sharpness) with ``blurry``: below the 30th percentile of their video (videos of four frames or more).

    The percentiles are order statistics of groups: jobs for them run when this is called, and no task holds a video.
    """
    bound = percentiles(frames, video, "sharpness", FRAME_BLUR_SHARE).select(F.col(video).alias("_video"), F.col("n").alias("_n"), F.col("value").alias("_p"))
    joined = frames.join(bound, F.col(video).eqNullSafe(F.col("_video")), "left")
    blurry = (F.col("_n") >= 4) & (F.col("sharpness") < F.greatest("_p", F.lit(FRAME_SHARPNESS_MIN)))
    return joined.withColumn("blurry", F.coalesce(blurry, F.lit(False))).drop("_video", "_n", "_p")


def sampled(frames: DataFrame, interval: float = FRAME_INTERVAL, most: int = FRAMES_MOST) -> DataFrame:
    """Of ``frames`` (idx from 0, fps, frame_count, ...) those that are sampled, with ``timestamp`` and ``duration`` in seconds.

    About ``most`` a video at most. Frames of a video without a rate or a count have none.
    """
    duration = F.col("frame_count") / F.col("fps")
    some = frames.where((F.col("fps") > 0) & (F.col("frame_count") > 0)).withColumn("duration", duration)
    some = some.where(F.col("idx") % step(F.col("fps"), F.col("duration"), interval, most) == 0)
    return some.withColumn("timestamp", F.bround(F.col("idx") / F.col("fps"), 2))


def first_seen(hashes: np.ndarray, kept: np.ndarray, bits: int = CLUSTER_BITS) -> np.ndarray:
    """For each frame of a batch whether no frame in ``kept`` (from earlier batches) is nearer than ``bits`` bits."""
    near = np.bitwise_count(hashes.view(np.uint64)[:, None] ^ kept.view(np.uint64)[None, :]) < bits
    return ~near.any(axis=1)


def drop_repeats(frames: DataFrame, bits: int = CLUSTER_BITS, batch: int = FRAME_BATCH) -> DataFrame:
    """``frames`` (video, seq, h) without those near a frame kept from an earlier batch of their video.

    Frames of one batch aren't compared with each other; ties in seq go by h, and a frame without a hash is
    dropped. Which frames stay depends on all kept before, so a video's samples are one group: take those of
    sampled(), about FRAMES_MOST a video.
    """

    def one(video: pa.Table) -> pa.Table:
        video = video.sort_by([("seq", "ascending"), ("h", "ascending")])
        hashes = video.column("h").to_numpy()
        stay, kept = np.zeros(len(video), bool), np.zeros(0, np.int64)
        for s in range(0, len(video), batch):
            stay[s : s + batch] = first_seen(hashes[s : s + batch], kept, bits)
            kept = np.concatenate((kept, hashes[s : s + batch][stay[s : s + batch]]))
        return video.filter(pa.array(stay))

    return frames.where("h is not null").groupBy("video").applyInArrow(one, frames.schema)


def kept(frames: DataFrame) -> DataFrame:
    """``frames`` (sharpness, over, under, blink) that are neither badly exposed nor blurry beyond use, without closed eyes."""
    return frames.where(~(F.col("over") | F.col("under")) & (F.col("sharpness") >= FRAME_SHARPNESS_MIN) & ~F.col("blink"))


def statistics(frames: DataFrame) -> DataFrame:
    """A row a video of (sharpness, over, under, blink): why frames were dropped, and how many stay."""
    exposed = F.col("over") | F.col("under")
    blurry = ~exposed & (F.col("sharpness") < FRAME_SHARPNESS_MIN)
    blink = ~exposed & ~blurry & F.col("blink")
    count = lambda c, name: F.count_if(c).alias(name)
    return frames.groupBy("video").agg(F.count("*").alias("candidates"), count(exposed, "failed"), count(blurry, "blurry"), count(blink, "blink"), count(~exposed & ~blurry & ~F.col("blink"), "kept"))


def extracted(frames: DataFrame, bits: int = CLUSTER_BITS, batch: int = FRAME_BATCH) -> DataFrame:
    """Of sampled ``frames`` (video, idx, sharpness, over, under, h, blink, ...) those that stay of each video, with ``dropped``
    telling why the others go: failed (badly exposed, or without a hash), blurry, dup, blink, null for those that stay.

    Batches of ``batch`` samples are looked at in turn: what is neither badly exposed nor blurred beyond use is compared with the
    frames kept from earlier batches, and stays unless eyes are closed. What is less sharp than most of a video's frames that
    stayed goes at last. A video's samples, some FRAMES_MOST, are one group; pixels aren't among them.
    """
    names = ["video", "idx", "sharpness", "over", "under", "h", "blink"]

    def one(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("idx")
        column = lambda c: rows.column(c).to_numpy(zero_copy_only=False)
        sharp, exposed, shut = column("sharpness").astype(float), (column("over") | column("under")).astype(bool), column("blink").astype(bool)
        hashed = rows.column("h").is_valid().to_numpy()
        h = rows.column("h").fill_null(0).to_numpy()
        why = np.full(len(rows), None, object)
        why[exposed] = "failed"
        why[~exposed & ~(sharp >= FRAME_SHARPNESS_MIN)] = "blurry"
        why[(why == None) & ~hashed] = "failed"  # noqa: E711
        kept = np.zeros(0, np.int64)
        for s in range(0, len(rows), batch):
            some = np.arange(s, min(len(rows), s + batch))
            some = some[[why[k] is None for k in some]]
            new = first_seen(h[some], kept, bits)
            why[some[~new]] = "dup"
            why[some[new & shut[some]]] = "blink"
            kept = np.concatenate((kept, h[some[new & ~shut[some]]]))
        return pa.table({"video": rows.column("video"), "idx": rows.column("idx"), "why": pa.array(why, pa.string())})

    thin = frames.select(*names)
    kinds = {f.name: f.dataType.simpleString() for f in thin.schema}
    told = cut(thin.groupBy("video").applyInArrow(one, f"video {kinds['video']}, idx {kinds['idx']}, why string"))
    stay = thin.select("video", "idx", "sharpness").join(told.where("why is null").select("video", "idx"), ["video", "idx"], "left_semi")
    blurry = relative_blur(stay).where("blurry").select("video", "idx", F.lit("blurry").alias("late"))
    told = told.join(blurry, ["video", "idx"], "left").select("video", "idx", F.coalesce("why", "late").alias("dropped"))
    return frames.join(told, ["video", "idx"])
