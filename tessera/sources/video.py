"""Frames of videos as a data source, for batches and streams: ``format("tessera_frames")``.

A video is cut into segments of sampled frames, each a partition that a task decodes by itself. What opens a video is
a plug-in; the one that is there reads uncompressed YUV4MPEG2 files.
"""

from __future__ import annotations

import hashlib
import importlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..config import FRAME_INTERVAL, FRAMES_MOST, VIDEO_BYTES, VIDEO_TYPES

SCHEMA = "video string, path string, signature string, idx bigint, fps double, frame_count bigint, timestamp double, duration double, height int, width int, channels int, data binary, error string"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_KINDS = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]


class VideoError(ValueError):
    """A video that is missing, can't be opened or holds no frames."""


class Y4M:
    """An uncompressed YUV4MPEG2 file (mono, 4:4:4 or 4:2:0, 8 bits): ``fps``, ``frame_count``, and frames by their number."""

    PLANES = {"mono": 1.0, "444": 3.0, "420": 1.5}

    def __init__(self, file, size: int) -> None:
        head = file.read(256).split(b"\n", 1)[0]
        words = head.decode("ascii", "replace").split(" ")
        if words[0] != "YUV4MPEG2":
            raise VideoError("not a YUV4MPEG2 file")
        found = {w[0]: w[1:] for w in words[1:] if w}
        kind = next((k for k in self.PLANES if found.get("C", "420").startswith(k)), None)
        try:
            self.width, self.height = int(found["W"]), int(found["H"])
            up, down = map(int, found["F"].split(":"))
        except (KeyError, ValueError) as error:
            raise VideoError("a header without a size or a rate") from error
        if kind is None or self.width <= 0 or self.height <= 0:
            raise VideoError("a kind of pixels that isn't known")
        self.kind, self.file, self.start = kind, file, len(head) + 1
        self.fps = up / down if down > 0 else 0.0
        half = (self.width + 1) // 2 * ((self.height + 1) // 2)
        self.bytes = self.width * self.height * {"mono": 1, "444": 3, "420": 1}[kind] + (2 * half if kind == "420" else 0)
        self.frame_count = max(0, size - self.start) // (len(b"FRAME\n") + self.bytes)

    def frame(self, idx: int) -> np.ndarray:
        """Height x width x (blue, green, red), or x 1 for mono."""
        self.file.seek(self.start + idx * (len(b"FRAME\n") + self.bytes))
        raw = self.file.read(len(b"FRAME\n") + self.bytes)
        if len(raw) < len(b"FRAME\n") + self.bytes or not raw.startswith(b"FRAME\n"):
            raise VideoError(f"frame {idx} is broken")
        x, n = np.frombuffer(raw, np.uint8, offset=len(b"FRAME\n")), self.width * self.height
        y = x[:n].reshape(self.height, self.width)
        if self.kind == "mono":
            return y[:, :, None]
        if self.kind == "444":
            u, v = x[n : 2 * n].reshape(y.shape), x[2 * n :].reshape(y.shape)
        else:
            h, w = (self.height + 1) // 2, (self.width + 1) // 2
            u, v = (np.repeat(np.repeat(p.reshape(h, w), 2, 0), 2, 1)[: self.height, : self.width] for p in (x[n : n + h * w], x[n + h * w :]))
        y, u, v = 1.164383 * (y.astype(float) - 16), u.astype(float) - 128, v.astype(float) - 128
        full = np.stack([y + 2.017232 * u, y - 0.391762 * u - 0.812968 * v, y + 1.596027 * v], axis=2)
        return np.clip(np.rint(full), 0, 255).astype(np.uint8)


def sampling(fps: float, frame_count: int, interval: float, most: int) -> int:
    """Frames from one sample to the next, as operators.frames.step() has it."""
    duration = frame_count / fps
    if most > 0 and duration / interval > most:
        interval = duration / most
    return max(1, round(interval * fps))


@dataclass
class Segment(InputPartition):
    """Sampled frames ``first``, ``first`` + ``step``, ... before ``end`` of a video; error: the video has none."""

    path: str
    signature: str
    fps: float = 0.0
    frame_count: int = 0
    first: int = 0
    end: int = 0
    step: int = 1
    error: str | None = None


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:", path) else (fs.LocalFileSystem(), path)


class _Frames:
    """What batches and streams share. Options: path (a file or a folder), interval, most (samples a video, about), segment (samples a
    partition), decoder (module:name of a function of a file and its size, which gives fps, frame_count and frame(idx); else
    Y4M), errors (``rows``: a video without frames is a row with an error; else it ends the query)."""

    def __init__(self, options: dict[str, str]) -> None:
        if "path" not in options:
            raise VideoError("no path")
        self.path, self.interval, self.most = options["path"], float(options.get("interval", FRAME_INTERVAL)), int(options.get("most", FRAMES_MOST))
        self.segment, self.decoder, self.rows = int(options.get("segment", 32)), options.get("decoder"), options.get("errors") == "rows"
        self.types = tuple(options.get("types", ",".join((*VIDEO_TYPES, "y4m"))).split(","))
        self.bytes = int(options.get("bytes", VIDEO_BYTES))

    def _opener(self) -> Callable:
        if not self.decoder:
            return Y4M
        module, _, name = self.decoder.partition(":")
        return getattr(importlib.import_module(module), name)

    def files(self) -> list[tuple[int, str, int]]:
        """(time of change in nanoseconds, path, size) of the videos of an allowed type and size, in this order."""
        from pyarrow import fs

        store, at = _store(self.path)
        info = store.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise VideoError(f"no such video or folder: {self.path}")
        some = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at))
        base = self.path[: len(self.path) - len(at)] if self.path.endswith(at) else ""
        kept = [f for f in some if f.type == fs.FileType.File and f.extension.lower() in self.types and f.size <= self.bytes]
        return sorted((f.mtime_ns or 0, base + f.path, f.size) for f in kept)

    def segments(self, files: list[tuple[int, str, int]]) -> list[Segment]:
        out = []
        for changed, path, size in files:
            signature = hashlib.md5(f"{size}:{changed}".encode()).hexdigest()[:6]
            try:
                store, at = _store(path)
                with store.open_input_file(at) as file:
                    video = self._opener()(file, size)
                    fps, count = float(video.fps), int(video.frame_count)
                if not (fps > 0 and count > 0):
                    raise VideoError("a video without a rate or frames")
                step = sampling(fps, count, self.interval, self.most)
                each = step * self.segment
                out += [Segment(path, signature, fps, count, s, min(s + each, count), step) for s in range(0, count, each)]
            except Exception as error:
                if not self.rows:
                    raise VideoError(f"{path}: {error}") from error
                out.append(Segment(path, signature, error=str(error) or type(error).__name__))
        return out

    def read(self, part: Segment) -> Iterator[pa.RecordBatch]:
        """A batch a frame: no task holds more than one. A frame that can't be read is a row with an error, or ends the query."""
        name = part.path.rsplit("/", 1)[-1]
        lasts = part.frame_count / part.fps if part.fps else None

        def row(idx: int | None, picture: np.ndarray | None, error: str | None) -> pa.RecordBatch:
            shape = (None,) * 3 if picture is None else picture.shape
            at = None if idx is None else round(idx / part.fps, 2)
            values = (name, part.path, part.signature, idx, part.fps or None, part.frame_count or None, at, lasts, *shape, None if picture is None else picture.tobytes(), error)
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, _KINDS)], _NAMES)

        if part.error is not None:
            yield row(None, None, part.error)
            return
        store, at = _store(part.path)
        with store.open_input_file(at) as file:
            video = self._opener()(file, file.size())
            for idx in range(part.first, part.end, part.step):
                try:
                    picture, error = np.ascontiguousarray(video.frame(idx), np.uint8), None
                    picture = picture.reshape(*picture.shape[:2], -1)
                except Exception as broken:
                    if not self.rows:
                        raise VideoError(f"{part.path}: {broken}") from broken
                    picture, error = None, str(broken) or type(broken).__name__
                yield row(idx, picture, error)


class _Batch(_Frames, DataSourceReader):
    def partitions(self) -> list[Segment]:
        return self.segments(self.files()) or [Segment("", "", end=0)]

    def read(self, part: Segment) -> Iterator[pa.RecordBatch]:
        return iter(()) if not part.path else _Frames.read(self, part)


class _Stream(_Frames, DataSourceStreamReader):
    """Videos in the order of their times of change, then of their paths. An offset is the last video's; files that are moved into the
    folder whole, with a time of change of their own, are seen once each. A video that breaks is always a row with an error."""

    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.rows = True

    def initialOffset(self) -> dict:
        return {"changed": 0, "path": ""}

    def latestOffset(self) -> dict:
        files = self.files()
        return {"changed": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        after, upto = ((o["changed"], o["path"]) for o in (start, end))
        return self.segments([f for f in self.files() if after < f[:2] <= upto])

    def read(self, part: Segment) -> Iterator[pa.RecordBatch]:
        return _Frames.read(self, part)


class FrameSource(DataSource):
    """``spark.read.format("tessera_frames")`` and ``spark.readStream.format(...)``, once register() was called."""

    @classmethod
    def name(cls) -> str:
        return "tessera_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FrameSource)
