"""Decoded pictures in Arrow batches: grey levels, measures, fingerprints, smaller copies, clarity of a face."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BRIGHT, DARK
from .fingerprints import dct_hash_of

#: Weights of blue, green and red in a grey level, in parts of 2 to the 14th (fixed values of ITU-R BT.601).
GREY = np.array([1868, 9617, 4899], np.int64)
GREY_OF_HASH = np.array([7471, 38470, 19595], np.int64)
Decoder = Callable[[bytes], np.ndarray]


def grey(pixels: np.ndarray) -> np.ndarray:
    """Grey levels (0 to 255) of a picture: height x width x (blue, green, red[, alpha]), or grey already."""
    if pixels.ndim == 2 or pixels.shape[2] == 1:
        return pixels.reshape(pixels.shape[:2])
    return ((pixels[:, :, :3].astype(np.int64) @ GREY + (1 << 13)) >> 14).astype(np.uint8)


def laplacian(levels: np.ndarray) -> np.ndarray:
    """The four-neighbour Laplacian, mirrored at its borders without repeating them (one row or column: its own mirror)."""
    x = levels.astype(np.float64)
    up = np.pad(x, [(1, 1) if n > 1 else (0, 0) for n in x.shape], "reflect")
    if x.shape[0] == 1:
        up = np.repeat(up, 3, axis=0)
    if x.shape[1] == 1:
        up = np.repeat(up, 3, axis=1)
    return up[:-2, 1:-1] + up[2:, 1:-1] + up[1:-1, :-2] + up[1:-1, 2:] - 4 * x


def grey_of_hash(pixels: np.ndarray) -> np.ndarray:
    """Grey levels as the hash takes them: the same standard's weights in parts of 2 to the 16th."""
    if pixels.ndim == 2 or pixels.shape[2] == 1:
        return pixels.reshape(pixels.shape[:2])
    return ((pixels[:, :, :3].astype(np.int64) @ GREY_OF_HASH + (1 << 15)) >> 16).astype(np.uint8)


@lru_cache(maxsize=64)
def _lanczos(n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(first sample, weights) of each of ``m`` outputs from ``n`` samples: a Lanczos window of three lobes, widened where they get
    fewer, in whole parts of 2 to the 22nd."""
    scale = n / m
    wide = max(scale, 1.0)
    centre = (np.arange(m) + 0.5) * scale
    first = np.maximum((centre - 3 * wide + 0.5).astype(np.int64), 0)
    last = np.minimum((centre + 3 * wide + 0.5).astype(np.int64), n)
    at = first[:, None] + np.arange(int((last - first).max()))[None, :]
    away = (at - centre[:, None] + 0.5) / wide
    w = np.where((away >= -3) & (away < 3) & (at < last[:, None]), np.sinc(away) * np.sinc(away / 3), 0.0)
    w = w / w.sum(1, keepdims=True) * (1 << 22)
    return first, np.trunc(w + np.where(w < 0, -0.5, 0.5)).astype(np.int64)


def _narrowed(x: np.ndarray, m: int) -> np.ndarray:
    """The first axis brought to ``m``, in 8 bits."""
    n = x.shape[0]
    if n == m:
        return x
    first, weights = _lanczos(n, m)
    total = np.full((m, *x.shape[1:]), 1 << 21, np.int64)
    for k in range(weights.shape[1]):
        w = weights[:, k].reshape(-1, *[1] * (x.ndim - 1))
        total += w * x[np.minimum(first + k, n - 1)]
    return np.clip(total >> 22, 0, 255).astype(np.uint8)


def resized(levels: np.ndarray, height: int, width: int) -> np.ndarray:
    """A picture in another size, each channel by itself: columns first, then rows, in whole numbers with 8 bits between."""
    return _narrowed(np.swapaxes(_narrowed(np.swapaxes(levels, 0, 1), width), 0, 1), height)


def reduced(pixels: np.ndarray, most: int) -> np.ndarray:
    """A picture with its long side at ``most``; one that isn't larger stays as it is."""
    long = max(pixels.shape[:2])
    return pixels if long <= most else resized(pixels, *(max(1, int(s * (most / long))) for s in pixels.shape[:2]))


def png(pixels: np.ndarray) -> bytes:
    """A picture (blue, green, red, or one channel) as a PNG file of 8 bits a channel."""
    h, w = pixels.shape[:2]
    x = pixels.reshape(h, w, -1)
    x = np.ascontiguousarray(x[:, :, 2::-1] if x.shape[2] >= 3 else x[:, :, :1], np.uint8)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = np.concatenate([np.zeros((h, 1), np.uint8), x.reshape(h, -1)], axis=1)  # a zero before each line: no filter
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if x.shape[2] == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(lines.tobytes())) + part(b"IEND", b"")


def for_judge(pixels: np.ndarray, most: int = 1024) -> bytes:
    """A picture as it is sent to a judge: a PNG file with its long side at ``most`` at most."""
    return png(reduced(pixels, most))


def fingerprint(pixels: np.ndarray) -> int:
    """The signed 64-bit perceptual hash of a picture."""
    h = dct_hash_of(resized(grey_of_hash(pixels), 32, 32).astype(float))
    return h - (1 << 64) if h >> 63 else h


def clarity(levels: np.ndarray, x0: int, y0: int, x1: int, y1: int) -> float:
    """Sharpness of a box, 500 or more as 1; an empty box has 0."""
    crop = levels[max(0, y0) : y1, max(0, x0) : x1]
    return min(float(laplacian(crop).var()) / 500.0, 1.0) if crop.size else 0.0


def rows_of(batch: pa.RecordBatch) -> Iterator[np.ndarray | None]:
    """The pictures of a batch of height, width, channels and data, one after the other without a copy; None where one wasn't decoded."""
    height, width, channels, data = (batch.column(batch.schema.get_field_index(c)) for c in ("height", "width", "channels", "data"))
    for k in range(len(batch)):
        h, w, c, pixels = height[k].as_py(), width[k].as_py(), channels[k].as_py(), data[k].as_buffer() if data[k].is_valid else None
        whole = pixels is not None and h and h > 0 and w > 0 and pixels.size == h * w * c
        yield np.frombuffer(pixels, np.uint8).reshape(h, w, c) if whole else None


def decoded_by(files: DataFrame, decoder: Decoder, error: str) -> DataFrame:
    """``files`` (path, name, content) decoded by ``decoder`` (bytes to height x width x channels); a row that fails fails alone."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for content in batch.column(batch.schema.get_field_index("content")):
                try:
                    x = np.ascontiguousarray(decoder(content.as_py()), np.uint8)
                    x = x.reshape(*x.shape[:2], -1)
                    out.append((*x.shape, x.tobytes(), None))
                except Exception:
                    out.append((-1, -1, -1, None, error))
            h, w, c, data, bad = zip(*out) if out else [()] * 5
            made = [pa.array(h, pa.int32()), pa.array(w, pa.int32()), pa.array(c, pa.int32()), pa.array(data, pa.binary()), pa.array(bad, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["path", "name", "height", "width", "channels", "data", "error"])

    return files.select("path", "name", "content").mapInArrow(some, "path string, name string, height int, width int, channels int, data binary, error string")


def measures(pictures: DataFrame) -> DataFrame:
    """``pictures`` (path, name, height, width, channels, data, error) as path, name, error, sharpness, mean, over, under, h.

    Measures of a picture that wasn't decoded are null. One pass over the pixels; pictures never leave their task.
    """

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in rows_of(batch):
                g = None if x is None else grey(x)
                out.append([None] * 5 if g is None else [float(laplacian(g).var()), float(g.mean()), float((g > BRIGHT).mean()), float((g < DARK).mean()), fingerprint(x)])
            columns = list(zip(*out)) if out else [()] * 5
            made = [pa.array(c, pa.int64() if k == 4 else pa.float64()) for k, c in enumerate(columns)]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("path", "name", "error")]
            yield pa.RecordBatch.from_arrays([*kept, *made], ["path", "name", "error", "sharpness", "mean", "over", "under", "h"])

    rows = pictures.select("path", "name", "error", "height", "width", "channels", "data")
    return rows.mapInArrow(some, "path string, name string, error string, sharpness double, mean double, over double, under double, h bigint")


def smaller(pictures: DataFrame, most: int) -> DataFrame:
    """``pictures`` (path, name, height, width, channels, data, error) with long sides of ``most`` at most."""
    names = ["path", "name", "height", "width", "channels", "data", "error"]

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(-1, -1, -1, None) if x is None else (*x.shape, x.tobytes()) for x in (None if p is None else reduced(p, most) for p in rows_of(batch))]
            h, w, c, data = zip(*out) if out else [()] * 4
            made = [pa.array(h, pa.int32()), pa.array(w, pa.int32()), pa.array(c, pa.int32()), pa.array(data, pa.binary())]
            first, last = [batch.column(k) for k in (0, 1)], batch.column(6)
            yield pa.RecordBatch.from_arrays([*first, *made, last], names)

    return pictures.select(*names).mapInArrow(some, "path string, name string, height int, width int, channels int, data binary, error string")


def face_clarity(pictures: DataFrame) -> DataFrame:
    """``pictures`` (path, height, width, channels, data, main: struct of x0, y0, x1, y1) as path, clarity (0 without a face)."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            boxes = batch.column(batch.schema.get_field_index("main")).to_pylist()
            found = [0.0 if x is None or b is None else round(clarity(grey(x), b["x0"], b["y0"], b["x1"], b["y1"]), 4) for x, b in zip(rows_of(batch), boxes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["path", "clarity"])

    box = F.struct(*[F.col("main")[c].alias(c) for c in ("x0", "y0", "x1", "y1")])
    rows = pictures.select("path", "height", "width", "channels", "data", F.when(F.col("main").isNotNull(), box).alias("main"))
    return rows.mapInArrow(some, "path string, clarity double")
