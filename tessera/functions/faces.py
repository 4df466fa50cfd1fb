"""Geometry and expression of detected faces as column expressions.

A face is struct<landmarks: array<struct<x, y>>, blendshapes: map<string, double>>, with places as shares of
width and height.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config
from .quality import bound

FACE = "struct<landmarks:array<struct<x:double,y:double>>,blendshapes:map<string,double>>"


def _shape(face: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(face["blendshapes"], F.lit(name)), F.lit(0.0))


def blinks(face: Column) -> Column:
    return (_shape(face, "eyeBlinkLeft") > 0.5) | (_shape(face, "eyeBlinkRight") > 0.5)


def smile(face: Column) -> Column:
    return (_shape(face, "mouthSmileLeft") + _shape(face, "mouthSmileRight")) / 2


def boxes(faces: Column, width: Column, height: Column) -> Column:
    """The boxes of faces in whole pixels with their area, largest first; empty boxes are left out."""

    def box(face: Column, i: Column) -> Column:
        side = lambda pick, axis, size: F.floor(pick(F.transform(face["landmarks"], lambda p: p[axis])) * size).cast("int")
        x0, x1, y0, y1 = side(F.array_min, "x", width), side(F.array_max, "x", width), side(F.array_min, "y", height), side(F.array_max, "y", height)
        return F.struct((-(x1 - x0) * (y1 - y0)).alias("minus_area"), i.alias("i"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))

    some = F.filter(F.transform(faces, box), lambda b: (b["x1"] > b["x0"]) & (b["y1"] > b["y0"]))
    return F.array_sort(some)


def metrics(faces: Column, width: Column, height: Column) -> Column:
    """count, has_face, any_blink, main_blink, smile, ratio, second_ratio and the main face's box (null without)."""
    faces = F.coalesce(faces, F.array().cast(f"array<{FACE}>"))

    def of(b: Column) -> Column:
        area = lambda k: -F.get(b, k)["minus_area"]
        some = F.size(b) > 0
        return F.struct(
            F.size(faces).alias("face_count"),
            (F.size(faces) > 0).alias("has_face"),
            F.exists(faces, lambda f: blinks(f)).alias("any_blink"),
            F.coalesce(blinks(F.get(faces, F.get(b, 0)["i"])), F.lit(False)).alias("main_blink"),
            F.round(F.coalesce(F.greatest(F.lit(0.0), F.array_max(F.transform(faces, lambda f: smile(f)))), F.lit(0.0)), 4).alias("smile"),
            F.round(F.when(some, area(0) / (width * height)).otherwise(0.0), 4).alias("ratio"),
            F.round(F.when(F.size(b) > 1, area(1) / area(0)).otherwise(0.0), 4).alias("second_ratio"),
            F.get(b, 0).alias("main"),
        )

    return bound(boxes(faces, width, height), of)


def blinks_of(face: dict) -> bool:
    return any((face["blendshapes"] or {}).get(k, 0.0) > 0.5 for k in ("eyeBlinkLeft", "eyeBlinkRight"))


def measured(faces: list[dict], width: int, height: int, clarity: Callable[[int, int, int, int], float]) -> dict:
    """metrics() of one picture inside a task, where its pixels are at hand, with clarity (of the main face's box) and face_overall.

    A face is a dict of landmarks (dicts of x and y) and blendshapes.
    """
    boxes = []
    for i, f in enumerate(faces):
        x, y = ([p[k] for p in f["landmarks"]] for k in "xy")
        if x:
            x0, x1, y0, y1 = math.floor(min(x) * width), math.floor(max(x) * width), math.floor(min(y) * height), math.floor(max(y) * height)
            if x1 > x0 and y1 > y0:
                boxes.append((-(x1 - x0) * (y1 - y0), i, x0, y0, x1, y1))
    boxes.sort()
    shape = lambda f, k: (f["blendshapes"] or {}).get(k, 0.0)
    smile = max([0.0, *((shape(f, "mouthSmileLeft") + shape(f, "mouthSmileRight")) / 2 for f in faces)])
    main_blink = bool(boxes) and blinks_of(faces[boxes[0][1]])
    clear = clarity(*boxes[0][2:]) if boxes else 0.0
    return {
        "face_overall": round(clear * 0.5 + smile * 0.3 + (0.0 if main_blink else 0.2), 4) if faces else 0.0, "face_count": len(faces),
        "ratio": round(-boxes[0][0] / (width * height), 4) if boxes else 0.0, "clarity": round(clear, 4), "second_ratio": round(boxes[1][0] / boxes[0][0], 4) if len(boxes) > 1 else 0.0,
        "any_blink": any(map(blinks_of, faces)), "main_blink": main_blink, "has_face": bool(faces),
    }


def described(m: dict) -> str:
    """scores.face_summary() of one picture inside a task."""
    if not m["face_count"]:
        return config.FACES_NONE
    near, half, far = config.FACE_SIZES
    sharp, soft, blurred, small = config.FACE_CLEAR
    yes = {True: config.YES, False: config.NO}
    words = {
        "count": m["face_count"], "main": yes[m["main_blink"]], "some": yes[m["any_blink"]], "size": near if m["ratio"] >= 0.30 else half if m["ratio"] >= 0.10 else far,
        "clear": small if m["ratio"] < 0.10 else sharp if m["clarity"] >= 0.15 else soft if m["clarity"] >= 0.10 else blurred,
    }
    spread = 0 if m["second_ratio"] >= 0.7 else 1 if m["second_ratio"] < 0.5 else 2
    few = (config.FACES_FEW_EVEN, config.FACES_FEW_APART, config.FACES_FEW_UNLIKE)
    many = (config.FACES_MANY_EVEN, config.FACES_MANY_APART, config.FACES_MANY_UNLIKE)
    return (config.FACES_ONE if m["face_count"] == 1 else (few if m["face_count"] <= 9 else many)[spread]).format(**words)
