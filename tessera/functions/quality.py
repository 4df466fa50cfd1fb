"""Objective measures of small grey tiles (row-major arrays of 0 to 255) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import BLURRY, BRIGHT, BRIGHT_SHARE, DARK, DARK_SHARE, EXPOSURE_BAND, OVER, SHARPNESS_MIN, UNDER


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), use), 0)


def laplacian(pixels: Column, side: int = 8) -> Column:
    """The four-neighbour Laplacian of a square tile, mirrored at its borders without repeating them."""
    low = lambda k: F.abs(k - 1)
    high = lambda k: (side - 1) - F.abs((side - 1) - (k + 1))

    def at(p: Column, i: Column) -> Column:
        r, c = F.floor(i / side).cast("int"), i % side
        get = lambda y, x: F.get(p, y * side + x)
        return get(low(r), c) + get(high(r), c) + get(r, low(c)) + get(r, high(c)) - 4 * F.get(p, i)

    return bound(pixels, lambda p: F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: at(p, i)))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + x)


def variance(values: Column) -> Column:
    """Population variance of whole numbers, exact: (n * sum of squares - square of sum) / n²."""
    def of(v: Column) -> Column:
        squares, plain, n = total(F.transform(v, lambda x: x * x)), total(v), F.size(v)
        return (n * squares - plain * plain).cast("double") / (n * n).cast("double")
    return bound(values, of)


def share(pixels: Column, test) -> Column:
    return F.size(F.filter(pixels, test)).cast("double") / F.size(pixels)


def over_share(pixels: Column) -> Column:
    return share(pixels, lambda x: x > BRIGHT)


def under_share(pixels: Column) -> Column:
    return share(pixels, lambda x: x < DARK)


def brightness(pixels: Column) -> Column:
    return total(pixels).cast("double") / F.size(pixels)


def exposure_score(mean: Column) -> Column:
    """1 within the band of brightness, falling to 0 over 128 levels outside it."""
    low, high = EXPOSURE_BAND
    away = F.when(mean < low, low - mean).when(mean > high, mean - high).otherwise(0.0)
    return F.when(away == 0.0, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - away / 128.0))


def noise_score(mean: Column, sharpness: Column) -> Column:
    """Brightness over the deviation of the Laplacian, a hundredth of it, 1 at most (1 without deviation)."""
    return F.when(sharpness == 0.0, 1.0).otherwise(F.least(mean / F.sqrt(sharpness) / 100.0, F.lit(1.0)))


def overall_score(sharpness: Column, exposure: Column, noise: Column) -> Column:
    return F.least(sharpness / 500.0, F.lit(1.0)) * 0.4 + exposure * 0.3 + noise * 0.3


def reasons(sharpness: Column, over: Column, under: Column) -> Column:
    return F.filter(
        F.array(F.when(sharpness < SHARPNESS_MIN, BLURRY), F.when(over > BRIGHT_SHARE, OVER), F.when(under > DARK_SHARE, UNDER)),
        lambda r: r.isNotNull(),
    )
