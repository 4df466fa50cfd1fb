"""64-bit fingerprints: hexadecimal form, distance, sign bits of a vector, DCT hash of a grey picture."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def to_hex(h: Column) -> Column:
    return F.lpad(F.lower(F.hex(h)), 16, "0")


def from_hex(x: Column) -> Column:
    return F.conv(x, 16, -10).cast("long")


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def sign_bits(vector: Column) -> Column:
    """Bit i is set where component i is positive (the first 64 components)."""
    bits = F.transform(F.slice(vector, 1, 64), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(b))


@lru_cache(maxsize=2)
def _dct(n: int) -> np.ndarray:
    k = np.arange(n)
    return np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))


def dct_hash_of(gray: np.ndarray) -> int:
    """The perceptual hash of a 32 x 32 grey picture: low 8 x 8 cosine coefficients above their median, first bit highest."""
    low = (_dct(32) @ gray @ _dct(32).T)[:8, :8]
    bits = (low > np.median(low)).reshape(-1)
    return int(sum(int(b) << (63 - i) for i, b in enumerate(bits)))


def dct_hashes_of(gray: np.ndarray) -> np.ndarray:
    """The signed hashes of n x 32 x 32 grey pictures, all at once."""
    low = (_dct(32)[:8] @ gray @ _dct(32)[:8].T).reshape(-1, 64)
    return np.packbits(low > np.median(low, axis=1, keepdims=True), axis=1).view(">u8").astype(np.uint64).view(np.int64).reshape(-1)


@F.pandas_udf(LongType())
def dct_hash(gray: pd.Series) -> pd.Series:
    """Of BINARY columns of 1024 grey bytes; null where the size is another."""
    good = gray.map(lambda b: b is not None and len(b) == 1024).astype(bool)
    out = pd.Series(pd.NA, gray.index, "Int64")
    if good.any():
        out[good] = dct_hashes_of(np.frombuffer(b"".join(gray[good]), np.uint8).reshape(-1, 32, 32).astype(float))
    return out
