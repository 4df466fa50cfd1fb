"""Link forests within a task, and connected components across all of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` vertices over the edges ``i[k] - j[k]``."""
    root = np.arange(n)
    while len(i):
        before = root.copy()
        np.minimum.at(root, i, before[j])
        np.minimum.at(root, j, before[i])
        root = root[root]
        if (root == before).all():
            break
    return root


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component_id) of every vertex of an undirected graph but the smallest of each component.

    Alternating large-star and small-star steps: each halves the distance to the smallest vertex, and a
    vertex never gathers its neighbours (only their minimum, pre-aggregated). Each round is cut by a
    written table; the loop ends when a round leaves the set of edges as it was.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now, mark = cut(now), None
    while True:
        now_mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now_mark == mark or not now_mark[0]:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
        mark = now_mark
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct(), instead_of=now)
