"""Plain Lloyd clustering of vectors in whole numbers: every sum, distance and centroid is exact.

The centroids, a bounded number of short rows, go to all tasks; each task finds the nearest one of each of its
vectors and keeps whole sums by centroid, which meet in one aggregation. No vector is shuffled or gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

#: Components are kept within this, so that no squared distance of 64 components leaves 64 bits.
MOST = 1 << 27
#: Rows whose differences from a centroid a task holds at once.
TOGETHER = 4096


def quantised(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """(vec_id, v array<bigint>) of the vectors with ``dim`` components that are all finite: floor(scale * x), within MOST."""
    x = lambda e: e.cast("double")
    finite = lambda e: F.coalesce((x(e) > float("-inf")) & (x(e) < float("inf")), F.lit(False))  # noqa: E731  NaN is above infinity
    whole = F.transform("embedding", lambda e: F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), F.floor(x(e) * scale).cast("double"))).cast("long"))
    good = (F.size("embedding") == dim) & F.forall("embedding", finite)
    return vectors.where(F.coalesce(good, F.lit(False))).select("vec_id", whole.alias("v"))


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid of each row; of equally near ones the smallest number."""
    number, distance = np.zeros(len(v), np.int64), np.zeros(len(v), np.int64)
    for s in range(0, len(v), TOGETHER):
        some = v[s : s + TOGETHER]
        away = np.stack([((some - c) ** 2).sum(1) for c in centroids], axis=1)
        number[s : s + TOGETHER] = away.argmin(1)
        distance[s : s + TOGETHER] = away.min(1)
    return number, distance


def _rows(batch: pd.DataFrame) -> np.ndarray:
    return np.stack(batch["v"].to_list()).astype(np.int64)


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of ``seed:vec_id``; of equal ones the smaller vector first, a null id last."""
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    found = rows.select(named.alias("name"), "v").orderBy(F.col("name").asc_nulls_last(), "v").limit(k).collect()  # k rows
    return np.array([r["v"] for r in found], np.int64)


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: the floors of their vectors' means; one without vectors stays."""
    k, dim = centroids.shape

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            v = _rows(batch)
            number, _ = nearest(v, centroids)
            n += np.bincount(number, minlength=k)
            for c in np.unique(number):
                total[c] += v[number == c].sum(0)
        # One row a centroid and component, and its count as one component more.
        yield pd.DataFrame({"cluster": np.repeat(np.arange(k), dim + 1), "axis": np.tile(np.arange(dim + 1), k), "total": np.hstack([total, n[:, None]]).reshape(-1)})

    parts = rows.select("v").mapInPandas(sums, "cluster int, axis int, total bigint")
    found = np.zeros((k, dim + 1), np.int64)
    for r in parts.groupBy("cluster", "axis").agg(F.sum("total").alias("total")).collect():  # k * (dim + 1) rows at most
        found[r["cluster"], r["axis"]] = r["total"]
    n = found[:, dim:]
    return np.where(n > 0, found[:, :dim] // np.maximum(n, 1), centroids)


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of the vectors that are kept, and the final centroids (a row each).

    Kept are rows of ``vectors`` (vec_id, embedding, ...) with exactly ``dim`` components, none null, NaN or
    infinite; components are floor(scale * x), held within 2 to the 27th. Fewer than ``k`` kept vectors give as many
    centroids; none, or an empty table, no row. Repeated rows are vectors of their own, also as first centroids; a null
    vec_id takes part like any other, but comes last among the first centroids. Other columns are ignored. Jobs for the
    first centroids and the rounds run when this is called.
    """
    rows = quantised(vectors, dim, scale)
    centroids = first_centroids(rows, k, seed).reshape(-1, dim)
    if not len(centroids):
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    for _ in range(rounds):
        centroids = moved(rows, centroids)

    def assigned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            number, distance = nearest(_rows(batch), centroids)
            yield pd.DataFrame({"vec_id": batch["vec_id"], "cluster": number, "distance": distance})

    # As text an id stays what it is: whole numbers with a null among them would become inexact ones in pandas.
    named = rows.select(F.col("vec_id").cast("string").alias("vec_id"), "v").mapInPandas(assigned, "vec_id string, cluster int, distance bigint")
    return named.withColumn("vec_id", F.col("vec_id").cast(rows.schema["vec_id"].dataType)), centroids


def report(vectors: DataFrame, **options: int) -> DataFrame:
    """cluster() with cluster_inertia, inertia (distances summed over the cluster and over all) and centroid_sha256."""
    found, centroids = cluster(vectors, **options)
    found = cut(found)
    names = [(c, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.tolist())]
    names = found.sparkSession.createDataFrame(names, "cluster int, centroid_sha256 string")
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = sums.agg(F.sum("cluster_inertia")).first()[0]
    of = names.join(sums, "cluster").withColumn("inertia", F.lit(total).cast("long"))  # a row a centroid
    return found.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1) -> str:
    """DuckDB SQL for report()."""
    near = f"""(SELECT vec_id, v, (d % {k})::INT AS cluster, (d // {k})::BIGINT AS distance FROM (
      SELECT r.vec_id, any_value(r.v) AS v, min(list_sum(list_transform(range(1, {dim + 1}), lambda i: (r.v[i] - c.v[i]) * (r.v[i] - c.v[i])))::HUGEINT * {k} + c.c) AS d FROM kept r, {{0}} c GROUP BY r.vec_id))"""
    parts = [f"""kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c, v FROM kept QUALIFY c < {k}
)"""]  # fmt: skip
    for r in range(rounds):
        parts.append(f"""a{r} AS MATERIALIZED {near.format(f"c{r}")}, m{r} AS (
  SELECT cluster, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS x FROM (
    SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY cluster, i)
), c{r + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (SELECT cluster, list(x ORDER BY i) AS v FROM m{r} GROUP BY cluster) m ON m.cluster = c.c
)""")
    last = f"c{rounds}"
    return f"WITH {', '.join(parts)}, a AS {near.format(last)}" + f"""
SELECT a.vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a JOIN {last} c ON c.c = a.cluster"""
