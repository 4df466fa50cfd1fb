"""Joins by Hamming distance of 64-bit fingerprints, through a metric index of pivots.

Pivots are fingerprints of the table; an item's home is the cell of its nearest pivot. By the triangle inequality two
items within r bits have distances to any pivot that differ by r at most, and the one's distance to the other's pivot
exceeds that to its own by 2 r at most. So an item visits only the cells where its distance meets some item's, and
in a cell it is compared only with the items whose distances to the pivot are near its own. Items within r / 2 of one
pivot are within r of each other, and needn't be compared where links are asked for. Cells and their visitors are
dealt into chunks, and pairs of chunks are groups of their own: a block or a cell of any size is spread over as many
tasks as it needs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut
from .graph import components, forest

#: Rows of a side of a group, about; pivots at most; rows compared at once; fingerprints that pivots are chosen from.
CHUNK, PIVOTS, AT_ONCE, SAMPLE = 4096, 1024, 128, 4096
#: Compared pairs that cost as much as sending an item to one more cell; rows of a task that compares groups, and of one that sends items to them, about.
SENT, ROWS, SENDS = 500, 1 << 16, 1 << 19
#: Pairs of a group that are held at once, about; where a part of a group has more, AT_ONCE * CHUNK.
PART = 1 << 18


def distances(h: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Bits that differ, a row an item and a column a pivot."""
    return np.bitwise_count(h.view(np.uint64)[:, None] ^ pivots.view(np.uint64)[None, :]).astype(np.int16)


def chosen(sample: np.ndarray, k: int) -> np.ndarray:
    """``k`` pivots of a sample of fingerprints: the first half as they come, so that many near items have one, then the one
    farthest from those chosen, again and again, so that few items are far from all."""
    pivots = list(range(min(len(sample), (k + 1) // 2)))
    away = distances(sample, sample[pivots]).min(1) if pivots else np.zeros(0, np.int16)
    while len(pivots) < min(k, len(sample)) and away.max() > 0:
        pivots.append(int(away.argmax()))
        away = np.minimum(away, distances(sample, sample[pivots[-1:]])[:, 0])
    return sample[pivots]


def planned(sample: np.ndarray, n: int, bits: int, sure: bool) -> np.ndarray:
    """Pivots for ``n`` items like ``sample``: of several numbers of them that of least work, for cells that are visited and pairs that are compared."""
    best = (math.inf, sample[:1])
    k = 1
    while k <= min(PIVOTS, max(1, len(sample) // 2)):
        pivots = chosen(sample, k)
        d = distances(sample, pivots)
        home = d.argmin(1)
        count = np.zeros((len(pivots), 65), np.int64)
        np.add.at(count, (home, d[np.arange(len(d)), home]), 1)
        upto = np.concatenate([np.zeros((len(pivots), 1), np.int64), np.cumsum(count, axis=1)], axis=1)
        cell = np.arange(len(pivots))[None, :]
        in_reach = upto[cell, np.minimum(d + bits, 64) + 1] - upto[cell, np.maximum(d - bits, 0)]
        goes = visited(d, home, np.full(len(d), len(pivots)), count > 0, bits)
        inner = 2 * d[np.arange(len(d)), home] <= bits
        balls = np.bincount(home[inner], minlength=len(pivots))[home] * inner * sure
        met = (in_reach[np.arange(len(d)), home] - balls) / 2 + (in_reach * goes).sum(1)
        work = n * (SENT * goes.sum(1).mean() + n * met.mean() / len(sample)) + n * len(pivots)
        best = min(best, (work, pivots), key=lambda x: x[0])
        k *= 2
    return best[1]


def _masks(homes: DataFrame, n: int) -> np.ndarray:
    """For each cell and distance whether a home item lies at it."""
    there = np.zeros((n, 65), bool)
    for r in homes.groupBy("_cell", "_d").agg(F.count("*")).collect():  # 65 rows a pivot at most
        there[r["_cell"], r["_d"]] = True
    return there


def visited(d: np.ndarray, home: np.ndarray, k: np.ndarray, there: np.ndarray, bits: int) -> np.ndarray:
    """Which cells after its own each item visits; d: distances, home: cell, k: pivots of the item's block, there: see _masks()."""
    low, high = np.maximum(d - bits, 0), np.minimum(d + bits, 64)
    seen = np.concatenate([np.zeros((len(there), 1), np.int32), np.cumsum(there, axis=1, dtype=np.int32)], axis=1)
    cell = np.arange(d.shape[1])
    some = seen[cell[None, :], high + 1] > seen[cell[None, :], low]
    own = d[np.arange(len(d)), home]
    return some & (d <= (own + 2 * bits)[:, None]) & (cell[None, :] > home[:, None]) & (cell[None, :] < k[:, None])


def _celled(items: DataFrame, large: DataFrame, pivots: np.ndarray, bits: int) -> DataFrame:
    """``items`` at home (_home) and in the cells they visit: _cell, _d (distance to its pivot), _k (pivots of the block: all in the ``large`` ones, else one)."""
    large = large.select("_block", F.lit(len(pivots)).alias("_k"))  # fewer than one for a chunk of rows
    items = items.join(F.broadcast(large), "_block", "left").withColumn("_k", F.coalesce("_k", F.lit(1)))

    def home_of(h: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = distances(h, pivots)
        return d, np.where(np.arange(len(pivots))[None, :] < k[:, None], d, 99).argmin(1)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(s, 512) for b in batches for s in range(0, len(b), 512)):
            column = lambda c: batch.column(batch.schema.get_field_index(c))
            d, cell = home_of(column("h").to_numpy(), column("_k").to_numpy())
            own = d[np.arange(len(d)), cell]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(own.astype(np.int32))], [*batch.schema.names, "_cell", "_d"])

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema) + ", _cell int, _d int"
    at_home = cut(items.mapInArrow(homes, kind))
    rows = at_home.withColumn("_home", F.lit(True))
    there, out = _masks(at_home, len(pivots)), rows.columns

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(s, 512) for b in batches for s in range(0, len(b), 512)):
            column = lambda c: batch.column(batch.schema.get_field_index(c))
            d = distances(column("h").to_numpy(), pivots)
            i, cell = np.nonzero(visited(d, column("_cell").to_numpy(), column("_k").to_numpy(), there, bits))
            moved = {"_cell": pa.array(cell.astype(np.int32)), "_d": pa.array(d[i, cell].astype(np.int32)), "_home": pa.array(np.zeros(len(i), bool))}
            yield pa.RecordBatch.from_arrays([moved[c] if c in moved else column(c).take(pa.array(i)) for c in out], out)

    return cut(rows.unionByName(at_home.mapInArrow(visits, kind + ", _home boolean")))


def _dealt(items: DataFrame, block: list[str], bits: int, chunk: int, sure: bool = False) -> DataFrame:
    """``items`` (id, h, ...) as members of groups (_block, _cell, _i, _j): those with _c = _i meet those with _c = _j; _d: distance to the pivot.

    Chunks of home items are numbered from 0, of visitors from -1 down.
    """
    items = items.where("h is not null").withColumn("_block", F.to_json(F.struct(*block)) if block else F.lit(""))
    sizes = cut(items.groupBy("_block").agg(F.count("*").alias("_n")))
    most = sizes.agg(F.max("_n")).first()[0] or 0
    names, pivots = [c for c in items.columns if c != "_block"], np.zeros(1, np.int64)  # one cell: distances to 0 are bit counts
    if most > chunk:
        found = items.select("h").distinct().orderBy(F.xxhash64("h"), "h").limit(SAMPLE).collect()  # SAMPLE numbers at most
        pivots = planned(np.array([r["h"] for r in found], np.int64), most, bits, sure)
    if len(pivots) == 1:
        rows = items.withColumns({"_k": F.lit(1), "_cell": F.lit(0), "_d": F.bit_count(F.col("h").bitwiseXOR(F.lit(int(pivots[0])))), "_home": F.lit(True)})
        counts = sizes.select("_block", F.lit(0).alias("_cell"), F.col("_n").alias("_a"), F.lit(0).alias("_b"))
    else:
        rows = _celled(items, sizes.where(F.col("_n") > chunk), pivots, bits)
        counts = cut(rows.groupBy("_block", "_cell").agg(F.count_if("_home").alias("_a"), F.count_if(~F.col("_home")).alias("_b")))
    parts = counts.select("_block", "_cell", "_a", "_b", F.ceil(F.col("_a") / chunk).cast("int").alias("_s"), F.ceil(F.col("_b") / chunk).cast("int").alias("_t"))
    total = parts.agg(F.sum(F.col("_a") * (F.col("_s") + F.col("_t")) + F.col("_b") * F.col("_s"))).first()[0] or 0
    # Only cells of more than a chunk are looked up, fewer than one for a chunk of rows; others are a chunk and one of visitors.
    large = parts.where((F.col("_a") > chunk) | (F.col("_b") > chunk)).select("_block", "_cell", "_s", "_t")
    rows = rows.join(F.broadcast(large), ["_block", "_cell"], "left")
    rows = rows.withColumns({"_s": F.coalesce("_s", F.lit(1)), "_t": F.coalesce("_t", (F.col("_k") > 1).cast("int"))})
    rows = rows.where("_s > 0")  # a cell without a home item in this block has nothing to visit
    if total > SENDS:  # a task that sends an item to all chunks holds what it sends
        rows = rows.repartition(math.ceil(total / SENDS), "id")
    number = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    rows = rows.withColumn("_c", F.when(F.col("_home"), number(F.col("_s"))).otherwise(-1 - number(F.greatest("_t", F.lit(1)))))
    each = lambda n: F.sequence(F.lit(0), n - 1)
    own = F.transform(each(F.col("_s")), lambda x: F.struct(F.least("_c", x).alias("i"), F.greatest("_c", x).alias("j")))
    guests = F.when(F.col("_t") > 0, F.transform(each(F.col("_t")), lambda x: F.struct(F.col("_c").alias("i"), (-1 - x).alias("j")))).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
    visit = F.transform(each(F.col("_s")), lambda x: F.struct(x.alias("i"), F.col("_c").alias("j")))
    pairs_ = F.when(F.col("_home"), F.concat(own, guests)).otherwise(visit)
    rows = rows.withColumn("_p", F.explode(pairs_)).select(*names, "_block", "_cell", "_d", "_c", F.col("_p.i").alias("_i"), F.col("_p.j").alias("_j"))
    # Rows that lie by cell would count as grouped, and one task would hold all groups of a cell.
    return rows.repartition(max(1, math.ceil(total / ROWS)), "_block", "_cell", "_i", "_j")


def _met(group: pa.Table, bits: int, sure: bool) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Index pairs of a group at ``bits`` bits or fewer, the smaller index first, and how many pairs were compared, at most AT_ONCE * CHUNK at a time.

    sure: items within bits / 2 of the pivot are not compared with each other, but all paired with the first of them.
    """
    h, d, c = (group.column(k).to_numpy() for k in ("h", "_d", "_c"))
    h, i, j = h.view(np.uint64), group.column("_i")[0].as_py(), group.column("_j")[0].as_py()
    order = np.argsort(d, kind="stable")
    a, b = order[c[order] == i], order[c[order] == j]
    inner = 2 * d <= bits if sure else np.zeros(len(d), bool)
    first, last = np.searchsorted(d[b], d[a] - bits, "left"), np.searchsorted(d[b], d[a] + bits, "right")
    balls = int(inner[a].sum())  # they come first, in a and in b
    balls_b = int(inner[b].sum())
    steps = np.union1d(np.flatnonzero(np.diff(d[a], prepend=-1)), np.arange(0, len(a), AT_ONCE))  # rows of one distance have one reach
    for s, e in zip(steps, [*steps[1:], len(a)]):
        rows, low, high = a[s:e], int(first[s]), int(last[s])
        if sure and e <= balls:
            low = max(low, balls_b)
        for t in range(low, high, CHUNK):
            others = b[t : min(high, t + CHUNK)]
            near = np.bitwise_count(h[rows, None] ^ h[None, others]) <= bits
            if i == j:
                near &= np.arange(s, s + len(rows))[:, None] < np.arange(t, t + len(others))[None, :]
            x, y = np.nonzero(near)
            x, y = rows[x], others[y]
            yield np.minimum(x, y), np.maximum(x, y), near.size
    ball = np.sort(np.union1d(a[inner[a]], b[inner[b]])) if sure else np.zeros(0, np.int64)
    yield np.full(max(0, len(ball) - 1), ball[0] if len(ball) else 0), ball[1:], 0


def _parts(met: Iterator[tuple[np.ndarray, np.ndarray, int]], part: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The index pairs of _met(), those of several steps together until they are ``part``; once at least."""
    left, right, n = [], [], 0
    for x, y, _ in met:
        left.append(x)
        right.append(y)
        n += len(x)
        if n >= part:
            yield np.concatenate(left), np.concatenate(right)
            left, right, n = [], [], 0
    none = np.zeros(0, np.int64)
    yield np.concatenate([none, *left]), np.concatenate([none, *right])


def _joined(
    items: DataFrame, block: list[str], bits: int, chunk: int, order: str, compare: Callable[[pa.Table, np.ndarray, np.ndarray], pa.Table], schema: str, sure: bool,
    thin: Callable[[int, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None,
) -> DataFrame:
    """``compare`` on each group, its rows along ``order``, with the index pairs at ``bits`` bits or fewer (or, sure, enough of them to link all).

    thin: of a group's size and some index pairs those that ``compare`` needs, fewer than rows, so that a group never holds all its pairs.
    """

    def one(group: pa.Table) -> pa.Table:
        group = group.sort_by([(order, "ascending"), ("id", "ascending")])
        x = y = np.zeros(0, np.int64)
        for more_x, more_y in _parts(_met(group, bits, sure), PART):
            x, y = np.concatenate([x, more_x]), np.concatenate([y, more_y])
            if thin:
                x, y = thin(len(group), x, y)
        return compare(group, x, y)

    return _dealt(items, block, bits, chunk, sure).groupBy("_block", "_cell", "_i", "_j").applyInArrow(one, schema)


def compared(items: DataFrame, bits: int, block: list[str] = [], chunk: int = CHUNK, sure: bool = True) -> int:  # noqa: B006
    """How many pairs of items (id, h, block columns) a join compares."""

    def one(group: pa.Table) -> pa.Table:
        return pa.table({"n": [sum(n for *_, n in _met(group.sort_by("id"), bits, sure))]})

    found = _dealt(items.select("id", "h", *block), block, bits, chunk, sure).groupBy("_block", "_cell", "_i", "_j").applyInArrow(one, "n bigint")
    return found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def pairs(items: DataFrame, bits: int, block: list[str] = [], chunk: int = CHUNK) -> DataFrame:  # noqa: B006
    """(a, b, distance) of items (id, h, block columns) at ``bits`` bits or fewer, a < b, nulls of a block equal.

    A group hands on its pairs part by part: one of copies has CHUNK * CHUNK of them.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(batches).sort_by("id")
        ids, h = group.column("id").to_numpy(), group.column("h").to_numpy().view(np.uint64)
        for x, y in _parts(_met(group, bits, False), PART):
            yield pa.RecordBatch.from_arrays([pa.array(ids[x]), pa.array(ids[y]), pa.array(np.bitwise_count(h[x] ^ h[y]).astype(np.int32))], ["a", "b", "distance"])

    groups = _dealt(items.select("id", "h", *block), block, bits, chunk).groupBy("_block", "_cell", "_i", "_j")
    return groups.applyInArrow(found, "a bigint, b bigint, distance int")


def clusters(items: DataFrame, bits: int, block: list[str] = [], chunk: int = CHUNK) -> DataFrame:  # noqa: B006
    """(id, cluster_id) of all items: the smallest id reachable over pairs; items without h stand alone.

    Items of one fingerprint are one item for the search. Jobs run when this is called.
    """

    def rooted(n: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        root = forest(n, x, y)
        linked = np.flatnonzero(root != np.arange(n))
        return root[linked], linked

    def found(group: pa.Table, x: np.ndarray, y: np.ndarray) -> pa.Table:
        ids = group.column("id").to_numpy()
        return pa.table({"a": ids[y], "b": ids[x]})

    known = items.where("h is not null").select("id", "h", *block)
    first = cut(known.groupBy("h", *block).agg(F.min("id").alias("id")))
    links = _joined(first.select("id", "h", *block), block, bits, chunk, "id", found, "a bigint, b bigint", True, rooted)
    same = F.lit(True)
    for c in ("h", *block):
        same = same & F.col(f"k.{c}").eqNullSafe(F.col(f"f.{c}"))
    copies = known.alias("k").join(first.alias("f"), same).where("k.id <> f.id").select(F.col("k.id").alias("a"), F.col("f.id").alias("b"))
    found_ids = components(links.union(copies), "a", "b").withColumnRenamed("component_id", "cluster_id")
    return items.select("id").join(found_ids, "id", "left").select("id", F.coalesce("cluster_id", "id").alias("cluster_id"))


def shadowed(items: DataFrame, bits: int, chunk: int = CHUNK) -> DataFrame:
    """(id) of items (id, h, rank) with an item of smaller rank fewer than ``bits`` bits away. Jobs run when this is called."""

    def first_met(n: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        least = np.arange(n)
        np.minimum.at(least, y, x)
        late = np.flatnonzero(least != np.arange(n))
        return least[late], late  # rows come by rank: if the first isn't of smaller rank, none is

    def found(group: pa.Table, x: np.ndarray, y: np.ndarray) -> pa.Table:
        ids, rank = group.column("id").to_numpy(), group.column("rank").to_numpy()
        return pa.table({"id": ids[y[rank[x] < rank[y]]]})

    known = items.where("h is not null").select("id", "h", "rank")
    if bits < 1:
        return known.select("id").limit(0)
    first = cut(known.groupBy("h").agg(F.min("rank").alias("least"), F.min_by("id", "rank").alias("id")))
    copies = known.join(first.select("h", "least"), "h").where("rank > least").select("id")
    late = _joined(first.select("id", "h", F.col("least").alias("rank")), [], bits - 1, chunk, "rank", found, "id bigint", True, first_met)
    # What shadows a fingerprint's first item shadows all its items.
    others = known.join(first.select("h", F.col("id").alias("_first")), "h").join(late.select(F.col("id").alias("_first")).distinct(), "_first").select("id")
    return copies.union(others).distinct()
