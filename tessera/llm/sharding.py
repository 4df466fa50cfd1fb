"""Shards cut from a Hilbert curve through several metadata dimensions.

Each dimension is quantised by its own percentiles (strings by the order of their whole values), the cells are ordered along the curve, and the order is
cut into runs of equally many rows: rows near in all dimensions share a shard, so that a reader's bounds on
any of them prune files. Cells are few (bounded by the levels); rows are ranked in slices of cells, so that
a cell with any share of all rows is no task's burden.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import constants, cut

BITS, SLICES = 4, 10_000


def firsts(rows: DataFrame, column: str, levels: int) -> list[str]:
    """The first string of each level after the lowest, by the order of whole strings; null comes before all others.

    A string's level is that share of ``levels`` by which rows lie before it. Distinct strings are range-sorted
    partitions, each counted after those before it; what comes to the driver are ``levels`` strings at most.
    """
    values = rows.groupBy(column).agg(F.count("*").alias("n")).repartitionByRange(F.col(column).asc_nulls_first())
    parts = cut(values.withColumn("part", F.spark_partition_id()))
    before = parts.groupBy("part").agg(F.sum("n").alias("all"))
    before = before.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before"))  # a row a partition
    within = F.sum("n").over(Window.partitionBy("part").orderBy(F.col(column).asc_nulls_first())) - F.col("n")
    placed = parts.withColumn("within", within).join(F.broadcast(before), "part").withColumn("at", F.col("before") + F.col("within"))
    n = rows.count()
    found = placed.agg(*[F.min(F.when(F.col("at") * levels >= k * n, F.col(column))) for k in range(1, levels)]).first()
    return [f for f in found if f is not None]


def hilbert(axes: int, bits: int) -> list[int]:
    """The place on the curve of every cell (first coordinate in the lowest bits), after Skilling (2004)."""
    x = [[cell >> bits * a & (1 << bits) - 1 for cell in range(1 << bits * axes)] for a in range(axes)]
    places = []
    for point in map(list, zip(*x)):
        for q in (1 << b for b in range(bits - 1, 0, -1)):
            for a in range(axes):
                if point[a] & q:
                    point[0] ^= q - 1
                else:
                    swap = (point[0] ^ point[a]) & (q - 1)
                    point[0], point[a] = point[0] ^ swap, point[a] ^ swap
        for a in range(1, axes):
            point[a] ^= point[a - 1]
        turn = 0
        for q in (1 << b for b in range(bits - 1, 0, -1)):
            turn ^= (q - 1) * bool(point[-1] & q)
        places.append(sum(((c ^ turn) >> b & 1) << (b * axes + axes - 1 - a) for b in range(bits) for a, c in enumerate(point)))
    return places


def layout(docs: DataFrame, shards: int = 40, bits: int = BITS, keep: bool = False) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, hilbert[, row]) for every row of ``docs``.

    docs: doc_id, text, and the dimensions source and lang where present; the third is the text's length.
    Law ``rows``: row counts of shards are at most one apart; slots are gapless from 0. Null texts have no
    bytes and no length, null strings come before all others; equal rows get slots of their own in any order;
    an empty table gives an empty result. keep: with a struct of the row's own columns. Jobs for the bounds run
    when this is called.
    """
    dims = [F.col(c).cast("string") for c in ("source", "lang") if c in docs.columns]
    dims.append(F.coalesce(F.length("text"), F.lit(-1)).cast("double"))
    axes = [f"x{i}" for i in range(len(dims))]
    text = F.coalesce("text", F.lit(""))
    rows = cut(docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"), *[d.alias(a) for d, a in zip(dims, axes)], *[F.struct(*docs.columns).alias("row")] * keep, F.monotonically_increasing_id().alias("_at")))
    levels = 1 << bits
    shares = [k / levels for k in range(1, levels)]
    bounds = rows.agg(F.count("*").alias("n"), F.percentile_approx(axes[-1], shares, 10_000).alias("length")).first()
    n = max(1, bounds["n"])
    over = {a: [F.col(a) >= f for f in firsts(rows, a, levels)] for a in axes[:-1]}
    over[axes[-1]] = [F.col(axes[-1]) > b for b in sorted(set(bounds["length"] or []))]
    level = lambda a: sum((F.coalesce(x.cast("long"), F.lit(0)) for x in over[a]), F.lit(0).cast("long"))
    cell = sum((level(a) * levels**i for i, a in enumerate(axes)), F.lit(0).cast("long"))
    rows = rows.withColumn("cell", cell).drop(*axes)
    # Both tables are bounded by the number of cells, and by SLICES more.
    full = max(500, n // SLICES)
    curve = constants(hilbert(len(axes), bits))
    rows = rows.withColumn("hilbert", F.get(curve, F.col("cell").cast("int"))).drop("cell")
    cells = rows.groupBy("hilbert").agg(F.ceil(F.count("*") / full).cast("int").alias("slices"))
    rows = rows.join(F.broadcast(cells), "hilbert").withColumn("slice", F.pmod(F.xxhash64("doc_id", "_at"), "slices").cast("int"))
    before = rows.groupBy("hilbert", "slice").agg(F.count("*").alias("n"))
    before = before.select("hilbert", "slice", (F.sum("n").over(Window.orderBy("hilbert", "slice")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("hilbert", "slice").orderBy("doc_id", "text_crc32", "size"))
    rows = rows.withColumn("_in", within).join(F.broadcast(before), ["hilbert", "slice"]).withColumn("rank", F.col("before") + F.col("_in") - 1)
    shard = F.expr(f"(rank * {shards}) div {n}").cast("int")
    start = F.expr(f"(shard * {n}L + {shards - 1}) div {shards}")
    out = rows.withColumn("shard", shard).withColumn("slot", F.col("rank") - start)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert", *["row"] * keep)


def write(docs: DataFrame, path: str, shards: int = 40) -> None:
    """Write every row of ``docs`` into one folder of Parquet files a shard, in the order of slots.

    Rows with null or repeated ids are written each. Columns of ``docs`` named shard or slot are written as the
    new ones.
    """
    placed = layout(docs, shards, keep=True)
    full = placed.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in ("shard", "slot")], "shard", "slot")
    full.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
