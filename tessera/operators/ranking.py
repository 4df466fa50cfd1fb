"""Ranks, order statistics, batch stretching, cluster summaries and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import cut


def order_statistic(df: DataFrame, column: str, k: int, enough: int = 10_000) -> float:
    """The k-th smallest value (from 0), exactly, in the engine's order: infinities at the ends, NaN after all; nulls don't count.

    Ranges are counted and narrowed until few rows are left. Each pass leaves a 1024th of the range, so that
    passes end whatever the values; ``df`` is read once a pass (cut it first).
    """
    v, big = F.col(column), float("inf")
    ends = df.agg(F.count_if(v == -big), F.count_if(~F.isnan(v) & (v > -big) & (v < big)), F.count_if(v == big), F.count_if(F.isnan(v))).first()
    for value, n in zip((-big, None, big, float("nan")), ends):
        if k < n:
            break
        k -= n
    else:
        raise IndexError("fewer values than the place that is asked for")
    if value is not None:
        return value
    df = df.where(~F.isnan(v) & (v > -big) & (v < big))
    while True:
        low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
        if low == high or n <= enough:
            return low if low == high else df.select(column).orderBy(column).offset(k).limit(1).first()[0]
        step = high / 1024 - low / 1024
        # Without a step fewer than 1024 numbers lie between the ends: each is a range of its own.
        place = F.greatest(F.lit(0.0), F.least(F.floor(v / step - low / step).cast("double"), F.lit(1023.0))) if step else v
        for r in sorted(df.groupBy(place.alias("p")).agg(F.count("*").alias("n")).collect()):  # 1024 rows at most
            if k < r["n"]:
                df = df.where(place == r["p"])
                break
            k -= r["n"]


def percentiles(df: DataFrame, group: str, column: str, share: float, enough: int = 10_000) -> DataFrame:
    """(group, n, value): of each group the number of its values and their percentile ``share`` (0 to 1), interpolated between two
    places as the engine's ``percentile`` does; nulls don't count, infinities lie at the ends and NaN after all.

    All groups at once: ranges are counted by (group, range), with sums combined before the shuffle, and narrowed to the one
    that holds the place, until ``enough`` values are left of each group. So a group with any share of all rows is no task's burden.
    Each pass leaves a 1024th of a group's range. The next place's value is the least above, found in one pass more.
    """
    v, big = F.col("v"), float("inf")
    finite = ~F.isnan("v") & (v > -big) & (v < big)
    some = cut(df.select(F.col(group).alias("g"), F.col(column).cast("double").alias("v")).where("v is not null"))
    of = some.groupBy("g").agg(
        F.count("*").alias("n"), F.count_if(v == -big).alias("low_n"), F.count_if(finite).alias("count"), F.count_if(v == big).alias("high_n"),
        F.min(F.when(finite, v)).alias("low"), F.max(F.when(finite, v)).alias("high"),
    )
    place = F.lit(share) * (F.col("n") - 1)
    of = of.withColumns({"k": F.floor(place), "part": place - F.floor(place)})
    # The place among the finite values, or the value itself where it is none of these.
    of = of.withColumn("at", F.col("k") - F.col("low_n")).withColumn("odd", F.when(F.col("at") < 0, -big).when(F.col("at") >= F.col("count") + F.col("high_n"), float("nan")).when(F.col("at") >= F.col("count"), big))
    state = cut(of.select("g", "n", "part", "odd", "at", "low", "high", "count"))
    inside = lambda rows, ranges: rows.join(ranges.select(F.col("g").alias("_g"), "low", "high", "at"), F.col("g").eqNullSafe(F.col("_g"))).where((v >= F.col("low")) & (v <= F.col("high")))
    wide = F.col("odd").isNull() & (F.col("low") < F.col("high")) & (F.col("count") > enough)
    while not state.where(wide).isEmpty():
        step = F.col("high") / 1024 - F.col("low") / 1024
        number = F.when(step > 0, F.greatest(F.lit(0.0), F.least(F.lit(1023.0), F.floor(v / step - F.col("low") / step).cast("double")))).otherwise(v)
        counts = inside(some, state.where(wide)).groupBy("g", "at", number.alias("number")).agg(F.count("*").alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = F.sum("c").over(Window.partitionBy("g").orderBy("number"))  # 1024 rows a group
        found = counts.withColumn("before", upto - F.col("c")).where((F.col("at") >= F.col("before")) & (F.col("at") < F.col("before") + F.col("c")))
        found = found.select(F.col("g").alias("_g"), (F.col("at") - F.col("before")).alias("_at"), F.col("low").alias("_low"), F.col("high").alias("_high"), F.col("c").alias("_c"))
        joined = state.join(found, F.col("g").eqNullSafe(F.col("_g")), "left")
        state = cut(joined.select("g", "n", "part", "odd", *[F.coalesce(f"_{c}", c).alias(c) for c in ("at", "low", "high")], F.coalesce("_c", "count").alias("count")), instead_of=state)
    few = inside(some, state.where("odd is null and low < high")).withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy("v")) - 1)  # ``enough`` rows a group
    few = few.where(F.col("place") == F.col("at")).select(F.col("g").alias("_g"), F.col("v").alias("exact"))
    here = state.join(few, F.col("g").eqNullSafe(F.col("_g")), "left").select("g", "n", "part", F.coalesce("odd", "exact", "low").alias("here"))
    told = here.select(F.col("g").alias("_g"), "here", F.floor(F.lit(share) * (F.col("n") - 1)).alias("k"))
    after = some.join(told, F.col("g").eqNullSafe(F.col("_g"))).groupBy("g", "k").agg(F.count_if(v <= F.col("here")).alias("upto"), F.min(F.when(v > F.col("here"), v)).alias("above"))
    after = after.select(F.col("g").alias("_g"), F.when(F.col("upto") <= F.col("k") + 1, F.col("above")).alias("next"))
    ends = here.join(after, F.col("g").eqNullSafe(F.col("_g")), "left").withColumn("next", F.coalesce("next", "here"))
    value = F.when((F.col("part") == 0) | (F.col("next") == F.col("here")), F.col("here")).otherwise((1 - F.col("part")) * F.col("here") + F.col("part") * F.col("next"))
    return ends.select(F.col("g").alias(group), "n", value.alias("value"))


def stretch(df: DataFrame, column: str, valid: Column, floor: float = 0.0) -> DataFrame:
    """``df`` with ``column`` of the valid rows stretched from the 5th to the 95th place of their order to 0..10.

    Left alone where fewer than two rows are valid, or the places lie less than 0.5 or infinitely far apart. floor:
    of the stretched value before the factor 10, so that a scored row never gets the 0 of an unscored one. The
    valid values are cut first: what ``df`` takes to compute is computed once for both places.
    """
    some = cut(df.where(valid).select(F.col(column).cast("double").alias("v")).where("v is not null"))
    n = some.count()
    if n < 2:
        return df
    low = order_statistic(some, "v", max(0, int(n * 0.05) - 1))
    high = order_statistic(some, "v", min(n - 1, int(n * 0.95) - 1))
    if not 0.5 <= high - low < float("inf"):
        return df
    unit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(column) - low) / (high - low)))
    return df.withColumn(column, F.when(valid, F.round(F.greatest(unit, F.lit(floor)) * 10, 4)).otherwise(F.col(column)))


def global_rank(df: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    """``df`` with row numbers from 1 along ``order``: range-sorted partitions, each numbered after those before it."""
    parts = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = before.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a partition
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.join(F.broadcast(before), "_part").withColumn(out, within + F.col("_before")).drop("_part", "_before")


def top_each(df: DataFrame, group: str, order: list[Column], k: int | Column, most: int | None = None) -> DataFrame:
    """The first ``k`` rows of each group (k: a number, or a column of the row, ``most`` at most).

    With a number the engine drops rows before the shuffle that can't be among the first.
    """
    ranked = df.withColumn("rank_in_group", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    if most is not None:
        ranked = ranked.where(F.col("rank_in_group") <= most)
    return ranked.where(F.col("rank_in_group") <= k)


def summaries(members: DataFrame) -> DataFrame:
    """A row a cluster of (cluster_id, id, sharpness): member_count, representative and representatives (the sharpest, the two sharpest).

    Of equally sharp members the smallest id comes first. Both are found by aggregates that combine before the
    shuffle; the members themselves are the rows of ``members``, and are never gathered.
    """
    best = F.struct(F.col("sharpness"), (-F.col("id")).alias("minus"))
    first = members.groupBy("cluster_id").agg(F.count("*").alias("member_count"), F.max(best).alias("_best"))
    first = first.select("cluster_id", "member_count", (-F.col("_best.minus")).alias("representative"))
    second = members.join(first.select("cluster_id", F.col("representative").alias("id")), ["cluster_id", "id"], "left_anti").groupBy("cluster_id").agg(F.max(best).alias("_second"))
    both = F.array_compact(F.array("representative", -F.col("_second.minus")))
    return first.join(second, "cluster_id", "left").withColumn("representatives", both).drop("_second")


def numbered(clusters: DataFrame) -> DataFrame:
    """``clusters`` (cluster_id: its smallest member, ...) with ``number``: from 0 in the order of first members."""
    return global_rank(clusters, [F.col("cluster_id")], "number").withColumn("number", F.col("number") - 1)


def representatives(clusters: DataFrame) -> DataFrame:
    """(cluster_id, id): the representatives of each cluster, or its one representative where it lists none."""
    some = F.when(F.size("representatives") > 0, F.col("representatives")).otherwise(F.array("representative"))
    return clusters.select("cluster_id", F.explode(some).alias("id"))


def quotas(videos: DataFrame, slots: int, most: float | None = None) -> DataFrame:
    """(video, duration, quota): slots in proportion to duration, one at least, ties by name.

    What rounding gives beyond ``slots`` is taken back unit by unit, the unit with the largest quota over
    duration first; what is missing goes to the longest videos. Without durations slots are dealt evenly.
    most: a share of ``slots`` that no video gets more than; then some may stay free.
    """
    total, n = videos.agg(F.coalesce(F.sum("duration"), F.lit(0.0)), F.count("*")).first()
    if not n:
        return videos.select("video", "duration", F.lit(0).cast("long").alias("quota"))
    if total <= 0:
        more = videos.orderBy("video").limit(slots % n).select("video", F.lit(1).alias("more"))
        return videos.join(more, "video", "left").select("video", "duration", (slots // n + F.coalesce("more", F.lit(0))).cast("long").alias("quota"))
    cap = max(1, int(slots * most)) if most else max(1, slots)
    given = videos.withColumn("quota", F.greatest(F.lit(1), F.bround(slots * F.col("duration") / F.lit(total))).cast("long"))
    given = given.withColumn("quota", F.least("quota", F.lit(cap))) if most else given
    have = given.agg(F.sum("quota")).first()[0]
    if have > slots:
        units = given.where("quota > 1").select("video", "duration", F.explode(F.sequence(F.lit(2), F.col("quota"))).alias("unit"))
        back = units.orderBy((F.col("unit") / F.col("duration")).desc(), "video").limit(have - slots).groupBy("video").agg(F.count("*").alias("back"))
        given = given.join(back, "video", "left").withColumn("quota", F.col("quota") - F.coalesce("back", F.lit(0)))
    elif have < slots:
        # The longest takes all that is missing, or with a cap the longest ones up to it: each video asks for one slot at least,
        # so that ``slots - have`` of them are enough.
        room = given.where(F.col("quota") < cap) if most else given
        longest = room.orderBy(F.col("duration").desc(), "video").limit(slots - have if most else 1)
        asked = (F.lit(cap) - F.col("quota")) if most else F.lit(slots - have)
        before = F.sum("asked").over(Window.orderBy(F.col("duration").desc(), "video")) - F.col("asked")  # rows bounded by the slots
        more = longest.withColumn("asked", asked.cast("long")).withColumn("more", F.greatest(F.lit(0), F.least("asked", slots - have - before)))
        given = given.join(F.broadcast(more.select("video", "more")), "video", "left").withColumn("quota", F.col("quota") + F.coalesce("more", F.lit(0)))
    return given.select("video", "duration", "quota")
