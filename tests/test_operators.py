import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import close, frames, graph, merge, ranking


def components(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 60)], [(5, 5), (7, 3), (3, 7), (3, 9)], [(random.Random(1).randrange(90) + 0 * k, random.Random(k).randrange(90)) for k in range(70)]])
def test_components(spark, edges):
    got = {r["id"]: r["component_id"] for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {k: v for k, v in components(edges).items() if k != v}


@pytest.mark.parametrize("chunk", [4096, 7])
def test_close_equals_brute_force(spark, chunk):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(6)]
    hashes = [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(9)] + [base[0]] * 5
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    rows = [(k, h, k % 2 or None, (k * 7) % 59) for k, h in enumerate(signed)] + [(99, None, 1, 99)]
    items = spark.createDataFrame(rows, "id bigint, h bigint, date int, rank int")
    near = lambda a, b, bits: (hashes[a] ^ hashes[b]).bit_count() <= bits
    want = {(a, b) for a in range(len(hashes)) for b in range(a) if near(a, b, 4)}
    assert {(r["b"], r["a"]) for r in close.pairs(items, 4, chunk=chunk).collect()} == want
    dated = {(r["b"], r["a"]) for r in close.pairs(items, 4, ["date"], chunk).collect()}
    assert dated == {(a, b) for a, b in want if a % 2 == b % 2}
    found = components(want)
    assert {r["id"]: r["cluster_id"] for r in close.clusters(items, 4, chunk=chunk).collect()} == {k: found.get(k, k) for k, *_ in rows}
    rank = {k: r for k, _, _, r in rows}
    late = {a if rank[a] > rank[b] else b for a, b in want if near(a, b, 3) and rank[a] != rank[b]}
    assert {r["id"] for r in close.shadowed(items, 4, chunk).collect()} == late


def plain_near(rows, bits, block=False):
    """Components of (id, h, block) rows by comparing each with each."""
    import numpy as np

    h = np.array([r[1] for r in rows], np.int64).view(np.uint64)
    found = []
    for k, r in enumerate(rows):
        near = np.flatnonzero(np.bitwise_count(h[k] ^ h[:k]) <= bits)
        found += [(r[0], rows[j][0]) for j in near if not block or rows[j][2] == r[2]]
    return found


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def clustered(n, groups, flips, seed, hot=0):
    """n rows around random centres, ``hot`` more around one centre, and copies."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(groups)]
    flip = lambda h: h ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(flips + 1))})
    hashes = [flip(rng.choice(centres)) for _ in range(n)] + [flip(centres[0]) for _ in range(hot)]
    return [(k, signed(h), k % 3 or None) for k, h in enumerate(hashes + hashes[:50])]


@pytest.mark.parametrize("bits", [0, 5, 16])
@pytest.mark.parametrize("block", [[], ["b"]])
def test_clusters_through_the_index_equal_brute_force(spark, bits, block):
    rows = clustered(500, 40, 4, bits, hot=250)
    items = spark.createDataFrame(rows, "id bigint, h bigint, b int").repartition(5)
    want = components(plain_near(rows, bits, bool(block)))
    got = {r["id"]: r["cluster_id"] for r in close.clusters(items, bits, block, chunk=40).collect()}
    assert got == {k: want.get(k, k) for k, *_ in rows}
    pairs = {(r["b"], r["a"]) for r in close.pairs(items, bits, block, chunk=40).collect()}
    assert pairs == set(plain_near(rows, bits, bool(block)))


def test_the_index_compares_few_pairs_of_clustered_rows(spark, monkeypatch):
    rows = clustered(12_000, 300, 3, 1)
    items = spark.createDataFrame(rows, "id bigint, h bigint, b int").repartition(8)
    n = close.compared(items, 6, chunk=100, sure=False)
    assert n < 0.06 * len(rows) ** 2 / 2
    hot = clustered(4000, 300, 3, 2, hot=2000)
    some = spark.createDataFrame(hot, "id bigint, h bigint, b int").repartition(8)
    # A third of all rows near one centre are known to be near each other: few of their pairs are compared. (Few rows are cheap
    # to compare, so that the plan would rather compare than send them.)
    monkeypatch.setattr(close, "SENT", 1)
    n, every = close.compared(some, 6, chunk=1000), close.compared(some, 6, chunk=1000, sure=False)
    assert n < 0.12 * len(hot) ** 2 / 2 and n < every - 2000**2 / 4
    sizes = close._dealt(some.select("id", "h"), [], 6, 100, True).groupBy("_block", "_cell", "_i", "_j").count().collect()
    assert len(sizes) > 100 and max(r["count"] for r in sizes) < 400


def parts_of(items, bits, block, chunk):
    """Rows by the task that compares them."""
    import pyarrow as pa
    from pyspark import TaskContext

    met = lambda group, x, y: pa.table({"part": [TaskContext.get().partitionId()], "n": [len(group)]})
    found = close._joined(items, block, bits, chunk, "id", met, "part bigint, n bigint", False)
    return {r["part"]: r["n"] for r in found.groupBy("part").agg(F.sum("n").alias("n")).collect()}


def test_groups_of_one_cell_are_spread_over_tasks(spark, monkeypatch):
    """Fingerprints without groups make one cell of a table, or of a block; its pairs of chunks go to many tasks, whose rows don't grow with the table."""
    monkeypatch.setattr(close, "ROWS", 1000, raising=False)
    monkeypatch.setattr(close, "SENDS", 2000, raising=False)
    rng = random.Random(8)
    rows = [(k, signed(rng.getrandbits(64)), None) for k in range(800)]
    items = spark.createDataFrame(rows, "id bigint, h bigint, b int").repartition(3)
    for n, block in ((400, []), (800, ["b"])):
        got = parts_of(items.where(F.col("id") < n), 20, block, 50)
        assert sum(got.values()) == n * n // 50 and max(got.values()) < 3000
        assert len(got) >= n * n // 50 // 2000
    assert {(r["b"], r["a"]) for r in close.pairs(items, 20, ["b"], 50).collect()} == set(plain_near(rows, 20))


def test_a_group_of_copies_hands_on_its_pairs_in_parts(monkeypatch):
    """Two chunks of copies are all pairs of both; the task that compares them holds a part of these at a time."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    class Groups:
        """Stands for the items and for their groups; gives the function that a task runs on a group."""

        select = groupBy = lambda self, *columns: self
        applyInArrow = lambda self, function, schema: function

    monkeypatch.setattr(close, "_dealt", lambda *_: Groups())
    run, n = close.pairs(Groups(), 4), 1500
    same = {c: np.full(2 * n, v, np.int32) for c, v in (("_d", 0), ("_i", 0), ("_j", 1))}
    group = pa.table({"id": np.arange(2 * n), "h": np.full(2 * n, 9), "_c": np.repeat([0, 1], n).astype(np.int32)} | same)
    tracemalloc.start()
    sizes = [len(part) for part in run(iter(group.to_batches()))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) == n * n and max(sizes) < n * n / 4
    assert peak < 40e6  # all pairs at once: 20 bytes each as they are handed on, 45 MB, and several times that on the way


@pytest.mark.parametrize("part", [1, 40])
def test_parts_of_pairs_equal_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(close, "PART", part, raising=False)
    monkeypatch.setattr(close, "AT_ONCE", 3)
    rows = clustered(150, 12, 4, 5, hot=60)
    items = spark.createDataFrame([(*r, k * 7 % 40) for k, r in enumerate(rows)], "id bigint, h bigint, b int, rank int").repartition(3)
    for chunk in (30, 4096):
        want = plain_near(rows, 5)
        assert sorted((r["b"], r["a"]) for r in close.pairs(items, 5, chunk=chunk).collect()) == sorted(want)
        found = components(want)
        assert {r["id"]: r["cluster_id"] for r in close.clusters(items, 5, chunk=chunk).collect()} == {k: found.get(k, k) for k, *_ in rows}
        late = {max(p, key=lambda k: k * 7 % 40) for p in plain_near(rows, 4) if (p[0] - p[1]) % 40}
        assert {r["id"] for r in close.shadowed(items, 5, chunk).collect()} == late


def test_order_statistic_and_rank(spark):
    values = [random.Random(k).choice([0.0, 1.5, random.Random(k).random()]) for k in range(500)]
    df = spark.createDataFrame([(v, k) for k, v in enumerate(values)], "v double, id int").repartition(5)
    for k in (0, 17, 250, 499):
        assert ranking.order_statistic(df, "v", k, enough=20) == sorted(values)[k]
    got = ranking.global_rank(df, [F.col("v").desc(), F.col("id")]).collect()
    want = {i: k for k, (_, i) in enumerate(sorted((-v, i) for i, v in enumerate(values)), 1)}
    assert {r["id"]: r["rank"] for r in got} == want


@pytest.mark.parametrize("values,want", [([5, 6, 7, 8, 9], [0, 3.3333, 6.6667, 10, 10]), ([6.5], [6.5]), ([6, 6, 6], [6, 6, 6])])
def test_stretch(spark, values, want):
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "id int, v double")
    assert [r["v"] for r in ranking.stretch(df, "v", F.col("v") > 0).orderBy("id").collect()] == want


def test_stretch_floor(spark):
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate([5, 6, 7, 8, 9, 0])], "id int, v double")
    got = [r["v"] for r in ranking.stretch(df, "v", F.col("v") > 0, 0.01).orderBy("id").collect()]
    assert got[0] == 0.1 and got[4] == 10 and got[5] == 0


@pytest.mark.parametrize("durations,slots,want", [([10, 10], 20, [10, 10]), ([3, 7], 20, [6, 14]), ([0.1, 99.9], 20, [1, 19]), ([100, 0.01], 20, [19, 1]), ([0, 0, 0], 20, [7, 7, 6]), ([1] * 5, 3, [1] * 5), ([], 5, [])])
def test_quotas(spark, durations, slots, want):
    videos = spark.createDataFrame([(f"v{k}", float(d)) for k, d in enumerate(durations)], "video string, duration double")
    assert [r["quota"] for r in ranking.quotas(videos, slots).orderBy("video").collect()] == want


def greedy(durations, slots):
    q = {v: max(1, round(slots * d / sum(durations.values()))) for v, d in durations.items()}
    while sum(q.values()) > slots and any(n > 1 for n in q.values()):
        q[min((v for v in q if q[v] > 1), key=lambda v: (-q[v] / durations[v], v))] -= 1
    while sum(q.values()) < slots:
        q[min(q, key=lambda v: (-durations[v], v))] += 1
    return q


@pytest.mark.parametrize("seed", range(6))
def test_quotas_equal_greedy(spark, seed):
    rng = random.Random(seed)
    durations = {f"v{k:02}": float(rng.randrange(1, 60)) for k in range(rng.randrange(2, 9))}
    videos = spark.createDataFrame(list(durations.items()), "video string, duration double")
    assert {r["video"]: r["quota"] for r in ranking.quotas(videos, 30).collect()} == greedy(durations, 30)


def test_relative_blur(spark):
    rows = [("a", float(s)) for s in range(10, 101, 10)] + [("b", 1.0), ("b", 2.0), ("b", 9.0)]
    got = frames.relative_blur(spark.createDataFrame(rows, "video string, sharpness double")).where("blurry").collect()
    assert sorted((r["video"], r["sharpness"]) for r in got) == [("a", 10.0), ("a", 20.0), ("a", 30.0)]


def test_repeats_count_from_the_next_batch_on(spark):
    rows = [("a", k, 0 if k != 1 else -1) for k in range(4)] + [("b", 0, 0)]
    got = frames.drop_repeats(spark.createDataFrame(rows, "video string, seq int, h bigint"), batch=2).collect()
    assert sorted((r["video"], r["seq"]) for r in got) == [("a", 0), ("a", 1), ("b", 0)]


def test_sampling_step(spark):
    row = spark.range(1).select(frames.step(F.lit(30.0), F.lit(100.0)).alias("a"), frames.step(F.lit(30.0), F.lit(1000.0)).alias("b"), frames.step(F.lit(0.1), F.lit(5.0)).alias("c")).first()
    assert tuple(row) == (30, 150, 1)


def test_rerun_closure():
    assert merge.rerun_closure([]) == set() and merge.rerun_closure(["topiq"]) == {"topiq"} and merge.rerun_closure(["vlm"]) == {"vlm"}
    assert merge.rerun_closure(["l4"]) == {"l4", "vlm"} and merge.rerun_closure(["l2"]) == {"l2", "l4", "topiq", "vlm"}
    assert merge.rerun_closure(["l1"]) == {"l1", "l2", "l4", "topiq", "vlm"}


def test_merges(spark):
    old = spark.createDataFrame([(1, 8.0), (2, 8.0)], "id int, overall double")
    new = spark.createDataFrame([(2, 6.0, None), (1, 3.0, "failed"), (3, 5.0, None)], "id int, overall double, error string")
    assert sorted(map(tuple, merge.keep_old(old, new.drop("error")).collect())) == [(1, 8.0), (2, 8.0), (3, 5.0)]
    assert sorted(map(tuple, merge.overwrite(old, new, ["overall"]).collect())) == [(1, 8.0), (2, 6.0)]
    assert [tuple(r) for r in merge.last_wins(spark.createDataFrame([("a", 1), ("a", 2)], "k string, s int"), "k", "s").collect()] == [("a", 2)]


@pytest.mark.parametrize("enough", [20, 10_000])
def test_order_statistic_of_odd_numbers(spark, enough):
    nan, inf = float("nan"), float("inf")
    rng = random.Random(5)
    values = [inf] * 40 + [-inf] * 3 + [nan] * 5 + [1e300, -1e300, 5e-324, 0.0, -0.0, 1e-310] + [rng.random() for _ in range(100)] + [7.0] * 60
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(3)
    order = sorted(v for v in values if v == v) + [nan] * 5
    for k in (0, 2, 3, 4, 60, 110, 168, 170, 208, 213):
        assert str(ranking.order_statistic(df, "v", k, enough) + 0.0) == str(order[k] + 0.0)
    tiny = spark.createDataFrame([(k * 5e-324,) for k in range(100)], "v double")
    assert ranking.order_statistic(tiny, "v", 41, 20) == 41 * 5e-324


def test_stretch_of_infinite_places_leaves_alone(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate([1.0, 2.0, float("inf"), float("inf")])], "id int, v double")
    assert [r["v"] for r in ranking.stretch(df, "v", F.col("v") > 0).orderBy("id").collect()] == [1.0, 2.0, float("inf"), float("inf")]


def capped(durations, slots, share):
    cap = max(1, int(slots * share))
    q = {v: min(cap, max(1, round(slots * d / sum(durations.values())))) for v, d in durations.items()}
    while sum(q.values()) > slots and any(n > 1 for n in q.values()):
        q[min((v for v in q if q[v] > 1), key=lambda v: (-q[v] / durations[v], v))] -= 1
    while sum(q.values()) < slots and any(n < cap for n in q.values()):
        q[min((v for v in q if q[v] < cap), key=lambda v: (-durations[v], v))] += 1
    return q


@pytest.mark.parametrize("seed", range(4))
def test_capped_quotas_equal_greedy(spark, seed):
    rng = random.Random(seed)
    durations = {f"v{k:02}": float(rng.randrange(1, 60)) for k in range(rng.randrange(2, 9))}
    videos = spark.createDataFrame(list(durations.items()), "video string, duration double")
    assert {r["video"]: r["quota"] for r in ranking.quotas(videos, 30, 0.3).collect()} == capped(durations, 30, 0.3)


def test_repeats_equal_brute_force(spark):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(5)]
    rows = [(f"v{k % 3}", k, base[rng.randrange(5)] ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(12))) & (1 << 64) - 1) for k in range(300)]
    want = []
    for video in ("v0", "v1", "v2"):
        mine, seen = [r for r in rows if r[0] == video], []
        for s in range(0, len(mine), 20):
            new = [r for r in mine[s : s + 20] if all((r[2] ^ k).bit_count() >= 16 for k in seen)]
            seen += [r[2] for r in new]
            want += [(r[0], r[1]) for r in new]
    df = spark.createDataFrame([(v, s, h - (1 << 64) if h >> 63 else h) for v, s, h in rows] + [("v0", 999, None)], "video string, seq int, h bigint").repartition(4)
    assert sorted((r["video"], r["seq"]) for r in frames.drop_repeats(df).collect()) == sorted(want) and 20 < len(want) < 300


def test_frames_of_broken_videos(spark):
    df = spark.createDataFrame([("a", 0, 0.0, 10), ("b", 0, 25.0, 0), ("c", 25, 25.0, 50), ("c", 26, 25.0, 50), ("c", 0, 25.0, 50)], "video string, idx int, fps double, frame_count int")
    got = [(r["video"], r["idx"], r["timestamp"], r["duration"]) for r in frames.sampled(df).orderBy("idx").collect()]
    assert got == [("c", 0, 0.0, 2.0), ("c", 25, 1.0, 2.0)]


def test_summaries(spark):
    rows = [(1, 1, 5.0), (1, 2, 9.0), (1, 3, 9.0), (4, 4, 1.0)]
    made = ranking.summaries(spark.createDataFrame(rows, "cluster_id bigint, id bigint, sharpness double"))
    assert sorted((r["cluster_id"], r["member_count"], r["representative"], r["representatives"]) for r in made.collect()) == [(1, 3, 2, [2, 3]), (4, 1, 4, [4])]
    assert sorted(tuple(r) for r in ranking.representatives(made).collect()) == [(1, 2), (1, 3), (4, 4)]
    assert sorted((r["cluster_id"], r["number"]) for r in ranking.numbered(made.select("cluster_id")).collect()) == [(1, 0), (4, 1)]
