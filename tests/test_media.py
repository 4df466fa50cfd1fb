"""Frames from videos, streams of frames and events, order statistics of groups, pictures: against plain versions."""

import math
import os
import random
import struct
import sys
import threading
import time
import zlib

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tessera.functions import faces, fingerprints, pixels, prompts, scores
from tessera.operators import frames as frame_ops
from tessera.operators import ranking
from tessera.plans import plugins
from tessera.sources import images, video
from tessera.streaming import arrivals

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't import this file

# -- videos


def y4m(path, frames, fps="10:1", kind="mono", cut=0):
    h, w = frames[0].shape[:2]
    data = f"YUV4MPEG2 W{w} H{h} F{fps} C{kind}\n".encode() + b"".join(b"FRAME\n" + f.tobytes() for f in frames)
    path.write_bytes(data[: len(data) - cut])


def pictures(n, seed=1, shape=(6, 8)):
    rng = np.random.default_rng(seed)
    return [rng.integers(0, 256, shape, np.uint8) for _ in range(n)]


def test_frames_of_videos(spark, tmp_path):
    video.register(spark)
    long, short = pictures(45), pictures(3, 2)
    y4m(tmp_path / "long.y4m", long)
    y4m(tmp_path / "short.y4m", short, "1:1")
    (tmp_path / "notes.txt").write_text("no video")
    df = spark.read.format("tessera_frames").option("interval", "0.2").option("segment", "7").load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 4 + 1  # 23 samples in segments of 7, and three
    got = {(r["video"], r["idx"]): r for r in df.collect()}
    assert set(got) == {("long.y4m", k) for k in range(0, 45, 2)} | {("short.y4m", k) for k in range(3)}
    for (name, k), r in got.items():
        x = (long if name[0] == "l" else short)[k]
        assert (r["height"], r["width"], r["channels"], bytes(r["data"])) == (6, 8, 1, x.tobytes()) and r["error"] is None
        assert r["timestamp"] == round(k / r["fps"], 2) and len(r["signature"]) == 6 and r["path"].endswith(name)
    assert got["long.y4m", 0]["duration"] == 4.5 and got["long.y4m", 0]["frame_count"] == 45
    few = spark.read.format("tessera_frames").option("most", "5").load(str(tmp_path / "long.y4m")).select("idx").collect()
    assert [r["idx"] for r in few] == list(range(0, 45, 10)) and df.select("idx").where("idx > 40").count() == 2
    measured = pixels.measures(df.withColumn("name", F.col("video"))).where("error is null")
    assert measured.count() == 26 and measured.where("h is null").count() == 0


def test_videos_that_are_missing_or_broken(spark, tmp_path):
    video.register(spark)
    read = lambda p, **o: spark.read.format("tessera_frames").options(**o).load(str(p)).collect()
    with pytest.raises(Exception, match="no such video"):
        read(tmp_path / "missing.y4m")
    (tmp_path / "bad.y4m").write_bytes(b"this is no video")
    with pytest.raises(Exception, match="YUV4MPEG2"):
        read(tmp_path)
    y4m(tmp_path / "still.y4m", pictures(2), fps="0:1")
    y4m(tmp_path / "good.y4m", pictures(2), fps="1:1")
    rows = {r["video"]: r for r in read(tmp_path, errors="rows") if r["idx"] is None or r["idx"] == 0}
    assert rows["bad.y4m"]["error"] and rows["bad.y4m"]["data"] is None and "rate" in rows["still.y4m"]["error"] and rows["good.y4m"]["error"] is None
    assert read(tmp_path, types="mp4") == []
    with pytest.raises(Exception, match="no path"):
        spark.read.format("tessera_frames").load().collect()
    with pytest.raises(Exception, match="size"):
        video.Y4M(__import__("io").BytesIO(b"YUV4MPEG2 F1:1\n"), 15)


def test_colours_of_frames(tmp_path):
    y = np.array([[16, 235], [81, 145]], np.uint8)
    u, v = np.array([[128, 128], [90, 54]], np.uint8), np.array([[128, 128], [240, 34]], np.uint8)
    for kind, planes in (("444", (y, u, v)), ("420jpeg", (np.full((2, 2), 81, np.uint8), np.array([[90]], np.uint8), np.array([[240]], np.uint8)))):
        path = tmp_path / f"{kind}.y4m"
        path.write_bytes(f"YUV4MPEG2 W2 H2 F25:1 C{kind}\nFRAME\n".encode() + b"".join(p.tobytes() for p in planes))
        with open(path, "rb") as file:
            x = video.Y4M(file, path.stat().st_size)
            assert x.frame_count == 1 and x.fps == 25
            got = x.frame(0).astype(int)
        if kind == "444":
            assert got[0, 0].tolist() == [0, 0, 0] and got[0, 1].tolist() == [255, 255, 255]
        assert (abs(got[1, 0] - [0, 0, 254]) <= 2).all()  # red


def test_a_stream_of_videos(spark, tmp_path):
    video.register(spark)
    folder, at = tmp_path / "in", str(tmp_path / "ck")
    folder.mkdir()
    y4m(folder / "a.y4m", pictures(4), "1:1")

    def run():
        stream = spark.readStream.format("tessera_frames").load(str(folder))
        q = stream.select("video", "idx", "error").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", at).trigger(availableNow=True).start()
        assert q.awaitTermination(60), q.stop()
        return sorted((r["video"], r["idx"], r["error"] is None) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    first = [("a.y4m", k, True) for k in range(4)]
    assert run() == first and run() == first
    y4m(folder / "b.y4m", pictures(2), "1:1")
    os.utime(folder / "b.y4m", ns=(time.time_ns(), time.time_ns() + 10**9))
    assert run() == first + [("b.y4m", k, True) for k in range(2)]


# -- frames in streams


def frame_rows(n=260, videos=4, seed=3):
    rng = random.Random(seed)
    base = [rng.getrandbits(63) for _ in range(9)]
    flip = lambda h: h ^ sum({1 << rng.randrange(63) for _ in range(rng.randrange(12))})
    return [(k % videos if k % 5 else 0, k, flip(rng.choice(base)) if k % 23 else None) for k in range(n)]


def stream_of(spark, folder, batches, schema):
    """A stream of one micro-batch for each of ``batches``."""
    folder.mkdir()
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(folder))
        for p in folder.glob("part-*"):
            if not p.name.startswith("part-done"):
                os.utime(p, (k + 10, k + 10))
                p.rename(folder / f"part-done-{k:03d}.json")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def written(spark, stream, at, mode="append"):
    q = stream.writeStream.format("memory").queryName(f"t{time.time_ns()}").outputMode(mode).option("checkpointLocation", str(at)).trigger(availableNow=True).start()
    assert q.awaitTermination(90), q.stop()
    return spark.table(q.name).collect()


@pytest.mark.parametrize("cuts", [[260], [1, 7, 20, 21, 90, 260], list(range(13, 273, 13))])
def test_a_stream_drops_the_repeats_of_a_batch(spark, tmp_path, cuts):
    rows, schema = frame_rows(), "video bigint, seq bigint, h bigint"
    want = sorted(map(tuple, frame_ops.drop_repeats(spark.createDataFrame(rows, schema)).collect()))
    stream = stream_of(spark, tmp_path / "in", [rows[a:b] for a, b in zip([0, *cuts], cuts)], schema)
    got = sorted(map(tuple, written(spark, arrivals.drop_repeats(stream), tmp_path / "ck")))
    assert got == want and 20 < len(got) < 200


def test_state_of_idle_videos_ends(spark, tmp_path):
    schema, h = "video bigint, seq bigint, h bigint", 0xABCDEF0123
    one = lambda v, s: [(v, s + k, h) for k in range(20)]
    stream = stream_of(spark, tmp_path / "in", [one(1, 0), one(1, 100), one(2, 0), one(2, 100), one(1, 200)], schema)
    # The second batch of each video is dropped; the first one, idle while the other came, is looked at anew.
    want = sorted([(1, k) for k in range(20)] + [(2, k) for k in range(20)] + [(1, 200 + k) for k in range(20)])
    q = arrivals.drop_repeats(stream, idle=0.001).writeStream.format("memory").queryName(f"t{time.time_ns()}").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        ends = time.time() + 60
        while time.time() < ends and spark.table(q.name).count() < len(want):
            time.sleep(0.3)
        got = sorted((r["video"], r["seq"]) for r in spark.table(q.name).collect())
    finally:
        q.stop()
    assert got == want


def events(n=400, seed=5):
    rng = random.Random(seed)
    return [(f"2024-05-01 {8 + k // 60 % 12:02d}:{k % 60:02d}:{rng.randrange(60):02d}", rng.choice(["view", "buy", None]), rng.randrange(4), float(rng.randrange(90))) for k in range(n)]


def test_sliding_windows_and_duplicates_in_streams(spark, tmp_path):
    schema = "ts timestamp, event_type string, user_id bigint, value double"
    rows = sorted(events())
    typed = lambda some: [(__import__("datetime").datetime.fromisoformat(t), *rest) for t, *rest in some]
    batch = spark.createDataFrame(typed(rows), schema)
    last = [("2024-05-03 00:00:00", "end", 9, 0.0)]  # moves the watermark past all windows
    parts = [typed(rows[k : k + 60]) for k in range(0, 400, 60)] + [typed(last), typed([("2024-05-01 08:00:00", "view", 1, 1e9)]), typed([("2024-05-03 00:00:01", "end", 9, 0.0)])]
    windows = arrivals.sliding(stream_of(spark, tmp_path / "in", parts, schema), late="10 minutes")
    got = sorted(map(str, written(spark, windows, tmp_path / "ck")))
    want = sorted(map(str, arrivals.sliding(batch).collect()))
    assert got == want and len(want) > 60  # the late row is dropped
    keys = ["event_type", "user_id"]
    seen = arrivals.distinct(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")), keys, late="20 hours")
    got = sorted(str((r["event_type"], r["user_id"])) for r in written(spark, seen.select(*keys), tmp_path / "ck2"))
    assert got == sorted([str((r["event_type"], r["user_id"])) for r in arrivals.distinct(batch, keys).select(*keys).collect()] + ["('end', 9)"])


# -- order statistics of groups


def plain_percentile(values, share):
    values = sorted(values, key=lambda v: (math.isnan(v), v))
    p = share * (len(values) - 1)
    k, part = math.floor(p), p - math.floor(p)
    here, after = values[k], values[min(k + 1, len(values) - 1)]
    return here if part == 0 or after == here else (1 - part) * here + part * after


@pytest.mark.parametrize("share,enough", [(0.0, 10_000), (0.3, 1), (0.5, 40), (1.0, 10_000), (0.3, 10_000)])
def test_percentiles_of_groups(spark, share, enough):
    rng, inf, nan = random.Random(7), float("inf"), float("nan")
    groups = {"hot": [rng.choice([rng.gauss(0, 1), 1e9 * rng.random(), 0.25]) for _ in range(1500)], None: [3.0, 1.0, 2.0], "one": [7.5], "same": [2.0] * 9, "odd": [-inf, -inf, 1.0, 2.0, inf, nan], "nan": [nan] * 3, "inf": [1.0, inf], "tiny": [5e-324, 0.0, 1e-323], "wide": [-1.7e308, 1.7e308, 0.0, 5.0]}
    rows = [(g, v) for g, some in groups.items() for v in some] + [("hot", None), ("void", None)]
    rng.shuffle(rows)
    got = {r["g"]: r for r in ranking.percentiles(spark.createDataFrame(rows, "g string, x double").repartition(5), "g", "x", share, enough).collect()}
    assert set(got) == set(groups)
    for g, some in groups.items():
        want = plain_percentile(some, share)
        assert got[g]["n"] == len(some) and (got[g]["value"] == pytest.approx(want, rel=1e-12) or (math.isnan(want) and math.isnan(got[g]["value"]))), (g, got[g])
    assert ranking.percentiles(spark.createDataFrame([], "g string, x double"), "g", "x", share).collect() == []


def plain_extracted(rows):
    """What becomes of one video's samples (idx, sharpness, over, under, h, blink)."""
    rows, why, kept = sorted(rows), {}, []
    for s in range(0, len(rows), 20):
        new = []
        for idx, sharp, over, under, h, blink in rows[s : s + 20]:
            if over or under:
                why[idx] = "failed"
            elif not sharp >= 3.0:
                why[idx] = "blurry"
            elif h is None:
                why[idx] = "failed"
            elif any((h ^ k).bit_count() < 16 for k in kept):
                why[idx] = "dup"
            elif blink:
                why[idx] = "blink"
            else:
                why[idx] = None
                new.append(h)
        kept += new
    stay = [r[1] for r in rows if why[r[0]] is None]
    if len(stay) >= 4:
        bound = max(plain_percentile(stay, 0.3), 3.0)
        why |= {r[0]: "blurry" for r in rows if why[r[0]] is None and r[1] < bound}
    return why


def test_extraction_equals_a_plain_loop(spark):
    rng = random.Random(11)
    base = [rng.getrandbits(63) for _ in range(25)]
    rows = [(v, k, rng.choice([1.0, 5.0, 60.0 * rng.random()]), rng.random() < 0.05, rng.random() < 0.05, rng.choice(base) ^ (1 << rng.randrange(63)) if rng.random() < 0.97 else None, rng.random() < 0.1) for v in ("a", "b", "c") for k in range({"a": 150, "b": 3, "c": 41}[v])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "video string, idx bigint, sharpness double, over boolean, under boolean, h bigint, blink boolean, late string").repartition(4)
    got = {(r["video"], r["idx"]): r["dropped"] for r in frame_ops.extracted(df).collect()}
    want = {(v, i): w for v in "abc" for i, w in plain_extracted([r[1:] for r in rows if r[0] == v]).items()}
    assert got == want and {"failed", "blurry", "dup", "blink", None} == set(want.values())


# -- pictures


def png(path, x):
    h, w, _ = x.shape
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(b"".join(b"\0" + r.tobytes() for r in x))) + part(b"IEND", b""))


def test_the_cache_reads_new_files_only(spark, tmp_path):
    folder, cache, calls = tmp_path / "in", tmp_path / "cache", tmp_path / "calls"
    folder.mkdir()
    calls.mkdir()

    def decoder(content):
        with open(str(calls / "told"), "ab") as log:
            log.write(b".")
        if content == b"broken":
            raise ValueError
        return np.frombuffer(content, np.uint8).reshape(-1, 10, 3)

    rng = np.random.default_rng(3)
    png(folder / "small [1].png", rng.integers(0, 256, (9, 12, 3), np.uint8))
    png(folder / "large.png", rng.integers(0, 256, (40, 100, 3), np.uint8))
    (folder / "bad.jpg").write_bytes(b"no picture")
    for k in range(3):
        (folder / f"p{k}.heic").write_bytes(rng.integers(0, 256, 30 * (k + 1), np.uint8).tobytes())
    (folder / "broken.heic").write_bytes(b"broken")
    get = lambda: {r["name"]: r for r in images.cached(spark, str(folder), str(cache), 50, decoder).collect()}
    first = get()
    told = lambda: len((calls / "told").read_bytes())
    assert len(first) == 7 and told() == 4
    assert (first["large.png"]["height"], first["large.png"]["width"]) == (20, 50) and (first["small [1].png"]["height"], first["small [1].png"]["width"]) == (9, 12)
    assert first["bad.jpg"]["error"] and first["broken.heic"]["error"] and first["p1.heic"]["height"] == 2
    assert get() == first and told() == 4
    (folder / "p9.heic").write_bytes(bytes(30))
    again = get()
    assert told() == 5 and {k: again[k] for k in first} == first and again["p9.heic"]["width"] == 10
    # An addition that wasn't written whole counts for nothing.
    (cache / "begun").mkdir()
    (cache / "begun" / "part-0.parquet").write_bytes(b"PAR1")
    (folder / "p0.heic").unlink()
    assert set(get()) == set(again) - {"p0.heic"} and told() == 5


def test_pictures_for_a_judge(spark, tmp_path):
    rng = np.random.default_rng(8)
    for name, x in {"colour": rng.integers(0, 256, (30, 70, 3), np.uint8), "grey": rng.integers(0, 256, (5, 4, 1), np.uint8), "plain": rng.integers(0, 256, (6, 7), np.uint8)}.items():
        (tmp_path / f"{name}.png").write_bytes(pixels.for_judge(x, 35))
        want = pixels.reduced(x, 35)
        r = images.decoded(spark, str(tmp_path)).where(F.col("name") == f"{name}.png").first()
        got = np.frombuffer(bytes(r["data"]), np.uint8).reshape(r["height"], r["width"], r["channels"])
        assert got.shape[:2] == want.shape[:2] and (got == want.reshape(*want.shape[:2], -1)).all()
        assert max(got.shape) <= 35 and pixels.for_judge(x, 35)[:4] == b"\x89PNG"


def plain_resized(rows, m):
    """One pass along rows of whole numbers, value by value."""
    n, out = len(rows[0]), []
    if n == m:
        return rows
    scale = n / m
    wide = max(scale, 1.0)
    kernel = lambda x: 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x) * math.sin(math.pi * x / 3) / (math.pi * x / 3) if -3 <= x < 3 else 0.0
    for row in rows:
        made = []
        for k in range(m):
            centre = (k + 0.5) * scale
            a, b = max(0, int(centre - 3 * wide + 0.5)), min(n, int(centre + 3 * wide + 0.5))
            w = [kernel((j - centre + 0.5) / wide) for j in range(a, b)]
            total = sum(w)
            whole = [int(x / total * (1 << 22) + (0.5 if x >= 0 else -0.5)) for x in w]
            made.append(min(255, max(0, (sum(x * y for x, y in zip(row[a:b], whole)) + (1 << 21)) >> 22)))
        out.append(made)
    return out


def made(kind):
    """The pictures of FIXTURES.md, section C (blue, green, red)."""
    y, x = np.mgrid[0:48, 0:64]
    return {
        "ramp": np.stack([x * 4 % 256, y * 5 % 256, (x + y) * 2 % 256], 2), "rings": np.repeat(((x - 30) ** 2 + (y - 20) ** 2)[:, :, None] // 3 % 256, 3, 2),
        "checks": np.stack([(x // 8 + y // 8) % 2 * 255, (x // 5 + y // 3) % 2 * 200, x * y % 251], 2), "small": np.arange(3 * 5 * 7).reshape(5, 7, 3) * 7 % 256,
    }[kind].astype(np.uint8)


#: Fixed values, as in FIXTURES.md.
HASHES = {"ramp": "aa595d1753555662", "rings": "b030cb82df827dab", "checks": "80023f3e7f287975", "small": "8b12356d359acada"}


@pytest.mark.parametrize("kind", ["ramp", "rings", "checks", "small"])
def test_resampling_equals_value_by_value(kind):
    picture = made(kind)
    b, g, r = (picture[:, :, k].astype(int) for k in range(3))
    grey = (r * 19595 + g * 38470 + b * 7471 + 32768) >> 16
    want = plain_resized(list(map(list, zip(*plain_resized(grey.tolist(), 32)))), 32)
    want = list(map(list, zip(*want)))
    got = pixels.resized(pixels.grey_of_hash(picture), 32, 32)
    assert got.tolist() == want
    h = fingerprints.dct_hash_of(np.array(want, float))
    assert pixels.fingerprint(picture) & (1 << 64) - 1 == h and f"{h:016x}" == HASHES[kind]


# -- detectors and judges


def random_faces(rng, n):
    return [{"landmarks": [{"x": rng.random(), "y": rng.random()} for _ in range(rng.randrange(1, 6))], "blendshapes": {k: rng.random() for k in ("eyeBlinkLeft", "eyeBlinkRight", "mouthSmileLeft", "mouthSmileRight") if rng.random() < 0.8}} for _ in range(n)]


def test_faces_in_tasks_equal_columns(spark):
    rng = random.Random(17)
    found = [random_faces(rng, k % 13) for k in range(120)]
    rows = [(k, [([(p["x"], p["y"]) for p in f["landmarks"]], f["blendshapes"]) for f in some]) for k, some in enumerate(found)]
    df = spark.createDataFrame(rows, f"id bigint, faces array<{faces.FACE}>").select("id", faces.metrics(F.col("faces"), F.lit(640), F.lit(480)).alias("m"))
    told = scores.face_summary(*(F.col(f"m.{c}") for c in ("face_count", "ratio", "second_ratio")), F.lit(0.12), F.col("m.main_blink"), F.col("m.any_blink"))
    overall = F.round(scores.face_overall(F.lit(0.12), F.col("m.smile"), F.col("m.main_blink")), 3)
    for r in df.select("id", "m", told.alias("told"), overall.alias("overall"), prompts.prompt(told).alias("prompt")).collect():
        m = faces.measured(found[r["id"]], 640, 480, lambda *_: 0.12)
        assert {k: m[k] for k in ("face_count", "has_face", "any_blink", "main_blink")} == {k: r["m"][k] for k in ("face_count", "has_face", "any_blink", "main_blink")}
        assert m["ratio"] == pytest.approx(r["m"]["ratio"], abs=2e-4) and m["second_ratio"] == pytest.approx(r["m"]["second_ratio"], abs=2e-4)
        if r["m"]["main"] is not None:
            assert m["clarity"] == 0.12 and m["face_overall"] == pytest.approx(r["overall"], abs=2e-3)
            assert faces.described(m | {k: r["m"][k] for k in ("ratio", "second_ratio")}) == r["told"] and prompts.text(r["told"]) == r["prompt"]
    assert prompts.text(None) == prompts.text(faces.described(faces.measured([], 1, 1, None)))


def shots(spark, n=40):
    rows = [(k, 4, 5, 3, bytes([k] * 60) if k % 9 else None) for k in range(n)]
    return spark.createDataFrame(rows, "id bigint, height int, width int, channels int, data binary").repartition(3)


def detector():
    def detect(x):
        k = int(x[0, 0, 0])
        if k % 7 == 0:
            raise ValueError("no faces today")
        return random_faces(random.Random(k), k % 4)

    return detect


def test_a_detector_in_a_worker(spark, tmp_path):
    rows = {r["id"]: r for r in plugins.faced(shots(spark), detector).collect()}
    assert len(rows) == 40 and rows[9]["error"] == "no picture" and rows[7]["error"] == "no faces today" and rows[5]["error"] is None
    assert all(r["face_count"] == (0 if r["error"] else k % 4) and r["has_face"] == (r["face_count"] > 0) for k, r in rows.items())
    mark = str(tmp_path / "tries")

    def third():
        with open(mark, "ab") as log:
            log.write(b".")
        if os.path.getsize(mark) % 3:
            raise RuntimeError("not yet")
        return detector()

    assert {r["id"]: r for r in plugins.faced(shots(spark).coalesce(1), third).collect()} == rows and os.path.getsize(mark) == 3
    never = plugins.faced(shots(spark), lambda: 1 / 0).collect()
    assert all(r["face_count"] == 0 and r["error"] for r in never) and len(never) == 40


def test_faces_and_judge_in_one_pass(spark):
    def connect():
        lock, state = threading.Lock(), {"now": 0, "most": 0, "tries": {}}

        def ask(prompt, picture):
            k = int(picture[0, 0, 0])
            with lock:
                state["now"] += 1
                state["most"] = max(state["most"], state["now"])
                state["tries"][k] = state["tries"].get(k, 0) + 1
            time.sleep(0.002 * (k * 37 % 11))  # replies come in another order
            with lock:
                state["now"] -= 1
            if k == 5 or (k == 6 and state["tries"][k] < 3):
                raise OSError("busy")
            assert state["most"] <= 4
            return f"{k}:{len(prompt)}"

        return ask

    out = plugins.faced_and_asked(shots(spark), detector, connect, at_once=4, wait=0.001, together=5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan.split("MapInArrow")[0]
    rows = {r["id"]: r for r in out.collect()}
    plain = {r["id"]: r for r in plugins.faced(shots(spark), detector).collect()}
    assert {k: [r[c] for c in plain[k].asDict()] for k, r in rows.items()} == {k: list(r) for k, r in plain.items()}
    for k, r in rows.items():
        summary = faces.described(plain[k].asDict())
        want = None if k % 9 == 0 or k == 5 else f"{k}:{len(prompts.text(summary))}"
        assert r["reply"] == want and r["reply_error"] == ("busy" if k == 5 else None)
    lost = plugins.faced_and_asked(shots(spark), detector, lambda: 1 / 0).collect()
    assert all(r["reply"] is None and (r["reply_error"] or r["id"] % 9 == 0) for r in lost)


def test_a_scorer_of_many_values(spark):
    def load():
        def model(values):
            if any(v < 0 for v in values):
                raise ValueError("negative")
            return [v * 2 for v in values]

        return model

    df = spark.createDataFrame([(k, float(k) if k != 7 else -1.0) for k in range(20)], "id bigint, v double").coalesce(1)
    got = {r["id"]: r["s"] for r in df.select("id", plugins.scored(F.col("v"), load, high=100.0, together=4).alias("s")).collect()}
    assert all(got[k]["score"] == 2.0 * k and got[k]["error"] is None for k in range(20) if k != 7) and got[7]["score"] is None and got[7]["error"] == "negative"
