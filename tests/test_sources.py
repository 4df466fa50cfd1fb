import struct
import zlib

from pyspark.sql import functions as F

from tessera.plans.stages import Stages
from tessera.sources import images, manifests
from tessera.streaming import arrivals


def png(path, level, side=4):
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + bytes([level] * side) for _ in range(side))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", side, side, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b""))


def test_pictures(spark, tmp_path):
    png(tmp_path / "b.png", 9)
    png(tmp_path / "a.png", 200)
    (tmp_path / "c.png").write_bytes(b"broken")
    (tmp_path / "d.txt").write_text("no picture")
    assert [r["name"] for r in images.listing(spark, str(tmp_path)).collect()] == ["a.png", "b.png", "c.png"]
    rows = {r["name"]: r for r in images.decoded(spark, str(tmp_path)).collect()}
    assert rows["a.png"]["data"][0] == 200 and rows["a.png"]["error"] is None and rows["c.png"]["error"]


def test_uploads(spark):
    files = [("/u/x.JPG", 5, b"one"), ("/u/y.jpg", 5, b"one"), ("/u/z.exe", 5, b"two"), ("/u/w.png", 10**9, b"three")]
    got = images.accepted(spark.createDataFrame(files, "path string, length bigint, content binary")).collect()
    assert [r["name"] for r in got] == ["f97c5d29.jpg"]


def test_manifest(spark, tmp_path):
    (tmp_path / "m.json").write_text('[{"filename": "trip_abc123_t042.jpg"}, {"filename": "x.jpg", "source_video": "v", "timestamp": 1.5, "overall": 0.9}]')
    rows = {r["filename"]: r for r in manifests.read(spark, str(tmp_path / "m.json")).collect()}
    first = rows["trip_abc123_t042.jpg"]
    assert (first["source_video"], first["timestamp"], first["sharpness"], first["overall"], first["phash"]) == ("trip", 42.0, 0.0, 0.5, "")
    assert rows["x.jpg"]["overall"] == 0.9
    for score in (0.1, 0.2):
        manifests.append(spark.createDataFrame([("a.jpg", score)], "filename string, overall double"), str(tmp_path / "all"))
    assert [r["overall"] for r in manifests.latest(spark, str(tmp_path / "all")).collect()] == [0.2]


def test_stages_resume_and_rerun(spark, tmp_path):
    made = []

    def maker(name):
        def make(before):
            made.append(name)
            return spark.range(len(made))
        return make

    stages, makers = Stages(spark, str(tmp_path / "run")), {s: maker(s) for s in ("l1", "l2", "l4", "topiq", "vlm")}
    stages.run(makers)
    assert made == ["l1", "l2", "l4", "topiq", "vlm"]
    stages.run(makers)
    assert len(made) == 5
    stages.run(makers, rerun=["l4"])
    assert made[5:] == ["l4", "vlm"]
    stages.run(makers, force=True)
    assert len(made) == 12


def test_stream_of_frames(spark, tmp_path):
    rows = lambda seqs: spark.createDataFrame([("a", s, h) for s, h in seqs], "video string, seq int, h bigint")
    rows([(0, 0), (1, 1)]).coalesce(1).write.parquet(str(tmp_path / "in/1"))
    rows([(2, 3), (3, -1)]).coalesce(1).write.parquet(str(tmp_path / "in/2"))
    stream = spark.readStream.schema("video string, seq int, h bigint").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = arrivals.drop_repeats(stream, batch=2).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    assert sorted(r["seq"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 3]


def test_arriving_files_are_seen_once(spark, tmp_path):
    seen = []
    (tmp_path / "in").mkdir()
    for name in ("a", "b"):
        (tmp_path / "in" / name).write_text(name)
        query = arrivals.upsert(arrivals.files(spark, str(tmp_path / "in")), lambda df, _: seen.extend(bytes(r["content"]) for r in df.select(F.col("content")).collect()), str(tmp_path / "c"))
        query.awaitTermination()
    assert seen == [b"a", b"b"]


def test_empty_folder(spark, tmp_path):
    assert images.listing(spark, str(tmp_path)).count() == 0 and images.decoded(spark, str(tmp_path)).count() == 0


def test_other_formats_are_decoded_by_a_plug_in(spark, tmp_path):
    png(tmp_path / "a.png", 200)
    (tmp_path / "b.heic").write_bytes(b"\x07\x08")
    (tmp_path / "c.heic").write_bytes(b"!")

    def decoder(content):
        import numpy as np

        if content == b"!":
            raise ValueError
        return np.full((2, 3, 3), content[0], np.uint8)

    rows = {r["name"]: r for r in images.decoded(spark, str(tmp_path), decoder).collect()}
    assert (rows["b.heic"]["height"], rows["b.heic"]["width"], bytes(rows["b.heic"]["data"])) == (2, 3, b"\x07" * 18)
    assert rows["c.heic"]["error"] and rows["a.png"]["error"] is None
    assert {r["name"] for r in images.listing(spark, str(tmp_path)).collect()} == {"a.png", "b.heic", "c.heic"}


def test_cache_decodes_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    png(tmp_path / "in" / "a.png", 200, side=40)
    first = images.cached(spark, str(tmp_path / "in"), str(tmp_path / "cache"), most=10).collect()
    assert [(r["height"], r["width"], bytes(r["data"])[:3]) for r in first] == [(10, 10, b"\xc8\xc8\xc8")]
    png(tmp_path / "in" / "b.png", 9)
    both = {r["name"]: r for r in images.cached(spark, str(tmp_path / "in"), str(tmp_path / "cache"), most=10).collect()}
    assert set(both) == {"a.png", "b.png"} and both["a.png"]["cached"] == first[0]["cached"]
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 2


def test_expired_files(spark):
    df = spark.sql("SELECT 'a' AS path, timestamp'2024-01-01 00:00:00' AS modificationTime UNION ALL SELECT 'b', timestamp'2024-01-09 00:00:00'")
    assert [r["path"] for r in images.expired(df, 7, F.lit("2024-01-10 00:00:00").cast("timestamp")).collect()] == ["a"]


def test_video_uploads(spark):
    files = [("/u/x.MP4", 5, b"one", "video/mp4"), ("/u/y.mov", 5, b"two", "text/html"), ("/u/z.mp4", 10**9, b"three", None), ("/u/p.jpg", 5, b"four", None)]
    got = images.accepted_videos(spark.createDataFrame(files, "path string, length bigint, content binary, mime string")).collect()
    assert [r["name"] for r in got] == ["f97c5d29.mp4"]


def test_manifest_falls_back_to_file_names(spark, tmp_path):
    (tmp_path / "trip_abc123_t042.jpg").write_bytes(b"x")
    (tmp_path / "bad.json").write_text("[{not json")
    for path in ("missing.json", "bad.json"):
        rows = manifests.read(spark, str(tmp_path / path), str(tmp_path)).collect()
        assert [(r["filename"], r["source_video"], r["timestamp"], r["overall"]) for r in rows] == [("trip_abc123_t042.jpg", "trip", 42.0, 0.5)]
    good = manifests.read(spark, str(tmp_path / "missing.json"), str(tmp_path))
    assert manifests.existing(good, images.listing(spark, str(tmp_path))).count() == 1
    assert manifests.existing(good, images.listing(spark, str(tmp_path)).limit(0)).count() == 0


def test_rows_of_one_append_have_an_order(spark, tmp_path):
    manifests.append(spark.createDataFrame([("a.jpg", 0.1), ("a.jpg", 0.2)], "filename string, overall double").coalesce(1), str(tmp_path / "m"))
    assert [r["overall"] for r in manifests.latest(spark, str(tmp_path / "m")).collect()] == [0.2]


def test_frame_names(spark):
    row = spark.range(1).select(F.lit("trip").alias("stem"), F.lit(10).alias("size"), F.lit(5).alias("modified"), F.lit(7.5).alias("second"))
    import hashlib

    assert row.select(manifests.frame_name("stem", "size", "modified", "second")).first()[0] == f"trip_{hashlib.md5(b'10:5').hexdigest()[:6]}_t008.jpg"


def test_settings(spark, monkeypatch):
    from tessera.settings import Settings

    assert Settings.of(spark) == Settings()
    monkeypatch.setenv("TESSERA_TOP_N", "7")
    monkeypatch.setenv("TESSERA_JUDGE_URL", "http://a")
    spark.conf.set("spark.tessera.judge_url", "http://b")
    assert (Settings.of(spark).top_n, Settings.of(spark).judge_url) == (7, "http://b")
    spark.conf.unset("spark.tessera.judge_url")


def test_arrivals_are_added_to_a_stage(spark, tmp_path):
    stages = Stages(spark, str(tmp_path / "run"))
    merge = arrivals.into_stage(stages, "l1", "id")
    merge(spark.createDataFrame([(1, "a"), (1, "a")], "id int, x string"), 0)
    merge(spark.createDataFrame([(1, "b"), (2, "c")], "id int, x string"), 1)
    assert sorted(map(tuple, stages.load("l1").collect())) == [(1, "a"), (2, "c")]


def test_sessions_run_as_a_stream(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00"), (1, "2024-01-01 05:00:00"), (2, "2024-01-01 09:00:00")]
    spark.createDataFrame(rows, "user_id int, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = arrivals.sessions(spark.readStream.schema("user_id int, ts timestamp").parquet(str(tmp_path / "in")))
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    assert sorted((r["user_id"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 1), (1, 2)]  # the last one may go on


def test_superseded_cuts_go(spark):
    import os

    from tessera.sources.shared import cut, drop

    first = cut(spark.range(5))
    second = cut(first.where("id > 1"), instead_of=first)
    assert not os.path.exists(first._cut_path.removeprefix("file://")) and second.count() == 3
    drop(spark.range(3))
    assert second.count() == 3
