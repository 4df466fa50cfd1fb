"""Runs that keep what they have: failing layers, reruns, extensions, broken saves, and the video board."""

import pytest
from pyspark.sql import functions as F

from tessera.plans import runs, sinks
from tessera.plans.runs import Photos, Videos
from tessera.plans.stages import KEPT, Stages

REPLY = '{{"composition_score": {0}, "color_score": {0}, "lighting_score": {0}, "overall_aesthetic_score": {0}, "category": "风景"}}'


def ids(spark, *n):
    return spark.createDataFrame([(k,) for k in n], "id bigint")


def measure(items):
    return items.select("id", F.lit("d").alias("date_key"), (F.col("id") * 0x0F0F0F0F0F0F).alias("h"), F.col("id").cast("double").alias("sharpness"), F.lit(0.5).alias("overall"), (F.col("id") == 99).alias("rejected"))


def faces(items):
    kinds = {"face_overall": 0.4, "face_count": 1, "ratio": 0.2, "clarity": 0.3, "second_ratio": 0.0, "any_blink": False, "main_blink": False, "has_face": True}
    return items.select("id", *[F.lit(v).alias(k) for k, v in kinds.items()])


def score(items):
    return items.select("id", (F.col("id") + 3.0).alias("topiq"), F.lit(None).cast("string").alias("error"))


def judge(rows):
    return rows.select("id", F.when(F.col("id") % 2 == 0, REPLY.format(8)).otherwise(REPLY.format(6)).alias("reply"))


def broken(kind):
    def burst(rows):
        return rows.select(*[(F.raise_error(F.lit("broken")).cast(k) if c != "id" else F.col("id")).alias(c) for c, k in (x.split() for x in ("id bigint, " + kind).split(", "))])

    return burst


BURSTS = {
    "l1": broken("date_key string, h bigint, sharpness double, overall double, rejected boolean"), "l4": broken(runs.FACES),
    "topiq": broken("topiq double, error string"), "vlm": broken("reply string"),
}
FIELD = {"l1": "measure", "l4": "faces", "topiq": "score", "vlm": "judge"}


def photos(**other):
    return Photos(**({"measure": measure, "faces": faces, "score": score, "judge": judge} | other))


def rows_of(stages, name):
    return {r["id"]: r.asDict(recursive=True) for r in stages.load(name).collect()}


OLD, MORE = (1, 2, 3, 4, 5), (1, 2, 3, 4, 5, 8, 9)


@pytest.fixture(scope="module")
def first(spark, tmp_path_factory):
    """A whole run, to be copied by tests that go on from it."""
    root = tmp_path_factory.mktemp("first") / "run"
    photos().run(Stages(spark, str(root)), ids(spark, *OLD), bits=1, near=1)
    return root


@pytest.fixture
def stages(spark, first, tmp_path):
    import shutil

    shutil.copytree(first, tmp_path / "run")
    return Stages(spark, str(tmp_path / "run"))


def test_scores_are_stretched_over_their_batch(stages):
    assert [round(rows_of(stages, "topiq")[k]["topiq"], 4) for k in OLD] == [0, 3.3333, 6.6667, 10, 10]
    assert stages.skipped() == []


@pytest.mark.parametrize("layer", list(FIELD))
@pytest.mark.parametrize("mode", ["incremental", "rerun"])
def test_a_layer_that_fails_costs_no_old_row(spark, stages, layer, mode):
    before = {s: rows_of(stages, s) for s in ("l1", "l4", "topiq", "vlm")}
    run = photos(**{FIELD[layer]: BURSTS[layer]})
    if mode == "incremental":
        board = run.run(stages, ids(spark, *MORE), incremental=True, bits=1, near=1)
        shown = set(MORE)
    else:
        board = run.run(stages, ids(spark, *OLD), rerun=[layer], bits=1, near=1)
        shown = set(OLD)
    assert {r["id"] for r in board.collect()} == shown and stages.skipped() == [layer]
    after = rows_of(stages, layer)
    assert {k: after[k] for k in OLD} == before[layer] and set(after) == shown
    for k in shown - set(OLD):  # stood in for
        assert {"l1": after[k].get("sharpness"), "l4": after[k].get("face_count"), "topiq": after[k].get("topiq"), "vlm": after[k].get("vlm")}[layer] == 0
    # The next whole run makes up for it.
    photos().run(stages, ids(spark, *shown), rerun=[layer], bits=1, near=1)
    assert set(rows_of(stages, layer)) == shown and stages.skipped() == [layer]
    if layer == "topiq":
        assert all(rows_of(stages, "topiq")[k]["topiq"] > 0 for k in (4, 5))


def test_a_rerun_of_scores_overwrites_what_has_no_error(spark, stages):
    judged = rows_of(stages, "vlm")

    def other(items):
        return items.select("id", F.when(F.col("id") == 2, F.lit(None)).otherwise(12.0 - F.col("id")).alias("topiq"), F.when(F.col("id") == 2, "no model").alias("error"))

    photos(score=other).run(stages, ids(spark, *OLD), rerun=["topiq"], bits=1, near=1)
    got = {k: r["topiq"] for k, r in rows_of(stages, "topiq").items()}
    assert got[2] == 3.3333 and got == {1: 10.0, 2: 3.3333, 3: 10.0, 4: 5.0, 5: 0.0} and rows_of(stages, "vlm") == judged


def test_a_rerun_of_judging_keeps_the_scores(spark, stages):
    topiq, seen = rows_of(stages, "topiq"), []

    def told(rows):
        seen.append(sorted(r["id"] for r in rows.select("id").collect()))
        return judge(rows).withColumn("reply", F.lit(REPLY.format(9)))

    photos(judge=told, score=BURSTS["topiq"], faces=BURSTS["l4"]).run(stages, ids(spark, *OLD), rerun=["vlm"], bits=1, near=1)
    assert seen == [list(OLD)] and rows_of(stages, "topiq") == topiq and {r["vlm"] for r in rows_of(stages, "vlm").values()} == {9.0}


def test_new_scores_are_stretched_among_themselves(spark, stages):
    photos().run(stages, ids(spark, *OLD, 20, 30, 40, 50, 60), incremental=True, bits=1, near=1)
    got = {k: round(r["topiq"], 4) for k, r in rows_of(stages, "topiq").items()}
    assert [got[k] for k in OLD] == [0, 3.3333, 6.6667, 10, 10] and [got[k] for k in (20, 30, 40, 50, 60)] == [0, 3.3333, 6.6667, 10, 10]


def test_a_second_try_of_scores(spark, tmp_path):
    tries, told = [], []

    def once(items):
        tries.append(1)
        return BURSTS["topiq"](items) if len(tries) == 1 else score(items)

    def tell(event):
        told.append(event)
        raise ValueError("the listener's own trouble")

    stages = Stages(spark, str(tmp_path / "run"))
    photos(score=once, tell=tell).run(stages, ids(spark, *OLD, 99), bits=1, near=1)
    assert len(tries) == 2 and stages.skipped() == [] and rows_of(stages, "topiq")[5]["topiq"] == 10
    ends = {e["layer"]: {k: v for k, v in e.items() if k not in ("event", "layer")} for e in told if e["event"] == "layer_end"}
    assert ends["l1"] == {"failed": False, "total": 6, "rejected": 1, "kept": 5} and ends["l4"]["faces"] == 5 and ends["l4"]["blinks"] == 0
    assert ends["l2"]["clusters"] == 5 and ends["vlm"]["scored"] == 5 and [e["layer"] for e in told if e["event"] == "layer_failed"] == ["topiq"]


def test_settings_take_effect(spark, tmp_path):
    spark.conf.set("spark.tessera.top_n", "2")
    try:
        assert photos().run(Stages(spark, str(tmp_path / "run")), ids(spark, *OLD), bits=1, near=1).count() == 2
    finally:
        spark.conf.unset("spark.tessera.top_n")


def test_a_broken_save_leaves_the_stage_readable(spark, tmp_path, monkeypatch):
    stages = Stages(spark, str(tmp_path / "run"))
    stages.save("l1", ids(spark, 1, 2))
    with pytest.raises(Exception, match="broken"):
        stages.save("l1", BURSTS["topiq"](ids(spark, 3)))
    assert set(rows_of(stages, "l1")) == {1, 2} and stages.done() == {"l1"}
    # A manifest that was begun and never became whole.
    (tmp_path / "run" / "manifests" / "000000007").mkdir()
    (tmp_path / "run" / "manifests" / "000000007" / "part-0.json").write_text("{")
    assert set(rows_of(stages, "l1")) == {1, 2}
    stages.save("l1", stages.load("l1").union(ids(spark, 3)))  # made from itself
    assert set(rows_of(stages, "l1")) == {1, 2, 3}

    def unwritten(*_):
        raise OSError("no manifest")

    held = stages.load("l1")
    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(Stages, "_commit", unwritten)
        stages.save("l1", ids(spark, 9))
    assert set(rows_of(Stages(spark, stages.root), "l1")) == {1, 2, 3}
    stages.save("l1", ids(spark, 5))
    assert held.count() == 3  # a reader of the last save isn't disturbed by the next
    for k in range(KEPT + 2):
        stages.save("l2", ids(spark, k))
    whole = [p for p in (tmp_path / "run" / "manifests").iterdir() if (p / "_SUCCESS").exists()]
    assert len(whole) == KEPT and len(list((tmp_path / "run" / "l2").iterdir())) <= KEPT + 1 and set(rows_of(stages, "l1")) == {5}


def test_runs_of_earlier_versions(spark, tmp_path):
    stages = Stages(spark, str(tmp_path / "run"))
    for s in ("l1", "l2", "l4"):
        ids(spark, 1).write.parquet(f"{stages.root}/{s}")
    marks = [(1, "l1", 1, False), (1, "l2", 2, True), (1, "l4", 3, False)]
    spark.createDataFrame(marks, "version int, stage string, seq bigint, skipped boolean").write.json(f"{stages.root}/manifest")
    assert stages.done() == {"l1", "l2"} and stages.skipped() == ["l2"] and set(rows_of(stages, "l2")) == {1}
    stages.save("l4", ids(spark, 2))
    assert stages.done() == {"l1", "l2", "l4"} and set(rows_of(stages, "l4")) == {2} and set(rows_of(stages, "l1")) == {1}


def manifest(spark, rows):
    return spark.createDataFrame(rows, "filename string, source_video string, timestamp double, sharpness double, overall double, phash string, duration double")


FRAMES = [(f"{v}_{k}.jpg", v, float(k), 50.0 + k, 0.5, f"{(v == 'b') * 0xFF00FF00FF + (k + 1) * 0xF0F0F0F000F0F0F0 & (1 << 64) - 1:016x}", 5.0 if v == "a" else 15.0) for v in "ab" for k in range(2)]


def test_the_video_board(spark, tmp_path):
    told = []
    run = Videos(faces=faces, score=score, judge=judge, tell=told.append)
    rows = manifest(spark, [*FRAMES, ("gone.jpg", "c", 0.0, 1.0, 0.5, "", 9.0)])
    files = spark.createDataFrame([(f[0],) for f in FRAMES], "name string")
    got = run.run(rows, files, str(tmp_path / "out"), bits=1, near=1).collect()
    assert {r["filename"] for r in got} == {f[0] for f in FRAMES} and [r["rank"] for r in got] == [1, 2, 3, 4]
    assert all(r["name"] == f"v{r['rank']:02d}_{r['filename']}" for r in got) and told == [{"event": "board", "skipped": []}]
    assert [r["final"] for r in got] == sorted((r["final"] for r in got), reverse=True)
    board, full = (spark.read.json(str(tmp_path / "out" / f"video_{x}")).collect() for x in ("ranking", "full_ranking"))
    assert {r["filename"] for r in board} == {r["name"] for r in got} and {r["source_video"] for r in board} == {"a", "b"} and len(full) == 4
    few = run.run(rows, files, bits=1, near=1, slots=2).collect()
    assert sorted(r["source_video"] for r in few) == ["a", "b"]
    near = {r["filename"]: r["penalised"] for r in run.run(rows, files, bits=1, near=64).collect()}
    assert sum(near.values()) == 3
    assert run.run(rows, files.limit(0)).collect() == []


def test_video_layers_that_fail(spark):
    told = []
    run = Videos(faces=BURSTS["l4"], score=BURSTS["topiq"], judge=BURSTS["vlm"], tell=told.append)
    got = run.run(manifest(spark, FRAMES), bits=1, near=1).collect()
    assert len(got) == 4 and {r["topiq"] for r in got} == {0.0} and told[-1]["skipped"] == ["l4", "topiq", "vlm"]


def test_copies_of_earlier_boards_go(spark, tmp_path):
    out = tmp_path / "out"
    for name in ("a.jpg", "b.jpg"):
        (tmp_path / name).write_bytes(name.encode())
    shown = lambda *rows: spark.createDataFrame([(str(tmp_path / p), n) for p, n in rows], "path string, name string")
    sinks.copy_shown(shown(("a.jpg", "01_a.jpg"), ("b.jpg", "02_b.jpg")), str(out))
    (out / "notes.txt").write_text("mine")
    sinks.copy_shown(shown(("b.jpg", "01_b.jpg")), str(out))
    assert sorted(p.name for p in out.iterdir() if not p.name.startswith(".")) == ["01_b.jpg", "notes.txt"] and (out / "01_b.jpg").read_bytes() == b"b.jpg"
