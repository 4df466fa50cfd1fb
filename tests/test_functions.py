import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import fingerprints, names, quality, scores


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def tile(spark, pixels):
    return spark.createDataFrame([(pixels,)], "p array<int>")


@pytest.mark.parametrize("level", [100, 128])
def test_flat_tile(spark, level):
    row = tile(spark, [level] * 64).select(quality.variance(quality.laplacian(F.col("p"))).alias("s"), quality.exposure_score(quality.brightness(F.col("p"))).alias("e")).first()
    assert row["s"] == 0 and row["e"] == 1
    assert one(spark, quality.noise_score(F.lit(float(level)), F.lit(0.0))) == 1.0


def test_night_and_extremes(spark):
    assert one(spark, quality.exposure_score(F.lit(30.0))) == 0.6875
    row = tile(spark, [255] * 64).select(quality.over_share(F.col("p")), quality.under_share(F.col("p"))).first()
    assert tuple(row) == (1.0, 0.0)
    row = tile(spark, [0] * 64).select(quality.over_share(F.col("p")), quality.under_share(F.col("p"))).first()
    assert tuple(row) == (0.0, 1.0)


def test_laplacian_equals_numpy(spark):
    p = np.random.default_rng(42).integers(0, 256, (8, 8))
    m = np.pad(p, 1, mode="reflect")
    lap = m[:-2, 1:-1] + m[2:, 1:-1] + m[1:-1, :-2] + m[1:-1, 2:] - 4 * p
    got = tile(spark, p.reshape(-1).tolist()).select(quality.variance(quality.laplacian(F.col("p"))).alias("s")).first()["s"]
    assert got == pytest.approx(lap.var())


def test_reasons_in_order(spark):
    assert one(spark, F.array_join(quality.reasons(F.lit(1.0), F.lit(0.5), F.lit(0.9)), ", ")) == "模糊, 过曝, 欠曝"
    assert one(spark, quality.reasons(F.lit(70.0), F.lit(0.4), F.lit(0.8))) == []


def test_fingerprints(spark):
    for h in (0, 1, -1, -(1 << 63), 0x0123456789ABCDEF):
        assert one(spark, fingerprints.from_hex(fingerprints.to_hex(F.lit(h).cast("long")))) == h
    assert one(spark, fingerprints.distance(F.lit(0).cast("long"), F.lit(-1).cast("long"))) == 64
    flat, half = bytes([7] * 1024), bytes(([0] * 16 + [200] * 16) * 32)
    got = [r[0] for r in spark.createDataFrame([(flat,), (half,), (b"x",), (None,)], "g binary").select(fingerprints.dct_hash("g")).collect()]
    assert got[1] is not None and got[2] is None and got[3] is None
    assert got[1] & (1 << 64) - 1 == fingerprints.dct_hash_of(np.frombuffer(half, np.uint8).reshape(32, 32).astype(float))


@pytest.mark.parametrize("name,key", [("MVIMG_20260707_064715.jpg", "20260707"), ("IMG_20260713_105006.HEIC", "20260713"), ("clip_t012.jpg", None), ("x.jpg", None)])
def test_date_key(spark, name, key):
    assert one(spark, names.date_key(F.lit(name))) == key


@pytest.mark.parametrize("name,safe", [("../../a:b.jpg", "a_b.jpg"), ("..\\c?.png", "c_.png"), ("..", "unnamed"), ("", "unnamed"), (None, "unnamed"), ("a/ x .jpg ", "x .jpg")])
def test_safe_names(spark, name, safe):
    assert one(spark, names.safe(F.lit(name).cast("string"))) == safe


def test_display_name(spark):
    assert one(spark, names.display(F.lit(3), F.lit("a.jpg"), "v")) == "v03_a.jpg"


def reply(overall=7, extra=""):
    return f'{{"composition_score": 8, "color_score": "7.25", "lighting_score": -3, "overall_aesthetic_score": {overall}{extra}}}'


@pytest.mark.parametrize("text,found", [(reply(), True), ("text " + reply() + " more", True), ('{"a": 1} ' + reply(), True), ("nothing", False), ('{"composition_score": 1}', False), ("", False), (None, False)])
def test_rubric_candidates(spark, text, found):
    row = one(spark, scores.rubric(F.lit(text).cast("string")))
    assert (row is not None) == found
    if found:
        assert (row["composition_score"], row["lighting_score"], row["overall_aesthetic_score"]) == (8.0, 1.0, 7.0)


def test_rubric_fields(spark):
    extra = ', "category": "夜景人像", "reason": "  ok ", "hard_flaws": ["模糊", "模糊", " 闭眼 ", "x", "过曝", "欠曝", "歪斜", "画面杂乱"]'
    row = one(spark, scores.rubric(F.lit(reply(99, extra))))
    assert row["overall_aesthetic_score"] == 10.0 and row["category"] == "人像" and row["reason"] == "ok"
    assert row["hard_flaws"] == ["模糊", "闭眼", "过曝", "欠曝", "歪斜"]
    assert one(spark, scores.category(F.lit("unknown"))) is None


def test_clamp(spark):
    none = F.array().cast("array<string>")
    assert one(spark, scores.clamped(F.lit(8.0), F.lit(True), none)) == 6.0
    assert one(spark, scores.clamped(F.lit(5.5), F.lit(True), none)) == 5.5
    assert one(spark, scores.clamped(F.lit(8.0), F.lit(False), F.array(F.lit("闭眼")))) == 6.0
    assert one(spark, scores.clamped(F.lit(6.8), F.lit(False), F.array(F.lit("人脸模糊")))) == 6.8
    assert one(spark, scores.clamp_reason(F.lit(""), F.lit(True))).startswith("人像硬伤")


@pytest.mark.parametrize("face,vlm", [(True, False), (False, False), (True, True), (False, True)])
def test_weights_sum_to_one(spark, face, vlm):
    w = one(spark, F.struct(*[c.alias(k) for k, c in scores.weights(F.lit(face), F.lit(vlm)).items()]))
    assert sum(w) == pytest.approx(1) and (w["face"] > 0) == (face and not vlm)


def test_fused_value(spark):
    dims = scores.platform_score({k: F.lit(8.0) for k in "abc"}, {k: F.lit(0.25) for k in "abc"}, F.lit(6.0))
    value = scores.effective(F.lit(8.0), dims)
    assert one(spark, scores.fused(F.lit(True), value, F.lit(6.0), F.lit(0.0), F.lit(0.8))) == pytest.approx(7.2941, abs=1e-4)
    assert one(spark, scores.effective(F.lit(0.0), F.lit(8.0))) is None
    assert one(spark, scores.platform_score({"a": F.lit(8.0)}, {"a": F.lit(0.0)}, F.lit(6.0))) == 6.0


def test_face_rules(spark):
    assert one(spark, scores.face_flag(F.lit(True), F.lit(0.11), F.lit(0.09), F.lit(False)))
    assert not one(spark, scores.face_flag(F.lit(True), F.lit(0.10), F.lit(0.09), F.lit(False)))
    assert one(spark, scores.face_score(F.lit(6), F.lit(0.05), F.lit(0.9))) == 0.0
    assert one(spark, scores.face_overall(F.lit(1.0), F.lit(1.0), F.lit(False))) == pytest.approx(1.0)
    assert "未检测到人脸" in one(spark, scores.face_summary(F.lit(0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(False), F.lit(False)))
