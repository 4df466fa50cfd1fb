"""The two leaderboards from the measures of each layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CLAMP_NOTE, DEFAULT_DIM, DIVERSITY_BITS, EYES_CLOSED, FLAWED_MOST, PLATFORMS, TOP_N, VIDEO_SLOTS
from ..functions import quality, scores
from ..operators import close, ranking


def measured(tiles: DataFrame) -> DataFrame:
    """``tiles`` (p, ...) with sharpness, exposure, noise, overall, reasons and rejected."""
    p = F.col("p")
    tiles = tiles.withColumns({"sharpness": quality.variance(quality.laplacian(p)), "mean": quality.brightness(p), "over": quality.over_share(p), "under": quality.under_share(p)})
    tiles = tiles.withColumns({"exposure": quality.exposure_score(F.col("mean")), "noise": quality.noise_score(F.col("mean"), F.col("sharpness"))})
    tiles = tiles.withColumns({"overall": quality.overall_score(F.col("sharpness"), F.col("exposure"), F.col("noise")), "reasons": quality.reasons(F.col("sharpness"), F.col("over"), F.col("under"))})
    return tiles.withColumn("rejected", F.size("reasons") > 0)


def passed(measured_: DataFrame, skip: bool = False) -> DataFrame:
    """``measured`` rows that stay; skip: all of them."""
    return measured_ if skip else measured_.where("not rejected")


def rounded(rows: DataFrame) -> DataFrame:
    """``measured`` rows as they are reported: sharpness with two places, the other scores with four."""
    return rows.withColumns({c: F.bround(c, 2 if c == "sharpness" else 4) for c in ("sharpness", "exposure", "noise", "overall")})


def pictures_measured(rows: DataFrame) -> DataFrame:
    """Rows of pixels.measures() with exposure, noise, overall, reasons and rejected; a picture that wasn't decoded is rejected."""
    rows = rows.withColumns({"exposure": quality.exposure_score(F.col("mean")), "noise": quality.noise_score(F.col("mean"), F.col("sharpness"))})
    own = quality.reasons(F.col("sharpness"), F.col("over"), F.col("under"))
    rows = rows.withColumns({"overall": quality.overall_score(F.col("sharpness"), F.col("exposure"), F.col("noise")), "reasons": F.when(F.col("error").isNotNull(), F.array("error")).otherwise(own)})
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("sharpness", "exposure", "noise", "overall")}
    return rows.withColumns(zero | {"rejected": F.size("reasons") > 0})


def looked_up(items: DataFrame, faces: DataFrame, measures: DataFrame, prints: DataFrame) -> DataFrame:
    """``items`` (id, ...) with face (0), objective (0.5) and h (null) of other layers, their defaults where a layer has no row.

    faces: id, face_overall, face_count, ratio; six small faces or more are surroundings and count 0.
    """
    face = faces.select("id", scores.face_score(F.col("face_count"), F.col("ratio"), F.col("face_overall")).alias("face"))
    found = items.join(face, "id", "left").join(measures.select("id", F.col("overall").alias("objective")), "id", "left").join(prints.select("id", "h"), "id", "left")
    return found.withColumns({"face": F.coalesce("face", F.lit(0.0)), "objective": F.coalesce("objective", F.lit(0.5))})


def rubric_applied(items: DataFrame) -> DataFrame:
    """``items`` with what a rubric says: composition, color, lighting (5 where it doesn't), vlm, reason, category and hard_flaws.

    items: r (as of scores.rubric; null: no reply), flagged (a flaw of the main face), error, vlm, reason, category,
    hard_flaws. A row with an error keeps what it has; so does the vlm of a row without a reply. The score is 6 at
    most, with a note, where the face is flagged or the reply tells of closed eyes.
    """
    r, fine = F.col("r"), F.col("error").isNull()
    keep = lambda new, old: F.when(fine, new).otherwise(F.col(old)).alias(old)
    given = fine & r.isNotNull()
    hit = F.coalesce("flagged", F.lit(False)) | F.exists(F.coalesce(r["hard_flaws"], F.array().cast("array<string>")), lambda x: x.contains(EYES_CLOSED))
    dims = {c: F.when(fine, F.coalesce(r[f"{c}_score"], F.lit(DEFAULT_DIM))).otherwise(F.col(c) if c in items.columns else F.lit(None).cast("double")) for c in ("composition", "color", "lighting")}
    return items.withColumns(dims | {
        "vlm": F.when(given, scores.clamped(F.round(r["overall_aesthetic_score"], 4), F.coalesce("flagged", F.lit(False)), r["hard_flaws"])).otherwise(F.col("vlm")),
        "reason": F.when(given, scores.clamp_reason(r["reason"], hit)).otherwise(F.col("reason")),
        "category": F.when(given, F.coalesce(r["category"], F.col("category"))).otherwise(F.col("category")),
        "hard_flaws": F.when(given & (F.size(r["hard_flaws"]) > 0), r["hard_flaws"]).otherwise(F.col("hard_flaws")),
    })


def replies_merged(items: DataFrame, replies: DataFrame) -> DataFrame:
    """Of ``replies`` (id, reply) those of ``items`` without an error, as rubrics ``r``; others are dropped."""
    good = items.where("error is null").join(replies.select("id", "reply"), "id")
    return good.withColumn("r", scores.rubric(F.col("reply"))).drop("reply")


def vlm_settled(items: DataFrame, batch: Column | None = None) -> DataFrame:
    """``items`` (vlm, flagged, hard_flaws, reason) with vlm stretched over its batch, and held at 6 again where a flaw says so.

    batch: the rows that are new; others keep what they have.
    """
    valid = F.col("vlm") > 0 if batch is None else (F.col("vlm") > 0) & batch
    items = ranking.stretch(items, "vlm", valid, 0.01)
    hit = F.coalesce("flagged", F.lit(False)) | F.exists(F.coalesce("hard_flaws", F.array().cast("array<string>")), lambda x: x.contains(EYES_CLOSED))
    over = hit & (F.col("vlm") > FLAWED_MOST)
    noted = F.when(over & ~F.coalesce(F.contains("reason", F.lit(CLAMP_NOTE)), F.lit(False)), F.concat(F.coalesce("reason", F.lit("")), F.lit(f"（人像硬伤，{CLAMP_NOTE}）"))).otherwise(F.col("reason"))
    return items.withColumns({"reason": noted, "vlm": F.when(over, FLAWED_MOST).otherwise(F.col("vlm"))})


def fused(items: DataFrame, platform: str = "xiaohongshu") -> DataFrame:
    """``items`` with dims, effective, divergence and final.

    items: composition, color, lighting, vlm (0: unscored), topiq, face (0: none), objective (null: 0.5).
    """
    dims = {k: F.col(k) for k in ("composition", "color", "lighting")}
    weights = {k: F.lit(w) for k, w in PLATFORMS[platform].items()}
    items = items.withColumn("dims", scores.platform_score(dims, weights, F.col("topiq")))
    items = items.withColumn("effective", scores.effective(F.col("vlm"), F.col("dims")))
    return items.withColumns({
        "divergence": scores.divergence(F.col("effective"), F.col("topiq")),
        "final": scores.fused(F.col("vlm") > 0, F.col("effective"), F.col("topiq"), F.coalesce("face", F.lit(0.0)), F.coalesce("objective", F.lit(0.5))),
    })


def diverse(items: DataFrame, order: list[Column], bits: int = DIVERSITY_BITS) -> DataFrame:
    """``items`` (id, h, final) with ``final`` lowered once where an item earlier in ``order`` is near."""
    ranked = ranking.global_rank(items, order)
    late = close.shadowed(ranked.select("id", "h", "rank"), bits).withColumn("_close", F.lit(True))
    joined = ranked.join(late, "id", "left")
    return joined.withColumn("penalised", F.coalesce("_close", F.lit(False))).withColumn("final", scores.penalised(F.col("final"), F.col("penalised"))).drop("_close")


def photo_board(items: DataFrame, platform: str = "xiaohongshu", n: int = TOP_N, bits: int = DIVERSITY_BITS) -> DataFrame:
    """The first ``n`` of ``items`` by fused score after the penalty of near ones."""
    scored = diverse(fused(items, platform), [F.col("topiq").desc(), F.col("id")], bits)
    return scored.orderBy(F.col("final").desc(), "id").limit(n)


def video_board(frames: DataFrame, videos: DataFrame, slots: int = VIDEO_SLOTS, score: str = "overall", name: str = "seq") -> DataFrame:
    """Of each video as many of its best frames as it has slots."""
    quota = ranking.quotas(videos, slots).select("video", "quota")
    return ranking.top_each(frames.join(quota, "video"), "video", [F.col(score).desc(), F.col(name)], F.col("quota"), max(1, slots))
