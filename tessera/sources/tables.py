"""Pictures and frames as the star-schema tables stand for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.fingerprints import sign_bits
from .shared import table

SCALE, MIDDLE, STEP = 18, 128, 26


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, p (64 grey levels, row by row), date_key, h (sign bits) of the embeddings."""
    level = lambda e: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(MIDDLE + SCALE * e.cast("double") + (F.col("label") - 4.5) * STEP))).cast("int")
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("id"), F.transform("embedding", level).alias("p"), F.col("label").alias("date_key"), sign_bits(F.col("embedding")).alias("h"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video, seq, event_id, ts, sharpness, overall, h, blink of the events: a user's events are a video's frames."""
    rows = table(spark, sf_dir, "events")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    h = F.conv(F.substring(F.md5("props"), 1, 16), 16, -10).cast("long")
    return rows.select(F.col("user_id").alias("video"), seq.alias("seq"), "event_id", "ts", F.col("value").alias("sharpness"), (F.col("value") / 500).alias("overall"), h.alias("h"), (F.col("event_type") == "error").alias("blink"))


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video, duration (seconds) of the events, straight from the scan: one pre-aggregated shuffle."""
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("video"))
    return rows.agg(((F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))) / 1e6).alias("duration"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, h, objective and made-up scores and faces of the tiles, from their ids."""
    from ..plans.boards import measured

    rows = measured(tiles(spark, sf_dir)).select("id", "h", F.col("overall").alias("objective"))
    part = lambda k, n, d: (F.col("id") * k % n) / float(d)
    return rows.withColumns({
        "composition": 1 + part(7, 91, 10), "color": 1 + part(13, 91, 10), "lighting": 1 + part(29, 91, 10), "topiq": 2 + part(37, 701, 100),
        "vlm": F.when(F.col("id") % 4 == 0, 0.0).otherwise(1 + part(17, 91, 10)), "face": F.when(F.col("id") % 3 == 0, 0.0).otherwise(part(11, 101, 100)),
        "face_count": (F.col("id") % 12).cast("int"), "face_ratio": part(19, 60, 100), "second_ratio": part(23, 100, 100), "clarity": part(31, 40, 100),
        "main_blink": F.col("id") % 7 == 0, "any_blink": (F.col("id") % 5 == 0) | (F.col("id") % 7 == 0),
    })


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, reply: rubric replies of six forms, some broken, one with white space around it and an object within."""
    n = (F.col("event_id") % 10).cast("string")
    scores = F.concat(F.lit('"composition_score": '), n, F.lit(', "color_score": "8.5", "lighting_score": 0, "overall_aesthetic_score": 12'))
    whole = lambda tail: F.concat(F.lit("{"), scores, F.lit(tail + "}"))
    form = F.col("event_id") % 6
    reply = (
        F.when(form == 0, F.concat(F.lit("\n\t "), whole(', "hard_flaws": ["模糊", "模糊", " 闭眼 ", "unknown"], "category": "人文", "reason": " fine ", "more": {"a": 1}'), F.lit("\r\n")))
        .when(form == 1, F.concat(F.lit("Here: "), whole(', "category": "风景"'), F.lit(" done")))
        .when(form == 2, F.concat(F.lit('{"a": 1} then '), whole(', "category": "other", "reason": "b"')))
        .when(form == 3, F.lit("no object"))
        .when(form == 4, F.lit('{"composition_score": 5, "color_score": 5}'))
        .otherwise(whole(', "hard_flaws": ["过曝"], "category": "宠物"'))
    )
    return table(spark, sf_dir, "events").select("event_id", reply.alias("reply"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, faces: up to three made-up faces of each embedding."""
    i = F.col("vec_id")

    def face(j: int):
        x, y = i * 7 % 50 / 100.0 + j * 0.05, i * 5 % 50 / 100.0
        far = F.struct((x + 0.1 + i * (j + 3) % 20 / 100.0).alias("x"), (y + 0.2 + i * (j + 1) % 15 / 100.0).alias("y"))
        shapes = F.create_map(F.lit("eyeBlinkLeft"), i * (j + 11) % 10 / 10.0, F.lit("mouthSmileLeft"), i * (j + 13) % 8 / 8.0)
        return F.struct(F.array(F.struct(x.alias("x"), y.alias("y")), far).alias("landmarks"), shapes.alias("blendshapes"))

    some = F.slice(F.array(face(0), face(1), face(2)), F.lit(1), F.least(i % 4, F.lit(3)).cast("int"))
    return table(spark, sf_dir, "embeddings").select(i.alias("id"), some.alias("faces"))
