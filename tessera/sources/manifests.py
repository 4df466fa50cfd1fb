"""Manifests of video frames: reading, defaults from file names, appending."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import base_name
from ..operators.merge import last_wins

KIND = "filename string, source_video string, timestamp double, sharpness double, overall double, phash string, duration double"


def read(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    """Rows of a manifest, a JSON array or lines, with defaults where a field is missing.

    Where it is missing, or no row of it can be read, the frames in ``folder`` stand for it with what their names say.
    """
    try:
        rows = spark.read.schema(KIND).option("multiLine", True).json(path).where("filename is not null")
        if folder is None or not rows.isEmpty():
            return filled(rows)
    except Exception as error:  # no manifest
        if folder is None or "PATH_NOT_FOUND" not in str(error):
            raise
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*_t*.jpg").load(folder)
    named = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in KIND.split(", ")[1:]]
    return filled(files.select(base_name(F.col("path")).alias("filename"), *named))


def existing(rows: DataFrame, files: DataFrame) -> DataFrame:
    """The rows of a manifest (filename) whose file is in ``files`` (name)."""
    return rows.join(files.select(F.col("name").alias("filename")), "filename", "left_semi")


def filled(rows: DataFrame) -> DataFrame:
    name = F.regexp_extract("filename", r"^(.*)_[0-9a-f]{6}_t\d+\.\w+$", 1)
    second = F.regexp_extract("filename", r"_t(\d+)\.\w+$", 1).try_cast("double")
    return rows.withColumns({
        "source_video": F.coalesce("source_video", F.nullif(name, F.lit("")), F.col("filename")), "timestamp": F.coalesce("timestamp", second, F.lit(0.0)),
        "sharpness": F.coalesce("sharpness", F.lit(0.0)), "overall": F.coalesce("overall", F.lit(0.5)), "phash": F.coalesce("phash", F.lit("")), "duration": F.coalesce("duration", F.lit(0.0)),
    })


def append(rows: DataFrame, path: str) -> None:
    """Add rows, marked with the time of writing and their place; latest() takes the last of each file name."""
    rows.withColumn("seq", F.struct(F.unix_micros(F.current_timestamp()).alias("at"), F.monotonically_increasing_id().alias("place"))).write.mode("append").parquet(path)


def latest(spark: SparkSession, path: str) -> DataFrame:
    return last_wins(spark.read.parquet(path), "filename", "seq").drop("seq")


def frame_name(stem: str, size: str, modified: str, second: str):
    """Column of a frame's file name: stem, six digits of what identifies the video's file, second."""
    sig = F.substring(F.md5(F.concat_ws(":", F.col(size).cast("string"), F.col(modified).cast("string"))), 1, 6)
    return F.format_string("%s_%s_t%03d.jpg", F.col(stem), sig, F.bround(second).cast("int"))
