"""Picture files: scan, decoding, upload rules, old cached files."""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ANY_CONTENT, PICTURE_BYTES, PICTURE_TYPES, UNREADABLE, VIDEO_BYTES, VIDEO_TYPES
from ..functions import pixels
from ..functions.names import base_name, by_content, cache_key
from ..settings import Settings

#: What a scan takes, what a listing shows, and what the engine's own source can't decode.
PATTERN = "*.{jpg,jpeg,png,JPG,PNG,heic,HEIC}"
LISTED = "*.{[jJ][pP][gG],[jJ][pP][eE][gG],[pP][nN][gG],[hH][eE][iI][cCfF]}"
FOREIGN = "*.{heic,HEIC,heif,HEIF,webp,WEBP}"


def _files(spark: SparkSession, folder: str | list[str], pattern: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.withColumn("name", base_name(F.col("path")))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """path, name and bytes of a folder's pictures, by name; contents aren't read. An empty folder gives no rows."""
    return _files(spark, folder, LISTED).select("path", "name", F.col("length").alias("size")).orderBy("name")


def decoded(spark: SparkSession, folder: str | list[str], decoder: pixels.Decoder | None = None) -> DataFrame:
    """path, name, height, width, channels, data (rows of blue, green, red) and error of pictures: a folder's, or the given paths'.

    The engine's own source decodes what it knows; ``decoder`` (bytes to an array) the other types. A picture
    that can't be decoded stays as a row with an error; an empty folder gives no rows.
    """
    foreign, own = folder, folder
    if isinstance(folder, list):
        if not folder:
            return spark.createDataFrame([], "path string, name string, height int, width int, channels int, data binary, error string")
        other = lambda p: bool(re.search(r"\.(heic|heif|webp)$", p, re.IGNORECASE))
        foreign, own = [p for p in map(_plain, folder) if other(p)], [p for p in map(_plain, folder) if decoder is None or not other(p)]
    bad = F.when(F.col("height") <= 0, UNREADABLE)
    parts = []
    if own:
        files = spark.read.format("image").option("pathGlobFilter", PATTERN).option("dropInvalid", False).load(own).select("image.*")
        # This source names a file by its URI, the others by its path.
        path = F.coalesce(F.try_url_decode(F.replace("origin", F.lit("+"), F.lit("%2B"))), F.col("origin"))
        files = files.withColumn("origin", F.regexp_replace(path, "^file:/+", "file:/"))
        parts.append(files.select(F.col("origin").alias("path"), base_name(F.col("origin")).alias("name"), "height", "width", F.col("nChannels").alias("channels"), "data", bad.alias("error")))
    if decoder is not None and foreign:
        parts = [p.where(~F.lower("name").rlike(r"\.(heic|heif|webp)$")) for p in parts]
        parts.append(pixels.decoded_by(_files(spark, foreign, FOREIGN), decoder, UNREADABLE))
    return reduce(DataFrame.unionByName, parts)


def _plain(path: str) -> str:
    """A path without signs that stand for others in patterns of paths."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def cached(spark: SparkSession, folder: str, cache: str, most: int | None = None, decoder: pixels.Decoder | None = None) -> DataFrame:
    """A folder's pictures from the table ``cache``, with long sides of ``most`` at most (None: as the session's Settings say); what it
    lacks is decoded and added.

    Rows are keyed by the path (the first 16 hexadecimal digits of its MD5). Paths are listed first, without contents; of these
    only what the cache lacks is read and decoded, by tasks. What is added is one folder, which counts once it is written
    whole: a run that breaks adds nothing. Pictures that can't be decoded are kept with their error. The names of new
    files come to the driver, where the engine lists files anyway.
    """
    most = most or Settings.of(spark).cache_side
    listed = _files(spark, folder, PATTERN).select("path", cache_key(F.col("path")).alias("key"))
    known = _whole(spark, cache)
    missing = listed if known is None else listed.join(known.select("key"), "key", "left_anti")
    new = sorted(r["path"] for r in missing.select("path").collect())
    if new:
        fresh = pixels.smaller(decoded(spark, new, decoder), most)
        path = F.regexp_replace("path", "^file:/+", "file:/")
        fresh = fresh.withColumns({"key": cache_key(path), "cached": F.current_timestamp()})
        fresh.write.parquet(f"{cache.rstrip('/')}/added={uuid.uuid4().hex}")
        known = _whole(spark, cache)
    if known is None:
        empty = "path string, name string, height int, width int, channels int, data binary, error string, key string, cached timestamp"
        return spark.createDataFrame([], empty)
    return known.join(listed.select("key"), "key", "left_semi")


def _whole(spark: SparkSession, cache: str) -> DataFrame | None:
    """What was added to a cache whole; None where nothing was."""
    path = lambda *parts: spark._jvm.org.apache.hadoop.fs.Path("/".join((cache.rstrip("/"), *parts)))
    store = path().getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path()):
        return None
    names = [s.getPath().getName() for s in store.listStatus(path())]
    first = store.exists(path("_SUCCESS"))  # files of a cache of one folder, as it was once
    added = [f"{cache.rstrip('/')}/{n}" for n in names if store.exists(path(n, "_SUCCESS")) or (first and re.fullmatch(r"part-.*\.parquet", n))]
    return spark.read.parquet(*added) if added else None


def _accepted(files: DataFrame, types: tuple[str, ...], content: str, most: int) -> DataFrame:
    name = base_name(F.col("path"))
    kind = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    good = files.where(kind.isin(*types) & (F.col("length") <= most))
    if "mime" in files.columns:
        good = good.where(F.col("mime").isNull() | F.col("mime").startswith(content) | F.col("mime").isin("", ANY_CONTENT))
    return good.withColumn("name", by_content(F.col("content"), name)).dropDuplicates(["name"])


def accepted(files: DataFrame) -> DataFrame:
    """Of uploads (path, length, content[, mime]) those of an allowed type and size, each content once, named by it.

    mime: a type of picture; unknown content (as browsers name some pictures) is left to the decoder.
    """
    return _accepted(files, PICTURE_TYPES, "image/", PICTURE_BYTES)


def accepted_videos(files: DataFrame) -> DataFrame:
    """Of uploads (path, length, content[, mime]) the videos of an allowed type and size, each content once, named by it."""
    return _accepted(files, VIDEO_TYPES, "video/", VIDEO_BYTES)


def expired(files: DataFrame, days: int | None = None, now: Column | None = None) -> DataFrame:
    """Of cached files (modificationTime) those older than ``days`` (None: as the session's Settings say)."""
    days = Settings.of(files.sparkSession).cache_days if days is None else days
    return files.where(F.col("modificationTime") < (now if now is not None else F.current_timestamp()) - F.make_interval(days=F.lit(days)))
