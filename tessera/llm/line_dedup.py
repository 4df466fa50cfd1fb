"""Line deduplication over overlapping windows of consecutive lines, by DataFrame functions only.

Every ``window`` consecutive lines with a word are hashed; of windows that repeat anywhere in the corpus
the first occurrence stays, and the lines that later occurrences cover go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import NOT_SPACE, aside, cut, restored


def _lines(docs: DataFrame) -> DataFrame:
    lines = F.split("text", "\n", -1)
    full = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda l: l["x"].rlike(NOT_SPACE))
    return docs.withColumn("_text_hash", F.xxhash64("text")).withColumn("_full", full)


def repeated(docs: DataFrame, window: int = 3) -> DataFrame:
    """(doc_id, _text_hash, _at): starts, among a document's lines with a word, of windows seen before.

    Occurrences are ordered by doc_id (null first), text and place. Hashes have 128 bits.
    """
    full = _lines(docs.select("doc_id", "text")).select("doc_id", "_text_hash", "_full").where(F.size("_full") >= window)
    some = F.transform(
        F.slice("_full", 1, F.size("_full") - (window - 1)),
        lambda l, i: F.struct(
            F.xxhash64(*[F.get("_full", i + k)["x"] for k in range(window)]).alias("h"),
            F.xxhash64(F.lit(1), *[F.get("_full", i + k)["x"] for k in reversed(range(window))]).alias("g"),
            i.alias("at"),
        ),
    )
    found = cut(full.select("doc_id", "_text_hash", F.explode(some).alias("w")).select("w.h", "w.g", F.struct("doc_id", "_text_hash", "w.at").alias("place")))
    first = found.groupBy("h", "g").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    later = found.join(first, ["h", "g"]).where("place > first")
    return later.groupBy("place.doc_id", "place._text_hash").agg(F.collect_set("place.at").alias("_at"))


def dedup_lines(docs: DataFrame, window: int = 3) -> DataFrame:
    """``docs`` (doc_id, text, ...) without the lines that repeat, with ``n_lines`` and ``n_removed``.

    A line without a word belongs to no window and stays; a document with fewer than ``window`` lines with a
    word is left alone. Null texts stay null (no lines), texts of which all lines go become empty. Rows that
    share doc_id and text are one occurrence and are treated alike. An empty table gives an empty result.
    Columns named like the two new ones are replaced.
    """
    found = repeated(docs, window).withColumnRenamed("doc_id", "_id").withColumnRenamed("_text_hash", "_hash")
    joined = _lines(aside(docs, "doc_id", "text")).join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left")
    covered = F.array_distinct(F.flatten(F.transform("_at", lambda t: F.transform(F.sequence(t, t + (window - 1)), lambda k: F.get("_full", k)["i"]))))
    joined = joined.withColumn("_gone", covered).withColumn("_lines", F.split("text", "\n", -1))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone")
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("_lines", i)), "\n"))
    counts = {"n_lines": F.coalesce(F.size("_lines"), F.lit(0)), "n_removed": F.coalesce(F.size("_gone"), F.lit(0))}
    return joined.select(*restored(docs.columns, {"text": text} | {k: F.greatest(v, F.lit(0)).cast("long") for k, v in counts.items()}, "doc_id", "text"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents
), filled AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), wins AS (
  SELECT doc_id, k, line AS a, lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c FROM filled WINDOW w AS (PARTITION BY doc_id ORDER BY k)
), later AS (
  SELECT doc_id, k FROM (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, k) AS seen FROM wins WHERE c IS NOT NULL) WHERE seen > 1
), covered AS (
  SELECT DISTINCT f.doc_id, f.i FROM filled f JOIN (SELECT doc_id, k + unnest([0, 1, 2]) AS k FROM later) l ON f.doc_id = l.doc_id AND f.k = l.k
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS text FROM lines l ANTI JOIN covered c ON l.doc_id = c.doc_id AND l.i = c.i GROUP BY l.doc_id
)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(c.n, 0) AS BIGINT) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id) c ON c.doc_id = d.doc_id
"""
