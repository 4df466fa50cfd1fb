"""Quality rules with a hashed n-gram log-likelihood ratio, by DataFrame functions only.

Documents that pass strict structural rules are the trusted target. Letters (with their combining marks),
digits and symbols are split into tokens, unigrams and bigrams hashed into buckets, and the buckets counted over the whole corpus and
over the target. A document's score is the mean log-likelihood ratio of its n-grams, target against corpus;
a document passes if it fails no base rule and its score is at least a fixed threshold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import NOT_SPACE, SPACE, aside, constants, restored

BUCKETS = 8192
#: Mean ratio (natural logarithm, an n-gram) that a document must reach.
THRESHOLD = -0.1
#: Ratios are kept as whole numbers of 1 / SCALE, so that sums don't depend on an order.
SCALE = 1000
#: Share of characters besides letters, combining marks and white space that a trusted document has at most.
TRUSTED_OTHER = 0.06
#: Repeated hashes of a text that are looked up one by one (more are sorted; the count is the same).
FEW = 16
_BLANKS = " \t\n\u000b\f\r"


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), use), 0)


def _triples(words: Column) -> Column:
    """Hashes of all windows of three words (words: three at least)."""
    return F.transform(F.slice(words, 1, F.size(words) - 2), lambda a, i: F.xxhash64(a, F.get(words, i + 1), F.get(words, i + 2)))


def _covered(hashes: Column) -> Column:
    """Places covered by windows of three whose hash occurs twice or more.

    The repeated hashes are found by a sort of whole numbers. Up to FEW of them are looked up place by place;
    more are sorted together with their places.
    """
    walk = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last"))
    covered = lambda at: F.aggregate(at, walk, step, lambda acc: acc["n"])
    given = lambda x: F.filter(x, lambda v: v.isNotNull())
    repeated = lambda s: F.array_distinct(given(F.zip_with(s, F.slice(s, 2, F.size(s)), lambda x, y: F.when(x == y, x))))

    def sorted_places(s: Column) -> Column:
        after = F.slice(s, 2, F.size(s))
        first = given(F.zip_with(s, after, lambda x, y: F.when(x["h"] == y["h"], x["i"])))
        second = given(F.zip_with(s, after, lambda x, y: F.when(x["h"] == y["h"], y["i"])))
        return F.sort_array(F.array_union(first, second))

    few = lambda d: given(F.transform(hashes, lambda h, i: F.when(F.array_contains(d, h), i)))
    many = _bound(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), sorted_places)
    return _bound(_bound(F.sort_array(hashes), repeated), lambda d: covered(F.when(F.size(d) <= FEW, few(d)).otherwise(many)))


def repeat_words(words: Column) -> Column:
    """Words that lie in 3-word windows found twice or more."""
    of = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h))
    return _bound(words, lambda w: F.when(F.size(w) < 4, F.lit(0)).otherwise(_bound(_triples(w), of)))


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _counted(docs: DataFrame) -> DataFrame:
    """``docs`` (text, ...) with _words and the columns of COUNTS as ``_n`` and their names, and _failed."""
    text = F.coalesce("text", F.lit(""))
    docs = docs.withColumn("_trim", F.btrim(text, F.lit(_BLANKS)))
    docs = docs.withColumn("_words", F.when(F.col("_trim") == "", F.array().cast("array<string>")).otherwise(F.split("_trim", f"{SPACE}+")))
    full = F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE))
    counts = [
        F.size("_words"), F.length(F.array_join("_words", "")), F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")),
        _bound(full, lambda x: F.size(x) - F.size(F.array_distinct(x))), repeat_words(F.col("_words")),
    ]
    docs = docs.withColumns({f"_{k}": v.cast("long") for k, v in zip(COUNTS, counts)})
    return docs.withColumn("_failed", (F.col("_n_words") < 50) | (100 * F.col("_n_repeat_words") > 50 * F.col("_n_words")))


def _made() -> dict[str, Column]:
    return {k: F.col(f"_{k}") for k in COUNTS} | {"base_failed": F.col("_failed")}


def base_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed."""
    return _counted(aside(docs, "text")).select(*restored(docs.columns, _made(), "text"))


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{M}]+|\p{N}+|[^\p{L}\p{M}\p{N}\s]+"), 0)


def _bucket(*tokens: Column) -> Column:
    return F.xxhash64(*tokens).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def buckets(text: Column) -> Column:
    """The buckets of a text's n-grams: its tokens, and each token with the next (the last with none)."""
    return _bound(_tokens(text), lambda t: F.concat(F.transform(t, lambda a: _bucket(a)), F.zip_with(t, F.slice(t, 2, F.size(t)), lambda a, b: _bucket(a, b))))


def mean_ratio(text: Column, ratio: list[int]) -> Column:
    """The mean of the n-grams' ratios, 0 where there are none."""
    table = constants(ratio)
    each = lambda t: F.zip_with(t, F.slice(t, 2, F.size(t)), lambda a, b: F.get(table, _bucket(a)) + F.get(table, _bucket(a, b)))
    total = lambda r: F.when(F.size(r) > 0, F.aggregate(r, F.lit(0).cast("long"), lambda acc, x: acc + x) / (2 * F.size(r)) / SCALE).otherwise(0.0)
    return _bound(_bound(_tokens(text), each), total)


def ratios(docs: DataFrame) -> list[int]:
    """For each bucket the scaled logarithm of its share in the target over its share in the corpus.

    Counted over all documents; what comes to the driver are BUCKETS rows at most.
    """
    text = F.coalesce("text", F.lit(""))
    other = F.length(F.regexp_replace(text, r"[\p{L}\p{M}\s]+", ""))
    words = F.regexp_count(text, F.lit(f"{NOT_SPACE}+"))
    trusted = (other <= TRUSTED_OTHER * F.length(text)) & (words >= 50)
    grams = docs.select(trusted.alias("trusted"), buckets(F.col("text")).alias("all")).select("trusted", F.explode("all").alias("bucket"))
    counts = {r["bucket"]: (r["n"], r["t"]) for r in grams.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if("trusted").alias("t")).collect()}
    n, t = (sum(c[k] for c in counts.values()) for k in (0, 1))
    if not t:
        return [0] * BUCKETS
    share = lambda x, of: math.log((x + 1) / (of + BUCKETS))
    return [round(SCALE * (share(counts.get(b, (0, 0))[1], t) - share(counts.get(b, (0, 0))[0], n))) for b in range(BUCKETS)]


def judge(docs: DataFrame, threshold: float = THRESHOLD, ratio: list[int] | None = None) -> DataFrame:
    """``docs`` (text, ...) with the base counts, ``base_failed``, ``llr`` and ``kept``.

    ratio: as from ratios(), else counted over ``docs``. Null and wordless texts have no words and an llr of
    0, and fail the base rules. Judged row by row: repeated rows and null or tied ids are no matter. With no
    trusted document all ratios are 0. An empty table gives an empty result. Columns named like the new ones
    are replaced. Without ``ratio`` a job counts when this is called.
    """
    ratio = ratios(docs) if ratio is None else ratio
    judged = _counted(aside(docs, "text")).withColumn("_llr", mean_ratio(F.col("text"), ratio))
    return judged.select(*restored(docs.columns, _made() | {"llr": F.col("_llr"), "kept": ~F.col("_failed") & (F.col("_llr") >= threshold)}, "text"))


def passed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that judge() keeps.

    The verdict is exploded, not filtered by: a filter would be moved below the columns that it is made of,
    and work them out again for each of their uses.
    """
    judged = judge(aside(docs, "text"))
    one = F.explode(F.filter(F.array("kept"), lambda k: k)).alias("_kept")
    return judged.select("text", "_row", one).select(*restored(docs.columns, {}, "text"))
