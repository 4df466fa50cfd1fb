"""SimHash near-duplicates: tiled exact comparison of 64-bit fingerprints.

Fingerprints are computed from whole texts in Arrow batches. Distinct fingerprints are put into tiles by
the population counts of their bit segments; two fingerprints within ``radius`` bits differ by at most
``radius`` in the sum of those counts, so tile pairs beyond it are never formed. Every other tile pair
is compared exactly, with exclusive-or and bit counts in numpy, in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import aside, components, cut, forest, restored

#: Rows of one side of a compared tile pair.
TILE = 32_768
_BITS = np.arange(64, dtype=np.uint64)


def fingerprint_of(text: str | None, words_per_shingle: int = 3) -> int:
    """Unsigned SimHash of one text: shingles of ASCII-lower-cased words, XXH64 with seed 42."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - words_per_shingle + 1)
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[s:e], 42) for s, e in zip(starts, ends[-n:].tolist())], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        part = hashes[k : k + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << _BITS[2 * ones > n]).sum(dtype=np.uint64))


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint", words_per_shingle: int = 3) -> DataFrame:
    """``docs`` with a BIGINT fingerprint of the whole text (null or wordless: 0)."""

    def some(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = np.fromiter((fingerprint_of(x.as_py(), words_per_shingle) for x in texts), np.uint64, len(texts))
            yield pa.array(found.view(np.int64))

    some.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(out, F.arrow_udf(some, "bigint")(F.col(text)))


def _close(a: np.ndarray, b: np.ndarray, radius: int, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (into a, into b) at ``radius`` bits or fewer; own: a is b, each pair once."""
    left, right = [], []
    for s in range(0, len(a), 256):
        for t in range(s if own else 0, len(b), 4096):
            i, j = np.nonzero(np.bitwise_count(a[s : s + 256, None] ^ b[None, t : t + 4096]) <= radius)
            i, j = i + s, j + t
            keep = i < j if own else slice(None)
            left.append(i[keep])
            right.append(j[keep])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _segments(n: int) -> int:
    """Segments whose population counts name a tile: more as the table grows, for smaller shares of tile pairs."""
    return 1 if n < 20_000 else 2 if n < 4_000_000 else 4


def close_links(prints: DataFrame, radius: int = 3, tile: int = TILE, segments: int | None = None) -> DataFrame:
    """Links (a, b) that connect all fingerprints at ``radius`` bits or fewer.

    prints: (fingerprint BIGINT, rep BIGINT), fingerprints distinct. Of the links found within one tile
    pair a spanning forest is returned, so a group of g near copies gives O(g) rows, not O(g * g).
    """
    s = segments or _segments(prints.count())
    width, base = 64 // s, 64 // s + 2 * radius + 1
    mask = F.lit(-1 if width == 64 else (1 << width) - 1)
    weight = [base**q for q in range(s)]
    key = sum((F.bit_count(F.shiftrightunsigned("fingerprint", q * width).bitwiseAND(mask)).cast("long") * weight[q] for q in range(s)), F.lit(0).cast("long"))
    prints = prints.select("fingerprint", "rep", key.alias("tile"))
    steps = [o for o in product(range(-radius, radius + 1), repeat=s) if sum(map(abs, o)) <= radius and o > (0,) * s]
    steps = F.array([F.lit(sum(x * w for x, w in zip(o, weight))).cast("long") for o in steps])
    sizes = prints.groupBy("tile").agg(F.count("*").alias("n"))
    near = sizes.select(F.explode(F.transform(steps, lambda o: F.col("tile") - o)).alias("tile"), "n").groupBy("tile").agg(F.sum("n").alias("near"))
    # At most (64 / s + 1) ** s rows, 83,521 for four segments: bounded, so it is broadcast.
    plan = cut(sizes.join(near, "tile", "left").select("tile", F.ceil(F.col("n") / tile).cast("int").alias("chunks"), F.ceil((F.coalesce("near", F.lit(0)) + F.col("n")) / tile).cast("int").alias("parts")))
    plan = F.broadcast(plan)
    chunk = F.pmod(F.xxhash64("fingerprint"), F.col("chunks")).cast("int")
    part = F.pmod(F.hash("fingerprint"), F.col("parts")).cast("int")
    own = prints.join(plan, "tile").withColumn("chunk", chunk)
    rows = own.select("fingerprint", "rep", "tile", "chunk", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"))
    rows = rows.union(own.where("chunk > 0").select("fingerprint", "rep", "tile", F.explode(F.sequence(F.lit(0), F.col("chunk") - 1)).alias("chunk"), part.alias("part"), F.lit(1).alias("side")))
    away = prints.select("fingerprint", "rep", F.explode(F.transform(steps, lambda o: F.col("tile") - o)).alias("tile")).join(plan, "tile")
    rows = rows.union(away.select("fingerprint", "rep", "tile", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), part.alias("part"), F.lit(1).alias("side")))

    def compare(group: pa.Table) -> pa.Table:
        prints, rep, side = (group.column(c).to_numpy() for c in ("fingerprint", "rep", "side"))
        order = np.lexsort((rep, side))
        prints, rep, a = prints[order].view(np.uint64), rep[order], int((side == 0).sum())
        i, j = _close(prints[:a], prints[a:], radius, False)
        j = j + a
        if group.column("part")[0].as_py() == 0:
            own_i, own_j = _close(prints[:a], prints[:a], radius, True)
            i, j = np.concatenate((i, own_i)), np.concatenate((j, own_j))
        root = forest(len(prints), i, j)
        linked = root != np.arange(len(root))
        return pa.table({"a": rep[linked], "b": rep[root[linked]]})

    return rows.groupBy("tile", "chunk", "part").applyInArrow(compare, "a bigint, b bigint")


def _groups(docs: DataFrame, radius: int, words_per_shingle: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, fingerprint) of every row, and (fingerprint, component_id)."""
    ids = with_fingerprint(docs.select("doc_id", "text"), words_per_shingle=words_per_shingle)
    ids = cut(ids.select("doc_id", F.xxhash64("text").alias("text_hash"), "fingerprint"))
    prints = cut(ids.groupBy("fingerprint").agg(F.min("doc_id").alias("rep")).where("rep is not null"))
    found = components(close_links(prints, radius), "a", "b")
    named = prints.join(found, prints.rep == found.id, "left").select("fingerprint", F.coalesce("component_id", "rep").alias("component_id"))
    return ids, named


def near_duplicates(docs: DataFrame, radius: int = 3, words_per_shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint BIGINT, component_id) for every row of ``docs`` (doc_id, text, ...).

    component_id: the smallest doc_id reachable over links of ``radius`` bits or fewer. Null and wordless
    texts have fingerprint 0 and link like any other; rows with a null doc_id take part and get the
    component of their fingerprint (null if nothing in it has an id). Repeated rows stay, each with the
    same component. An empty table gives an empty result; other columns are ignored. Jobs for the links run
    when this is called.
    """
    ids, named = _groups(docs, radius, words_per_shingle)
    return ids.join(named, "fingerprint", "left").select("doc_id", "fingerprint", "component_id")


def keep_one(docs: DataFrame, radius: int = 3, words_per_shingle: int = 3) -> DataFrame:
    """``docs`` (doc_id, text, ...) with one row of each group of near duplicates: that of the smallest doc_id.

    Of rows that repeat it, one stays; so does one row of each fingerprint that only rows without an id have.
    Every text is hashed once: what stays is told by doc_id and the text's hash.
    """
    ids, named = _groups(docs, radius, words_per_shingle)
    first = ids.join(named, "fingerprint", "left").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    group = ["component_id", F.when(F.col("component_id").isNull(), F.col("fingerprint")).alias("alone")]
    first = cut(first.groupBy(*group).agg(F.min("text_hash").alias("_hash"), F.count("*").alias("n")))
    stay = first.select(F.col("component_id").alias("_id"), "_hash", "n")
    out = aside(docs, "doc_id", "text").join(stay, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash")))
    if not first.where("n > 1").isEmpty():
        again = F.when(F.col("n") > 1, F.lit(0)).otherwise(F.monotonically_increasing_id() + 1)
        out = out.withColumn("_again", again).dropDuplicates(["_id", "_hash", "_again"]).drop("_again")
    return out.select(*restored(docs.columns, {}, "doc_id", "text"))
