"""Language identification in two steps: the family first, then the language within it.

Texts become hashed counts of letter pairs and triples, in Arrow batches. One linear support vector machine
for each family against the rest names the family; within it one machine for each pair of languages votes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import share01

#: Families of languages by their ISO 639-1 codes. A language that isn't listed, as those without near relatives among the
#: usual ones (zh, ja, ko, ar, el, id, vi, ...), is a family of its own: for it the first step is the only one.
FAMILIES = {
    "germanic": "en de nl sv da no is af lb fy",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk",
    "uralic": "fi et hu",
    "indic": "hi bn mr gu pa ur ne",
    "turkic": "tr az kk uz",
}
FAMILY_OF = {language: family for family, languages in FAMILIES.items() for language in languages.split()}
#: Hashed features; texts whose features a task holds at once.
WIDTH, TOGETHER = 4096, 512
#: The fit is bounded: rows of each language, of all languages, and languages (those with most rows) at most.
SAMPLE, ROWS, LANGUAGES = 600, 12_000, 256
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def features(text: str | None) -> np.ndarray | None:
    """Unit vector of square roots of hashed pair and triple counts; None without a letter."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _is_letter()[c]
    if not letter.any():
        return None
    c = np.concatenate(([0, 0], np.where(letter, c, 0), [0, 0])).astype(np.uint32)
    pair = c[:-1] * np.uint32(0x9E3779B1) ^ c[1:] * np.uint32(0x85EBCA77)
    triple = pair[:-1] * np.uint32(3) ^ c[2:] * np.uint32(0xC2B2AE3D)
    pair, triple = pair[(c[:-1] > 0) | (c[1:] > 0)], triple[(c[1:-1] > 0) & ((c[:-2] > 0) | (c[2:] > 0))]
    count = np.bincount(np.concatenate((pair, triple)) * np.uint32(0x27D4EB2F) >> np.uint32(20), minlength=WIDTH)
    count = np.sqrt(count, dtype=np.float32)
    return count / np.linalg.norm(count)


def machine(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 200) -> np.ndarray:
    """Weights and intercept (last) of a linear support vector machine with squared hinge loss; y is 1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    now = np.zeros(x.shape[1], np.float32)
    ahead, t, rate = now.copy(), 1.0, 0.25
    for _ in range(rounds):
        short = np.maximum(0, 1 - y * (x @ ahead))
        step = ahead - rate * (penalty * ahead - 2 * x.T @ (weight * y * short))
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead, now = step + np.float32((before - 1) / t) * (step - now), step
    return now


def fitted(x: np.ndarray, kinds: np.ndarray, task: tuple[int, int]) -> np.ndarray:
    """The machine that tells rows of kind a from those of kind b (-1: all others)."""
    a, b = task
    if b < 0:
        return machine(x, np.where(kinds == a, 1, -1).astype(np.float32))
    some = (kinds == a) | (kinds == b)
    return machine(x[some], np.where(kinds[some] == a, 1, -1).astype(np.float32))


def side_by_side(spark: SparkSession):
    """fitted() for many machines at once, each in a task of its own: the sample, of bounded size, goes to all of them."""

    def fit(x: np.ndarray, work: list[tuple[np.ndarray, tuple[int, int]]]) -> list[np.ndarray]:
        kinds, which = [], []
        for k, _ in work:
            if not any(k is other for other in kinds):
                kinds.append(k)
            which.append(next(i for i, other in enumerate(kinds) if other is k))
        sent = spark.sparkContext.broadcast((x, kinds))
        rows = [(i, which[i], *map(int, task)) for i, (_, task) in enumerate(work)]

        def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, k, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                    x, kinds = sent.value
                    w = fitted(x, kinds[k], (a, b))
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([w], pa.list_(pa.float32()))], ["i", "w"])

        tasks = spark.createDataFrame(rows, "i int, k int, a int, b int").repartition(len(rows), "i")
        found = tasks.mapInArrow(some, "i int, w array<float>").orderBy("i").toArrow()
        w = found.column("w").combine_chunks()
        sent.destroy()
        return list(w.flatten().to_numpy().reshape(len(rows), -1).copy())

    return fit


def one_by_one(x: np.ndarray, work: list[tuple[np.ndarray, tuple[int, int]]]) -> list[np.ndarray]:
    return [fitted(x, kinds, task) for kinds, task in work]


class Model:
    """languages by family; machines for families (against the rest) and for pairs within a family."""

    def __init__(self, x: np.ndarray, languages: list[str], fit=one_by_one) -> None:
        named = np.array([FAMILY_OF.get(c, c) for c in languages], object)
        languages = np.array(languages, object)
        self.families = sorted(set(named))
        self.members = {f: sorted(set(languages[named == f])) for f in self.families}
        every = sorted(set(languages))
        families, kinds = np.searchsorted(self.families, named.astype(str)), np.searchsorted(every, languages.astype(str))
        against = [(families, (f, -1)) for f in range(len(self.families))] if len(self.families) > 1 else []
        pairs = [(a, b) for members in self.members.values() for a, b in combinations(members, 2)]
        work = against + [(kinds, (every.index(a), every.index(b))) for a, b in pairs]
        made = fit(x, work) if work else []
        self.family = np.stack(made[: len(against)]) if against else None
        self.pairs = dict(zip(pairs, made[len(against) :]))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(languages, scores) for rows of features."""
        if self.family is None:
            family, sure = np.zeros(len(x), np.int64), np.ones(len(x))
        else:
            margins = 3 * (x @ self.family[:, :-1].T + self.family[:, -1])
            odds = np.exp(margins - margins.max(1, keepdims=True))
            family, sure = odds.argmax(1), odds.max(1) / odds.sum(1)
        names, scores = np.empty(len(x), object), np.zeros(len(x))
        for f in np.unique(family):
            rows, members = np.flatnonzero(family == f), self.members[self.families[f]][::-1]  # of equal votes the last name wins
            votes = np.zeros((len(rows), len(members)))
            for b, a in combinations(range(len(members)), 2):
                w = self.pairs[members[a], members[b]]
                p = 1 / (1 + np.exp(-3 * (x[rows] @ w[:-1] + w[-1])))
                votes[:, a] += p
                votes[:, b] += 1 - p
            best = votes.argmax(1)
            names[rows] = np.array(members, object)[best]
            scores[rows] = sure[rows] * (votes.max(1) / (len(members) - 1) if len(members) > 1 else 1.0)
        return names, scores


def _arrow(apply, kind: str):
    """A column of ``kind`` from ``apply`` on Arrow arrays of texts."""

    def some(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return map(apply, batches)

    some.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(some, kind)


def _sparse(texts: pa.Array) -> pa.Array:
    rows = [features(t.as_py()) for t in texts]
    at = [None if x is None else np.flatnonzero(x).astype(np.int16) for x in rows]
    values = [None if x is None else x[i] for x, i in zip(rows, at)]
    return pa.StructArray.from_arrays([pa.array(at, pa.list_(pa.int16())), pa.array(values, pa.list_(pa.float32()))], ["at", "value"])


def learn(docs: DataFrame, sample: int = SAMPLE, rows: int = ROWS, languages: int = LANGUAGES) -> Model | None:
    """A model of rows with a lang whose crc32(doc_id as text) mod 4 is not 2.

    The ``languages`` with most rows, ``sample`` rows of each at most (the first by a hash of doc_id; rows that repeat
    an id count each) and ``rows`` in all are learned from: what comes to the driver, and from there to the tasks that
    fit the machines side by side, is bounded (about 200 MB). Features are computed of the sampled rows alone, and
    sent as their places and values.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    usable = docs.where(F.col("lang").isNotNull() & (fold != 2)).select("doc_id", "text", "lang")
    sizes = usable.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("doc_id").alias("ids")).orderBy(F.col("n").desc(), "lang").limit(languages).collect()
    if not sizes:
        return None
    each = max(2, min(sample, rows // len(sizes)))
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, 1.3 * each / max(1, r["ids"]))) for r in sizes], "lang string, share double")
    order = Window.partitionBy("lang").orderBy(share01(F.col("doc_id")), "doc_id", F.xxhash64("text"))
    some = usable.join(F.broadcast(shares), "lang").where(share01(F.col("doc_id")) <= F.col("share"))
    some = some.withColumn("k", F.row_number().over(order)).where(F.col("k") <= each)
    found = some.select("lang", "k", _arrow(_sparse, "struct<at:array<smallint>,value:array<float>>")("text").alias("x")).select("lang", "k", "x.at", "x.value").toArrow()
    found = found.filter(found.column("at").is_valid()).sort_by([("k", "ascending"), ("lang", "ascending")])
    if not len(found):
        return None
    return Model(dense(found.column("at"), found.column("value")), found.column("lang").to_pylist(), side_by_side(docs.sparkSession))


def dense(at: pa.ChunkedArray, value: pa.ChunkedArray) -> np.ndarray:
    """The rows of sparse features, filled some rows at a time from Arrow's own arrays."""
    x, row = np.zeros((len(at), WIDTH), np.float32), 0
    for places, values in zip(at.chunks, value.chunks):
        for s in range(0, len(places), TOGETHER):
            some = places.slice(s, TOGETHER)
            sizes = np.diff(some.offsets.to_numpy())
            x[np.repeat(np.arange(row, row + len(some)), sizes), some.flatten().to_numpy()] = values.slice(s, TOGETHER).flatten().to_numpy()
            row += len(some)
    return x


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs`` (doc_id, text, lang, ...).

    lang serves learning only; jobs for it run when this is called. Null texts and texts without a letter are ``und`` with a score of 0, and so is
    every text where there was nothing to learn from. A null doc_id is not held out and not learned from;
    repeated rows are predicted each; other columns are ignored; an empty table gives an empty result.
    """
    model = model or learn(docs)

    def named(texts: pa.Array) -> pa.Array:
        names, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        for s in range(0, len(texts), TOGETHER):
            rows = [features(t.as_py()) for t in texts[s : s + TOGETHER]]
            at = [s + k for k, x in enumerate(rows) if x is not None and model is not None]
            if at:
                names[at], scores[at] = model.predict(np.stack([rows[k - s] for k in at]))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    found = docs.select("doc_id", _arrow(named, "struct<lang_pred:string,score:double>")("text").alias("found"))
    return found.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "found.lang_pred", "found.score")
