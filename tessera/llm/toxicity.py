"""Toxicity of noisy texts: a noisy channel is undone first, then the restored text is scored.

Words may be disguised by digits and signs in place of letters, by repeated letters, and by separators between
letters. Every reading of such a token is a path through a lattice of characters; the path that a character language
model and the channel's costs together find likeliest is decoded by Viterbi's algorithm. The language model is
counted over all documents. Tokens without a sign of disguise have one reading, themselves, and aren't decoded.

The restored text is scored by a lexicon of whole words and beginnings of words that are significantly more frequent
in toxic than in other documents, and a logistic model over a document's strongest words.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, share01

#: Letters that a digit or sign may stand for (fixed values).
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c"}
#: Signs that may part the letters of one word, besides a space.
SEPARATORS = ".-_*"
#: Natural logarithms of the channel's odds: a letter written as a digit or sign, a letter repeated, a separator put between letters.
SWAP, REPEAT, PART = -3.5, -1.0, -0.7
#: Symbols of the language model: 0 a boundary, 1 to 26 letters, then digits, signs, and classes of all other letters.
SYMBOLS = 64
#: Weights of the shorter contexts in the language model.
BACK = 8.0
#: Labelled rows that are learned from, about; features of the lexicon at most; toxic documents that a feature is in at least.
SAMPLE, FEATURES, LEAST = 20_000, 65_536, 3
#: Beginnings of words that are features besides the word; a feature counts by its log odds less so many standard errors.
STARTS, ERRORS = (3, 4, 5, 6, 7, 8), 2.0
#: A document's strongest words that enter its score; characters of decoded tokens that a worker remembers.
STRONGEST, REMEMBERED = 4, 1 << 20
#: Characters whose features are held at once, about (a longer text is held by itself).
TOGETHER = 1 << 19
COLUMNS = [*(f"strongest{k}" for k in range(STRONGEST)), "hits", "words", "share"]
_P, _MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(symbol, kind) of every code point; kinds: 0 space, 1 letter or mark, 2 digit or sign of LEET, 3 separator, 4 other."""
    symbol, kind = np.zeros(0x110000, np.uint8), np.full(0x110000, 4, np.uint8)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha() or unicodedata.category(x)[0] == "M":
            kind[c], symbol[c] = 1, 44 + c % 20
        elif x.isspace():
            kind[c] = 0
    for k in range(26):
        symbol[ord("a") + k] = 1 + k
    for k, x in enumerate(LEET):
        symbol[ord(x)], kind[ord(x)] = 27 + k, 2
    for x in SEPARATORS:
        kind[ord(x)] = 3
    return symbol, kind


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def chunks(texts: list[str]) -> Iterator[list[str]]:
    """``texts`` in turn, some together, of about TOGETHER characters."""
    some, n = [], 0
    for t in texts:
        some.append(t)
        n += len(t) + 1
        if n >= TOGETHER:
            yield some
            some, n = [], 0
    if some:
        yield some


def counted(texts: list[str]) -> np.ndarray:
    """How often each symbol follows each two others in lower-case texts; a word starts after two boundaries."""
    s = _tables()[0][points(" " + " ".join(texts) + " ")]
    s = s[(s > 0) | np.concatenate(([True], s[:-1] > 0))]  # one boundary between words
    s = np.repeat(s, np.where(s == 0, 2, 1)).astype(np.int64)
    return np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)


def language_model(counts: np.ndarray) -> np.ndarray:
    """Log probabilities (symbol before the last, last, next) of counts, smoothed by shorter contexts."""
    n = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(np.float64)
    one = (n.sum((0, 1)) + 1) / (n.sum() + SYMBOLS)
    two = n.sum(0)
    two = (two + BACK * one) / (two.sum(1, keepdims=True) + BACK)
    return np.log((n + BACK * two) / (n.sum(2, keepdims=True) + BACK))


def lattice(token: str) -> list[list[tuple[int, float, str]]]:
    """Positions of a lower-case token, each with its readings (symbol, cost, text); symbol -1: nothing, -2: the reading before again.

    Of a repeated character one or two count where the token has one thrice or more in a row, else all; a separator
    is a boundary or nothing where the token's letters stand alone between such.
    """
    symbol, kind = _tables()
    runs: list[list] = []
    for x in token:
        if runs and runs[-1][0] == x:
            runs[-1][1] += 1
        else:
            runs.append([x, 1])
    core = lambda x: kind[ord(x)] in (1, 2)
    long = any(n > 2 and core(x) for x, n in runs)
    alone = lambda k: 0 <= k < len(runs) and runs[k][1] == 1 and core(runs[k][0])
    out: list[list[tuple[int, float, str]]] = []
    for k, (x, n) in enumerate(runs):
        if core(x):
            here = [(int(symbol[ord(x)]), 0.0, x)] + [(int(symbol[ord(y)]), SWAP, y) for y in LEET.get(x, "")]
            out.append(here)
            if n > 1 and long:
                out.append([(-1, REPEAT, ""), (-2, REPEAT, "")])
            else:
                out += [[(-2, 0.0, "")]] * (n - 1)
        elif (x == " " or kind[ord(x)] == 3) and n == 1 and alone(k - 1) and alone(k + 1):
            out.append([(0, 0.0, x), (-1, PART, "")])
        else:
            out.append([(0, 0.0, x * n)])
    return out


def decode(token: str, model: np.ndarray) -> str:
    """The likeliest reading of a token, from boundary to boundary; of equally likely ones the first in the lattice's order."""
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for here in [*lattice(token), [(0, 0.0, "")]]:
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, path) in states.items():
            for s, cost, text in here:
                if s == -1:
                    to, total = (a, b), score + cost
                elif s == -2:
                    to, total, text = (b, b), score + cost + model[a, b, b], path[1][-1:]
                else:
                    to, total = (b, s) if s else (0, 0), score + cost + (model[a, b, s] if s or b else 0.0)
                if to not in new or total > new[to][0]:
                    new[to] = (total, (path, text) if text else path)
        states = new
    path, parts = max(states.values(), key=lambda x: x[0])[1], []
    while path is not None:
        path, text = path
        parts.append(text)
    return "".join(reversed(parts))


def disguised(text: str) -> list[tuple[int, int]]:
    """(start, end) of the tokens of a lower-case text that show a sign of disguise, in order.

    Signs are a digit or sign of LEET beside a letter, a letter thrice in a row, and three letters or more alone
    between equal separators; those between single spaces are one token.
    """
    c = points(text)
    if not len(c):
        return []
    kind = _tables()[1][c]
    core, letter = (kind == 1) | (kind == 2), kind == 1
    edge = np.diff(np.concatenate(([0], (kind > 0).astype(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sign = np.zeros(len(c), bool)
    sign[:-1] |= core[:-1] & core[1:] & (kind[:-1] != kind[1:])
    sign[:-2] |= letter[:-2] & (c[:-2] == c[1:-1]) & (c[1:-1] == c[2:])
    apart = core[:-4] & (kind[1:-3] == 3) & core[2:-2] & (c[1:-3] == c[3:-1]) & core[4:]
    sign[:-4] |= apart & ~np.concatenate(([False], core[: max(0, len(c) - 5)]))[: len(apart)]
    flagged = np.zeros(len(start), bool)
    flagged[np.searchsorted(start, np.flatnonzero(sign), "right") - 1] = True
    # Runs of single letters between single spaces.
    single = (end - start == 1) & core[start]
    next_ = np.zeros(len(start), bool)
    next_[:-1] = single[:-1] & single[1:] & (start[1:] == end[:-1] + 1) & (c[end[:-1].clip(max=len(c) - 1)] == 32)
    found = [(int(s), int(e)) for s, e in zip(start[flagged & ~single], end[flagged & ~single])]
    steps = np.diff(np.concatenate(([0], next_.astype(np.int8), [0])))
    for a, b in zip(np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)):
        if b - a >= 2:
            found.append((int(start[a]), int(end[b])))
    return sorted(found)


class Restorer:
    """Restores texts; decoded tokens are remembered up to REMEMBERED characters."""

    def __init__(self, model: np.ndarray) -> None:
        self.model, self.known, self.chars = model, {}, 0

    def _decoded(self, token: str) -> str:
        if token not in self.known:
            if self.chars > REMEMBERED:
                self.known, self.chars = {}, 0
            self.known[token] = decode(token, self.model)
            self.chars += len(token)
        return self.known[token]

    def __call__(self, text: str | None) -> str:
        """The text in lower case with its disguised tokens restored; null is empty."""
        text, parts, at = (text or "").lower(), [], 0
        for s, e in disguised(text):
            parts += [text[at:s], self._decoded(text[s:e])]
            at = e
        return "".join([*parts, text[at:]])


@lru_cache(maxsize=1)
def _inverse() -> int:
    return pow(_P, -1, 1 << 64)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word, hash) of the features of restored texts: their words, and the words' beginnings. word: its own hash."""
    c = points("\n".join(texts) + "\n")
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    kind = _tables()[1][c]
    edge = np.diff(np.concatenate(([0], (kind == 1).astype(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    text = np.searchsorted(np.cumsum(sizes + 1), start, "right")
    with np.errstate(over="ignore"):
        one = np.ones(1, np.uint64)
        power = np.cumprod(np.concatenate((one, np.full(len(c), _P, np.uint64))))
        back = np.cumprod(np.concatenate((one, np.full(len(c), _inverse(), np.uint64))))
        sums = np.cumsum(np.concatenate((one * np.uint64(0), (c.astype(np.uint64) + one) * power[:-1])))
        of = lambda s, e, k: (((sums[e] - sums[s]) * back[s] ^ np.uint64(k)) * np.uint64(_MIX)).view(np.int64)
        word = of(start, end, 0)
        out = [(text, word, word)]
        for k in STARTS:
            some = end - start > k
            out.append((text[some], word[some], of(start[some], start[some] + k, k)))
    return tuple(np.concatenate(x) for x in zip(*out))  # type: ignore[return-value]


@dataclass
class Lexicon:
    """Features (sorted hashes) with a weight above zero."""

    hashes: np.ndarray
    weights: np.ndarray

    def statistics(self, texts: list[str]) -> np.ndarray:
        """A row a restored text: the weights of its strongest different words, and the logarithms of how many different words have
        a weight, of how many words it has, and of their ratio."""
        return np.concatenate([np.zeros((0, len(COLUMNS))), *map(self._measured, chunks(texts))])

    def _measured(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(COLUMNS)))
        text, word, h = features(texts)
        words = np.bincount(text[h == word], minlength=len(texts))
        out[:, STRONGEST + 1] = np.log1p(words)
        out[:, STRONGEST + 2] = np.log(0.5 / (words + 1))
        if not len(self.hashes):
            return out
        at = np.searchsorted(self.hashes, h).clip(max=len(self.hashes) - 1)
        hit = self.hashes[at] == h
        text, word, weight = text[hit], word[hit], self.weights[at[hit]]
        order = np.lexsort((-weight, word, text))
        text, word, weight = text[order], word[order], weight[order]
        first = np.ones(len(text), bool)
        first[1:] = (text[1:] != text[:-1]) | (word[1:] != word[:-1])
        text, weight = text[first], weight[first]
        order = np.lexsort((-weight, text))
        text, weight = text[order], weight[order]
        place = np.arange(len(text)) - np.searchsorted(text, text)
        top = place < STRONGEST
        out[text[top], place[top]] = weight[top]
        hits = np.bincount(text, minlength=len(texts))
        out[:, STRONGEST] = np.log1p(hits)
        out[:, STRONGEST + 2] = np.log((hits + 0.5) / (words + 1))
        return out


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights and intercept (last) of a logistic model with a quadratic penalty on the weights, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    w[-1] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    held = np.append(np.full(x.shape[1] - 1, penalty * max(1, len(y)) / 100), 1e-9)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(held + 1e-9), x.T @ (y - p) - held * w)
        w = w + step * min(1.0, 5.0 / max(1e-12, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return w


def _texts(batch: pa.RecordBatch, column: str) -> list[str | None]:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def count_symbols(docs: DataFrame) -> np.ndarray:
    """counted() over all documents: each task sums its own, what comes to the driver are 64 to the third numbers at most."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for some_texts in chunks([(t or "").lower() for t in _texts(batch, "text")]):
                total += counted(some_texts)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    rows = docs.select("text").mapInArrow(some, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SYMBOLS**3, np.int64)
    out[rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    return out


def restored(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """``docs`` (text, ...) with ``text`` restored, in lower case."""
    at = docs.columns.index("text")

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(model)
        for batch in batches:
            made = pa.array([restore(t) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([made if k == at else c for k, c in enumerate(batch.columns)], schema=batch.schema)

    return docs.mapInArrow(some, docs.schema)


def lexicon(toxic: DataFrame, other: DataFrame, limit: int = FEATURES) -> Lexicon:
    """Features of restored documents (text) that are significantly more frequent in toxic ones.

    Documents are counted for each feature by tasks, and for the ``limit`` features of most toxic documents only; these
    alone come to the driver. A weight is the logarithm of the odds less ERRORS standard errors, and counts above zero.
    """

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in (part for batch in batches for part in chunks(_texts(batch, "text"))):
            text, _, h = features(texts)
            order = np.lexsort((h, text))
            text, h = text[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
            found, n = np.unique(h[new], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], ["h", "n"])

    often = toxic.select("text").mapInArrow(frequent, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)
    rows = often.orderBy(F.col("n").desc(), "h").limit(limit).toArrow()
    hashes, pos = rows.column("h").to_numpy(), rows.column("n").to_numpy()
    order = np.argsort(hashes)
    hashes, pos = hashes[order], pos[order]

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(hashes), np.int64)
        for texts in (part for batch in batches for part in chunks(_texts(batch, "text"))):
            text, _, h = features(texts)
            at = np.searchsorted(hashes, h).clip(max=max(0, len(hashes) - 1))
            hit = hashes[at] == h if len(hashes) else np.zeros(len(h), bool)
            pair = np.unique(text[hit] * len(hashes) + at[hit]) if len(hashes) else np.zeros(0, np.int64)
            total += np.bincount(pair % max(1, len(hashes)), minlength=len(hashes)).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    rows = other.select("text").mapInArrow(known, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    neg = np.zeros(len(hashes), np.int64)
    neg[rows.column("at").to_numpy()] = rows.column("n").to_numpy()
    p, n = toxic.count(), other.count()
    odds = np.log((pos + 0.5) / (p + 1)) - np.log((neg + 0.5) / (n + 1))
    weight = odds - ERRORS * np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
    return Lexicon(hashes[weight > 0], weight[weight > 0])


@dataclass
class Model:
    language: np.ndarray
    lexicon: Lexicon
    weights: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        """Of restored texts."""
        z = self.lexicon.statistics(texts) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).

    The language model counts all documents. Labels are learned from where crc32(doc_id as text) mod 5 is not 0: about
    ``sample`` documents, the first by a hash of their id, three quarters of them for the lexicon, the others
    (remainder 4) for the logistic model. An id with several labels has the one of most of them (toxic, if they tie).
    """
    language = language_model(count_symbols(docs))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    usable = labels.where(F.col("toxic").isin(0, 1) & (fold != 0)).groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    usable = cut(usable.join(docs.select("doc_id"), "doc_id", "left_semi"))
    share = min(1.0, sample / max(1, usable.count()))
    chosen = usable.where(share01(F.col("doc_id")) < share)  # an id a row: as many as ``sample``, about
    some = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")
    some = cut(restored(some, language))
    known = some.where(fold != 4)
    words = lexicon(known.where("toxic = 1"), known.where("toxic = 0"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = words.statistics(_texts(batch, "text"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, x.T)], ["doc_id", "toxic", *COLUMNS])

    kind = f"doc_id {some.schema['doc_id'].dataType.simpleString()}, toxic int, " + ", ".join(f"{c} double" for c in COLUMNS)
    rows = some.where(fold == 4).mapInArrow(measured, kind).orderBy(share01(F.col("doc_id")), "doc_id", *COLUMNS).limit(sample).toArrow()
    x = np.stack([rows.column(c).to_numpy() for c in COLUMNS], axis=1)
    return Model(language, words, logistic(x, rows.column("toxic").to_numpy().astype(np.float64)))


def score(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text, ...).

    labels: (doc_id, toxic), see learn(); only the text enters a score. Jobs of the fit run when this is called. Null
    and empty texts are scored like any other; a null doc_id is not held out and never learned from; repeated rows
    are scored each. Without labels every score is 0.5. Other columns are ignored; an empty table gives an empty
    result.
    """
    docs = docs.select("doc_id", "text")
    model = model or learn(docs, labels)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(model.language)
        for batch in batches:
            made = model.scores([restore(t) for t in _texts(batch, "text")])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made)], ["doc_id", "score"])

    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    found = docs.mapInArrow(some, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return found.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
