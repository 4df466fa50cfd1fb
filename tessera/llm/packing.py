"""Best-fit packing of token sequences.

Documents and gaps are kept as runs of equal sizes, counted over all pieces, and dealt out by ranges of
size. In a superstep every range of documents is dealt gaps, of its own range and of larger ones, by counts
of each range alone: the smallest gaps first, the longest documents first. The ranges are then swept side by
side: every run of documents takes its successor, the smallest gap that it fits; where more documents than gaps
meet, the longest go first, and within a run the rank decides. The gaps are updated and the step is repeated.
A gap at least halves in every step that uses it, so there are few steps; long documents enter before short
ones, which fill what those leave. The matches, intervals of ranks to intervals of sequences, are then joined
back to the pieces.

Runs don't grow with the input. There are ``size`` runs of documents at most, and a match uses up a run of
documents or one of gaps. A match that uses up gaps leaves one run of gaps, smaller than half; one that uses
up documents leaves two, and there are ``size`` of those in all. Dealing cuts a run at RANGES places a range
and step at most. So there are O(size + RANGES² x steps) runs, whatever the number of pieces.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .byte_bpe import BLOCK, model_bytes
from .shared import cut

MAX_TOKENS, END = 4096, 1
#: Texts that a Python worker splits together.
TOGETHER = 256
#: Bytes of words, stems and ids that a Python worker remembers, with what an entry takes besides; characters of a word that is
#: remembered at all; slices of runs of equal lengths.
_REMEMBERED, _ENTRY, _WORD, SLICES = 120_000_000, 200, 256, 10_000
#: Ranges of sizes swept side by side; what a run is: documents, gaps or a match.
RANGES = 16
#: Documents longer than these parts of a sequence enter before shorter ones, which then fill what is left.
ENTER = (2, 3, 4, 5, 6, 8, 12)
DOCS, GAPS, MATCH = range(3)


#: A plain word is letters and signs after them; its ids are those of its lower-cased letters and of its signs:
#: normalisation leaves precomposed Latin letters as they are, and no pre-token holds both letters and signs.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
_SIGNS = ".,;:!?|*#$%&"


def _lower(text: str) -> str:
    """Lower-cased, as the tokenizer does it, where all characters are Latin-1; others are left to the tokenizer."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


_INNER = {b: BLOCK + b for b in range(256)}
_LAST = [chr(BLOCK + 256 + b) for b in range(256)]


class Words:
    """Remembers words (parts between spaces) and the bytes of their ids.

    No pre-token spans white space and normalisation doesn't reach across it, so the ids of a text are
    those of its words in turn. Plain words go through a sentencepiece model written from the same merges,
    in which a word's last byte has a character of its own; all others through the tokenizer.
    """

    def __init__(self, path: str) -> None:
        import json

        import sentencepiece
        from tokenizers import Tokenizer

        self.held = 0
        self.known: dict[str, bytes] = {}
        self.stems: dict[str, bytes | None] = {}
        self.signs: dict[str, bytes] = {}
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            bpe = json.load(file)["model"]
        # Bytes as printable characters: those that print stand for themselves, the others follow from 256 on.
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        char = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in own)}
        byte = {c: b for b, c in char.items()}
        end = bpe["end_of_word_suffix"]

        def piece(token: str) -> str:
            last = token.endswith(end)
            codes = [byte[c] for c in token.removesuffix(end)]
            return "".join(chr(BLOCK + c) for c in codes[: len(codes) - last]) + (chr(BLOCK + 256 + codes[-1]) if last else "")

        made = [a + b for a, b in (m if isinstance(m, list) else m.split(" ") for m in bpe["merges"])]
        single = [t for t in bpe["vocab"] if len(t.removesuffix(end)) == 1]
        pieces = list(dict.fromkeys([*made, *single]))
        self.ids = np.array([0, *(bpe["vocab"][t] for t in pieces)], "<u4")
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model_bytes([piece(t) for t in pieces]))

    def learn(self, new: set[str]) -> None:
        """Remember ``new`` words; the letters and the signs of plain ones are encoded once for all words that share them."""
        known, stems, signs = self.known, self.stems, self.signs
        split = {word: word.rstrip(_SIGNS) for word in new}
        fresh = set(split.values()).difference(stems)
        plain = [x for x in fresh if _LETTERS(x)]
        stems.update(dict.fromkeys(fresh))  # None: not plain
        mapped = [x.lower().encode().decode("latin-1") for x in plain]
        encoded = self.pieces.encode([x[:-1].translate(_INNER) + _LAST[ord(x[-1])] for x in mapped], num_threads=1)
        ends = np.cumsum(np.fromiter(map(len, encoded), np.int64, len(encoded)) * 4).tolist()
        flat = self.ids[np.fromiter(chain.from_iterable(encoded), np.int64)].tobytes()
        stems.update(zip(plain, (flat[a:b] for a, b in zip([0, *ends], ends))))
        others = []
        for word, stem in split.items():
            ids = stems[stem]
            if ids is None:
                others.append(word)
            elif len(word) == len(stem):
                known[word] = ids
            else:
                after = word[len(stem) :]
                if after not in signs:
                    signs[after] = np.array(self.model.encode(after, add_special_tokens=False).ids, "<u4").tobytes()
                known[word] = ids + signs[after]
        for word, e in zip(others, self.model.encode_batch_fast(others, add_special_tokens=False)):
            known[word] = np.array(e.ids, "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [_lower(t or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        if self.held > _REMEMBERED:
            for remembered in (self.known, self.stems, self.signs):
                remembered.clear()
            self.held = 0
        new = set(chain.from_iterable(split)).difference(self.known)
        if new:
            self.learn(new)
        out = [b"".join(map(self.known.__getitem__, words)) for words in split]
        for word in new:
            if len(word) > _WORD:  # such words hardly come again
                self.known.pop(word)
                self.stems.pop(word.rstrip(_SIGNS), None)
                self.signs.pop(word[len(word.rstrip(_SIGNS)) :], None)
            else:
                self.held += _ENTRY + 8 * len(word) + len(self.known[word])
        return out


@lru_cache(maxsize=2)
def words(path: str) -> Words:
    """One per Python worker and vocabulary."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Words(path)


def _path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, size: int = MAX_TOKENS, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): documents as ids and an end mark, cut only beyond ``size``.

    A null or empty text is the end mark alone. ids: BINARY, little-endian unsigned 32-bit integers.
    """
    path = path or _path()
    row = "piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    kinds = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids

    def some(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        end = np.uint32(END).astype("<u4").tobytes()
        for batch in batches:
            out, ends = [], [0]
            for at in range(0, len(batch), TOGETHER):
                for ids in words(path).encode(batch[at : at + TOGETHER].to_pylist()):
                    ids += end
                    for k, s in enumerate(range(0, len(ids), 4 * size)):
                        part = ids[s : s + 4 * size]
                        out.append((k, s // 4, len(part) // 4, zlib.crc32(part), part))
                    ends.append(len(out))
            columns = list(zip(*out)) or [()] * 5
            made = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds)], fields=[pa.field(*k) for k in kinds])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), made)

    some.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    cut_up = F.arrow_udf(some, f"array<struct<{re.sub(r'(\w+) (\w+)', r'\1:\2', row)}>>")
    return docs.select("doc_id", F.inline(cut_up(F.col("text"))))


def sweep(group: pa.Table) -> pa.Table:
    """One range's documents and the gaps dealt to it (kind, size, first, n, seq, seqs, gap, part): a run of documents takes its successor, the smallest free gap that it fits.

    In order of size each gaps' run takes the longest documents below it that are still free; the others
    wait for a larger gap. Of one length a sequence takes as many as fit. Where a length is used up, what is
    left of the gap goes to the next longest; otherwise it is a gap of the next sweep, less than half as
    large.
    """
    group = group.drop_columns(["part"])
    rows = sorted(zip(*(group.column(c).to_pylist() for c in group.column_names)), key=lambda r: (r[1], r[0], r[2]))
    out: list[tuple] = []
    waiting: list[list[int]] = []  # [length, first, n], longest last
    for kind, size, first, n, *_ in rows:
        if kind == DOCS:
            waiting.append([size, first, n])
        free = [(size, first, n)] if kind == GAPS else []
        while free:
            size, first, n = free.pop()
            if not waiting or waiting[-1][0] > size:
                out.append((GAPS, size, first, n, 0, 0, 0))
                continue
            length, rank, left = waiting.pop()
            layers = min(size // length, left)
            seqs = min(n, left // layers)
            out.append((MATCH, length, rank, seqs * layers, first, seqs, size))
            if left > seqs * layers:
                waiting.append([length, rank + seqs * layers, left - seqs * layers])
            if n > seqs:
                free.append((size, first + seqs, n - seqs))
            if size > layers * length:
                free.append((size - layers * length, first, seqs))
    out += [(DOCS, *run, 0, 0, 0) for run in waiting]
    return pa.table({f.name: pa.array(c, f.type) for f, c in zip(group.schema, zip(*out))}, schema=group.schema)


def deals(docs: dict[int, tuple], gaps: dict[int, tuple]) -> list[dict]:
    """Which gaps go to the documents of which range, for (n, tokens, shortest, longest) of each range of documents and of gaps.

    Of the gaps of range ``c``, numbered from the largest, those from ``low`` to before ``high`` go to the
    documents of range ``b`` (-1: they wait). Documents of a lower range fit all gaps of a range, those of its own
    only some of them.
    """
    out, want = [], {b: n for b, (n, *_) in docs.items()}
    for c in sorted(gaps):
        free, tokens, _, largest = gaps[c]
        mean, at = tokens / free, 0
        for b in sorted((b for b in want if b <= c), reverse=True):
            n, length, shortest, _ = docs[b]
            if b == c and shortest > largest:
                continue
            each = max(1, int(mean * n // length))
            k = min(free - at, -(-want[b] // each))
            if b < c:  # how many fit those of their own range isn't known: larger gaps are kept for them
                want[b] -= k * each
            if want[b] <= 0:
                del want[b]
            out.append({"c": c, "b": b, "low": at, "high": at + k})
            at += k
        out.append({"c": c, "b": -1, "low": at, "high": free})
    return [d for d in out if d["high"] > d["low"]]


def match(counts: DataFrame, size: int) -> DataFrame:
    """(length, first, n, seq, seqs, gap): which ranks of each length go to which sequences, for ``counts`` (length, n).

    Document k of a match goes to sequence ``seq + k % seqs``, ``k div seqs`` documents after the place where the
    gap began. A superstep deals gaps to ranges of documents and sweeps every range; what comes to the driver
    are sums for each range. Where a document is longer than any gap, as many sequences are opened as the
    lengths that entered, or their numbers in a sequence, need at least.
    """
    spark, width = counts.sparkSession, max(1, size // RANGES)
    is_docs, tokens = F.col("kind") == DOCS, F.col("size") * F.col("n")
    # A gap's range is that below which all documents fit.
    span = F.floor(F.when(is_docs, F.col("size") - 1).otherwise(F.col("size")) / width).cast("int")
    runs = counts.select(F.lit(DOCS).alias("kind"), F.col("length").cast("long").alias("size"), F.lit(0).cast("long").alias("first"), "n", *[F.lit(0).cast("long").alias(c) for c in ("seq", "seqs", "gap")])
    kinds, done, opened, above = runs.schema, [], 0, size
    state = runs.limit(0)
    for least in dict.fromkeys([*(size // k for k in ENTER), 0]):
        state = state.union(runs.where((F.col("size") > least) & (F.col("size") <= above)))
        above = least
        while True:
            room = {DOCS: {}, GAPS: {}}
            over = 0
            sums = state.groupBy("kind", span.alias("span")).agg(F.sum("n"), F.sum(tokens), F.min("size"), F.max("size"), F.sum(F.when(is_docs | (F.col("size") > least), tokens).otherwise(0)))
            for kind, at, *found, counted in sums.collect():  # two rows a range
                room[kind][at] = tuple(found)
                over += counted if kind == DOCS else -counted
            docs, gaps = room[DOCS], room[GAPS]
            if not docs:
                break
            largest = max((g[3] for g in gaps.values()), default=0)
            if max(d[3] for d in docs.values()) > largest:
                stuck = state.where(is_docs & (F.col("size") > largest))
                need = stuck.agg(F.sum(tokens).alias("all"), F.ceil(F.sum(F.when(F.col("size") * ENTER[-1] > size, F.col("n") / F.floor(size / F.col("size"))))).alias("by")).first()
                new = max(-(-need["all"] // size), -(-over // size), need["by"] or 0)
                state = state.union(spark.range(1, numPartitions=1).select(*[F.lit(v).cast(f.dataType) for v, f in zip((GAPS, size, opened, new, 0, 0, 0), kinds)]))
                opened += new
                n, held, *ends = gaps.get(size // width, (0, 0, size, size))
                gaps[size // width] = (n + new, held + new * size, min(ends[0], size), size)
            dealt = F.from_json(F.lit(json.dumps(deals(docs, gaps))), "array<struct<c:int,b:int,low:bigint,high:bigint>>")
            free = state.where(~is_docs).withColumn("span", span)
            upto = F.sum("n").over(Window.partitionBy("span").orderBy(F.col("size").desc(), "first"))  # runs of a range are few
            free = free.withColumn("to", upto).withColumn("from", F.col("to") - F.col("n"))
            mine = F.filter(dealt, lambda d: (d["c"] == F.col("span")) & (d["low"] < F.col("to")) & (d["high"] > F.col("from")))
            free = free.withColumn("d", F.explode(mine)).withColumn("lo", F.greatest("d.low", "from"))
            free = free.select("kind", "size", (F.col("first") + F.col("lo") - F.col("from")).alias("first"), (F.least("d.high", "to") - F.col("lo")).alias("n"), "seq", "seqs", "gap", F.col("d.b").alias("part"))
            ready = state.where(is_docs).withColumn("part", span).union(free)
            out = cut(ready.where("part >= 0").groupBy("part").applyInArrow(sweep, kinds).union(ready.where("part < 0").drop("part")))
            done.append(out.where(F.col("kind") == MATCH))
            state = out.where(F.col("kind") != MATCH)
    matches = reduce(DataFrame.union, done) if done else state
    return matches.select(F.col("size").alias("length"), "first", "n", "seq", "seqs", "gap")


def _blocks(matches: DataFrame) -> DataFrame:
    """``matches`` with a row for each ``block`` of ranks that they touch; in three steps, so that no array is long."""
    for bits in (26, 16, 6):
        low, high = F.greatest("first", "block"), F.least(F.col("first") + F.col("n"), F.col("stop")) - 1
        some = F.sequence(F.shiftright(low, bits), F.shiftright(high, bits))
        matches = matches.withColumn("b", F.explode(some)).withColumn("block", F.shiftleft("b", bits)).withColumn("stop", F.shiftleft(F.col("b") + 1, bits)).drop("b")
    return matches.withColumn("block", F.shiftright("block", 6)).drop("stop")


def assign(made: DataFrame, size: int = MAX_TOKENS) -> DataFrame:
    """``made`` (pieces, one row each, lengths from 1 to ``size``, ``at`` unlike for all rows) with ``sequence_id`` and ``offset``."""
    counts = cut(made.groupBy("length").agg(F.count("*").alias("n")))  # ``size`` rows at most
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    # A run of equal lengths may hold any share of the pieces: it is ranked in slices, of which there are
    # SLICES at most besides one for each length.
    full = max(500, total // SLICES)
    made = made.join(F.broadcast(counts.select("length", F.ceil(F.col("n") / full).cast("int").alias("slices"))), "length")
    made = made.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece", "at"), F.col("slices")).cast("int")).drop("slices")
    before = made.groupBy("length", "slice").agg(F.count("*").alias("n"))
    before = before.select("length", "slice", (F.sum("n").over(Window.partitionBy("length").orderBy("slice")) - F.col("n")).alias("before"))
    within = Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = made.withColumn("rank", F.row_number().over(within)).join(F.broadcast(before), ["length", "slice"])
    ranked = ranked.withColumn("rank", F.col("rank") - 1 + F.col("before")).drop("slice", "before")
    ranked = ranked.withColumn("block", F.shiftright("rank", 6))
    matches = match(counts, size).withColumns({"block": F.lit(0).cast("long"), "stop": F.col("first") + F.col("n")})
    placed = ranked.join(_blocks(matches), ["length", "block"]).withColumn("k", F.col("rank") - F.col("first")).where("k >= 0 AND k < n")
    place = {"sequence_id": F.expr("seq + k % seqs"), "offset": F.expr(f"{size} - gap + k div seqs * length")}
    return placed.withColumns(place).drop("block", "first", "n", "seq", "seqs", "gap", "k", "rank")


def pack(docs: DataFrame, size: int = MAX_TOKENS, path: str | None = None) -> DataFrame:
    """Where every piece of ``docs`` (doc_id, text, ...) goes: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Sequences hold at most ``size`` tokens, their pieces lie without gaps from offset 0, and only documents
    longer than ``size`` are cut. Null and empty texts are one piece of one token; rows are packed each by
    itself, so repeated rows and null or tied doc_ids are no matter; other columns are ignored; an empty
    table gives an empty result. The supersteps run when this is called.
    """
    made = cut(pieces(docs, size, path).withColumn("at", F.monotonically_increasing_id()))
    return assign(made, size).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
