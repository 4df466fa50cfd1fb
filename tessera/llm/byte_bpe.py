"""Byte-level BPE by a sentencepiece model that is written from the ranks of a public vocabulary.

Every byte becomes one character of a private block, every token one piece with the score of its negative
rank, and the normaliser is the identity: the model then merges exactly as the ranks say. Texts are split
into pre-tokens first; each is encoded by itself, and decoding maps the ids back to their bytes.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: First of the 256 characters that stand for bytes, in a private-use block.
BLOCK = 0xE000
#: Bytes that a Python worker uses to remember chunks, and those of an entry besides its text and ids.
_REMEMBERED, _ENTRY = 64 << 20, 240
#: A space within white space, where a text can't be cut by spaces alone.
_RUN = re.compile(r"\s (?:\s|\Z)|[\x1c-\x1f]")


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a file of base64 tokens and ranks, by rank."""
    with open(path, "rb") as lines:
        found = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    return [found[k] for k in range(len(found))]


def as_chars(token: bytes) -> str:
    return token.decode("latin-1").translate(_CHARS)


_CHARS = {k: BLOCK + k for k in range(256)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + np.float32(value).tobytes()
    return _varint(number << 3) + _varint(value)


def model_bytes(tokens: list[str]) -> bytes:
    """A serialised sentencepiece model: piece 0 is unknown, piece k + 1 the token of rank k."""
    pieces = [_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))]
    pieces += [_field(1, _field(1, t.encode()) + _field(2, -float(k)) + _field(3, 1)) for k, t in enumerate(tokens)]
    trainer = _field(2, _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, 0) + _field(41, (1 << 64) - 1) + _field(42, (1 << 64) - 1) + _field(43, (1 << 64) - 1))
    normalizer = _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return b"".join(pieces) + trainer + normalizer


class Codec(dict):
    """Remembers space-led chunks of texts and the bytes of their ids (little-endian, 32 bits)."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex
        import sentencepiece

        self.held = 0
        self.tokens = read_ranks(path)
        self.rank = {t: k for k, t in enumerate(self.tokens)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes([as_chars(t) for t in self.tokens]))
        # White space as Unicode has it: Python's \s also takes the four separators \x1c to \x1f.
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))

    def __missing__(self, chunk: str) -> bytes:
        ids = self.ids(chunk)
        if len(chunk) < 64:
            self.held += _ENTRY + 4 * len(chunk) + len(ids)
            if self.held > _REMEMBERED:
                self.clear()
                self.held = 0
            self[chunk] = ids
        return ids

    def ids(self, chunk: str) -> bytes:
        out: list[int] = []
        for part in self.split.findall(chunk):
            raw = part.encode("utf-8", "surrogatepass")
            known = self.rank.get(raw)
            if known is not None:
                out.append(known)
            else:
                out += [k - 1 for k in self.model.encode(as_chars(raw))]
        return np.array(out, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _RUN.search(text):
            return self.ids(text)
        first, *rest = text.split(" ")
        return b"".join(map(self.__getitem__, [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One per Python worker and vocabulary."""
    return Codec(path, pattern)


def _public() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _mapped(apply) -> object:
    def some(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array((apply(x.as_py()) for x in batch), pa.binary())

    some.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(some, "binary")


def encoded(text: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """Token ids of whole texts, packed as little-endian unsigned 32-bit integers (null or empty: no bytes)."""
    path, pattern = path or _public()[0], pattern or _public()[1]
    return _mapped(lambda x: codec(path, pattern).encode(x))(text)


def decoded(ids: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """The bytes that packed ids stand for (null: no bytes); an id outside the vocabulary is an error."""
    path, pattern = path or _public()[0], pattern or _public()[1]
    return _mapped(lambda x: codec(path, pattern).decode(x or b""))(ids)


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` (doc_id, text, ...) with BINARY columns ``ids`` and ``decoded``; see encoded and decoded.

    Row by row: repeated rows stay, ids may be null or tied, an empty table gives an empty result, and
    columns named like the two new ones are replaced.
    """
    return docs.withColumn("ids", encoded(F.col("text"), path, pattern)).withColumn("decoded", decoded(F.col("ids"), path, pattern))
