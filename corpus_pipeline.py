"""From raw documents to packed sequences, in five stages.

Each stage takes all that the one before kept, written as Parquet and read again, and acts on it: documents
go, lines go, copies go, personal data is masked, and the last stage says where every piece is packed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import line_dedup, packing, pii, quality_rules, simhash
from tessera.llm.shared import cut, table


def _apply(docs: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``operator`` on doc_id and text; the other columns travel aside, so that no name can clash with its own."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = operator(docs.select("doc_id", "text", F.struct(*(rest or [F.lit(0)])).alias("_rest")))
    back = {c: F.col("_rest")[c] for c in rest} | {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in rest:
        back["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[back[c].alias(c) for c in docs.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio."""
    return _apply(docs, quality_rules.passed)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines in three-line windows that an earlier document or place has."""
    return _apply(docs, line_dedup.dedup_lines)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group linked by SimHash fingerprints."""
    return _apply(docs, simhash.keep_one)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by the name of its kind."""
    return _apply(docs, pii.mask)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 4096 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("simhash_dedup", drop_near_copies),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]

#: SQL can't express the tokenizer and the packing; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage for the documents table in ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        docs = made if name == STAGES[-1][0] else cut(made, instead_of=docs)
    return docs
