"""The pipeline against the stages' plain meanings, and the registration of its queries."""

import pytest

import __spark_entry__
import corpus_pipeline
from tessera.llm import packing


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        out[name] = docs = spark.createDataFrame(docs.toArrow()) if docs.columns else docs
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages(spark, sf, stages):
    names = list(stages)
    for before, name in zip(names, names[1:-1]):
        assert stages[name].schema.names == stages["documents"].schema.names
        assert set(ids(stages[name])) <= set(ids(stages[before]))
    assert ids(stages["line_dedup"]) == ids(stages["quality_rules"]) and ids(stages["pii"]) == ids(stages["simhash_dedup"])
    assert len(ids(stages["simhash_dedup"])) == len(set(ids(stages["simhash_dedup"])))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    from tessera.llm import quality_rules

    judged = quality_rules.judge(stages["documents"].select("doc_id", "text"))
    assert ids(stages["quality_rules"]) == ids(judged.where("kept"))
    clean = judged.where("not base_failed").join(labels.where("quality = 1"), "doc_id")
    assert set(ids(clean)) <= set(ids(stages["quality_rules"]))
    text = {r["doc_id"]: r for r in stages["pii"].collect()}
    assert not any("@mail" in r["text"] for r in text.values()) and all(r["n_chars"] == len(r["text"]) for r in text.values())
    pieces = stages["packing"].collect()
    want = packing.pieces(stages["pii"]).collect()
    key = lambda r: (r["doc_id"], r["piece"], r["length"], r["ids_crc32"])
    assert sorted(map(key, pieces)) == sorted(map(key, want))


def plain_run(rows):
    """The pieces that five stages leave, by the plain versions of the other tests: one document after the other."""
    import re
    import zlib

    import numpy as np
    import test_dedup as dedup
    import test_text as text
    from tokenizers import Tokenizer

    from tessera.llm import pii, quality_rules

    _, means = text.plain_llr([t for _, t in rows])
    docs = {}
    for (doc, t), mean in zip(rows, means):
        words, _, _, _, repeats = text.plain_base(t)
        if words >= 50 and 100 * repeats <= 50 * words and mean >= quality_rules.THRESHOLD:
            docs[doc] = t
    docs = {doc: t for doc, (t, _) in dedup.plain_lines(docs).items()}
    prints = {doc: dedup.plain_fingerprint(t) for doc, t in docs.items()}
    order = sorted(docs)
    near = [(i, j) for i, a in enumerate(order) for j, b in enumerate(order[:i]) if (prints[a] ^ prints[b]).bit_count() <= 3]
    docs = {order[k]: docs[order[k]] for k in sorted(set(dedup.roots(len(order), near)))}
    found, _ = text.plain_extraction(docs)
    for doc, t in docs.items():
        spans = [s.split(":") for s in found[doc].split(",") if s.startswith("identifier")]
        for _, a, b in reversed(spans):
            t = t[: int(a)] + "[IDENTIFIER]" + t[int(b) :]
        for rank, (kind, pattern) in enumerate(text.KINDS.items()):
            good = {(s, e) for s, r, e, _ in text.plain_spans(t) if r == rank}
            t = re.sub(pattern, lambda m: f"[{kind.upper()}]" if m.span() in good else m[0], t)
        docs[doc] = t
    plain = Tokenizer.from_file(packing._path())
    plain.encode_special_tokens = True
    out = []
    for doc, t in docs.items():
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        out += [(doc, s // 4096, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for s in range(0, len(ids), 4096)]
    return sorted(out)


def test_run_equals_a_plain_version(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    key = lambda r: (r["doc_id"], r["piece"], r["length"], r["ids_crc32"])
    got = corpus_pipeline.run(spark, sf).collect()
    want = plain_run(rows)
    assert sorted(map(key, got)) == want and len(want) > 50
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for some in by.values():
        ends = [a + n for a, n in sorted(some)]
        assert [a for a, _ in sorted(some)] == [0, *ends[:-1]] and ends[-1] <= 4096


def test_run_equals_the_stages_in_turn(spark, sf, stages):
    key = lambda r: (r["doc_id"], r["piece"], r["length"], r["ids_crc32"])
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted(map(key, got)) == sorted(map(key, stages["packing"].collect()))


def test_stages_of_odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    odd = docs.unionByName(docs.limit(5)).unionByName(spark.createDataFrame([(None, None, None, None, None), (10**6, None, None, "s", 3), (10**6 + 1, "", "en", None, None)], docs.schema))
    odd = odd.selectExpr("*", "1 AS kept", "'x' AS fingerprint", "2 AS n_lines")
    for some in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            some = stage(spark, some, sf)
            if name != "packing":
                assert some.columns == odd.columns
                some = spark.createDataFrame(some.toArrow(), some.schema)
        assert some.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        some.collect()


def test_all_and_the_pipeline_are_registered():
    names = __spark_entry__.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
