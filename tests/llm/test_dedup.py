"""Near duplicates and repeated lines against brute force."""

import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import embedding_dedup, line_dedup, simhash


def roots(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def vectors():
    rng = np.random.default_rng(1)
    rows = [rng.standard_normal(16) for _ in range(120)]
    for k in range(60):  # near copies of some, at many distances
        x = rows[k % 7]
        rows.append(x + rng.standard_normal(16) * np.linalg.norm(x) * 0.02 * (k % 9))
    rows += [rows[0] * 3.0, rows[1].copy(), rows[1].copy()]
    return [r.astype(np.float32).tolist() for r in rows]


BAD = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15]


@pytest.mark.parametrize("chunk", [1024, 16])
def test_embeddings_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(embedding_dedup, "CHUNK", chunk)
    monkeypatch.setattr(embedding_dedup, "BLOCK", chunk)
    monkeypatch.setattr(embedding_dedup, "SMALL", 64 if chunk == 1024 else 6)
    monkeypatch.setattr(embedding_dedup, "SENT", 64 if chunk == 1024 else 2)
    rows = vectors() + [vectors()[0][:8]]
    x = [np.array(r, float) for r in rows]
    near = [(a, b) for a in range(len(x)) for b in range(a) if len(x[a]) == len(x[b]) and x[a] @ x[b] / np.linalg.norm(x[a]) / np.linalg.norm(x[b]) >= 0.95]
    want = roots(len(rows), near)
    links = np.bincount(np.array(near).reshape(-1), minlength=len(rows))
    data = [(k, r, "x") for k, r in enumerate(rows + BAD)] + [(None, rows[0], "x")]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<float>, kept string").repartition(3)
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df).collect()}
    assert len(got) == len(data)
    for k in range(len(rows)):
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (links[k], want[k], want[k] == k)
    for k in range(len(rows), len(rows) + len(BAD)):
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (0, k, True)
    assert (got[None]["n_links"], got[None]["component_id"], got[None]["kept"]) == (0, None, False)


def crowd(n, dim=64, cosine=0.957):
    """A third of the rows different near copies around one centre."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centre, k = x[-1].copy(), n // 3
    x[:k] = centre + x[:k] * np.sqrt(1 / cosine - 1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_links_of_a_large_group_are_found(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SENT", 6)  # leads as for a larger table
    x = crowd(3000).astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.95).sum(1) - 1
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id bigint, embedding array<float>")
    got = sum(r["n_links"] for r in embedding_dedup.near_duplicates(df).collect())
    assert want.sum() > 500_000 and want.sum() * 0.9999 <= got <= want.sum()


def test_leads_hold_their_recall_at_a_hundred_thousand():
    x = crowd(100_000)
    rng = np.random.default_rng(4)
    fit = embedding_dedup.calibrate(x[rng.choice(len(x), 1000, replace=False)], len(x), 0.95, 0.9999, 7)
    assert fit["leads"] > 2 and fit["tables"] > 4
    codes = embedding_dedup.lead_codes(x[:2000], np.full(2000, 64), fit, fit["tables"])
    p, q = rng.integers(2000, size=(2, 200_000))
    near = (p != q) & ((x[p] * x[q]).sum(1) >= 0.95)
    met = (codes[p[near]] == codes[q[near]]).any(1)
    assert near.sum() > 100_000 and met.mean() >= 0.9999


def test_windows_and_counts_come_from_no_sample():
    from math import comb
    from statistics import NormalDist

    rng = np.random.default_rng(6)
    samples = [embedding_dedup._units(rng.standard_normal((1000, 64)) + shift) for shift in (0, 1, 1, 5)]
    fits = [embedding_dedup.calibrate(x, n, 0.95, 0.9999, 7) for x in samples for n in (1000, 1_000_000)]
    assert len({(f["width"], f["least"], f["reach"]) for f in fits}) == 1
    inside = 2 * NormalDist().cdf(fits[0]["width"] / np.sqrt(0.1 / 64)) - 1
    missed = lambda least: sum(comb(16, k) * inside**k * (1 - inside) ** (16 - k) for k in range(least))
    assert missed(fits[0]["least"]) <= 5e-5 < missed(fits[0]["least"] + 1)


@pytest.mark.parametrize("n", [0, 1])
def test_few_embeddings(spark, n):
    df = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(n)], "vec_id bigint, embedding array<float>")
    assert [tuple(r) for r in embedding_dedup.near_duplicates(df).collect()] == [(k, 0, k, True) for k in range(n)]


def test_collisions_are_counted_by_windows():
    rng = np.random.default_rng(0)
    a, b = rng.integers(-3000, 3000, (9, 5), np.int16), rng.integers(-3000, 3000, (13, 5), np.int16)
    assert (embedding_dedup.collisions(a, b) == (np.abs(a[:, None].astype(int) - b[None]) <= embedding_dedup.WIDE).sum(2)).all()


def plain_fingerprint(text):
    import xxhash

    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def texts():
    rng = random.Random(2)
    words = ["Éa", "the", "of", "x", "word", "other", "İz", "z" * 40]
    out = [" ".join(rng.choices(words, k=rng.randrange(1, 60))) for _ in range(150)]
    out += [t + " tail" for t in out[:30]] + out[:10] + [t.upper() for t in out[:5]]
    return [None, "", " \t\n", "one", "one two", "\x1cone\xa0two three", "a " * 70_000, *out]


@pytest.mark.parametrize("segments,tile", [(1, 32_768), (2, 16), (4, 16)])
def test_close_links_equal_brute_force(spark, segments, tile):
    rng = random.Random(segments)
    base = [rng.getrandbits(64) for _ in range(25)]
    prints = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (1 << 64) - 1 for b in base for _ in range(12)})
    near = [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3]
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, k) for k, p in enumerate(prints)], "fingerprint bigint, rep bigint")
    links = [(r["a"], r["b"]) for r in simhash.close_links(df, 3, tile, segments).collect()]
    assert roots(len(prints), links) == roots(len(prints), near)


def test_simhash_equals_brute_force(spark):
    rows = texts()
    prints = [plain_fingerprint(t) for t in rows]
    near = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3]
    want = roots(len(rows), near)
    df = spark.createDataFrame([(k, t, 0) for k, t in enumerate(rows)], "doc_id bigint, text string, component_id int").repartition(3)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(df).collect()}
    assert [got[k]["fingerprint"] & (1 << 64) - 1 for k in range(len(rows))] == prints
    assert [got[k]["component_id"] for k in range(len(rows))] == want
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))


def test_keep_one_of_repeated_rows_and_null_ids(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (9, "a b c d"), (None, "p q r s"), (None, "p q r s"), (None, "a b c d")]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(map(str, map(tuple, got))) == ["(5, 'a b c d')", "(None, 'p q r s')"]
    assert simhash.keep_one(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def plain_lines(docs):
    seen, out = set(), {}
    for k, text in sorted(docs.items()):
        lines = (text or "").split("\n")
        full = [i for i, x in enumerate(lines) if re.search("[^\x20\x09-\x0d]", x)]
        gone = set()
        for t in range(len(full) - 2):
            window = tuple(lines[i] for i in full[t : t + 3])
            if window in seen:
                gone.update(full[t : t + 3])
            seen.add(window)
        out[k] = (text if text is None else "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone))
    return out


def test_lines_equal_brute_force(spark):
    rng = random.Random(4)
    pool = ["a", "b", "c", "", "  ", "d\x0b", "e e", "\xa0"]
    docs = {k: "\n".join(rng.choices(pool, k=rng.randrange(0, 14))) for k in range(80)}
    docs |= {80: None, 81: "", 82: "\n".join(f"l{i % 50}" for i in range(3000)), 83: "l0\nl1\nl2"}
    df = spark.createDataFrame([(k, t, 1) for k, t in docs.items()], "doc_id bigint, text string, _at int").withColumnRenamed("_at", "n_lines").repartition(3)
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(df).collect()}
    assert got == plain_lines(docs)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_lines_of_repeated_rows_and_null_ids(spark):
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc\nd")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == [("1", ""), ("1", ""), ("None", "a\nb\nc\nd")]


def test_lines_equal_sql(spark, sf):
    from tessera.llm.queries import ORACLES, QUERIES

    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    got, want = QUERIES["op7_line_dedup"](spark, sf), duck.sql(ORACLES["op7_line_dedup"])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
    assert got.agg(F.sum("n_removed")).first()[0] > 0


def test_vectors_of_any_length_link(spark):
    """Components whose squares leave the range of doubles, and ids that repeat."""
    from tessera.llm import embedding_dedup

    rows = [(1, [1e-170, 2e-170]), (2, [1e-170, 2e-170]), (3, [1e200, 2e200]), (4, [5e-324, 1e-323]), (5, [1e200, -2e200]), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, None), (10, []), (3, [2e-5, 4e-5]), (3, [2.0, -1.0])]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    links = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got)
    assert links == [(1, 4, 1), (2, 4, 1), (3, 0, 3), (3, 4, 1), (3, 4, 1), (4, 4, 1), *[(k, 0, k) for k in (5, 6, 7, 8, 9, 10)]]


def test_fingerprints_of_an_empty_table(spark):
    from tessera.llm import simhash

    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert simhash.near_duplicates(empty).collect() == [] and simhash.keep_one(empty).collect() == []
