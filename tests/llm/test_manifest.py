"""Toxicity, centroids and the Merkle manifest against plain versions."""

import hashlib
import itertools
import math
import random
import unicodedata
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import centroids, merkle, toxicity
from tessera.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", ["op12_lloyd", "op13_merkle_manifest"])
def test_query_equals_sql(spark, sf, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got, want = QUERIES[name](spark, sf), duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = [tuple(r) for r in got.select(*want.columns).collect()]
    assert sorted(rows) == sorted(want.fetchall()) and rows


# -- toxicity

WORDS = "the quick brown fox jumps over a lazy dog and then some idiot calls it stupid while the moron sleeps in the warm sun of an island".split()


@pytest.fixture(scope="module")
def model():
    rng = random.Random(4)
    return toxicity.language_model(toxicity.counted([" ".join(rng.choices(WORDS, k=40)) for _ in range(300)] + ["call 1 555 20 now!"]))


def test_counts_equal_plain_counting():
    symbol, _ = toxicity._tables()
    texts = ["", "ab  a-b.", "Äb1 \n\n", "漢字 a", "!a", " 1"]
    plain = np.zeros(64**3, np.int64)
    line = [int(symbol[ord(c)]) for c in " " + " ".join(texts) + " "]
    out = []
    for s, run in itertools.groupby(line):
        out += [0, 0] if s == 0 else list(run)
    for a, b, c in zip(out, out[1:], out[2:]):
        plain[(a * 64 + b) * 64 + c] += 1
    assert (toxicity.counted(texts) == plain).all() and plain.sum()
    p = np.exp(toxicity.language_model(plain)).sum(2)
    assert np.allclose(p, 1)


def readings(token, model):
    """Every reading of a token with its score."""
    for path in itertools.product(*toxicity.lattice(token)):
        a, b, total, parts = 0, 0, 0.0, []
        for s, cost, text in path:
            total += cost
            if s == -1:
                continue
            if s == -2:
                s, text = b, parts[-1][-1:]
            if s or b:
                total += model[a, b, s]
            a, b = (b, s) if s else (0, 0)
            parts.append(text)
        yield total + (model[a, b, 0] if b else 0.0), "".join(parts)


def test_decoded_is_the_likeliest_reading(model):
    rng = random.Random(8)
    signs = "abdimorstu01345$@!|.- "
    tokens = ["1d10t", "m0r0n", "s.t.u.p.1.d", "i d i o t", "stuupiiid", "a", "$", "..", "5tup1d!!", "aa-b-c", "x" * 7]
    tokens += ["".join(rng.choices(signs, k=rng.randrange(1, 9))) for _ in range(300)]
    for t in tokens:
        t = t.strip() or "a"
        best = {}
        for total, text in readings(t, model):
            best[text] = max(total, best.get(text, -1e9))
        got = toxicity.decode(t, model)
        assert best[got] == pytest.approx(max(best.values()), abs=1e-9), t


def test_disguises_are_undone(model):
    restore = toxicity.Restorer(model)
    for x in ("1d10t", "id!ot", "i d i o t", "i.d.i.o.t", "I-D-I-O-T", "idiooooot", "1d1000t"):
        assert restore(f"the {x} sleeps") == "the idiot sleeps", x
    assert restore("quick, brown fox. 1 555 20!") == "quick, brown fox. 1 555 20!"
    assert restore(None) == "" and restore("") == "" and restore("A b. c") == "a b. c"
    long = "the lazy dog " * 50_000 + "st\U0001f642upid m0r0n"
    assert restore(long).endswith("moron") and len(restore(long)) == len(long)
    assert len(restore("x1" * 20_000)) == 40_000


def plain_disguised(text):
    kind = lambda c: 0 if c.isspace() else 1 if c.isalpha() or unicodedata.category(c)[0] == "M" else 2 if c in toxicity.LEET else 3 if c in toxicity.SEPARATORS else 4
    spans, i = [], 0
    while i < len(text):
        if kind(text[i]) == 0:
            i += 1
            continue
        j = i
        while j < len(text) and kind(text[j]):
            j += 1
        spans.append((i, j))
        i = j
    single = [e - s == 1 and kind(text[s]) in (1, 2) for s, e in spans]
    out = []
    for k, (s, e) in enumerate(spans):
        ks = [kind(c) for c in text[s:e]]
        mixed = any({a, b} == {1, 2} for a, b in zip(ks, ks[1:]))
        thrice = any(a == 1 and x == y == z for a, x, y, z in zip(ks, text[s:e], text[s + 1 : e], text[s + 2 : e]))
        parted = any(ks[q] in (1, 2) and ks[q + 1] == 3 and ks[q + 2] in (1, 2) and ks[q + 4] in (1, 2) and text[s + q + 1] == text[s + q + 3] and not (q and ks[q - 1] in (1, 2)) for q in range(e - s - 4))
        if (mixed or thrice or parted) and not single[k]:
            out.append((s, e))
    k = 0
    while k < len(spans):
        j = k
        while j + 1 < len(spans) and single[j] and single[j + 1] and text[spans[j][1] : spans[j + 1][0]] == " ":
            j += 1
        if j - k >= 2:
            out.append((spans[k][0], spans[j][1]))
        k = j + 1
    return sorted(out)


def test_disguised_tokens_equal_plain_search():
    rng = random.Random(2)
    for k in range(3000):
        text = "".join(rng.choices("aab1$.-  \n\té!¡", k=k % 25))
        assert toxicity.disguised(text) == plain_disguised(text), repr(text)


def test_features_and_statistics_equal_plain_ones():
    rng = random.Random(6)
    texts = ["", *(" ".join(rng.choices(["a", "abcd", "abcdefghijkl", "äöü", "Ab", "x-y", "abcdx", "étés"], k=n)) for n in range(1, 30))]
    at, word, h = toxicity.features(texts)
    names, seen = {}, set()
    for k, t in enumerate(texts):
        clean = "".join(c if c.isalpha() or unicodedata.category(c)[0] == "M" else " " for c in t)
        for w in clean.split():
            seen |= {(k, w, w, 0)} | {(k, w, w[:n], n) for n in toxicity.STARTS if len(w) > n}
    one = {}
    for k, w, f, n in seen:
        one.setdefault((f, n), len(one))
    assert len(set(h.tolist())) == len(one) and len({*zip(at.tolist(), word.tolist(), h.tolist())}) == len(seen)
    lexicon = toxicity.Lexicon(np.sort(np.unique(h))[::3], np.linspace(1, 2, len(np.unique(h)[::3])))
    weight = dict(zip(lexicon.hashes.tolist(), lexicon.weights.tolist()))
    for k, row in enumerate(lexicon.statistics(texts)):
        mine = [(w, weight[f]) for a, w, f in zip(at.tolist(), word.tolist(), h.tolist()) if a == k and f in weight]
        best = sorted((max(x for v, x in mine if v == w) for w in {w for w, _ in mine}), reverse=True)
        n = sum(a == k and w == f for a, w, f in zip(at.tolist(), word.tolist(), h.tolist()))
        want = (best + [0.0] * 4)[:4] + [math.log1p(len(best)), math.log1p(n), math.log((len(best) + 0.5) / (n + 1))]
        assert row.tolist() == pytest.approx(want)
    assert toxicity.Lexicon(np.zeros(0, np.int64), np.zeros(0)).statistics(["a b"])[0, :5].tolist() == [0] * 5


DISGUISE = {"i": "1", "o": "0", "e": "3", "a": "@", "s": "$", "t": "7"}


def fixture_docs(spark, n=600):
    rng, rows, labels = random.Random(12), [], []
    plain = [w for w in WORDS if w not in ("idiot", "stupid", "moron")]
    for k in range(n):
        words, toxic = rng.choices(plain, k=60), int(k % 5 == 1)
        if toxic:
            for p in rng.sample(range(60), 4):
                w = rng.choice(["idiot", "stupid", "moron"])
                held = zlib.crc32(str(k).encode()) % 5 == 0
                words[p] = rng.choice(["".join(DISGUISE.get(c, c) for c in w), " ".join(w), "-".join(w), w[0] + w[1] * 4 + w[2:]]) if held else w
        rows.append((k, " ".join(words), "score", 1))
        labels.append((k, toxic))
    return spark.createDataFrame(rows, "doc_id bigint, text string, toxic string, held_out int"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_disguised_words_of_held_out_documents_are_caught(spark):
    docs, labels = fixture_docs(spark)
    got = toxicity.score(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 600 and len(held) > 80 and {r["held_out"] for r in got} == {True, False}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(r["predicted"] == r["toxic"] for r in held if r["toxic"])
    assert sum(r["predicted"] != r["toxic"] for r in got) <= 3


def test_odd_rows_of_toxicity(spark):
    docs, labels = fixture_docs(spark, 200)
    odd = docs.unionByName(docs.limit(7)).unionByName(spark.createDataFrame([(None, "an idiot", "s", 1), (10**12, None, None, 1), (10**12, "", None, None), (10**12 + 1, "1" * 50_000, "", 0)], docs.schema))
    wrong = spark.createDataFrame([(None, 1), (10**12, 1), (10**12, 0), (3, None), (4, 7), (5, 0), (5, 0), (5, 1)], "doc_id bigint, toxic int")
    got = toxicity.score(odd, labels.unionByName(wrong)).collect()
    assert len(got) == 211 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    again = {}
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] < 200:
            again.setdefault(r["doc_id"], set()).add(r["score"])
    assert all(len(s) == 1 for s in again.values())
    nothing = toxicity.score(docs, labels.limit(0)).collect()
    assert {r["score"] for r in nothing} == {0.5} and len(nothing) == 200
    assert toxicity.score(docs.limit(0), labels).collect() == []
    # Many more labels than documents take nothing from what is learned.
    many = labels.unionByName(spark.range(1000, 60_000).selectExpr("id AS doc_id", "0 AS toxic"))
    same = {r["doc_id"]: r["score"] for r in toxicity.score(docs, many).collect()}
    assert same == {r["doc_id"]: r["score"] for r in toxicity.score(docs, labels).collect()}


# -- centroids


def plain_lloyd(rows, k, rounds, dim):
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: (i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "")
    centres = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((away(v, c), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        of = {}
        for _, v in kept:
            of.setdefault(near(v)[1], []).append(v)
        centres = [[sum(x) // len(of[j]) for x in zip(*of[j])] if j in of else c for j, c in enumerate(centres)]
    found = [(i, near(v)[1], near(v)[0]) for i, v in kept]
    sums = {j: sum(d for _, c, d in found if c == j) for j in range(k)}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, j, d, sums[j], sum(sums.values()), sha[j]) for i, j, d in found), key=str)


@pytest.mark.parametrize("n", [0, 1, 5, 300])
def test_lloyd_equals_plain_version(spark, n):
    rng = random.Random(n)
    rows = [(k * (1 << 50) if k % 3 else k, [float(np.float32(rng.gauss(c := k % 4, 0.4) - c * 2)) for _ in range(8)]) for k in range(n)]
    if n > 100:
        rows += rows[:40] + [(None, rows[0][1]), (None, rows[1][1])]
        rows += [(1, None), (2, []), (3, [1.0] * 7), (4, [1.0] * 7 + [None]), (5, [1.0] * 7 + [float("nan")]), (6, [1.0] * 7 + [float("inf")]), (7, [-0.0] * 8), (8, [1.0] * 9)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id bigint, embedding array<float>, cluster string, v int").repartition(3)
    got = centroids.report(df, k=6, rounds=3, dim=8)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_lloyd(rows, 6, 3, 8)


def test_huge_components_are_held(spark):
    df = spark.createDataFrame([(k, [1e300 * (-1) ** k] * 64) for k in range(3)], "vec_id bigint, embedding array<double>")
    got = {r["vec_id"]: r["distance"] for r in centroids.report(df, k=2).collect()}
    assert set(got) == {0, 1, 2} and min(got.values()) >= 0


# -- the manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def frame(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def reduced(nodes, fanout):
    """(root, for each node its siblings' (before, after) level by level)."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            s = i - i % fanout
            proofs[k].append(("".join(nodes[s:i]), "".join(nodes[i + 1 : s + fanout])))
        nodes, at = [H(*nodes[s : s + fanout]) for s in range(0, len(nodes), fanout)], [i // fanout for i in at]
    return nodes[0] if nodes else None, proofs


def plain_manifest(rows, fanout=3):
    leaf = lambda r, text: H(*map(frame, (*r[:4], text)))
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        some = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees[s] = (some, *reduced([leaf(r, r[4]) for r in some], fanout))
    root, tops = reduced([trees[s][1] for s in order], fanout)
    out = []
    for s, top in zip(order, tops):
        some, subroot, proofs = trees[s]
        for r, proof in zip(some, proofs):
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            h = leaf(r, r[4].replace("\n", "") if even and r[4] is not None else r[4])
            for b, a in proof + top:
                h = H(b, h, a)
            out.append((r[0], leaf(r, r[4]), subroot, root, H(*(b + a for b, a in proof + top)), h, h == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("n,sources,part,band", [(0, 1, 7, 2), (1, 1, 7, 2), (3, 3, 7, 1), (200, 1, 11, 1), (300, 5, 7, 2), (300, 40, 1000, 9), (260, 2, 13, 3)])
def test_manifest_equals_plain_version(spark, n, sources, part, band):
    rng = random.Random(n + part)
    rows = [(k if k % 17 else None, rng.choice([None, *(f"s{j}é" for j in range(sources - 1))]) if k % 3 else "hot", rng.choice([None, "en", ""]), rng.choice([None, k]), rng.choice([None, "", "a\nb\n", "\n", f"text {k} ü🙂\n" * 3])) for k in range(n)]
    rows += rows[:30] + rows[:5]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, source string, lang string, n_chars bigint, text string, leaf string, row int").repartition(5)
    proved = merkle.prove(merkle.document_leaves(df), ["id"], part=part, band=band)
    proof = F.sha2(F.array_join(F.zip_with("before", "after", lambda b, a: F.concat(b, a)), ""), 256)
    got = proved.select("row.doc_id", "leaf", "subroot", "root", proof, merkle.folded(F.col("row.tampered"), F.col("before"), F.col("after")).alias("f")).collect()
    assert sorted(((*r, r["f"] == r["root"]) for r in got), key=str) == plain_manifest(rows)
    if n == 300 and sources == 5:
        assert sorted((tuple(r) for r in merkle.verified(df).collect()), key=str) == plain_manifest(rows)
        other = merkle.prove(merkle.document_leaves(df), ["id"], fanout=4, part=part, band=band).select("root").distinct().collect()
        assert len(other) == 1 and other[0]["root"] == plain_manifest(rows, 4)[0][3]


def test_tampering_is_seen(spark):
    rows = [(k, f"s{k % 3}", "en", 5, f"line\n{k}") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    for r in merkle.verified(df).collect():
        assert r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 2 == 1)
