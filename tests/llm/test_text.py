"""Personal data, quality, language and shards."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import langid, pii, quality_classifier, quality_rules, sharding

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(map(int, str(int(c) * (1 + i % 2)))) for i, c in enumerate(reversed(digits))) % 10 == 0


def plain_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) < 256 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def test_base_spans_equal_plain_expressions(spark):
    rng, texts = random.Random(5), [None, "", "a@b.c._x@d.e-f.g", "1.2.3.4.5.6.7.8", "+1 (017) 555-7713", "4111 1111-1111 1111"]
    for _ in range(1500):
        texts.append("".join(rng.choices(rng.choice(["0123456789 -.+()", "a1.@-_%+é ", "12.5 ", "0123 -", "a@b.c-🙂 1"]), k=rng.randrange(1, 60))))
    texts += ["1.2" * 5000, "1 " * 3000, "a." * 20_000 + "@" + "b." * 20_000 + "c", "+1" + "(" * 50_000, "9" * 50_000]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(None, "x@y.z", "x")], "doc_id bigint, text string, spans string").repartition(4)
    got = {r["doc_id"]: r for r in pii.spans(df).collect()}
    assert len(got) == len(texts) + 1 and got[None]["n_email"] == 1
    for k, t in enumerate(texts):
        want = plain_spans(t)
        listed = [f"{kind}:{s}:{e}" for s, _, e, kind in want]
        assert got[k]["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest(), t[:80]
        assert [got[k][f"n_{kind}"] for kind in KINDS] == [sum(w[3] == kind for w in want) for kind in KINDS]
        assert [x for x in got[k]["spans"].split(",") if x and not x.startswith("identifier")] == listed


def card(k):
    head = f"4{k:014}"
    return next(head + str(c) for c in range(10) if luhn(head + str(c)))


def contexts(n):
    rows = [(k, f"please charge my card {card(k)} today") for k in range(n)]
    return rows + [(1000, "please charge my card 4000000000000001 today"), (1001, "see release 2024-01-15-0001 of the notes"), (1002, None)]


def test_patterns_of_seeds_discover_others(spark):
    got = {r["doc_id"]: r for r in pii.spans(spark.createDataFrame(contexts(8), "doc_id bigint, text string")).collect()}
    assert not luhn("4000000000000001") and got[1000]["spans"] == "identifier:22:38" and got[1000]["n_card"] == 0
    assert got[1001]["spans"] == "" and got[1002]["spans"] == "" and got[0]["spans"] == "card:22:38"
    alone = pii.spans(spark.createDataFrame(contexts(8)[8:], "doc_id bigint, text string")).collect()
    assert all(r["spans"] == "" for r in alone)
    assert pii.spans(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


UNSEEN = {
    "email": (lambda k: f"please write to {chr(97 + k)}x@mail{k}.org soon", "please write to anna.b@localhost soon", "anna.b@localhost"),
    "ip": (lambda k: f"logged in from 10.1.{k}.7 at noon", "logged in from 10.1.300.7 at noon", "10.1.300.7"),
    "card": (lambda k: f"paid with card {card(k)} yesterday", "paid with card 4000 0000 0000 0001 yesterday", "4000 0000 0000 0001"),
    "phone": (lambda k: f"reach me on +1 (826) 555-40{10 + k} tonight", "reach me on (826) 555-4099 tonight", "(826) 555-4099"),
}


@pytest.mark.parametrize("kind", UNSEEN)
def test_each_kind_of_seed_discovers(spark, kind):
    make, text, hidden = UNSEEN[kind]
    rows = [(k, make(k)) for k in range(8)] + [(100, text), (101, "see release 2024-01-15-0001 of 12.04.2024 1234 notes")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in pii.spans(df).collect()}
    start = text.index(hidden)
    assert got[100]["spans"] == f"identifier:{start}:{start + len(hidden)}" and got[101]["spans"] == ""
    assert all(got[k][f"n_{kind}"] == 1 and got[k]["n_found"] == 0 for k in range(8))
    masked = {r["doc_id"]: r["text"] for r in pii.mask(df).collect()}
    assert masked[100] == text.replace(hidden, "[IDENTIFIER]") and masked[101] == rows[-1][1]


#: The rule of candidates, written out: a name, an @ and a domain; digits in groups, parted by one sign or a parenthesis; a token
#: of eight letters, digits and hyphens with a digit. Nothing that could belong to it stands before, nor after a group.
CANDIDATE = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*"
    r"|(?<![0-9A-Za-z.+-])\+?\(?[0-9]++(?:\)?[ ./-]?\(?[0-9]++)++(?![A-Za-z0-9-])"
    r"|(?<![0-9A-Za-z-])(?=[A-Za-z-]*[0-9])[0-9A-Za-z-]{8,}"
)


def plain_matches(pattern, text):
    """(start, end, match, context words before, after), as contexts are defined: between the matches of one expression."""
    import regex

    found, rows = list(regex.finditer(pattern, text)), []
    words = lambda x: regex.sub(r"[^\p{L}\p{N}=:]+", " ", x).lower().split()
    for i, m in enumerate(found):
        before = text[found[i - 1].end() if i else 0 : m.start()]
        after = text[m.end() : found[i + 1].start() if i + 1 < len(found) else len(text)]
        rows.append((m.start(), m.end(), m[0], words(before[-80:]), words(after[:40])))
    return rows


def plain_contexts(m, before, after):
    kind = "a" if re.search("[A-Za-z]", m) else "9"
    out = [f"{before[-1]} _ {kind}"] if before else []
    out += [f"{before[-2]} {before[-1]} _"] if len(before) > 1 else []
    return out + ([f"_ {after[0]} {kind}"] if after else [])


def plain_extraction(docs):
    """The spans of every document by the whole loop, one document and one round after the other."""
    seen, edges, accepted, cands = {}, set(), {}, {}
    for doc, text in docs.items():
        text, seen[doc] = text or "", plain_spans(text)
        for kind, pattern in pii.KINDS.items():
            for start, end, m, before, after in plain_matches(pattern, text):
                if any((start, end, kind) == (s, e, k) for s, _, e, k in seen[doc]):
                    accepted[m] = 1.0
                    edges |= {(m, p) for p in plain_contexts(m, before, after)}
        rows = [r for r in plain_matches(CANDIDATE, text) if len(re.sub("[^0-9]", "", r[2])) >= 4 or "@" in r[2]]
        cands[doc] = [r for r in rows if not any(s < r[1] and r[0] < e for s, _, e, _ in seen[doc])]
        edges |= {(r[2], p) for r in cands[doc] for p in plain_contexts(*r[2:])}
    members = {}
    for m, p in edges:
        members.setdefault(p, []).append(m)
    rounds = 0
    while True:
        means = {p: sum(sorted(accepted.get(m, 0.0) for m in ms)) / len(ms) for p, ms in members.items() if sum(m in accepted for m in ms) >= 3}
        new = {}
        for p, mean in means.items():
            for m in members[p]:
                if mean >= 0.7 and m not in accepted:
                    new[m] = max(mean, new.get(m, 0.0))
        if not new:
            break
        accepted, rounds = accepted | new, rounds + 1
    own = {doc: [(s, r, e, k) for s, r, e, k in rows] for doc, rows in seen.items()}
    for doc, rows in cands.items():
        own[doc] = sorted(own[doc] + [(r[0], 4, r[1], "identifier") for r in rows if r[2] in accepted])
    return {doc: ",".join(f"{k}:{s}:{e}" for s, _, e, k in rows) for doc, rows in own.items()}, rounds


def hops(n):
    """Cards discover numbers that fail their check, these a second context, and that one numbers with no card beside them."""
    bad = lambda k: f"4{k:014}{(int(card(k)[-1]) + 1) % 10}"
    docs = [f"please charge my card {card(k)} today" for k in range(n)] + [f"please charge my card {bad(k)} today" for k in range(6)]
    docs += [f"then wire to account {bad(k)} again" for k in range(6)] + ["then wire to account 7000000000000000 again"]
    return docs + ["an unknown thing 7000000000000000 here", "see release 2024-01-15-0001 of the notes"]


def test_discovered_instances_support_patterns_of_their_own(spark):
    docs = hops(40)
    got = [r["spans"] for r in sorted(pii.spans(spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")).collect(), key=lambda r: r["doc_id"])]
    assert got[40:46] == ["identifier:22:38"] * 6 and got[46:53] == ["identifier:21:37"] * 7  # two hops
    assert got[53] == "identifier:17:33" and got[54] == ""  # wherever it stands
    want, rounds = plain_extraction(dict(enumerate(docs)))
    assert got == list(want.values()) and rounds == 2


def test_extraction_equals_the_plain_loop(spark):
    rng = random.Random(21)
    words, ends = "call pay the of card account mail id ref".split(), [" ", ", ", "\n", ": ", "="]
    make = [
        lambda: card(rng.randrange(12)), lambda: f"4{rng.randrange(9):015}", lambda: f"u{rng.randrange(9)}@mail.org", lambda: f"u{rng.randrange(9)}@host", lambda: f"10.0.{rng.randrange(400)}.1",
        lambda: f"+1 (826) 555-40{rng.randrange(10, 30)}", lambda: f"(826) 555-40{rng.randrange(10, 30)}", lambda: f"AB-{rng.randrange(12):06}", lambda: str(rng.randrange(9999)), lambda: "2024-01-1" + str(rng.randrange(9)),
    ]
    docs = {}
    for k in range(400):
        parts = [rng.choice(words) if rng.random() < 0.75 else rng.choice(make)() for _ in range(rng.randrange(1, 25))]
        docs[k] = "".join(p + rng.choice(ends) for p in parts)
    docs |= {400: None, 401: "", 402: "card " * 40 + card(3), 403: "12345678-1 " * 300}
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(3)
    want, rounds = plain_extraction(docs)
    got = {r["doc_id"]: r["spans"] for r in pii.spans(df).collect()}
    assert got == want and rounds >= 2 and sum("identifier" in x for x in want.values()) > 20


def test_work_grows_with_the_matches(spark):
    docs = spark.createDataFrame([(1, "123456789012 " * 80_000)], "doc_id bigint, text string")  # 1 MB of matches
    import time

    began = time.perf_counter()
    assert pii.mask(docs).count() == 1 and pii.mask(docs).first()["text"] is not None
    assert time.perf_counter() - began < 120


def test_mask(spark):
    rows = [*contexts(8), (5, "a@b.cd or 10.0.0.1 or +1 (017) 555-7713"), (5, "a@b.cd or 10.0.0.1 or +1 (017) 555-7713")]
    got = sorted((r["doc_id"], r["text"]) for r in pii.mask(spark.createDataFrame(rows, "doc_id bigint, text string")).collect() if r["text"])
    assert (1000, "please charge my card [IDENTIFIER] today") in got and (0, "please charge my card [CARD] today") in got
    assert sum(t == "[EMAIL] or [IP] or [PHONE]" for _, t in got) == 2


def plain_base(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + d for i, t in enumerate(triples) if triples.count(t) > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_base_counts_equal_brute_force(spark):
    rng = random.Random(6)
    texts = [None, "", "\n \n", "\xa0", "\x1c", *("".join(rng.choices(["a ", "b ", "é|", "\n", "\t", "a b a b\n", "🙂 "], k=rng.randrange(0, 80))) for _ in range(250))]
    many = [str(k) for k in range(60)]
    texts += [" ".join(many + ["x"] + many[10:50]), " ".join(many[:5] * 3 + many), "a a a a b a a a"]  # more and fewer repeated windows than FEW
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id bigint, text string, kept int").repartition(3)
    rows = quality_rules.judge(df)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for r in rows.collect():
        want = plain_base(r["text"])
        assert tuple(r[n] for n in names) == want, r["text"]
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and (not r["kept"] or not r["base_failed"])
    assert quality_rules.judge(df.limit(0)).count() == 0


def corpus(times=1):
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 8))) for _ in range(300)]
    good = [" ".join(rng.choices(words, k=120)) for _ in range(60 * times)]
    bad = [" ".join(w.upper() + "!!" for w in rng.choices(words, k=120)) for _ in range(20 * times)] + [" ".join(w + "###" for w in rng.choices(words, k=120)) for _ in range(20 * times)]
    return good, bad


def test_ratio_keeps_clean_and_drops_junk(spark):
    good, bad = corpus()
    df = spark.createDataFrame(list(enumerate(good + bad)), "doc_id bigint, text string").repartition(3)
    kept = {r["doc_id"] for r in quality_rules.judge(df).where("kept").collect()}
    assert kept == set(range(len(good)))


def test_clean_documents_of_a_language_with_combining_marks_are_kept(spark):
    good, bad = corpus()
    words = "यह एक साधारण हिन्दी वाक्य है जिसमें कोई विशेष चिह्न नहीं और लोग इसे पढ़ते हैं क्योंकि किताबें बहुत अच्छी लगती थीं दुनिया में".split()
    rng = random.Random(11)
    hindi = [" ".join(rng.choices(words, k=120)) for _ in range(4)]  # 4 percent of the corpus
    df = spark.createDataFrame(list(enumerate(good + hindi + bad)), "doc_id bigint, text string").repartition(3)
    kept = {r["doc_id"] for r in quality_rules.judge(df).where("kept").collect()}
    assert kept == set(range(len(good) + len(hindi)))


def test_ratio_equals_plain_sum(spark):
    ratio = [(k * 37) % 401 - 200 for k in range(quality_rules.BUCKETS)]
    df = spark.createDataFrame([("Ab c1, d!! ab",), ("",), (None,)], "text string")
    got = df.select(quality_rules.mean_ratio(F.col("text"), ratio).alias("r"), quality_rules.buckets(F.col("text")).alias("b")).collect()
    assert len(got[0]["b"]) == 14 and got[0]["r"] == pytest.approx(sum(ratio[b] for b in got[0]["b"]) / 14 / 1000)
    assert got[1]["r"] == got[2]["r"] == 0


def test_quality_classifier_on_held_out_rows(spark):
    good, bad = corpus(4)
    texts = good + bad
    docs = spark.createDataFrame([(k, t, 0.0) for k, t in enumerate(texts)] + [(None, None, 0.0), (5000, "", 0.0)], "doc_id bigint, text string, score double").repartition(3)
    labels = spark.createDataFrame([(k, int(k < len(good)), 0) for k in range(len(texts))] + [(None, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality_classifier.score(docs, labels).collect()}
    assert len(got) == len(texts) + 2 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    held = [k for k in range(len(texts)) if got[k]["held_out"]]
    assert held == [k for k in range(len(texts)) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert np.mean([got[k]["predicted"] == (k < len(good)) for k in held]) >= 0.95
    none = quality_classifier.score(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}


def test_rules_compile_to_the_same_score(spark):
    rng = np.random.default_rng(3)
    x = rng.random((400, len(quality_classifier.FEATURES)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] <= 0.7)).astype(int)
    intercept, rules = quality_classifier.fit(x, y)
    z = intercept + sum(w * quality_classifier.holds(r, x) for r, w in rules.items())
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[:50]], ", ".join(f"{f} double" for f in quality_classifier.FEATURES))
    got = [r["s"] for r in df.select(quality_classifier.compiled(intercept, rules).alias("s")).collect()]
    assert got == pytest.approx((1 / (1 + np.exp(-z[:50]))).tolist()) and np.mean((z > 0) == y) > 0.97


WORDS = {"en": "the of and thing with that", "de": "der und nicht schön über ein", "fr": "le été une avec où même", "es": "el niño con qué una año", "fi": "yö kissa talo järvi minä sinä"}


def test_languages_on_held_out_rows(spark):
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choices(WORDS[c].split(), k=rng.randrange(3, 30))), c, "x") for k in range(600) for c in [sorted(WORDS)[k % 5]]]
    extra = [(9000, None, "en", "x"), (9001, "12 !?", "en", "x"), (None, "the of and", "en", "x"), (9002, "le été", None, "x"), (9003, "yö kissa " * 20_000, None, "x")]
    df = spark.createDataFrame(rows + extra, "doc_id bigint, text string, lang string, score string").repartition(3)
    got = {r["doc_id"]: r for r in langid.identify(df).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k, *_ in rows)
    assert np.mean([got[k]["lang_pred"] == c for k, _, c, _ in held]) > 0.98
    assert got[9000]["lang_pred"] == got[9001]["lang_pred"] == "und" and got[9003]["lang_pred"] == "fi" and got[None]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


@pytest.mark.parametrize("axes,bits", [(2, 3), (3, 2), (3, 4)])
def test_curve_visits_neighbours(axes, bits):
    places = sharding.hilbert(axes, bits)
    assert sorted(places) == list(range(1 << axes * bits))
    points = np.array([[c >> bits * a & (1 << bits) - 1 for a in range(axes)] for c in np.argsort(places)])
    assert (np.abs(np.diff(points, axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("n", [0, 3, 1003])
def test_shards(spark, n):
    rng = random.Random(9)
    rows = [(k if k % 9 else None, rng.choice([None, "", "é" * rng.randrange(900), "same"]), rng.choice([None, "en", "de"]), rng.choice(["a", "b" * 9, None]), 0) for k in range(n)]
    rows += rows[:1] * bool(n > 3)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, shard int").repartition(3)
    got = sharding.layout(df).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(k), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t, *_ in rows)
    counts = [sorted(r["slot"] for r in got if r["shard"] == s) for s in range(40)]
    assert all(c == list(range(len(c))) for c in counts) and max(map(len, counts)) - min(map(len, counts)) <= 1
    order = [r["hilbert"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert order == sorted(order)


def test_sources_that_share_their_beginning(spark):
    rows = [(k, "same text", "en", f"https://site{k % 10}.example/") for k in range(4000)] + [(k, "same text", "en", None) for k in range(4000, 4400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(3)
    got = sharding.layout(df, 40).join(df.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.countDistinct("shard").alias("n"), F.countDistinct("hilbert").alias("cells")).collect()
    assert len(got) == 11 and all(r["n"] <= 6 and r["cells"] == 1 for r in got)


@pytest.mark.parametrize("bits", [1, 4])
def test_levels_are_in_the_order_of_whole_strings(spark, bits):
    rng = random.Random(12)
    values = [rng.choice([None, "", "https://a", "https://b/" + "x" * rng.randrange(40), "https://é", "z"]) for _ in range(700)]
    firsts = sharding.firsts(spark.createDataFrame([(v,) for v in values], "s string"), "s", 1 << bits)
    given, key = [v for v in values if v is not None], lambda v: v.encode()
    below = lambda v: values.count(None) + sum(key(x) < key(v) for x in given)
    for v in set(given):
        assert sum(key(v) >= key(f) for f in firsts) == below(v) * (1 << bits) // len(values)


def test_written_shards(spark, tmp_path):
    rng = random.Random(13)
    rows = [(k if k % 7 else None, "t" * rng.randrange(300), rng.choice(["en", "de", None]), f"https://site{k % 12}.example/", 9) for k in range(1000)]
    rows += [(5, "same", "en", "s", 9)] * 200  # repeated rows
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, slot int")
    sharding.write(docs, str(tmp_path / "out"), 24)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["count"] for r in back.groupBy("shard").count().collect()) == [50] * 24
    assert sorted(map(str, [tuple(r) for r in back.select("doc_id", "text", "lang", "source").collect()])) == sorted(str(r[:4]) for r in rows)
    bounds = back.groupBy("shard").agg(F.min("source").alias("low"), F.max("source").alias("high")).collect()
    opened = [sum(b["low"] <= s <= b["high"] for b in bounds) for s in {r[3] for r in rows}]
    assert np.mean(opened) <= 12, opened  # the reader of one source opens half of the shards or fewer


def plain_llr(texts):
    """Ratios of all buckets and the mean ratio of each text, one n-gram after the other."""
    import math

    import regex
    import xxhash

    def signed(h):
        return h - (1 << 64) if h >> 63 else h

    def bucket(*tokens):
        h = 42
        for t in tokens:
            h = xxhash.xxh64_intdigest(t.encode(), h)
        return signed(h) & quality_rules.BUCKETS - 1

    grams, counts, target = [], [0] * quality_rules.BUCKETS, [0] * quality_rules.BUCKETS
    for text in texts:
        text = text or ""
        tokens = regex.findall(r"[\p{L}\p{M}]+|\p{N}+|[^\p{L}\p{M}\p{N}\s]+", text)
        own = [bucket(t) for t in tokens] + [bucket(a, b) for a, b in zip(tokens, tokens[1:])] + [bucket(t) for t in tokens[-1:]]
        grams.append(own)
        trusted = len(re.findall("[^\x20\x09-\x0d]+", text)) >= 50 and len(regex.sub(r"[\p{L}\p{M}\s]+", "", text)) <= quality_rules.TRUSTED_OTHER * len(text)
        for b in own:
            counts[b] += 1
            target[b] += trusted
    n, t = sum(counts), sum(target)
    share = lambda x, of: math.log((x + 1) / (of + quality_rules.BUCKETS))
    ratio = [round(quality_rules.SCALE * (share(b, t) - share(a, n))) if t else 0 for a, b in zip(counts, target)]
    return ratio, [sum(ratio[b] for b in own) / len(own) / quality_rules.SCALE if own else 0.0 for own in grams]


def test_ratios_equal_brute_force(spark):
    good, bad = corpus()
    texts = [None, "", "# 1!", *good, *bad, *good[:3]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    want, means = plain_llr(texts)
    assert quality_rules.ratios(df) == want and len(set(want)) > 50
    rows = {r["doc_id"]: r for r in quality_rules.judge(df).collect()}
    assert [rows[k]["llr"] for k in range(len(texts))] == pytest.approx(means)
    assert all(r["kept"] == (not r["base_failed"] and r["llr"] >= quality_rules.THRESHOLD) for r in rows.values())


def plain_statistics(text):
    import math

    import regex

    t = text or ""
    n_words, word_chars, n_symbols, n_dup, n_rep = plain_base(t)
    n, chars, lines = max(1, n_words), max(1, len(t)), len(t.split("\n"))
    share = lambda p: len(regex.findall(p, t)) / chars
    distinct = len(set(re.split("[\x20\x09-\x0d]+", t.lower())))
    return [math.log1p(n_words), word_chars / n, n_symbols / chars, share(r"\p{Lu}"), share(r"[^\p{L}\s]"), share("[0-9]"), n_dup / lines, n_rep / n, distinct / n, chars / lines]


def test_statistics_equal_brute_force(spark):
    rng = random.Random(14)
    texts = [None, "", " ", "\n\n", *("".join(rng.choices(["a ", "B", "é|", "\n", "\t", "12 ", "a b c\n", "#"], k=rng.randrange(0, 80))) for _ in range(120))]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id bigint, text string, symbols string").repartition(3)
    for r in quality_classifier.statistics(df).collect():
        assert [r[f] for f in quality_classifier.FEATURES] == pytest.approx(plain_statistics(r["text"])), r["text"]


def test_scores_of_repeated_rows_and_empty_tables(spark):
    good, bad = corpus()
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(good + bad)] + [(0, good[0])] * 50, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, int(k < len(good))) for k in range(len(good) + len(bad))] + [(0, 1)] * 40, "doc_id bigint, quality int")
    rows = quality_classifier.score(docs, labels, sample=300).collect()
    assert len(rows) == len(good) + len(bad) + 50 and len({r["score"] for r in rows if r["doc_id"] == 0}) == 1
    assert quality_classifier.score(docs.limit(0), labels).count() == 0


def test_features_and_votes_equal_plain_ones(spark):
    rng = np.random.default_rng(15)
    letters = "aé ßb1"
    for text in ["", "1 2", *("".join(rng.choice(list(letters), 30)) for _ in range(30))]:
        chars = [0, 0, *(ord(c) if c.isalpha() else 0 for c in text.lower()), 0, 0]
        mask, counts = (1 << 32) - 1, np.zeros(langid.WIDTH)
        for i in range(len(chars) - 1):
            pair = (chars[i] * 0x9E3779B1 ^ chars[i + 1] * 0x85EBCA77) & mask
            if chars[i] or chars[i + 1]:
                counts[(pair * 0x27D4EB2F & mask) >> 20] += 1
            if i + 2 < len(chars) and chars[i + 1] and (chars[i] or chars[i + 2]):
                counts[(((pair * 3 ^ chars[i + 2] * 0xC2B2AE3D) & mask) * 0x27D4EB2F & mask) >> 20] += 1
        got = langid.features(text)
        assert (got is None) == (not counts.any())
        if got is not None:
            assert got == pytest.approx(np.sqrt(counts) / np.linalg.norm(np.sqrt(counts)), abs=1e-6)
    x = rng.random((60, langid.WIDTH)).astype(np.float32) / 30
    model = langid.Model(x, [["en", "de", "nl", "fr", "es", "fi"][k % 6] for k in range(60)])
    names, scores = model.predict(x)
    for row, name, score in zip(x, names, scores):
        margins = [3 * (f[:-1] @ row + f[-1]) for f in model.family]
        odds = np.exp(np.array(margins) - max(margins))
        members = model.members[model.families[int(odds.argmax())]]
        votes = dict.fromkeys(members, 0.0)
        for a in members:
            for b in members:
                if a < b:
                    p = 1 / (1 + np.exp(-3 * float(model.pairs[a, b][:-1] @ row + model.pairs[a, b][-1])))
                    votes[a], votes[b] = votes[a] + p, votes[b] + 1 - p
        best = max(members, key=lambda c: (votes[c], c))
        assert name == best and score == pytest.approx(odds.max() / odds.sum() * (votes[best] / (len(members) - 1) if len(members) > 1 else 1), abs=1e-5)


def test_languages_of_repeated_rows_and_empty_tables(spark):
    rows = [(1, "der und nicht", "de")] * 3000 + [(k, "the of and", "en") for k in range(2, 60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("found", F.lit(1))
    got = langid.identify(df)
    assert got.count() == len(rows) and {r["lang_pred"] for r in got.where("doc_id = 1").collect()} == {"de"}
    assert langid.identify(df.limit(0)).count() == 0


def test_long_candidates_are_found(spark):
    """A name of many characters, a digit after many letters, and many groups of digits."""
    names = ["n" * 90 + "@host", "x" * 60 + "-77123", "/".join(["12"] * 20), "-".join(["1234"] * 40)]
    for hidden in names:
        seed = [(k, f"please write to {chr(97 + k)}x@mail{k}.org soon") for k in range(8)] if "@" in hidden else contexts(8)[:8]
        text = f"please write to {hidden} soon" if "@" in hidden else f"please charge my card {hidden} today"
        if hidden[0] == "x":
            seed, text = [(k, f"reach id ab{k}c@d.org now") for k in range(8)], f"reach id {hidden} now"
        got = {r["doc_id"]: r["spans"] for r in pii.spans(spark.createDataFrame([*seed, (99, text)], "doc_id bigint, text string")).collect()}
        start = text.index(hidden)
        assert got[99] == f"identifier:{start}:{start + len(hidden)}", hidden
    blob = "a" * 200_000 + " " + "1 " * 100_000 + "b-" * 50_000 + "9"
    assert pii.spans(spark.createDataFrame([(1, blob)], "doc_id bigint, text string")).count() == 1


def test_many_labels_of_other_documents(spark):
    """Labels whose documents aren't there take no place in the sample."""
    rng = random.Random(3)
    rows, labels = [], []
    for k in range(300):
        good = k % 2
        words = [rng.choice(["stone", "river", "cloud", "grass"]) + str(rng.randrange(90)) * good for _ in range(80)]
        rows.append((k, " ".join(words) if good else " ".join(words[:4] * 20)))
        labels.append((k, good))
    docs, mine = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int")
    many = mine.unionByName(spark.range(10_000, 40_000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality"))
    want = {r["doc_id"]: r["score"] for r in quality_classifier.score(docs, mine, sample=250).collect()}
    got = {r["doc_id"]: r["score"] for r in quality_classifier.score(docs, many, sample=250).collect()}
    assert got == want and all((got[k] >= 0.5) == bool(k % 2) for k in range(300))


def test_features_reach_the_driver_without_lists():
    import tracemalloc

    import pyarrow as pa

    rows, places = 20_000, 2437
    at = np.arange(rows, dtype=np.int32)[:, None] % 3 + np.sort(np.random.default_rng(1).permutation(4000)[:places]).astype(np.int32)[None, :]
    offsets = pa.array(np.arange(0, rows * places + 1, places, dtype=np.int32))
    sparse = lambda flat, kind: pa.chunked_array([pa.ListArray.from_arrays(offsets, pa.array(flat, kind)).slice(s, 7000) for s in range(0, rows, 7000)])
    a, v = sparse(at.reshape(-1).astype(np.int16), pa.int16()), sparse(np.ones(rows * places, np.float32), pa.float32())
    tracemalloc.start()
    x = langid.dense(a, v)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert x.shape == (rows, langid.WIDTH) and (x.sum(1) == places).all() and x[5, at[5]].all() and peak < 450e6


def test_machines_of_tasks_equal_those_of_one_process(spark):
    rng = np.random.default_rng(2)
    languages = [["en", "de", "fr", "es", "zh"][k % 5] for k in range(100)]
    x = rng.random((100, langid.WIDTH), np.float32) + np.eye(5, langid.WIDTH, dtype=np.float32)[np.arange(100) % 5]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    one, side = langid.Model(x, languages), langid.Model(x, languages, langid.side_by_side(spark))
    assert np.allclose(one.family, side.family, atol=1e-5) and set(one.pairs) == set(side.pairs) == {("de", "en"), ("es", "fr")}
    assert all(np.allclose(one.pairs[k], side.pairs[k], atol=1e-5) for k in one.pairs)
    y = np.where(np.array(languages) == "zh", 1, -1).astype(np.float32)
    plain = langid.machine(x, y)
    assert ((x @ plain[:-1] + plain[-1] > 0) == (y > 0)).all() and np.allclose(plain, one.family[one.families.index("zh")], atol=1e-5)


CLASHING = ["_id", "_hash", "_at", "_words", "_trim", "_row", "_kept", "_failed", "_llr", "_n_words", "_full", "_gone", "_lines", "_text_hash", "_again", "n", "kept", "text_hash", "component_id", "fingerprint", "a.b"]


def test_columns_of_any_name(spark):
    """Every operator that returns a table's columns keeps those that are called like its inner ones."""
    from tessera.llm import line_dedup, simhash

    body = [" ".join(f"plain{k}word{j}" for j in range(70)) for k in range(4)]
    rows = [(k, f"{body[k]}\nmail x{k}@y.org\nlast line {k}", *([k] * len(CLASHING))) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"`{c}` bigint" for c in CLASHING))
    made = {"lines": line_dedup.dedup_lines(docs), "masked": pii.mask(docs), "one": simhash.keep_one(docs), "passed": quality_rules.passed(docs), "counts": quality_rules.base_counts(docs), "judged": quality_rules.judge(docs)}
    for name, out in made.items():
        assert out.columns[: len(docs.columns)] == docs.columns, name
        for r in out.collect():
            own = {"judged": {"kept"}}.get(name, set())
            assert all(r[c] == r["doc_id"] for c in CLASHING if c not in own), name
    assert {r["text"].split("\n")[1] for r in made["masked"].collect()} == {"mail [EMAIL]"}


def test_machines_are_at_their_optimum():
    """The gradient of the squared hinge loss with its penalty, written out, is next to nothing where the fit ends."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 10)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.where(x[:, 0] + 0.05 * rng.normal(size=60) > 0.1, 1, -1).astype(np.float32)
    w = langid.machine(x, y, penalty=0.05, rounds=3000).astype(float)
    full = np.hstack([x, np.ones((60, 1))]).astype(float)
    slope = 0.05 * w
    for row, label in zip(full, y):
        short = max(0.0, 1 - label * float(row @ w))
        slope -= 2 * row * label * short * 0.5 / (y == label).sum()
    assert np.abs(slope).max() < 1e-3 and ((full @ w > 0) == (y > 0)).mean() > 0.8


def test_lasso_is_at_its_optimum():
    """Weights without a rule have a slope within the penalty, the others one that equals it."""
    rng = np.random.default_rng(6)
    z = (rng.random((300, 12)) < 0.4).astype(float)
    y = (rng.random(300) < 1 / (1 + np.exp(-(3 * z[:, 0] - 2 * z[:, 1] - 0.5)))).astype(float)
    w, b = quality_classifier._lasso(z, y, 0.02, 0.0, rounds=4000)
    slope = [sum((1 / (1 + np.exp(-(row @ w + b))) - t) * row[j] for row, t in zip(z, y)) / 300 for j in range(12)]
    assert abs(sum(1 / (1 + np.exp(-(row @ w + b))) - t for row, t in zip(z, y))) / 300 < 1e-4
    assert all(abs(s + 0.02 * np.sign(v)) < 1e-4 if v else abs(s) < 0.02 + 1e-4 for s, v in zip(slope, w))
    assert w[0] > 1 and w[1] < -0.5 and (w == 0).sum() >= 4


def test_spans_of_repeated_rows(spark):
    rows = contexts(8) + contexts(8)[:3] + [(1000, "please charge my card 4000000000000001 today")] * 2 + [(None, "please charge my card 4000000000000001 today")]
    got = pii.spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == len(rows) and all(r["spans"] == "identifier:22:38" for r in got if r["doc_id"] in (1000, None))
    assert sum(r["doc_id"] == 0 and r["spans"] == "card:22:38" for r in got) == 2
