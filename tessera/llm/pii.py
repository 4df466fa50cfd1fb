"""Personal data by bootstrapped contextual extraction, by DataFrame functions only.

Seeds are the entities that four fixed expressions find. Their contexts, the words beside them (for a single
word, with the class of what stands there: with letters or without), are lexical patterns; other tokens that
could be identifiers of any kind are candidates.
Patterns and instances form a graph that is scored in rounds, up to a fixed point: a pattern by the mean score
of its instances, an instance by the best pattern that discovers it. Instances that a round discovers count for
other patterns in the next one, and are identifiers wherever they stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import aside, cut, restored

#: The four kinds in their order. The expressions match what the plain forms
#:   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+    ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#:   card [0-9]([\x20-]?[0-9])+                                 phone \+[0-9][\x20().0-9-]+[0-9]
#: match, without backing up: a run of an entity's first characters is tried from its start only, since the
#: rest of a match doesn't depend on where in the run it starts.
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: A candidate, in this order: names around an @ (domains without a dot too); groups of digits with a + or a
#: parenthesis before and dots, hyphens, slashes, a space or a parenthesis between; eight letters, digits and
#: hyphens at least, a digit among them. Four digits in all, or an @. Of any length: each run is tried from its start only.
CANDIDATE = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+"
    r"|(?<![0-9A-Za-z.+-])\+?\(?[0-9]++(?:[)]?[\x20./-]?[(]?[0-9]++)++(?![A-Za-z0-9-])"
    r"|(?<![0-9A-Za-z-])(?=[A-Za-z-]*+[0-9])[0-9A-Za-z-]{8,}+"
)
CANDIDATE_NEEDS = r"[0-9@]"
CONFIDENCE, SUPPORT = 0.7, 3
#: Characters before and after a match that its context may reach; a longer word counts with the part in reach.
BEFORE, AFTER = 80, 40
_MATCH = "array<struct<start:int,end:int,m:string,left:string,right:string>>"


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), use), 0)


def _running(values: Column, join, none: int) -> Column:
    """Of whole numbers, ``join`` over each and all before it (``none``: its neutral number), by doubled steps: n log n work."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))
    back = lambda acc, i, k: F.coalesce(F.get(acc, i - F.call_function("shiftleft", F.lit(1), k)), F.lit(none))
    return F.aggregate(steps, values, lambda acc, k: F.transform(acc, lambda x, i: join(x, back(acc, i, k))))


def _below(ordered: Column, value: Column) -> Column:
    """How many of the ordered numbers are less than ``value``, by bisection."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(ordered) + 1)).cast("int"))

    def step(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["low"] + s["high"], 1)
        less = F.coalesce(F.get(ordered, mid) < value, F.lit(False)) & (s["low"] < s["high"])
        return F.struct(F.when(less, mid + 1).otherwise(s["low"]).alias("low"), F.when(less, s["high"]).otherwise(mid).alias("high"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(ordered).alias("high")), step, lambda s: s["low"])


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]+", "")


def _luhn(digits: Column) -> Column:
    twice = lambda c: F.when(2 * c > 9, 2 * c - 9).otherwise(2 * c)
    each = F.transform(F.sequence(F.lit(0), F.length(digits) - 1), lambda i: F.struct(F.substring(F.reverse(digits), i + 1, F.lit(1)).cast("int").alias("c"), (i % 2 == 1).alias("second")))
    return F.aggregate(each, F.lit(0), lambda s, x: s + F.when(x["second"], twice(x["c"])).otherwise(x["c"])) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.cast("double") <= 255)
    n = F.length(_digits(m))
    return n.between(9, 15) if kind == "phone" else F.when(n.between(12, 19), _luhn(_digits(m))).otherwise(False)


def _matches(text: Column, pattern: str, needs: str) -> Column:
    """All matches with their places (code points, end exclusive) and the text beside them.

    The gaps between matches and the matches themselves add up to the places.
    """

    def rows(gaps: Column) -> Column:
        some = F.zip_with(gaps, F.regexp_extract_all(text, F.lit(pattern), 0), lambda g, m: F.struct(g.alias("g"), m.alias("m"), F.length(m).alias("w")))
        some = F.zip_with(some, F.slice(gaps, 2, F.greatest(F.size(gaps), F.lit(1))), lambda r, n: F.struct((F.length(r["g"]) + r["w"]).alias("n"), r["w"].alias("w"), r["m"].alias("m"), F.right(r["g"], F.lit(BEFORE)).alias("left"), F.left(n, F.lit(AFTER)).alias("right")))
        return F.filter(some, lambda r: r["m"].isNotNull())

    def placed(some: Column) -> Column:
        ends = _running(F.transform(some, lambda r: r["n"]), lambda a, b: a + b, 0)
        return F.zip_with(some, ends, lambda r, e: F.struct((e - r["w"]).alias("start"), e.alias("end"), r["m"].alias("m"), r["left"].alias("left"), r["right"].alias("right")))

    places = _bound(F.split(text, pattern, -1), lambda gaps: _bound(rows(gaps), placed))
    return F.when(text.rlike(needs), places).otherwise(F.array().cast(_MATCH))


def _patterns(x: Column) -> Column:
    """Contexts of a match: the two words before by themselves; the word before and the word after, each with the match's class."""
    words = lambda c: F.filter(F.split(F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}=:]+", " ")), " "), lambda w: w != "")
    kind = F.when(x["m"].rlike("[A-Za-z]"), "a").otherwise("9")
    before, after = words(x["left"]), words(x["right"])
    one, two = F.try_element_at(before, F.lit(-1)), F.try_element_at(before, F.lit(-2))
    return F.filter(F.array(F.concat(one, F.lit(" _ "), kind), F.concat(two, F.lit(" "), one, F.lit(" _")), F.concat(F.lit("_ "), F.get(after, 0), F.lit(" "), kind)), lambda p: p.isNotNull())


def base(docs: DataFrame) -> DataFrame:
    """``docs`` (text, ...) with ``_seeds``: the valid matches of the four kinds, ordered by start, then kind."""
    text = F.coalesce("text", F.lit(""))

    def entities(rank: int, kind: str) -> Column:
        ok = F.filter(_matches(text, KINDS[kind], NEEDS[kind]), lambda x: _valid(kind, x["m"]))
        return F.transform(ok, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["m"].alias("m"), x["left"].alias("left"), x["right"].alias("right")))

    found = {f"_{kind}": entities(rank, kind) for rank, kind in enumerate(KINDS)}
    return docs.withColumns(found).withColumn("_seeds", F.array_sort(F.concat(*found))).drop(*found)


def candidates(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_cands``: tokens with an identifier's shape that touch no seed, and ``k``, their number among all such tokens."""
    all_ = F.transform(_matches(F.coalesce("text", F.lit("")), CANDIDATE, CANDIDATE_NEEDS), lambda x, k: F.struct(x["start"].alias("start"), k.alias("k"), x["end"].alias("end"), x["m"].alias("m"), x["left"].alias("left"), x["right"].alias("right")))
    some = F.filter(all_, lambda x: (F.length(_digits(x["m"])) >= 4) | F.contains(x["m"], F.lit("@")))

    def free(starts: Column, ends: Column) -> Column:
        # Of the seeds that start before a candidate's end the last end lies at or before its start.
        return F.filter("_some", lambda x: F.coalesce(F.get(ends, _below(starts, x["end"]) - 1) <= x["start"], F.lit(True)))

    reach = F.transform("_seeds", lambda s: s["start"]), _running(F.transform("_seeds", lambda s: s["end"]), F.greatest, 0)
    free_ = _bound(reach[0], lambda starts: _bound(reach[1], lambda ends: free(starts, ends)))
    alone = (F.size("_seeds") == 0) | (F.size("_some") == 0)
    return docs.withColumn("_some", some).withColumn("_cands", F.when(alone, F.col("_some")).otherwise(free_)).drop("_some")


def discover(found: DataFrame, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """(instance, score): the seeds, with 1, and what the patterns of high confidence discover.

    found: _seeds and _cands of all documents. A pattern is one of high confidence where ``support`` accepted
    instances or more stand in it and the mean score of all its instances (0: not accepted) is ``confidence``
    at least. Instances that stand in one are accepted, with the best mean as their score for good; then the
    patterns are scored anew, until a round accepts nothing. Scores fall from hop to hop, since a mean is 1 at
    most. Edges are pairs of different instances and patterns; sums are pre-aggregated, and a pattern or an
    instance with a large share of all edges is split by the engine's skew handling, for nothing is gathered.
    """
    seeds = found.select(F.explode("_seeds").alias("x")).select(F.col("x.m").alias("instance"), _patterns(F.col("x")).alias("p"), F.lit(True).alias("seed"))
    cands = found.select(F.explode("_cands").alias("x")).select(F.col("x.m").alias("instance"), _patterns(F.col("x")).alias("p"), F.lit(False).alias("seed"))
    edges = seeds.union(cands).select("instance", "seed", F.explode_outer("p").alias("pattern")).groupBy("instance", "pattern").agg(F.max("seed").alias("seed"))
    edges = cut(edges)
    accepted = cut(edges.where("seed").select("instance", F.lit(1.0).alias("score")).distinct())
    # A pattern with fewer instances than ``support`` never counts.
    often = edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= support).select("pattern")
    edges = cut(edges.select("instance", "pattern").join(often, "pattern"))
    rounds = [accepted]
    while not rounds[-1].isEmpty():
        scored = edges.join(accepted, "instance", "left")
        sure = scored.groupBy("pattern").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("mean"), F.count("score").alias("n")).where((F.col("mean") >= confidence) & (F.col("n") >= support))
        new = edges.join(sure, "pattern").groupBy("instance").agg(F.max("mean").alias("score")).join(accepted, "instance", "left_anti")
        rounds.append(cut(new))
        accepted = accepted.union(rounds[-1])
    return accepted


def extract(docs: DataFrame) -> DataFrame:
    """(doc_id, _text_hash, _seeds, _new) for every row of ``docs`` (doc_id, text, ...).

    _seeds: base entities; _new: discovered ones (start, k, end, m; null if none), never over a base entity.
    Null texts are empty. Rows that share doc_id and text (repeated rows) get the same; doc_id may be null.
    With no seeds nothing is discovered; an empty table gives an empty result. Contexts reach BEFORE and
    AFTER characters; candidates have an @ or four digits at least (see CANDIDATE). Work grows with n log n in
    the matches of a text.
    """
    found = cut(candidates(base(docs.select("doc_id", "text").withColumn("_text_hash", F.xxhash64("text")))).drop("text"))
    at = found.where(F.size("_cands") > 0).select("doc_id", "_text_hash", F.explode("_cands").alias("x"))
    at = at.select("doc_id", "_text_hash", F.struct("x.start", "x.k", "x.end", "x.m").alias("x"), F.col("x.m").alias("instance"))
    new = at.join(discover(found), "instance").groupBy("doc_id", "_text_hash").agg(F.sort_array(F.collect_set("x")).alias("_new"))
    new = new.withColumnRenamed("doc_id", "_id").withColumnRenamed("_text_hash", "_hash")
    return found.drop("_cands").join(new, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("_text_hash").eqNullSafe(F.col("_hash")), "left").drop("_id", "_hash")


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found): see extract; texts of spans are kind:start:end."""
    each = lambda kind, x: F.concat_ws(":", kind, x["start"].cast("string"), x["end"].cast("string"))
    own = F.transform("_seeds", lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))
    new = F.transform(F.coalesce("_new", F.array().cast("array<struct<start:int,k:int,end:int,m:string>>")), lambda x: F.struct(x["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), x["end"].alias("end"), F.lit("identifier").alias("kind")))
    joined = lambda a: F.array_join(F.transform(a, lambda x: each(x["kind"], x)), ",")
    count = lambda kind: F.size(F.filter("_seeds", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in KINDS]
    return extract(docs).select("doc_id", *counts, F.sha2(joined(own), 256).alias("base_sha256"), joined(F.array_sort(F.concat(own, new))).alias("spans"), F.coalesce(F.size("_new"), F.lit(0)).cast("long").alias("n_found"))


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with entities in ``text`` replaced by [EMAIL], [IP], [CARD], [PHONE] and [IDENTIFIER].

    Discovered tokens are replaced first, then kind after kind by the kind's expression, each on what the one
    before left; a name in brackets holds no digit and no @, so that it neither makes nor lengthens a match.
    Null texts stay null, texts without entities and all other columns as they are; rows that repeat are
    treated alike.
    """
    new = extract(docs).where("_new is not null").select(F.col("doc_id").alias("_id"), F.col("_text_hash").alias("_hash"), F.array_sort(F.transform("_new", lambda x: x["k"])).alias("_at")).dropDuplicates(["_id", "_hash"])
    joined = aside(docs, "doc_id", "text").join(new, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash")), "left")

    def replaced(text: Column, pattern: str, needs: str, by: str, ok) -> Column:
        found = F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), lambda m, i: F.when(ok(m, i), F.lit(f"[{by.upper()}]")).otherwise(m))
        parts = F.zip_with(F.split(text, pattern, -1), found, lambda g, m: F.concat(g, F.coalesce(m, F.lit(""))))
        return F.when(text.rlike(needs), F.array_join(parts, "")).otherwise(text)

    at = F.col("_at")
    text = replaced(F.col("text"), CANDIDATE, CANDIDATE_NEEDS, "identifier", lambda m, i: F.get(at, _below(at, i)) == i)
    joined = joined.withColumn("text", F.when(at.isNull(), F.col("text")).otherwise(text))
    for kind, pattern in KINDS.items():
        joined = joined.withColumn("text", replaced(F.col("text"), pattern, NEEDS[kind], kind, lambda m, _, k=kind: _valid(k, m)))
    return joined.select(*restored(docs.columns, {}, "doc_id", "text"))
