"""A Merkle manifest of a dataset: a digest of every row, a tree of digests by group, a tree over the groups, and proofs.

Leaves are range-sorted, so that every partition holds consecutive leaves of a few groups; what lies before a
partition's leaves of a group is the sum of the counts of the partitions before it. With these offsets each
partition builds the subtrees that are whole and aligned within it, up to a band of levels. What is left are ragged
nodes at its edges, few of them: these are shuffled by the coordinate of the node that they meet below, and finished
there, band after band. A second pass over the partitions puts the paths of leaf, ragged node and group together.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType
from pyspark.sql.window import Window

from .shared import cut

#: Nodes that become one; leaves of a partition; levels that are finished together (3 to the 9th leaves: 19,683).
FANOUT, PART, BAND = 3, 50_000, 9


def framed(value: Column) -> Column:
    """``-`` for null, else the number of the value's UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """The digest of a row: lower-case hexadecimal SHA-256 of its framed values."""
    return F.sha2(F.concat(*map(framed, values)), 256)


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height(n: int, fanout: int) -> int:
    """Levels above ``n`` leaves: how often runs of ``fanout`` nodes become one until one is left."""
    h = 0
    while n > 1:
        n, h = -(-n // fanout), h + 1
    return h


def climb(first: int, hashes: list[str], n: int, fanout: int, most: int) -> list[tuple[int, list[str]]]:
    """The nodes that leaves ``first``, ``first`` + 1, ... of ``n`` settle by themselves: (first place, digests) of each level up to ``most``."""
    levels = [(first, hashes)]
    while n > 1 and len(levels) <= most:
        a, some = levels[-1]
        b = a + len(some)
        start, end = -(-a // fanout), -(-n // fanout) if b == n else b // fanout
        if end <= start:
            break
        levels.append((start, [digest(some[p * fanout - a : min(p * fanout + fanout, n) - a]) for p in range(start, end)]))
        n = -(-n // fanout)
    return levels


def _ragged(levels: list[tuple[int, list[str]]], fanout: int) -> list[tuple[int, int, str]]:
    """(level, place, digest) of the nodes of ``climb`` without a parent there."""
    out = []
    for level, (a, some) in enumerate(levels):
        start, above = levels[level + 1] if level + 1 < len(levels) else (0, [])
        out += [(level, i, h) for i, h in enumerate(some, a) if not start <= i // fanout < start + len(above)]
    return out


def _siblings(i: int, of: list[str], a: int, fanout: int) -> tuple[str, str]:
    """What stands before and after node ``i`` in its run, among consecutive nodes from ``a`` on that hold the run."""
    start = i - i % fanout
    return "".join(of[start - a : i - a]), "".join(of[i + 1 - a : start + fanout - a])


@dataclass
class Tree:
    """sorted: (part, pos, leaf, row); spans: (part, g, first, count, start, n) of each partition's leaves of a group; above:
    (part, first, level, idx, before, after), the ragged nodes' paths to the roots; roots: (g, root)."""

    sorted: DataFrame
    spans: DataFrame
    above: DataFrame
    roots: DataFrame
    fanout: int
    band: int


_NODE = "g string, n bigint, part int, first bigint, level int, idx bigint, hash string"
_PATH = "g string, n bigint, part int, first bigint, level int, idx bigint, top_level int, top_idx bigint, hash string, before array<string>, after array<string>"
_TEXTS = pa.list_(pa.string())


def grow(leaves: DataFrame, order: list[str], fanout: int = FANOUT, part: int = PART, band: int = BAND) -> Tree:
    """The trees of ``leaves`` (g string, order columns, leaf, row): one for each g, whose leaves ascend by ``order``, then leaf.

    Nulls come first. Equal leaves may stand in any order: the tree is the same.
    """
    spark = leaves.sparkSession
    thin = cut(leaves.select("g", *order, "leaf", "row", F.monotonically_increasing_id().alias("_at")))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-thin.count() // part))
    keys = ["g", *order, "leaf", "_at"]
    placed = thin.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    placed = cut(placed.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos"), "g", "leaf", "row"))
    counts = placed.groupBy("part", "g").agg(F.count("*").alias("count"), F.min("pos").alias("first"))
    whole = Window.partitionBy("g")  # a row a partition
    start = F.sum("count").over(whole.orderBy("part")) - F.col("count")
    spans = cut(counts.select("part", "g", "first", "count", start.alias("start"), F.sum("count").over(whole).alias("n")))

    def build(rows: pa.Table, own: pa.Table) -> pa.Table:
        out, at, hashes = [], 0, rows.sort_by("pos").column("leaf").to_pylist()
        for s in own.sort_by("first").to_pylist():
            levels = climb(s["start"], hashes[at : at + s["count"]], s["n"], fanout, band)
            out += [(s["g"], s["n"], s["part"], s["first"], *x) for x in _ragged(levels, fanout)]
            at += s["count"]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 7, (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.string()))], ["g", "n", "part", "first", "level", "idx", "hash"])

    nodes = cut(placed.select("part", "pos", "leaf").groupBy("part").cogroup(spans.groupBy("part")).applyInArrow(build, _NODE))
    most = spans.agg(F.max("n")).first()[0] or 0
    above = roots = tops = None
    high = 0
    while above is None or fanout**high < most:
        high += band
        made = cut(_finished(nodes if above is None else tops, high, fanout))
        tops = made.where("hash is not null").select(*[x.split()[0] for x in _NODE.split(", ")])
        done = tops.where(F.col("n") <= fanout**high).select("g", F.col("hash").alias("root"))
        roots = done if roots is None else roots.union(done)
        tops = tops.where(F.col("n") > fanout**high)
        paths = made.where("hash is null")
        if above is None:
            above = paths.drop("n", "hash")
        else:
            more = paths.select(F.col("g").alias("_g"), F.col("level").alias("_l"), F.col("idx").alias("_i"), F.col("top_level").alias("_tl"), F.col("top_idx").alias("_ti"), F.col("before").alias("_b"), F.col("after").alias("_a"))
            same = F.col("g").eqNullSafe(F.col("_g")) & (F.col("top_level") == F.col("_l")) & (F.col("top_idx") == F.col("_i"))
            longer = above.join(more, same, "left")
            none = F.array().cast("array<string>")
            above = longer.select(
                "g", "part", "first", "level", "idx", F.coalesce("_tl", "top_level").alias("top_level"), F.coalesce("_ti", "top_idx").alias("top_idx"),
                F.concat("before", F.coalesce("_b", none)).alias("before"), F.concat("after", F.coalesce("_a", none)).alias("after"),
            )
    return Tree(placed, spans, above.select("part", "first", "level", "idx", "before", "after"), cut(roots), fanout, band)


def _finished(nodes: DataFrame, high: int, fanout: int) -> DataFrame:
    """_PATH rows: the nodes' paths up to level ``high`` or the root, and with a ``hash`` what stands there.

    nodes: those that cover all that lies below them. A group are the nodes below one node of level ``high``.
    """

    def one(rows: pa.Table) -> pa.Table:
        given = rows.to_pylist()
        n = given[0]["n"]
        top = min(high, height(n, fanout))
        known: dict[tuple[int, int], str] = {(r["level"], r["idx"]): r["hash"] for r in given}
        now: dict[int, str] = {}
        for level in range(min(r["level"] for r in given), top + 1):
            now |= {i: h for (l, i), h in known.items() if l == level}
            known |= {(level, i): h for i, h in now.items()}
            if level < top:
                runs: dict[int, list[str]] = {}
                for i in sorted(now):
                    runs.setdefault(i // fanout, []).append(now[i])
                now = {p: digest(some) for p, some in runs.items()}
        out = []
        for r in given:
            before, after, i = [], [], r["idx"]
            for level in range(r["level"], top):
                start = i - i % fanout
                before.append("".join(known[level, j] for j in range(start, i)))
                after.append("".join(known[level, j] for j in range(i + 1, start + fanout) if (level, j) in known))
                i //= fanout
            out.append((r["g"], n, r["part"], r["first"], r["level"], r["idx"], top, i, None, before, after))
        ((i, h),) = now.items()
        out.append((given[0]["g"], n, None, None, top, i, top, i, h, None, None))
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.string(), _TEXTS, _TEXTS)
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [x.split()[0] for x in _PATH.split(", ")])

    below = F.expr(f"idx div cast(pow({fanout}, {high} - level) as bigint)").alias("below")
    return nodes.select(*[x.split()[0] for x in _NODE.split(", ")], below).groupBy("g", "below").applyInArrow(one, _PATH)


def paths(tree: Tree, over: DataFrame | None = None) -> DataFrame:
    """(row, leaf, before, after, subroot, root) of each leaf: its siblings, level by level, up to the root of its group.

    over: (g, before, after, root), the groups' own paths in a tree over them, which the leaves' paths then go on with.
    """
    spans, none = tree.spans, F.array().cast("array<string>")
    tops = tree.roots.withColumnRenamed("root", "subroot")
    if over is None:
        tops = tops.select("g", "subroot", F.col("subroot").alias("root"), none.alias("before"), none.alias("after"))
    else:
        tops = tops.join(over.withColumnRenamed("g", "_g"), F.col("g").eqNullSafe(F.col("_g"))).drop("_g")
    tops = tops.withColumnRenamed("g", "_g")
    spans = spans.join(tops, F.col("g").eqNullSafe(F.col("_g"))).select("part", "first", "count", "start", "n", F.lit(-1).alias("level"), F.lit(0).cast("long").alias("idx"), "before", "after", "subroot", "root")
    no = lambda kind, name: F.lit(None).cast(kind).alias(name)
    nodes = tree.above.select("part", "first", *[no("bigint", c) for c in ("count", "start", "n")], "level", "idx", "before", "after", no("string", "subroot"), no("string", "root"))
    fanout, band = tree.fanout, tree.band

    def prove(rows: pa.Table, told: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        hashes, told = rows.column("leaf").to_pylist(), told.to_pylist()
        up = {(r["first"], r["level"], r["idx"]): (r["before"], r["after"]) for r in told if r["level"] >= 0}
        before, after, subroot, root = [], [], [], []
        for s in sorted((r for r in told if r["level"] < 0), key=lambda r: r["first"]):
            levels = climb(s["start"], hashes[len(before) : len(before) + s["count"]], s["n"], fanout, band)
            found: dict[tuple[int, int], tuple[list[str], list[str]]] = {}

            def path(level: int, i: int) -> tuple[list[str], list[str]]:
                """Of a node's siblings up to the root over all, remembered by node."""
                if (level, i) not in found:
                    at = (s["first"], level, i)
                    if at in up:
                        found[level, i] = up[at][0] + s["before"], up[at][1] + s["after"]
                    else:
                        a, some = levels[level]
                        left, right = _siblings(i, some, a, fanout)
                        b, c = path(level + 1, i // fanout)
                        found[level, i] = [left, *b], [right, *c]
                return found[level, i]

            for i in range(s["start"], s["start"] + s["count"]):
                b, c = path(0, i)
                before.append(b)
                after.append(c)
            subroot += [s["subroot"]] * s["count"]
            root += [s["root"]] * s["count"]
        made = [pa.array(before, _TEXTS), pa.array(after, _TEXTS), pa.array(subroot, pa.string()), pa.array(root, pa.string())]
        return pa.table([rows.column("row"), rows.column("leaf"), *made], ["row", "leaf", "before", "after", "subroot", "root"])

    rows = tree.sorted.select("part", "pos", "leaf", "row")
    kind = StructType([rows.schema["row"], rows.schema["leaf"], *[StructField(c, ArrayType(StringType())) for c in ("before", "after")], *[StructField(c, StringType()) for c in ("subroot", "root")]])
    return rows.groupBy("part").cogroup(spans.union(nodes).groupBy("part")).applyInArrow(prove, kind)


def prove(leaves: DataFrame, order: list[str], fanout: int = FANOUT, part: int = PART, band: int = BAND) -> DataFrame:
    """(row, leaf, before, after, subroot, root) for every row of ``leaves`` (g, order columns, leaf, row).

    Leaves of one g ascend by ``order`` (nulls first), equal ones by their digests. Runs of ``fanout`` consecutive
    nodes, the last perhaps shorter, become the digest of their digests until one is left, the subroot; subroots,
    by g (null first, by bytes), likewise give the root. before and after: for each level up to the root what stands in
    a node's run before and after it. ``row`` is carried along. Rows that repeat are leaves of their own; null values
    count as a frame of their own (see framed()); an empty table gives an empty result. Jobs for the nodes run when this
    is called.
    """
    tree = grow(leaves, order, fanout, part, band)
    roots = tree.roots.select(F.lit(None).cast("string").alias("g"), F.col("g").alias("name"), F.col("root").alias("leaf"), F.struct("g").alias("row"))
    over = paths(grow(roots, ["name"], fanout, part, band))
    return paths(tree, cut(over.select("row.g", "before", "after", "root")))


def folded(leaf_: Column, before: Column, after: Column) -> Column:
    """The root that a leaf's digest and its siblings lead to."""
    both = F.zip_with(before, after, lambda b, a: F.struct(b.alias("b"), a.alias("a")))
    return F.aggregate(both, leaf_, lambda h, x: F.sha2(F.concat(x["b"], h, x["a"]), 256))


def document_leaves(docs: DataFrame) -> DataFrame:
    """Leaves of ``docs`` (doc_id, source, lang, n_chars, text) by source and doc_id; a column that the table lacks counts as null.

    row: doc_id, and ``tampered``, the leaf without the line feeds in ``text`` where 2 divides the CRC-32 of the decimal
    doc_id, else the leaf. Columns besides these five are not covered by a leaf.
    """
    of = {c: F.col(c) if c in docs.columns else F.lit(None).cast("string") for c in ("doc_id", "source", "lang", "n_chars", "text")}
    own = docs.select(*[v.alias(k) for k, v in of.items()])
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    first, plain = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], F.replace("text", F.lit("\n"), F.lit(""))
    changed = even & F.contains("text", F.lit("\n"))
    own = own.withColumn("leaf", leaf(*first, F.col("text"))).withColumn("tampered", F.when(F.coalesce(changed, F.lit(False)), leaf(*first, plain)).otherwise(F.col("leaf")))
    return own.select(F.col("source").cast("string").alias("g"), F.col("doc_id").alias("id"), "leaf", F.struct("doc_id", "tampered").alias("row"))


def verified(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): see document_leaves() and prove()."""
    proved = prove(document_leaves(docs), ["id"])
    proof = F.sha2(F.array_join(F.zip_with("before", "after", lambda b, a: F.concat(b, a)), ""), 256)
    out = proved.select("row.doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded(F.col("row.tampered"), F.col("before"), F.col("after")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle(levels: int = 12, upper: int = 8) -> str:
    """DuckDB SQL for verified() of groups of 3 to the power of ``levels`` leaves at most, and 3 to the power of ``upper`` groups."""
    frame = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}::VARCHAR) || ':' || {x}::VARCHAR END"
    digest_of = lambda text: "sha256(" + " || ".join(map(frame, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    key = "(doc_id::VARCHAR)"
    octets = f"list_transform(range(1, strlen({key}) + 1), lambda i: ord({key}[i]))"
    crc = f"list_reduce(list_concat([4294967295], {octets}), lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384)))"
    parts = [f"""leaves AS MATERIALIZED (
  SELECT doc_id, source AS g, {digest_of("text")} AS leaf, CASE WHEN xor({crc}, 4294967295) % 2 = 0 THEN {digest_of("replace(text, chr(10), '')")} ELSE {digest_of("text")} END AS f FROM documents
), d0 AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n, '' AS proof FROM leaves
), n0 AS MATERIALIZED (SELECT g, i, n, leaf AS h FROM d0)"""]  # fmt: skip

    def climbed(nodes: str, rows: str, steps: int) -> None:
        """Levels of nodes (g, i, n, h), and of rows (..., g, i, n, f, proof) below them."""
        for k in range(steps):
            parts.append(f"""{nodes}runs{k} AS MATERIALIZED (SELECT g, i // 3 AS p, any_value(n) AS n, list(h ORDER BY i) AS hs FROM {nodes}{k} GROUP BY g, i // 3
), {nodes}{k + 1} AS MATERIALIZED (SELECT g, p AS i, (n + 2) // 3 AS n, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM {nodes}runs{k}
), {rows}{k + 1} AS MATERIALIZED (
  SELECT d.* EXCLUDE (before, after) REPLACE (d.i // 3 AS i, (d.n + 2) // 3 AS n, CASE WHEN d.n = 1 THEN f ELSE sha256(before || f || after) END AS f, CASE WHEN d.n = 1 THEN proof ELSE proof || before || after END AS proof)
  FROM (SELECT d.*, array_to_string(r.hs[:d.i % 3], '') AS before, array_to_string(r.hs[d.i % 3 + 2:], '') AS after FROM {rows}{k} d JOIN {nodes}runs{k} r ON r.g IS NOT DISTINCT FROM d.g AND r.p = d.i // 3) d)""")  # fmt: skip

    climbed("n", "d", levels)
    parts.append(f"""t0 AS MATERIALIZED (SELECT 0 AS g, g AS name, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, count(*) OVER () AS n, h FROM n{levels}
), e0 AS MATERIALIZED (SELECT d.doc_id, d.leaf, t.h AS subroot, 0 AS g, t.i, t.n, d.f, d.proof FROM d{levels} d JOIN t0 t ON t.name IS NOT DISTINCT FROM d.g)""")
    climbed("t", "e", upper)
    return f"""WITH {", ".join(parts)}
SELECT e.doc_id, leaf, subroot, t.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = t.h AS verified FROM e{upper} e, t{upper} t"""
