"""Embedding near-duplicates by collision-counting projections.

Vectors are projected onto many random lines. A table orders the vectors by a compound of a few lead
projections cut into randomly shifted cells of one width. Each run of equal codes is sorted along a line of its
own, every vector opens a window around its own place there, and for the vectors within it the windows of the
other lines in which a pair meets are counted. Pairs with a count that near pairs reach (by the law of pairs
at exactly the threshold, not by a sample) are verified in double precision. Whether shifted cells part a pair depends on
its distance only, not on where the mass of the vectors lies, so the number of tables that the wished recall
needs holds for the pairs of any group. Width and number of leads are those of least work for the distances of
a bounded sample, which decides on nothing else; a small table needs no leads and is one run.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, cut, forest, share01

#: Bounded sample for the distances that the work is planned by.
SAMPLE = 1000
#: Compared pairs that cost as much as sending a vector to one table; rows of one side of a compared pair of chunks, of a block.
SENT, CHUNK, BLOCK = 1024, 4096, 256
#: Runs of fewer rows are compared together; pairs of them at once.
SMALL, AT_ONCE = 64, 1 << 18
#: Lines whose windows are counted; whole numbers that a window's half width is counted in.
WINDOWS, WIDE = 16, 1000
#: Vectors and lines are rounded to 1 / GRID for the cells: sums of their products are exact, in any order.
GRID = 1 << 20


def _lines(seed: int, table: int, k: int, rows: int, dim: int) -> np.ndarray:
    """The first ``rows`` coordinates of ``k`` lines in ``dim`` dimensions."""
    return np.random.default_rng((seed, table, k)).standard_normal((rows, k)) / math.sqrt(dim)


def _units(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that no square is lost below or above the range of doubles."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True, initial=0)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _matrix(column) -> tuple[np.ndarray, np.ndarray]:
    """(rows padded with zeros, true lengths) of a column of lists of numbers without nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = flat
    return out, sizes


def together(distance: float, width: float) -> float:
    """The probability that a shifted cell of ``width`` on a random line holds both of two vectors, lines as many as dimensions."""
    r = width / max(distance, 1e-9)
    return math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))


def _plan(sample: np.ndarray, n: int, threshold: float, recall: float) -> tuple[int, int, float]:
    """Leads, tables and cell width (in units of the lines) of least work; every choice has the recall.

    The work of a row in a table is that of sending it, and of the rows below the threshold that share its cells;
    without leads all rows share the one cell of one table.
    """
    cosines = (sample @ sample.T)[np.triu_indices(len(sample), 1)]
    share, edges = np.histogram(cosines[cosines < threshold], 200, (-1, threshold))
    share = share / max(1, len(cosines))
    apart = np.sqrt(2 - 2 * np.minimum((edges[:-1] + edges[1:]) / 2, threshold))
    at = math.sqrt(2 - 2 * threshold)
    best = (SENT + n, 0, 1, 1.0)
    for times in (2, 3, 4, 6, 8, 11, 16, 23):
        far = np.array([together(d, times * at) for d in apart])
        for leads in range(1, 41):
            hit = together(at, times * at) ** leads
            tables = max(1, math.ceil(math.log(1 - recall) / math.log1p(-min(hit, 0.999999))))
            work = tables * (SENT + n * float((share * far**leads).sum()))
            best = min(best, (work, leads, tables, times * at))
    return best[1:]


def windows(dim: int, threshold: float, recall: float) -> tuple[float, int]:
    """(half width of a window, least count) for pairs at exactly the threshold, whatever the vectors.

    Along a random line such a pair is apart by a normal deviate of known size: a window holds it with a known probability,
    and the count over independent lines is binomial. The recall is that over the draw of the lines.
    """
    normal = NormalDist()
    half = normal.inv_cdf(0.98)
    holds = 2 * normal.cdf(half * (WIDE - 1) / WIDE) - 1  # places are whole numbers: a pair at the very edge may round out
    below, least = 0.0, 0
    while least < WINDOWS and (below := below + math.comb(WINDOWS, least) * holds**least * (1 - holds) ** (WINDOWS - least)) <= 1 - recall:
        least += 1
    return half * math.sqrt((2 - 2 * threshold) / dim), max(1, least)


def calibrate(sample: np.ndarray, n: int, threshold: float, recall: float, seed: int) -> dict:
    """Lead projections, tables, cells, window width and least count for ``n`` vectors like ``sample``; it decides on the work only."""
    rng, dim = np.random.default_rng(seed), sample.shape[1]
    recall = 1 - (1 - recall) / 2  # a half of what may be missed for each of leads and windows
    leads, tables, cell = _plan(sample, n, threshold, recall)
    fit = {"leads": leads, "tables": tables, "cell": cell / math.sqrt(dim), "shifts": rng.random((tables, leads)), "seed": seed, "dim": dim}
    fit["width"], fit["least"] = windows(dim, threshold, recall)
    # The place along the first line is off by 4.5 deviations in 7 of a million pairs.
    fit["reach"] = math.ceil(4.5 * math.sqrt((2 - 2 * threshold) / dim) / fit["width"] * WIDE)
    return fit


def places(unit: np.ndarray, fit: dict) -> np.ndarray:
    """Where vectors lie on the window lines, in whole numbers of which a half window has WIDE; the first line is the one to sort by."""
    on = unit @ _lines(fit["seed"], 1 << 20, WINDOWS + 1, unit.shape[1], fit["dim"])
    return np.clip(np.rint(on / fit["width"] * WIDE), -16_000, 16_000).astype(np.int16)


def lead_codes(unit: np.ndarray, sizes: np.ndarray, fit: dict, tables: int) -> np.ndarray:
    """A code for each row and table: rows of one length with the same cells on all leads of a table have the same one."""
    factors = np.random.default_rng((fit["seed"], 1 << 21)).integers(1 << 62, size=fit["leads"] + 1) * 2 + 1
    out = np.empty((len(unit), tables), np.int64)
    whole = np.rint(unit * GRID)
    for t in range(tables):
        lines = np.rint(_lines(fit["seed"], t, fit["leads"], unit.shape[1], fit["dim"]) * GRID)
        cells = np.floor(whole @ lines / (fit["cell"] * GRID * GRID) + fit["shifts"][t]).astype(np.int64)
        out[:, t] = (cells * factors[:-1]).sum(1) + sizes * factors[-1]
    return out


def collisions(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many columns b's rows lie in the windows centred on a's rows, per pair."""
    count = np.zeros((len(a), len(b)), np.int8)
    for k in range(a.shape[1]):
        away = a[:, k, None] - b[None, :, k]
        count += np.abs(away, out=away) <= WIDE
    return count


class Rows:
    """Whole runs of vectors, and what their pairs add up to: rows linked with each row, smallest row that links reach."""

    def __init__(self, unit: np.ndarray, sizes: np.ndarray, weight: np.ndarray, table: np.ndarray, fit: dict, threshold: float) -> None:
        self.unit, self.sizes, self.weight, self.table, self.fit, self.threshold = unit, sizes, weight, table, fit, threshold
        self.on = places(unit, fit)
        self.linked, self.root = np.zeros(len(unit), np.int64), np.arange(len(unit))

    def small(self, starts: np.ndarray, ends: np.ndarray) -> None:
        """All pairs of rows of each short run, counted together."""
        rows = np.repeat(starts, ends - starts)
        rows += np.arange(len(rows)) - np.repeat(np.cumsum(ends - starts) - (ends - starts), ends - starts)
        later = np.repeat(ends, ends - starts) - rows - 1
        upto = np.cumsum(later)
        for k in range(0, int(upto[-1]) if len(upto) else 0, AT_ONCE):
            pair = np.arange(k, min(k + AT_ONCE, int(upto[-1])))
            at = np.searchsorted(upto, pair, "right")
            p = rows[at]
            q = p + 1 + pair - (upto[at] - later[at])
            met = (np.abs(self.on[p, 1:] - self.on[q, 1:]) <= WIDE).sum(1, dtype=np.int8) >= self.fit["least"]
            self.settle(p[met], q[met])

    def large(self, a: np.ndarray, b: np.ndarray | None) -> None:
        """Pairs of rows ``a`` and ``b`` (None: pairs of a), both sorted along the first line, block by block with what its windows reach."""
        own, on = b is None, self.on
        a = a[np.argsort(on[a, 0], kind="stable")]
        b = a if own else b[np.argsort(on[b, 0], kind="stable")]
        along = on[b, 0].astype(np.int32)
        for s in range(0, len(a), BLOCK):
            rows = a[s : s + BLOCK]
            first = s if own else int(np.searchsorted(along, int(on[rows[0], 0]) - self.fit["reach"], "left"))
            last = int(np.searchsorted(along, int(on[rows[-1], 0]) + self.fit["reach"], "right"))
            for t in range(first, last, CHUNK):
                others = b[t : min(last, t + CHUNK)]
                met = collisions(on[rows, 1:], on[others, 1:]) >= self.fit["least"]
                if own:
                    met &= np.arange(s, s + len(rows))[:, None] < np.arange(t, t + len(others))[None, :]
                p, q = np.nonzero(met)
                dense = 8 * len(p) > met.size
                self.settle(rows[p], others[q], (self.unit[rows] @ self.unit[others].T)[p, q] if dense else None)

    def settle(self, p: np.ndarray, q: np.ndarray, cosine: np.ndarray | None = None) -> None:
        """Verify pairs, join what they link, and count those that share no cell of an earlier table (they were counted there)."""
        if cosine is None:
            cosine = np.concatenate([np.zeros(0), *((self.unit[p[k : k + 8192]] * self.unit[q[k : k + 8192]]).sum(1) for k in range(0, len(p), 8192))])
        p, q = p[cosine >= self.threshold], q[cosine >= self.threshold]
        if not len(p):
            return
        n, root = len(self.root), self.root
        apart = root[p] != root[q]
        if apart.any():
            self.root = forest(n, root[p[apart]], root[q[apart]])[root]
        tables = int(self.table[p].max())
        rows = np.flatnonzero(np.bincount(p, minlength=n) + np.bincount(q, minlength=n))
        codes = lead_codes(self.unit[rows], self.sizes[rows], self.fit, tables)
        at = np.zeros(n, np.int64)
        at[rows] = np.arange(len(rows))
        for t in range(tables):
            new = (codes[at[p], t] != codes[at[q], t]) | (t >= self.table[p])
            p, q = p[new], q[new]
        self.linked += np.bincount(p, self.weight[q], n).astype(np.int64) + np.bincount(q, self.weight[p], n).astype(np.int64)


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.9999, seed: int = 7) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, ...).

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null vec_id,
    link with nothing (component: themselves). Vectors of different lengths never link. Exactly equal
    vectors are one class for the search, so copies cost one row each; repeated rows count as vectors of
    their own. An empty table gives an empty result; other columns are ignored.
    """
    rows = vectors.select("vec_id", F.col("embedding").alias("v"))
    finite = lambda e: F.coalesce((e.cast("double") > float("-inf")) & (e.cast("double") < float("inf")), F.lit(False))  # noqa: E731  NaN is above infinity
    good = F.forall("v", finite) & F.exists("v", lambda e: e != 0) & F.col("vec_id").isNotNull()
    good = F.coalesce(good, F.lit(False))
    rows = rows.withColumn("good", good).withColumn("key", F.when(F.col("good"), F.sha2(F.col("v").cast("string"), 256)))
    classes = cut(rows.where("good").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.any_value("v").alias("v")))
    # Repeated vec_ids with different vectors would share a name: the name of a class is its own.
    classes = classes.select("key", "rep", "n", "v", F.xxhash64("key").alias("cls"))
    total = classes.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    links, roots = _links(classes, total["n"], total["dim"] or 0, threshold, recall, seed)
    found = components(roots, "a", "b")
    of_class = classes.select("key", "cls", "n", "rep").join(links, "cls", "left").join(found, F.col("cls") == F.col("id"), "left")
    of_class = of_class.select("key", "rep", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component_id", "cls").alias("root"))
    least = of_class.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_class = of_class.join(least, "root").select("key", "n_links", "component_id")
    out = rows.select("vec_id", "key").join(of_class, "key", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").cast("long").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _links(classes: DataFrame, n: int, dim: int, threshold: float, recall: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """(cls, linked): rows linked with a class's vector; (a, b): a spanning set of the links."""
    spark = classes.sparkSession
    if n < 2:
        return spark.createDataFrame([], "cls bigint, linked bigint"), spark.createDataFrame([], "a bigint, b bigint")
    sample = classes.where(share01(F.col("cls")) < min(1.0, 0.8 * SAMPLE / n)).select("v").limit(SAMPLE).toArrow()
    sample = sample if len(sample) else classes.select("v").limit(SAMPLE).toArrow()
    x = _matrix(sample.column("v"))[0]
    fit = calibrate(_units(np.pad(x, ((0, 0), (0, dim - x.shape[1])))), n, threshold, recall, seed)

    def codes_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            x, sizes = _matrix(batch)
            codes = lead_codes(_units(x), sizes, fit, fit["tables"])
            yield pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, fit["tables"], dtype=np.int32)), pa.array(codes.reshape(-1)))

    codes_of.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    light = cut(classes.select("cls", F.posexplode(F.arrow_udf(codes_of, "array<bigint>")("v")).alias("tbl", "code")))
    runs = light.groupBy("tbl", "code").agg(F.count("*").alias("size")).where("size > 1")
    light = light.join(runs, ["tbl", "code"]).withColumn("s", F.ceil(F.col("size") / CHUNK).cast("int"))
    light = light.withColumn("c", F.pmod("cls", "s").cast("int"))
    # A run beyond CHUNK rows is compared as pairs of chunks, each a group of its own.
    pairs = F.transform(F.sequence(F.lit(0), F.col("s") - 1), lambda x: F.struct(F.least("c", x).alias("i"), F.greatest("c", x).alias("j")))
    light = light.select("cls", "tbl", "code", "c", F.explode(pairs).alias("p")).select("cls", "tbl", "code", "c", "p.i", "p.j")
    key, kind = ["tbl", "code", "i", "j"], "cls bigint, linked bigint, root bigint"

    def whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs come in sorted batches; the last one of a batch may go on in the next, and is held back."""
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            new = np.zeros(max(0, len(rows) - 1), bool)
            for name in key:
                column = rows.column(name).to_numpy()
                new |= column[1:] != column[:-1]
            starts = np.concatenate(([0], np.flatnonzero(new) + 1))
            yield found(rows.slice(0, starts[-1]), starts)
            held = rows.slice(starts[-1])
        if held is not None:
            yield found(held, np.array([0, len(held)]))

    def found(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        if not len(rows):
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, ["cls", "linked", "root"])
        x, sizes = _matrix(rows.column("v"))
        cls, weight, c, tbl, i, j = (rows.column(k).to_numpy() for k in ("cls", "n", "c", "tbl", "i", "j"))
        some = Rows(_units(x), sizes, weight, tbl, fit, threshold)
        starts, ends = starts[:-1], starts[1:]
        short = (ends - starts < SMALL) & (i[starts] == j[starts])
        some.small(starts[short], ends[short])
        for s, e in zip(starts[~short], ends[~short]):
            a = np.flatnonzero(c[s:e] == i[s]) + s
            some.large(a, None if i[s] == j[s] else np.flatnonzero(c[s:e] == j[s]) + s)
        hit = np.flatnonzero((some.linked > 0) | (some.root != np.arange(len(rows))))
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (cls[hit], some.linked[hit], cls[some.root[hit]])], ["cls", "linked", "root"])

    # The work lies in the pairs, not in the bytes that sizes of partitions are told by: their number is given.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * fit["tables"] * (8 * dim + 32) // (32 << 20))
    full = light.join(classes.select("cls", "n", "v"), "cls").repartition(parts, *key).sortWithinPartitions(*key, "cls")
    made = cut(full.mapInArrow(whole_runs, kind))
    return made.groupBy("cls").agg(F.sum("linked").alias("linked")), made.where("cls <> root").select(F.col("cls").alias("a"), F.col("root").alias("b"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id WHERE l.b > r.root
)
SELECT e.vec_id, coalesce(n, 0) AS n_links, c.component_id, coalesce(e.vec_id = c.component_id, false) AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = e.vec_id
LEFT JOIN (SELECT id, min(root) AS component_id FROM reach GROUP BY id) c ON c.id = e.vec_id
"""
