"""Approximate nearest neighbours by largest inner product, with shifted space-filling curves.

The largest inner product is made the least distance: one coordinate is added that completes each candidate to the greatest
norm, while a query is scaled to that norm and has 0 there. Both are projected onto a few orthogonal directions, shifted, and
ordered by the Hilbert curve through the projected space, once for each of ``CURVES`` projections and shifts. Spark
range-partitions each order by key, which gives every row its place on every curve, and every query the place among them where
its own key belongs. A query's candidates are the rows within a window of so many places before and after that on each curve;
the windows of all curves are merged, and exact inner products of the original vectors in double precision rank them.

The length of the window, in rows, and the number of curves are measured on the table itself: the exact neighbours of
``PROBES`` queries (a bounded number, against all rows) are found in one scan, and the cheapest pair is taken whose windows
hold the target recall of them. On data without low-dimensional structure no order keeps neighbours together: where windows
would come to more rows than there are, one curve with a window of all rows is taken, which is an exact search.

Curves are cut into blocks of places, ``ROWS`` at most and a part of the table where windows are in use. A (curve, block, part) is a group: its rows, and those queries whose window
touches the block, dealt into parts of about ``QUERIES``. So no task holds more than that, whatever the keys: equal vectors
share a key, but not a place.

Vectors that are null or zero, of another length than most, or hold null or non-finite components take no part. Repeated
vectors are rows of their own, ties go to the smaller vec_id. Rows of one vec_id are one query, and one candidate with its
best score, which takes one place of a list. No row is a candidate of its own id. Scores that are not a number (by overflow) are left out. Empty tables give
empty results; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

NEIGHBOURS = 20
CURVES = 6
DIMENSIONS = 8
BITS = 6
SAMPLE = 4096
PROBES = 200
TARGET = 0.95
ROWS = 16_384
#: Blocks of a curve at least, where windows are in use.
BLOCKS = 64
QUERIES = 8_192


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert keys (uint64) of integer points below 2 ** bits, by Skilling's transposition."""
    x = points.T.astype(np.uint64).copy()
    n = len(x)
    top = np.uint64(1 << (bits - 1))
    q = top
    while q > 1:
        p = q - np.uint64(1)
        for i in range(n):
            on = (x[i] & q) != 0
            t = np.where(on, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= np.uint64(1)
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - np.uint64(1)), t)
        q >>= np.uint64(1)
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << np.uint64(1)) | ((x[i] >> np.uint64(b)) & np.uint64(1))
    return key


def matrix(lists) -> np.ndarray:
    """Vectors of a list column as rows of doubles."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


class Curves:
    """Projections and shifts; everything a task needs to place a vector."""

    def __init__(self, sample: np.ndarray, largest: float, greatest: float, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.largest = largest  # of all components: scaled vectors stay finite
        self.greatest = greatest  # norm of all scaled vectors
        full = self.completed(sample)
        self.middle = full.mean(axis=0)
        d = full.shape[1]
        _, _, axes = np.linalg.svd(full - self.middle, full_matrices=False)
        self.axes, self.low, self.step = [], [], []
        for c in range(CURVES):
            if c == 0:  # the directions of largest spread first, then random ones
                a = axes[: min(DIMENSIONS, d)]
            else:
                a = np.linalg.qr(rng.normal(size=(d, min(DIMENSIONS, d))))[0].T
            at = (full - self.middle) @ a.T
            low, high = at.min(axis=0), at.max(axis=0)
            spread = np.maximum(high - low, 1e-12)
            self.axes.append(a)
            self.low.append(low - rng.uniform(0, 0.25, len(low)) * spread)
            self.step.append(spread * 1.25)

    def completed(self, x: np.ndarray) -> np.ndarray:
        x = x / self.largest
        rest = np.sqrt(np.maximum(self.greatest**2 - (x * x).sum(axis=1), 0))
        return np.hstack([x, rest[:, None]])

    def asking(self, x: np.ndarray) -> np.ndarray:
        """Queries: of the greatest norm, and 0 in the added coordinate."""
        x = x / self.largest
        x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)  # small ones do not vanish when squared
        x = x * (self.greatest / np.linalg.norm(x, axis=1, keepdims=True))
        return np.hstack([x, np.zeros((len(x), 1))])

    def keys(self, full: np.ndarray, curve: int) -> np.ndarray:
        at = (full - self.middle) @ self.axes[curve].T
        cell = np.floor((at - self.low[curve]) / self.step[curve] * (1 << BITS))
        return hilbert(np.clip(cell, 0, (1 << BITS) - 1))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the vectors that take part."""
    e = F.col("embedding")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e).filter(e.isNotNull() & F.col("vec_id").isNotNull() & finite & F.exists(e, lambda v: v != 0))


def fit(vectors: DataFrame, sample: int = SAMPLE) -> Curves | None:
    """Curves fitted on a bounded sample of usable vectors; None if there are none."""
    n, largest = vectors.agg(F.count("*"), F.max(F.aggregate("embedding", F.lit(0.0), lambda a, v: F.greatest(a, F.abs(v.cast("double")))))).first()
    if not n:
        return None
    order = F.xxhash64("vec_id", F.lit(5))
    unit = F.pmod(order, F.lit(1 << 30)) / F.lit(float(1 << 30))
    table = vectors.filter(unit < 2 * sample / n).orderBy(order, "vec_id").limit(sample).select("embedding").toArrow()
    if not table.num_rows:
        table = vectors.limit(sample).select("embedding").toArrow()
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + (v.cast("double") / F.lit(float(largest))) ** 2))
    return Curves(matrix(table.column("embedding")), float(largest), float(vectors.agg(F.max(norm)).first()[0]))


def key_maker(curves, every: int):
    """(curve, key, asks, vec_id): each row as a candidate, and once more where it is a query."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = curves.value
        for rows in batches:
            if rows.num_rows:
                x, ids = matrix(rows.column("embedding")), rows.column("vec_id").to_numpy()
                asked = ids % every == 0
                for asks, full, own in ((False, c.completed(x), ids), (True, c.asking(x[asked]), ids[asked])):
                    for k in range(CURVES if len(own) else 0):
                        columns = [pa.array(np.full(len(own), k, np.int32)), pa.array(c.keys(full, k).view(np.int64)), pa.array(np.full(len(own), asks)), pa.array(own)]
                        yield pa.RecordBatch.from_arrays(columns, names=["curve", "key", "asks", "vec_id"])

    return make


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each row of a sorted partition, how many candidates of its curve come before it there."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    before: dict[int, int] = {}
    for rows in batches:
        curve, own = rows.column("curve").to_numpy(), ~rows.column("asks").to_numpy(zero_copy_only=False)
        place = np.empty(len(curve), np.int64)
        for c in np.unique(curve).tolist():
            at = curve == c
            n = before.get(c, 0) + np.cumsum(own[at])
            place[at] = n - own[at]
            before[c] = int(n[-1])
        yield pa.RecordBatch.from_arrays([rows.column("curve"), rows.column("vec_id"), rows.column("asks"), pa.array(np.full(len(curve), part)), pa.array(place)], names=["curve", "vec_id", "asks", "range", "row"])


def places(vectors: DataFrame, curves: Curves, every: int) -> DataFrame:
    """Written table (curve, vec_id, asks, place): a range sort of all curves' keys, counted partition by partition."""
    shared = vectors.sparkSession.sparkContext.broadcast(curves)
    keys = vectors.mapInArrow(key_maker(shared, every), "curve int, key long, asks boolean, vec_id long")
    order = ["curve", "key", "vec_id", "asks"]
    sorted_ = keys.repartitionByRange(*order).sortWithinPartitions(*order).select("curve", "vec_id", "asks")
    sorted_ = common.written(sorted_.mapInArrow(numbered, "curve int, vec_id long, asks boolean, range long, row long"), "nearest-order")
    # A row for each curve and range partition; a partition may hold the end of one curve and the start of the next.
    counts = sorted_.groupBy("curve", "range").agg(F.count_if(~F.col("asks")).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("curve").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = common.small(counts.select("curve", "range", before.alias("shift")))
    return common.written(sorted_.join(starts, ["curve", "range"]).select("curve", "vec_id", "asks", (F.col("row") + F.col("shift")).alias("place")), "nearest-places")


def best_of(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query number, column) of the ``k`` best of each row of ``score``, ties to the smaller id; -inf is no candidate."""
    k = min(k, score.shape[1])
    least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k, None]
    row, column = np.nonzero((score >= least) & (score > -np.inf))
    order = np.lexsort((ids[column], -score[row, column], row))
    row, column = row[order], column[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], column[rank < k]


def scores(q: np.ndarray, qid: np.ndarray, x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of the queries with each id's best row, and the ids in order; -inf where there is none."""
    with np.errstate(all="ignore"):
        out = q @ x.T
    out[np.isnan(out)] = -np.inf
    every, first = np.unique(ids, return_index=True)
    if len(every) < len(ids):
        order = np.argsort(ids, kind="stable")
        out = np.maximum.reduceat(out[:, order], np.searchsorted(ids[order], every), axis=1)
    elif not np.array_equal(every, ids):
        out = out[:, first]
    out[qid[:, None] == every[None, :]] = -np.inf
    return out, every


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def prober(probes, k: int):
    """The best ``k`` of a partition for each of the probes (ids, vectors)."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q = probes.value
        best: pa.Table | None = None
        for rows in batches:
            if rows.num_rows:
                s, ids = scores(q, qid, matrix(rows.column("embedding")), rows.column("vec_id").to_numpy())
                r, c = best_of(s, ids, k)
                new = pa.table([pa.array(qid[r]), pa.array(ids[c]), pa.array(s[r, c])], schema=FOUND)
                best = new if best is None else pa.concat_tables([best, new])
                if best.num_rows > 8 * k * len(qid):
                    best = top(best, k)
        if best is not None:
            yield from top(best, k).to_batches()

    return probe


def top(found: pa.Table, k: int) -> pa.Table:
    """The best ``k`` ids of each query, one row an id."""
    found = found.group_by(["query_id", "vec_id"]).aggregate([("score", "max")]).rename_columns(FOUND.names)
    qid, ids, s = (found.column(c).to_numpy() for c in ("query_id", "vec_id", "score"))
    order = np.lexsort((ids, -s, qid))
    rank = np.arange(len(order)) - np.searchsorted(qid[order], qid[order])
    return found.take(pa.array(order[rank < k])).select(FOUND.names)


def ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def block_rows(n: int) -> int:
    """Places of a block where windows are in use: small beside the table, so that a window is a part of it at any size."""
    return max(1, min(ROWS, -(-n // BLOCKS)))


def window_of(vectors: DataFrame, placed: DataFrame, n: int, every: int, k: int = NEIGHBOURS, target: float = TARGET, probes: int = PROBES) -> tuple[int, int]:
    """(curves, rows before and after): the cheapest windows that hold the target recall of the probes' exact neighbours."""
    order = F.xxhash64("vec_id", F.lit(9))
    asked = vectors.filter(F.pmod("vec_id", F.lit(every)) == 0).orderBy(order, "vec_id").limit(probes).toArrow()
    if not asked.num_rows:
        return 1, n
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast((asked.column("vec_id").to_numpy(), matrix(asked.column("embedding"))))
    true = ranked(vectors.mapInArrow(prober(shared, k), "query_id long, vec_id long, score double"), k).select("query_id", "vec_id")
    true = F.broadcast(common.written(true, "nearest-probes"))  # at most probes x k rows
    theirs = placed.filter("not asks").join(true, "vec_id").select("curve", "query_id", "vec_id", "place")
    own = placed.filter("asks").join(F.broadcast(true.select(F.col("query_id").alias("vec_id")).distinct()), "vec_id").select("curve", F.col("vec_id").alias("query_id"), F.col("place").alias("own"))
    gaps = theirs.join(F.broadcast(own), ["curve", "query_id"]).groupBy("query_id", "vec_id").pivot("curve", list(range(CURVES))).agg(F.min(F.abs(F.col("place") - F.col("own")))).toPandas()
    if not len(gaps):
        return 1, n
    gap = np.minimum.accumulate(gaps[[str(c) for c in range(CURVES)]].to_numpy(np.float64), axis=1)
    reach = np.quantile(gap, target, axis=0, method="higher").astype(np.int64)
    cost = [(min(2 * int(r) + block_rows(n), n) * (c + 1), c + 1, int(r)) for c, r in enumerate(reach)]  # blocks are taken whole
    best = min(cost)
    return best[1:] if best[0] < n else (1, n)


def searcher(k: int):
    def search(index: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if index.num_rows and queries.num_rows:
            x, ids = matrix(index.column("embedding")), index.column("vec_id").to_numpy()
            q, qid = matrix(queries.column("embedding")), queries.column("vec_id").to_numpy()
            for at in range(0, len(qid), 256):
                s, known = scores(q[at : at + 256], qid[at : at + 256], x, ids)
                r, c = best_of(s, known, k)
                out.append(pa.table([pa.array(qid[at + r]), pa.array(known[c]), pa.array(s[r, c])], schema=FOUND))
        return pa.concat_tables(out) if out else FOUND.empty_table()

    return search


def search(vectors: DataFrame, every: int = 20, k: int = NEIGHBOURS, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector whose id ``every`` divides, its ``k`` nearest found among all others."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    # One length: the most frequent one takes part.
    length = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if length is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n = length["count"]
    rows = rows.filter(F.size("embedding") == length["d"])
    placed = places(rows, fit(rows), every)
    curves, reach = window_of(rows, placed, n, every, k, target)
    # All vectors meet their places once a curve in use.
    at = common.written(placed.filter(F.col("curve") < curves).join(rows, "vec_id"), "nearest-rows")
    asked = at.filter("asks")
    if reach >= n:
        return ranked(met(at, asked, n, n, ROWS, every, k), k)
    found = common.written(met(at, asked, n, reach, block_rows(n), every, k), "nearest-found")
    # Windows in which rows of a few ids crowd out the others hold too few: these queries are asked against all rows.
    need = min(k, rows.select("vec_id").distinct().count() - 1)
    enough = found.groupBy(F.col("query_id").alias("vec_id")).count().filter(F.col("count") >= need)
    short = common.written(asked.filter("curve = 0").join(enough, "vec_id", "left_anti"), "nearest-short")
    if not short.isEmpty():
        found = found.unionByName(met(at.filter("curve = 0"), short, n, n, ROWS, every, k)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return ranked(found, k)


def met(at: DataFrame, asked: DataFrame, n: int, reach: int, size: int, every: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): the best of every block of ``size`` places for the queries whose window touches it."""
    block = lambda place: F.floor(place / size)
    touched = F.sequence(F.greatest(F.lit(0), block(F.col("place") - reach)), F.least(F.lit((n - 1) // size), block(F.col("place") + reach)))
    parts = max(1, round(n / every * min(1.0, (2 * reach + size) / n) / QUERIES))
    index = at.filter("not asks").withColumn("block", block(F.col("place"))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    queries = asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")).withColumn("block", F.explode(touched))
    keys = ["curve", "block", "part"]
    found = index.select(*keys, "vec_id", "embedding").groupBy(*keys).cogroup(queries.select(*keys, "vec_id", "embedding").groupBy(*keys)).applyInArrow(searcher(k), "query_id long, vec_id long, score double")
    # Rows met on several curves, or under a repeated id, count once; one exchange serves both groupings.
    return found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))


def op8_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "embeddings"))
