"""Scoped exact vector retrieval and what follows it: merge, scale, coverage, citations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, norm
from ..sources.shared import written


#: Queries of a block, items of a part and values of either, at most; queries whose products with a part are made at once.
FEW, MANY, VALUES, STEP = 16_384, 8_192, 1 << 20, 256
#: Cosines that are closer than this may change places by rounding to six digits.
SLACK = 2e-6


def nearest_of(k: int):
    """For a part of items and a block of queries: (query_id, item_id, scope, score) of all pairs that may be among a query's best ``k``.

    Products are made by matrices. What is within ``SLACK`` of the k-th best is multiplied again in order, component by component,
    as the exact score is. Of equal scores the ``k`` smallest item_id stay, so that copies of a vector are ``k`` rows at most.
    """

    def rows(t: pa.Table, name: str) -> np.ndarray:
        return t[name].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1).astype(float)

    def find(items: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        if items.num_rows and asked.num_rows:
            items = items.sort_by("item_id")
            x, y = rows(items, "embedding"), rows(asked, "q")
            xn, yn = items["item_norm"].to_numpy(), asked["q_norm"].to_numpy()
            item, query = items["item_id"].to_numpy(), asked["query_id"].to_numpy()
            unit = (x / xn[:, None]).T
            for at in range(0, len(y), STEP):
                own = slice(at, at + STEP)
                near = (y[own] / yn[own, None]) @ unit
                near[query[own, None] == item[None, :]] = -np.inf
                least = np.partition(near, len(item) - k, axis=1)[:, len(item) - k] if len(item) > k else np.full(len(near), -np.inf)
                q, i = np.nonzero((near >= least[:, None] - SLACK) & (near > -np.inf))
                score = np.zeros(len(q))
                for c in range(x.shape[1]):
                    score += x[i, c] * y[at + q, c]
                score /= xn[i] * yn[at + q]
                order = np.lexsort((i, score, q))
                q, i, score = q[order], i[order], score[order]
                place = np.arange(len(q))
                first = np.r_[True, (q[1:] != q[:-1]) | (score[1:] != score[:-1])][: len(q)]
                stays = place - np.maximum.accumulate(np.where(first, place, 0)) < k
                q, i = pa.array(at + q[stays]), pa.array(i[stays])
                found.append(pa.table({"query_id": asked["query_id"].take(q), "item_id": items["item_id"].take(i), "scope": items["scope"].take(i), "score": score[stays]}))
        return pa.concat_tables(found) if found else pa.table({"query_id": asked["query_id"][:0], "item_id": items["item_id"][:0], "scope": items["scope"][:0], "score": pa.array([], pa.float64())})

    return find


def plainly(unit: DataFrame, asked: DataFrame, meets: Column) -> DataFrame:
    """(query_id, item_id, scope, score) of all pairs, by expressions; for vectors that are null, zero, not finite or of another length."""
    score = dot(F.col("embedding"), F.col("q")) / F.nullif(F.col("item_norm") * F.col("q_norm"), F.lit(0.0))
    return unit.join(asked, meets).select("query_id", "item_id", "scope", score.alias("score"))


def scoped_topk(items: DataFrame, queries: DataFrame, k: int, allowed: DataFrame | None = None, own_scope: bool = False) -> DataFrame:
    """The ``k`` items nearest by cosine to each query among those of the allowed scopes.

    items(item_id, scope, embedding), queries(query_id, embedding), allowed(scope). Every query is compared with every item, in
    blocks of queries times parts of items, which are counted first. With ``own_scope`` a query has a scope, and only items of
    it are its own. Ties go to the smaller item_id.
    """
    if allowed is not None:
        items = items.join(allowed.select("scope").distinct(), "scope", "left_semi")
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) if own_scope else F.lit("")
    unit = items.select("item_id", "scope", "embedding", norm(F.col("embedding")).alias("item_norm"), named("scope").alias("_own"))
    asked = queries.select("query_id", *([F.col("scope").alias("q_scope")] if own_scope else []), F.col("embedding").alias("q"), norm(F.col("embedding")).alias("q_norm"), named("scope").alias("_own"))
    sound = lambda n: F.coalesce(F.col(n).between(1e-100, 1e100), F.lit(False))
    kinds = unit.groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n"), F.count_if(sound("item_norm")).alias("good"))
    best, n = kinds.agg(F.max(F.struct("good", "size")), F.sum("n")).first()
    size = (best and best.size) or 0
    good = {c: sound(m) & (F.size(c) == size) & F.col(key).isNotNull() for c, m, key in (("embedding", "item_norm", "item_id"), ("q", "q_norm", "query_id"))}
    meets = (F.col("item_id") != F.col("query_id")) & (F.col("scope").eqNullSafe(F.col("q_scope")) if own_scope else F.lit(True))
    kept = ["query_id", "item_id", "scope", "score"]
    scored = blocked(unit.filter(good["embedding"]), asked.filter(good["q"]), k, size)
    odd = lambda c: ~F.coalesce(good[c], F.lit(False))
    if n and best.good < n:
        scored = scored.unionByName(plainly(unit.filter(odd("embedding")).drop("_own"), asked.drop("_own"), meets).select(*kept))
    if not asked.filter(odd("q")).isEmpty():
        scored = scored.unionByName(plainly(unit.filter(good["embedding"]).drop("_own"), asked.filter(odd("q")).drop("_own"), meets).select(*kept))
    nearest = Window.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), "item_id")
    return scored.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def blocked(unit: DataFrame, asked: DataFrame, k: int, size: int) -> DataFrame:
    """``nearest_of`` for all blocks of queries and parts of items that agree in ``_own``."""
    few, many = (max(1, min(m, VALUES // max(size, 1))) for m in (FEW, MANY))
    cores = unit.sparkSession.sparkContext.defaultParallelism
    # Smaller parts than need be, so that small tables keep all cores busy.
    parts = F.greatest(F.ceil(F.col("n") / many), F.least(F.lit(2 * cores), F.ceil(F.col("n") / 256)))
    counts = unit.groupBy("_own").agg(F.count("*").alias("n")).select("_own", parts.cast("long").alias("_parts")).join(asked.groupBy("_own").agg(F.ceil(F.count("*") / few).cast("long").alias("_blocks")), "_own")
    counts = written(counts, "search-parts")
    groups = counts.agg(F.sum(F.col("_parts") * F.col("_blocks"))).first()[0] or 1
    number = lambda c, m: F.pmod(F.xxhash64(c), F.col(m))
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.col(m) - 1))
    keys = ["_own", "_block", "_part"]
    left = unit.join(counts, "_own").withColumn("_part", number("item_id", "_parts")).withColumn("_block", every("_blocks")).drop("_parts", "_blocks")
    right = asked.join(counts, "_own").withColumn("_block", number("query_id", "_blocks")).withColumn("_part", every("_parts")).drop("_parts", "_blocks", "q_scope")
    left, right = (side.repartition(int(min(2 * groups, 2_000)), *keys).groupBy(*keys) for side in (left, right))
    kind = dict(unit.dtypes) | dict(asked.dtypes)
    return left.cogroup(right).applyInArrow(nearest_of(k), f"query_id {kind['query_id']}, item_id {kind['item_id']}, scope {kind['scope']}, score double")


def merge_ranked(hits: DataFrame, limit: int) -> DataFrame:
    """First-seen union of ranked batches: an item keeps its earliest (query_id, rank) place; the first ``limit`` stay."""
    first = hits.groupBy("item_id").agg(F.min(F.struct("query_id", "rank", "score")).alias("f"))
    place = Window.orderBy("query_id", "rank", "item_id")
    top = first.select("item_id", "f.*").orderBy("query_id", "rank", "item_id").limit(limit)
    return top.withColumn("position", F.row_number().over(place).cast("long"))


def scaled_k(chunk_count: Column, n_queries: Column, per_chunk: int = 9, target: float = 0.6, low: int = 4, high: int = 16) -> Column:
    """Retrieval depth of a query: ``low`` up to 40 chunks; beyond, one in nine of them or what lets up to six queries
    reach the target share, at least 6 and at most ``high``."""
    by_size = F.ceil(chunk_count / F.lit(per_chunk))
    wanted = F.greatest(F.lit(1), F.ceil(chunk_count * F.lit(target)))
    by_share = F.ceil(wanted / F.greatest(F.least(n_queries, F.lit(6)), F.lit(1)))
    deep = F.least(F.lit(high), F.greatest(F.lit(low), F.lit(6), by_size, by_share))
    return F.when(chunk_count <= 40, F.lit(low)).otherwise(deep).cast("long")


def coverage(headings: DataFrame, hits: DataFrame, low: float = 0.25) -> DataFrame:
    """(scope, headings, covered, fraction, is_low): share of a scope's headings that a retrieved item represents."""
    seen = headings.join(hits.select("scope", "heading").distinct().withColumn("hit", F.lit(1)), ["scope", "heading"], "left")
    n, k = F.count("*"), F.count("hit")
    return seen.groupBy("scope").agg(n.alias("headings"), k.alias("covered"), F.round(k / n, 4).alias("fraction"), (k / n < low).alias("is_low"))


def centroids(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, embedding): the mean vector of each group, summed component by component; its size is that of a vector."""
    parts = chunks.select(*keys, F.posexplode("embedding").alias("at", "v")).groupBy(*keys, "at").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda p: p["v"]).alias("embedding"))


def phased(chunks: DataFrame, queries: DataFrame, most: int = 16) -> tuple[DataFrame, DataFrame]:
    """Retrieval in two phases; chunks(item_id, scope, heading, embedding), queries(query_id, scope, embedding).

    First the queries of a scope are asked, as deep as its chunks and queries let ``scaled_k`` go. A chunk belongs to the first
    query that found it. Then every heading of an asked scope that no chunk found stands for is asked for by the mean of its own
    chunks, among the chunks not found yet; of those the nearest joins, under the first heading that found it.

    Returns hits (scope, phase, query_id, heading, item_id, rank, score) and diagnostics (scope, query_id, k, hits, new).
    """
    counts = chunks.groupBy("scope").agg(F.count("*").alias("chunks"))
    depth = queries.groupBy("scope").agg(F.count("*").alias("n")).join(counts, "scope").select("scope", F.least(scaled_k(F.col("chunks"), F.col("n"), high=most), F.lit(most)).alias("k"))
    found = written(scoped_topk(chunks.select("item_id", "scope", "embedding"), queries, most, own_scope=True).join(depth, "scope").filter("rank <= k"), "phase-one")
    first = found.groupBy("scope", "item_id").agg(F.min(F.struct("query_id", "rank", "score")).alias("f"))
    one = written(first.join(chunks.select("item_id", "heading"), "item_id").select("scope", F.lit(1).alias("phase"), F.col("f.query_id").alias("query_id"), "heading", "item_id", F.col("f.rank").alias("rank"), F.col("f.score").alias("score")), "first-hits")
    missing = chunks.join(depth, "scope", "left_semi").join(one.select("scope", "heading").distinct(), ["scope", "heading"], "left_anti")
    asked = centroids(missing, ["scope", "heading"]).withColumn("query_id", -F.abs(F.xxhash64("scope", "heading")) - 1)
    asked = written(asked, "heading-queries")
    rest = chunks.join(one.select("item_id"), "item_id", "left_anti").select("item_id", "scope", "embedding")
    nearest = scoped_topk(rest, asked, 1, own_scope=True).join(asked.select("query_id", "heading"), "query_id")
    two = nearest.groupBy("scope", "item_id").agg(F.min(F.struct("heading", "rank", "score")).alias("f")).select("scope", F.lit(2).alias("phase"), F.lit(None).cast("long").alias("query_id"), "f.heading", "item_id", "f.rank", "f.score")
    new = one.groupBy("scope", "query_id").agg(F.count("*").alias("new"))
    told = found.groupBy("scope", "query_id", "k").agg(F.count("*").alias("hits")).join(new, ["scope", "query_id"], "left").withColumn("new", F.coalesce("new", F.lit(0)))
    return one.unionByName(two), told
