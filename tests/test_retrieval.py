"""Exact retrieval in blocks against all pairs one by one, with vectors that are odd and vectors that are copies."""

import math
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from brackwater.operators import retrieval

DATA = "/root/testdata/sf0.001"


def plain(items, asked, k, own_scope):
    """SQL's order: rounded cosines downwards, NaN first, null last, then smaller ids."""

    def score(a, b):
        if a is None or b is None or None in (*a, *b) or len(a) != len(b):
            return None
        dot = x = y = 0.0
        for v, w in zip(a, b, strict=True):
            dot, x, y = dot + v * w, x + v * v, y + w * w
        size = math.sqrt(x) * math.sqrt(y)
        if not size:
            return None
        s = dot / size
        return s if math.isnan(s) else float(Decimal(repr(s)).quantize(Decimal("1e-6"), ROUND_HALF_UP))

    out = []
    for qid, q_scope, q in asked:
        met = [(score(v, q), i, s) for i, s, v in items if i != qid and (not own_scope or s == q_scope)]
        met.sort(key=lambda m: (m[0] is None, 0 if m[0] is None else -math.inf if math.isnan(m[0]) else -m[0], m[1]))
        out += [(qid, i, s, str(v), r) for r, (v, i, s) in enumerate(met[:k], 1)]
    return out


@pytest.mark.parametrize("own_scope", [False, True])
@pytest.mark.parametrize("sizes", [None, (7, 20, 3)])
def test_blocks_give_what_all_pairs_give(spark, monkeypatch, own_scope, sizes):
    for name, n in zip(("FEW", "MANY", "STEP"), sizes or (), strict=False):
        monkeypatch.setattr(retrieval, name, n)
    rows = [(r.vec_id, r.label % 3 or None, list(r.embedding)) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").filter("vec_id < 150").collect()]
    rows += [(1000 + i, 1 + i % 2, rows[3][2]) for i in range(40)] + [(2000 + i, 1, [2 * x for x in rows[3][2]]) for i in range(5)]
    nan, zero = [math.nan] + [1.0] * 63, [0.0] * 64
    rows += [(3000, 1, None), (3001, 2, zero), (3002, 1, [1.0] * 63), (3003, 2, [None] + [1.0] * 63), (3004, 1, nan), (3005, None, [1.0] * 63 + [math.inf])]
    asked = [r for r in rows if r[0] % 10 == 3 or r[0] in (1000, 2000, 3000, 3001, 3002, 3004)]
    df = spark.createDataFrame(rows, "item_id long, scope int, embedding array<float>")
    q = spark.createDataFrame(asked, "query_id long, scope int, embedding array<float>")
    got = retrieval.scoped_topk(df, q if own_scope else q.drop("scope"), 3, own_scope=own_scope).select("query_id", "item_id", "scope", "score", "rank").collect()
    text = lambda v: str(v)
    assert sorted((r.query_id, r.rank, r.item_id, r.scope or 0, text(r.score)) for r in got) == sorted((a, e, b, c or 0, d) for a, b, c, d, e in plain(rows, asked, 3, own_scope))


def test_scores_are_made_in_blocks(spark):
    """No expression is worked out once a pair."""
    e = spark.read.parquet(f"{DATA}/embeddings.parquet")
    items = e.select(F.col("vec_id").alias("item_id"), F.col("label").alias("scope"), "embedding")
    plan = retrieval.scoped_topk(items, items.select(F.col("item_id").alias("query_id"), "embedding"), 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan
    assert retrieval.scoped_topk(items.limit(0), items.select(F.col("item_id").alias("query_id"), "embedding"), 3).count() == 0
