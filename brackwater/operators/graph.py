"""Property-graph operators: components, reachability, roles, paths and flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written


def components(edges: DataFrame, most: int = 100) -> DataFrame:
    """(node, component) by least-label propagation with pointer jumping; component is the least node of it.

    A step costs two shuffles on narrow rows; jumping halves the distance to the root, so steps grow with its logarithm.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")))
    for _ in range(most):
        heard = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("heard"))
        new = labels.join(heard, F.col("node") == F.col("a")).select("node", F.least("component", "heard").alias("component"), F.col("component").alias("old"))
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("root"))
        new = written(new.join(jump, F.col("component") == F.col("via"), "left").select("node", F.least("component", F.coalesce("root", "component")).alias("component"), "old"))
        changed = new.filter("component <> old").limit(1).count()
        labels = new.drop("old")
        if not changed:
            return labels
    raise RuntimeError("components did not settle")


def minimax_paths(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(scope, source, node, cost, path): to every node that a source reaches, a way whose dearest edge is as cheap as can be.

    edges(scope, a, b, cost) are followed from a to b, sources(scope, source, cost) begin with a cost of their own. Each round
    extends what the last one bettered by an edge and keeps a node's cheapest way, the one with fewer edges and then smaller
    names among those met so far; rounds go on until nothing is bettered, as many as the longest way that is kept has edges.
    Rounds are written, and join on (scope, node), so a hub's edges are dealt out by AQE.
    """
    edges = written(edges.groupBy("scope", "a", "b").agg(F.min("cost").alias("step")).filter("a <> b"), "path-edges")
    start = sources.groupBy("scope", "source").agg(F.min("cost").alias("cost"))
    way = lambda cost, hops, path: F.struct(cost.alias("cost"), hops.alias("hops"), path.alias("path"))
    known = written(start.select("scope", "source", F.col("source").alias("node"), way(F.col("cost"), F.lit(0), F.array("source")).alias("best")), "paths")
    front = known
    keys = ["scope", "source", "node"]
    while not front.isEmpty():
        out = front.join(edges, (front["scope"] == edges["scope"]) & (front["node"] == edges["a"])).filter(~F.array_contains("best.path", F.col("b")))
        longer = way(F.greatest("best.cost", "step"), F.col("best.hops") + 1, F.array_append("best.path", F.col("b")))
        step = out.select(front["scope"], "source", F.col("b").alias("node"), longer.alias("new")).groupBy(*keys).agg(F.min("new").alias("new"))
        better = step.join(known, keys, "left").filter(F.col("best").isNull() | (F.col("new") < F.col("best")))
        front = written(better.select(*keys, F.col("new").alias("best")), "paths")
        known = written(known.join(front.select(*keys), keys, "left_anti").unionByName(front), "paths")
    return known.select(*keys, "best.cost", "best.path")
