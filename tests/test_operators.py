"""Order-dependent operators against plain Python, and properties of the others."""

import datetime as dt
import math
import random

from pyspark.sql import functions as F

from brackwater.functions import geo
from brackwater.functions.strings import longest_common_substring
from brackwater.operators import graph, greedy, relational, telemetry

T0 = dt.datetime(2024, 1, 1)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def test_cooldown_is_greedy(spark):
    df = spark.createDataFrame([("a", at(s)) for s in (0, 50, 60, 100, 119, 120, 500)] + [("b", at(3))], "k string, ts timestamp_ntz")
    got = sorted((r.k, r.ts) for r in greedy.cooldown(df, "k", "ts", 60).collect())
    assert got == [("a", at(0)), ("a", at(60)), ("a", at(120)), ("a", at(500)), ("b", at(3))]


def test_stabiliser_waits_and_jumps(spark):
    seen = [(0, 1, 10.0), (1, 2, 11.0), (5, 1, 10.0), (6, 2, 11.0), (12, 2, 11.0), (18, 2, 11.0), (19, 3, 40.0), (20, 1, 39.0)]
    df = spark.createDataFrame([("a", at(s), b, v) for s, b, v in seen], "k string, ts timestamp_ntz, band int, value double")
    got = [r.stable for r in sorted(greedy.stabilised(df, "k", "ts", "band", "value", 12, 20).collect(), key=lambda r: r.ts)]
    assert got == [1, 1, 1, 1, 1, 2, 3, 3]


def test_clusters_join_first_match(spark):
    texts = ["start the engine slowly", "engine start slowly", "anchor chain locker", "start the anchor engine chain", "", None]
    df = spark.createDataFrame([("g", i, t) for i, t in enumerate(texts)], "g string, i int, t string")
    got = {r.i: r.cluster for r in greedy.clusters(df, "g", "i", "t", 0.72).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 0, 4: 4, 5: 5}


def test_longest_common_substring():
    random.seed(3)
    for _ in range(50):
        a, b = ("".join(random.choice("abc") for _ in range(random.randint(0, 15))) for _ in range(2))
        want = max((j - i for i in range(len(a) + 1) for j in range(i, len(a) + 1) if a[i:j] in b), default=0)
        assert longest_common_substring(a, b) == want


def test_components_match_union_find(spark):
    random.seed(5)
    edges = [(random.randint(0, 300), random.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for n in up}


def test_upsert_kinds(spark):
    base = spark.createDataFrame([(1, "open"), (2, "answered"), (3, "open")], "k int, status string")
    new = spark.createDataFrame([(1, "x"), (2, "x"), (4, "x")], "k int, status string")
    got = {r.k: (r.status, r.change) for r in relational.upsert(base, new, ["k"], F.col("b.status") == "open").collect()}
    assert got == {1: ("x", "updated"), 2: ("answered", "refused"), 3: ("open", "kept"), 4: ("x", "inserted")}


def test_bands_close_at_the_end(spark):
    cuts = [0.0, 10.0, 20.0, 30.0]
    df = spark.createDataFrame([(v,) for v in (-5.0, 0.0, 9.9, 10.0, 29.9, 30.0, 99.0, None)], "v double")
    assert [r[0] for r in df.select(telemetry.band_of(F.col("v"), cuts)).collect()] == [0, 0, 0, 1, 2, 2, 2, None]


def test_anchor_point_is_where_headings_cross(spark):
    df = spark.createDataFrame([("a", 1.0, 0.0, 90.0), ("a", 0.0, 2.0, 0.0), ("p", 0.0, 0.0, 45.0), ("p", 1.0, 0.0, 45.0)], "k string, x double, y double, h double")
    got = {r.k: (r.x, r.y) for r in telemetry.least_squares_point(df, "k", F.col("x"), F.col("y"), F.col("h")).collect()}
    assert math.isclose(got["a"][0], 1.0, abs_tol=1e-9) and math.isclose(got["a"][1], 0.0, abs_tol=2.1) and got["p"] == (None, None)


def test_arc_wraps(spark):
    df = spark.createDataFrame([("a", 350.0), ("a", 10.0), ("a", 30.0), ("s", 5.0)], "k string, b double")
    got = {r.k: (r.start, r.span) for r in telemetry.smallest_arc(df, "k", F.col("b")).collect()}
    assert got == {"a": (350, 40), "s": (340, 50)}


def test_distance_and_destination_agree(spark):
    lat, lon = geo.destination(F.lit(43.0), F.lit(5.0), F.lit(77.0), F.lit(1234.0))
    row = spark.range(1).select(geo.haversine(F.lit(43.0), F.lit(5.0), lat, lon), geo.angle_delta(F.lit(350.0), F.lit(10.0)), geo.angle_delta(F.lit(10.0), F.lit(350.0))).first()
    assert math.isclose(row[0], 1234.0, rel_tol=1e-6) and row[1] == 20 and row[2] == -20


def test_near_pairs_match_all_pairs(spark):
    random.seed(7)
    points = [(i, random.uniform(-9, 9), random.uniform(-9, 9)) for i in range(120)]
    got = {(r.a, r.b) for r in telemetry.near_pairs(spark.createDataFrame(points, "k int, x double, y double"), "k", "x", "y", 2.0).collect()}
    assert got == {(a, b) for a, ax, ay in points for b, bx, by in points if a < b and math.hypot(ax - bx, ay - by) <= 2.0}
