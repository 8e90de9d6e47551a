"""Telemetry queries over events (user: vessel, type: path), in batch, with streaming twins where they exist."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import greedy
from ..operators import telemetry as M
from ..sources.tables import read
from ..streaming import replay
from .catalog import query

C = F.col
MEAN = "round(avg(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL {m} MINUTE PRECEDING AND CURRENT ROW), 6)"


@query("rolling_means", "SELECT event_id, " + ", ".join(f"{MEAN.format(m=m)} AS mean_{n}" for m, n in ((300, 5), (600, 10), (900, 15))) + " FROM events")
def rolling_means(spark, d):
    """Three windows over one sort; the table's events are hours apart, so the windows are 60 times the live ones."""
    e = read(spark, d, "events")
    return e.select("event_id", *[F.round(M.rolling_mean(C("value"), "user_id", "ts", m), 6).alias(f"mean_{n}") for m, n in ((300, 5), (600, 10), (900, 15))])


@query("buckets", "SELECT event_type, time_bucket(INTERVAL 10 SECOND, ts) AS bucket, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY ALL")
def buckets(spark, d):
    return M.buckets(read(spark, d, "events"), "ts", "10 seconds", F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"), keys=("event_type",))


@query("streamed_buckets", "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS bucket, count(*) AS n FROM events GROUP BY ALL")
def streamed_buckets(spark, d):
    """The bucket count as a stream that is run until its input is used up."""
    return replay.hourly_counts(spark, f"{d}/events.parquet")


COOL = 86_400


@query(
    "cooldown",
    f"""WITH RECURSIVE e AS (SELECT event_id, user_id, ts, min(ts) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL {COOL} SECOND FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM events),
    f AS (SELECT user_id, min(ts) AS ts FROM e GROUP BY user_id UNION SELECT e.user_id, e.nxt FROM f JOIN e ON e.user_id = f.user_id AND e.ts = f.ts WHERE e.nxt IS NOT NULL)
    SELECT user_id, ts FROM f""",
)
def cooldown(spark, d):
    """Greedy alarms: the first, then the first at least a day after the last one that fired."""
    return greedy.cooldown(read(spark, d, "events").select("user_id", "ts"), "user_id", "ts", COOL)


@query(
    "latest_state",
    "SELECT event_id, "
    + ", ".join(f"last_value(CASE WHEN event_type = '{p}' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {p}" for p in ("view", "click", "purchase"))
    + " FROM events",
)
def latest_state(spark, d):
    paths = ["view", "click", "purchase"]
    return M.latest_state(read(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", "value", paths).select("event_id", *paths)


@query("major_jumps", "SELECT event_id, round(value - before, 6) AS jump FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE abs(value - before) >= 15")
def major_jumps(spark, d):
    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return read(spark, d, "events").select("event_id", "value", before.alias("b")).filter(F.abs(C("value") - C("b")) >= 15).select("event_id", F.round(C("value") - C("b"), 6).alias("jump"))


CUTS = [0.0, 10.0, 25.0, 60.0, 120.0]


@query("dwell_bands")
def dwell_bands(spark, d):
    """Bands with a dwell of six hours and a bypass for major jumps; order-dependent, so checked against plain Python."""
    e = read(spark, d, "events").select("event_id", "user_id", "ts", "value", M.band_of(C("value"), CUTS).alias("band"))
    return greedy.stabilised(e, "user_id", "ts", "band", "value", 6 * 3600, 60.0).select("event_id", "band", "stable")


@query("band_lookup", "SELECT event_id, CASE WHEN value < 10 THEN 0 WHEN value < 25 THEN 1 WHEN value < 60 THEN 2 ELSE 3 END AS band FROM events WHERE value IS NOT NULL")
def band_lookup(spark, d):
    return read(spark, d, "events").filter(C("value").isNotNull()).select("event_id", M.band_of(C("value"), CUTS).alias("band"))


ANGLES, WINDS = [30.0, 60.0, 90.0, 150.0], [5.0, 10.0, 20.0]
SPEEDS = [[2.0, 3.5, 4.0], [4.0, 6.0, 7.0], [5.0, 7.5, 9.0], [3.0, 5.5, 8.0]]


def _cells() -> str:
    rows = [f"({a}, {a2}, {w}, {w2}, {SPEEDS[i][j]}, {SPEEDS[i][j + 1]}, {SPEEDS[i + 1][j]}, {SPEEDS[i + 1][j + 1]}, {i == len(ANGLES) - 2}, {j == len(WINDS) - 2})" for i, (a, a2) in enumerate(zip(ANGLES, ANGLES[1:], strict=False)) for j, (w, w2) in enumerate(zip(WINDS, WINDS[1:], strict=False))]
    return ", ".join(rows)


@query(
    "polar_interpolation",
    f"""WITH g(a, a2, w, w2, s, sw, sa, saw, last_a, last_w) AS (VALUES {_cells()}),
    e AS (SELECT event_id, greatest(30.0, least(150.0, (event_id % 180)::DOUBLE)) AS x, greatest(5.0, least(20.0, value)) AS y FROM events)
    SELECT event_id, round((s + (sw - s) * (y - w) / (w2 - w)) + ((sa + (saw - sa) * (y - w) / (w2 - w)) - (s + (sw - s) * (y - w) / (w2 - w))) * (x - a) / (a2 - a), 6) AS target
    FROM e JOIN g ON x >= a AND (x < a2 OR last_a) AND y >= w AND (y < w2 OR last_w)""",
)
def polar_interpolation(spark, d):
    angle = (C("event_id") % 180).cast("double")
    return read(spark, d, "events").filter(C("value").isNotNull()).select("event_id", F.round(M.bilinear(angle, C("value"), ANGLES, WINDS, SPEEDS), 6).alias("target"))


@query(
    "anchor_point",
    """WITH l AS (SELECT user_id, -sin(radians(value)) AS nx, cos(radians(value)) AS ny, (event_id % 100) / 100.0::DOUBLE AS lat, (event_id % 37) / 37.0::DOUBLE AS lon FROM events),
    s AS (SELECT user_id, count(*) AS n, sum(nx * nx) AS a, sum(nx * ny) AS b, sum(ny * ny) AS d, sum(nx * (nx * lat + ny * lon)) AS p, sum(ny * (nx * lat + ny * lon)) AS q FROM l GROUP BY user_id)
    SELECT user_id, n, CASE WHEN n >= 2 AND abs(a * d - b * b) >= 1e-12 THEN round((p * d - q * b) / (a * d - b * b), 6) END AS x, CASE WHEN n >= 2 AND abs(a * d - b * b) >= 1e-12 THEN round((a * q - b * p) / (a * d - b * b), 6) END AS y,
    CASE WHEN n < 5 THEN 'low' WHEN n <= 15 THEN 'medium' ELSE 'high' END AS confidence FROM s""",
)
def anchor_point(spark, d):
    lat, lon = (C("event_id") % 100) / F.lit(100.0), (C("event_id") % 37) / F.lit(37.0)
    p = M.least_squares_point(read(spark, d, "events"), "user_id", lat, lon, C("value"))
    confidence = F.when(C("n") < 5, "low").when(C("n") <= 15, "medium").otherwise("high")
    return p.select("user_id", "n", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), confidence.alias("confidence"))


@query(
    "swing_radius",
    """SELECT user_id, round(max(2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(value / 100 - 0.5) / 2), 2) + cos(radians(0.5)) * cos(radians(value / 100)) * pow(sin(radians((event_id % 37) / 37.0::DOUBLE - 0.5) / 2), 2))))) + 12, 3) AS radius FROM events GROUP BY user_id""",
)
def swing_radius(spark, d):
    dist = geo.haversine(F.lit(0.5), F.lit(0.5), C("value") / 100, (C("event_id") % 37) / F.lit(37.0))
    return read(spark, d, "events").groupBy("user_id").agg(F.round(F.max(dist) + 12, 3).alias("radius"))


@query(
    "swing_pairs",
    """WITH p AS (SELECT user_id AS k, avg(value) AS x, avg((event_id % 97)::DOUBLE) AS y FROM events GROUP BY user_id)
    SELECT a.k AS a, b.k AS b, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 6) AS distance, CASE WHEN sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) < 1 THEN 'red' ELSE 'amber' END AS severity
    FROM p a JOIN p b ON a.k < b.k WHERE sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 2""",
)
def swing_pairs(spark, d):
    p = read(spark, d, "events").groupBy("user_id").agg(F.avg("value").alias("x"), F.avg((C("event_id") % 97).cast("double")).alias("y"))
    near = M.near_pairs(p, "user_id", "x", "y", 2.0)
    return near.select("a", "b", F.round("distance", 6).alias("distance"), F.when(C("distance") < 1, "red").otherwise("amber").alias("severity"))


@query(
    "circular_arc",
    """WITH b AS (SELECT DISTINCT user_id, (round(value * 3)::BIGINT % 360 + 360) % 360 AS b FROM events),
    g AS (SELECT user_id, coalesce(lead(b) OVER w, min(b) OVER (PARTITION BY user_id) + 360) - b AS gap, coalesce(lead(b) OVER w, min(b) OVER (PARTITION BY user_id) + 360) % 360 AS nxt FROM b WINDOW w AS (PARTITION BY user_id ORDER BY b)),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY gap DESC, nxt) AS rn FROM g)
    SELECT user_id, CASE WHEN gap = 360 THEN (nxt + 335) % 360 ELSE nxt END AS start, CASE WHEN gap = 360 THEN 50 ELSE 360 - gap END AS span FROM r WHERE rn = 1""",
)
def circular_arc(spark, d):
    return M.smallest_arc(read(spark, d, "events"), "user_id", C("value") * 3)
