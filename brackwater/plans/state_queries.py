"""Live state over replayed events: timers let go of what is stale, old or silent; SQL gives the batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import telemetry
from ..sources.tables import read
from ..streaming import conflicts, keyed, live
from .catalog import query
from .telemetry_queries import CUTS

C = F.col
LATE = "1 day"


def replay(spark, d, *columns):
    e = read(spark, d, "events").select("event_id", "user_id", C("ts").cast("timestamp").alias("ts"), *columns)
    return keyed.in_slices(e, "ts", 4)


def ntz(name: str):
    return C(name).cast("timestamp_ntz").alias(name)


@query(
    "live_freshness",
    """WITH g AS (SELECT user_id, event_type, ts, lag(ts) OVER w AS before, lead(ts) OVER w AS after, max(ts) OVER () - INTERVAL 1 DAY AS mark FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
    SELECT user_id, event_type AS role, ts AS at, true AS fresh FROM g WHERE before IS NULL OR ts > before + INTERVAL 12 HOUR
    UNION ALL SELECT user_id, event_type, ts + INTERVAL 12 HOUR, false FROM g WHERE after > ts + INTERVAL 12 HOUR OR (after IS NULL AND ts + INTERVAL 12 HOUR < mark)""",
)
def live_freshness(spark, d):
    """When each role of a vessel turned fresh and stale; a timer tells of the roles that no further value comes for."""
    out, _ = live.finished(live.kept_live(replay(spark, d, "event_type"), "user_id", live.Freshness("ts", "event_id", "event_type", 12 * 3600), LATE), "freshness")
    return out.select(C("key").alias("user_id"), "role", ntz("at"), "fresh")


@query(
    "live_retained",
    """SELECT event_id, count(*) OVER w AS n, round(avg(value) OVER w, 6) AS mean, min(ts) OVER w AS oldest FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 5 DAY PRECEDING AND CURRENT ROW)""",
)
def live_retained(spark, d):
    """What a sliding retention of five days holds at each event, kept as a list that a timer empties."""
    out, _ = live.finished(live.kept_live(replay(spark, d, "value"), "user_id", live.Retained("ts", "event_id", "value", 5 * 86_400), LATE), "retained")
    return out.select(C("tie").alias("event_id"), C("n").cast("long").alias("n"), F.round("mean", 6).alias("mean"), ntz("oldest"))


@query("live_dwell")
def live_dwell(spark, d):
    """The band in force of ``dwell_bands`` as keyed state; order-dependent, held against it."""
    e = replay(spark, d, "value", telemetry.band_of(C("value"), CUTS).alias("band"))
    out, _ = live.finished(live.kept_live(e, "user_id", live.Dwell("ts", "event_id", "band", "value", 6 * 3600, 60.0, 90 * 86_400), LATE), "dwell")
    return out.select(C("tie").alias("event_id"), "stable")


@query(
    "live_anchors",
    """WITH e AS (SELECT user_id, event_id, ts, -sin(radians(value)) AS nx, cos(radians(value)) AS ny, (event_id % 100) / 100.0::DOUBLE AS lat, (event_id % 37) / 37.0::DOUBLE AS lon, event_id % 4 <> 1 AS slow, max(ts) OVER () - INTERVAL 1 DAY AS mark,
      coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 3 DAY, false) AS begins FROM events),
    g AS (SELECT *, count(*) FILTER (WHERE begins) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS stay FROM e),
    s AS (SELECT user_id, stay, event_id, ts, mark, count(*) FILTER (WHERE slow) OVER w AS n, sum(CASE WHEN slow THEN nx * nx END) OVER w AS a, sum(CASE WHEN slow THEN nx * ny END) OVER w AS b, sum(CASE WHEN slow THEN ny * ny END) OVER w AS d,
      sum(CASE WHEN slow THEN nx * (nx * lat + ny * lon) END) OVER w AS p, sum(CASE WHEN slow THEN ny * (nx * lat + ny * lon) END) OVER w AS q FROM g WINDOW w AS (PARTITION BY user_id, stay ORDER BY ts RANGE BETWEEN INTERVAL 2 DAY PRECEDING AND CURRENT ROW)),
    f AS (SELECT *, CASE WHEN n >= 2 AND abs(a * d - b * b) >= 1e-3 THEN (p * d - q * b) / (a * d - b * b) END AS x, CASE WHEN n >= 2 AND abs(a * d - b * b) >= 1e-3 THEN (a * q - b * p) / (a * d - b * b) END AS y FROM s),
    h AS (SELECT *, last_value(x IGNORE NULLS) OVER v AS hx, last_value(y IGNORE NULLS) OVER v AS hy, lead(ts) OVER (PARTITION BY user_id, stay ORDER BY ts, event_id) AS after, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS later FROM f WINDOW v AS (PARTITION BY user_id, stay ORDER BY ts, event_id))
    SELECT user_id, event_id, n, round(hx, 3) AS x, round(hy, 3) AS y, true AS watched FROM h
    UNION ALL SELECT user_id, NULL, n, round(hx, 3), round(hy, 3), false FROM h WHERE after IS NULL AND (later IS NOT NULL OR ts + INTERVAL 3 DAY < mark)""",
)
def live_anchors(spark, d):
    """The anchor point of the slow positions of two days at each event; a vessel that is silent for three days is let go."""
    e = replay(spark, d, ((C("event_id") % 100) / F.lit(100.0)).alias("lat"), ((C("event_id") % 37) / F.lit(37.0)).alias("lon"), "value", (C("event_id") % 4 != 1).alias("slow"))
    out, _ = live.finished(live.kept_live(e, "user_id", live.AnchorWatch("ts", "event_id", "lat", "lon", "value", "slow", 2 * 86_400, 3 * 86_400), LATE), "anchors")
    return out.select(C("key").alias("user_id"), C("tie").alias("event_id"), C("n").cast("long").alias("n"), F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), "watched")


def near_misses(spark, d):
    """All versions of the states of vessels that came near each other within half an hour; nearness is that of values."""
    e = read(spark, d, "events").select(C("user_id").alias("vessel"), C("ts").cast("timestamp").alias("ts"), "value", F.floor(C("value") / 10).alias("cell"))
    return conflicts.counted_states(keyed.in_slices(e, "ts", 4), 30, 2.0, 0.5, 24 * 60)


@query(
    "live_conflicts",
    """WITH e AS (SELECT user_id AS vessel, ts, value, floor(value / 10) AS cell FROM events),
    p AS (SELECT a.vessel AS va, b.vessel AS vb, CASE WHEN abs(a.value - b.value) <= 0.5 THEN 2 WHEN abs(a.value - b.value) <= 2 THEN 1 ELSE 0 END AS sev FROM e a JOIN e b ON a.cell = b.cell AND a.vessel < b.vessel AND b.ts BETWEEN a.ts - INTERVAL 30 MINUTE AND a.ts + INTERVAL 30 MINUTE)
    SELECT vessel, max(sev) AS worst, count(*) AS n FROM (SELECT va AS vessel, sev FROM p UNION ALL SELECT vb, sev FROM p) WHERE sev > 0 GROUP BY vessel""",
)
def live_conflicts(spark, d):
    """The states of vessels after the last micro-batch."""
    states = near_misses(spark, d)
    last = states.agg(F.max("batch").alias("batch"))  # one row
    return states.join(F.broadcast(last), "batch").select("vessel", "worst", "n")
