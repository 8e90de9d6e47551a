"""Live-data queries: deltas, routing, freshness, advice by sail plan, swing conflicts; batch forms with keyed-stream twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import anchors, greedy
from ..operators import sailplan as S
from ..operators import telemetry as M
from ..sources.shared import written
from ..sources.tables import read
from ..streaming import keyed
from .catalog import query

C = F.col
KNOTS = 1.94384

DELTA = "struct<context:string, updates:array<struct<timestamp:timestamp_ntz, values:array<struct<path:string, value:string>>>>>"


def deltas(spark, d):
    """JSON documents of an hour of a vessel's events; every third value is text, every context of 7n is another vessel's."""
    value = F.when(C("event_id") % 3 == 0, F.concat(F.lit('"'), C("value").cast("string"), F.lit('"'))).otherwise(C("value").cast("string"))
    path = F.when(C("event_id") % 2 == 0, F.concat(F.lit("self."), "event_type")).otherwise(C("event_type"))
    one = F.struct(C("ts").alias("timestamp"), F.array(F.struct(path.alias("path"), value.alias("value"))).alias("values"))
    e = read(spark, d, "events").groupBy("user_id", F.date_trunc("hour", C("ts").cast("timestamp")).alias("hour")).agg(F.collect_list(one).alias("updates"))
    context = F.when(C("user_id") % 7 == 0, F.concat(F.lit("vessels."), C("user_id").cast("string"))).otherwise("vessels.self")
    return e.select("user_id", F.to_json(F.struct(context.alias("context"), "updates")).alias("delta"))


@query(
    "exploded_deltas",
    "SELECT user_id, event_type AS path, count(*) AS n, round(sum(value), 6) AS total FROM events WHERE user_id % 7 <> 0 AND event_id % 3 <> 0 GROUP BY user_id, event_type",
)
def exploded_deltas(spark, d):
    """Own vessel's numeric values out of nested deltas, paths without their prefix."""
    x = deltas(spark, d).select("user_id", F.from_json("delta", DELTA).alias("m")).filter(C("m.context") == "vessels.self")
    v = x.select("user_id", F.explode("m.updates").alias("u")).select("user_id", F.explode("u.values").alias("v"))
    number = F.when(~C("v.value").startswith('"'), C("v.value")).try_cast("double")
    rows = v.select("user_id", F.regexp_replace("v.path", r"^self\.", "").alias("path"), number.alias("value")).filter(C("value").isNotNull() & ~F.isnan("value"))
    return rows.groupBy("user_id", "path").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("demuxed_messages", "SELECT CASE WHEN user_id % 7 = 0 THEN 'hello' ELSE 'delta' END AS kind, count(*) AS n FROM (SELECT DISTINCT user_id, date_trunc('hour', ts) FROM events) GROUP BY ALL")
def demuxed_messages(spark, d):
    """Greetings and deltas told apart by their fields, over one parse."""
    raw = deltas(spark, d).select(F.when(C("user_id") % 7 == 0, '{"self": "vessels.self", "version": "1"}').otherwise(C("delta")).alias("message"))
    m = raw.select(F.from_json("message", "struct<self:string, updates:array<struct<timestamp:string>>>").alias("m"))
    return m.select(F.when(C("m.updates").isNotNull(), "delta").when(C("m.self").isNotNull(), "hello").alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query(
    "boat_speed",
    f"""SELECT event_id, CASE WHEN abs(stw) >= 0.05 THEN 'stw' WHEN sog IS NOT NULL THEN 'sog' WHEN stw IS NOT NULL THEN 'stw' END AS source,
    round(CASE WHEN abs(stw) >= 0.05 THEN stw WHEN sog IS NOT NULL THEN sog ELSE stw END * {KNOTS}, 6) AS knots, round(CASE WHEN heading IS NOT NULL THEN heading WHEN sog > 0.3 THEN cog ELSE 0 END, 6) AS heading,
    round(coalesce(tws, aws) * {KNOTS}, 6) AS tws FROM (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 0.01::DOUBLE ELSE value / 100 END AS stw, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value / 90 END AS sog,
      CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS heading, (event_id % 360)::DOUBLE AS cog, CASE WHEN event_id % 2 = 0 THEN value / 10 END AS tws, value / 20 AS aws FROM events)""",
)
def boat_speed(spark, d):
    """Speed through water unless it is missing or next to nothing, heading and wind by precedence, in knots."""
    k, v = C("event_id"), C("value")
    e = read(spark, d, "events").select("event_id", F.when(k % 4 == 0, None).when(k % 4 == 1, 0.01).otherwise(v / 100).alias("stw"), F.when(k % 3 != 0, v / 90).alias("sog"), F.when(k % 5 != 0, v).alias("heading"), (k % 360).cast("double").alias("cog"), F.when(k % 2 == 0, v / 10).alias("tws"), (v / 20).alias("aws"))
    useful = F.abs("stw") >= 0.05
    source = F.when(useful, "stw").when(C("sog").isNotNull(), "sog").when(C("stw").isNotNull(), "stw")
    speed = F.when(useful, C("stw")).otherwise(F.coalesce("sog", "stw"))
    heading = F.coalesce("heading", F.when(C("sog") > 0.3, C("cog")), F.lit(0.0))
    return e.select("event_id", source.alias("source"), F.round(speed * KNOTS, 6).alias("knots"), F.round(heading, 6).alias("heading"), F.round(F.coalesce("tws", "aws") * KNOTS, 6).alias("tws"))


@query(
    "routed_paths",
    """WITH b(role, path) AS (VALUES ('speed', 'view'), ('depth', 'click'), ('sog', 'purchase'), ('log', 'view')) SELECT role, user_id, count(*) AS n, round(max_by(value, (ts, event_id)), 6) AS latest FROM events JOIN b ON path = event_type GROUP BY role, user_id""",
)
def routed_paths(spark, d):
    """Values routed from paths to the roles bound to them; the fallback of the speed is a role of its own."""
    bindings = {"speed": ("self.view", "self.purchase"), "depth": ("self.click", None), "log": ("self.view", None)}
    rows = [(role, path) for role, (path, _) in bindings.items()] + [("sog", bindings["speed"][1])]
    b = spark.createDataFrame([(r, p.removeprefix("self.")) for r, p in rows], "role string, path string")
    e = read(spark, d, "events").join(F.broadcast(b), C("event_type") == C("path"))  # as many rows as there are roles
    return e.groupBy("role", "user_id").agg(F.count("*").alias("n"), F.round(F.max_by("value", F.struct("ts", "event_id")), 6).alias("latest"))


@query(
    "freshness",
    """WITH g AS (SELECT user_id, event_type, ts, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS nxt FROM events)
    SELECT user_id, event_type, count(*) AS n, count(*) FILTER (WHERE nxt IS NULL OR nxt - ts > INTERVAL 12 HOUR) AS outages, max(ts) + INTERVAL 12 HOUR AS fresh_until FROM g GROUP BY user_id, event_type""",
)
def freshness(spark, d):
    """How often each role went stale: its time to live ran out before the next value; and until when it is fresh."""
    nxt = F.lead("ts").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    g = read(spark, d, "events").withColumn("nxt", nxt)
    late = C("nxt").isNull() | (C("nxt") - C("ts") > F.expr("INTERVAL 12 HOURS"))
    return g.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.count_if(late).alias("outages"), (F.max("ts") + F.expr("INTERVAL 12 HOURS")).alias("fresh_until"))


@query(
    "retained_samples",
    """SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean, min(ts) AS oldest FROM (SELECT *, max(ts) OVER (PARTITION BY user_id) AS now FROM events) WHERE ts >= now - INTERVAL 5 DAY GROUP BY user_id""",
)
def retained_samples(spark, d):
    """What a sliding retention holds at a user's last event; the newest time is one aggregate, joined back."""
    e = read(spark, d, "events")
    now = e.groupBy("user_id").agg(F.max("ts").alias("now"))
    return e.join(now, "user_id").filter(C("ts") >= C("now") - F.expr("INTERVAL 5 DAYS")).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("ts").alias("oldest"))


@query(
    "path_discovery",
    """SELECT event_type, time_bucket(INTERVAL 45 SECOND, ts) AS bucket, max_by(value, (ts, event_id)) AS latest FROM events WHERE NOT isnan(value) GROUP BY ALL""",
)
def path_discovery(spark, d):
    """The latest number of each path in scans of 45 seconds."""
    e = read(spark, d, "events").filter(~F.isnan("value"))
    return M.buckets(e, "ts", "45 seconds", F.max_by("value", F.struct("ts", "event_id")).alias("latest"), keys=("event_type",))


@query("stopped_recordings", "SELECT user_id, max_by(value, (ts, event_id)) AS last_value, count(*) > 400 AS was_anchored, 0 AS swing_radius, 'unknown' AS state FROM events GROUP BY user_id")
def stopped_recordings(spark, d):
    """What stays when recording stops: the last position; everything derived is reset."""
    return read(spark, d, "events").groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("last_value"), (F.count("*") > 400).alias("was_anchored")).select("*", F.lit(0).alias("swing_radius"), F.lit("unknown").alias("state"))


@query(
    "course_jumps",
    """SELECT event_id, round(least(abs(a - b), 360 - abs(a - b)), 6) AS turn, round(abs(value - before), 6) AS step FROM (SELECT event_id, value, (event_id * 37 % 360)::DOUBLE AS a, lag((event_id * 37 % 360)::DOUBLE) OVER w AS b, lag(value) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    WHERE least(abs(a - b), 360 - abs(a - b)) >= 15 OR abs(value - before) >= 4""",
)
def course_jumps(spark, d):
    """Jumps on either of two channels, the angle on the circle."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    angle = (C("event_id") * 37 % 360).cast("double")
    e = read(spark, d, "events").select("event_id", "value", angle.alias("a"), F.lag(angle).over(w).alias("b"), F.lag("value").over(w).alias("before"))
    turn, step = F.abs(geo.angle_delta(C("b"), C("a"))), F.abs(C("value") - C("before"))
    return e.filter((turn >= 15) | (step >= 4)).select("event_id", F.round(turn, 6).alias("turn"), F.round(step, 6).alias("step"))


@query(
    "wind_steps",
    """WITH e AS (SELECT event_id, (event_id * 53 % 360)::DOUBLE AS a, (event_id * 91 % 360)::DOUBLE AS b, (event_id % 11) / 10.0::DOUBLE AS t FROM events)
    SELECT event_id, round((((a + ((b - a + 540) % 360 - 180) * t) % 360) + 360) % 360, 6) AS wind, round(CASE WHEN event_id % 2 = 0 THEN (a + b) % 360 ELSE b END, 6) AS base FROM e""",
)
def wind_steps(spark, d):
    """Wind turned the shortest way between two directions, and a boat-relative angle made a compass one by the heading."""
    k = C("event_id")
    a, b, t = (k * 53 % 360).cast("double"), (k * 91 % 360).cast("double"), (k % 11) / F.lit(10.0)
    turn = F.pmod(b - a + 540, F.lit(360.0)) - 180
    path = F.when(k % 2 == 0, "environment.wind.angleTrueWater").otherwise("environment.wind.directionTrue")
    base = F.when(path.contains("angleTrueWater") | path.contains("angleTrueGround"), geo.normal_degrees(a + b)).otherwise(b)
    return read(spark, d, "events").select("event_id", F.round(geo.normal_degrees(a + turn * t), 6).alias("wind"), F.round(base, 6).alias("base"))


@query(
    "near_own_vessel",
    """WITH h AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS b, max_by(value, (ts, event_id)) AS lat FROM events WHERE user_id = 1 GROUP BY ALL)
    SELECT event_id, round(6371000.0 * radians(abs(value - lat) / 100), 3) AS metres FROM events JOIN h ON time_bucket(INTERVAL 1 DAY, ts) = b WHERE 6371000.0 * radians(abs(value - lat) / 100) <= 20000""",
)
def near_own_vessel(spark, d):
    """Positions within a radius of a moving centre: the own vessel's last one of each day, joined by day."""
    day = F.window(C("ts").cast("timestamp"), "1 day")["start"]
    e = read(spark, d, "events")
    own = e.filter("user_id = 1").groupBy(day.alias("day")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("lat"))
    metres = geo.haversine(C("lat") / 100, F.lit(0.0), C("value") / 100, F.lit(0.0))
    return e.withColumn("day", day).join(own, "day").filter(metres <= 20000).select("event_id", F.round(metres, 3).alias("metres"))


@query("deadband_values")
def deadband_values(spark, d):
    """Values at least 20 from the last that was taken; order-dependent, so held against plain Python and its streaming twin."""
    return greedy.deadband(read(spark, d, "events").select("event_id", "user_id", "ts", "value"), "user_id", ["ts", "event_id"], "value", 20.0)


@query(
    "streamed_cooldown",
    """WITH RECURSIVE e AS (SELECT user_id, ts, min(ts) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECOND FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM events),
    f AS (SELECT user_id, min(ts) AS ts FROM e GROUP BY user_id UNION SELECT e.user_id, e.nxt FROM f JOIN e ON e.user_id = f.user_id AND e.ts = f.ts WHERE e.nxt IS NOT NULL) SELECT user_id, ts FROM f""",
)
def streamed_cooldown(spark, d):
    """The cooldown as keyed state with a watermark, over a replay in four micro-batches; equals the batch twin."""
    e = read(spark, d, "events").select("user_id", C("ts").cast("timestamp").alias("ts"))
    out = keyed.finished(keyed.cooldown(keyed.in_slices(e, "ts", 4), "user_id", "ts", 86_400), "cooldown")
    return out.select("user_id", C("ts").cast("timestamp_ntz").alias("ts"))


@query(
    "streamed_latest",
    """WITH s AS (SELECT user_id, ts, event_id, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER w AS "view", last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER w AS click FROM events WHERE event_type IN ('view', 'click') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT user_id, count(*) AS n, round(sum("view"), 6) AS views, round(sum(click), 6) AS clicks FROM s WHERE "view" IS NOT NULL AND click IS NOT NULL GROUP BY user_id""",
)
def streamed_latest(spark, d):
    """Records flushed once all their paths have been seen, from keyed state over four micro-batches."""
    e = read(spark, d, "events").select("user_id", C("ts").cast("timestamp").alias("ts"), "event_type", "value")
    out = keyed.finished(keyed.latest(keyed.in_slices(e, "ts", 4), "user_id", "ts", "event_type", "value", ["view", "click"]), "latest")
    return out.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("view"), 6).alias("views"), F.round(F.sum("click"), 6).alias("clicks"))


@query("streamed_deadband")
def streamed_deadband(spark, d):
    """The deadband as keyed state; its rows are those of ``deadband_values``."""
    e = read(spark, d, "events").select("event_id", "user_id", C("ts").cast("timestamp").alias("ts"), "value")
    out = keyed.finished(keyed.deadband(keyed.in_slices(e, "ts", 3), "user_id", "ts", "value", 20.0), "deadband")
    return out.select("event_id", "user_id", C("ts").cast("timestamp_ntz").alias("ts"), "value")


@query(
    "cut_bands",
    """WITH c AS (SELECT s_suppkey, [s_acctbal / 50, s_acctbal / 50, (s_suppkey % 7 - 2) * 40.0::DOUBLE, 'nan'::DOUBLE, 90.0::DOUBLE] AS raw FROM supplier),
    n AS (SELECT s_suppkey, list_sort(list_distinct(list_transform(list_filter(raw, lambda x: NOT isnan(x)), lambda x: least(180.0::DOUBLE, greatest(0.0::DOUBLE, x))))) AS cuts FROM c)
    SELECT s_suppkey, len(cuts) AS n_cuts, len(cuts) - 1 AS n_bands, cuts[1] AS first_cut, cuts[-1] AS last_cut FROM n""",
)
def cut_bands(spark, d):
    """Cuts clamped, sorted and without repeats, and the bands between them."""
    raw = F.array(C("s_acctbal") / 50, C("s_acctbal") / 50, (C("s_suppkey") % 7 - 2) * F.lit(40.0), F.lit(float("nan")), F.lit(90.0))
    c = read(spark, d, "supplier").select("s_suppkey", S.normal_cuts(raw, 0.0, 180.0, [0.0, 180.0]).alias("cuts"))
    return c.select("s_suppkey", F.size("cuts").cast("long").alias("n_cuts"), F.size(S.bands(C("cuts"))).cast("long").alias("n_bands"), F.element_at("cuts", 1).alias("first_cut"), F.element_at("cuts", -1).alias("last_cut"))


@query(
    "resampled_matrix",
    """WITH b(i, lo, hi) AS (VALUES (0, 0.0, 40.0), (1, 40.0, 90.0), (2, 90.0, 180.0)), n AS (SELECT s_suppkey, t.j, CASE t.j WHEN 0 THEN 0.0 ELSE s_suppkey % 60 + 20.0 END AS lo, CASE t.j WHEN 0 THEN s_suppkey % 60 + 20.0 ELSE 180.0 END AS hi FROM supplier, (VALUES (0), (1)) t(j))
    SELECT s_suppkey, j AS new_row, i AS old_row, 'cell ' || i AS cell FROM n JOIN b ON (n.lo + n.hi) / 2 >= b.lo AND (n.lo + n.hi) / 2 < b.hi""",
)
def resampled_matrix(spark, d):
    """A matrix brought to new cuts: each new band takes the cell of the old band that holds its middle."""
    old = S.bands(F.array(*[F.lit(x) for x in (0.0, 40.0, 90.0, 180.0)]))
    new = S.bands(F.array(F.lit(0.0), C("s_suppkey") % 60 + F.lit(20.0), F.lit(180.0)))
    cells = F.array(*[F.lit(f"cell {i}") for i in range(3)])
    x = read(spark, d, "supplier").select("s_suppkey", F.posexplode(S.resampled(old, new)).alias("new_row", "old_row"))
    return x.select("s_suppkey", "new_row", "old_row", F.get(cells, C("old_row")).alias("cell"))


TWA, TWS = [0.0, 45.0, 90.0, 180.0], [0.0, 10.0, 20.0]
SAILS = [["jib", "jib, reefed"], ["genoa", "Jib"], ["spinnaker", "genoa"]]
HEAVY = ["storm jib", "storm jib", "bare poles"]


def _advice_sql() -> str:
    cells = ", ".join(f"({i}, {j}, '{SAILS[i][j]}')" for i in range(3) for j in range(2))
    return f"""WITH cell(i, j, sail) AS (VALUES {cells}), heavy(i, sail) AS (VALUES {', '.join(f"({i}, '{s}')" for i, s in enumerate(HEAVY))}),
    e AS (SELECT event_id, (event_id * 7 % 181)::DOUBLE AS a, value / 8 AS w FROM events),
    b AS (SELECT *, CASE WHEN a < 45 THEN 0 WHEN a < 90 THEN 1 ELSE 2 END AS i, CASE WHEN w < 10 THEN 0 ELSE 1 END AS j FROM e),
    p AS (SELECT *, CASE WHEN i > 0 AND abs(a - CASE i WHEN 1 THEN 45 ELSE 90 END) <= 4 THEN 1 ELSE 0 END AS lo_a, CASE WHEN i < 2 AND abs(a - CASE i WHEN 0 THEN 45 ELSE 90 END) <= 4 THEN 1 ELSE 0 END AS hi_a, CASE WHEN abs(w - 10) <= 1.5 THEN 1 ELSE 0 END AS near_w FROM b),
    n AS (SELECT event_id, string_agg(DISTINCT lower(x.sail), '/' ORDER BY lower(x.sail)) AS other FROM p JOIN cell own ON own.i = p.i AND own.j = p.j JOIN cell x ON ((x.j = p.j AND ((x.i = p.i - 1 AND lo_a = 1) OR (x.i = p.i + 1 AND hi_a = 1))) OR (x.i = p.i AND x.j = 1 - p.j AND near_w = 1)) AND lower(x.sail) <> lower(own.sail) WHERE w < 18 GROUP BY event_id)
    SELECT p.event_id, CASE WHEN w >= 18 THEN h.sail ELSE c.sail END AS sail, coalesce(n.other, '') AS alternatives, w >= 18 AS heavy, w < 18 AND lo_a + hi_a + near_w > 0 AS near, a < 85 AND w < 5 AS slow
    FROM p JOIN cell c ON c.i = p.i AND c.j = p.j JOIN heavy h ON h.i = p.i LEFT JOIN n ON n.event_id = p.event_id"""


@query("sail_advice", _advice_sql())
def sail_advice(spark, d):
    """The sail of a band, heavy weather first; sails of the neighbours near a seam as alternatives; a hint at low performance."""
    a, w = (C("event_id") * 7 % 181).cast("double"), C("value") / 8
    twa, tws = (S.bands(F.array(*[F.lit(x) for x in cuts])) for cuts in (TWA, TWS))
    i, j = S.band_index(twa, C("a")), S.band_index(tws, C("w"))
    e = read(spark, d, "events").select("event_id", a.alias("a"), w.alias("w")).withColumn("i", i).withColumn("j", j)
    (low_a, high_a), (low_w, high_w) = S.edge(C("a"), twa, C("i")), S.edge(C("w"), tws, C("j"))
    grid = F.array(*[F.array(*[F.lit(s) for s in row]) for row in SAILS])
    cell = lambda i, j: F.get(F.get(grid, i), j)
    near = [low_a <= 4, high_a <= 4, low_w <= 1.5, high_w <= 1.5]
    around = [cell(C("i") - 1, C("j")), cell(C("i") + 1, C("j")), cell(C("i"), C("j") - 1), cell(C("i"), C("j") + 1)]
    heavy = C("w") >= 18
    other = S.unique_texts(F.array_compact(F.array(*[F.when(t, x) for t, x in zip(near, around, strict=True)])), cell(C("i"), C("j")))
    other = F.when(heavy, "").otherwise(F.array_join(F.array_sort(F.transform(other, lambda t: F.lower(t))), "/"))
    sail = F.when(heavy, F.get(F.array(*[F.lit(s) for s in HEAVY]), C("i"))).otherwise(cell(C("i"), C("j")))
    seam = near[0] | near[1] | near[2] | near[3]
    return e.select("event_id", sail.alias("sail"), other.alias("alternatives"), heavy.alias("heavy"), (~heavy & seam).alias("near"), ((C("a") < 85) & (C("w") < 5)).alias("slow"))


@query(
    "sticky_seams",
    """SELECT event_id, coalesce(last_value(CASE WHEN abs(value - 60) <= 4 THEN true WHEN NOT coalesce(abs(value - 60) <= 7, false) THEN false END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), false) AS near FROM events""",
)
def sticky_seams(spark, d):
    """Near a cutover from 4 degrees on, until more than 7 away: the last decision so far."""
    gap = F.abs(C("value") - 60)
    e = read(spark, d, "events").select("event_id", "user_id", "ts", "value", (gap <= 4).alias("enter"), (gap <= 7).alias("stay"))
    return greedy.sticky(e, "user_id", ["ts", "event_id"], "enter", "stay").select("event_id", "near")


@query(
    "target_curve",
    "SELECT nation.n_nationkey, t.a AS twa, round(t.lo + (t.hi - t.lo) * (least(20.0, greatest(5.0, n_nationkey)) - 5.0) / 15.0, 6) AS target FROM nation, (VALUES (30.0, 2.0, 4.0), (90.0, 5.0, 9.0)) t(a, lo, hi)",
)
def target_curve(spark, d):
    """Target speed at a fixed wind for every angle of the table."""
    wind = F.greatest(F.lit(5.0), F.least(F.lit(20.0), C("n_nationkey").cast("double")))
    rows = F.array(*[F.struct(F.lit(a).alias("twa"), (F.lit(lo) + (F.lit(hi) - F.lit(lo)) * (wind - 5.0) / 15.0).alias("target")) for a, lo, hi in ((30.0, 2.0, 4.0), (90.0, 5.0, 9.0))])
    return read(spark, d, "nation").select("n_nationkey", F.explode(rows).alias("r")).select("n_nationkey", C("r.twa").cast("decimal(3,1)").alias("twa"), F.round("r.target", 6).alias("target"))


def _anchors(spark, d):
    """Anchored vessels: one a supplier, close together on a small grid."""
    k = C("s_suppkey")
    return read(spark, d, "supplier").select(k.alias("k"), ((k * 37 % 101) / F.lit(20000.0)).alias("lat"), ((k * 53 % 97) / F.lit(20000.0)).alias("lon"), (k % 60 + F.lit(20.0)).alias("radius"), (k % 15 + F.lit(8.0)).alias("boat"))


_DIST = "2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2))))"
_ANCHORS = "v AS (SELECT s_suppkey AS k, (s_suppkey * 37 % 101) / 20000.0::DOUBLE AS lat, (s_suppkey * 53 % 97) / 20000.0::DOUBLE AS lon, s_suppkey % 60 + 20.0::DOUBLE AS radius, s_suppkey % 15 + 8.0::DOUBLE AS boat FROM supplier)"


_SEV = "CASE WHEN greatest(a.radius, b.radius) >= {d} + least(a.radius, b.radius) - CASE WHEN a.radius <= b.radius THEN a.boat ELSE b.boat END THEN 2 WHEN {d} <= greatest(a.radius, b.radius) THEN 1 ELSE 0 END"


@query(
    "anchor_states",
    f"""WITH {_ANCHORS}, p AS (SELECT a.k AS a, b.k AS b, {_DIST.format(a='a.', b='b.')} AS d, a.radius AS ra, b.radius AS rb, a.boat AS ba, b.boat AS bb, a.lat AS la, a.lon AS oa, b.lat AS lb, b.lon AS ob FROM v a JOIN v b ON a.k <> b.k),
    s AS (SELECT *, CASE WHEN greatest(ra, rb) >= d + least(ra, rb) - CASE WHEN ra <= rb THEN ba ELSE bb END THEN 2 WHEN d <= greatest(ra, rb) THEN 1 ELSE 0 END AS sev FROM p)
    SELECT v.k, coalesce(max(sev), 0) AS worst, count(*) FILTER (WHERE sev > 0) AS conflicts FROM v LEFT JOIN s ON s.a = v.k GROUP BY v.k""",
)
def anchor_states(spark, d):
    """Worst severity of each anchored vessel over all others near enough to matter: met in cubes of the largest reach, in blocks."""
    v = _anchors(spark, d)
    return v.select("k").join(anchors.states(v), "k", "left").select("k", F.coalesce("worst", F.lit(0)).alias("worst"), F.coalesce("conflicts", F.lit(0)).alias("conflicts"))


def conflicting(v):
    return anchors.pairs(v)


def _wind_sql() -> str:
    dest = lambda s: f"degrees(asin(sin(radians({s}.lat)) * cos({s}.radius / 6371000.0) + cos(radians({s}.lat)) * sin({s}.radius / 6371000.0) * cos(radians(w + 180))))"
    east = lambda s: f"{s}.lon + degrees(atan2(sin(radians(w + 180)) * sin({s}.radius / 6371000.0) * cos(radians({s}.lat)), cos({s}.radius / 6371000.0) - sin(radians({s}.lat)) * sin(radians({dest(s)}))))"
    d = _DIST.format(a="q.a", b="q.b")
    return f"""WITH {_ANCHORS}, w AS (SELECT (350 + 60.0::DOUBLE * i / 36) AS w FROM range(37) t(i)),
    p AS (SELECT a.k AS a, b.k AS b, a.radius AS ra, b.radius AS rb, a.boat AS ba, b.boat AS bb, w, {dest('a')} AS alat, {east('a')} AS alon, {dest('b')} AS blat, {east('b')} AS blon, {_SEV.format(d='(' + _DIST.format(a='a.', b='b.') + ')')} AS sev FROM v a JOIN v b ON a.k <> b.k, w),
    q AS (SELECT *, {d.replace('q.', '')} AS d FROM p WHERE sev > 0),
    c AS (SELECT a, b, max(sev) AS sev, bool_or(greatest(ra, rb) >= d + least(ra, rb) - CASE WHEN ra <= rb THEN ba ELSE bb END OR d <= greatest(ra, rb)) AS meets FROM q GROUP BY a, b)
    SELECT a AS k, CASE WHEN max(sev) = 2 THEN 'red' WHEN bool_or(meets) THEN 'amber' ELSE 'green' END AS state FROM c GROUP BY a"""


@query("wind_range_states", _wind_sql())
def wind_range_states(spark, d):
    """States when the wind stays between 350 and 50 degrees: an amber vessel is green if no sampled wind brings two boats together.

    Vessels that are red whatever the wind are settled by their conflicts alone; only amber ones are held against the winds. Where
    a boat lies at each wind is a matter of its vessel, not of a pair.
    """
    v = _anchors(spark, d)
    found = written(anchors.states(v), "anchor-states")
    winds = F.transform(F.sequence(F.lit(0), F.lit(36)), lambda i: F.lit(350.0) + F.lit(60.0) * i / 36)
    there = lambda i: F.transform(winds, lambda w: geo.destination(C("lat"), C("lon"), w + 180, C("radius"))[i])
    boats = written(v.withColumns({"lats": there(0), "lons": there(1)}), "boats")
    met = anchors.brought_together(boats, boats.join(found.filter("worst = 1").select("k"), "k", "left_semi"))
    return found.join(met, "k", "left").select("k", F.when(C("worst") == 2, "red").when(C("met"), "amber").otherwise("green").alias("state"))


@query(
    "swing_positions",
    """SELECT s_suppkey, i AS step, round(degrees(asin(sin(radians(lat)) * cos(50 / 6371000.0) + cos(radians(lat)) * sin(50 / 6371000.0) * cos(radians(brg)))), 7) AS lat FROM (SELECT s_suppkey, (s_suppkey % 50 + 1)::DOUBLE AS lat, i, (s_suppkey % 360 + CASE WHEN s_suppkey % 5 = 0 THEN 360.0::DOUBLE * i / 4 ELSE s_suppkey % 90 * i / 3.0::DOUBLE END) % 360 AS brg FROM supplier, range(4) t(i))""",
)
def swing_positions(spark, d):
    """Points on a swing circle along the clockwise arc between two bearings; equal bearings mean the whole circle."""
    k = C("s_suppkey")
    start, end = (k % 360).cast("double"), F.when(k % 5 == 0, k % 360).otherwise(k % 360 + k % 90).cast("double")
    s = read(spark, d, "supplier").select("s_suppkey", F.posexplode(arc(start, end, 4)).alias("step", "bearing"))
    lat, _ = geo.destination((k % 50 + 1).cast("double"), F.lit(0.0), C("bearing"), F.lit(50.0))
    return s.select("s_suppkey", C("step").cast("long").alias("step"), F.round(lat, 7).alias("lat"))


def arc(start, end, n: int):
    """``n`` bearings along the clockwise arc, both ends in; the full circle, its end left out, where they coincide."""
    s = geo.normal_degrees(start)
    span = F.pmod(end - start, F.lit(360.0))
    part = F.when(span < 1e-6, F.lit(360.0) / n).otherwise(span / (n - 1))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: geo.normal_degrees(s + part * i))


@query(
    "anchor_watch",
    """WITH e AS (SELECT user_id, event_id, ts, -sin(radians(value)) AS nx, cos(radians(value)) AS ny, (event_id % 100) / 100.0::DOUBLE AS lat, (event_id % 37) / 37.0::DOUBLE AS lon, event_id % 4 <> 1 AS slow FROM events),
    s AS (SELECT user_id, event_id, ts, count(*) FILTER (WHERE slow) OVER w AS n, sum(CASE WHEN slow THEN nx * nx END) OVER w AS a, sum(CASE WHEN slow THEN nx * ny END) OVER w AS b, sum(CASE WHEN slow THEN ny * ny END) OVER w AS d,
      sum(CASE WHEN slow THEN nx * (nx * lat + ny * lon) END) OVER w AS p, sum(CASE WHEN slow THEN ny * (nx * lat + ny * lon) END) OVER w AS q FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id RANGE BETWEEN INTERVAL 2 DAY PRECEDING AND CURRENT ROW)),
    f AS (SELECT *, CASE WHEN n >= 2 AND abs(a * d - b * b) >= 1e-3 THEN (p * d - q * b) / (a * d - b * b) END AS x FROM s)
    SELECT event_id, n, CASE WHEN n < 5 THEN 'low' WHEN n <= 15 THEN 'medium' ELSE 'high' END AS confidence, round(last_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id), 3) AS anchor FROM f""".replace("ORDER BY ts, event_id RANGE", "ORDER BY ts RANGE"),
)
def anchor_watch(spark, d):
    """The anchor point of the slow positions of the last two days at each event; with fewer than two the one before is kept."""
    nx, ny = -F.sin(F.radians("value")), F.cos(F.radians("value"))
    c = nx * (C("event_id") % 100) / F.lit(100.0) + ny * (C("event_id") % 37) / F.lit(37.0)
    slow = C("event_id") % 4 != 1
    seconds = F.unix_micros(C("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy(seconds).rangeBetween(-2 * 86_400_000_000, 0)
    total = lambda v: F.sum(F.when(slow, v)).over(w)
    e = read(spark, d, "events").select("user_id", "event_id", "ts", F.count(F.when(slow, 1)).over(w).alias("n"), total(nx * nx).alias("a"), total(nx * ny).alias("b"), total(ny * ny).alias("d"), total(nx * c).alias("p"), total(ny * c).alias("q"))
    det = C("a") * C("d") - C("b") * C("b")
    x = F.when((C("n") >= 2) & (F.abs(det) >= 1e-3), (C("p") * C("d") - C("q") * C("b")) / det)
    held = F.last(C("x"), ignorenulls=True).over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    e = e.withColumn("x", x)
    return e.select("event_id", "n", F.when(C("n") < 5, "low").when(C("n") <= 15, "medium").otherwise("high").alias("confidence"), F.round(held, 3).alias("anchor"))
