"""Live state: batch twins over whole tables, micro-batches of any size, and silent keys that leave the state."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from brackwater.plans import catalog
from brackwater.streaming import buckets, conflicts, keyed, live

catalog.load()
DATA = "/root/testdata/sf0.001"
START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def stream(spark, rows, slices, columns):
    df = spark.createDataFrame([(i, k, START + dt.timedelta(hours=h), *more) for i, (k, h, *more) in enumerate(rows)], f"event_id long, user_id long, ts timestamp, {columns}")
    return keyed.in_slices(df, "ts", slices)


def test_dwell_is_that_of_the_batch_twin(spark):
    rows = lambda name: {(r.event_id, r.stable) for r in catalog.QUERIES[name](spark, DATA).select("event_id", "stable").collect()}
    assert rows("live_dwell") == rows("dwell_bands")


@pytest.mark.parametrize("slices", [1, 5])
def test_roles_go_stale_by_timer(spark, slices):
    rows = [(1, 0, "wind"), (1, 1, "wind"), (1, 2, "log"), (2, 0, "wind"), (1, 90, "log"), (3, 200, "wind"), (3, 230, "wind")]
    out, progress = live.finished(live.kept_live(stream(spark, rows, slices, "role string"), "user_id", live.Freshness("ts", "event_id", "role", 3600 * 5), "10 hours"), "fresh")
    hours = {(r.key, r.role, (r.at.replace(tzinfo=dt.UTC) - START).total_seconds() / 3600, r.fresh) for r in out.collect()}
    assert hours == {
        (1, "wind", 0, True), (1, "wind", 6, False), (1, "log", 2, True), (1, "log", 7, False), (1, "log", 90, True), (1, "log", 95, False),
        (2, "wind", 0, True), (2, "wind", 5, False), (3, "wind", 200, True), (3, "wind", 205, False), (3, "wind", 230, True),
    }
    # Vessels 1 and 2 have left; what is held of 3 is a role and a timer.
    assert progress[-1]["numRowsTotal"] <= 4 and progress[-1]["numRowsTotal"] < max(p["numRowsTotal"] for p in progress[:-1])


def test_anchors_are_let_go_after_silence(spark):
    fixes = [(0.0, 0.0, 45.0), (0.0, 2.0, 315.0)]
    rows = [(1, h, *fixes[h % 2], True) for h in range(6)] + [(1, 100, 0.0, 0.0, 10.0, True), (1, 101, 0.0, 0.0, 20.0, False), (2, 120, *fixes[0], True), (2, 200, *fixes[1], True)]
    out, progress = live.finished(live.kept_live(stream(spark, rows, 4, "lat double, lon double, heading double, slow boolean"), "user_id", live.AnchorWatch("ts", "event_id", "lat", "lon", "heading", "slow", 86_400, 86_400 * 2), "12 hours"), "anchors")
    got = sorted(out.collect(), key=lambda r: (r.key, r.at, r.watched is False))
    assert [r.tie for r in got if r.key == 1 and r.watched] == [0, 1, 2, 3, 4, 5, 6, 7]
    gone = [(r.key, (r.at.replace(tzinfo=dt.UTC) - START).total_seconds() / 3600, r.n) for r in got if not r.watched]
    assert gone == [(1, 5.0, 6), (1, 101.0, 1), (2, 120.0, 1)]
    first = next(r for r in got if r.tie == 1)
    assert round(first.x, 6) == 1.0 and round(first.y, 6) == 1.0 and next(r for r in got if r.tie == 0).x is None
    assert next(r for r in got if r.tie == 6).x is None  # the point of the stay before is not kept
    assert progress[-1]["numRowsTotal"] < max(p["numRowsTotal"] for p in progress)


def test_retention_is_emptied_and_nulls_are_passed(spark):
    rows = [(1, 0, 1.0), (1, 1, None), (1, 2, 3.0), (1, 30, 5.0), (2, 0, 9.0), (3, 400, 1.0), (3, 401, 1.0)]
    out, progress = live.finished(live.kept_live(stream(spark, rows, 3, "value double"), "user_id", live.Retained("ts", "event_id", "value", 3600 * 24), "1 hour"), "kept")
    got = {r.tie: (r.n, r.mean) for r in out.collect()}
    assert got == {0: (1, 1.0), 1: (1, 1.0), 2: (2, 2.0), 3: (1, 5.0), 4: (1, 9.0), 5: (1, 1.0), 6: (2, 1.0)}
    assert progress[-1]["numRowsTotal"] < max(p["numRowsTotal"] for p in progress)


def test_a_silent_key_begins_anew(spark):
    rows = [(1, 0, 10.0), (1, 1, 11.0), (1, 500, 11.0), (2, 900, 1.0), (2, 901, 2.0)]
    taken = lambda silent: {r.event_id for r in keyed.finished(keyed.deadband(stream(spark, rows, 3, "value double"), "user_id", "ts", "value", 5.0, silent=silent), "deadband").collect()}
    assert taken(3600 * 100) == {0, 2, 3} and taken(3600 * 10_000) == {0, 3}
    e = stream(spark, [(1, 0, "a", 1.0), (1, 1, "b", 2.0), (1, 500, "b", 3.0), (1, 501, "a", 4.0)], 2, "path string, value double")
    out = keyed.finished(keyed.latest(e, "user_id", "ts", "path", "value", ["a", "b"], silent=3600 * 100), "latest")
    assert sorted((r.a, r.b) for r in out.collect()) == [(1.0, 2.0), (4.0, 3.0)]


def test_nothing_comes(spark):
    e = keyed.in_slices(spark.createDataFrame([], "event_id long, user_id long, ts timestamp, value double"), "ts", 2)
    out, _ = live.finished(live.kept_live(e, "user_id", live.Retained("ts", "event_id", "value", 60), "1 hour"), "none")
    assert out.count() == 0 and out.filter(F.col("tie").isNull()).count() == 0


@pytest.mark.parametrize("lat", [0.0, 60.0, 80.0, 89.99])
def test_conflicts_at_any_latitude(spark, lat):
    """All pairs in conflict are met, near the pole and over the date line, whatever the radii."""
    import math
    import random

    from brackwater.plans import live_queries

    rng = random.Random(3)
    rows = []
    for k in range(60):
        north, east = rng.uniform(-900, 900), rng.uniform(-900, 900)
        rows.append((k, lat + math.degrees(north / 6371000) * (1 if lat < 89 else -1), (180 + math.degrees(east / (6371000 * math.cos(math.radians(lat)))) + 180) % 360 - 180, rng.uniform(20, 400), rng.uniform(8, 20)))

    def distance(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371000 * math.asin(min(1, math.sqrt(h)))

    want = set()
    for a in rows:
        for b in rows:
            if a[0] != b[0]:
                larger, smaller, boat, d = max(a[3], b[3]), min(a[3], b[3]), (a if a[3] <= b[3] else b)[4], distance(a, b)
                if larger >= d + smaller - boat or d <= larger:
                    want.add((a[0], b[0]))
    got = {(r.a, r.b) for r in live_queries.conflicting(spark.createDataFrame(rows, "k long, lat double, lon double, radius double, boat double")).collect()}
    assert got == want and len(want) > 20


def test_states_follow_every_micro_batch(spark):
    """After each micro-batch the states are those of a batch over all that had come by then."""
    from brackwater.plans import state_queries

    rows = sorted(spark.read.parquet(f"{DATA}/events.parquet").select("user_id", "ts", "value").collect(), key=lambda r: r.ts)
    low, high = rows[0].ts, rows[-1].ts
    got = {}
    for r in state_queries.near_misses(spark, DATA).collect():
        got.setdefault(r.batch, {})[r.vessel] = (r.worst, r.n)
    for number in range(4):
        want = {}
        end = low + (high - low) * (number + 1) / 4
        come = [r for r in rows if number == 3 or r.ts < end]
        for i, a in enumerate(come):
            for b in come[i + 1 :]:
                if (b.ts - a.ts).total_seconds() > 1800:
                    break
                gap = abs(a.value - b.value)
                if a.user_id != b.user_id and a.value // 10 == b.value // 10 and gap <= 2:
                    for v in (a.user_id, b.user_id):
                        worst, n = want.get(v, (0, 0))
                        want[v] = (max(worst, 2 if gap <= 0.5 else 1), n + 1)
        assert got.get(number, {}) == want, number
    assert got[3]


def test_conflicts_are_counted_in_blocks(spark, monkeypatch):
    """A crowded cell is many blocks; counts are those of all pairs, of which those of held events alone do not count again."""
    import random

    monkeypatch.setattr(conflicts, "SIZE", 40)
    monkeypatch.setattr(conflicts, "STRIP", 7)
    rng = random.Random(2)
    rows = [(rng.randrange(60), START + dt.timedelta(minutes=rng.choice([0, 30, 60, rng.random() * 90])), v, int(v // 10), rng.random() < 0.5) for v in (rng.randrange(80) / 4 for _ in range(400))]
    want = {}
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            gap = abs(a[2] - b[2])
            if a[0] != b[0] and a[3] == b[3] and gap <= 2 and abs(a[1] - b[1]) <= dt.timedelta(minutes=30) and (a[4] or b[4]):
                for v in (a[0], b[0]):
                    worst, n = want.get(v, (0, 0))
                    want[v] = max(worst, 2 if gap <= 0.5 else 1), n + 1
    events = spark.createDataFrame(rows + [(None, START, 1.0, 0, True), (1, None, 1.0, 0, True), (1, START, None, None, True)], "vessel long, ts timestamp, value double, cell long, fresh boolean")
    assert {r.vessel: (r.worst, r.n) for r in conflicts.counted(events, 30, 2.0, 0.5).collect()} == want


def test_pairs_meet_by_time_and_cell(spark):
    """All pairs within half an hour, also over the borders of slots; time is a key of the join, not only a filter after it."""
    rows = [(i, START + dt.timedelta(minutes=m), c) for i, (m, c) in enumerate([(0, 1), (29, 1), (30, 1), (31, 1), (59, 1), (60, 1), (61, 2), (90, 1), (91, 2), (-1, 1), (-30, 1), (-31, 1)])]
    e = spark.createDataFrame(rows, "vessel long, ts timestamp, cell long")
    found = conflicts.paired(e, e, "cell", "ts", 30, "1 day")
    got = [(r.a.vessel, r.b.vessel) for r in found.collect()]
    assert sorted(got) == sorted((a, b) for a, s, c in rows for b, t, q in rows if a < b and c == q and abs(s - t) <= dt.timedelta(minutes=30))
    assert "slot" in found._jdf.queryExecution().optimizedPlan().toString()


def test_keys_share_a_state(spark):
    """Many keys are few states, whatever their number, and none mixes with another."""
    rows = [(k, h, float(k)) for h in (0, 1, 40) for k in range(3000)]
    e = lambda: stream(spark, rows, 2, "value double")
    out, progress = live.finished(live.kept_live(e(), "user_id", live.Retained("ts", "event_id", "value", 3600 * 24), "1 hour"), "shared")
    assert max(p["numRowsTotal"] for p in progress) <= 4 * buckets.COUNT
    assert {(r.key, r.n, r.mean) for r in out.collect()} == {(k, n, float(k)) for k in range(3000) for n in (1, 2)}
    fired = keyed.finished(keyed.cooldown(e(), "user_id", "ts", 7200), "fired").collect()
    assert len(fired) == 6000 and {r.event_id for r in fired} == {*range(3000), *range(6000, 9000)}
