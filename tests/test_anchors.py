"""States of anchored vessels against a loop over all pairs, on a crowded place and over the globe."""

import math
import random

from brackwater.operators import anchors


def loop(rows):
    out = {}
    for k, lat, lon, r, boat in rows:
        for q, lat2, lon2, r2, boat2 in rows:
            if k == q:
                continue
            h = math.sin(math.radians(lat2 - lat) / 2) ** 2 + math.cos(math.radians(lat)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon) / 2) ** 2
            d = 2 * 6_371_000.0 * math.asin(math.sqrt(min(1.0, h)))
            sev = 2 if max(r, r2) >= d + min(r, r2) - (boat if r <= r2 else boat2) else 1 if d <= max(r, r2) else 0
            if sev:
                worst, n = out.get(k, (0, 0))
                out[k] = max(worst, sev), n + 1
    return out


def test_states_are_those_of_all_pairs(spark):
    rng = random.Random(4)
    rows = [(i, rng.random() / 500, rng.random() / 500, 20.0 + i % 60, 8.0 + i % 15) for i in range(700)]
    rows += [(1000 + i, 89.9999, float(i), 30.0, 9.0) for i in range(0, 360, 7)] + [(2000 + i, 10.0, 180.0 - 0.0001 * i if i % 2 else -180.0 + 0.0001 * i, 25.0, 8.0) for i in range(9)]
    v = spark.createDataFrame(rows, "k long, lat double, lon double, radius double, boat double")
    # A crowded place is several blocks, which go to several tasks.
    assert anchors.met(v, v, lambda a, b: {"n": [len(a["k"])]}, "n long").rdd.getNumPartitions() > 1
    assert {r.k: (r.worst, r.conflicts) for r in anchors.states(v).collect()} == loop(rows)


def test_boats_meet_at_one_wind(spark):
    rows = [(1, 0.0, 0.0, 40.0, 8.0, [0.0, 1.0], [0.0, 1.0]), (2, 0.0, 0.0003, 40.0, 8.0, [5.0, 1.0], [5.0, 1.0]), (3, 0.0, -0.0003, 40.0, 8.0, [9.0, 7.0], [9.0, 7.0])]
    v = spark.createDataFrame(rows, "k long, lat double, lon double, radius double, boat double, lats array<double>, lons array<double>")
    assert {r.k: r.met for r in anchors.brought_together(v, v.filter("k <> 2")).collect()} == {1: True, 3: False}
