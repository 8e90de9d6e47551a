"""All pairs of keys that many rows share, in blocks, against plain loops."""

from collections import Counter

from brackwater.operators import blocks, devices
from brackwater.plans import catalog

catalog.load()


def test_pairs_are_all_pairs(spark):
    left = [(k, i) for k, n in ((1, 1300), (2, 3), (3, 1), (4, 7)) for i in range(n)] + [(2, 0)]
    right = [(k, -i) for k, n in ((1, 600), (2, 5), (3, 0), (5, 9)) for i in range(n)]
    got = blocks.paired(spark.createDataFrame(left, "k int, a long"), spark.createDataFrame(right, "k int, b long"), ["k"])
    assert got.rdd.getNumPartitions() > 1
    assert Counter(tuple(r) for r in got.collect()) == Counter((k, a, b) for k, a in left for m, b in right if k == m)
    assert blocks.paired(spark.createDataFrame([], "k int, a long"), spark.createDataFrame(right, "k int, b long"), ["k"]).count() == 0


def test_control_paths_tell_every_hub(spark, tmp_path):
    spark.createDataFrame([(i, 1, 6000.0) for i in range(3)] + [(9, 2, 6000.0), (10, 1, 10.0)], "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(5, 1, 9500.0), (6, 2, 9500.0), (7, 1, 0.0)], "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    got = {(r["target"], r["hub"]) for r in catalog.QUERIES["control_paths"](spark, str(tmp_path)).collect()}
    assert got == {(1000005, 0), (1000005, 1), (1000005, 2), (1000006, 9)}


def test_requirements_meet_two_devices_a_class_and_rejected_ones_all(spark):
    """The one that asks is passed over, rows do not grow with pairs, and no near miss is lost or told twice."""
    eq = [(1, i, f"model{i}", "bolt economy" if i % 2 else "plain", i % 3 == 0, i % 4 == 0) for i in range(40)]
    equipment = spark.createDataFrame(eq, "vessel int, device long, model string, hay string, switch_like boolean, remote_path boolean")
    req = spark.createDataFrame([(1, i, i, "safety relay or a safety relay") for i in range(40)] + [(1, 100 + i, i, f"economy kit, model{i}0") for i in range(4)], "vessel int, req_id long, device long, text string")
    families = spark.createDataFrame([("economy", "economy kit", "economy")], "family string, phrase string, token string")
    classes = spark.createDataFrame([(0, "relay", "safety relay", "bolt", True)], "class_ord int, class_id string, trigger string, token string, remote boolean")
    best, rejected = devices.resolved(req, equipment, families, classes)
    got = {r.req_id: (r.device, r.tier) for r in best.collect()}
    worth = {i: 1.0 if h.startswith("bolt") else 0.85 for _, i, _, h, s, p in eq if s and p}
    for i in range(40):
        assert got[i] == (min((d for d in worth if d != i), key=lambda d: (-worth[d], d)), 3)
    assert got[100] == (1, 2) and got[101] == (10, 1) and got[102] == (2 * 10, 1) and got[103] == (30, 1)
    rows = [(r.req_id, r.device) for r in rejected.collect()]
    near = [i for _, i, _, h, s, p in eq if (h.startswith("bolt") or s) and i not in worth]
    assert sorted(rows) == sorted((q, i) for q in range(40) for i in near if i != q)
