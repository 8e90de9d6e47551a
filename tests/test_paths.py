"""Minimax ways against a plain search on random graphs, and the devices of a way against the networks they share."""

import heapq
import random
from collections import defaultdict

from brackwater.operators import devices, graph, registry
from brackwater.plans import catalog, device_queries

catalog.load()
DATA = "/root/testdata/sf0.001"


def plain_costs(edges, source, first):
    """Least greatest edge to every node: nodes are settled in the order of their cost."""
    out, heap = {}, [(first, source)]
    near = defaultdict(list)
    for a, b, c in edges:
        near[a].append((b, c))
    while heap:
        cost, node = heapq.heappop(heap)
        if node not in out:
            out[node] = cost
            for b, c in near[node]:
                heapq.heappush(heap, (max(cost, c), b))
    return out


def test_ways_of_random_graphs(spark):
    rng = random.Random(6)
    edges, sources, want = [], [], {}
    for g in range(300):
        n = rng.randrange(2, 12)
        own = [(f"v{rng.randrange(n)}", f"v{rng.randrange(n)}", rng.randrange(5)) for _ in range(rng.randrange(1, 30))]
        edges += [(g, *e) for e in own]
        first = rng.randrange(3)
        sources.append((g, "v0", first))
        want |= {(g, "v0", node): cost for node, cost in plain_costs([e for e in own if e[0] != e[1]], "v0", first).items()}
    got = graph.minimax_paths(spark.createDataFrame(edges, "scope int, a string, b string, cost int"), spark.createDataFrame(sources, "scope int, source string, cost int")).collect()
    assert {(r.scope, r.source, r.node): r.cost for r in got} == want
    cheapest = defaultdict(lambda: 99)
    for g, a, b, c in edges:
        cheapest[g, a, b] = min(cheapest[g, a, b], c)
    begin = {g: c for g, _, c in sources}
    for r in got:
        assert r.path[0] == "v0" and r.path[-1] == r.node and len(set(r.path)) == len(r.path)
        assert max([begin[r.scope], *(cheapest[r.scope, a, b] for a, b in zip(r.path, r.path[1:], strict=False))]) == r.cost
    assert graph.minimax_paths(spark.createDataFrame([], "scope int, a string, b string, cost int"), spark.createDataFrame(sources[:2], "scope int, source string, cost int")).count() == 2


def test_devices_of_a_way_share_networks(spark):
    _, speaks, bridges, _, _ = device_queries.graph_of(spark, DATA)
    on, relays = defaultdict(set), set()
    for r in speaks.collect():
        on[r.vessel, r.device].add(r.net)
    for r in bridges.collect():
        on[r.vessel, r.device] |= {r.source, r.target}
        relays.add((r.vessel, r.device))
    weakest = {(r.vessel, r.target, r.hub): r.weakest for r in catalog.QUERIES["path_provenance"](spark, DATA).collect()}
    rows = catalog.QUERIES["path_devices"](spark, DATA).collect()
    assert {(r.vessel, r.target, r.hub) for r in rows} == set(weakest) and rows
    names = ["self_claimed", "counterpart_claim", "diagram_inference"]
    for r in rows:
        way = [int(x) for x in r.devices.split(">")]
        assert way[0] == r.hub and way[-1] == r.target
        assert all(on[r.vessel, a] & on[r.vessel, b] for a, b in zip(way, way[1:], strict=False))
        assert all((r.vessel, x) in relays for x in way[1:-1])
        assert max(x % 3 for x in way) == names.index(weakest[r.vessel, r.target, r.hub])


def test_deep_packs_and_long_chains(spark):
    """Depth is no cycle, and a chain is followed to its end."""
    chain = spark.createDataFrame([(i, i + 1, "a") for i in range(24)], "parent long, child long, ord string")
    assert registry.expand(chain, spark.createDataFrame([(0,)], "root long")).agg({"depth": "max"}).first()[0] == 24
    asked = spark.createDataFrame([(24, 0), (0, 24)], "parent long, child long")
    assert {(r.parent, r.refused) for r in registry.closes_cycle(chain, asked).collect()} == {(24, True), (0, False)}


def test_a_bridge_is_entered_by_the_networks_that_it_joins(spark):
    """Device 2 speaks net a but joins b and c, so that the way from a to c is by device 3, whose claim is weak."""
    speaks = spark.createDataFrame([(7, 1, "a"), (7, 2, "a"), (7, 4, "c")], "vessel int, device long, net string")
    bridges = spark.createDataFrame([(7, 2, "b", "c"), (7, 3, "a", "c")], "vessel int, device long, source string, target string")
    tiers = spark.createDataFrame([(7, d, "weak" if d == 3 else "strong") for d in (1, 2, 3, 4)], "vessel int, device long, tier string")
    got = devices.device_paths(spark.createDataFrame([(7, 4, 1)], "vessel int, target long, hub long"), speaks, bridges, tiers, {"strong": 0, "weak": 1}).collect()
    assert [(r.weakest, list(r.devices)) for r in got] == [("weak", [1, 3, 4])]


def test_settled_starts_are_let_go(spark, monkeypatch):
    """A child whose parents are found is followed no further; one that is refused nothing is followed to the end."""
    rows = []
    monkeypatch.setattr(registry, "written", lambda df, name="step", f=registry.written: [out := f(df, name), rows.append((name, out.count()))][0])
    chain = spark.createDataFrame([(i, i + 1) for i in range(8)], "parent long, child long")
    asked = spark.createDataFrame([(i + 1, i) for i in range(8)] + [(0, 5), (3, 3)], "parent long, child long")
    got = {(r.parent, r.child): r.refused for r in registry.closes_cycle(chain, asked).collect()}
    assert got == {(i + 1, i): True for i in range(8)} | {(0, 5): False, (3, 3): True}
    assert [n for name, n in rows if name == "reach"] == [8, 8, 1, 1, 0]
