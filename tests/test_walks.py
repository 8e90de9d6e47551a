"""Order-dependent walks, keyed streams and list unions against plain Python; graphs and NOT IN at their edges."""

import pytest
from pyspark.sql import functions as F

from brackwater.functions import headings, matching
from brackwater.operators import greedy, registry, relational, retrieval
from brackwater.plans import assembly_queries, catalog

catalog.load()
DATA = "/root/testdata/sf0.001"


def events(spark):
    rows = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", "user_id", "ts", "value").collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.ts, r.event_id)):
        by.setdefault(r.user_id, []).append(r)
    return by


def plain_deadband(rows, least):
    last, out = None, set()
    for r in rows:
        if last is None or abs(r.value - last) >= least:
            last = r.value
            out.add(r.event_id)
    return out


@pytest.mark.parametrize("name", ["deadband_values", "streamed_deadband"])
def test_deadband_takes_what_a_loop_takes(spark, name):
    want = set().union(*(plain_deadband(rows, 20.0) for rows in events(spark).values()))
    assert {r.event_id for r in catalog.QUERIES[name](spark, DATA).collect()} == want


def test_deadband_on_a_circle(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([350.0, 355.0, 2.0, 1.0, 341.0, None, 340.0])], "k string, i int, v double")
    assert sorted(r.i for r in greedy.deadband(df, "k", ["i"], "v", 10.0, 360.0).collect()) == [0, 2, 4]


def test_seams_stick_until_left(spark):
    want = {}
    for rows in events(spark).values():
        near = False
        for r in rows:
            gap = abs(r.value - 60)
            near = gap <= 4 or (near and gap <= 7)
            want[r.event_id] = near
    assert {r.event_id: r.near for r in catalog.QUERIES["sticky_seams"](spark, DATA).collect()} == want


def test_dwell_is_that_of_a_loop(spark):
    cuts, want = [10, 25, 60], {}
    for rows in events(spark).values():
        current = before = waiting = since = None
        for r in rows:
            band = sum(r.value >= c for c in cuts)
            jumped = before is not None and abs(r.value - before) >= 60
            before = r.value
            if current is None or band == current or jumped:
                current, waiting = band, None
            elif band != waiting:
                waiting, since = band, r.ts
            elif (r.ts - since).total_seconds() >= 6 * 3600:
                current, waiting = band, None
            want[r.event_id] = current
    assert {r.event_id: r.stable for r in catalog.QUERIES["dwell_bands"](spark, DATA).collect()} == want


def test_unions_meet_the_first_like_them(spark):
    got = catalog.QUERIES["united_actions"](spark, DATA).collect()
    texts = sorted({r.text for r in got})
    pairs = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    like = {(r.a, r.b) for r in pairs.filter(matching.similar(F.col("a"), F.col("b"))).collect()}
    by = {}
    for r in sorted(got, key=lambda r: r.k):
        items = by.setdefault(r.device, [])
        first = next((i for i in items if (i[1], r.text) in like), None)
        assert r.head == (first[0] if first else r.k) and r.conflict == bool(first and r.status != first[2])
        if first is None:
            items.append((r.k, r.text, r.status))
    assert any(r.head != r.k for r in got)


#: Pairs by what the rule is to say of them.
ALIKE = [
    ("Open the quick menu", "open quick menu"), ("Show the display settings", "show screen settings"), ("Check error codes", "review the alarms"), ("Check faults now", "the alarm codes"),
    ("Press the red button twice", "press red button"), (" Reset ", "reset"), ("a b c d e f g h i j", "a b c d e f g x y z"), ("read alarm list", "Alarm list"),
]
UNLIKE = [("Turn on the pump", "turn off the pump"), ("start engine", "stop engine"), ("", ""), (None, "x"), ("...", "..!"), ("a b c d e f x y z q", "a b c d e f g h i j"), ("unlock it all", "lock it all"), ("fill the tank", "wash the deck")]


@pytest.mark.parametrize("turned", [False, True])
def test_similarity_of_known_pairs(spark, turned):
    pairs = [(i, *(p[::-1] if turned else p)) for i, p in enumerate([*ALIKE, *UNLIKE])]
    df = spark.createDataFrame(pairs, "i int, a string, b string").select("i", matching.traits(F.col("a")).alias("p"), matching.traits(F.col("b")).alias("q"), matching.similar(F.col("a"), F.col("b")).alias("s"))
    for r in df.collect():
        plain = matching.similar_values(matching.values(r.p.asDict()), matching.values(r.q.asDict()))
        assert r.s == plain == (r.i < len(ALIKE)), pairs[r.i]


#: Chunks and the heading that the survey's rules T11 to T14 give them.
CHUNKS = [
    ("intro words\nSYSTEM OVERVIEW\n1.2 Setup of it\n3 Later", "1.2 Setup of it"),
    ("plain opening line here now\nSYSTEM OVERVIEW\nbody", "SYSTEM OVERVIEW"),
    ("AC PANEL BOARD\nMain switch of boat", "AC PANEL BOARD Main switch of boat"),
    ("## Engine controls\nare on the left side", "Engine controls are on the left side"),
    ("Engine controls:\nare on the left side", "Engine controls:"),
    ("D E\nRestart when\nthe alarm stops", "Restart when the alarm stops"),
    ("....\n12 34\nA Power off\nShort one", "Short one"),
    ("A B C D\nB caption of a figure\n", None),
    ("", None),
    (None, None),
    ("Select to view the list of things on board", None),
    ("This is a whole sentence of more than six words.\nBilge pumps and alarms of it", "Bilge pumps and alarms of it"),
    ("y" * 121 + "\nUsable line of five words", "Usable line of five words"),
    ("1 " + "z" * 118, "1 " + "z" * 118),
]


def test_headings_of_known_chunks(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CHUNKS)], "i int, t string").select("i", headings.guessed(F.col("t")).alias("h")).collect()
    assert {r.i: r.h for r in rows} == {i: h for i, (_, h) in enumerate(CHUNKS)}


def test_guessed_headings_keep_what_holds_of_all(spark):
    """Over a whole table: at most 200 characters, never junk, out of the text's own lines, and a numbered line wins over all."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    df = catalog.QUERIES["guessed_headings"](spark, DATA).withColumn("junk", headings.is_junk(F.col("heading")))
    got = df.collect()
    assert {r.doc_id for r in got} == set(docs)
    for r in got:
        if r.heading is None:
            continue
        flat = " ".join(docs[r.doc_id].replace("#", " ").split())
        assert 0 < len(r.heading) <= 200 and not r.junk and " ".join(r.heading.replace("#", " ").split()) in flat
    # The rule's first choice is found anew where a text gets a numbered line.
    more = spark.createDataFrame([(d, f"{t}\n7.1 Found before all others") for d, t in docs.items()], "doc_id long, text string")
    for r in more.select("text", headings.guessed(F.col("text")).alias("h"), headings.guessed(F.lit("7.1 x")).alias("one")).collect():
        assert headings_number(r.h) and r.one == "7.1 x"


def headings_number(line):
    return line is not None and line[0].isdigit()


def test_cycles_are_found_and_refused(spark):
    edges = spark.createDataFrame([(1, 2, "a"), (2, 3, "a"), (1, 3, "b"), (3, 4, "a"), (4, 5, "a"), (5, 3, "b"), (5, 6, "c")], "parent long, child long, ord string")
    assert {r.node for r in registry.cycle_core(edges).collect()} == {3, 4, 5}
    with pytest.raises(ValueError, match="cycle"):
        registry.expand(edges, spark.createDataFrame([(1,)], "root long"))
    tree = edges.filter("child <> 3 or parent <> 5")
    walk = [r.node for r in registry.expand(tree, spark.createDataFrame([(1,)], "root long")).orderBy("path").collect()]
    assert walk == [1, 2, 3, 4, 5, 6]  # the diamond's second way to 3 is not walked again
    asked = spark.createDataFrame([(6, 1), (1, 6), (4, 4)], "parent long, child long")
    assert {(r.parent, r.child): r.refused for r in registry.closes_cycle(tree, asked).collect()} == {(6, 1): True, (1, 6): False, (4, 4): True}


def test_not_in_knows_nulls(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    other = lambda *v: spark.createDataFrame([(x,) for x in v], "o int")
    got = lambda o: sorted(str(r.k) for r in relational.not_in(df, "k", o, "o").collect())
    assert got(other(2)) == ["1"] and got(other(2, None)) == [] and got(other()) == ["1", "2", "None"]


def test_many_questions_are_met_in_blocks(spark, monkeypatch):
    e = spark.read.parquet(f"{DATA}/embeddings.parquet")
    items = e.select(F.col("vec_id").alias("item_id"), F.col("label").alias("scope"), "embedding")
    asked = e.filter("vec_id % 3 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    once = sorted(map(tuple, retrieval.scoped_topk(items, asked, 3).select("query_id", "rank", "item_id").collect()))
    monkeypatch.setattr(retrieval, "FEW", 7)
    assert sorted(map(tuple, retrieval.scoped_topk(items, asked, 3).select("query_id", "rank", "item_id").collect())) == once


def plain_coalesced(groups, most):
    out = list(groups)
    while len(out) > most:
        pairs = [(a[1] + b[1], i) for i, (a, b) in enumerate(zip(out, out[1:], strict=False)) if not a[2] and not b[2]]
        if not pairs:
            break
        size, i = min(pairs)
        out[i : i + 2] = [(f"{out[i][0]}+{out[i + 1][0]}", size, False)]
    return sorted((n, s) for n, s, _ in out)


def test_groups_are_merged_as_by_a_loop(spark):
    by, got = {}, {}
    for r in assembly_queries.chapters(spark.read.parquet(f"{DATA}/orders.parquet")).orderBy("device", "ord").collect():
        by.setdefault(r.device, []).append((r.name, r.size, r.intro))
    for r in catalog.QUERIES["coalesced_groups"](spark, DATA).collect():
        got.setdefault(r.device, []).append((r.group_id, r.size))
    assert {k: sorted(v) for k, v in got.items()} == {k: plain_coalesced(v, 3) for k, v in by.items()}


def test_second_phase_is_the_nearest_to_each_heading(spark):
    """Every heading of a scope is stood for, or its mean's nearest chunk is one that another heading brought in."""
    import numpy as np

    got = catalog.QUERIES["phased_retrieval"](spark, DATA).collect()
    e = {r.vec_id: r for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    first = {r.item_id for r in got if r.phase == 1}
    assert len({r.item_id for r in got}) == len(got)
    unit = lambda v: np.array(v, float) / np.linalg.norm(v)
    for scope in {r.scope for r in got}:
        own = [i for i, r in e.items() if r.label == scope]
        missing = {i % 37 for i in own} - {i % 37 for i in own if i in first}
        brought = {r.item_id: r.heading for r in got if r.scope == scope and r.phase == 2}
        for h in missing:
            mean = unit(np.mean([np.array(e[i].embedding, float) for i in own if i % 37 == h], axis=0))
            score = {i: round(float(unit(e[i].embedding) @ mean), 6) for i in own if i not in first}
            best = max(score.values())
            tops = [i for i, s in score.items() if s >= best - 2e-6]
            assert any(brought.get(i, 99) <= h for i in tops)
        assert set(brought.values()) <= missing


def test_steps_are_not_broadcast(spark, monkeypatch):
    """However many steps there are, none is sent to the driver to be broadcast."""
    plans = []
    monkeypatch.setattr(registry, "written", lambda df, name, keep=registry.written: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, name))
    edges = spark.createDataFrame([(i, i // 2, "a") for i in range(2, 40)], "parent long, child long, ord string")
    assert registry.expand(edges, spark.range(1, 40).withColumnRenamed("id", "root")).count() == sum(i.bit_length() for i in range(1, 40))
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


@pytest.mark.parametrize("seed", range(2))
def test_walks_are_those_by_path(spark, seed):
    """The walk made from the lowest nodes up is the order of first paths, for roots with and without children, in graphs with diamonds."""
    import random

    rng = random.Random(seed)
    edges = {(p, c): o for p in range(25) for o, c in zip("abc", rng.sample(range(p + 1, 40), 3), strict=True) if rng.random() < 0.8}
    # A cycle that only roots that are not asked for lead to.
    rows = [(p, c, o) for (p, c), o in edges.items()] + [(100, 101, "a"), (101, 100, "a"), (101, 1, "b"), (102, 100, "a"), (102, 2, "b")]
    df = spark.createDataFrame(rows, "parent long, child long, ord string")
    roots = spark.createDataFrame([(i,) for i in (*range(0, 40, 2), 77)], "root long")
    want = {}
    for r in registry.expand(df, roots).orderBy("root", "path").collect():
        want.setdefault(r.root, []).append(r.node)
    assert {r.root: r.walk for r in registry.walks(df, roots).collect()} == want and want[77] == [77]
    for bad in (100, 102):
        with pytest.raises(ValueError, match="cycle"):
            registry.walks(df, spark.createDataFrame([(1,), (bad,)], "root long"))


def test_bundles_are_lists_when_they_are_shuffled(spark, monkeypatch):
    """No step of ``pack_expansion`` writes a row a pack and node, with its path."""
    names = []
    monkeypatch.setattr(registry, "written", lambda df, name, keep=registry.written: names.append(tuple(df.columns)) or keep(df, name))
    got = catalog.QUERIES["pack_expansion"](spark, DATA)
    assert ("node", "asked", "walk") in names and not any("path" in n for n in names)
    assert got.filter("root = 13").first().walk == "13,6,3,1,2,4" and got.filter("n_nodes <> size(split(walk, ','))").isEmpty()
