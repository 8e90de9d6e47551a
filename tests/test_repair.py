"""Profile repairs against a plain engine over lists, on profiles built at random; repaired ones are left alone and resolve."""

import random
import re

from brackwater.operators import repair
from brackwater.plans import validation_queries

COLUMNS = repair.COLUMNS
NOTES = ["Control devices via the network", "It can be switched remotely", "The battery cable must be fused", "plain note", "Fit a fuse near the DC supply", "commands various lights"]
USES = [None, "control_surfaces[0]", "control_surfaces[1]", "requires_devices[1]"]


def made(rng, profile):
    rows = []

    def add(kind, i, text, **more):
        rows.append({"profile": profile, "list": kind, "idx": i, "text": text, **{c: more.get(c) for c in COLUMNS[4:]}})

    for i in range(rng.randrange(5)):
        add("requires_devices", i, rng.choice(["Class T fuse", "class t fuse ", "remote panel", "usb cable"]), needed_for=rng.choice(USES))
    for i in range(rng.randrange(3)):
        add("control_surfaces", i, rng.choice(["Remote Panel", None, "app"]), optional=rng.choice([True, False, None]))
    if rng.random() < 0.6:
        add("data_roles", 0, "controllable_from_network")
    if rng.random() < 0.3:
        add("protected_by", 0, rng.choice(["breaker", "main fuse"]))
    for i in range(rng.randrange(6)):
        add("evidence", i, rng.choice(NOTES), section=rng.choice([None, "Setup"]), supports=rng.choice(["data_roles[0]", "requires_devices[0].text", "requires_devices[3]", "control_surfaces[1]", "other", None]))
    for i in range(rng.randrange(2)):
        add("derived_notes", i, "from evidence", source="derived", derived_from=rng.choice([f"evidence[{rng.randrange(6)}]", None]))
    return rows


def follow(rows, gone):
    """Without the elements in ``gone``: numbers and paths anew, and the elements that lose their ground."""
    stay = [dict(r) for r in rows if (r["list"], r["idx"]) not in gone]
    to, n = {}, {}
    for r in sorted(stay, key=lambda r: r["idx"]):
        if r["list"] == "data_roles":
            to[r["list"], r["idx"]] = r["idx"]
        else:
            to[r["list"], r["idx"]] = n.get(r["list"], 0)
            n[r["list"]] = n.get(r["list"], 0) + 1
    was, lost = {(r["list"], r["idx"]) for r in rows}, set()
    for r in stay:
        here = to[r["list"], r["idx"]]
        for p in repair.PATHS:
            m = re.match(r"([a-z_]+)\[(\d+)\](.*)$", r[p] or "")
            if m and (m[1], int(m[2])) in was:
                new = to.get((m[1], int(m[2])))
                r[p] = None if new is None else f"{m[1]}[{new}]{m[3]}"
                if new is None and ((p == "supports" and r["list"] == "evidence") or (p == "derived_from" and r["source"] == "derived")):
                    lost.add((r["list"], here))
        r["idx"] = here
    return stay, lost


def plain(rows):
    count, profile = 0, rows[0]["profile"]
    new = lambda kind, text, **more: {"profile": profile, "list": kind, "idx": 1 + max((r["idx"] for r in rows if r["list"] == kind), default=-1), "text": text, **{c: more.get(c) for c in COLUMNS[4:]}, "source": "derived"}

    def drop(gone):
        nonlocal rows, count
        while gone:
            count += len(gone)
            rows, gone = follow(rows, gone)

    while True:
        before = count
        own = [r for r in rows if r["list"] == "evidence" and r["supports"] == "data_roles[0]"]
        bad = [r for r in own if re.search(repair.COMMANDS, f"{r['text'] or ''} {r['section'] or ''}")]
        drop({("evidence", r["idx"]) for r in bad} | ({("data_roles", 0)} if bad and len(bad) == len(own) and any(r["list"] == "data_roles" for r in rows) else set()))
        seen, gone = set(), set()
        for r in sorted((r for r in rows if r["list"] == "requires_devices"), key=lambda r: r["idx"]):
            key = (r["text"].strip().lower(), r["needed_for"])
            gone |= {("requires_devices", r["idx"])} if key in seen else set()
            seen.add(key)
        drop(gone)
        needs = [r for r in rows if r["list"] == "requires_devices"]
        for s in sorted((r for r in rows if r["list"] == "control_surfaces" and r["optional"]), key=lambda r: r["idx"]):
            path, label = f"control_surfaces[{s['idx']}]", (s["text"] or "").strip().lower()
            if not any(r["needed_for"] == path or (label and label in r["text"].lower()) for r in needs):
                rows = [*rows, new("requires_devices", (s["text"] or "").strip() or "optional accessory", derived_from=path, needed_for=path)]
                count += 1
        if not any(r["list"] in ("supply_requirements", "protected_by") and "fuse" in r["text"].lower() for r in rows):
            for e in sorted((r for r in rows if r["list"] == "evidence"), key=lambda r: r["idx"]):
                if re.search(repair.FUSED, " ".join(x for x in (e["supports"], e["section"], e["text"]) if x)):
                    rows = [*rows, new("supply_requirements", e["text"].strip() if "fuse" in e["text"].lower() else repair.FUSE, derived_from=f"evidence[{e['idx']}]")]
                    count += 1
                    break
        if count == before:
            return rows, count


def test_repairs_are_those_of_a_plain_engine(spark):
    rng = random.Random(12)
    profiles = [p for p in (made(rng, k) for k in range(300)) if p]
    schema = "profile long, list string, idx int, text string, section string, supports string, derived_from string, needed_for string, source string, optional boolean"
    df = spark.createDataFrame([tuple(r[c] for c in COLUMNS) for p in profiles for r in p], schema)
    rows, log = repair.repaired(df)
    want = [plain(p) for p in profiles]
    got = sorted(repr(tuple(r)) for r in rows.select(*COLUMNS).collect())
    assert got == sorted(repr(tuple(r[c] for c in COLUMNS)) for rs, _ in want for r in rs)
    assert log.count() == sum(n for _, n in want)
    assert {r.repair for r in log.collect()} == {"polarity", "repeated", "surface_requires", "fuse", "orphaned"}
    again, nothing = repair.repaired(rows)
    assert nothing.count() == 0 and sorted(repr(tuple(r)) for r in again.select(*COLUMNS).collect()) == got
    # What is derived leads somewhere, but for paths that led nowhere before or were never given.
    start = {(r["profile"], r["list"], r["text"]) for p in profiles for r in p if r["source"] == "derived"}
    assert {(r.profile, r.list) for r in repair.ungrounded(rows).collect()} <= {(a, b) for a, b, _ in start}


def test_profiles_of_the_table(spark):
    df = validation_queries.talked_profiles(spark, "/root/testdata/sf0.001")
    by = {}
    for r in df.collect():
        by.setdefault(r.profile, []).append(r.asDict())
    rows, log = repair.repaired(df)
    want = [plain(p) for p in by.values()]
    assert sorted(repr(tuple(r)) for r in rows.select(*COLUMNS).collect()) == sorted(repr(tuple(r[c] for c in COLUMNS)) for rs, _ in want for r in rs)
    assert log.count() == sum(n for _, n in want) > 5
