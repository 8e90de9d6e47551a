"""Profile queries: customers stand for devices, their orders for the groups and runs of an extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import matching
from ..operators import profiles as P
from ..sources.tables import read
from .catalog import query

C = F.col


def nested(spark, d):
    """(device, surfaces: array of (label, path), speaks: array, needs: array, confidence) from customers and their orders."""
    o = read(spark, d, "orders").groupBy(C("o_custkey").alias("device")).agg(
        F.collect_list(F.when(C("o_orderstatus") == "F", F.struct(C("o_orderpriority").alias("label"), C("o_orderkey").alias("path")))).alias("surfaces"),
        F.collect_set(F.when(C("o_orderkey") % 3 == 0, C("o_orderpriority"))).alias("speaks"),
        F.collect_set(F.when(C("o_orderkey") % 11 == 0, C("o_orderstatus"))).alias("needs"),
    )
    c = read(spark, d, "customer").select(C("c_custkey").alias("device"), (C("c_acctbal") / 10000).alias("confidence"))
    none = F.array().cast("array<string>")
    return c.join(o, "device", "left").withColumn("speaks", F.coalesce("speaks", none)).withColumn("needs", F.coalesce("needs", none))


@query(
    "profile_flags",
    """WITH o AS (SELECT o_custkey AS device, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_surf, count(DISTINCT CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END) AS n_speaks,
      count(DISTINCT CASE WHEN o_orderkey % 11 = 0 THEN o_orderstatus END) AS n_needs FROM orders GROUP BY o_custkey),
    p AS (SELECT c_custkey AS device, c_acctbal / 10000 AS confidence, coalesce(n_surf, 0) AS n_surf, coalesce(n_speaks, 0) AS n_speaks, coalesce(n_needs, 0) AS n_needs FROM customer LEFT JOIN o ON device = c_custkey)
    SELECT device, 'action_without_surface' AS flag, 'blocking' AS severity, 'control_surfaces' AS path FROM p WHERE n_surf = 0
    UNION ALL SELECT device, 'speaks_but_inert', 'blocking', 'networks.speaks' FROM p WHERE n_speaks > 0 AND n_surf = 0
    UNION ALL SELECT device, 'dangling_needed_for', 'warning', 'requires_devices[' || n_needs::VARCHAR || ']' FROM p WHERE n_needs > 1
    UNION ALL SELECT device, 'low_confidence_profile', 'warning', 'confidence' FROM p WHERE confidence < 0.06""",
)
def profile_flags(spark, d):
    surfaces = F.coalesce(F.size("surfaces"), F.lit(0))
    surfaces = F.when(surfaces < 0, 0).otherwise(surfaces)
    rules = [
        ("action_without_surface", "blocking", surfaces == 0, F.lit("control_surfaces")),
        ("speaks_but_inert", "blocking", (F.size("speaks") > 0) & (surfaces == 0), F.lit("networks.speaks")),
        ("dangling_needed_for", "warning", F.size("needs") > 1, F.concat(F.lit("requires_devices["), F.size("needs").cast("string"), F.lit("]"))),
        ("low_confidence_profile", "warning", C("confidence") < 0.06, F.lit("confidence")),
    ]
    return P.flags(nested(spark, d), "device", rules)


@query(
    "stage_gate",
    """WITH o AS (SELECT c_custkey AS device, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_surf, count(o_orderkey) FILTER (WHERE o_orderkey % 3 = 0) AS n_speaks FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey),
    b AS (SELECT device, (CASE WHEN n_surf = 0 THEN 1 + CASE WHEN n_speaks > 0 THEN 1 ELSE 0 END ELSE 0 END)::BIGINT AS blocking FROM o) SELECT device, blocking, blocking = 0 AS passes FROM b""",
)
def stage_gate(spark, d):
    """Every profile, those without any flag too."""
    profiles = read(spark, d, "customer").select(C("c_custkey").alias("device"))
    return P.gate(profiles, profile_flags(spark, d), "device")


@query(
    "reduce_profiles",
    """SELECT o_custkey AS device, bool_or(o_orderstatus = 'P') AS flag, max_by(o_orderpriority, {'l': length(o_orderpriority), 'k': o_orderkey}) AS version, max(o_totalprice) AS confidence,
    coalesce(string_agg(o_orderstatus, ' | ' ORDER BY o_orderkey, o_orderstatus) FILTER (WHERE o_orderkey % 4 = 0), '') AS notes, count(*) AS n_groups FROM orders GROUP BY o_custkey""",
)
def reduce_profiles(spark, d):
    o = read(spark, d, "orders")
    note = F.when(C("o_orderkey") % 4 == 0, C("o_orderstatus")).otherwise("")
    items = o.select(C("o_custkey").alias("device"), C("o_orderkey").alias("group_no"), (C("o_orderstatus") == "P").alias("flag"), C("o_orderpriority").alias("version"), C("o_totalprice").alias("confidence"), note.alias("note"))
    return P.reduce_groups(items, "device")


@query(
    "vote_runs",
    """WITH v AS (SELECT o_custkey AS device, CASE WHEN o_totalprice > 150000 THEN 'true' ELSE 'false' END AS value, o_orderkey AS run FROM orders),
    n AS (SELECT device, value, count(*) AS n, min(run) AS f FROM v GROUP BY device, value)
    SELECT device, max_by(value, {'n': n, 't': value = 'true', 'f': -f}) AS chosen, count(*) = 1 OR 2 * max(n) > sum(n) AS stable, max(n)::VARCHAR || '/' || sum(n)::VARCHAR AS margin FROM n GROUP BY device""",
)
def vote_runs(spark, d):
    value = F.when(C("o_totalprice") > 150000, "true").otherwise("false")
    return P.vote(read(spark, d, "orders").select(C("o_custkey").alias("device"), C("o_orderkey").alias("run"), value.alias("value")), "device")


@query(
    "partition_batches",
    "SELECT source, doc_id, ((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 8)::INTEGER AS group_no FROM documents",
)
def partition_batches(spark, d):
    return P.partition_batches(read(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", 8)


@query(
    "resolve_requirements",
    """WITH e AS (SELECT n_nationkey AS device, n_nationkey AS ordinal, n_name AS model, r_name AS family FROM nation JOIN region ON r_regionkey = n_regionkey),
    q AS (SELECT c_custkey AS req_id, ' ' || lower(c_name || ' needs ' || CASE WHEN c_custkey % 3 = 0 THEN n_name WHEN c_custkey % 3 = 1 THEN r_name || ' parts' ELSE 'a cable' END) || ' ' AS t
      FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
    h AS (SELECT req_id, device, ordinal, 1 AS tier FROM q JOIN e ON contains(t, lower(model)) UNION ALL SELECT req_id, device, ordinal, 2 FROM q JOIN e ON contains(t, lower(family)))
    SELECT req_id, b.device AS device, b.tier::INTEGER AS tier FROM (SELECT req_id, min({'tier': tier, 'ordinal': ordinal, 'device': device}) AS b FROM h GROUP BY req_id)""",
)
def resolve_requirements(spark, d):
    n = read(spark, d, "nation").join(read(spark, d, "region"), C("r_regionkey") == C("n_regionkey"))
    equipment = n.select(C("n_nationkey").alias("device"), C("n_nationkey").alias("ordinal"), C("n_name").alias("model"))
    families = n.select(C("r_name").alias("family"), C("n_nationkey").alias("device"))
    named = F.when(C("c_custkey") % 3 == 0, C("n_name")).when(C("c_custkey") % 3 == 1, F.concat("r_name", F.lit(" parts"))).otherwise("a cable")
    q = read(spark, d, "customer").join(n, C("n_nationkey") == C("c_nationkey")).select(C("c_custkey").alias("req_id"), F.concat("c_name", F.lit(" needs "), named).alias("text"))
    return P.resolve_requirements(q, equipment, families)


#: Words for kinds of requirements, tried in this order; fixed values.
TOOL = r"(?i)\b(?:configuration\s+tool|config\s+tool|commissioning\s+tool|setup\s+tool|programming\s+tool)\b|\bmasteradjust\b"
APP = r"(?i)\b(?:app|apps|software)\b|\bvictronconnect\b|\bmasteradjust\b"
CABLE = r"(?i)\b(?:cable|cord|wire|dongle|usb\s+interface|smart\s+dongle|connector\s+kit|deutsch\s+connector)\b"
NEEDS = ["MasterAdjust software", "a setup  tool", "the VictronConnect app", "software dongle", "USB cable", "Class T fuse", "a wired remote", "an app with cable", ""]
KINDS = ["commissioning_tool", "commissioning_tool", "software_app", "cable_or_consumable", "cable_or_consumable", "device", "device", "cable_or_consumable", "device"]


@query("requirement_kinds", "SELECT p_partkey, kind FROM part JOIN (VALUES " + ", ".join(f"({i}, '{k}')" for i, k in enumerate(KINDS)) + ") v(i, kind) ON i = p_partkey % 9")
def requirement_kinds(spark, d):
    """Tools before apps (some are both), apps unless a cable is meant, then cables; all else is a device."""
    t = F.get(F.array(*[F.lit(x) for x in NEEDS]), (C("p_partkey") % len(NEEDS)).cast("int"))
    kind = F.when(t.rlike(TOOL), "commissioning_tool").when(t.rlike(APP) & ~t.rlike(CABLE), "software_app").when(t.rlike(CABLE), "cable_or_consumable").otherwise("device")
    return read(spark, d, "part").select("p_partkey", kind.alias("kind"))


@query(
    "similar_part_names",
    """WITH n AS (SELECT DISTINCT lower(trim(p_name)) AS name FROM part), t AS (SELECT name, list_distinct(list_transform(list_filter(string_split_regex(name, '[^a-z0-9]+'), lambda w: w <> ''), lambda w: CASE WHEN w IN ('display', 'displays', 'screens') THEN 'screen' ELSE w END)) AS t FROM n)
    SELECT a.name AS a, b.name AS b FROM t a JOIN t b ON a.name < b.name AND len(a.t) > 0 AND len(b.t) > 0 AND len(list_intersect(a.t, b.t)) / least(len(a.t), len(b.t)) >= 0.5""",
)
def similar_part_names(spark, d):
    """Pairs of different part names that are similar at a half of their tokens. Names are made unique first, and only those
    that share a token meet, each pair at its first shared token."""
    names = read(spark, d, "part").select(F.lower(F.trim("p_name")).alias("name")).distinct().withColumn("t", matching.canonical(matching.tokens(C("name"))))
    token = names.select("name", "t", F.explode("t").alias("w"))
    a, b = token.alias("a"), token.alias("b")
    met = a.join(b, (C("a.w") == C("b.w")) & (C("a.name") < C("b.name")) & (C("a.w") == F.get(F.array_intersect("a.t", "b.t"), F.lit(0))))
    return met.filter(matching.similar(C("a.name"), C("b.name"), 50)).select(C("a.name").alias("a"), C("b.name").alias("b"))
