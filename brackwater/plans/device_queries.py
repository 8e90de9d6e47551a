"""Device-graph queries: parts stand for devices, their size for the vessel, lines for networks spoken and bridged."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import devices as D
from ..operators import predicates as P
from ..sources.shared import written
from ..sources.tables import read
from .catalog import query
from .predicate_queries import NETWORKS

C = F.col
#: Names under which networks are spoken of here; the eighth has no alias.
SPOKEN = ["NMEA 2000", "n2k", "czone", "Wi-Fi", "wlan", "CAN", "usb", "foo bus", "ve.direct", "ethernet", "ble"]
_NET = "CASE {c} % 11 " + " ".join(f"WHEN {i} THEN '{NETWORKS.get(n.lower(), 'UNKNOWN:' + n.lower())}'" for i, n in enumerate(SPOKEN)) + " END"

DEV = f"""dev AS (SELECT p_partkey AS device, p_size AS vessel, p_brand AS maker, p_name AS model, p_type AS description, p_partkey % 29 = 0 AS platform, p_partkey % 4 = 1 AS station, p_partkey % 11 = 0 AS displays, p_partkey % 7 = 0 AS controllable,
      p_partkey % 4 <> 0 AS has_surface, p_partkey % 5 > 1 AS has_actions, p_retailprice / 1500 AS confidence, p_partkey % 6 = 0 AS protective, p_partkey % 3 = 0 AS daily FROM part),
    speaks AS (SELECT DISTINCT p_size AS vessel, l_partkey AS device, {_NET.format(c='l_suppkey')} AS net FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 49),
    bridges AS (SELECT DISTINCT p_size AS vessel, l_partkey AS device, {_NET.format(c='l_suppkey')} AS source, {_NET.format(c='(l_suppkey + 4)')} AS target FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity < 2 AND p_partkey % 5 = 0),
    nets AS (SELECT vessel, net FROM speaks UNION SELECT vessel, source FROM bridges UNION SELECT vessel, target FROM bridges),
    ed AS (SELECT vessel, source AS a, target AS b FROM bridges UNION SELECT vessel, target, source FROM bridges),
    reach(vessel, a, b) AS (SELECT vessel, net, net FROM nets UNION SELECT r.vessel, r.a, e.b FROM reach r JOIN ed e ON e.vessel = r.vessel AND e.a = r.b),
    comp AS (SELECT vessel, a AS net, min(b) AS component FROM reach GROUP BY vessel, a),
    onc AS (SELECT DISTINCT x.vessel, device, component FROM (SELECT vessel, device, net FROM speaks UNION SELECT vessel, device, source FROM bridges UNION SELECT vessel, device, target FROM bridges) x JOIN comp USING (vessel, net)),
    cmd AS (SELECT DISTINCT o.vessel, o.device FROM onc o JOIN onc x ON x.vessel = o.vessel AND x.component = o.component AND x.device <> o.device JOIN dev ON dev.device = x.device AND dev.controllable),
    hub AS (SELECT vessel, device FROM dev WHERE NOT platform AND station AND (displays OR device IN (SELECT device FROM cmd))),
    hubc AS (SELECT DISTINCT o.vessel, o.component, o.device FROM onc o JOIN hub USING (vessel, device)),
    roled AS (SELECT dev.*, CASE WHEN platform THEN 'PLATFORM' WHEN device IN (SELECT device FROM hub) THEN 'HUB' WHEN device IN (SELECT device FROM bridges) AND NOT has_actions THEN 'BRIDGE' WHEN NOT has_surface AND NOT has_actions THEN 'PASSIVE'
      WHEN has_surface AND device NOT IN (SELECT o.device FROM onc o JOIN hubc h ON h.vessel = o.vessel AND h.component = o.component) THEN 'ISLAND' ELSE 'ENDPOINT' END AS role FROM dev),
    paths AS (SELECT o.vessel, o.device AS target, min(h.device) AS hub, count(DISTINCT h.device) AS n_hubs FROM onc o JOIN roled r ON r.device = o.device AND r.controllable AND r.role <> 'HUB' JOIN hubc h ON h.vessel = o.vessel AND h.component = o.component GROUP BY o.vessel, o.device)"""


def tables(spark, d):
    k = C("p_partkey")
    dev = read(spark, d, "part").select(
        k.alias("device"), C("p_size").alias("vessel"), C("p_brand").alias("maker"), C("p_name").alias("model"), C("p_type").alias("description"), (k % 29 == 0).alias("platform"), (k % 4 == 1).alias("station"),
        (k % 11 == 0).alias("displays"), (k % 7 == 0).alias("controllable"), (k % 4 != 0).alias("has_surface"), (k % 5 > 1).alias("has_actions"), (C("p_retailprice") / 1500).alias("confidence"), (k % 6 == 0).alias("protective"), (k % 3 == 0).alias("daily"),
    )
    names = F.array(*[F.lit(n) for n in SPOKEN])
    net = lambda c: P.aliased(F.get(names, (c % 11).cast("int")), NETWORKS)
    li = read(spark, d, "lineitem").select(C("l_partkey").alias("device"), "l_suppkey", "l_quantity").filter("l_quantity > 49 OR l_quantity < 2").join(dev.select("device", "vessel"), "device")
    speaks = li.filter("l_quantity > 49").select("vessel", "device", net(C("l_suppkey")).alias("net")).distinct()
    bridges = li.filter("l_quantity < 2 AND device % 5 = 0").select("vessel", "device", net(C("l_suppkey")).alias("source"), net(C("l_suppkey") + 4).alias("target")).distinct()
    return dev, written(speaks, "speaks"), written(bridges, "bridges")


def graph_of(spark, d):
    dev, speaks, bridges = tables(spark, d)
    on = written(D.on_components(speaks, bridges, D.network_components(speaks, bridges)), "on")
    roled = written(D.roles(dev, bridges, on), "roled")
    return dev, speaks, bridges, on, roled


@query("network_components", f"WITH RECURSIVE {DEV} SELECT * FROM comp")
def network_components(spark, d):
    _, speaks, bridges = tables(spark, d)
    return D.network_components(speaks, bridges)


@query("device_components", f"WITH RECURSIVE {DEV} SELECT vessel, device, string_agg(component, ',' ORDER BY component) AS components FROM onc GROUP BY vessel, device")
def device_components(spark, d):
    """The set of components each device is on."""
    _, speaks, bridges = tables(spark, d)
    on = D.on_components(speaks, bridges, D.network_components(speaks, bridges))
    return on.groupBy("vessel", "device").agg(F.array_join(F.array_sort(F.collect_set("component")), ",").alias("components"))


@query("device_roles", f"WITH RECURSIVE {DEV} SELECT vessel, device, role, device IN (SELECT device FROM cmd) AS commands FROM roled")
def device_roles(spark, d):
    dev, _, _, on, roled = graph_of(spark, d)
    c = D.commanders(dev, on).withColumn("commands", F.lit(True))
    return roled.join(c, ["vessel", "device"], "left").select("vessel", "device", "role", F.coalesce("commands", F.lit(False)).alias("commands"))


@query("taught_paths", f"WITH RECURSIVE {DEV} SELECT * FROM paths")
def taught_paths(spark, d):
    _, _, _, on, roled = graph_of(spark, d)
    return D.taught_paths(roled, on)


def ways(spark, d):
    dev, speaks, bridges, on, roled = graph_of(spark, d)
    names = F.array(*[F.lit(x) for x in ("self_claimed", "counterpart_claim", "diagram_inference")])
    tiers = dev.select("vessel", "device", F.get(names, (C("device") % 3).cast("int")).alias("tier"))
    return D.device_paths(D.taught_paths(roled, on), speaks, bridges, tiers, {"self_claimed": 0, "counterpart_claim": 1, "diagram_inference": 2})


@query(
    "path_provenance",
    f"""WITH RECURSIVE {DEV}, bt AS (SELECT DISTINCT vessel, device, net FROM (SELECT vessel, device, source AS net FROM bridges UNION ALL SELECT vessel, device, target FROM bridges)), mem AS (SELECT vessel, device, net FROM speaks UNION SELECT vessel, device, net FROM bt),
    hubs AS (SELECT DISTINCT vessel, hub FROM paths), way(vessel, hub, net, cost) AS (SELECT h.vessel, h.hub, m.net, h.hub % 3 FROM hubs h JOIN mem m ON m.vessel = h.vessel AND m.device = h.hub
      UNION SELECT w.vessel, w.hub, y.net, greatest(w.cost, x.device % 3) FROM way w JOIN bt x ON x.vessel = w.vessel AND x.net = w.net JOIN bt y ON y.vessel = x.vessel AND y.device = x.device AND y.net <> x.net)
    SELECT p.vessel, p.target, p.hub, CASE min(greatest(w.cost, p.target % 3)) WHEN 0 THEN 'self_claimed' WHEN 1 THEN 'counterpart_claim' ELSE 'diagram_inference' END AS weakest FROM paths p JOIN mem m ON m.vessel = p.vessel AND m.device = p.target JOIN way w ON w.vessel = p.vessel AND w.hub = p.hub AND w.net = m.net GROUP BY p.vessel, p.target, p.hub""",
)
def path_provenance(spark, d):
    """The weakest claim on the best claimed way from a device to its hub."""
    return ways(spark, d).drop("devices")


@query("path_devices")
def path_devices(spark, d):
    """The devices on that way, in order; held against the networks that they share."""
    return ways(spark, d).select("vessel", "target", "hub", F.array_join(C("devices").cast("array<string>"), ">").alias("devices"))


_REQ = "req AS (SELECT p_size AS vessel, p_partkey AS device, 'path ' || p_partkey % 2 AS path, CASE WHEN p_partkey % 9 = 0 THEN 'software_app' ELSE 'device' END AS kind, p_partkey % 13 < 5 AS satisfied FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_size, p_partkey, 'path 0', 'device', p_partkey % 17 < 3 FROM part)"


@query(
    "structural_flags",
    f"""WITH RECURSIVE {DEV}, {_REQ}, mem AS (SELECT vessel, device, net FROM speaks UNION SELECT vessel, device, source FROM bridges UNION SELECT vessel, device, target FROM bridges), sz AS (SELECT vessel, net, count(*) AS n FROM mem GROUP BY vessel, net),
    h AS (SELECT vessel, count(*) FILTER (WHERE role = 'HUB') AS n FROM roled GROUP BY vessel)
    SELECT vessel, NULL::BIGINT AS device, 'no_hub_found' AS flag, '' AS detail FROM h WHERE n = 0 UNION SELECT vessel, NULL, 'multiple_hubs', n::VARCHAR FROM h WHERE n > 1
    UNION SELECT b.vessel, b.device, 'orphan_bridge', source || '>' || target FROM bridges b JOIN roled r ON r.device = b.device AND role = 'BRIDGE' JOIN sz ON sz.vessel = b.vessel AND sz.net IN (source, target) AND sz.n = 1
    UNION SELECT vessel, device, 'unresolved_dependency', path FROM req WHERE kind = 'device' GROUP BY vessel, device, path HAVING NOT bool_or(satisfied)
    UNION SELECT vessel, device, 'network_alias_gap', '' FROM mem WHERE net LIKE 'UNKNOWN:%' UNION SELECT vessel, device, 'low_confidence_profile', '' FROM roled WHERE confidence < 0.65
    UNION SELECT vessel, device, 'suspected_installer_line_item', '' FROM roled WHERE role = 'PASSIVE' AND NOT protective UNION SELECT vessel, device, 'island_with_daily_use', '' FROM roled WHERE role = 'ISLAND' AND daily
    UNION SELECT vessel, device, 'controllable_but_unreachable', '' FROM roled WHERE controllable AND role <> 'HUB' AND device NOT IN (SELECT target FROM paths)""",
)
def structural_flags(spark, d):
    """Nine rules over vessels, networks and devices, each flag once."""
    _, speaks, bridges, on, roled = graph_of(spark, d)
    k = C("p_partkey")
    kind = F.when(k % 9 == 0, "software_app").otherwise("device")
    p = read(spark, d, "part")
    req = p.filter("p_partkey % 2 = 0").select(C("p_size").alias("vessel"), k.alias("device"), F.concat(F.lit("path "), (k % 2).cast("string")).alias("path"), kind.alias("kind"), (k % 13 < 5).alias("satisfied"))
    req = req.unionByName(p.select(C("p_size").alias("vessel"), k.alias("device"), F.lit("path 0").alias("path"), F.lit("device").alias("kind"), (k % 17 < 3).alias("satisfied")))
    return D.structural_flags(roled, speaks, bridges, req, D.taught_paths(roled, on), 0.65)


@query(
    "cross_references",
    f"""WITH RECURSIVE {DEV}, sec AS (SELECT vessel, device, description AS section FROM dev), pr AS (SELECT a.vessel, CASE WHEN a.device % 2 = 0 THEN 'protection' ELSE 'power_dependency' END AS kind, a.device, b.device AS other FROM dev a JOIN dev b ON b.vessel = a.vessel AND b.device = a.device * 2),
    e AS (SELECT vessel, 'control' AS kind, target AS device, hub AS other FROM paths UNION ALL SELECT * FROM pr), x AS (SELECT e.*, a.section AS sa, b.section AS sb FROM e JOIN sec a ON a.device = e.device JOIN sec b ON b.device = e.other WHERE a.section <> b.section)
    SELECT vessel, kind, sa AS in_section, other AS to_device FROM x UNION SELECT vessel, 'hosts_control', sb, device FROM x WHERE kind = 'control'""",
)
def cross_references(spark, d):
    """Edges that leave their section: control from both sides, protection and power from one."""
    dev, _, _, on, roled = graph_of(spark, d)
    other = dev.select("vessel", C("device").alias("other"))
    kind = F.when(C("device") % 2 == 0, "protection").otherwise("power_dependency")
    pr = dev.select("vessel", kind.alias("kind"), "device", (C("device") * 2).alias("other")).join(other, ["vessel", "other"])
    return D.cross_references(D.taught_paths(roled, on), pr, dev.select("vessel", "device", C("description").alias("section")))


@query(
    "counterpart_claims",
    f"""WITH RECURSIVE {DEV}, c AS (SELECT DISTINCT s.vessel, s.device, b.target AS net FROM speaks s JOIN bridges b ON b.vessel = s.vessel AND b.source = s.net AND b.device <> s.device)
    SELECT vessel, device, net FROM c EXCEPT SELECT vessel, device, net FROM speaks""",
)
def counterpart_claims(spark, d):
    """Networks a device is claimed to speak by the bridges of others on its own networks, unless it says so itself.

    Bridges are folded to (network, target, least and greatest bridge) first: a device meets a claim once, not once a bridge.
    """
    _, speaks, bridges = tables(spark, d)
    claims = bridges.groupBy("vessel", C("source").alias("net"), C("target").alias("claimed")).agg(F.min("device").alias("lo"), F.max("device").alias("hi"))
    met = speaks.join(claims, ["vessel", "net"]).filter((C("lo") != C("device")) | (C("hi") != C("device")))
    return met.select("vessel", "device", C("claimed").alias("net")).distinct().join(speaks, ["vessel", "device", "net"], "left_anti")


@query(
    "hub_domains",
    f"""WITH RECURSIVE {DEV}, m AS (SELECT vessel FROM hub GROUP BY vessel HAVING count(*) > 1)
    SELECT vessel, device, coalesce(nullif(concat_ws('; ', CASE WHEN contains(model, 'ring') THEN 'rings' END, CASE WHEN regexp_matches(model, '(red|blue)') THEN 'coloured' END, CASE WHEN description = 'SMALL' THEN 'small' END), ''), 'domain cues sparse') AS notes
    FROM hub JOIN m USING (vessel) JOIN (SELECT device, model, description FROM dev) USING (device)""",
)
def hub_domains(spark, d):
    """Where a vessel has several hubs, what each seems to be for; nothing is merged."""
    *_, roled = graph_of(spark, d)
    hubs = roled.filter("role = 'HUB'")
    several = hubs.groupBy("vessel").count().filter("count > 1").select("vessel")
    notes = F.array_compact(F.array(F.when(C("model").contains("ring"), "rings"), F.when(C("model").rlike("(red|blue)"), "coloured"), F.when(C("description") == "SMALL", "small")))
    return hubs.join(several, "vessel").select("vessel", "device", F.coalesce(F.nullif(F.array_join(notes, "; "), F.lit("")), F.lit("domain cues sparse")).alias("notes"))


_RES = """eq AS (SELECT p_size AS vessel, p_partkey AS device, p_name AS model, lower(p_brand || ' ' || p_name || ' ' || p_type) AS hay, p_partkey % 4 = 0 AS switch_like, p_partkey % 8 = 0 AS remote_path FROM part),
    rq AS (SELECT p_size AS vessel, p_partkey AS req_id, p_partkey AS own, list_filter(list_transform(string_split_regex(CASE p_partkey % 4 WHEN 0 THEN 'a ' || p_name || ' or safety relay' WHEN 1 THEN 'any economy kit' WHEN 2 THEN 'Safety Relay, battery fuse' ELSE 'an unknown thing' END, '(?i)\\s*,\\s*(?:or\\s+)?|\\s+or\\s+|\\s*/\\s*'), lambda x: trim(x)), lambda x: x <> '') AS alts FROM part),
    alt AS (SELECT vessel, req_id, own, unnest(range(len(alts))) AS alt, lower(unnest(alts)) AS text FROM rq),
    t3 AS (SELECT req_id, device, alt, c.ord, class_id, remote, contains(hay, token) AS named, switch_like, remote_path FROM alt JOIN (VALUES (0, 'external_safety_relay', 'safety relay', 'bolt', true), (1, 'class_t_fuse', 'battery fuse', 'gear', false)) c(ord, class_id, trig, token, remote) ON contains(text, trig) JOIN eq USING (vessel) WHERE device <> own AND (contains(hay, token) OR switch_like)),
    s3 AS (SELECT *, CASE WHEN remote THEN CASE WHEN remote_path THEN 0.4 + CASE WHEN switch_like THEN CASE WHEN named THEN 0.6 ELSE 0.45 END ELSE least(CASE WHEN named THEN 0.4 ELSE 0.25 END, 0.45) END ELSE least(CASE WHEN switch_like THEN CASE WHEN named THEN 0.6 ELSE 0.45 END ELSE CASE WHEN named THEN 0.4 ELSE 0.25 END END, 0.45) END
      ELSE CASE WHEN named THEN 0.8 ELSE 0.25 END END AS sc, concat_ws('; ', CASE WHEN remote AND NOT switch_like THEN 'protective but not a switch' END, CASE WHEN remote AND NOT remote_path THEN 'no remote command path' END) AS reason FROM t3)"""


def requirements(spark, d):
    k = C("p_partkey") % 4
    p = read(spark, d, "part")
    text = F.when(k == 0, F.concat(F.lit("a "), "p_name", F.lit(" or safety relay"))).when(k == 1, "any economy kit").when(k == 2, "Safety Relay, battery fuse").otherwise("an unknown thing")
    req = p.select(C("p_size").alias("vessel"), C("p_partkey").alias("req_id"), C("p_partkey").alias("device"), text.alias("text"))
    eq = p.select(C("p_size").alias("vessel"), C("p_partkey").alias("device"), C("p_name").alias("model"), F.lower(F.concat_ws(" ", "p_brand", "p_name", "p_type")).alias("hay"), (C("p_partkey") % 4 == 0).alias("switch_like"), (C("p_partkey") % 8 == 0).alias("remote_path"))
    families = spark.createDataFrame([("economy", "economy kit", "economy")], "family string, phrase string, token string")
    classes = spark.createDataFrame([(0, "external_safety_relay", "safety relay", "bolt", True), (1, "class_t_fuse", "battery fuse", "gear", False)], "class_ord int, class_id string, trigger string, token string, remote boolean")
    return D.resolved(req, eq, families, classes)


@query(
    "resolved_tiers",
    f"""WITH {_RES}, h AS (SELECT req_id, device, 1 AS tier, alt, 0 AS ord, 0.0::DOUBLE AS score FROM alt JOIN eq USING (vessel) WHERE device <> own AND contains(text, lower(model)) AND len(model) >= 3 AND list_contains(string_split_regex(text, '[^a-z0-9]+'), string_split_regex(lower(model), '[^a-z0-9]+')[1])
      UNION ALL SELECT req_id, device, 2, alt, 0, 0.0 FROM alt JOIN eq USING (vessel) WHERE device <> own AND contains(text, 'economy kit') AND contains(hay, 'economy') UNION ALL SELECT req_id, device, 3, alt, ord, round(sc, 3)::DOUBLE FROM s3 WHERE sc >= 0.7 AND reason = ''),
    r AS (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY tier, alt, ord, score DESC, device) AS rn FROM h) SELECT req_id, device, tier, score FROM r WHERE rn = 1""",
)
def resolved_tiers(spark, d):
    """The best match of each requirement over its alternatives: literal, family, then scored class."""
    return requirements(spark, d)[0]


@query("rejected_candidates", f"WITH {_RES} SELECT DISTINCT req_id, device, class_id, round(sc, 3)::DOUBLE AS score, CASE WHEN reason = '' THEN 'score below threshold' ELSE reason END AS reason FROM s3 WHERE sc < 0.7 OR reason <> ''")
def rejected_candidates(spark, d):
    """Near misses of the scored classes, with the criteria they failed."""
    return requirements(spark, d)[1]


@query(
    "content_tiers",
    f"""WITH RECURSIVE {DEV} SELECT vessel, device, CASE WHEN role = 'PLATFORM' THEN 'platform' WHEN role = 'PASSIVE' AND NOT protective THEN 'omit' WHEN role IN ('HUB', 'ISLAND') THEN 'full' WHEN role = 'BRIDGE' THEN 'provenance' WHEN device IN (SELECT target FROM paths) THEN 'summary' ELSE 'full' END AS tier,
    CASE WHEN role = 'PASSIVE' AND protective THEN 'protective' WHEN device IN (SELECT target FROM paths) THEN 'taught via hub' ELSE 'own' END AS reason FROM roled""",
)
def content_tiers(spark, d):
    """How much of a device a guide tells, by its role and by whether a hub teaches it, the first rule that applies."""
    *_, on, roled = graph_of(spark, d)
    paths = D.taught_paths(roled, on).select("vessel", C("target").alias("device"), F.lit(True).alias("_taught"))
    r = roled.join(paths, ["vessel", "device"], "left")
    taught, role = C("_taught").isNotNull(), C("role")
    tier = F.when(role == "PLATFORM", "platform").when((role == "PASSIVE") & ~C("protective"), "omit").when(role.isin("HUB", "ISLAND"), "full").when(role == "BRIDGE", "provenance").when(taught, "summary").otherwise("full")
    reason = F.when((role == "PASSIVE") & C("protective"), "protective").when(taught, "taught via hub").otherwise("own")
    return r.select("vessel", "device", tier.alias("tier"), reason.alias("reason"))


@query(
    "section_inputs",
    f"""WITH RECURSIVE {DEV}, cand AS (SELECT vessel, description AS section, device, 3 AS depth FROM roled WHERE role IN ('HUB', 'ISLAND', 'ENDPOINT') UNION ALL SELECT p.vessel, h.description, p.target, 2 FROM paths p JOIN dev h ON h.device = p.hub UNION ALL SELECT vessel, description, device, 1 FROM roled WHERE role = 'BRIDGE')
    SELECT vessel, section, count(DISTINCT device) AS members, count(*) - count(DISTINCT device) AS alternates, sum(depth)::BIGINT AS depths, max(depth) AS richest FROM cand GROUP BY vessel, section""",
)
def section_inputs(spark, d):
    """Contributors of each section from three sources; a device keeps its richest, the others are remembered as alternates."""
    dev, _, _, on, roled = graph_of(spark, d)
    full = roled.filter("role IN ('HUB', 'ISLAND', 'ENDPOINT')").select("vessel", C("description").alias("section"), "device", F.lit(3).alias("depth"))
    hub = dev.select(C("device").alias("hub"), C("description").alias("section"))
    taught = D.taught_paths(roled, on).join(hub, "hub").select("vessel", "section", C("target").alias("device"), F.lit(2).alias("depth"))
    bridge = roled.filter("role = 'BRIDGE'").select("vessel", C("description").alias("section"), "device", F.lit(1).alias("depth"))
    one = full.unionByName(taught).unionByName(bridge).groupBy("vessel", "section", "device").agg(F.max("depth").alias("depth"), (F.count("*") - 1).alias("others"), F.sum("depth").alias("total"))
    return one.groupBy("vessel", "section").agg(F.count("*").alias("members"), F.sum("others").alias("alternates"), F.sum("total").alias("depths"), F.max("depth").alias("richest"))


@query(
    "instance_rows",
    """SELECT s_suppkey, i AS instance, CASE WHEN s_suppkey % 3 + 1 > 1 THEN s_name || ' ' || i ELSE s_name END AS label, CASE WHEN i = 1 THEN 'port' WHEN i = 2 THEN 'starboard' END AS side FROM supplier, range(1, 4) t(i) WHERE i <= s_suppkey % 3 + 1""",
)
def instance_rows(spark, d):
    """A row for each instance of a line item by its quantity, labelled where there are several."""
    n = (C("s_suppkey") % 3 + 1).cast("int")
    s = read(spark, d, "supplier").select("s_suppkey", "s_name", n.alias("n"), F.explode(F.sequence(F.lit(1), n)).alias("instance"))
    label = F.when(C("n") > 1, F.concat_ws(" ", "s_name", C("instance").cast("string"))).otherwise(C("s_name"))
    side = F.when(C("instance") == 1, "port").when(C("instance") == 2, "starboard")
    return s.select("s_suppkey", C("instance").cast("long").alias("instance"), label.alias("label"), side.alias("side"))


@query(
    "kept_relations",
    "SELECT l_suppkey AS owner, string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR) AS members FROM lineitem WHERE l_quantity > 48 GROUP BY l_suppkey HAVING count(DISTINCT l_partkey) >= 2",
)
def kept_relations(spark, d):
    """Relations with at least two different members."""
    r = read(spark, d, "lineitem").filter("l_quantity > 48").groupBy(C("l_suppkey").alias("owner")).agg(F.array_sort(F.collect_set(C("l_partkey").cast("string"))).alias("m"))
    return r.filter(F.size("m") >= 2).select("owner", F.array_join("m", ",").alias("members"))


@query(
    "edge_round_trip",
    "SELECT o_custkey AS device, count(*) AS edges, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate, o_orderkey) AS inlined FROM orders GROUP BY o_custkey",
)
def edge_round_trip(spark, d):
    """Edges split from their profiles with their place, written, and folded back in the same order."""
    o = read(spark, d, "orders").groupBy(C("o_custkey").alias("device")).agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))).alias("edges"))
    split = written(o.select("device", F.posexplode("edges").alias("place", "edge")), "edges")
    back = split.groupBy("device").agg(F.array_sort(F.collect_list(F.struct("place", C("edge.o_orderkey").alias("k")))).alias("e"))
    return back.select("device", F.size("e").cast("long").alias("edges"), F.array_join(F.transform("e", lambda x: x["k"].cast("string")), ",").alias("inlined"))
