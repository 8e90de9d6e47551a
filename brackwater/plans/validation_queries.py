"""Validation queries: a profile a customer, its lists made of the orders; every rule family against SQL over the single rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import relational as R
from ..operators import repair
from ..operators import validate as V
from ..sources.tables import read
from .catalog import query

C = F.col
ACTIONS = ["Open the quick menu", "Turn on the pump", "Check error codes", "Set display brightness", "Reset the battery monitor"]
OCCASIONS = {0: "to open quick menu", 1: "when leaving", 2: "to turn the pump on again now", 3: ""}
SECTIONS = ["3.1 Setup", "D E F", "Alarms", "Select to view the alarms that your display has.", "", "Wiring"]
NOTES = ["commands other loads and controls devices", "turn on pump", "battery monitor reset", ""]
FIELDS = ["data_roles.controllable_from_network", "requires_devices[{i}]", "operator_actions[{i}]", "colour", "", "safety_role.is_protective_device", "control_surfaces[7]"]


def sql_case(key: str, values: list[str] | dict) -> str:
    items = enumerate(values) if isinstance(values, list) else values.items()
    return f"CASE {key} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in items) + " END"


ROWS = f"""r AS (SELECT o_custkey AS device, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, o_orderstatus AS status FROM orders),
    x AS (SELECT *, {sql_case('k % 5', ACTIONS)} AS action, {sql_case('k % 4', OCCASIONS)} AS occasion, {sql_case('k % 6', SECTIONS)} AS section, {sql_case('(k // 2) % 4', NOTES)} AS note,
      replace({sql_case('(k // 3) % 7', FIELDS)}, '{{i}}', i::VARCHAR) AS field, CASE k % 3 WHEN 0 THEN 'control_surfaces[' || i || ']' WHEN 1 THEN '' ELSE 'operator_actions[' || i || ']' END AS needed_for, k % 7 = 0 AS gate FROM r),
    n AS (SELECT device, count(*) AS n_rows, count(*) FILTER (WHERE status = 'F') AS n_surfaces, count(*) FILTER (WHERE status = 'O') AS n_speaks FROM r GROUP BY device),
    p AS (SELECT c_custkey AS device, c_custkey % 2 = 0 AS controllable, c_custkey % 3 = 0 AS displays, c_custkey % 5 = 0 AS protective, CASE WHEN c_custkey % 8 = 0 THEN ' ' ELSE c_mktsegment END AS category,
      c_custkey % 10 / 10.0::DOUBLE AS coverage, c_acctbal / 10000 AS confidence, coalesce(n_rows, 0) AS n_rows, coalesce(n_surfaces, 0) AS n_surfaces, coalesce(n_speaks, 0) AS n_speaks FROM customer LEFT JOIN n ON n.device = c_custkey),
    y AS (SELECT x.*, n_rows, n_surfaces FROM x JOIN n USING (device))"""


def pick(values: list[str], key):
    return F.get(F.array(*[F.lit(v) for v in values]), key.cast("int"))


def profiles(spark, d):
    k, i = C("k"), C("i")
    r = read(spark, d, "orders").select(C("o_custkey").alias("device"), C("o_orderkey").alias("k"), C("o_orderstatus").alias("status"), (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("i"))
    field = F.replace(pick(FIELDS, F.floor(k / 3) % 7), F.lit("{i}"), i.cast("string"))
    needed = F.when(k % 3 == 0, V.at("control_surfaces", i)).when(k % 3 == 1, "").otherwise(V.at("operator_actions", i))
    item = F.struct(
        i,
        F.struct(pick(ACTIONS, k % 5).alias("action"), C("status").alias("audience"), pick(list(OCCASIONS.values()), k % 4).alias("occasion")).alias("action"),
        F.struct(field.alias("field"), pick(SECTIONS, k % 6).alias("section"), pick(NOTES, F.floor(k / 2) % 4).alias("note")).alias("evidence"),
        F.struct(F.lit("a fuse").alias("text"), needed.alias("needed_for"), (k % 7 == 0).alias("gate")).alias("requires"),
    )
    lists = r.groupBy("device").agg(F.array_sort(F.collect_list(item)).alias("items"), F.count_if(C("status") == "F").alias("n_surfaces"), F.count_if(C("status") == "O").alias("n_speaks"))
    c = read(spark, d, "customer").join(lists, C("device") == C("c_custkey"), "left")
    part = lambda name: F.coalesce(F.transform("items", lambda x: x[name]), F.array().cast(item_type(lists, name))).alias({"action": "actions"}.get(name, name))
    ck = C("c_custkey")
    return c.select(
        ck.alias("device"), part("action"), part("evidence"), part("requires"), F.coalesce("n_surfaces", F.lit(0)).alias("n_surfaces"), F.coalesce("n_speaks", F.lit(0)).alias("n_speaks"), (ck % 2 == 0).alias("controllable"), (ck % 3 == 0).alias("displays"),
        (ck % 5 == 0).alias("protective"), F.when(ck % 8 == 0, " ").otherwise(C("c_mktsegment")).alias("category"), ((ck % 10) / 10).alias("coverage"), (C("c_acctbal") / 10000).alias("confidence"),
    )


def item_type(lists, name: str) -> str:
    struct = lists.schema["items"].dataType.elementType
    return f"array<{struct[name].dataType.simpleString()}>"


FLAGS = {
    "validated_evidence": ("evidence_incomplete", "evidence_heading_invalid", "evidence_shape_invalid", "unknown_field", "direction_mismatch"),
    "validated_links": ("occasion_circular", "dangling_needed_for"),
    "validated_profiles": ("action_without_surface", "speaks_but_inert", "category_freeform_provenance", "coverage_low", "low_confidence_profile"),
}
_LOST = "(field LIKE 'operator_actions[%' AND i >= n_rows) OR field = 'colour' OR (field = 'control_surfaces[7]' AND n_surfaces <= 7)"


def flags_of(spark, d, name):
    return V.validated(profiles(spark, d), FLAGS[name])


@query(
    "validated_evidence",
    f"""WITH {ROWS}, need AS (SELECT device, 'data_roles.controllable_from_network' AS path FROM p WHERE controllable UNION ALL SELECT device, 'data_roles.displays_data_from_other_devices' FROM p WHERE displays UNION ALL SELECT device, 'safety_role.is_protective_device' FROM p WHERE protective
      UNION ALL SELECT device, 'requires_devices[' || i || ']' FROM x WHERE NOT gate)
    SELECT DISTINCT device, 'evidence_incomplete' AS flag, 'blocking' AS severity, path AS detail, 'evidence' AS path FROM need WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.device = need.device AND x.field = need.path)
    UNION ALL SELECT device, 'evidence_heading_invalid', 'blocking', section, 'evidence[' || i || '].manual_section' FROM x WHERE k % 6 IN (1, 3)
    UNION ALL SELECT device, 'evidence_shape_invalid', 'blocking', '', 'evidence[' || i || ']' FROM x WHERE field = '' OR section = ''
    UNION ALL SELECT device, 'unknown_field', 'blocking', field, 'evidence[' || i || '].supports_field' FROM y WHERE {_LOST}
    UNION ALL SELECT device, 'direction_mismatch', 'blocking', field, 'evidence[' || i || '].supports_field' FROM x WHERE field LIKE 'data_roles.%' AND note LIKE 'commands%'""",
)
def validated_evidence(spark, d):
    return flags_of(spark, d, "validated_evidence")


@query(
    "validated_links",
    f"""WITH {ROWS} SELECT device, 'occasion_circular' AS flag, 'warning' AS severity, occasion AS detail, 'operator_actions[' || i || '].occasion' AS path FROM x WHERE (k % 5 = 0 AND k % 4 = 0) OR (k % 5 = 1 AND k % 4 = 2)
    UNION ALL SELECT device, 'dangling_needed_for', 'blocking', needed_for, 'requires_devices[' || i || '].needed_for' FROM y WHERE k % 3 = 0 AND i >= n_surfaces""",
)
def validated_links(spark, d):
    return flags_of(spark, d, "validated_links")


@query(
    "validated_profiles",
    f"""WITH {ROWS} SELECT device, 'action_without_surface' AS flag, 'blocking' AS severity, '' AS detail, 'control_surfaces' AS path FROM p WHERE n_rows > 0 AND n_surfaces = 0 UNION ALL SELECT device, 'category_freeform_provenance', 'blocking', '', 'device.category_freeform' FROM p WHERE trim(category) = ''
    UNION ALL SELECT device, 'coverage_low', 'warning', '', 'coverage' FROM p WHERE coverage < 0.25 UNION ALL SELECT device, 'low_confidence_profile', 'warning', '', 'confidence.overall' FROM p WHERE confidence < 0.6""",
)
def validated_profiles(spark, d):
    return flags_of(spark, d, "validated_profiles")


@query(
    "supported_actions",
    f"""WITH {ROWS} SELECT device, 'operator_actions' AS list, i, CASE WHEN (k // 2) % 4 = 1 THEN 'Turn on the pump' ELSE 'Reset the battery monitor' END AS better FROM x WHERE field LIKE 'operator_actions[%'
    AND (((k // 2) % 4 = 1 AND action <> 'Turn on the pump' AND EXISTS (SELECT 1 FROM x o WHERE o.device = x.device AND o.action = 'Turn on the pump')) OR ((k // 2) % 4 = 2 AND action <> 'Reset the battery monitor' AND EXISTS (SELECT 1 FROM x o WHERE o.device = x.device AND o.action = 'Reset the battery monitor')))""",
)
def supported_actions(spark, d):
    """Evidence whose note fits another action better than the one it is linked to."""
    f = V.validated(profiles(spark, d), ("evidence_support_mismatch",))
    return f.select("device", F.lit("operator_actions").alias("list"), F.regexp_extract("path", r"\[(\d+)\]", 1).cast("long").alias("i"), C("detail").alias("better"))


@query(
    "repaired_occasions",
    f"WITH {ROWS} SELECT device, count(*) AS actions, count(*) FILTER (WHERE occasion <> '' AND NOT ((k % 5 = 0 AND k % 4 = 0) OR (k % 5 = 1 AND k % 4 = 2))) AS occasions FROM x GROUP BY device",
)
def repaired_occasions(spark, d):
    """Occasions left once those that only say the action again are cleared."""
    r = V.repaired(profiles(spark, d)).filter(F.size("actions") > 0)
    return r.select("device", F.size("actions").cast("long").alias("actions"), F.size(F.filter("actions", lambda a: a["occasion"] != "")).cast("long").alias("occasions"))


@query(
    "extraction_gate",
    f"WITH {ROWS}, b AS (SELECT DISTINCT device FROM (SELECT device FROM p WHERE n_rows > 0 AND n_surfaces = 0 UNION SELECT device FROM p WHERE trim(category) = '' UNION SELECT device FROM x WHERE k % 6 IN (1, 3, 4) OR field = '' UNION SELECT device FROM y WHERE ({_LOST}) OR (k % 3 = 0 AND i >= n_surfaces) UNION SELECT device FROM x WHERE field LIKE 'data_roles.%' AND note LIKE 'commands%' UNION SELECT device FROM x WHERE NOT gate AND NOT EXISTS (SELECT 1 FROM x e WHERE e.device = x.device AND e.field = 'requires_devices[' || x.i || ']') UNION SELECT device FROM p WHERE controllable AND NOT EXISTS (SELECT 1 FROM x e WHERE e.device = p.device AND e.field = 'data_roles.controllable_from_network') UNION SELECT device FROM p WHERE displays UNION SELECT device FROM p WHERE protective AND NOT EXISTS (SELECT 1 FROM x e WHERE e.device = p.device AND e.field = 'safety_role.is_protective_device'))) SELECT device, device IN (SELECT device FROM b) AS needs_rextraction FROM p",
)
def extraction_gate(spark, d):
    """Every profile, and whether any blocking flag is left after repair."""
    p = profiles(spark, d)
    bad = V.validated(p, V.BLOCKING).select("device").distinct().withColumn("bad", F.lit(True))
    return p.select("device").join(bad, "device", "left").select("device", F.coalesce("bad", F.lit(False)).alias("needs_rextraction"))


@query(
    "group_contributions",
    """SELECT o_custkey AS device, o_orderkey % 3 AS group_no, count(*) AS excerpts, count(*) FILTER (WHERE o_orderstatus = 'F') AS surfaces, count(*) FILTER (WHERE o_orderstatus = 'P') AS actions, count(*) FILTER (WHERE o_orderstatus IN ('F', 'P')) = 0 AS unutilized FROM orders GROUP BY ALL""",
)
def group_contributions(spark, d):
    """What each group of an extraction contributed; groups with excerpts and no contribution."""
    s = C("o_orderstatus")
    return read(spark, d, "orders").groupBy(C("o_custkey").alias("device"), (C("o_orderkey") % 3).alias("group_no")).agg(F.count("*").alias("excerpts"), F.count_if(s == "F").alias("surfaces"), F.count_if(s == "P").alias("actions"), (F.count_if(s.isin("F", "P")) == 0).alias("unutilized"))


@query(
    "chapter_groups",
    """WITH a AS (SELECT o_custkey AS device, o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END AS chapter FROM orders),
    s AS (SELECT device, count(*) AS n, count(chapter) AS assigned FROM a GROUP BY device), b AS (SELECT a.*, n, assigned, row_number() OVER (PARTITION BY device ORDER BY k) - 1 AS rn FROM a JOIN s USING (device))
    SELECT device, CASE WHEN n >= 8 AND assigned < 0.35 * n THEN 'batch ' || rn // 7 ELSE coalesce(chapter, 'unassigned') END AS group_id, count(*) AS excerpts FROM b GROUP BY ALL""",
)
def chapter_groups(spark, d):
    """Excerpts by chapter; where too few are assigned, by batches in order."""
    a = read(spark, d, "orders").select(C("o_custkey").alias("device"), C("o_orderkey").alias("k"), F.when(C("o_orderstatus") != "F", C("o_orderpriority")).alias("chapter"))
    s = a.groupBy("device").agg(F.count("*").alias("n"), F.count("chapter").alias("assigned"))
    place = F.row_number().over(Window.partitionBy("device").orderBy("k")) - 1
    b = a.withColumn("rn", place).join(s, "device")
    batch = F.concat(F.lit("batch "), F.floor(C("rn") / 7).cast("string"))
    group = F.when((C("n") >= 8) & (C("assigned") < 0.35 * C("n")), batch).otherwise(F.coalesce("chapter", F.lit("unassigned")))
    return b.groupBy("device", group.alias("group_id")).agg(F.count("*").alias("excerpts"))


@query("top_chapters", "SELECT p_size AS chapter, min_by(p_name, (length(p_name), p_name, p_partkey)) AS title, count(*) AS n FROM part GROUP BY p_size")
def top_chapters(spark, d):
    """The shortest title of each chapter."""
    return read(spark, d, "part").groupBy(C("p_size").alias("chapter")).agg(F.min_by("p_name", F.struct(F.length("p_name"), "p_name", "p_partkey")).alias("title"), F.count("*").alias("n"))


@query(
    "predicted_fields",
    """SELECT o_custkey AS device, coalesce(string_agg(DISTINCT f, ',' ORDER BY f), 'operator_actions') AS fields FROM orders LEFT JOIN (VALUES ('1', 'requires_devices'), ('2', 'networks'), ('3', 'networks')) v(k, f) ON contains(o_orderpriority, k) GROUP BY o_custkey""",
)
def predicted_fields(spark, d):
    """Fields that the words of a device's queries foretell, a default where none does."""
    words = {"1": "requires_devices", "2": "networks", "3": "networks"}
    hits = F.array_compact(F.array(*[F.when(C("o_orderpriority").contains(k), F.lit(f)) for k, f in words.items()]))
    g = read(spark, d, "orders").groupBy(C("o_custkey").alias("device")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(hits)))).alias("f"))
    return g.select("device", F.when(F.size("f") > 0, F.array_join("f", ",")).otherwise("operator_actions").alias("fields"))


@query(
    "triaged_votes",
    """WITH v AS (SELECT o_custkey AS device, o_orderpriority AS item, count(DISTINCT o_orderkey % 3) AS present, count(DISTINCT o_orderstatus) AS variants FROM orders GROUP BY ALL)
    SELECT device, count(*) FILTER (WHERE variants > 1 AND present < 3) AS material, count(*) FILTER (WHERE variants > 1 AND present = 3) AS cosmetic, min(present)::VARCHAR || '/3' AS least_margin FROM v GROUP BY device""",
)
def triaged_votes(spark, d):
    """Items that runs disagree on: material where some run lacks them, cosmetic where only their wording differs."""
    v = read(spark, d, "orders").groupBy(C("o_custkey").alias("device"), "o_orderpriority").agg(F.count_distinct(C("o_orderkey") % 3).alias("present"), F.count_distinct("o_orderstatus").alias("variants"))
    return v.groupBy("device").agg(F.count_if((C("variants") > 1) & (C("present") < 3)).alias("material"), F.count_if((C("variants") > 1) & (C("present") == 3)).alias("cosmetic"), F.concat(F.min("present").cast("string"), F.lit("/3")).alias("least_margin"))


@query(
    "prioritised_evidence",
    """WITH e AS (SELECT o_custkey AS device, o_orderkey AS k, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'F' THEN 3 ELSE 5 END AS p FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY p, k) AS rn FROM e)
    SELECT device, string_agg(k::VARCHAR, ',' ORDER BY k) AS kept FROM r WHERE rn <= 8 GROUP BY device""",
)
def prioritised_evidence(spark, d):
    """The eight items of highest priority, given back in the order they came."""
    rank = F.when(C("o_orderstatus") == "P", 0).when(C("o_orderstatus") == "F", 3).otherwise(5)
    e = read(spark, d, "orders").select(C("o_custkey").alias("device"), C("o_orderkey").alias("k"), rank.alias("p"))
    top = e.withColumn("rn", F.row_number().over(Window.partitionBy("device").orderBy("p", "k"))).filter("rn <= 8")
    return top.groupBy("device").agg(R.ordered_text(C("k"), C("k")).alias("kept"))


@query(
    "missing_headings",
    """WITH h AS (SELECT n_regionkey AS manual, n_name AS h, n_nationkey AS i, CASE WHEN n_nationkey % 7 = 0 THEN 0 WHEN n_nationkey % 2 = 0 THEN 1 END AS p FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)),
    r AS (SELECT *, row_number() OVER (PARTITION BY manual ORDER BY p, i) AS rn FROM h WHERE p IS NOT NULL) SELECT manual, string_agg(h, ',' ORDER BY rn) AS headings FROM r WHERE rn <= 3 GROUP BY manual""",
)
def missing_headings(spark, d):
    """Headings not yet retrieved that matter: forced ones first, then by priority, a few a manual."""
    have = read(spark, d, "supplier").filter("s_acctbal > 9000").select(C("s_nationkey").alias("n_nationkey"))
    rank = F.when(C("n_nationkey") % 7 == 0, 0).when(C("n_nationkey") % 2 == 0, 1)
    h = read(spark, d, "nation").join(have, "n_nationkey", "left_anti").withColumn("p", rank).filter("p IS NOT NULL")
    r = h.withColumn("rn", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("p", "n_nationkey"))).filter("rn <= 3")
    return r.groupBy(C("n_regionkey").alias("manual")).agg(R.ordered_text(C("n_name"), C("rn")).alias("headings"))


@query(
    "primary_chapters",
    """WITH s AS (SELECT l_suppkey AS k, l_shipdate AS d, l_returnflag AS chapter FROM lineitem), n AS (SELECT k, chapter, count(*) AS hits FROM s GROUP BY ALL), m AS (SELECT k, max(hits) AS top FROM n GROUP BY k)
    SELECT n.k AS device, CASE WHEN count(*) = 1 THEN min(chapter) END AS chapter, min(hits) AS hits FROM n JOIN m ON m.k = n.k AND top = hits GROUP BY n.k""",
)
def primary_chapters(spark, d):
    """The chapter with the most hits if it is the only one, else none."""
    n = read(spark, d, "lineitem").groupBy(C("l_suppkey").alias("device"), C("l_returnflag").alias("chapter")).agg(F.count("*").alias("hits"))
    tops = n.groupBy("device", "hits").agg(F.count("*").alias("n"), F.min("chapter").alias("chapter"))
    best = tops.groupBy("device").agg(F.max(F.struct("hits", "n", "chapter")).alias("b"))
    return best.select("device", F.when(C("b.n") == 1, C("b.chapter")).alias("chapter"), C("b.hits").alias("hits"))


@query(
    "overlaid_facts",
    """WITH s AS (SELECT DISTINCT c_custkey AS device, lower(c_mktsegment) AS speak FROM customer), f AS (SELECT o_custkey AS device, lower(CASE o_orderkey % 2 WHEN 0 THEN 'building' ELSE 'NMEA' END) AS speak FROM orders)
    SELECT device, string_agg(speak, ',' ORDER BY speak) AS speaks FROM (SELECT * FROM s UNION SELECT * FROM f) GROUP BY device""",
)
def overlaid_facts(spark, d):
    """What a vessel's own facts add to a profile: networks it lacks, whatever the case."""
    s = read(spark, d, "customer").select(C("c_custkey").alias("device"), F.lower("c_mktsegment").alias("speak"))
    f = read(spark, d, "orders").select(C("o_custkey").alias("device"), F.lower(F.when(C("o_orderkey") % 2 == 0, "Building").otherwise("NMEA")).alias("speak"))
    return s.unionByName(f).distinct().groupBy("device").agg(R.ordered_text(C("speak"), C("speak")).alias("speaks"))


@query("unattached_evidence", "SELECT doc_id, 'evidence_unattached' AS flag FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def unattached_evidence(spark, d):
    """Facts whose evidence is not in the store."""
    store = read(spark, d, "documents").filter("lang = 'en'").select("doc_id")
    return read(spark, d, "labels").join(store, "doc_id", "left_anti").select("doc_id", F.lit("evidence_unattached").alias("flag"))


@query(
    "expanded_pages",
    """SELECT o_custkey AS device, 'page ' || o_orderpriority || ' surface' AS surface, count(*) AS actions, bool_or(o_orderstatus = 'P') AS gated FROM orders WHERE o_orderpriority NOT LIKE '5%' GROUP BY ALL""",
)
def expanded_pages(spark, d):
    """Pages of a device unfolded into surfaces and actions; settings pages are no surfaces of their own."""
    action = F.struct(C("o_orderkey").alias("key"), (C("o_orderstatus") == "P").alias("gated"))
    pages = read(spark, d, "orders").groupBy(C("o_custkey").alias("device"), C("o_orderpriority").alias("name")).agg(F.collect_list(action).alias("actions"))
    nested = pages.groupBy("device").agg(F.collect_list(F.struct("name", "actions")).alias("pages"))
    flat = nested.select("device", F.explode(F.filter("pages", lambda p: ~p["name"].startswith("5"))).alias("p"))
    return flat.select("device", F.concat(F.lit("page "), C("p.name"), F.lit(" surface")).alias("surface"), F.size("p.actions").cast("long").alias("actions"), F.exists("p.actions", lambda a: a["gated"]).alias("gated"))


def talked_profiles(spark, d):
    """Profiles made of conversations: first words of questions are requirements, those of answers surfaces, turns are evidence."""
    t = read(spark, d, "conversations").filter("text IS NOT NULL AND conv_id IS NOT NULL").withColumn("word", F.regexp_extract("text", r"^\W*(\w+)", 1))
    none = lambda kind: F.lit(None).cast(kind)
    row = lambda df, name, text, section=None, supports=None, needed=None, optional=None: df.select(
        C("conv_id").alias("profile"), F.lit(name).alias("list"), (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text")) - 1).alias("idx"), text.alias("text"), *[(none("string") if c is None else c).alias(n) for n, c in (("section", section), ("supports", supports))],
        none("string").alias("derived_from"), (none("string") if needed is None else needed).alias("needed_for"), none("string").alias("source"), (none("boolean") if optional is None else optional).alias("optional"),
    )
    indexed = lambda name, n: F.concat(F.lit(f"{name}["), n.cast("string"), F.lit("]"))
    needs = row(t.filter("role = 'user'"), "requires_devices", C("word"), needed=indexed("control_surfaces", C("turn") % 2))
    surfaces = row(t.filter("role = 'assistant'"), "control_surfaces", C("word"), optional=F.length("text") % 2 == 0)
    supports = F.when(F.length("text") % 5 == 0, indexed("data_roles", F.lit(0))).otherwise(F.concat(indexed("requires_devices", F.length("text") % 4), F.lit(".text")))
    evidence = row(t, "evidence", C("text"), section=C("role"), supports=supports)
    roles = t.groupBy("conv_id").agg(F.min("turn").alias("turn"), F.min("text").alias("text")).filter("turn % 2 = 0")
    return needs.unionByName(surfaces).unionByName(evidence).unionByName(row(roles, "data_roles", F.lit("controllable_from_network")))


@query("repaired_profiles")
def repaired_profiles(spark, d):
    """Profiles after all repairs, their lists numbered anew and their paths led along; held against a plain engine."""
    rows, _ = repair.repaired(talked_profiles(spark, d))
    return rows.withColumn("text", F.md5(C("text").cast("binary")))


@query("repair_log")
def repair_log(spark, d):
    """What the repairs dropped and added, by pass and rule."""
    _, log = repair.repaired(talked_profiles(spark, d))
    return log.groupBy("pass", "repair", "list").agg(F.count("*").alias("n"), F.countDistinct("profile").alias("profiles"))
