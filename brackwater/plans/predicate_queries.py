"""Predicate and normaliser queries: composed filters, rules compiled to columns, labels, and ordered picks without repeats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import coerce
from ..operators import predicates as P
from ..operators import relational as R
from ..operators.ordering import placed
from ..sources.tables import read
from .catalog import query

C = F.col

#: Parameter sets of one filter: each leaves others out.
SEARCHES = {
    "all": {},
    "text": {"text": "1%"},
    "brand": {"text": "#3", "equals": {"p_size": 7}},
    "typed": {"equals": {"p_brand": None}, "among": {"words": "COPPER"}},
    "shipped": {"text": "a", "shipped": True},
    "idle": {"among": {"words": "STANDARD"}, "shipped": False},
}


@query(
    "composed_filters",
    """WITH t AS (SELECT *, string_split(p_type, ' ') AS words, EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 48) AS shipped FROM part)
    SELECT 'all' AS search, count(*) AS n, sum(p_partkey)::BIGINT AS total FROM t
    UNION ALL SELECT 'text', count(*), sum(p_partkey)::BIGINT FROM t WHERE contains(lower(p_name), '1%') OR contains(lower(p_brand), '1%')
    UNION ALL SELECT 'brand', count(*), sum(p_partkey)::BIGINT FROM t WHERE (contains(lower(p_name), '#3') OR contains(lower(p_brand), '#3')) AND p_size = 7
    UNION ALL SELECT 'typed', count(*), sum(p_partkey)::BIGINT FROM t WHERE list_contains(words, 'COPPER')
    UNION ALL SELECT 'shipped', count(*), sum(p_partkey)::BIGINT FROM t WHERE (contains(lower(p_name), 'a') OR contains(lower(p_brand), 'a')) AND shipped
    UNION ALL SELECT 'idle', count(*), sum(p_partkey)::BIGINT FROM t WHERE list_contains(words, 'STANDARD') AND NOT shipped""",
)
def composed_filters(spark, d):
    """One filter by several sets of parameters; those not given do not filter, percent signs are no wildcards."""
    p = read(spark, d, "part").withColumn("words", F.split("p_type", " "))
    large = read(spark, d, "lineitem").filter("l_quantity > 48").select(C("l_partkey").alias("p_partkey"))
    parts = []
    for name, how in SEARCHES.items():
        how = dict(how)
        has = [(large, "p_partkey", how.pop("shipped"))] if "shipped" in how else []
        parts.append(P.search(p, columns=["p_name", "p_brand"], has=has, **how).agg(F.count("*").alias("n"), F.sum("p_partkey").alias("total")).select(F.lit(name).alias("search"), "n", "total"))
    return reduce(DataFrame.unionByName, parts)


@query(
    "autocomplete",
    """SELECT * FROM (SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(p_name), 'ring') AND p_partkey <> 3 ORDER BY p_brand, p_name, p_partkey LIMIT 20)""",
)
def autocomplete(spark, d):
    """The first 20 hits anywhere in a name, one of them excluded: a top-k, no full sort."""
    return P.search(read(spark, d, "part"), "ring ", ["p_name"]).filter("p_partkey <> 3").select("p_partkey", "p_name", "p_brand").orderBy("p_brand", "p_name", "p_partkey").limit(20)


#: Rules in the ``when`` language, by name.
RULES = {
    "always": {"always": True},
    "engines": {"twin_engine": True},
    "one_engine": {"all": [{"not_twin_engine": True}, {"has_category": "propulsion_and_machinery"}]},
    "sails_or_water": {"any": [{"is_sailing": True}, {"has_watermaker": True}]},
    "radio": {"has_company_vhf": True, "local_rules_exclude": ["Anchor"]},
    "never": {"any": []},
}
CATEGORIES = ["propulsion_and_machinery", "fresh_water_and_plumbing", "rigging_and_sail_handling"]
SNAPSHOT_SQL = """s AS (SELECT c_custkey, coalesce(n_engine, 0) AS n_engine, coalesce(water, false) AS water, coalesce(n_rig, 0) AS n_rig,
      CASE WHEN c_nationkey % 5 = 0 THEN 'sailing_catamaran' WHEN c_nationkey % 5 = 1 THEN 'cruising_monohull_sailing' ELSE 'motor_yacht' END AS vessel_type,
      CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS company, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'VHF ' || c_nationkey END AS channel,
      CASE WHEN c_custkey % 6 = 1 THEN 'No anchoring at night' ELSE 'Keep clear' END AS rule FROM customer LEFT JOIN
      (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_engine, bool_or(o_orderstatus = 'O' AND o_orderpriority LIKE '1%') AS water, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_rig FROM orders GROUP BY o_custkey)
      ON o_custkey = c_custkey)"""


def snapshots(spark, d):
    """A vessel a customer: its orders stand for equipment, their status for the category."""
    k = C("o_orderstatus")
    category = F.when(k == "F", CATEGORIES[0]).when(k == "O", CATEGORIES[1]).otherwise(CATEGORIES[2])
    text = F.when((k == "O"), F.when(C("o_orderpriority").startswith("1"), "an Aqua-Base Desalinator").otherwise(C("o_orderpriority")))
    o = read(spark, d, "orders").groupBy(C("o_custkey").alias("c_custkey")).agg(F.collect_list(category).alias("categories"), F.collect_list(text).alias("texts"))
    kind = F.when(C("c_nationkey") % 5 == 0, "sailing_catamaran").when(C("c_nationkey") % 5 == 1, "cruising_monohull_sailing").otherwise("motor_yacht")
    none = F.array().cast("array<string>")
    s = read(spark, d, "customer").join(o, "c_custkey", "left")
    return s.select("c_custkey", F.struct(
        F.coalesce("categories", none).alias("categories"), F.coalesce("texts", none).alias("texts"), kind.alias("vessel_type"),
        F.when(C("c_custkey") % 3 == 0, "").otherwise(C("c_mktsegment")).alias("company"),
        F.when(C("c_custkey") % 4 == 0, "").otherwise(F.concat(F.lit("VHF "), C("c_nationkey").cast("string"))).alias("channel"),
        F.array(F.when(C("c_custkey") % 6 == 1, "No anchoring at night").otherwise("Keep clear")).alias("rules"),
    ).alias("snapshot"))


@query(
    "when_rules",
    f"""WITH {SNAPSHOT_SQL}, t AS (SELECT *, n_engine >= 2 OR contains(vessel_type, 'catamaran') AS twin FROM s)
    SELECT c_custkey, 'always' AS rule, true AS holds FROM t UNION ALL SELECT c_custkey, 'engines', twin FROM t
    UNION ALL SELECT c_custkey, 'one_engine', NOT twin AND n_engine > 0 FROM t UNION ALL SELECT c_custkey, 'sails_or_water', contains(vessel_type, 'sailing') OR n_rig > 0 OR water FROM t
    UNION ALL SELECT c_custkey, 'radio', company <> '' AND channel <> '' AND rule NOT LIKE '%anchor%' FROM t UNION ALL SELECT c_custkey, 'never', false FROM t""",
)
def when_rules(spark, d):
    """Every rule on every vessel: rules are compiled to predicates, so the table is scanned once."""
    each = F.array(*[F.struct(F.lit(name).alias("rule"), P.compile_when(rule).alias("holds")) for name, rule in RULES.items()])
    return snapshots(spark, d).select("c_custkey", F.explode(each).alias("r")).select("c_custkey", "r.rule", "r.holds")


@query(
    "filled_slots",
    f"""WITH {SNAPSHOT_SQL} SELECT c_custkey, 'Call ' || CASE WHEN company = '' THEN 'the charter company' ELSE company END || ' on {{unknown}}, check ' || CASE WHEN n_engine >= 2 OR contains(vessel_type, 'catamaran') THEN 'both engines' ELSE 'the engine' END
    || CASE WHEN company <> '' AND channel <> '' THEN ' — call ' || company || ' on ' || channel ELSE '' END || '.' AS text FROM s""",
)
def filled_slots(spark, d):
    """A sentence with slots filled from each vessel; the unknown slot stays."""
    s = C("snapshot")
    slots = {
        "company_or_charter": F.when(s["company"] == "", "the charter company").otherwise(s["company"]),
        "both_engines": F.when(P.is_twin(s), "both engines").otherwise("the engine"),
        "vhf_suffix": F.when((s["company"] != "") & (s["channel"] != ""), F.concat(F.lit(" — call "), s["company"], F.lit(" on "), s["channel"])).otherwise(""),
    }
    return snapshots(spark, d).select("c_custkey", P.filled(F.lit("Call {company_or_charter} on {unknown}, check {both_engines}{vhf_suffix}."), slots).alias("text"))


@query(
    "instrument_maps",
    """SELECT user_id, string_agg(event_type || '=' || 'self.' || event_type, ',' ORDER BY event_type) AS instruments FROM (SELECT DISTINCT user_id, event_type FROM events WHERE user_id % 3 <> 0) WHERE event_type IN ('click', 'view') GROUP BY user_id
    UNION ALL SELECT DISTINCT user_id, '' FROM events e WHERE NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type IN ('click', 'view') AND x.user_id % 3 <> 0)""",
)
def instrument_maps(spark, d):
    """Maps of roles to paths without roles that are not allowed, and without paths outside the vessel."""
    path = F.when(C("user_id") % 3 == 0, C("event_type")).otherwise(F.concat(F.lit(" self."), "event_type"))
    raw = read(spark, d, "events").groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct(F.concat("event_type", F.lit(" ")), path)))).alias("raw"))
    kept = P.kept_settings(C("raw"), ["click", "view"], "self.", 32)
    return raw.select("user_id", F.array_join(F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("instruments"))


@query(
    "merged_context",
    """SELECT s_suppkey, n_name AS harbour, CASE WHEN s_suppkey % 3 = 0 THEN s_name WHEN s_nationkey % 2 = 0 THEN n_name || ' radio' END AS radio, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS note FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
)
def merged_context(spark, d):
    """Settings of the base with those of the vessel over them, where they are set; empty ones do not count."""
    s = read(spark, d, "supplier").join(read(spark, d, "nation"), C("n_nationkey") == C("s_nationkey"))
    base = F.map_concat(F.create_map(F.lit("harbour"), C("n_name")), F.when(C("s_nationkey") % 2 == 0, F.create_map(F.lit("radio"), F.concat("n_name", F.lit(" radio")))).otherwise(F.create_map().cast("map<string,string>")))
    own = F.create_map(F.lit("harbour"), F.lit(""), F.lit("radio"), F.when(C("s_suppkey") % 3 == 0, C("s_name")), F.lit("note"), F.when(C("s_suppkey") % 2 == 0, C("s_name")).otherwise(""))
    return s.select("s_suppkey", P.overridden(base, own).alias("m")).select("s_suppkey", C("m")["harbour"].alias("harbour"), F.try_element_at("m", F.lit("radio")).alias("radio"), F.try_element_at("m", F.lit("note")).alias("note"))


#: Network names and what they are called; fixed values.
NETWORKS = {"masterbus": "MASTERBUS", "czone": "CZONE", "nmea 2000": "NMEA2000", "nmea2000": "NMEA2000", "n2k": "NMEA2000", "ve.direct": "VEDIRECT", "ve direct": "VEDIRECT", "ve.can": "VECAN", "bluetooth": "BLUETOOTH", "ble": "BLUETOOTH", "can": "CAN", "canbus": "CAN", "wifi": "WIFI", "wi-fi": "WIFI", "wlan": "WIFI", "ethernet": "ETHERNET", "usb": "USB", "usb2.0": "USB", "usb 2.0": "USB"}


@query(
    "normalised_names",
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'NMEA2000' WHEN 1 THEN 'WIFI' WHEN 2 THEN 'UNKNOWN:' || lower(o_orderpriority) WHEN 3 THEN 'VEDIRECT' ELSE 'UNKNOWN:' END AS network,
    CASE o_orderstatus WHEN 'F' THEN 'propulsion' WHEN 'O' THEN 'electrical' ELSE 'other' END AS category,
    CASE WHEN regexp_matches(o_orderpriority, '(?i)(urgent|high)') THEN 'power' WHEN o_orderstatus = 'F' THEN 'motor' WHEN o_custkey % 4 IN (0, 2) THEN 'cruising' ELSE 'sailing' END AS hull,
    CASE WHEN o_orderkey % 2 = 0 THEN '[tagged] ' || o_orderpriority ELSE 'Answer from the manuals: ' || o_orderpriority END AS question FROM orders""",
)
def normalised_names(spark, d):
    """Alias tables with a fallback, ordered cases of patterns and lists, and a prefix unless tagged."""
    k = C("o_orderkey") % 5
    raw = F.when(k == 0, " N2K ").when(k == 1, "Wi-Fi").when(k == 2, C("o_orderpriority")).when(k == 3, "VE.Direct")
    mapping = F.create_map(F.lit("F"), F.lit("propulsion"), F.lit("O"), F.lit("electrical"))
    hull = F.when(C("o_orderpriority").rlike("(?i)(urgent|high)"), "power").when(C("o_orderstatus") == "F", "motor").when((C("o_custkey") % 4).isin(0, 2), "cruising").otherwise("sailing")
    asked = F.trim(F.when(C("o_orderkey") % 2 == 0, F.concat(F.lit(" [tagged] "), "o_orderpriority")).otherwise(C("o_orderpriority")))
    question = F.when(asked.startswith("["), asked).otherwise(F.concat(F.lit("Answer from the manuals: "), asked))
    return read(spark, d, "orders").select("o_orderkey", P.aliased(raw, NETWORKS).alias("network"), F.coalesce(F.try_element_at(mapping, C("o_orderstatus")), F.lit("other")).alias("category"), hull.alias("hull"), question.alias("question"))


@query(
    "location_labels",
    """WITH z AS (SELECT s_suppkey, r_name AS zone, n_name AS sub_zone, n_regionkey, s_nationkey, s_suppkey % 3 AS side FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)
    SELECT s_suppkey, trim(CASE side WHEN 0 THEN '' WHEN 1 THEN 'Port – ' ELSE 'Starboard – ' END || CASE WHEN s_nationkey % 7 = 0 THEN zone WHEN contains(lower(zone), lower(substr(sub_zone, 1, 1))) THEN substr(sub_zone, 1, 1) ELSE zone || ' – ' || substr(sub_zone, 1, 1) END
      || CASE WHEN s_suppkey % 4 = 0 THEN ' (aft)' ELSE '' END) AS label,
    CASE WHEN n_regionkey = 4 AND side > 0 THEN 'side' WHEN n_regionkey = 3 THEN 'zone' ELSE '' END AS refused, CASE WHEN n_regionkey = 3 THEN NULL ELSE zone END AS default_zone FROM z""",
)
def location_labels(spark, d):
    """Labels of structured places, which of them are refused for the kind of vessel, and a default place from a dimension table."""
    s = read(spark, d, "supplier").join(read(spark, d, "nation"), C("n_nationkey") == C("s_nationkey")).join(read(spark, d, "region"), C("r_regionkey") == C("n_regionkey"))
    zone, sub = C("r_name"), F.substring("n_name", 1, 1)
    side = F.when(C("s_suppkey") % 3 == 1, "port").when(C("s_suppkey") % 3 == 2, "STARBOARD ")
    detail = F.when(C("s_suppkey") % 4 == 0, " aft ")
    return s.select("s_suppkey", place_label(zone, sub, C("s_nationkey") % 7 == 0, side, detail).alias("label"), F.when((C("n_regionkey") == 4) & side.isNotNull(), "side").when(C("n_regionkey") == 3, "zone").otherwise("").alias("refused"), F.when(C("n_regionkey") != 3, zone).alias("default_zone"))


def place_label(zone, sub, generic, side, detail):
    """Side, zone and part of it, and a detail in brackets; a part that is general or named in the zone is not said twice."""
    core = F.when(generic | sub.isNull(), zone).when(F.lower(zone).contains(F.lower(sub)), sub).otherwise(F.concat_ws(" – ", zone, sub))
    text = F.concat_ws(" – ", F.initcap(F.nullif(F.trim(side), F.lit(""))), core)
    return F.concat_ws(" ", F.nullif(text, F.lit("")), F.when(~coerce.blank(detail), F.concat(F.lit("("), F.trim(detail), F.lit(")"))))


@query(
    "offered_categories",
    """SELECT c_nationkey, string_agg(slug, ',' ORDER BY ord) AS offered FROM (SELECT c_nationkey, bool_and(c_mktsegment IN ('BUILDING', 'FURNITURE', 'MACHINERY')) AS sail FROM customer GROUP BY c_nationkey), (VALUES (1, 'engine', false), (2, 'rigging', true), (3, 'water', false)) k(ord, slug, sail_only)
    WHERE NOT sail_only OR sail GROUP BY c_nationkey""",
)
def offered_categories(spark, d):
    """Categories on offer for the kinds of vessel of each nation: those for sail only where all kinds sail."""
    kinds = read(spark, d, "customer").groupBy("c_nationkey").agg(F.collect_set("c_mktsegment").alias("kinds"))
    sail = (F.size("kinds") > 0) & F.forall("kinds", lambda k: k.isin("BUILDING", "FURNITURE", "MACHINERY"))
    offered = F.array_compact(F.array(*[F.when(sail if only else F.lit(True), F.lit(slug)) for slug, only in (("engine", False), ("rigging", True), ("water", False))]))
    return kinds.select("c_nationkey", F.array_join(offered, ",").alias("offered"))


@query(
    "fix_cards",
    """SELECT p_partkey, row_number() OVER (ORDER BY CASE string_split(p_type, ' ')[1] WHEN 'STANDARD' THEN 0 WHEN 'SMALL' THEN 1 ELSE 99 END, p_name, p_partkey) AS place FROM part WHERE p_size BETWEEN 5 AND 30 AND (contains(lower(p_name), '1') OR list_bool_or(list_transform(string_split(p_type, ' '), lambda s: contains(lower(s), 'co'))))""",
)
def fix_cards(spark, d):
    """Cards of a category with a text in the title or in any step, in the order of the categories, then of titles."""
    steps = F.split("p_type", " ")
    rank = F.coalesce(F.try_element_at(F.create_map(F.lit("STANDARD"), F.lit(0), F.lit("SMALL"), F.lit(1)), steps[0]), F.lit(99))
    hit = F.lower("p_name").contains("1") | F.exists(steps, lambda s: F.lower(s).contains("co"))
    cards = read(spark, d, "part").filter(C("p_size").between(5, 30) & hit).select("p_partkey", rank.alias("rank"), "p_name")
    return placed(cards, "rank", "p_name", "p_partkey").select("p_partkey", "place")


@query(
    "source_labels",
    """SELECT conv_id, string_agg(label, '; ' ORDER BY label) AS sources FROM (SELECT conv_id, coalesce(max(title), upper(role[1]) || substr(role, 2) || ' Turn') || ' p. ' || string_agg(DISTINCT CASE WHEN turn % 5 = 4 THEN NULL ELSE turn + 1000 END, ', ' ORDER BY CASE WHEN turn % 5 = 4 THEN NULL ELSE turn + 1000 END)
      || CASE WHEN bool_or(turn % 5 = 4) THEN ', ?' ELSE '' END AS label FROM (SELECT *, CASE WHEN role = 'user' THEN 'The question' END AS title FROM conversations) GROUP BY conv_id, role HAVING bool_or(turn % 5 <> 4)) GROUP BY conv_id""",
)
def source_labels(spark, d):
    """Sources of a conversation grouped by manual: a title, else its id in words; pages sorted, an unknown page last."""
    page = F.when(C("turn") % 5 != 4, C("turn") + 1000)
    title = F.when(C("role") == "user", "The question")
    name = F.initcap(F.replace(F.concat("role", F.lit("_turn")), F.lit("_"), F.lit(" ")))
    one = read(spark, d, "conversations").groupBy("conv_id", "role").agg(F.max(F.coalesce(title, name)).alias("title"), F.array_sort(F.collect_set(page)).alias("pages"), F.bool_or(page.isNull()).alias("unknown"))
    pages = F.concat(F.transform("pages", lambda p: p.cast("string")), F.when(C("unknown"), F.array(F.lit("?"))).otherwise(F.array().cast("array<string>")))
    label = F.concat("title", F.lit(" p. "), F.array_join(pages, ", "))
    return one.filter(F.size("pages") > 0).groupBy("conv_id").agg(R.ordered_text(label, label, "; ").alias("sources"))


@query(
    "unique_queries",
    """SELECT conv_id, turn, text, CASE WHEN regexp_matches(lower(text), '(why|not|fail|error|fault|alarm|problem)') THEN 2 ELSE 1 END + CASE WHEN turn % 3 = 0 THEN 0 ELSE 1 END AS n_queries FROM conversations WHERE role = 'user'""",
)
def unique_queries(spark, d):
    """The retrieval queries of a question, in order and without repeats: itself, a rewording, a booster where something is wrong."""
    wrong = F.lower("text").rlike("(why|not|fail|error|fault|alarm|problem)")
    reworded = F.when(C("turn") % 3 == 0, C("text")).otherwise(F.concat(F.lit("about: "), "text"))
    queries = F.array_distinct(F.array_compact(F.array(C("text"), reworded, F.when(wrong, F.concat(F.lit("troubleshooting "), "text")))))
    return read(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", "text", F.size(queries).alias("n_queries"))


@query(
    "sanitised_history",
    """WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS rn FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> ''),
    q AS (SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN text ELSE '?' END AS question FROM c WHERE rn = 1),
    k AS (SELECT c.*, row_number() OVER (PARTITION BY conv_id ORDER BY rn) AS place FROM c JOIN q USING (conv_id) WHERE NOT (rn = 1 AND role = 'user' AND trim(text) = trim(question)))
    SELECT conv_id, count(*) AS n, min(turn) AS first_turn, max(turn) AS last_turn FROM k WHERE place <= 8 GROUP BY conv_id""",
)
def sanitised_history(spark, d):
    """The last eight turns of each conversation without the question that is asked again at its end."""
    from pyspark.sql import Window

    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("text"))
    c = read(spark, d, "conversations").filter(C("role").isin("user", "assistant") & (F.trim("text") != ""))
    # Nine rows a conversation hold all eight that may remain.
    c = c.withColumn("rn", F.row_number().over(newest)).filter("rn <= 9").withColumn("last", F.first("text").over(newest))
    question = F.when(C("conv_id") % 2 == 0, C("last")).otherwise("?")
    repeated = (C("rn") == 1) & (C("role") == "user") & (F.trim("text") == F.trim(question))
    c = c.withColumn("dropped", F.max(F.when(repeated, 1).otherwise(0)).over(Window.partitionBy("conv_id")))
    kept = c.filter(~repeated & (C("rn") - C("dropped") <= 8))
    return kept.groupBy("conv_id").agg(F.count("*").alias("n"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


@query(
    "prompt_versions",
    """SELECT p_brand, coalesce(max_by(p_name, (p_size, p_partkey)) FILTER (WHERE p_retailprice > 1200), 'default') AS prompt FROM part GROUP BY p_brand""",
)
def prompt_versions(spark, d):
    """The highest active version of each key, else the default."""
    best = F.max_by(F.when(C("p_retailprice") > 1200, C("p_name")), F.when(C("p_retailprice") > 1200, F.struct("p_size", "p_partkey")))
    return read(spark, d, "part").groupBy("p_brand").agg(F.coalesce(best, F.lit("default")).alias("prompt"))


@query(
    "grouped_installs",
    """SELECT l_partkey, count(*) AS n, count(*) > 1 AS is_multiple, min_by(l_orderkey, (l_shipdate, l_orderkey, l_linenumber)) AS first_order, string_agg(l_orderkey::VARCHAR, ',' ORDER BY l_shipdate, l_orderkey, l_linenumber) AS instances FROM lineitem GROUP BY l_partkey""",
)
def grouped_installs(spark, d):
    """Instances of each item in first-seen order."""
    seen = F.struct("l_shipdate", "l_orderkey", "l_linenumber")
    g = read(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.min_by("l_orderkey", seen).alias("first_order"), R.ordered_text(C("l_orderkey"), seen).alias("instances"))
    return g.withColumn("is_multiple", C("n") > 1)


@query(
    "status_report",
    """WITH s AS (SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS approved, count(*) FILTER (WHERE o_orderstatus = 'P') AS draft, count(*) AS total FROM orders GROUP BY o_orderpriority),
    e AS (SELECT o_orderpriority, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS first_errors FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS rn FROM orders WHERE o_orderstatus = 'P') WHERE rn <= 8 GROUP BY o_orderpriority)
    SELECT s.*, coalesce(first_errors, '') AS first_errors FROM s LEFT JOIN e USING (o_orderpriority)""",
)
def status_report(spark, d):
    """Counts by status with the first eight errors of each source."""
    o = read(spark, d, "orders")
    counts = o.groupBy("o_orderpriority").agg(F.count_if(C("o_orderstatus") == "F").alias("approved"), F.count_if(C("o_orderstatus") == "P").alias("draft"), F.count("*").alias("total"))
    from pyspark.sql import Window

    first = o.filter("o_orderstatus = 'P'").withColumn("rn", F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("o_orderkey"))).filter("rn <= 8")
    errors = first.groupBy("o_orderpriority").agg(R.ordered_text(C("o_orderkey"), C("o_orderkey")).alias("first_errors"))
    return counts.join(errors, "o_orderpriority", "left").select("o_orderpriority", "approved", "draft", "total", F.coalesce("first_errors", F.lit("")).alias("first_errors"))


@query(
    "parent_counts",
    """SELECT r_regionkey, r_name, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS nations, (SELECT count(*) FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = r_regionkey) AS suppliers,
    (SELECT count(DISTINCT c_mktsegment) FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = r_regionkey) AS segments FROM region""",
)
def parent_counts(spark, d):
    """Children counted by parent before they are joined, so that no count fans out."""
    n = read(spark, d, "nation")
    of = lambda t, key, agg: read(spark, d, t).join(n, C(key) == C("n_nationkey")).groupBy("n_regionkey").agg(agg)
    r = read(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    for part in (n.groupBy("n_regionkey").agg(F.count("*").alias("nations")), of("supplier", "s_nationkey", F.count("*").alias("suppliers")), of("customer", "c_nationkey", F.count_distinct("c_mktsegment").alias("segments"))):
        r = r.join(part, "n_regionkey", "left")
    return r.select(C("n_regionkey").alias("r_regionkey"), "r_name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("nations", "suppliers", "segments")])
