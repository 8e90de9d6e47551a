"""Assembly queries: bundles and modules, edits of nested profiles, registry links and matches, over orders, parts and nations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import headings as H
from ..functions import matching as M
from ..operators import assembly as A
from ..operators import relational as R
from ..operators import retrieval
from ..sources.shared import new_path, written
from ..sources.tables import read
from .catalog import query

C = F.col


def bundles(spark, d):
    """A bundle a region: branding unless it is the last, systems of its even nations, checklists of its odd ones."""
    n = read(spark, d, "nation").join(read(spark, d, "region"), C("r_regionkey") == C("n_regionkey"))
    pair = F.struct(C("n_nationkey").cast("string"), C("n_name"))
    of = lambda odd: F.to_json(F.map_from_entries(F.collect_list(F.when(C("n_nationkey") % 2 == odd, pair))))
    b = n.groupBy("r_regionkey", "r_name").agg(of(0).alias("systems"), of(1).alias("checklists"))
    return b.select("r_regionkey", F.when(C("r_regionkey") < 4, C("r_name")).alias("branding"), "systems", "checklists")


@query(
    "split_modules",
    """SELECT r_regionkey, 'branding' AS content_type, 'branding' AS content_key, r_name AS payload FROM region WHERE r_regionkey < 4
    UNION ALL SELECT n_regionkey, CASE WHEN n_nationkey % 2 = 0 THEN 'systems' ELSE 'checklists' END, n_nationkey::VARCHAR, n_name FROM nation""",
)
def split_modules(spark, d):
    return A.split_bundle(bundles(spark, d), "r_regionkey", ["branding"], ["systems", "checklists"])


@query(
    "assembled_modules",
    """SELECT r_regionkey, CASE WHEN r_regionkey < 4 THEN r_name END AS branding, count(*) FILTER (WHERE n_nationkey % 2 = 0) AS systems, string_agg(n_name, ',' ORDER BY n_nationkey::VARCHAR) FILTER (WHERE n_nationkey % 2 = 1) AS checklists FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name""",
)
def assembled_modules(spark, d):
    """Bundles split, written as modules, and assembled again."""
    modules = written(A.split_bundle(bundles(spark, d), "r_regionkey", ["branding"], ["systems", "checklists"]), "modules")
    b = A.assembled(modules, "r_regionkey", ["branding"], ["systems", "checklists"])
    entries = lambda c: F.map_values(F.from_json(c, "map<string,string>"))
    return b.select("r_regionkey", "branding", F.size(entries("systems")).cast("long").alias("systems"), F.array_join(entries("checklists"), ",").alias("checklists"))


@query(
    "publication_errors",
    """SELECT r_regionkey, 'Missing branding module.' AS message FROM region WHERE r_regionkey = 4 UNION ALL SELECT r_regionkey, 'Warning: few systems.' FROM region WHERE (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey % 2 = 0) < 3""",
)
def publication_errors(spark, d):
    """What keeps a bundle from being published, and what only warns."""
    systems = F.size(F.map_keys(F.from_json("systems", "map<string,string>")))
    return A.publication_errors(bundles(spark, d), "r_regionkey", [(C("branding").isNull(), "Missing branding module."), (systems < 3, "Warning: few systems.")])


@query("ordered_systems", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey DESC) AS systems FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900) GROUP BY n_regionkey")
def ordered_systems(spark, d):
    """Published systems in the catalogue's order."""
    have = read(spark, d, "customer").filter("c_acctbal > 9900").select(C("c_nationkey").alias("n_nationkey"))
    n = read(spark, d, "nation").join(have, "n_nationkey", "left_semi")
    return n.groupBy("n_regionkey").agg(R.ordered_text(C("n_name"), -C("n_nationkey")).alias("systems"))


@query(
    "interleaved_photos",
    """SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'p1,a2,p2,c2' ELSE 'p1,p2,c2' END AS sections FROM nation""",
)
def interleaved_photos(spark, d):
    """Photos back at their places between generated sections; a section the new text lacks goes, a new one follows."""
    s = lambda t, p, b: F.struct(F.lit(t).alias("title"), F.lit(p).alias("photo"), F.lit(b).alias("body"))
    reference = F.array(s("p", True, "p1"), s("a", False, "a1"), s("p", True, "p2"), s("b", False, "b1"))
    generated = F.when(C("n_nationkey") % 2 == 0, F.array(s("a", False, "a2"), s("c", False, "c2"), s("q", True, "q2"))).otherwise(F.array(s("c", False, "c2"), s("", False, "x2")))
    n = read(spark, d, "nation").select("n_nationkey", reference.alias("r"), generated.alias("g"))
    return n.select("n_nationkey", F.array_join(F.transform(A.interleaved(C("r"), C("g")), lambda x: x["body"]), ",").alias("sections"))


def requiring(spark, d):
    """(device, requires, surfaces) a customer: an order is a requirement, a surface a priority."""
    o = read(spark, d, "orders")
    kind = F.when(C("o_orderkey") % 5 == 0, "software_app").otherwise("device")
    needed = F.when(C("o_orderkey") % 4 == 0, "").otherwise(F.concat(F.lit("surface "), F.left("o_orderpriority", F.lit(1))))
    requires = F.struct(C("o_orderkey").alias("k"), F.concat(F.lit("a "), "o_orderpriority").alias("text"), kind.alias("kind"), needed.alias("needed_for"))
    surfaces = F.struct(F.concat(F.lit("surface "), F.left("o_orderpriority", F.lit(1))).alias("path"), (F.left("o_orderpriority", F.lit(1)).cast("int") % 2 == 0).alias("optional"), F.when(C("o_orderpriority").startswith("2"), "").otherwise(C("o_orderpriority")).alias("label"))
    return o.groupBy(C("o_custkey").alias("device")).agg(F.array_sort(F.collect_list(requires)).alias("requires"), F.array_sort(F.collect_set(surfaces)).alias("surfaces"))


@query(
    "dropped_requirements",
    """WITH r AS (SELECT o_custkey AS device, 'a ' || o_orderpriority AS text, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, CASE WHEN o_orderkey % 4 = 0 THEN 'dangling_needed_for' WHEN substr(o_orderpriority, 1, 1)::INT % 2 = 1 AND o_orderkey % 5 <> 0 THEN 'contradiction_builtin_requires_accessory' END AS flag FROM orders)
    SELECT device, flag, i, text FROM r WHERE flag IS NOT NULL""",
)
def dropped_requirements(spark, d):
    """Requirements that contradict a built-in surface, or have no use, with what is told of each."""
    p = requiring(spark, d)
    _, repairs = A.dropped_requirements(C("requires"), C("surfaces"))
    return p.select("device", F.explode(repairs).alias("x")).select("device", "x.flag", C("x.i").cast("long").alias("i"), "x.text")


@query(
    "added_requirements",
    """WITH s AS (SELECT DISTINCT o_custkey AS device, o_orderpriority AS label, substr(o_orderpriority, 1, 1) AS no FROM orders WHERE substr(o_orderpriority, 1, 1) IN ('2', '4')),
    r AS (SELECT DISTINCT o_custkey AS device, o_orderpriority AS label, o_orderkey % 4 <> 0 AS used FROM orders)
    SELECT device, 'optional accessory' AS text, 'surface 2' AS needed_for FROM s WHERE no = '2' AND NOT EXISTS (SELECT 1 FROM r WHERE r.device = s.device AND r.label = s.label AND used)""",
)
def added_requirements(spark, d):
    """Requirements added for optional surfaces that nothing covers, by path or by name."""
    p = requiring(spark, d)
    return p.select("device", F.explode(A.added_requirements(C("requires"), C("surfaces"))).alias("x")).select("device", "x.text", "x.needed_for")


@query(
    "derived_actions",
    """SELECT o_custkey AS device, count(*) + CASE WHEN bool_or(o_orderstatus = 'P') AND NOT bool_or(o_orderpriority LIKE '1%') THEN 1 ELSE 0 END AS actions FROM orders GROUP BY o_custkey""",
)
def derived_actions(spark, d):
    """An action to look at errors where a device has an emergency procedure and no such action yet."""
    action = F.when(C("o_orderpriority").startswith("1"), "Check the error codes").otherwise(C("o_orderpriority"))
    p = read(spark, d, "orders").groupBy(C("o_custkey").alias("device")).agg(F.collect_list(action).alias("actions"), F.bool_or(C("o_orderstatus") == "P").alias("emergency"))
    derived = F.lit("Consult error codes and alarms")
    lacking = C("emergency") & ~F.exists("actions", lambda a: M.consults_errors(M.plain(a), M.plain(derived)))
    return p.select("device", F.size(F.when(lacking, F.array_append("actions", derived)).otherwise(C("actions"))).cast("long").alias("actions"))


@query(
    "filled_occasions",
    """WITH a AS (SELECT o_custkey AS device, o_orderkey AS k, o_orderstatus = 'F' AS given, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders WHERE contains(lower(o_orderpriority), 'high'))
    SELECT device, k, NOT given AS filled FROM a WHERE rn = 1""",
)
def filled_occasions(spark, d):
    """The first action with a text gets an occasion if it has none; nothing that is set is changed."""
    a = read(spark, d, "orders").groupBy(C("o_custkey").alias("device")).agg(F.array_sort(F.collect_list(F.when(F.lower("o_orderpriority").contains("high"), F.struct(C("o_orderkey").alias("k"), (C("o_orderstatus") == "F").alias("given"))))).alias("a"))
    return a.filter(F.size("a") > 0).select("device", C("a")[0]["k"].alias("k"), (~C("a")[0]["given"]).alias("filled"))


@query(
    "bound_evidence",
    """WITH a AS (SELECT o_custkey AS device, o_orderkey % 3 AS g, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 3 ORDER BY o_orderkey) - 1 AS i, lower(o_orderpriority) AS action FROM orders),
    e AS (SELECT device, g, i AS ei, CASE WHEN i % 2 = 0 THEN i ELSE i + 1 END AS target FROM a) SELECT e.device, e.g AS group_no, e.ei AS i, coalesce('operator_actions[' || a.action || ']', 'operator_actions[' || target || ']') AS field FROM e LEFT JOIN a ON a.device = e.device AND a.g = e.g AND a.i = target""",
)
def bound_evidence(spark, d):
    """Evidence bound to the texts of its own group's actions before groups are united; unknown places stay as they are."""
    g = read(spark, d, "orders").groupBy(C("o_custkey").alias("device"), (C("o_orderkey") % 3).alias("group_no")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", F.lower("o_orderpriority").alias("action")))).alias("a"))
    e = g.select("device", "group_no", "a", F.explode(F.sequence(F.lit(0), F.size("a") - 1)).alias("i"))
    target = F.when(C("i") % 2 == 0, C("i")).otherwise(C("i") + 1)
    text = F.coalesce(F.get("a", target)["action"], target.cast("string"))
    return e.select("device", "group_no", C("i").cast("long").alias("i"), F.concat(F.lit("operator_actions["), text, F.lit("]")).alias("field"))


@query("coalesced_groups")
def coalesced_groups(spark, d):
    """Chapters of a device merged, the smallest neighbours first, until three are left; held against a plain loop."""
    o = read(spark, d, "orders")
    return A.coalesced(chapters(o), "device", 3)


def chapters(orders):
    """(device, ord, name, size, intro) of what is grouped."""
    no = F.left("o_orderpriority", F.lit(1))
    return orders.groupBy(C("o_custkey").alias("device"), no.alias("name")).agg(F.count("*").alias("size")).select("device", C("name").alias("ord"), "name", "size", (C("name") == "1").alias("intro"))


@query(
    "matched_manuals",
    """WITH ix(token, manual) AS (VALUES ('ring', 1), ('red', 2), ('bolt', 3)), t AS (SELECT p_partkey, p_brand, unnest(string_split(p_name, ' ')) AS tok, unnest(range(len(string_split(p_name, ' ')))) AS pos FROM part),
    h AS (SELECT p_partkey, min_by(manual, pos) AS manual FROM t JOIN ix ON tok = token GROUP BY p_partkey) SELECT p.p_partkey, coalesce(h.manual, CASE WHEN p_brand = 'Brand#2' THEN 9 END) AS manual FROM part p LEFT JOIN h USING (p_partkey)""",
)
def matched_manuals(spark, d):
    """The manual of the first of a model's words that has one, else the brand's."""
    ix = spark.createDataFrame([("ring", 1), ("red", 2), ("bolt", 3)], "token string, manual int")
    t = read(spark, d, "part").select("p_partkey", F.posexplode(F.filter(F.split("p_name", r"[\s\-/()_]+"), lambda w: F.length(w) >= 2)).alias("pos", "token"))
    h = t.join(F.broadcast(ix), "token").groupBy("p_partkey").agg(F.min_by("manual", "pos").alias("manual"))  # three rows
    brand = F.when(C("p_brand") == "Brand#2", 9)
    return read(spark, d, "part").join(h, "p_partkey", "left").select("p_partkey", F.coalesce("manual", brand).alias("manual"))


@query(
    "linked_registry",
    """WITH o AS (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 1 ELSE p_partkey % 150 END AS s FROM part) SELECT p_partkey, s_suppkey AS equipment FROM o LEFT JOIN supplier ON s_suppkey = s AND s_acctbal > 0""",
)
def linked_registry(spark, d):
    """A profile's registry row by its override, else by its own key; exact, none where there is none."""
    overrides = F.when(C("p_partkey") % 10 == 0, F.lit(1).cast("long"))
    p = read(spark, d, "part").select("p_partkey", F.coalesce(overrides, C("p_partkey") % 150).alias("s"))
    return p.join(read(spark, d, "supplier").filter("s_acctbal > 0").select(C("s_suppkey").alias("equipment")), C("equipment") == C("s"), "left").select("p_partkey", "equipment")


@query(
    "attached_places",
    """SELECT s_suppkey, coalesce(string_agg(p_size || ':' || p_partkey, ',' ORDER BY p_size, p_partkey), '') AS places FROM supplier LEFT JOIN (SELECT DISTINCT l_suppkey, p_size, p_partkey FROM lineitem JOIN part ON p_partkey = l_partkey AND p_size % 7 = l_suppkey % 7 WHERE l_quantity > 30) ON l_suppkey = s_suppkey GROUP BY s_suppkey""",
)
def attached_places(spark, d):
    """Places of each item as one ordered list, joined on two keys."""
    li = read(spark, d, "lineitem").filter("l_quantity > 30").select(C("l_suppkey").alias("s_suppkey"), "l_partkey").withColumn("m", C("s_suppkey") % 7)
    p = read(spark, d, "part").select(C("p_partkey").alias("l_partkey"), "p_size", (C("p_size") % 7).cast("long").alias("m"))
    places = li.join(p, ["l_partkey", "m"]).groupBy("s_suppkey").agg(F.array_sort(F.collect_set(F.struct("p_size", "l_partkey"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: F.concat_ws(":", x["p_size"].cast("string"), x["l_partkey"].cast("string"))), ",")
    return read(spark, d, "supplier").join(places, "s_suppkey", "left").select("s_suppkey", F.coalesce(text, F.lit("")).alias("places"))


@query(
    "hull_packs",
    """SELECT p_partkey, coalesce(n_items, 0) AS items, coalesce(n_makers, 0) AS makers FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n_items, count(DISTINCT l_suppkey) AS n_makers FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey WHERE p_partkey IN (SELECT l_partkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey = 3)""",
)
def hull_packs(spark, d):
    """Packs that apply to one hull, with their counts; what is counted is grouped before it is joined."""
    li = read(spark, d, "lineitem")
    one = li.join(read(spark, d, "supplier").filter("s_nationkey = 3").select(C("s_suppkey").alias("l_suppkey")), "l_suppkey", "left_semi").select("l_partkey").distinct()
    counts = li.groupBy("l_partkey").agg(F.count("*").alias("items"), F.count_distinct("l_suppkey").alias("makers"))
    p = read(spark, d, "part").select(C("p_partkey").alias("l_partkey")).join(one, "l_partkey", "left_semi").join(counts, "l_partkey", "left")
    return p.select(C("l_partkey").alias("p_partkey"), F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("makers", F.lit(0)).alias("makers"))


@query("aboard_profiles", "SELECT c_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS relations FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey IN (SELECT DISTINCT s_nationkey FROM supplier WHERE s_acctbal > 5000) GROUP BY c_custkey")
def aboard_profiles(spark, d):
    """Profiles that are aboard, with their relations as ordered lists."""
    aboard = read(spark, d, "supplier").filter("s_acctbal > 5000").select(C("s_nationkey").alias("c_nationkey")).distinct()
    c = read(spark, d, "customer").join(aboard, "c_nationkey", "left_semi").select(C("c_custkey").alias("o_custkey"))
    r = read(spark, d, "orders").join(c, "o_custkey").groupBy(C("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias("r"))
    return r.select("c_custkey", F.array_join("r", ",").alias("relations"))


@query(
    "loaded_fragments",
    """SELECT o_custkey, o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' AND c_acctbal > 0) WHERE rn = 1""",
)
def loaded_fragments(spark, d):
    """The newest approved fragment of each key of active owners."""
    active = read(spark, d, "customer").filter("c_acctbal > 0").select(C("c_custkey").alias("o_custkey"))
    o = read(spark, d, "orders").filter("o_orderstatus = 'F'").join(active, "o_custkey")
    return o.groupBy("o_custkey", "o_orderpriority").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query(
    "asserted_circuits",
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 OR (contains(p_name, 'ring') AND p_brand LIKE '%1%') THEN 'asserted' ELSE 'context_shaping' END AS render_as FROM part WHERE p_size % 11 <> 0""",
)
def asserted_circuits(spark, d):
    """Circuits told as facts if they are standard, or if a rule finds them and what they feed in the inventory."""
    rules = [("ring", "1")]
    corroborated = F.lit(False)
    for circuit, inventory in rules:
        corroborated = corroborated | (C("p_name").rlike(rf"(?i)\b{circuit}\b") & C("p_brand").rlike(inventory))
    standard = C("p_size") % 3 == 0
    return read(spark, d, "part").filter("p_size % 11 <> 0").select("p_partkey", F.when(standard | corroborated, "asserted").otherwise("context_shaping").alias("render_as"))


@query(
    "assigned_chapters",
    """WITH h(chapter, word) AS (VALUES ('Rings', 'ring'), ('Bolts', 'bolt'), ('Reds', 'red')), s AS (SELECT p_partkey, chapter, CASE WHEN p_name LIKE word || ' %' THEN 2 ELSE 1 END AS score FROM part JOIN h ON list_contains(string_split(p_name, ' '), word)),
    r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, chapter) AS rn FROM s) SELECT p_partkey, chapter, score FROM r WHERE rn = 1""",
)
def assigned_chapters(spark, d):
    """Excerpts given to the chapter of the best score; those without any stay unassigned."""
    words = {"Bolts": "bolt", "Reds": "red", "Rings": "ring"}
    name = C("p_name")
    scored = F.array_compact(F.array(*[F.when(F.array_contains(F.split(name, " "), w), F.struct((-F.when(name.startswith(f"{w} "), 2).otherwise(1)).alias("s"), F.lit(c).alias("c"))) for c, w in words.items()]))
    best = F.array_min(scored)
    return read(spark, d, "part").select("p_partkey", best["c"].alias("chapter"), (-best["s"]).alias("score")).filter("chapter IS NOT NULL")


@query("role_buckets", "SELECT p_partkey, CASE WHEN p_name LIKE 'red ring%' THEN 'shape' WHEN p_name LIKE '%ring' OR p_name LIKE '%bolt' THEN 'shape' WHEN p_name LIKE 'red%' OR p_name LIKE 'blue%' THEN 'colour' ELSE 'other' END AS bucket FROM part")
def role_buckets(spark, d):
    """The role whose words hit most, the first listed among equals."""
    buckets = {"shape": ["ring", "bolt"], "colour": ["red", "blue"]}
    hits = [F.struct(F.size(F.filter(F.split("p_name", " "), within(w))).alias("n"), F.lit(-i).alias("o"), F.lit(b).alias("b")) for i, (b, w) in enumerate(buckets.items())]
    best = F.array_max(F.array(*hits))
    return read(spark, d, "part").select("p_partkey", F.when(best["n"] > 0, best["b"]).otherwise("other").alias("bucket"))


def within(words: list[str]):
    return lambda w: w.isin(*words)


@query(
    "rejected_titles",
    """SELECT k, reason FROM (SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'too_short' WHEN 2 THEN 'too_few_tokens' WHEN 3 THEN 'toc_artifact' WHEN 4 THEN 'figure_caption' ELSE 'no_imperative_verb' END AS reason FROM orders)""",
)
def rejected_titles(spark, d):
    """Why a title is no procedure: the first filter that applies."""
    titles = ["Replace the fuse", "Stop", "Maintenance", "Replace fuse ....... 12", "Figure 3 Replace the fuse", "The fuse of the pump"]
    t = F.trim(F.get(F.array(*[F.lit(x) for x in titles]), (C("o_orderkey") % 6).cast("int")))
    reason = (
        F.when(F.length(t) < 6, "too_short").when(F.size(H.words(t)) < 2, "too_few_tokens").when(t.rlike(r"\.{3,}|\s\d+$"), "toc_artifact").when(t.rlike(r"(?i)^(figure|fig\.|table)\s+\d"), "figure_caption")
        .when(~t.rlike(r"(?i)\b(replace|install|set|reset|check|clean|start|stop|open|close|remove|connect|turn)\b"), "no_imperative_verb")
    )
    return read(spark, d, "orders").select(C("o_orderkey").alias("k"), reason.alias("reason"))


@query("synced_assets", "SELECT page_id, md5(html) AS digest, page_id % 4 <> 0 AS present FROM pages WHERE page_id % 3 <> 0")
def synced_assets(spark, d):
    """A manifest with what is missing from the store; the client's cache by hash lacks two thirds of the pages."""
    pages = read(spark, d, "pages").select("page_id", F.md5(C("html").cast("binary")).alias("digest"))
    cache = pages.filter("page_id % 3 = 0")
    store = pages.filter("page_id % 4 <> 0").select("digest").distinct().withColumn("here", F.lit(True))
    return pages.join(cache, ["page_id", "digest"], "left_anti").join(store, "digest", "left").select("page_id", "digest", F.coalesce("here", F.lit(False)).alias("present"))


@query(
    "hashed_assets",
    """SELECT n_nationkey, sha256(n_name) AS digest, octet_length(encode(n_name)) AS bytes, false AS missing FROM nation WHERE n_nationkey % 5 <> 0 UNION ALL SELECT n_nationkey, NULL, NULL, true FROM nation WHERE n_nationkey % 5 = 0""",
)
def hashed_assets(spark, d):
    """Assets named in documents with hash and size of the files they name; files that are not there are missing."""
    folder = new_path(spark, "assets")
    n = read(spark, d, "nation")
    n.filter("n_nationkey % 5 <> 0").select(C("n_name"), C("n_nationkey").alias("id")).repartition(4, "id").write.partitionBy("id").text(folder)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(folder)
    body = F.rtrim(C("content").cast("string"))
    body = F.regexp_replace(body, r"\n$", "")
    found = files.select(F.regexp_extract("path", r"id=(\d+)", 1).cast("int").alias("n_nationkey"), F.sha2(body.cast("binary"), 256).alias("digest"), F.length(body.cast("binary")).cast("long").alias("bytes"))
    return n.select("n_nationkey").join(found, "n_nationkey", "left").select("n_nationkey", "digest", "bytes", C("digest").isNull().alias("missing"))


@query(
    "ingested_chunks",
    """SELECT label, count(*) AS chunks, sum(vec_id)::BIGINT AS ids FROM embeddings WHERE label <> 2 GROUP BY label UNION ALL SELECT 2, count(*), sum(vec_id)::BIGINT FROM embeddings WHERE label = 2 AND vec_id % 2 = 0""",
)
def ingested_chunks(spark, d):
    """Chunks written a manual a partition; one manual is ingested again and replaces only its own partition."""
    path = new_path(spark, "chunks")
    e = read(spark, d, "embeddings").select("vec_id", "label")
    write = lambda df, **how: df.repartition("label").write.mode("overwrite").partitionBy("label").options(**how).parquet(path)
    write(e)
    write(e.filter("label = 2 AND vec_id % 2 = 0"), partitionOverwriteMode="dynamic")
    return spark.read.parquet(path).groupBy("label").agg(F.count("*").alias("chunks"), F.sum("vec_id").alias("ids"))


@query(
    "rewritten_registry",
    "SELECT s_suppkey::VARCHAR AS s_suppkey, CASE WHEN s_acctbal < 0 THEN 'failed' ELSE 'done' END AS status FROM supplier",
)
def rewritten_registry(spark, d):
    """A registry file rewritten by way of a staged copy: readers see the old file or the new one."""
    base, staged = new_path(spark, "registry"), new_path(spark, "registry-staged")
    s = read(spark, d, "supplier")
    s.select("s_suppkey", F.lit("new").alias("status"), "s_acctbal").write.csv(base, header=True)
    old = spark.read.csv(base, header=True)
    old.select("s_suppkey", F.when(C("s_acctbal").cast("double") < 0, "failed").otherwise("done").alias("status")).write.csv(staged, header=True)
    return spark.read.csv(staged, header=True)


@query("bank_estimates", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL ELSE round((p_size % 4 + 1) * p_size / 10.0, 3)::DOUBLE END AS kwh FROM part")
def bank_estimates(spark, d):
    """Energy of a bank: its number of units times what the model's name says, null where it says nothing."""
    model = F.when(C("p_size") % 4 == 0, "Lithium bank").otherwise(F.concat(F.lit("Lithium "), F.format_string("%.1f", C("p_size") / 10), F.lit(" kWh")))
    each = F.nullif(F.regexp_extract(model, r"(?i)(\d+(?:\.\d+)?)\s*kwh", 1), F.lit("")).cast("double")
    return read(spark, d, "part").select("p_partkey", F.round((C("p_size") % 4 + 1) * each, 3).alias("kwh"))


@query(
    "english_parts",
    """WITH b AS (SELECT doc_id, lang, trim(unnest(string_split_regex(text, '\\n\\s*\\n')), E' \\n\\t\\r') AS block FROM documents) SELECT doc_id, count(*) FILTER (WHERE block <> '') AS blocks FROM b GROUP BY doc_id""".replace("\\\\", "\\").replace("E' \\n\\t\\r'", "' ' || chr(10) || chr(9) || chr(13)"),
)
def english_parts(spark, d):
    """Blocks between blank lines of each document."""
    blocks = F.filter(F.transform(F.split("text", r"\n\s*\n"), lambda b: F.trim(b, F.lit(" \n\t\r"))), lambda b: b != "")
    return read(spark, d, "documents").select("doc_id", F.size(blocks).cast("long").alias("blocks")).filter("blocks IS NOT NULL")


@query("log_pages", "SELECT conv_id, turn, text FROM conversations WHERE role = 'user' AND conv_id % 2 = 1 ORDER BY turn DESC, conv_id, text LIMIT 50")
def log_pages(spark, d):
    """A page of the log by the filters that are set."""
    from ..operators import predicates as P

    return P.search(read(spark, d, "conversations").filter("conv_id % 2 = 1"), equals={"role": "user", "conv_id": None}).select("conv_id", "turn", "text").orderBy(F.desc("turn"), "conv_id", "text").limit(50)


@query("version_diff", "SELECT s AS sentence, 'added' AS change FROM (SELECT DISTINCT p_name || p_brand AS s FROM part WHERE p_size > 20 EXCEPT SELECT p_name || p_brand FROM part WHERE p_size <= 20) UNION ALL SELECT s, 'removed' FROM (SELECT DISTINCT p_name || p_brand AS s FROM part WHERE p_size <= 20 EXCEPT SELECT p_name || p_brand FROM part WHERE p_size > 20)")
def version_diff(spark, d):
    """Sentences that one version of a section has and the other lacks."""
    p = read(spark, d, "part")
    new, old = (p.filter(w).select(F.concat("p_name", "p_brand").alias("sentence")) for w in ("p_size > 20", "p_size <= 20"))
    diff = R.differences(new, old)
    return diff.select("sentence", F.when(C("missing_in") == "right", "added").otherwise("removed").alias("change"))

