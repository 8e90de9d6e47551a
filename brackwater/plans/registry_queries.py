"""Registry queries: bundles of files, key checks, pack graphs, upserts and links, over parts, suppliers, nations and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import coerce
from ..operators import registry as G
from ..operators import relational as R
from ..sources.shared import new_path, written
from ..sources.tables import read
from .catalog import query

C = F.col
FILES = {"hulls": "hulls.csv", "packs": "packs.csv", "links": "links.csv"}
SOURCES = ["STANDARD", "SMALL", "MEDIUM", "LARGE"]


def bundle(spark, d):
    """Three CSV files made of nation, part and both, written and loaded again as text."""
    folder = new_path(spark, "bundle")
    n, p = read(spark, d, "nation"), read(spark, d, "part")
    n.select(C("n_regionkey").alias("manufacturer"), C("n_nationkey").alias("model_code"), "n_name").write.csv(f"{folder}/{FILES['hulls']}", header=True)
    packs = p.select(C("p_brand").alias("manufacturer"), C("p_partkey").alias("pack"), F.split("p_type", " ")[0].alias("source"), F.when(C("p_size") % 10 != 0, C("p_name")).otherwise("  ").alias("title"))
    packs.write.csv(f"{folder}/{FILES['packs']}", header=True)
    p.filter("p_retailprice > 1000").select((C("p_partkey") * 2).alias("pack"), (C("p_size") % 30).alias("model_code")).write.csv(f"{folder}/{FILES['links']}", header=True)
    return G.read_bundle(spark, folder, FILES)


@query(
    "csv_bundle",
    """WITH packs AS (SELECT p_brand AS manufacturer, p_partkey::VARCHAR AS pack, string_split(p_type, ' ')[1] AS source, CASE WHEN p_size % 10 <> 0 THEN p_name ELSE '  ' END AS title FROM part),
    links AS (SELECT (p_partkey * 2)::VARCHAR AS pack, (p_size % 30)::VARCHAR AS model_code FROM part WHERE p_retailprice > 1000)
    SELECT 'missing' AS check_name, pack AS subject, 'title' AS detail FROM packs WHERE trim(title) = ''
    UNION ALL SELECT 'enum', pack, 'source' FROM packs WHERE source NOT IN ('STANDARD', 'SMALL', 'MEDIUM', 'LARGE')
    UNION ALL SELECT 'unknown_pack', pack, model_code FROM links WHERE pack NOT IN (SELECT pack FROM packs)
    UNION ALL SELECT 'unknown_hull', pack, model_code FROM links WHERE model_code NOT IN (SELECT n_nationkey::VARCHAR FROM nation)
    UNION ALL SELECT 'uncovered', pack, '' FROM packs WHERE pack NOT IN (SELECT pack FROM links)""",
)
def csv_bundle(spark, d):
    b = bundle(spark, d)
    packs, links = b["packs"], b["links"]
    named = lambda df, name, subject, detail: df.select(F.lit(name).alias("check_name"), subject.alias("subject"), detail.alias("detail"))
    out = named(G.missing_required(packs, C("pack"), ["title"]), "missing", C("key"), C("column"))
    out = out.unionByName(named(G.outside_enum(packs, C("pack"), "source", SOURCES), "enum", C("key"), C("column")))
    out = out.unionByName(named(G.unknown_keys(links, ["pack"], packs, ["pack"]), "unknown_pack", C("pack"), C("model_code")))
    out = out.unionByName(named(G.unknown_keys(links, ["model_code"], b["hulls"], ["model_code"]), "unknown_hull", C("pack"), C("model_code")))
    return out.unionByName(named(G.uncovered(packs, "pack", links), "uncovered", C("pack"), F.lit("")))


@query("keyed_json", "SELECT n_nationkey::VARCHAR AS key, n_name AS name, CASE WHEN n_regionkey % 2 = 0 THEN 'map' ELSE 'list' END AS form FROM nation")
def keyed_json(spark, d):
    """A region's nations as one JSON document, a map or a list by turns, and the bodies out of both again."""
    n = read(spark, d, "nation").withColumn("form", F.when(C("n_regionkey") % 2 == 0, "map").otherwise("list"))
    body = F.struct(C("n_nationkey").cast("string").alias("key"), C("n_name").alias("name"), "form")
    docs = n.groupBy("n_regionkey").agg(
        F.when(F.first("form") == "map", F.to_json(F.map_from_entries(F.collect_list(F.struct(C("n_nationkey").cast("string").alias("k"), F.to_json(body).alias("v"))))))
        .otherwise(F.to_json(F.collect_list(body))).alias("doc")
    )
    out = G.keyed_json(docs, "doc", "key")
    return out.select("key", F.get_json_object("body", "$.name").alias("name"), F.get_json_object("body", "$.form").alias("form"))


@query(
    "matrix_file",
    """SELECT s_nationkey AS table_no, s_suppkey::DOUBLE AS row, t.c::DOUBLE AS "column", s_acctbal / t.c AS value FROM supplier, (VALUES (4), (8), (12)) t(c) WHERE s_suppkey % 6 <> 0""",
)
def matrix_file(spark, d):
    """Tab-separated lines of a number and three cells; one line in six has a field too few and is left out."""
    cells = [(C("s_acctbal") / k).cast("string") for k in (4, 8, 12)]
    line = F.when(C("s_suppkey") % 6 != 0, F.concat_ws("\t", C("s_suppkey").cast("string"), *cells)).otherwise(F.concat_ws("\t", C("s_suppkey").cast("string"), *cells[:2]))
    return G.matrix_rows(read(spark, d, "supplier").select(C("s_nationkey").alias("table_no"), line.alias("line")), "line", ["4", "8", "12"], "table_no")


@query(
    "typed_rows",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN true WHEN o_orderkey % 5 = 1 THEN false WHEN o_orderkey % 5 = 2 THEN NULL ELSE o_orderkey % 5 = 3 END AS flag,
    CASE WHEN o_orderkey % 4 = 0 THEN 7 WHEN o_orderkey % 4 = 1 THEN NULL ELSE o_orderkey END AS number,
    CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN o_totalprice END AS price,
    CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus || ';' || replace(o_orderpriority, ' ', '') END AS parts,
    CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 0 END AS n_items FROM orders""",
)
def typed_rows(spark, d):
    """Texts of flags, numbers, lists and JSON, some of them bad, coerced with defaults and nulls."""
    k = C("o_orderkey")
    o = read(spark, d, "orders")
    o = o.withColumn("f", F.when(k % 5 == 0, " YES ").when(k % 5 == 1, "0").when(k % 5 == 2, "maybe").when(k % 5 == 3, "  ").otherwise("n"))
    o = o.withColumn("i", F.when(k % 4 == 0, "").when(k % 4 == 1, "1.5").otherwise(F.concat(F.lit(" "), k.cast("string"))))
    o = o.withColumn("x", F.when(k % 3 == 0, "NaN").when(k % 3 == 1, C("o_totalprice").cast("string")).otherwise("true"))
    o = o.withColumn("p", F.when(k % 3 == 0, " ,|").otherwise(F.concat("o_orderstatus", F.lit(" | ,"), F.replace("o_orderpriority", F.lit(" "), F.lit("")))))
    o = o.withColumn("j", F.when(k % 2 == 0, '["a", "b"]').otherwise('{"a": 1'))
    return o.select("o_orderkey", coerce.flag(C("f"), True, strict=False).alias("flag"), coerce.integer(C("i"), 7, "i", strict=False).alias("number"), coerce.number(C("x")).alias("price"), F.array_join(coerce.parts(C("p")), ";").alias("parts"), F.size(coerce.json_list(C("j"))).alias("n_items"))


def halves(spark, d):
    """Pack p holds pack p div 2 (first) and p div 3 (second): branches that meet again, no cycle."""
    p = C("p_partkey")
    child = F.array(F.struct(F.lit("a").alias("ord"), F.floor(p / 2).alias("child")), F.struct(F.lit("b").alias("ord"), F.floor(p / 3).alias("child")))
    return read(spark, d, "part").select(p.alias("parent"), F.explode(child).alias("e")).select("parent", "e.child", "e.ord").filter("child > 0")


@query(
    "pack_expansion",
    """WITH RECURSIVE e(root, node, depth, path) AS (SELECT p_partkey, p_partkey, 0, '' FROM part
    UNION ALL SELECT e.root, e.node // k.k, e.depth + 1, e.path || k.o FROM e, (VALUES (2, 'a'), (3, 'b')) k(k, o) WHERE e.node // k.k > 0),
    f AS (SELECT root, node, min(path) AS path FROM e GROUP BY root, node)
    SELECT root, count(*) AS n_nodes, string_agg(node::VARCHAR, ',' ORDER BY path) AS walk FROM f GROUP BY root""",
)
def pack_expansion(spark, d):
    """Every pack with all it holds, in depth-first order, each once."""
    out = G.walks(halves(spark, d), read(spark, d, "part").select(C("p_partkey").alias("root")))
    return out.select("root", F.size("walk").cast("long").alias("n_nodes"), F.array_join(C("walk").cast("array<string>"), ",").alias("walk"))


@query(
    "pack_cycles",
    """WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey // 2 AS b FROM part WHERE p_partkey > 1 UNION SELECT p_partkey // 8, p_partkey FROM part WHERE p_size = 7 AND p_partkey >= 8),
    r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
    c AS (SELECT a AS node FROM r WHERE a = b)
    SELECT DISTINCT node FROM (SELECT node FROM c UNION ALL SELECT x.b FROM r x JOIN c ON c.node = x.a WHERE x.b IN (SELECT r.a FROM r JOIN c ON c.node = r.b))""",
)
def pack_cycles(spark, d):
    """Packs on a cycle, in a graph that some links close; the acyclic one of ``pack_expansion`` gives none."""
    p = read(spark, d, "part")
    down = p.filter("p_partkey > 1").select(C("p_partkey").alias("parent"), F.floor(C("p_partkey") / 2).alias("child"))
    up = p.filter("p_size = 7 AND p_partkey >= 8").select(F.floor(C("p_partkey") / 8).alias("parent"), C("p_partkey").alias("child"))
    return G.cycle_core(down.unionByName(up))


@query(
    "refused_links",
    """WITH RECURSIVE u(start, node) AS (SELECT p_partkey, p_partkey FROM part UNION SELECT u.start, u.node // k.k FROM u, (VALUES (2), (3)) k(k) WHERE u.node // k.k > 0)
    SELECT parent, child, EXISTS (SELECT 1 FROM u WHERE start = child AND node = parent) AS refused FROM (
      SELECT p_partkey // 4 AS parent, p_partkey AS child FROM part UNION SELECT p_partkey, p_size::BIGINT FROM part)""",
)
def refused_links(spark, d):
    """New links between packs, and whether each would close a cycle."""
    p = read(spark, d, "part")
    proposals = p.select(F.floor(C("p_partkey") / 4).alias("parent"), C("p_partkey").alias("child")).unionByName(p.select(C("p_partkey").alias("parent"), C("p_size").cast("long").alias("child"))).distinct()
    return G.closes_cycle(halves(spark, d), proposals)


@query(
    "applied_packs",
    """WITH RECURSIVE e(root, node) AS (SELECT p_partkey, p_partkey FROM part UNION SELECT e.root, e.node // k.k FROM e, (VALUES (2), (3)) k(k) WHERE e.node // k.k > 0),
    wanted AS (SELECT DISTINCT s_nationkey AS vessel, node FROM supplier JOIN e ON root = s_suppkey JOIN part ON p_partkey = s_suppkey AND p_size % 3 <> 0),
    present AS (SELECT DISTINCT c_nationkey AS vessel, c_custkey AS node FROM customer)
    SELECT vessel, count(*) AS added, min(node) AS first_added, sum(node)::BIGINT AS total FROM (SELECT * FROM wanted EXCEPT SELECT * FROM present) GROUP BY vessel""",
)
def applied_packs(spark, d):
    """Packs put on vessels where they apply: expanded, what is there already left out, the rest counted."""
    applicable = read(spark, d, "part").filter("p_size % 3 <> 0").select(C("p_partkey").alias("root"))
    chosen = read(spark, d, "supplier").select(C("s_nationkey").alias("vessel"), C("s_suppkey").alias("root")).join(applicable, "root")
    below = G.expand(halves(spark, d), applicable)
    wanted = chosen.join(below, "root").select("vessel", "node").distinct()
    present = read(spark, d, "customer").select(C("c_nationkey").alias("vessel"), C("c_custkey").alias("node"))
    return wanted.join(present, ["vessel", "node"], "left_anti").groupBy("vessel").agg(F.count("*").alias("added"), F.min("node").alias("first_added"), F.sum("node").alias("total"))


@query(
    "upsert_counts",
    """WITH b AS (SELECT CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_brand END AS maker, p_partkey AS model, p_name AS title FROM part),
    n AS (SELECT CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_brand END AS maker, p_partkey AS model, upper(p_name) AS title FROM part WHERE p_size > 40
          UNION ALL SELECT p_brand, -p_partkey, p_name FROM part WHERE p_size < 3)
    SELECT change, count(*) AS n, count(title) AS titles, sum(length(title))::BIGINT AS letters FROM (
      SELECT CASE WHEN b.model IS NULL THEN 'inserted' WHEN n.model IS NULL THEN 'kept' ELSE 'updated' END AS change, coalesce(n.title, b.title) AS title
      FROM b FULL JOIN n ON b.maker IS NOT DISTINCT FROM n.maker AND b.model IS NOT DISTINCT FROM n.model) GROUP BY change""",
)
def upsert_counts(spark, d):
    """Rows inserted, updated and kept by a natural key that may be null in part."""
    p = read(spark, d, "part")
    maker = F.when(C("p_partkey") % 9 != 0, C("p_brand")).alias("maker")
    base = p.select(maker, C("p_partkey").alias("model"), C("p_name").alias("title"))
    new = p.filter("p_size > 40").select(maker, C("p_partkey").alias("model"), F.upper("p_name").alias("title"))
    new = new.unionByName(p.filter("p_size < 3").select(C("p_brand").alias("maker"), (-C("p_partkey")).alias("model"), C("p_name").alias("title")))
    out = G.upsert_counted(base, new, ["maker", "model"], ["title"])
    return out.groupBy("change").agg(F.count("*").alias("n"), F.count("title").alias("titles"), F.sum(F.length("title")).alias("letters"))


@query(
    "reloaded_links",
    """WITH base AS (SELECT l_suppkey AS owner, l_partkey AS item FROM lineitem WHERE l_quantity > 10), new AS (SELECT l_suppkey AS owner, l_partkey AS item FROM lineitem WHERE l_quantity > 45 AND l_suppkey % 2 = 0)
    SELECT owner, count(*) AS items, sum(item)::BIGINT AS total FROM (SELECT owner, item FROM base WHERE owner NOT IN (SELECT owner FROM new) UNION SELECT owner, item FROM new) GROUP BY owner""",
)
def reloaded_links(spark, d):
    """Links of the owners in a new file replaced as a whole, those of others kept; loading twice changes nothing."""
    li = read(spark, d, "lineitem").select(C("l_suppkey").alias("owner"), C("l_partkey").alias("item"), "l_quantity")
    new = li.filter("l_quantity > 45 AND owner % 2 = 0")
    once = G.reload_links(li.filter("l_quantity > 10"), new, "owner", ["owner", "item"])
    return G.reload_links(once, new, "owner", ["owner", "item"]).groupBy("owner").agg(F.count("*").alias("items"), F.sum("item").alias("total"))


@query(
    "superseded_drafts",
    """WITH k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_orderstatus = 'O')
    SELECT o.o_orderkey, CASE WHEN o.o_orderstatus <> 'O' THEN o.o_orderstatus WHEN k.rn = 1 THEN 'O' ELSE 'superseded' END AS status, coalesce(k.rn = 1, false) AS is_current FROM orders o LEFT JOIN k USING (o_orderkey)""",
)
def superseded_drafts(spark, d):
    """Of a customer's open orders the newest stays and is current; the others are superseded. One aggregate, one join by customer."""
    o = read(spark, d, "orders")
    keep = o.filter("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("keep_id"))
    current = F.coalesce(C("o_orderkey") == C("keep_id"), F.lit(False))
    status = F.when((C("o_orderstatus") == "O") & ~current, "superseded").otherwise(C("o_orderstatus"))
    return o.join(keep, "o_custkey", "left").select("o_orderkey", status.alias("status"), current.alias("is_current"))


@query(
    "swept_orphans",
    """WITH links AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01'), gone AS (SELECT s_suppkey FROM supplier WHERE s_acctbal < 4000)
    SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM links WHERE l_suppkey NOT IN (SELECT s_suppkey FROM gone))""",
)
def swept_orphans(spark, d):
    """Parts left without any link after suppliers are deleted with their links."""
    gone = read(spark, d, "supplier").filter("s_acctbal < 4000").select(C("s_suppkey").alias("l_suppkey"))
    links = read(spark, d, "lineitem").filter("l_shipdate < TIMESTAMP_NTZ '1996-01-01'").select("l_partkey", "l_suppkey").join(gone, "l_suppkey", "left_anti")
    return read(spark, d, "part").join(links, C("l_partkey") == C("p_partkey"), "left_anti").select("p_partkey")


@query(
    "saved_documents",
    """SELECT doc_id, revision, length(body) AS n_chars FROM (SELECT doc_id, text AS body, 1 AS revision FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    UNION ALL SELECT doc_id, text || '!', 2 FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))""",
)
def saved_documents(spark, d):
    """A keyed table written, then changed rows saved over it: the keyed overwrite gives one row a key, with its revision."""
    docs = read(spark, d, "documents").select("doc_id", C("text").alias("body"))
    first = docs.withColumn("revision", F.lit(1))
    changed = docs.join(read(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select("doc_id", F.concat("body", F.lit("!")).alias("body"), F.lit(2).alias("revision"))
    return R.overlay(written(first, "saved"), changed, ["doc_id"]).select("doc_id", "revision", F.length("body").cast("long").alias("n_chars"))


@query(
    "cloned_vessel",
    """WITH m AS (SELECT o_custkey, o_orderpriority, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS k FROM orders GROUP BY o_custkey, o_orderpriority)
    SELECT o_custkey, o_orderkey, 'own' AS kind FROM orders UNION ALL SELECT -o_custkey, k, 'cloned' FROM m""",
)
def cloned_vessel(spark, d):
    """Every customer's newest order of each priority appended under a new owner."""
    o = read(spark, d, "orders")
    newest = o.groupBy("o_custkey", "o_orderpriority").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))
    return o.select("o_custkey", "o_orderkey", F.lit("own").alias("kind")).unionByName(newest.select((-C("o_custkey")).alias("o_custkey"), "o_orderkey", F.lit("cloned").alias("kind")))


@query(
    "backfilled_links",
    """SELECT DISTINCT p_partkey, n_nationkey FROM (SELECT p_partkey, trim(unnest(string_split(p_type, ' '))) AS label, p_size FROM part) p JOIN nation ON n_regionkey = p_size % 5 AND n_nationkey % 10 = length(label) WHERE label <> ''""",
)
def backfilled_links(spark, d):
    """Labels unnested and joined, trimmed, to what they name: an N:M table from a list column."""
    labels = read(spark, d, "part").select("p_partkey", (C("p_size") % 5).alias("region"), F.explode(F.split("p_type", " ")).alias("label")).withColumn("label", F.trim("label")).filter("label <> ''")
    n = read(spark, d, "nation").select("n_nationkey", C("n_regionkey").alias("region"), (C("n_nationkey") % 10).alias("letters"))
    return labels.withColumn("letters", F.length("label")).join(n, ["region", "letters"]).select("p_partkey", "n_nationkey").distinct()


@query(
    "regrouped_arrays",
    """SELECT l_suppkey, string_agg(part, ',' ORDER BY l_partkey) AS parts FROM (SELECT DISTINCT l_suppkey, l_partkey, l_partkey::VARCHAR AS part FROM lineitem) GROUP BY l_suppkey""",
)
def regrouped_arrays(spark, d):
    """Links folded back into one ordered list an owner."""
    return read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_set("l_partkey")), ",").alias("parts"))


@query(
    "inventory_scan",
    """SELECT label, vec_id, row_number() OVER (ORDER BY label NULLS LAST, vec_id % 17 NULLS LAST, vec_id) AS place FROM embeddings WHERE label IN (1, 3, 5)""",
)
def inventory_scan(spark, d):
    """All chunks of a set of manuals, in order of manual, page and id: a range sort, then places counted partition by partition."""
    chunks = read(spark, d, "embeddings").filter(C("label").isin(1, 3, 5)).select("label", "vec_id", (C("vec_id") % 17).alias("page"))
    order = [F.asc_nulls_last("label"), F.asc_nulls_last("page"), C("vec_id")]
    ranged = written(chunks.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id()), "inventory")
    part = F.shiftright("_row", 33)
    from pyspark.sql import Window

    counts = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).withColumn("_before", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ranged.withColumn("_part", part).join(F.broadcast(counts), "_part").select("label", "vec_id", (C("_before") + C("_row") - F.shiftleft("_part", 33) + 1).alias("place"))


@query(
    "ask_log",
    """SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE role = 'user') AS questions, sum(length(text))::BIGINT AS letters FROM conversations WHERE conv_id % 10 <> 3 GROUP BY conv_id""",
)
def ask_log(spark, d):
    """Turns appended to a log in two writes: ids that are no numbers are left out, unknown roles become null."""
    path = new_path(spark, "ask-log")
    raw = read(spark, d, "conversations").select(F.when(C("conv_id") % 10 == 3, "not-an-id").otherwise(C("conv_id").cast("string")).alias("raw_id"), "role", "text")
    rows = raw.select(C("raw_id").try_cast("long").alias("conv_id"), F.when(C("role").isin("user", "assistant", "system"), C("role")).alias("role"), "text").filter("conv_id IS NOT NULL")
    rows.filter("role = 'user'").write.mode("append").parquet(path)
    rows.filter("role IS NULL OR role <> 'user'").write.mode("append").parquet(path)
    return spark.read.parquet(path).groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(C("role") == "user").alias("questions"), F.sum(F.length("text")).alias("letters"))
