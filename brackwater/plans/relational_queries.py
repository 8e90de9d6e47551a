"""Registry and library queries: joins, ordered aggregates, picks, merges and closures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import registry
from ..operators import relational as R
from ..sources.tables import read
from .catalog import query

C = F.col


@query(
    "allowlist_join",
    """SELECT DISTINCT c_custkey, s_suppkey FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
    JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 0 WHERE o_orderstatus = 'F' AND c_mktsegment = 'BUILDING'""",
)
def allowlist_join(spark, d):
    c = read(spark, d, "customer").filter(C("c_mktsegment") == "BUILDING").select("c_custkey")
    o = read(spark, d, "orders").filter(C("o_orderstatus") == "F").select("o_orderkey", "o_custkey")
    li = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    s = read(spark, d, "supplier").filter(C("s_acctbal") > 0).select("s_suppkey")
    return c.join(o, C("c_custkey") == C("o_custkey")).join(li, C("l_orderkey") == C("o_orderkey")).join(s, C("s_suppkey") == C("l_suppkey")).select("c_custkey", "s_suppkey").distinct()


@query("title_map", "SELECT s_nationkey, string_agg(s_suppkey::VARCHAR || '=' || s_name, ';' ORDER BY s_suppkey) AS titles FROM supplier GROUP BY s_nationkey")
def title_map(spark, d):
    return read(spark, d, "supplier").groupBy("s_nationkey").agg(R.ordered_text(F.concat(C("s_suppkey").cast("string"), F.lit("="), "s_name"), C("s_suppkey"), ";").alias("titles"))


@query(
    "dim_header",
    """SELECT s_suppkey, s_name, n_name, r_name, brands FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey
    LEFT JOIN region ON r_regionkey = n_regionkey LEFT JOIN (SELECT l_suppkey, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS brands
    FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_suppkey) ON l_suppkey = s_suppkey""",
)
def dim_header(spark, d):
    brands = read(spark, d, "lineitem").join(read(spark, d, "part"), C("p_partkey") == C("l_partkey")).groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("brands"))
    s = read(spark, d, "supplier").join(read(spark, d, "nation"), C("n_nationkey") == C("s_nationkey"), "left").join(read(spark, d, "region"), C("r_regionkey") == C("n_regionkey"), "left")
    return s.join(brands, C("l_suppkey") == C("s_suppkey"), "left").select("s_suppkey", "s_name", "n_name", "r_name", "brands")


@query(
    "preagg_left_joins",
    """SELECT c_custkey, c_name, coalesce(n_orders, 0) AS n_orders, coalesce(n_lines, 0) AS n_lines, coalesce(order_keys, '') AS order_keys FROM customer
    LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate, o_orderkey) AS order_keys FROM orders GROUP BY o_custkey) o ON o.o_custkey = c_custkey
    LEFT JOIN (SELECT o_custkey, sum(n)::BIGINT AS n_lines FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey GROUP BY o_custkey) l ON l.o_custkey = c_custkey""",
)
def preagg_left_joins(spark, d):
    o = read(spark, d, "orders")
    per_customer = o.groupBy(C("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), R.ordered_text(C("o_orderkey"), F.struct("o_orderdate", "o_orderkey")).alias("order_keys"))
    lines = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    lines = o.join(lines, C("l_orderkey") == C("o_orderkey")).groupBy(C("o_custkey").alias("c_custkey")).agg(F.sum("n").alias("n_lines"))
    zero = lambda c, v: F.coalesce(C(c), F.lit(v)).alias(c)
    return read(spark, d, "customer").join(per_customer, "c_custkey", "left").join(lines, "c_custkey", "left").select("c_custkey", "c_name", zero("n_orders", 0), zero("n_lines", 0), zero("order_keys", ""))


@query(
    "ordered_labels",
    """SELECT r_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS labels, min_by(n_name, n_nationkey) AS first_nation,
    coalesce(string_agg(DISTINCT upper(substr(n_name, 1, 1)), '' ORDER BY upper(substr(n_name, 1, 1))) FILTER (WHERE n_nationkey % 2 = 0), '') AS initials
    FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey""",
)
def ordered_labels(spark, d):
    n = read(spark, d, "region").join(read(spark, d, "nation"), C("n_regionkey") == C("r_regionkey"))
    initial = F.when(C("n_nationkey") % 2 == 0, F.upper(F.substring("n_name", 1, 1)))
    return n.groupBy("r_regionkey").agg(R.ordered_text(C("n_name"), C("n_name"), ", ").alias("labels"), R.first_of_group(C("n_name"), C("n_nationkey")).alias("first_nation"), F.array_join(F.array_sort(F.collect_set(initial)), "").alias("initials"))


@query(
    "existence_flags",
    """SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_order,
    EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS has_pending,
    (SELECT o_orderstatus FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) AS latest_status FROM customer""",
)
def existence_flags(spark, d):
    o = read(spark, d, "orders").groupBy(C("o_custkey").alias("c_custkey")).agg(F.bool_or(C("o_orderstatus") == "P").alias("pending"), F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("latest_status"))
    return read(spark, d, "customer").join(o, "c_custkey", "left").select("c_custkey", C("pending").isNotNull().alias("has_order"), F.coalesce("pending", F.lit(False)).alias("has_pending"), "latest_status")


@query(
    "lateral_latest",
    """SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) o
    ON o_custkey = c_custkey AND rn = 1""",
)
def lateral_latest(spark, d):
    latest = read(spark, d, "orders").groupBy(C("o_custkey").alias("c_custkey")).agg(F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_orderdate", "o_orderkey")).alias("o"))
    return read(spark, d, "customer").join(latest, "c_custkey", "left").select("c_custkey", "o.o_orderkey", "o.o_totalprice")


@query(
    "pick_policies",
    """WITH r AS (SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus,
      row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END, o_orderdate DESC NULLS LAST, o_orderkey) AS a,
      row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 WHEN 'F' THEN 3 ELSE 4 END, o_orderdate DESC NULLS LAST, o_orderkey) AS b,
      row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) AS c FROM orders)
    SELECT o_custkey, max(o_orderkey) FILTER (WHERE a = 1) AS approved_first, max(o_orderkey) FILTER (WHERE b = 1) AS draft_first, max(o_orderkey) FILTER (WHERE c = 1) AS newest FROM r GROUP BY o_custkey""",
)
def pick_policies(spark, d):
    # Orders by three preference lists in one aggregation; each pick is a minimum over (rank, newest, key), no sort.
    o = read(spark, d, "orders")
    newest = -F.unix_micros(C("o_orderdate").cast("timestamp"))
    pick = lambda statuses: F.min_by("o_orderkey", F.struct(R.status_rank(C("o_orderstatus"), statuses), newest, "o_orderkey"))
    return o.groupBy("o_custkey").agg(pick(["F", "O"]).alias("approved_first"), pick(["P", "O", "F"]).alias("draft_first"), F.min_by("o_orderkey", F.struct(newest, C("o_orderkey"))).alias("newest"))


@query(
    "status_fallback",
    """SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'F' THEN 2 END, o_totalprice DESC, o_orderkey) AS rn
    FROM orders WHERE o_orderstatus IN ('P', 'F')) WHERE rn = 1""",
)
def status_fallback(spark, d):
    wanted = ["P", "F"]
    o = read(spark, d, "orders").filter(C("o_orderstatus").isin(wanted))
    return R.pick_one(o, ["o_custkey"], [R.status_rank(C("o_orderstatus"), wanted), F.desc("o_totalprice"), C("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query(
    "null_aware_anti",
    """WITH c AS (SELECT nullif(c_custkey % 40, 7) AS key, c_custkey FROM customer), full_ AS (SELECT o_custkey AS k FROM orders WHERE o_orderkey % 3 = 0), holed AS (SELECT nullif(o_custkey, 10) AS k FROM orders)
    SELECT c_custkey, 'plain' AS kind FROM c WHERE key NOT IN (SELECT k FROM full_ WHERE k > 20) UNION ALL SELECT c_custkey, 'holed' FROM c WHERE key NOT IN (SELECT k FROM holed) UNION ALL SELECT c_custkey, 'none' FROM c WHERE key NOT IN (SELECT k FROM full_ WHERE k < 0)""",
)
def null_aware_anti(spark, d):
    """NOT IN against keys without nulls, with one, and against none; null keys of the left side stay only in the last."""
    c = read(spark, d, "customer").select(F.nullif(C("c_custkey") % 40, F.lit(7)).alias("key"), "c_custkey")
    o = read(spark, d, "orders")
    full = o.filter("o_orderkey % 3 = 0").select(C("o_custkey").alias("k"))
    parts = [("plain", full.filter("k > 20")), ("holed", o.select(F.nullif(C("o_custkey"), F.lit(10)).alias("k"))), ("none", full.filter("k < 0"))]
    found = [R.not_in(c, "key", other, "k").select("c_custkey", F.lit(kind).alias("kind")) for kind, other in parts]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(
    "set_drift",
    """SELECT s_nationkey AS nationkey, 'right' AS missing_in FROM (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000 EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9500)
    UNION ALL SELECT c_nationkey, 'left' FROM (SELECT c_nationkey FROM customer WHERE c_acctbal > 9500 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)""",
)
def set_drift(spark, d):
    left = read(spark, d, "supplier").filter("s_acctbal > 5000").select(C("s_nationkey").alias("nationkey")).distinct()
    right = read(spark, d, "customer").filter("c_acctbal > 9500").select(C("c_nationkey").alias("nationkey")).distinct()
    return R.differences(left, right)


@query(
    "direction_self_join",
    """SELECT a.n_nationkey AS nation, b.n_nationkey AS other, CASE WHEN a.n_nationkey < b.n_nationkey THEN 'out' ELSE 'in' END AS direction
    FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey""",
)
def direction_self_join(spark, d):
    n = read(spark, d, "nation")
    pairs = n.alias("a").join(n.alias("b"), (C("a.n_regionkey") == C("b.n_regionkey")) & (C("a.n_nationkey") < C("b.n_nationkey"))).select(C("a.n_nationkey").alias("x"), C("b.n_nationkey").alias("y"))
    # An OR over two roles is a union of two equi-joined halves.
    out = pairs.select(C("x").alias("nation"), C("y").alias("other"), F.lit("out").alias("direction"))
    return out.unionByName(pairs.select(C("y").alias("nation"), C("x").alias("other"), F.lit("in").alias("direction")))


@query(
    "duplicate_keys",
    """SELECT l_partkey, l_suppkey, count(*) AS n, string_agg(l_orderkey::VARCHAR, ',' ORDER BY l_orderkey) AS lines FROM lineitem GROUP BY l_partkey, l_suppkey HAVING count(*) > 1""",
)
def duplicate_keys(spark, d):
    return R.duplicate_keys(read(spark, d, "lineitem"), ["l_partkey", "l_suppkey"], "l_orderkey")


@query(
    "overlay_merge",
    """SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 7 <> 0
    UNION ALL SELECT o_orderkey, 'X', round(o_totalprice * 2, 2) FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT -o_orderkey, 'N', o_totalprice FROM orders WHERE o_orderkey % 11 = 0""",
)
def overlay_merge(spark, d):
    base = read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    changed = base.filter("o_orderkey % 7 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.round(C("o_totalprice") * 2, 2).alias("o_totalprice"))
    new = base.filter("o_orderkey % 11 = 0").select((-C("o_orderkey")).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), "o_totalprice")
    return R.overlay(base, changed.unionByName(new), ["o_orderkey"])


@query(
    "conditional_upsert",
    """SELECT coalesce(b.k, n.k) AS k, CASE WHEN b.k IS NULL OR (n.k IS NOT NULL AND b.status = 'O') THEN n.status ELSE b.status END AS status,
    CASE WHEN b.k IS NULL THEN 'inserted' WHEN n.k IS NULL THEN 'kept' WHEN b.status = 'O' THEN 'updated' ELSE 'refused' END AS change
    FROM (SELECT o_orderkey AS k, o_orderstatus AS status FROM orders) b FULL JOIN (SELECT o_orderkey * 2 AS k, 'answered' AS status FROM orders) n ON b.k = n.k""",
)
def conditional_upsert(spark, d):
    o = read(spark, d, "orders")
    base = o.select(C("o_orderkey").alias("k"), C("o_orderstatus").alias("status"))
    new = o.select((C("o_orderkey") * 2).alias("k"), F.lit("answered").alias("status"))
    return R.upsert(base, new, ["k"], C("b.status") == "O")


@query(
    "supersede_and_promote",
    """SELECT o_orderkey, CASE WHEN rn = 1 THEN 'published' WHEN o_orderstatus = 'F' THEN 'superseded' ELSE o_orderstatus END AS status FROM
    (SELECT *, CASE WHEN o_orderstatus = 'F' THEN row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) END AS rn FROM orders)""",
)
def supersede_and_promote(spark, d):
    place = Window.partitionBy("o_custkey", "o_orderstatus").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    o = read(spark, d, "orders").withColumn("rn", F.row_number().over(place))
    done = C("o_orderstatus") == "F"
    return o.select("o_orderkey", F.when(done & (C("rn") == 1), "published").when(done, "superseded").otherwise(C("o_orderstatus")).alias("status"))


EXPAND_SQL = """WITH RECURSIVE e AS (SELECT p_partkey AS root, p_partkey AS node, 0 AS depth FROM part
    UNION ALL SELECT e.root, e.node // 2, e.depth + 1 FROM e JOIN part ON p_partkey = e.node // 2 WHERE e.node > 1)
    SELECT root, count(*) AS n_nodes, max(depth)::INTEGER AS depth, sum(node)::BIGINT AS total FROM e GROUP BY root"""


@query("recursive_expand", EXPAND_SQL)
def recursive_expand(spark, d):
    """Packs expand into their children (part p holds part p div 2), by frontiers: no limit of levels or rows as in a recursive query."""
    p = read(spark, d, "part").select("p_partkey")
    edges = p.select(C("p_partkey").alias("parent"), F.floor(C("p_partkey") / 2).alias("child"), F.lit("a").alias("ord")).filter("child > 0")
    e = registry.expand(edges, p.select(C("p_partkey").alias("root")))
    return e.groupBy("root").agg(F.count("*").alias("n_nodes"), F.max("depth").alias("depth"), F.sum("node").alias("total"))


@query(
    "last_n_turns",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS rn FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> '')
    SELECT conv_id, count(*) AS n_turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn, text) AS history FROM r WHERE rn <= 8 GROUP BY conv_id""",
)
def last_n_turns(spark, d):
    last = Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("text"))
    t = read(spark, d, "conversations").filter(C("role").isin("user", "assistant") & (F.trim("text") != "")).withColumn("rn", F.row_number().over(last)).filter("rn <= 8")
    return t.groupBy("conv_id").agg(F.count("*").alias("n_turns"), R.ordered_text(F.concat("role", F.lit(": "), "text"), F.struct("turn", "text"), "\n").alias("history"))


@query(
    "paged_search",
    """SELECT p_partkey, p_name, p_brand FROM part WHERE (p_name ILIKE '%a%' OR p_brand ILIKE '%1%') AND p_size < 30
    AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49) ORDER BY p_brand, p_name, p_partkey LIMIT 50 OFFSET 50""",
)
def paged_search(spark, d):
    p = read(spark, d, "part").filter((C("p_name").ilike("%a%") | C("p_brand").ilike("%1%")) & (C("p_size") < 30))
    p = p.join(read(spark, d, "lineitem").filter("l_quantity > 49"), C("l_partkey") == C("p_partkey"), "left_anti")
    return p.select("p_partkey", "p_name", "p_brand").orderBy("p_brand", "p_name", "p_partkey").offset(50).limit(50)


@query(
    "dashboard_counts",
    """SELECT (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM supplier) AS suppliers, (SELECT count(*) FROM part) AS parts, (SELECT count(*) FROM orders) AS orders,
    (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS open_orders, (SELECT count(*) FROM documents) AS documents, (SELECT count(DISTINCT conv_id) FROM conversations) AS conversations""",
)
def dashboard_counts(spark, d):
    one = lambda name, *aggs: read(spark, d, name).agg(*aggs)
    n = F.count("*")
    parts = [one("customer", n.alias("customers")), one("supplier", n.alias("suppliers")), one("part", n.alias("parts")), one("orders", n.alias("orders"), F.count_if(C("o_orderstatus") == "O").alias("open_orders")), one("documents", n.alias("documents")), one("conversations", F.count_distinct("conv_id").alias("conversations"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out


@query(
    "progress_rollup",
    """SELECT source, count(*) FILTER (WHERE quality = 1) AS done, count(*) AS total, round(100.0 * count(*) FILTER (WHERE quality = 1) / count(*))::BIGINT AS percent
    FROM documents JOIN labels USING (doc_id) GROUP BY source""",
)
def progress_rollup(spark, d):
    x = read(spark, d, "documents").select("doc_id", "source").join(read(spark, d, "labels"), "doc_id")
    done = F.count_if(C("quality") == 1)
    return x.groupBy("source").agg(done.alias("done"), F.count("*").alias("total"), F.round(100.0 * done / F.count("*")).cast("long").alias("percent"))


@query(
    "assemble_bundle",
    """SELECT r_regionkey, sha256(r_name || '{' || coalesce(string_agg(n_nationkey::VARCHAR || ':' || n_name, ',' ORDER BY n_nationkey), '') || '}') AS content_hash, count(n_nationkey) AS modules
    FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name""",
)
def assemble_bundle(spark, d):
    """Modules of a bundle in order, with the hash that tells whether a bundle has to be published anew."""
    x = read(spark, d, "region").join(read(spark, d, "nation"), C("n_regionkey") == C("r_regionkey"), "left")
    module = F.concat(C("n_nationkey").cast("string"), F.lit(":"), "n_name")
    body = x.groupBy("r_regionkey", "r_name").agg(R.ordered_text(module, C("n_nationkey")).alias("body"), F.count("n_nationkey").alias("modules"))
    return body.select("r_regionkey", F.sha2(F.concat("r_name", F.lit("{"), "body", F.lit("}")), 256).alias("content_hash"), "modules")


@query(
    "coercions",
    """SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
    try_cast(regexp_extract(p_brand, '[0-9]+$', 0) AS INTEGER) AS brand_no, len(list_filter(string_split(p_type, ' '), lambda x: x <> ''))::INTEGER AS n_words,
    CASE WHEN p_size > 25 THEN true ELSE false END AS is_large FROM part""",
)
def coercions(spark, d):
    slug = F.regexp_replace(F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return read(spark, d, "part").select("p_partkey", slug.alias("slug"), F.regexp_extract("p_brand", "[0-9]+$", 0).try_cast("int").alias("brand_no"), F.size(F.filter(F.split("p_type", " "), lambda x: x != "")).alias("n_words"), F.when(C("p_size") > 25, True).otherwise(False).alias("is_large"))


@query(
    "next_version",
    "SELECT o_custkey, coalesce(max(o_orderkey % 100), 0) + 1 AS next_version FROM orders GROUP BY o_custkey",
)
def next_version(spark, d):
    return read(spark, d, "orders").groupBy("o_custkey").agg((F.coalesce(F.max(C("o_orderkey") % 100), F.lit(0)) + 1).alias("next_version"))
