"""Graph queries: networks over nations, suppliers and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocks
from ..operators import graph as G
from ..sources.tables import read
from .catalog import query

C = F.col
EDGES_SQL = "SELECT p_partkey AS a, p_partkey // 3 AS b FROM part WHERE p_partkey % 5 <> 0 AND p_partkey >= 3"


def edges(spark, d):
    return read(spark, d, "part").filter("p_partkey % 5 <> 0 and p_partkey >= 3").select(C("p_partkey").alias("a"), F.floor(C("p_partkey") / 3).alias("b"))


@query(
    "components",
    f"""WITH RECURSIVE e AS ({EDGES_SQL}), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    r AS (SELECT a AS node, a AS seen FROM s UNION SELECT r.node, s.b FROM r JOIN s ON s.a = r.seen WHERE s.b < r.seen)
    SELECT node, min(root) AS component FROM (SELECT node, min(seen) AS root FROM r GROUP BY node) GROUP BY node""",
)
def components(spark, d):
    """In this forest every node reaches the least node of its component by falling steps, which is what the SQL follows."""
    return G.components(edges(spark, d))


ROLES_SQL = """WITH dev AS (SELECT s_suppkey AS id, s_nationkey AS component, 'supplier' AS kind, s_acctbal AS bal FROM supplier UNION ALL SELECT c_custkey + 1000000, c_nationkey, 'customer', c_acctbal FROM customer),
    f AS (SELECT component, bool_or(kind = 'supplier' AND bal > 5000) AS has_hub FROM dev GROUP BY component)"""


def devices(spark, d):
    s = read(spark, d, "supplier").select(C("s_suppkey").alias("id"), C("s_nationkey").alias("component"), F.lit("supplier").alias("kind"), C("s_acctbal").alias("bal"))
    c = read(spark, d, "customer").select((C("c_custkey") + 1000000).alias("id"), C("c_nationkey").alias("component"), F.lit("customer").alias("kind"), C("c_acctbal").alias("bal"))
    return s.unionByName(c)


def is_hub():
    return (C("kind") == "supplier") & (C("bal") > 5000)


@query(
    "roles",
    ROLES_SQL + " SELECT id, CASE WHEN kind = 'supplier' AND bal > 5000 THEN 'HUB' WHEN kind = 'supplier' THEN 'BRIDGE' WHEN bal < 0 THEN 'PASSIVE' WHEN NOT has_hub THEN 'ISLAND' ELSE 'ENDPOINT' END AS role FROM dev JOIN f USING (component)",
)
def roles(spark, d):
    dev = devices(spark, d)
    flags = dev.groupBy("component").agg(F.bool_or(is_hub()).alias("has_hub"))
    role = F.when(is_hub(), "HUB").when(C("kind") == "supplier", "BRIDGE").when(C("bal") < 0, "PASSIVE").when(~C("has_hub"), "ISLAND").otherwise("ENDPOINT")
    return dev.join(flags, "component").select("id", role.alias("role"))


@query(
    "control_paths",
    ROLES_SQL + " SELECT e.id AS target, h.id AS hub FROM dev e JOIN dev h ON e.component = h.component WHERE e.kind = 'customer' AND e.bal > 9000 AND h.kind = 'supplier' AND h.bal > 5000",
)
def control_paths(spark, d):
    """Controllable ends with every hub of their component: all pairs, made in blocks."""
    dev = devices(spark, d)
    ends = dev.filter("kind = 'customer' and bal > 9000").select("component", C("id").alias("target"))
    hubs = dev.filter(is_hub()).select("component", C("id").alias("hub"))
    return blocks.paired(ends, hubs, ["component"]).select("target", "hub")


@query(
    "unreachable_flags",
    ROLES_SQL + " SELECT id, 'controllable_but_unreachable' AS flag FROM dev JOIN f USING (component) WHERE kind = 'customer' AND NOT has_hub UNION ALL SELECT id, 'low_confidence_profile' FROM dev WHERE bal < -900",
)
def unreachable_flags(spark, d):
    """Flags are one filtered projection a rule, joined by union."""
    dev = devices(spark, d)
    hubs = dev.filter(is_hub()).select("component").distinct()
    lost = dev.filter("kind = 'customer'").join(hubs, "component", "left_anti").select("id", F.lit("controllable_but_unreachable").alias("flag"))
    return lost.unionByName(dev.filter("bal < -900").select("id", F.lit("low_confidence_profile").alias("flag")))


@query(
    "weakest_provenance",
    "SELECT c_nationkey AS component, max_by(c_mktsegment, {'r': CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 ELSE 2 END, 's': c_mktsegment}) AS weakest FROM customer GROUP BY c_nationkey",
)
def weakest_provenance(spark, d):
    rank = F.when(C("c_mktsegment") == "BUILDING", 0).when(C("c_mktsegment") == "MACHINERY", 1).otherwise(2)
    return read(spark, d, "customer").groupBy(C("c_nationkey").alias("component")).agg(F.max_by("c_mktsegment", F.struct(rank.alias("r"), C("c_mktsegment").alias("s"))).alias("weakest"))
