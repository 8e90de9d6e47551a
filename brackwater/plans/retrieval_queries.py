"""Vector retrieval over ``embeddings``; the label stands for the manual a chunk belongs to."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import retrieval
from ..sources.tables import read
from .catalog import query

COSINE = "round(list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / nullif(sqrt(list_sum(list_transform({a}, lambda v: v::DOUBLE * v::DOUBLE))) * sqrt(list_sum(list_transform({b}, lambda v: v::DOUBLE * v::DOUBLE))), 0), 6)"
TOPK_SQL = f"""
  SELECT * FROM (
    SELECT q.vec_id AS query_id, e.vec_id AS item_id, e.label AS scope, {COSINE.format(a='e.embedding', b='q.embedding')} AS score,
           row_number() OVER (PARTITION BY q.vec_id ORDER BY {COSINE.format(a='e.embedding', b='q.embedding')} DESC NULLS LAST, e.vec_id) AS rank
    FROM embeddings e JOIN embeddings q ON q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id
    WHERE e.label IN (SELECT s_nationkey % 5 FROM supplier WHERE s_acctbal > 0)) WHERE rank <= 3"""


def asked(spark, sf_dir):
    """Every row whose id 50 divides asks; the scopes allowed to them come from a semi-join, not from a list in the plan."""
    e = read(spark, sf_dir, "embeddings")
    items = e.select(F.col("vec_id").alias("item_id"), F.col("label").alias("scope"), "embedding")
    questions = e.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    allowed = read(spark, sf_dir, "supplier").filter(F.col("s_acctbal") > 0).select((F.col("s_nationkey") % 5).alias("scope"))
    return items, questions, allowed


@query("scoped_topk", TOPK_SQL)
def scoped_topk(spark, sf_dir):
    items, questions, allowed = asked(spark, sf_dir)
    return retrieval.scoped_topk(items, questions, 3, allowed).select("query_id", "item_id", "scope", "score", "rank")


@query(
    "merged_topk",
    f"""
WITH hits AS ({TOPK_SQL}),
first AS (SELECT item_id, min({{'query_id': query_id, 'rank': rank, 'score': score}}) AS f FROM hits GROUP BY item_id)
SELECT item_id, f.query_id AS query_id, f.rank AS rank, f.score AS score,
       row_number() OVER (ORDER BY f.query_id, f.rank, item_id) AS position
FROM first QUALIFY position <= 6""",
)
def merged_topk(spark, sf_dir):
    items, questions, allowed = asked(spark, sf_dir)
    return retrieval.merge_ranked(retrieval.scoped_topk(items, questions, 3, allowed), 6)


@query(
    "scaled_depth",
    """SELECT label AS scope, count(*) AS chunks, (CASE WHEN count(*) <= 40 THEN 4 ELSE least(16, greatest(4, 6, ceil(count(*) / 9.0), ceil(greatest(1, ceil(count(*) * 0.6)) / 6.0))) END)::BIGINT AS k FROM embeddings GROUP BY label""",
)
def scaled_depth(spark, sf_dir):
    n = read(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("scope")).agg(F.count("*").alias("chunks"))
    return n.withColumn("k", retrieval.scaled_k(F.col("chunks"), F.lit(8)))


@query(
    "heading_coverage",
    f"""WITH hits AS ({TOPK_SQL}), h AS (SELECT label AS scope, vec_id % 7 AS heading FROM embeddings GROUP BY ALL),
    s AS (SELECT h.scope, count(*) AS headings, count(x.heading) AS covered FROM h LEFT JOIN (SELECT DISTINCT scope, item_id % 7 AS heading FROM hits) x ON x.scope = h.scope AND x.heading = h.heading GROUP BY h.scope)
    SELECT scope, headings, covered, round(covered / headings, 4) AS fraction, covered / headings < 0.25 AS is_low FROM s""",
)
def heading_coverage(spark, sf_dir):
    items, questions, allowed = asked(spark, sf_dir)
    hits = retrieval.scoped_topk(items, questions, 3, allowed).select("scope", (F.col("item_id") % 7).alias("heading"))
    headings = items.select("scope", (F.col("item_id") % 7).alias("heading")).distinct()
    return retrieval.coverage(headings, hits)


_COS = COSINE.replace("z[1]::DOUBLE", "z[1]").replace("z[2]::DOUBLE", "z[2]").replace("v::DOUBLE", "v")
PHASED_SQL = f"""WITH e AS MATERIALIZED (SELECT vec_id AS item_id, label AS scope, vec_id % 37 AS heading, embedding::DOUBLE[] AS embedding FROM embeddings),
    q AS (SELECT item_id AS query_id, scope, embedding FROM e WHERE item_id % 50 = 0),
    depth AS (SELECT scope, CASE WHEN chunks <= 40 THEN 4 ELSE least(16, greatest(4, 6, ceil(chunks / 9.0), ceil(greatest(1, ceil(chunks * 0.6)) / greatest(least(n, 6), 1)))) END AS k FROM (SELECT scope, count(*) AS chunks FROM e GROUP BY scope) JOIN (SELECT scope, count(*) AS n FROM q GROUP BY scope) USING (scope)),
    met AS (SELECT q.query_id, e.item_id, e.scope, e.heading, {_COS.format(a='e.embedding', b='q.embedding')} AS score FROM e JOIN q ON e.scope = q.scope AND e.item_id <> q.query_id),
    found AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, item_id) AS rank FROM met) JOIN depth USING (scope) WHERE rank <= k),
    one AS MATERIALIZED (SELECT scope, 1 AS phase, query_id, heading, item_id, rank, score FROM found QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY query_id, rank) = 1),
    missing AS (SELECT e.* FROM e SEMI JOIN depth USING (scope) ANTI JOIN one ON one.scope = e.scope AND one.heading = e.heading),
    parts AS (SELECT scope, heading, i, avg(v) AS v FROM (SELECT scope, heading, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM missing) GROUP BY ALL),
    cents AS MATERIALIZED (SELECT scope, heading, list(v ORDER BY i) AS embedding FROM parts GROUP BY ALL),
    rest AS (SELECT * FROM e ANTI JOIN one USING (item_id)),
    near AS (SELECT r.scope, c.heading, r.item_id, {_COS.format(a='r.embedding', b='c.embedding')} AS score FROM rest r JOIN cents c ON c.scope = r.scope QUALIFY row_number() OVER (PARTITION BY c.scope, c.heading ORDER BY score DESC NULLS LAST, r.item_id) = 1),
    two AS (SELECT scope, 2 AS phase, NULL::BIGINT AS query_id, heading, item_id, 1 AS rank, score FROM near QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY heading) = 1)"""


def phases(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("label").alias("scope"), (F.col("vec_id") % 37).alias("heading"), "embedding")
    return retrieval.phased(e, e.filter("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), "scope", "embedding"))


@query("phased_retrieval", PHASED_SQL + " SELECT scope, phase, query_id, heading, item_id, rank, score FROM one UNION ALL SELECT scope, phase, query_id, heading, item_id, rank, score FROM two")
def phased_retrieval(spark, sf_dir):
    """Retrieval in two phases: what the questions find; then, for headings that no hit stands for, what is nearest to their mean vector."""
    return phases(spark, sf_dir)[0]


@query("phase_diagnostics", PHASED_SQL + " SELECT f.scope, f.query_id, any_value(f.k)::BIGINT AS k, count(*) AS hits, count(o.item_id) AS new FROM found f LEFT JOIN one o ON o.item_id = f.item_id AND o.query_id = f.query_id GROUP BY f.scope, f.query_id")
def phase_diagnostics(spark, sf_dir):
    """How deep each question was asked, what it found, and how much of it was new."""
    return phases(spark, sf_dir)[1]


@query(
    "asked_context",
    PHASED_SQL
    + """, hits AS (SELECT * FROM one UNION ALL SELECT * FROM two), texts AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL),
    placed AS (SELECT h.*, t.text, row_number() OVER (PARTITION BY h.scope ORDER BY phase, coalesce(query_id, heading), rank, item_id) AS place FROM hits h JOIN texts t ON t.doc_id = h.item_id QUALIFY place <= 6)
    SELECT scope, count(*) AS nodes, string_agg('[' || place || '] chunk ' || item_id || chr(10) || left(text, 1200), chr(10) || chr(10) ORDER BY place) AS context,
      string_agg(item_id::VARCHAR, ',' ORDER BY place) FILTER (WHERE contains(text, 'the')) AS citations FROM placed GROUP BY scope""",
)
def asked_context(spark, sf_dir):
    """The way of a question: two phases, the first six chunks of a scope, clipped and labelled as context; cited are those that
    hold the word asked for."""
    hits = phases(spark, sf_dir)[0]
    texts = read(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("item_id"), "text")
    best = Window.partitionBy("scope").orderBy("phase", F.coalesce("query_id", F.col("heading")), "rank", "item_id")
    placed = hits.join(texts.select("item_id"), "item_id", "left_semi").withColumn("place", F.row_number().over(best)).filter("place <= 6")
    labelled = placed.join(texts, "item_id").select("scope", "place", "item_id", F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] chunk "), F.col("item_id").cast("string"), F.lit("\n"), F.left("text", F.lit(1200))).alias("node"), F.contains("text", F.lit("the")).alias("cited"))
    rows = labelled.groupBy("scope").agg(F.count("*").alias("nodes"), F.array_sort(F.collect_list(F.struct("place", "node", "item_id", "cited"))).alias("r"))
    cited = F.transform(F.filter("r", lambda x: x["cited"]), lambda x: x["item_id"].cast("string"))
    return rows.select("scope", "nodes", F.array_join(F.transform("r", lambda x: x["node"]), "\n\n").alias("context"), F.nullif(F.array_join(cited, ","), F.lit("")).alias("citations"))
