"""Benchmark sentences that documents repeat although no page of their language has them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import leaks
from ..sources.tables import read
from .catalog import query
from .reconcile_queries import BLOCK, page_blocks

C = F.col
_ROW = r"' ' || array_to_string(list_filter(string_split_regex(lower({t}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''), ' ') || ' '"


@query(
    "leaked_phrases",
    f"""WITH i AS MATERIALIZED (SELECT * FROM (SELECT lang AS scope, doc_id * 100000 + i - 1 AS key, {_ROW.format(t='x')} AS row FROM (SELECT lang, doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)) WHERE row <> '  '),
    p AS MATERIALIZED (SELECT row AS phrase, min(phrase_id) AS phrase_id FROM (SELECT item_id * 1000 + i - 1 AS phrase_id, {_ROW.format(t='x')} AS row FROM (SELECT item_id, unnest(string_split_regex(text, '[.!?]\\s+')) AS x, generate_subscripts(string_split_regex(text, '[.!?]\\s+'), 1) AS i FROM benchmark)) WHERE row <> '  ' GROUP BY row),
    c AS MATERIALIZED (SELECT scope, {_ROW.format(t='x')} AS row FROM (SELECT regexp_extract(html, '<html lang="(\\w+)"', 1) AS scope, unnest(regexp_extract_all(html, '{BLOCK}', 2)) AS x FROM pages)),
    met AS MATERIALIZED (SELECT DISTINCT scope, key, phrase_id, phrase FROM i JOIN p ON contains(row, phrase) OR (len(string_split(row, ' ')) - 2 >= 4 AND contains(phrase, row))),
    own AS (SELECT DISTINCT c.scope, m.phrase_id FROM c JOIN (SELECT DISTINCT scope, phrase_id, phrase FROM met) m ON m.scope = c.scope AND contains(c.row, m.phrase))
    SELECT scope, key, min(phrase_id) AS phrase_id, count(*) AS n FROM met ANTI JOIN own USING (scope, phrase_id) GROUP BY scope, key""",
)
def leaked_phrases(spark, d):
    """Lines of documents with the first sentence of the benchmark that they repeat, and how many."""
    lines = read(spark, d, "documents").select(C("lang").alias("scope"), "doc_id", F.posexplode(F.split(C("text"), "\n")).alias("at", "text"))
    items = lines.select("scope", (C("doc_id") * 100_000 + C("at")).alias("key"), "text")
    cut = read(spark, d, "benchmark").select("item_id", F.posexplode(F.split(C("text"), r"[.!?]\s+")).alias("at", "text"))
    found = leaks.leaked(items, cut.select((C("item_id") * 1000 + C("at")).alias("phrase_id"), "text"), page_blocks(spark, d).select("scope", "text"))
    return leaks.first_leak(found)
