"""Text, corpus and document-assembly queries over documents, pages, benchmark and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.strings import lcs_ratio
from ..operators import greedy
from ..operators import relational as R
from ..sources.tables import read
from .catalog import query

C = F.col
LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)"
HEADING = r"(length(line) <= 80 AND (regexp_matches(line, '^[0-9]+(\.[0-9]+)* [A-Z]') OR regexp_matches(line, '^(Chapter|Section|Part) [0-9]+') OR (regexp_matches(line, '^[A-Z0-9 !,.-]+$') AND regexp_matches(line, '[A-Z]{2}') AND len(string_split(line, ' ')) BETWEEN 2 AND 8)))"


def lines(spark, d):
    return read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


@query("heading_inventory", f"SELECT lower(line) AS heading, count(*) AS n, min(doc_id) AS first_doc FROM {LINES} WHERE {HEADING} GROUP BY lower(line)")
def heading_inventory(spark, d):
    return lines(spark, d).filter(T.is_heading(C("line"))).groupBy(F.lower("line").alias("heading")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query(
    "heading_carry_forward",
    f"""SELECT doc_id, pos::INTEGER AS pos, last_value(CASE WHEN {HEADING} THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM {LINES}""",
)
def heading_carry_forward(spark, d):
    """The last heading so far, line by line: each heading unfolds over the lines up to the next, so that no line is shuffled and
    the work is that of a document's lines."""
    found = F.transform(F.split("text", "\n"), lambda x: F.when(T.is_heading(x), x))
    marked = read(spark, d, "documents").select("doc_id", found.alias("h"))
    marked = marked.withColumn("starts", F.array_distinct(F.concat(F.array(F.lit(0)), F.filter(F.transform("h", lambda h, i: F.when(h.isNotNull(), i)), lambda i: i.isNotNull()))))
    runs = F.transform("starts", lambda s, j: F.struct(s.alias("first"), (F.coalesce(F.get("starts", j + 1), F.size("h")) - 1).alias("last"), F.get("h", s).alias("heading")))
    rows = marked.filter("h IS NOT NULL").select("doc_id", F.explode(runs).alias("r"))
    return rows.select("doc_id", F.explode(F.sequence("r.first", "r.last")).alias("pos"), "r.heading")


@query(
    "short_label_filter",
    rf"SELECT doc_id, pos::INTEGER AS pos, line FROM {LINES} WHERE length(line) <= 80 AND regexp_matches(line, '[A-Za-z]{{2}}') AND length(regexp_replace(line, '[\x00-\x7F]+', '', 'g')) < length(line) * 0.12",
)
def short_label_filter(spark, d):
    return lines(spark, d).filter(T.is_short_label(C("line"))).select("doc_id", "pos", "line")


STOP = ("the", "of", "and", "to", "in", "is", "that", "for", "with", "as")


@query(
    "english_blocks",
    f"""SELECT doc_id, count(*) FILTER (WHERE hits >= 0.1 * n_words AND n_words > 0) AS english_lines, count(*) AS lines FROM (
    SELECT doc_id, len(list_filter(string_split(lower(line), ' '), lambda w: w IN {STOP})) AS hits, len(list_filter(string_split(line, ' '), lambda w: w <> '')) AS n_words FROM {LINES}) GROUP BY doc_id""",
)
def english_blocks(spark, d):
    """Lines with at least a tenth of English function words; a deterministic scorer."""
    hits = F.size(F.filter(F.split(F.lower("line"), " "), lambda w: w.isin(*STOP)))
    n = F.size(F.filter(F.split("line", " "), lambda w: w != ""))
    return lines(spark, d).select("doc_id", ((hits >= 0.1 * n) & (n > 0)).alias("english")).groupBy("doc_id").agg(F.count_if("english").alias("english_lines"), F.count("*").alias("lines"))


@query(
    "chunk_overlap",
    """WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS words FROM documents)
    SELECT doc_id, (i // 448)::INTEGER AS chunk, md5(array_to_string(words[i + 1 : i + 512], ' ')) AS digest, least(512, len(words) - i)::INTEGER AS n_words
    FROM (SELECT doc_id, words, unnest(range(0, greatest(len(words) - 64, 1), 448)) AS i FROM w WHERE len(words) > 0)""".replace("\\\\", "\\"),
)
def chunk_overlap(spark, d):
    """Chunks of 512 words that overlap by 64; a tail within the overlap is no chunk of its own. Slices are made before they
    are exploded: a chunk's row carries its own words only."""
    w = read(spark, d, "documents").select("doc_id", F.filter(F.split("text", r"\s+"), lambda x: x != "").alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.floor((F.greatest(F.size("words") - 64, F.lit(1)) - 1) / 448).cast("int"))
    slices = F.transform(starts, lambda k: F.slice("words", k * 448 + 1, F.lit(512)))
    c = w.select("doc_id", F.posexplode(F.transform(slices, lambda p: F.struct(F.md5(F.array_join(p, " ").cast("binary")).alias("digest"), F.size(p).alias("n_words")))).alias("chunk", "c"))
    return c.select("doc_id", "chunk", "c.digest", "c.n_words")


@query(
    "token_overlap_pairs",
    """WITH w AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: length(x) >= 3)) AS t FROM benchmark),
    p AS (SELECT DISTINCT a.item_id AS a, b.item_id AS b FROM (SELECT item_id, unnest(t) AS x FROM w) a JOIN (SELECT item_id, unnest(t) AS x FROM w) b ON a.x = b.x AND a.item_id < b.item_id)
    SELECT a, b, round(len(list_intersect(x.t, y.t)) / least(len(x.t), len(y.t)), 6) AS overlap FROM p JOIN w x ON x.item_id = a JOIN w y ON y.item_id = b
    WHERE len(list_intersect(x.t, y.t)) / least(len(x.t), len(y.t)) >= 0.1""".replace("\\\\", "\\"),
)
def token_overlap_pairs(spark, d):
    """Benchmark items whose token sets overlap. Of the smaller set of a pair, enough tokens must be shared that one of its rarest
    n - ceil(n / 10) + 1 is: only those are looked up among all, so the commonest words join nothing; then sets are intersected."""
    w = read(spark, d, "benchmark").select("item_id", T.words(C("text")).alias("t")).withColumn("n", F.size("t"))
    token = w.select("item_id", "n", F.explode("t").alias("x"))
    often = token.groupBy("x").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy("df", "x"))
    rare = token.join(often, "x").withColumn("place", place).filter(C("place") <= C("n") - F.ceil(C("n") / 10) + 1)
    met = rare.alias("a").join(token.alias("b"), (C("a.x") == C("b.x")) & (C("a.item_id") != C("b.item_id")) & (C("a.n") <= C("b.n")))
    pairs = met.select(F.least("a.item_id", "b.item_id").alias("a"), F.greatest("a.item_id", "b.item_id").alias("b")).distinct()
    sets = lambda k, name: w.select(C("item_id").alias(k), C("t").alias(name))
    both = pairs.join(sets("a", "ta"), "a").join(sets("b", "tb"), "b")
    overlap = F.size(F.array_intersect("ta", "tb")) / F.least(F.size("ta"), F.size("tb"))
    return both.filter(overlap >= 0.1).select("a", "b", F.round(overlap, 6).alias("overlap"))


@query("lcs_of_neighbours")
def lcs_of_neighbours(spark, d):
    """Longest common substring of each benchmark item with the next."""
    b = read(spark, d, "benchmark").select("item_id", "text")
    return b.alias("a").join(b.alias("b"), C("b.item_id") == C("a.item_id") + 1).select(C("a.item_id").alias("item_id"), F.round(lcs_ratio(C("a.text"), C("b.text")), 6).alias("ratio"))


@query("greedy_dedupe")
def greedy_dedupe(spark, d):
    """Turns of a conversation clustered in order: each joins the first cluster whose head it overlaps."""
    t = read(spark, d, "conversations").select("conv_id", "turn", "text")
    return greedy.clusters(t, "conv_id", "turn", "text", 0.72)


@query(
    "majority_vote",
    """WITH v AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY user_id, event_type)
    SELECT user_id, max_by(event_type, {'n': n, 'f': -first_id}) AS winner, 2 * max(n) > sum(n) AS stable, max(n)::VARCHAR || '/' || sum(n)::VARCHAR AS margin FROM v GROUP BY user_id""",
)
def majority_vote(spark, d):
    """The most frequent type of a user, the first seen among equals; stable if it beats all others together."""
    v = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("f"))
    top, all_ = F.max("n"), F.sum("n")
    return v.groupBy("user_id").agg(F.max_by("event_type", F.struct("n", -C("f"))).alias("winner"), (2 * top > all_).alias("stable"), F.concat_ws("/", top.cast("string"), all_.cast("string")).alias("margin"))


@query(
    "quantity_tokens",
    "SELECT doc_id, len(q)::INTEGER AS n, array_to_string(q, ';') AS quantities FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]+[.][0-9]+') AS q FROM documents) WHERE len(q) > 0",
)
def quantity_tokens(spark, d):
    q = F.regexp_extract_all("text", F.lit("[0-9]+[.][0-9]+"), F.lit(0))
    return read(spark, d, "documents").select("doc_id", q.alias("q")).filter(F.size("q") > 0).select("doc_id", F.size("q").alias("n"), F.array_join("q", ";").alias("quantities"))


@query("content_hash", "SELECT doc_id, sha256(trim(regexp_replace(lower(text), '[ \n\t\r]+', ' ', 'g'))) AS digest FROM documents")
def content_hash(spark, d):
    return read(spark, d, "documents").select("doc_id", F.sha2(F.trim(F.regexp_replace(F.lower("text"), "[ \n\t\r]+", " ")), 256).alias("digest"))


@query(
    "citations_filter",
    """WITH c AS (SELECT event_id, [(k * 7) % 9, k % 9, (k * 7) % 9, 99] AS cited, k FROM (SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events))
    SELECT event_id, CASE WHEN k % 3 = 0 THEN '' ELSE array_to_string(list_filter([cited[1], CASE WHEN cited[2] <> cited[1] THEN cited[2] END], lambda x: x BETWEEN 1 AND 6), ',') END AS kept FROM c""",
)
def citations_filter(spark, d):
    """Cited numbers that exist, without repeats, in order of mention; none where nothing was relevant."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = read(spark, d, "events").select("event_id", k.alias("k"))
    cited = F.array((C("k") * 7) % 9, C("k") % 9, (C("k") * 7) % 9, F.lit(99).cast("long"))
    good = F.array_distinct(F.filter(cited, lambda x: x.between(1, 6)))
    return e.select("event_id", F.when(C("k") % 3 == 0, "").otherwise(F.array_join(good, ",")).alias("kept"))


SECTIONS = {"power": ("on", "er", "re"), "water": ("ea", "en", "th"), "sails": ("la", "de", "un")}


@query(
    "section_score",
    "WITH s AS (SELECT doc_id, "
    + ", ".join(f"len(list_filter(string_split(lower(text), ' '), lambda w: w IN {ks})) AS {n}" for n, ks in SECTIONS.items())
    + """ FROM documents), r AS (SELECT doc_id, section, hits, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, section) AS rn, lead(hits) OVER (PARTITION BY doc_id ORDER BY hits DESC, section) AS second
    FROM (SELECT doc_id, 'power' AS section, power AS hits FROM s UNION ALL SELECT doc_id, 'water', water FROM s UNION ALL SELECT doc_id, 'sails', sails FROM s))
    SELECT doc_id, CASE WHEN hits > 0 THEN section END AS section, hits::INTEGER AS hits, hits - second <= 1 AS low_margin FROM r WHERE rn = 1""",
)
def section_score(spark, d):
    """Section of most keyword hits, by name among equals, flagged if the runner-up is close. One row a document: no shuffle."""
    tokens = F.split(F.lower("text"), " ")
    scored = [F.struct((-F.size(F.filter(tokens, hit(n)))).alias("h"), F.lit(n).alias("s")) for n in SECTIONS]
    ranked = read(spark, d, "documents").select("doc_id", F.array_sort(F.array(*scored)).alias("r"))
    hits = -C("r")[0]["h"]
    return ranked.select("doc_id", F.when(hits > 0, C("r")[0]["s"]).alias("section"), hits.alias("hits"), (hits + C("r")[1]["h"] <= 1).alias("low_margin"))


def hit(name):
    return lambda w: w.isin(*SECTIONS[name])


@query(
    "inverted_index",
    """SELECT token, count(*) AS n_docs, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+')) AS token FROM documents)
    WHERE length(token) >= 3 GROUP BY token HAVING count(*) >= 3""".replace("\\\\", "\\"),
)
def inverted_index(spark, d):
    t = read(spark, d, "documents").select("doc_id", F.explode(T.words(C("text"))).alias("token"))
    return t.groupBy("token").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).filter("n_docs >= 3")


@query(
    "asset_manifest",
    """WITH a AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '(?:href|src)="([^"]+)"', 1)) AS path FROM pages) SELECT path, count(*) AS n_pages, min(page_id) AS first_page FROM a GROUP BY path""",
)
def asset_manifest(spark, d):
    paths = F.array_distinct(F.regexp_extract_all("html", F.lit('(?:href|src)="([^"]+)"'), F.lit(1)))
    return read(spark, d, "pages").select("page_id", F.explode(paths).alias("path")).groupBy("path").agg(F.count("*").alias("n_pages"), F.min("page_id").alias("first_page"))


@query(
    "manifest_diff",
    """SELECT page_id, md5(html) AS digest FROM pages WHERE page_id % 5 = 0 UNION ALL SELECT page_id, md5(html) FROM pages WHERE page_id > (SELECT max(page_id) * 0.9 FROM pages) AND page_id % 5 <> 0""",
)
def manifest_diff(spark, d):
    """Assets whose (path, hash) the previous manifest lacks: a left anti join on both."""
    p = read(spark, d, "pages").select("page_id", F.md5(C("html").cast("binary")).alias("digest"))
    last = p.agg((F.max("page_id") * 0.9).alias("cut"))
    before = p.crossJoin(last).filter("page_id <= cut").select("page_id", F.when(C("page_id") % 5 == 0, F.lit("old")).otherwise(C("digest")).alias("digest"))
    return p.join(before, ["page_id", "digest"], "left_anti")


@query(
    "spine_order",
    f"""SELECT doc_id, pos::INTEGER AS pos FROM (SELECT doc_id, pos, length(line) % 7 AS rank, max(length(line) % 7) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {LINES}) WHERE rank < before""",
)
def spine_order(spark, d):
    """Blocks whose place in the prescribed order is below that of one before them."""
    rank = F.length("line") % 7
    before = F.max(rank).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    return lines(spark, d).select("doc_id", "pos", rank.alias("rank"), before.alias("before")).filter("rank < before").select("doc_id", "pos")


@query(
    "orphan_facts",
    f"SELECT line, min(doc_id) AS doc_id FROM {LINES} WHERE length(line) > 20 GROUP BY line HAVING count(*) = 1 AND min(pos) > 0",
)
def orphan_facts(spark, d):
    """Sentences stated exactly once, outside the reference block at the top."""
    return lines(spark, d).filter(F.length("line") > 20).groupBy("line").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.min("pos").alias("p")).filter("n = 1 and p > 0").select("line", "doc_id")


@query(
    "clip_text",
    """SELECT doc_id, CASE WHEN length(text) <= 1200 THEN text ELSE rtrim(CASE WHEN contains(substr(text, 1, 1200), ' ') THEN substr(substr(text, 1, 1200), 1, 1200 - instr(reverse(substr(text, 1, 1200)), ' ')) ELSE substr(text, 1, 1200) END, ' ') || '...' END AS clipped FROM documents""",
)
def clip_text(spark, d):
    return read(spark, d, "documents").select("doc_id", T.clip_at_word(C("text"), 1200).alias("clipped"))


@query(
    "labelled_context",
    """SELECT conv_id, string_agg('[' || rn::VARCHAR || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rn) AS context FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS rn FROM conversations) WHERE rn <= 6 GROUP BY conv_id""",
)
def labelled_context(spark, d):
    rn = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text"))
    t = read(spark, d, "conversations").select("conv_id", "text", rn.alias("rn")).filter("rn <= 6")
    return t.groupBy("conv_id").agg(R.ordered_text(F.concat(F.lit("["), C("rn").cast("string"), F.lit("]\n"), "text"), C("rn"), "\n\n").alias("context"))
