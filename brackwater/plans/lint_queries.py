"""Heading, wording and composition queries, over sentences made of parts, orders and lines of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import headings as H
from ..functions import matching as M
from ..operators import greedy
from ..sources.tables import read
from .catalog import query

C = F.col

#: Sentences and titles that orders carry by number; each shows a case of a rule.
SAYINGS = [
    "Open the quick menu", "Close the quick menu", "Check error codes and alarms", "Review the fault codes", "Set display brightness to high", "Set screen brightness to low",
    "Turn on the pump", "3.1 Starting the engine", "D E F", "A Power off", "CLIMATE PAGE CONTROLS", "Select to view the alarms that your display has.",
    "12 batteries are fitted. The rated 2,5-3 kW and 300 W loads fail often.", "Use the pump. When at anchor, press the red button.", "See the Water section. It is aboard.", "AC POWER PANEL",
]


def _values() -> str:
    return ", ".join(f"({i}, '{s}')" for i, s in enumerate(SAYINGS))


SAID = f"said AS (SELECT o_orderkey AS k, o_custkey AS device, s AS text, o_orderstatus AS status FROM orders JOIN (VALUES {_values()}) v(i, s) ON i = o_orderkey % 16)"


def said(spark, d):
    text = F.get(F.array(*[F.lit(s) for s in SAYINGS]), (C("o_orderkey") % len(SAYINGS)).cast("int"))
    return read(spark, d, "orders").select(C("o_orderkey").alias("k"), C("o_custkey").alias("device"), text.alias("text"), C("o_orderstatus").alias("status"))


def _case(column: str, table: dict[int, str], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {column} = {k} THEN {v}" for k, v in table.items()) + f" ELSE {other} END"


def _test_sql() -> str:
    """The tests of a line as they are stated, over its trimmed text s and its words w."""
    letter = "regexp_matches({}, '^\\p{{L}}$')"
    callout = f"((len(list_filter(w, lambda x: {letter.format('x')})) = len(w) AND len(w) BETWEEN 1 AND 16) OR (len(w) >= 2 AND {letter.format('w[1]')}))"
    junk = f"(s = '' OR length(s) > 120 OR contains(s, '...') OR regexp_matches(s, '^[.\\s\\d]+$') OR {callout})"
    prose = f"((regexp_matches(s, '[.!?]\\s*$') AND len(w) > 6) OR regexp_matches(s, '{H.PROSE}'))"
    capitals = "(regexp_matches(s, '\\p{Lu}') AND NOT regexp_matches(s, '\\p{Ll}') AND len(w) BETWEEN 2 AND 8 AND NOT starts_with(s, 'AC '))"
    heading = f"(NOT {junk} AND (regexp_matches(s, '{H.NUMBERED}') OR regexp_matches(s, '(?i)^(Chapter|Section|Appendix)\\b') OR {capitals}))"
    lone = "len(list_filter(w, lambda x: length(regexp_replace(x, '[^A-Za-z0-9]', '', 'g')) <= 1))"
    title = f"(s <> '' AND NOT (regexp_matches(s, '^(?:[A-Za-z]\\s+)+[A-Za-z]$') OR (len(w) >= 2 AND {lone} >= 0.75 * len(w)) OR len(w) > 12 OR {prose} OR (regexp_matches(s, '(?i)^i\\s+\\w+') AND len(w) > 4)))"
    trouble = H.TROUBLE.replace("'", "''")
    cut = "unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos"
    split = "list_filter(string_split_regex({}, '\\s+'), lambda x: x <> '')"
    bare = "trim(ltrim(trim(line), '#'))"
    return f"""WITH l AS (SELECT doc_id AS id, -1 AS turn, {cut} FROM documents UNION ALL SELECT conv_id, turn, {cut} FROM conversations),
    a AS (SELECT id, turn, pos, line, trim(line) AS s, {split.format('trim(line)')} AS w FROM l),
    b AS (SELECT id, turn, pos, {bare} AS s, {split.format(bare)} AS w FROM l),
    t AS (SELECT id, turn, pos, {callout} AS callout, {junk} AS junk, NOT {junk} AND len(w) <= 12 AND NOT {prose} AS usable, {title} AS title, regexp_matches(line, '{trouble}') AS trouble FROM a),
    h AS (SELECT id, turn, pos, {heading} AS heading FROM b)
    SELECT id, turn, pos, callout, junk, usable, heading, title, trouble FROM t JOIN h USING (id, turn, pos)"""


@query("line_tests", _test_sql())
def line_tests(spark, d):
    """Callouts, junk, usable headings, headings, titles and questions about faults among all lines of documents and turns."""
    cut = F.posexplode(F.split(C("text"), "\n")).alias("pos", "line")
    lines = read(spark, d, "documents").select(C("doc_id").alias("id"), F.lit(-1).alias("turn"), cut).unionByName(read(spark, d, "conversations").select(C("conv_id").alias("id"), "turn", cut))
    t = C("line")
    return lines.select("id", "turn", "pos", H.is_callout(t).alias("callout"), H.is_junk(t).alias("junk"), H.usable(t).alias("usable"), H.is_heading(t).alias("heading"), H.is_section_title(t).alias("title"), t.rlike(H.TROUBLE).alias("trouble"))


@query("guessed_headings")
def guessed_headings(spark, d):
    """The heading each document seems to be under."""
    return read(spark, d, "documents").select("doc_id", H.guessed(C("text")).alias("heading"))


@query(
    "clipped_excerpts",
    """SELECT doc_id, CASE WHEN length(text) <= 300 THEN text WHEN contains(c, chr(10)) AND 300 - instr(reverse(c), chr(10)) >= 150 THEN rtrim(substr(c, 1, 300 - instr(reverse(c), chr(10))), ' ') WHEN contains(c, ' ') AND 300 - instr(reverse(c), ' ') >= 150 THEN rtrim(substr(c, 1, 300 - instr(reverse(c), ' ')), ' ') ELSE c END AS excerpt
    FROM (SELECT doc_id, text, substr(text, 1, 300) AS c FROM documents)""",
)
def clipped_excerpts(spark, d):
    """Excerpts cut at a line, else at a space, if past the half."""
    return read(spark, d, "documents").select("doc_id", H.clip(C("text"), 300).alias("excerpt"))


@query("capacity_quantities", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE CASE WHEN '2.5–' || p_size || '|kw' < p_partkey % 90 || '|kwh' THEN '2.5–' || p_size || '|kw;' || p_partkey % 90 || '|kwh' ELSE p_partkey % 90 || '|kwh;2.5–' || p_size || '|kw' END END AS quantities FROM part")
def capacity_quantities(spark, d):
    """Power and energy out of texts, with their units; other numbers are none."""
    size, bank = C("p_size").cast("string"), (C("p_partkey") % 90).cast("string")
    text = F.when(C("p_partkey") % 3 == 0, F.concat(F.lit("model "), size, F.lit(" of 12 volts"))).otherwise(F.concat(F.lit("rated 2,5 - "), size, F.lit(" kW, bank of "), bank, F.lit("kWh, again "), bank, F.lit(" KWH")))
    return read(spark, d, "part").select("p_partkey", F.array_join(H.quantities(text), ";").alias("quantities"))


_PAIRS = [(0, 1, False, False), (2, 3, True, True), (4, 5, True, False), (0, 0, True, False), (6, 7, False, False), (2, 12, False, False)]


@query(
    "similar_sayings",
    "SELECT o_orderkey AS k, CASE o_orderkey % 6 " + " ".join(f"WHEN {i} THEN {str(p[2]).lower()}" for i, p in enumerate(_PAIRS)) + " END AS similar, CASE o_orderkey % 6 " + " ".join(f"WHEN {i} THEN {str(p[3]).lower()}" for i, p in enumerate(_PAIRS)) + " END AS errors FROM orders",
)
def similar_sayings(spark, d):
    """Pairs of texts by fuzzy similarity: opposites never, synonyms and looking at errors do."""
    texts = F.array(*[F.struct(F.lit(SAYINGS[a]).alias("a"), F.lit(SAYINGS[b]).alias("b")) for a, b, *_ in _PAIRS])
    p = read(spark, d, "orders").select(C("o_orderkey").alias("k"), F.get(texts, (C("o_orderkey") % 6).cast("int")).alias("p"))
    return p.select("k", M.similar(C("p.a"), C("p.b")).alias("similar"), M.consults_errors(M.plain(C("p.a")), M.plain(C("p.b"))).alias("errors"))


STEM_SQL = "CASE WHEN length(w) > 4 AND w LIKE '%ing' THEN substr(w, 1, length(w) - 3) WHEN length(w) > 4 AND w LIKE '%tion' THEN substr(w, 1, length(w) - 4) WHEN length(w) > 4 AND w LIKE '%ed' THEN substr(w, 1, length(w) - 2) WHEN length(w) > 4 AND w LIKE '%es' THEN substr(w, 1, length(w) - 2) WHEN length(w) > 4 AND w LIKE '%s' THEN substr(w, 1, length(w) - 1) ELSE w END"


@query(
    "content_stems",
    f"""SELECT doc_id, count(DISTINCT s) AS n, min(s) AS first_stem, max(s) AS last_stem FROM (SELECT doc_id, {STEM_SQL} AS s FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS w FROM documents) WHERE length(w) > 1 AND w NOT IN {H.STOP}) WHERE s NOT IN {H.STOP} GROUP BY doc_id""",
)
def content_stems(spark, d):
    """Stems of the words that carry a text's content."""
    s = read(spark, d, "documents").select("doc_id", H.content_tokens(C("text")).alias("s")).filter(F.size("s") > 0)
    return s.select("doc_id", F.size("s").cast("long").alias("n"), F.array_min("s").alias("first_stem"), F.array_max("s").alias("last_stem"))


@query(
    "grounded_items",
    f"""WITH {SAID}, c AS (SELECT device, list_distinct(flatten(list(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '')))) AS words FROM said WHERE status = 'F' GROUP BY device)
    SELECT k, coalesce(len(list_intersect(t, words)) >= 0.55 * least(len(t), len(words)), false) AS grounded FROM (SELECT k, device, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '')) AS t FROM said) LEFT JOIN c USING (device)""",
)
def grounded_items(spark, d):
    """Items enough of whose tokens occur in the entity's own excerpts; a corpus is folded to its tokens once."""
    s = said(spark, d)
    corpus = s.filter("status = 'F'").select("device", F.explode(M.tokens(C("text"))).alias("w")).groupBy("device").agg(F.collect_set("w").alias("words"))
    t = M.tokens(C("text"))
    return s.join(corpus, "device", "left").select("k", F.coalesce(F.size(F.array_intersect(t, "words")) >= 0.55 * F.least(F.size(t), F.size("words")), F.lit(False)).alias("grounded"))


@query(
    "editions",
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE 'rev ' || p_size END AS declared, p_size % 3 <> 0 AND p_size % 2 <> 0 AS mismatch FROM part""",
)
def editions(spark, d):
    """The edition a manual declares, and whether it is another than its label says, spelling apart."""
    size = C("p_size").cast("string")
    text = F.when(C("p_size") % 3 == 0, "nothing is said of it").otherwise(F.concat(F.lit("Manual, Revision "), size, F.lit(". All rights")))
    label = F.concat(F.lit("REV. "), F.when(C("p_size") % 2 == 0, size).otherwise("A"))
    norm = lambda t: F.regexp_replace(F.regexp_replace(F.lower(t), r"\brev(?:ision)?\b\.?", "rev"), r"\s+", " ")
    declared = F.nullif(norm(F.regexp_extract(text, r"(?i)\b(?:revision|edition|rev\.?)\s+\w+", 0)), F.lit(""))
    return read(spark, d, "part").select("p_partkey", declared.alias("declared"), F.coalesce(declared != norm(label), F.lit(False)).alias("mismatch"))


@query(
    "expanded_alternatives",
    """WITH r AS (SELECT o_custkey AS device, o_orderkey AS i, CASE WHEN o_orderkey % 2 = 0 THEN ['gx device', 'usb cable'] ELSE ['usb cable'] END AS parts, o_orderkey % 3 AS needed FROM orders),
    e AS (SELECT device, i, needed, unnest(parts) AS text, unnest(range(len(parts))) AS p FROM r), k AS (SELECT device, needed, text, min((i, p)) AS f FROM e GROUP BY device, needed, text),
    n AS (SELECT device, needed, text, f, row_number() OVER (PARTITION BY device ORDER BY f) - 1 AS new_i FROM k), m AS (SELECT e.device, e.i, min(new_i) AS new_i FROM e JOIN n USING (device, needed, text) GROUP BY e.device, e.i)
    SELECT m.device, m.i AS old_key, 'requires_devices[' || new_i || ']' AS path, (SELECT count(*) FROM n x WHERE x.device = m.device) AS entries FROM m""",
)
def expanded_alternatives(spark, d):
    """Requirements split into alternatives and made unique by text and use, with the new place of each old entry's evidence."""
    from pyspark.sql import Window

    text = F.when(C("o_orderkey") % 2 == 0, "GX device or USB  cable").otherwise("usb cable")
    parts = F.split(F.trim(text), r"(?i)\s+or\s+|,(?![^()]*\))")
    e = read(spark, d, "orders").select(C("o_custkey").alias("device"), C("o_orderkey").alias("i"), (C("o_orderkey") % 3).alias("needed"), F.posexplode(parts).alias("p", "t"))
    e = e.withColumn("text", F.regexp_replace(F.lower(F.trim("t")), r"\s+", " "))
    first = e.groupBy("device", "needed", "text").agg(F.min(F.struct("i", "p")).alias("f"))
    new = first.withColumn("new_i", F.row_number().over(Window.partitionBy("device").orderBy("f")) - 1).withColumn("entries", F.count("*").over(Window.partitionBy("device")))
    m = e.join(new, ["device", "needed", "text"]).groupBy("device", C("i").alias("old_key")).agg(F.min("new_i").alias("new_i"), F.first("entries").alias("entries"))
    return m.select("device", "old_key", F.concat(F.lit("requires_devices["), C("new_i").cast("string"), F.lit("]")).alias("path"), "entries")


@query(
    "collapsed_options",
    f"""WITH {SAID}, p AS (SELECT *, nullif(regexp_replace(replace(lower(regexp_extract(text, '(?is)^(.+?)\\s+to\\s+(.+)$', 1)), ' the ', ' '), '\\s+', ' ', 'g'), '') AS stem, lower(regexp_extract(text, '(?is)^(.+?)\\s+to\\s+(.+)$', 2)) AS opt FROM said)
    SELECT device, stem, string_agg(DISTINCT opt, ',' ORDER BY opt) AS options, count(*) AS n, min(k) AS first_key FROM p WHERE stem IS NOT NULL GROUP BY device, stem, status HAVING count(*) >= 2""",
)
def collapsed_options(spark, d):
    """Actions that set one thing to several values, as one row with its options; single ones stay as they are."""
    pattern = r"(?is)^(.+?)\s+to\s+(.+)$"
    stem = F.nullif(F.regexp_replace(F.replace(F.lower(F.regexp_extract("text", pattern, 1)), F.lit(" the "), F.lit(" ")), r"\s+", " "), F.lit(""))
    p = said(spark, d).withColumn("stem", stem).filter("stem IS NOT NULL")
    return p.groupBy("device", "stem", "status").agg(F.array_join(F.array_sort(F.collect_set(F.lower(F.regexp_extract("text", pattern, 2)))), ",").alias("options"), F.count("*").alias("n"), F.min("k").alias("first_key")).filter("n >= 2").drop("status")


@query("united_actions")
def united_actions(spark, d):
    """Actions of all groups of a device united in order, with the groups that disagree on the audience; order-dependent."""
    return greedy.united(said(spark, d), "device", ["k"], "k", "text", "status")


@query(
    "profile_digests",
    "SELECT device, sha256(string_agg(DISTINCT lower(trim(text)) || '/' || status, '|' ORDER BY lower(trim(text)) || '/' || status)) AS digest FROM (SELECT o_custkey AS device, s AS text, o_orderstatus AS status FROM orders JOIN (VALUES " + _values() + ") v(i, s) ON i = o_orderkey % 16) GROUP BY device",
)
def profile_digests(spark, d):
    """A hash of what a profile says, whatever the order and spelling: equal runs need no vote."""
    item = F.concat(F.lower(F.trim("text")), F.lit("/"), "status")
    return said(spark, d).groupBy("device").agg(F.sha2(F.array_join(F.array_sort(F.collect_set(item)), "|"), 256).alias("digest"))


@query(
    "prose_lint",
    f"""WITH {SAID} SELECT k, 'sentence_initial_numeral' AS code, '12' AS match FROM said WHERE k % 16 = 12 UNION ALL SELECT k, 'sentence_initial_numeral', '3' FROM said WHERE k % 16 = 7 UNION ALL SELECT k, 'pointer_not_paragraph_final', 'See the Water section.' FROM said WHERE k % 16 = 14
    UNION ALL SELECT k, 'instruction_missing_occasion', CASE k % 16 WHEN 0 THEN 'Open the quick menu' WHEN 2 THEN 'Check error codes and alarms' WHEN 4 THEN 'Set display brightness to high' WHEN 5 THEN 'Set screen brightness to low' WHEN 6 THEN 'Turn on the pump' ELSE 'Use the pump.' END FROM said WHERE k % 16 IN (0, 2, 4, 5, 6, 13)
    UNION ALL SELECT k, 'deictic_boat_reference', 'aboard' FROM said WHERE k % 16 = 14""",
)
def prose_lint(spark, d):
    """Rules on prose, each one filter over sentences: numerals that begin one, pointers that do not end a paragraph,
    instructions without an occasion, places on the boat named by pointing."""
    s = said(spark, d).select("k", F.posexplode(H.sentences(C("text"))).alias("i", "sentence"), F.size(H.sentences(C("text"))).alias("n"))
    x = C("sentence")
    cue, occasion = r"^(?:Use|Set|Change|Open|Press|Reset|Watch|Check|Turn|Shut|Apply|Activate)\b", r"(?i)\b(?:when|whenever|if|after|before|once|until|during|daily|at anchor)\b"
    rules = [
        ("sentence_initial_numeral", x.rlike(r"^\d"), F.regexp_extract(x, r"^\d+", 0)),
        ("pointer_not_paragraph_final", x.rlike(r"(?i)\bsee the .+ section\b") & (C("i") < C("n") - 1), x),
        ("instruction_missing_occasion", x.rlike(cue) & ~x.rlike(occasion), x),
        ("deictic_boat_reference", x.rlike(r"(?i)\b(?:aboard|on board|this boat)\b"), F.regexp_extract(x, r"(?i)\b(?:aboard|on board|this boat)\b", 0)),
    ]
    found = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(code).alias("code"), match.alias("match"))) for code, test, match in rules]))
    return s.select("k", F.explode(found).alias("f")).select("k", "f.code", "f.match")


@query(
    "composition_lint",
    """WITH b AS (SELECT o_custkey AS device, o_orderkey % 5 AS target, o_orderkey % 7 AS block FROM orders WHERE o_orderkey % 7 < 6),
    x AS (SELECT device, target FROM b GROUP BY device, target HAVING count(DISTINCT block) >= 2 AND max(block) - min(block) > count(DISTINCT block) - 1),
    u AS (SELECT o_custkey AS device, count(*) AS n FROM orders WHERE o_orderkey % 7 = 6 GROUP BY o_custkey), v AS (SELECT o_custkey AS device, count(*) FILTER (WHERE o_orderstatus = 'F') AS n FROM orders GROUP BY o_custkey)
    SELECT device, 'xref_not_consolidated' AS code, target AS n FROM x UNION ALL SELECT device, 'unknown_spine_block', n FROM u UNION ALL SELECT device, 'vessel_name_repeated', n FROM v WHERE n > 6""",
)
def composition_lint(spark, d):
    """Rules on a whole composition: references to one target in blocks that are no neighbours, blocks off the spine, a name
    said too often."""
    o = read(spark, d, "orders").select(C("o_custkey").alias("device"), (C("o_orderkey") % 5).alias("target"), (C("o_orderkey") % 7).alias("block"), C("o_orderstatus").alias("status"))
    on = o.filter("block < 6").groupBy("device", "target").agg(F.count_distinct("block").alias("n"), (F.max("block") - F.min("block")).alias("span")).filter("n >= 2 AND span > n - 1")
    out = on.select("device", F.lit("xref_not_consolidated").alias("code"), C("target").alias("n"))
    counts = o.groupBy("device").agg(F.count_if(C("block") == 6).alias("off"), F.count_if(C("status") == "F").alias("named"))
    out = out.unionByName(counts.filter("off > 0").select("device", F.lit("unknown_spine_block").alias("code"), C("off").alias("n")))
    return out.unionByName(counts.filter("named > 6").select("device", F.lit("vessel_name_repeated").alias("code"), C("named").alias("n")))


@query(
    "restated_quantities",
    """SELECT a.p_partkey AS peer, b.p_partkey AS wisdom FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 AND (a.p_size % 9 = b.p_size % 9 OR a.p_size % 9 = b.p_partkey % 9)""",
)
def restated_quantities(spark, d):
    """Wisdom sentences that say a quantity again that the peer before them states."""
    kw = lambda c: F.concat((c % 9).cast("string"), F.lit(" kW"))
    p = read(spark, d, "part")
    a = p.select(C("p_partkey").alias("peer"), H.quantities(F.concat(F.lit("gives "), kw(C("p_size")))).alias("qa"))
    b = p.select((C("p_partkey") - 1).alias("peer"), C("p_partkey").alias("wisdom"), H.quantities(F.concat(F.lit("at "), kw(C("p_size")), F.lit(" or "), kw(C("p_partkey")))).alias("qb"))
    return a.join(b, "peer").filter(F.arrays_overlap("qa", "qb")).select("peer", "wisdom")


@query(
    "zone_index",
    "SELECT r_regionkey, string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_name) AS systems FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 0) GROUP BY r_regionkey",
)
def zone_index(spark, d):
    """Zones with their published systems in catalogue order; zones without any are left out."""
    published = read(spark, d, "supplier").filter("s_acctbal > 0").select(C("s_nationkey").alias("n_nationkey")).distinct()
    n = read(spark, d, "nation").join(published, "n_nationkey", "left_semi")
    systems = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_name", "n_nationkey"))), lambda x: x["n_nationkey"].cast("string")), ",")
    return n.groupBy(C("n_regionkey").alias("r_regionkey")).agg(systems.alias("systems"))


@query("coverage_gaps", "SELECT n_regionkey AS chapter, count(*) AS gaps, min(n_name) AS first_gap FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000) GROUP BY n_regionkey")
def coverage_gaps(spark, d):
    """What each chapter's equipment has no material for."""
    have = read(spark, d, "supplier").filter("s_acctbal > 8000").select(C("s_nationkey").alias("n_nationkey"))
    return read(spark, d, "nation").join(have, "n_nationkey", "left_anti").groupBy(C("n_regionkey").alias("chapter")).agg(F.count("*").alias("gaps"), F.min("n_name").alias("first_gap"))


@query(
    "chosen_manuals",
    "SELECT p_size, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS manuals FROM (SELECT *, CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'SMALL' THEN 1 ELSE 2 END AS r, min(CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'SMALL' THEN 1 ELSE 2 END) OVER (PARTITION BY p_size) AS best FROM part) WHERE r = best GROUP BY p_size",
)
def chosen_manuals(spark, d):
    """Of each kind of equipment's manuals those of the best class there is: operator's, service, then installation."""
    rank = F.when(C("p_type") == "ECONOMY", 0).when(C("p_type") == "SMALL", 1).otherwise(2)
    per = read(spark, d, "part").groupBy("p_size", rank.alias("r")).agg(F.array_join(F.array_sort(F.collect_list("p_partkey")), ",").alias("manuals"))
    return per.groupBy("p_size").agg(F.min_by("manuals", "r").alias("manuals"))


@query(
    "overridden_cards",
    """WITH f AS (SELECT l_partkey AS card, max_by(l_suppkey, (l_orderkey, l_linenumber)) AS w FROM lineitem WHERE l_quantity > 45 GROUP BY l_partkey)
    SELECT p_partkey AS card, coalesce(w, 0) AS writer, CASE WHEN w IS NULL THEN 'base' ELSE 'fragment' END AS origin FROM part LEFT JOIN f ON card = p_partkey UNION ALL SELECT -card, w, 'extra' FROM f WHERE card % 10 = 0""",
)
def overridden_cards(spark, d):
    """Cards replaced by key, the last writer winning, and extra cards appended."""
    f = read(spark, d, "lineitem").filter("l_quantity > 45").groupBy(C("l_partkey").alias("card")).agg(F.max_by("l_suppkey", F.struct("l_orderkey", "l_linenumber")).alias("by"))
    base = read(spark, d, "part").select(C("p_partkey").alias("card")).join(f, "card", "left").select("card", F.coalesce("by", F.lit(0)).alias("writer"), F.when(C("by").isNull(), "base").otherwise("fragment").alias("origin"))
    return base.unionByName(f.filter("card % 10 = 0").select((-C("card")).alias("card"), C("by").alias("writer"), F.lit("extra").alias("origin")))


@query(
    "published_versions",
    """WITH h AS (SELECT o_custkey, sha256('a' || count(*) FILTER (WHERE o_orderstatus <> 'P')) AS old, sha256('a' || count(*)) AS new, max(o_orderkey % 9) AS version FROM orders GROUP BY o_custkey)
    SELECT o_custkey, CASE WHEN old = new THEN version ELSE version + 1 END AS version, old <> new AS published FROM h""",
)
def published_versions(spark, d):
    """A new version only where the content's hash has changed."""
    h = read(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(C("o_orderstatus") != "P").alias("a"), F.count("*").alias("b"), F.max(C("o_orderkey") % 9).alias("version"))
    old, new = (F.sha2(F.concat(F.lit("a"), C(c).cast("string")), 256) for c in ("a", "b"))
    return h.select("o_custkey", F.when(old == new, C("version")).otherwise(C("version") + 1).alias("version"), (old != new).alias("published"))
