"""Nested documents made of the lines of ``documents`` and of event properties: walks, fields by path, prose, a profile's schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import nested
from ..sources.tables import read
from .catalog import query

C = F.col
_DOCS = """docs AS (SELECT doc_id, to_json({'title': coalesce(source, ''), 'sections': list_transform(string_split(text, chr(10) || chr(10)), lambda s: {'title': left(s, 9), 'kind': lang,
    'cards': list_transform(string_split(s, chr(10)), lambda l: {'body': l, 'note': {'text': 'said "' || l || '" \\ {body}'}})})}) AS doc FROM documents WHERE text IS NOT NULL)"""


def built(spark, d):
    """(doc_id, doc): a document's blocks as sections, their lines as cards; texts with quotes and braces, five levels deep."""
    card = lambda line: F.struct(line.alias("body"), F.struct(F.concat(F.lit('said "'), line, F.lit('" \\ {body}')).alias("text")).alias("note"))
    section = lambda s: F.struct(F.left(s, F.lit(9)).alias("title"), C("lang").alias("kind"), F.transform(F.split(s, "\n"), card).alias("cards"))
    doc = F.struct(F.coalesce("source", F.lit("")).alias("title"), F.transform(F.split("text", "\n\n"), section).alias("sections"))
    return read(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.to_json(doc, {"ignoreNullFields": "false"}).alias("doc"))


@query("nested_leaves", f"WITH {_DOCS} SELECT doc_id, t.fullkey AS path, CASE t.type WHEN 'NULL' THEN 'VOID' ELSE 'STRING' END AS type, t.atom ->> '$' AS text FROM docs, json_tree(doc) t WHERE t.type NOT IN ('OBJECT', 'ARRAY')")
def nested_leaves(spark, d):
    """Every leaf of the documents with its path."""
    return nested.leaves(built(spark, d), ["doc_id"], "doc")


@query("prose_strings", f"WITH {_DOCS} SELECT doc_id, count(*) AS n, sum(length(t.atom ->> '$'))::BIGINT AS letters FROM docs, json_tree(doc) t WHERE t.type = 'VARCHAR' AND regexp_matches(t.fullkey, '^\\$(\\.(sections|cards)\\[[0-9]+\\])*\\.(title|body)$') AND trim(t.atom ->> '$') <> '' GROUP BY doc_id")
def prose_strings(spark, d):
    """Texts under prose keys, however deep; texts under other keys, and keys within texts, are left out."""
    return nested.prose(nested.leaves(built(spark, d), ["doc_id"], "doc")).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("letters"))


_PATHS = ("sections[0].cards[0].note.text", "title", "sections[1].title", "sections.title", "title[0]", "sections[0].none.x", "a..b", "")


@query(
    "resolved_fields",
    f"""WITH {_DOCS}, p AS (SELECT doc_id, doc, doc_id % 8 AS k, json_array_length(doc, '$.sections') AS n FROM docs)
    SELECT doc_id, k IN (0, 1) OR (k = 2 AND n > 1) AS ok, CASE k WHEN 0 THEN doc ->> '$.sections[0].cards[0].note.text' WHEN 1 THEN doc ->> '$.title' WHEN 2 THEN doc ->> '$.sections[1].title' END AS text,
      CASE k WHEN 2 THEN CASE WHEN n < 2 THEN 'index out of range at sections[1]' END WHEN 3 THEN 'missing sections.title' WHEN 4 THEN 'not a list at title[0]' WHEN 5 THEN 'missing sections[0].none' WHEN 6 THEN 'empty or malformed path' WHEN 7 THEN 'empty or malformed path' END AS error FROM p""",
)
def resolved_fields(spark, d):
    """Fields at paths that come with the rows, and why there is none."""
    path = F.get(F.array(*[F.lit(p) for p in _PATHS]), (C("doc_id") % len(_PATHS)).cast("int"))
    r = built(spark, d).select("doc_id", nested.resolved(F.parse_json("doc"), path).alias("r"))
    return r.select("doc_id", "r.ok", F.variant_get("r.value", "$", "string").alias("text"), "r.error")


@query(
    "changed_fields",
    """SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE coalesce(json_extract_string(props, '$.k'), 'none') END AS before, CASE event_id % 3 WHEN 0 THEN 'it "is"' WHEN 1 THEN json_extract_string(props, '$.k') END AS after FROM events""",
)
def changed_fields(spark, d):
    """Event properties with a field set: over one that is there, beside it, or below it, where nothing can be."""
    path = F.get(F.array(F.lit("k"), F.lit("more"), F.lit("k.below")), (C("event_id") % 3).cast("int"))
    e = read(spark, d, "events").select("event_id", "props", nested.with_value(C("props"), path, F.lit('"it \\"is\\""')).alias("new"))
    k = lambda c: F.try_variant_get(F.parse_json(c), F.lit("$.k"), "string")
    return e.select("event_id", F.when(C("new").isNotNull(), F.coalesce(k("props"), F.lit("none"))).alias("before"), k("new").alias("after"))


@query(
    "normalised_profiles",
    """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE trim(p_name) END AS model, CASE p_partkey % 3 WHEN 0 THEN p_brand || ',' || p_type WHEN 1 THEN p_brand ELSE '' END AS networks, p_partkey % 5 IN (0, 2) AS controllable,
      CASE WHEN p_partkey % 7 = 0 THEN 0.0 ELSE least(1.0, p_size / 40.0) END::DOUBLE AS confidence, CASE WHEN p_partkey % 2 = 0 THEN 'unknown' ELSE 'daily' END AS frequency FROM part""",
)
def normalised_profiles(spark, d):
    """Raw profiles brought to a schema: defaults for what is missing or of the wrong type, lists of texts only, numbers clamped."""
    k = C("p_partkey")
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    model = F.when(k % 4 == 0, "12").otherwise(text(F.concat(F.lit(" "), "p_name", F.lit(" "))))
    nets = F.when(k % 3 == 0, F.concat(F.lit("["), text(C("p_brand")), F.lit(",7,null,"), text(C("p_type")), F.lit("]"))).when(k % 3 == 1, text(C("p_brand"))).otherwise('{"a":1}')
    flag = F.get(F.array(F.lit("true"), F.lit("false"), F.lit('"yes"'), F.lit('"maybe"'), F.lit("null")), (k % 5).cast("int"))
    sure = F.when(k % 7 == 0, '"high"').otherwise((C("p_size") / 40.0).cast("decimal(10,4)").cast("string"))
    often = F.when(k % 2 == 0, '"Hourly"').otherwise('" DAILY "')
    raw = F.concat(F.lit('{"device":{"model":'), model, F.lit('},"networks":'), nets, F.lit(',"controllable":'), flag, F.lit(',"confidence":'), sure, F.lit(',"use":[{"frequency":'), often, F.lit("}]}"))
    v = read(spark, d, "part").select("p_partkey", F.parse_json(raw).alias("v"))
    return v.select("p_partkey", *[c.alias(n) for n, c in nested.normalised(C("v"), PROFILE).items()])


#: Fields of a profile: path, kind, and what stands for a value that is missing or of another kind.
PROFILE = {
    "model": ("device.model", "text", ""),
    "networks": ("networks", "texts", None),
    "controllable": ("controllable", "flag", False),
    "confidence": ("confidence", "share", 0.0),
    "frequency": ("use[0].frequency", ("daily", "weekly", "monthly", "rarely"), "unknown"),
}
