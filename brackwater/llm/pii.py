"""Personal data: base patterns, and bootstrapped contextual extraction of identifiers the patterns miss.

Base spans come from four expressions, leftmost and non-overlapping per kind; matches that fail their check are dropped.
They are the seeds. A *pattern* is the pair of words before a candidate token (one with a digit or @); an *instance* is the
token without outer punctuation. The pattern-instance graph is scored in turns, all in Spark: a pattern scores the mean of
its distinct instances' scores (smoothed by one), an instance outside the seeds the noisy-or of its patterns. Only patterns
that introduce at least ``MIN_SEEDS`` distinct seeds of a kind take part. Scores are iterated until they settle; what a
pattern says of its own unseen instances is solved for, as it would settle ever more slowly the more there are: with n seeds,
z seeds of other kinds and t told of its unseen instances by other patterns it scores (n + t) / (n + z + 1 + t). The instances
of patterns that score at least ``ACCEPT`` are seeds of the next turn, until a turn finds none; the tokens behind patterns
accepted in any turn become further spans of that kind. Base spans always stay.

Everything is DataFrame expressions. The scan is one projection, whose small result is written once to the shared folder;
the graph works on distinct edges, so copies of a document add nothing to a score and hot contexts are pre-aggregated.

The patterns below match the same spans as the plain ones in the contract. They are possessive, and start only where no
earlier start could match (``\\G``: right behind the last match), which keeps long runs of one class linear.

Null and empty texts have no spans. Offsets count code points. Repeated rows (same id and text) get the same spans.
Further columns are not read by ``find``; ``redact`` returns the columns it was given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
MIN_SEEDS = 3
ACCEPT = 0.75
#: Scores that move by no more than this have settled, and a score so near ACCEPT reaches it.
SETTLED = 1e-6
BLOCK = 128
SPANS = "array<struct<start:int,end:int,value:string>>"


#: The last two words of a gap, whole, or its only one. Possessive, and begun at words only: linear in the gap.
LAST_WORDS = r"(?<!\S)(\S++(?:\s++\S++)?+)\s*+$"


def located(text: Column, matches: Column, pattern: str) -> Column:
    """Start, end (code points) and value of each of ``matches`` (all matches of ``pattern`` in ``text``)."""
    gaps = F.slice(F.split(text, pattern), 1, F.size(matches))
    parts = F.zip_with(matches, gaps, lambda v, gap: F.struct(v.alias("v"), F.length(gap).alias("gap")))
    # Running sums in two levels, blocks and members: a fold copies what it has gathered at every step.
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / BLOCK).cast("int")), lambda b: F.slice(parts, b * BLOCK + 1, F.lit(BLOCK)))
    width = lambda x: x["gap"] + F.length(x["v"])
    wide = F.transform(blocks, lambda b: F.struct(b.alias("block"), F.aggregate(b, F.lit(0), lambda n, x: n + width(x)).alias("width")))
    placed = F.aggregate(
        wide,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, w: F.struct((acc["at"] + w["width"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
    )["out"]

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["v"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["v"].alias("value")))).alias("out"))

    members = F.zip_with(blocks, placed, lambda b, at: F.aggregate(b, F.struct(at.alias("at"), F.array().cast(SPANS).alias("out")), add)["out"])
    return F.when(F.size(matches) > 0, F.flatten(members)).otherwise(F.array().cast(SPANS))


def passes(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        plain = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(plain(p)) <= 3) & (F.coalesce(plain(p).try_cast("int"), F.lit(256)) <= 255))
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def passing(kind: str):
    return lambda s: passes(kind, s["value"])


def as_span(kind_no: int):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(kind_no).alias("kind_no"), s["end"].alias("end"))


def of_kind(kind_no: int):
    return lambda s: s["kind_no"] == kind_no


def with_base_spans(docs: DataFrame, text: Column) -> DataFrame:
    """Adds ``_base``: array of (start, kind_no, end), in that order."""
    # A match of a kind has its sign; the cheap test spares the texts without one the expression.
    sign = {"email": text.contains("@"), "ip": F.col("_digit"), "card": F.col("_digit"), "phone": text.contains("+") & F.col("_digit")}
    none = F.array().cast("array<string>")
    raw = {f"_m_{k}": F.when(sign[k], F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0))).otherwise(none) for k in KINDS}
    docs = docs.withColumn("_digit", text.rlike("[0-9]"))
    docs = docs.withColumns(raw)
    parts = []
    for n, k in enumerate(KINDS):
        good = F.filter(located(text, F.col(f"_m_{k}"), PATTERNS[k]), passing(k))
        parts.append(F.transform(good, as_span(n)))
    return docs.withColumn("_base", F.array_sort(F.concat(*parts))).drop(*raw)


def extract(docs: DataFrame) -> DataFrame:
    """Written table (doc_id, h, base, candidates): one scan, no text in it. ``h`` tells apart texts under one id."""
    text = F.col("_text")
    docs = with_base_spans(docs.select("doc_id", common.text_of().alias("_text")), text)
    some = F.col("_digit") | text.contains("@")
    docs = docs.withColumn("_c", F.when(some, F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))).otherwise(F.array().cast("array<string>")))
    # The words before a candidate: the end of the gap in front of it.
    gaps = F.slice(F.split(text, CANDIDATE), 1, F.size("_c"))
    context = F.transform(gaps, lambda g: F.lower(F.regexp_replace(F.regexp_extract(g, LAST_WORDS, 1), r"\s+", " ")))
    spans = F.zip_with(located(text, F.col("_c"), CANDIDATE), context, lambda s, c: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), c.alias("context")))

    def place(s: Column) -> Column:
        seed = F.filter("_base", lambda b: (b["start"] >= s["start"]) & (b["start"] < s["end"]))
        token = F.lower(F.regexp_replace(s["value"], r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["context"].alias("pattern"), token.alias("instance"), F.try_element_at(seed, F.lit(1))["kind_no"].alias("kind_no"))

    inside = lambda s: F.exists("_base", lambda b: (s["start"] > b["start"]) & (s["start"] < b["end"]))
    found = F.when(F.size("_c") > 0, F.transform(F.filter(spans, lambda s: ~inside(s) & (s["context"] != "")), place))
    return common.written(docs.select("doc_id", F.xxhash64("_text").alias("h"), F.col("_base").alias("base"), found.alias("candidates")), "pii-extract")


def score_patterns(distinct: DataFrame, min_seeds: int = MIN_SEEDS) -> DataFrame | None:
    """(pattern, kind_no, score) of patterns with enough seeds, settled; None if there are none. distinct(pattern, instance, seed_kind)."""
    seeded = distinct.filter("seed_kind is not null").groupBy("pattern", F.col("seed_kind").alias("kind_no")).count().filter(F.col("count") >= min_seeds).drop("count")
    graph = common.written(distinct.join(seeded, "pattern"), "pii-graph")
    if graph.isEmpty():
        return None
    own = F.col("seed_kind") == F.col("kind_no")
    of = graph.groupBy("pattern", "kind_no").agg(F.count_if(own).alias("n"), F.count_if(~own).alias("other"))
    scores = common.written(of.withColumn("score", F.col("n") / (F.col("n") + F.col("other") + 1)), "pii-scores")
    # What other patterns say of an instance; those of a single pattern say of it what it says itself.
    unseen = graph.filter("seed_kind is null").select("pattern", "kind_no", "instance")
    shared = unseen.groupBy("instance", "kind_no").count().filter("count > 1").drop("count")
    shared = common.written(unseen.join(shared, ["instance", "kind_no"]), "pii-shared")
    moved = 0.0 if shared.isEmpty() else 1.0
    while moved > SETTLED:
        edges = shared.join(scores.select("pattern", "kind_no", F.log1p(-F.col("score")).alias("doubt")), ["pattern", "kind_no"])
        every = edges.groupBy("instance", "kind_no").agg(F.sum("doubt").alias("doubts"))
        others = edges.join(every, ["instance", "kind_no"]).groupBy("pattern", "kind_no").agg(F.sum(1 - F.exp(F.col("doubts") - F.col("doubt"))).alias("told"))
        told = F.coalesce(F.col("told"), F.lit(0.0))
        new = scores.withColumnRenamed("score", "before").join(others, ["pattern", "kind_no"], "left").withColumn("score", (F.col("n") + told) / (F.col("n") + F.col("other") + 1 + told))
        scores = common.written(new.drop("told"), "pii-scores")
        moved = scores.agg(F.max(F.abs(F.col("score") - F.col("before")))).first()[0]
        scores = scores.drop("before")
    return scores.select("pattern", "kind_no", "score")


def accepted_patterns(edges: DataFrame, accept: float = ACCEPT, **how) -> DataFrame | None:
    """(pattern, k): patterns accepted in any turn and minus their kind; None if there are none. edges(pattern, instance, kind_no)."""
    distinct = common.written(edges.groupBy("pattern", "instance").agg(F.max("kind_no").alias("seed_kind")), "pii-edges")
    taken = None
    while (scores := score_patterns(distinct, **how)) is not None:
        # The kind that scores best, the one listed first among equals, is the pattern's; that of an earlier turn stays.
        best = scores.filter(F.col("score") >= accept - SETTLED).groupBy("pattern").agg(F.max(F.struct("score", (-F.col("kind_no")).alias("k"))).alias("b")).select("pattern", "b.*")
        taken = common.written(best if taken is None else taken.unionByName(best.join(taken, "pattern", "left_anti")), "pii-patterns")
        # What accepted patterns introduce are seeds of the next turn.
        new = distinct.filter("seed_kind is null and instance <> ''").join(taken, "pattern").groupBy("instance").agg((-F.max(F.struct("score", "k"))["k"]).alias("new_kind"))
        new = common.written(new, "pii-seeds")
        if new.isEmpty():
            break
        distinct = common.written(distinct.join(new, "instance", "left").select("pattern", "instance", F.coalesce("seed_kind", "new_kind").alias("seed_kind")), "pii-edges")
    return taken


def extra_spans(extracted: DataFrame, **how) -> DataFrame | None:
    """(doc_id, h, extra) for documents in which accepted patterns discover unseen identifiers; None if there are none."""
    seen = extracted.select("doc_id", "h", F.explode("candidates").alias("c")).select("doc_id", "h", "c.*")
    best = accepted_patterns(seen.select("pattern", "instance", "kind_no"), **how)
    if best is None:
        return None
    found = seen.filter("kind_no is null and instance <> ''").join(common.small(best.select("pattern", "k")), "pattern")
    # Copies of a row have equal spans: one of each is kept, and both copies get them when they are joined back.
    return common.written(found.groupBy("doc_id", "h").agg(F.collect_set(F.struct("start", (-F.col("k")).alias("kind_no"), "end")).alias("extra")), "pii-extra")


def joined_spans(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind_no"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def with_extra(df: DataFrame, extra: DataFrame | None) -> DataFrame:
    """Adds ``extra`` by (doc_id, h), an empty array where there is none."""
    none = F.array().cast("array<struct<start:int,kind_no:int,end:int>>")
    if extra is None:
        return df.withColumn("extra", none)
    extra = common.small(extra).alias("x")
    return df.alias("d").join(extra, F.col("d.doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("d.h") == F.col("x.h")), "left").select("d.*", F.coalesce("x.extra", none).alias("extra"))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): arrays of (start, kind_no, end) in that order."""
    extracted = extract(docs)
    df = with_extra(extracted, extra_spans(extracted))
    return df.select("doc_id", "base", F.array_sort(F.concat("base", "extra")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets and ``n_chars`` counted anew; null stays null.

    Spans that overlap are replaced together, under the name of the first.
    """
    columns = docs.columns
    extra = extra_spans(extract(docs))
    text = F.col("text")
    df = with_base_spans(docs.withColumn("h", F.xxhash64(common.text_of())), common.text_of())
    df = with_extra(df, extra).withColumn("_spans", F.array_sort(F.concat("_base", "extra")))
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def cut(acc: Column, s: Column) -> Column:
        skip = s["start"] < acc["at"]
        new = F.array(F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), marks[s["kind_no"]])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(skip, acc["out"]).otherwise(F.concat(acc["out"], new)).alias("out"))

    df = df.withColumn("_cut", F.when(F.size("_spans") > 0, F.aggregate("_spans", zero, cut)))
    clean = F.when(F.col("_cut").isNull(), text).otherwise(F.concat(F.array_join("_cut.out", ""), F.substr(text, F.col("_cut.at") + 1, F.length(text))))
    df = df.withColumn("text", clean)
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*columns) if "n_chars" in columns else df.select(*columns)


def op3_find_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.filter("base", of_kind(n))).cast("long").alias(f"n_{k}") for n, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined_spans(F.col("base")), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"))
