"""Mixing sources to target weights by weighted fair queueing.

Every document of a source waits in that source's queue, in a shuffled order that depends on the seed alone. A copy of a
document gets the virtual finish time (words of its source up to and including it) / (target of the source), so that all
copies, ordered by finish time, interleave the sources in proportion to their targets. The order is global: virtual time is
cut into ranges, the words that finish in each are summed, and the running total over the ranges shows the time at which
the mix has served its budget (the whole words of all targets). There it is cut: copies that finish by then are taken whole,
one that is in service gives the words served by then, later ones none. A source whose target exceeds its size is queued
again, up to ``max_repeats`` times.

Sums are two-level: a source's queue is cut into slots by the shuffle hash, and slots are summed and timed first. Only rows of
one slot of one source meet in a task, so a source with a third of all rows is spread over all slots. ``serve`` needs the
order within a slot only where the mix ends: all other texts are read and written once, and none but those are shuffled.

Null or empty texts have size 0: they take part, take no words and finish with the document before them. A null source is
a source of its own, ordered last. Repeated rows are separate copies with the same hash; which of them comes first does
not change any sum. An empty table gives an empty result. Further columns are carried unless they bear the names of result
columns, which the result's own replace (``serve`` keeps them all). Null ids share one slot of their source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WORDS = r"[^\x20\x09-\x0D]+"
#: A source's queue has 16 ** SLOT_DIGITS slots; rows of one slot of one source meet in one task.
SLOT_DIGITS = 3
#: Ranges of a unit of virtual time; a power of two, so that borders times a target are exact.
RANGES = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def shuffle_key(seed: int) -> Column:
    """A uniform key of the document and the seed alone: reruns and retried tasks deal the same order."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f"-{seed}")).cast("binary"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: float = 3.0, budget_share: float = 1.0) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) per source.

    Water filling in closed form: with sources ordered by the share at which their cap binds, size*max/weight, the capped
    ones are a prefix; the level is what the budget leaves over the weights of the rest. One row per source is sorted.
    """
    n = len(weights)
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    by_bind = Window.orderBy("bind", F.col("source").isNull(), F.encode("source", "utf-8"))
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(n)) + 1).cast("int"))
    ranked = (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
        .withColumn("bind", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(budget_share)))
        .withColumn("capped_before", F.coalesce(F.sum("cap").over(by_bind.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(by_bind.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", F.greatest(F.lit(0.0), F.col("budget") - F.col("capped_before")) / F.col("weight_left"))
    )
    # The first source (in binding order) that is not capped at its level fixes the level of all the others.
    free = F.min(F.when(F.col("bind") > F.col("level"), F.struct("bind", "level"))).over(everything)
    return ranked.select("source", "source_size", F.least("cap", F.coalesce(free["level"] * F.col("weight"), F.col("cap"))).alias("target"))


def slot_of(order: Column) -> Column:
    return F.conv(F.substring(order, 1, SLOT_DIGITS), 16, 10).cast("int")


def timed_slots(docs: DataFrame, weights: tuple[int, ...], max_repeats: int, budget_share: float, seed: int) -> DataFrame:
    """Written table (source, _slot, slot_size, _slot_before, source_size, target): the queues of all sources, slot by slot."""
    sized = docs.select("source", slot_of(shuffle_key(seed)).alias("_slot"), word_count(F.col("text")).alias("size"))
    slots = common.written(sized.groupBy("source", "_slot").agg(F.sum("size").alias("slot_size")), "mix-slots")
    targets = source_targets(slots.groupBy("source").agg(F.sum("slot_size").alias("source_size")), weights, max_repeats, budget_share)
    of_source = Window.partitionBy("source").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("_slot_before", F.coalesce(F.sum("slot_size").over(of_source), F.lit(0)))
    timed = slots.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.source", "_slot", "slot_size", "_slot_before", "source_size", "target")
    return common.written(timed, "mix-timed")


def end_of_mix(timed: DataFrame, max_repeats: int, ranges: int = RANGES) -> float:
    """The virtual time at which the running total of all sources' words, in order of finish time, reaches the budget.

    The budget is the sum of the targets' whole words. Each slot's copies are split at the borders of the time ranges; what
    finishes in each range is summed, and totals run over the ranges (two units of time at most).
    """
    copies = timed.filter(F.col("target") > 0).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))))
    low = F.col("_slot_before") + F.col("_k") * F.col("source_size")
    copies = copies.select("target", low.alias("low"), (low + F.col("slot_size")).alias("high"))
    in_range = lambda words: F.least(F.floor(words * F.lit(float(ranges)) / F.col("target")), F.lit(2 * ranges))
    copies = copies.filter((F.col("high") > F.col("low")) & (in_range(F.col("low")) < 2 * ranges)).withColumn("range", F.explode(F.sequence(in_range(F.col("low")), in_range(F.col("high")))))
    served = lambda border: F.greatest("low", F.least("high", F.floor(border * F.col("target") / F.lit(float(ranges)))))
    finished = copies.groupBy("range").agg(F.sum(served(F.col("range") + 1) - served(F.col("range"))).alias("words"))
    totals = finished.withColumn("total", F.sum("words").over(Window.orderBy("range")))  # a row a range
    budget = timed.groupBy("source").agg(F.floor(F.first("target")).alias("whole")).agg(F.sum("whole")).first()[0]
    first_beyond = totals.filter(F.col("total") > F.lit(budget or 0)).agg(F.min("range")).first()[0]
    return (2 * ranges if first_beyond is None else first_beyond) / ranges


def words_taken(size: Column, before: Column, served: Column, max_repeats: int) -> Column:
    """Words of a document, ``before`` words into its queue, among the first ``served`` of the queue and its repeats."""
    one = lambda k: F.greatest(F.lit(0).cast("long"), F.least(size, served - (before + F.col("source_size") * k)))
    return sum((one(k) for k in range(max_repeats)), F.lit(0).cast("long")).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, budget_share: float = 1.0, seed: int = 17) -> DataFrame:
    """``docs`` with size, source_size, target, taken, and ``finish``, the virtual time at which its first copy ends.

    A document in service when the budget ends gives the words served by then, so each source's taken words differ from
    its target by less than one word for each pass through its queue. Rows are dealt by (source, slot), once: the window and
    the join have the same keys. ``serve`` gives the documents themselves without dealing their texts.
    """
    own = ["size", "source_size", "target", "taken", "finish", "_slot", "_order", "_before", "_slot_before", "_name", "_none"]
    docs = docs.drop(*[c for c in own if c in docs.columns])
    timed = timed_slots(docs, weights, max_repeats, budget_share, seed)
    end = end_of_mix(timed, max_repeats)
    keys = {"_name": F.coalesce(F.col("source"), F.lit("")), "_none": F.col("source").isNull()}
    sized = docs.withColumn("size", word_count(F.col("text"))).withColumn("_order", shuffle_key(seed)).withColumn("_slot", slot_of(F.col("_order"))).withColumns(keys)
    in_slot = Window.partitionBy("_name", "_none", "_slot").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    queued = sized.withColumn("_before", F.coalesce(F.sum("size").over(in_slot), F.lit(0)))
    frame = timed.withColumns(keys).select("_name", "_none", "_slot", "_slot_before", "source_size", "target")
    joined = queued.join(frame, ["_name", "_none", "_slot"])
    before = F.col("_slot_before") + F.col("_before")
    taken = words_taken(F.col("size"), before, F.floor(F.lit(end) * F.col("target")), max_repeats)
    finish = F.when(F.col("target") > 0, (before + F.col("size")) / F.col("target"))
    return joined.withColumn("taken", taken).withColumn("finish", finish).select(*docs.columns, "size", "source_size", "target", "taken", "finish")


def serve(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, budget_share: float = 1.0, seed: int = 17) -> DataFrame:
    """The mix itself: a row of ``docs`` for each pass in which the document is served; one without words stays once.

    The row for a document in service at the end of the mix is whole. Sources are met by a broadcast row each (behind a check of
    their number); a document's slot says in which passes it is served, but for slots in service at the end, whose rows are
    the only ones to be dealt and ordered.
    """
    timed = timed_slots(docs, weights, max_repeats, budget_share, seed)
    served = F.floor(F.lit(end_of_mix(timed, max_repeats)) * F.col("target"))
    high = lambda k: F.col("_slot_before") + F.col("slot_size") + F.col("source_size") * k
    # Of each pass, the first slot that is not served to its end, and the words before it.
    last = lambda k: F.min(F.when(high(k) > served, F.struct(F.col("_slot").alias("slot"), F.col("_slot_before").alias("before"))))
    sources = timed.groupBy("source").agg(F.first(served).alias("_served"), F.first("source_size").alias("_source_size"), F.array(*[last(k) for k in range(max_repeats)]).alias("_ends"))
    sources = common.small(common.written(sources.withColumnRenamed("source", "_source"), "mix-sources"))
    # The row travels as one column, so that no name of its own can clash.
    placed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "text", "source", shuffle_key(seed).alias("_order"))
    placed = placed.withColumn("_slot", slot_of(F.col("_order"))).join(sources, F.col("source").eqNullSafe(F.col("_source")))
    at_end = F.exists("_ends", lambda e: e["slot"] == F.col("_slot"))
    at_end = F.coalesce(at_end, F.lit(False))
    passes = F.size(F.filter("_ends", lambda e: e.isNull() | (e["slot"] > F.col("_slot"))))
    empty = ~F.coalesce(F.col("text").rlike(WORDS), F.lit(False))
    whole = placed.filter(~at_end).withColumn("_copies", F.when(empty, F.lit(1)).otherwise(passes))
    in_slot = Window.partitionBy("_source", "_slot").orderBy("_order", "doc_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    ended = placed.filter(at_end).withColumn("_size", word_count(F.col("text"))).withColumn("_in_slot", F.coalesce(F.sum("_size").over(in_slot), F.lit(0)))
    before = F.filter("_ends", lambda e: e["slot"] == F.col("_slot"))[0]["before"] + F.col("_in_slot")
    reached = sum((F.when(F.col("_served") > before + F.col("_source_size") * k, 1).otherwise(0) for k in range(max_repeats)), F.lit(0))
    ended = ended.withColumn("_copies", F.when(F.col("_size") == 0, F.lit(1)).otherwise(reached))
    both = whole.select("_row", "_copies").unionByName(ended.select("_row", "_copies"))
    return both.withColumn("_copies", F.explode(F.array_repeat(F.lit(1), F.col("_copies")))).select("_row.*")


def in_mix_order(mixed: DataFrame, size: str = "size") -> DataFrame:
    """One row per copy taken (``pass``, ``served`` words of it), globally range-sorted by virtual finish time."""
    k = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("taken") / F.greatest(F.col(size), F.lit(1))) - 1).cast("int")))
    copies = mixed.filter(F.col("taken") > 0).withColumn("pass", k)
    copies = copies.withColumn("served", F.least(F.col(size), F.col("taken") - F.col("pass") * F.col(size)))
    copies = copies.withColumn("finish", F.col("finish") + F.col("pass") * F.col("source_size") / F.col("target"))
    return copies.repartitionByRange("finish", "doc_id").sortWithinPartitions("finish", "doc_id")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mix(docs).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", F.round("finish", 9).alias("finish"))
    return mixed.repartitionByRange("finish", "doc_id").sortWithinPartitions("finish", "doc_id")


OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || '-17') AS k
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [1.0, 2.0, 3.0][((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3) + 1]::DOUBLE AS weight FROM sources),
bound AS (SELECT *, source_size * 3.0::DOUBLE AS cap, source_size * 3.0::DOUBLE / weight AS bind FROM weighed),
levels AS (
  SELECT *, greatest(0.0, (SELECT sum(source_size)::DOUBLE FROM sources)
      - coalesce(sum(cap) OVER (ORDER BY bind, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
      / sum(weight) OVER (ORDER BY bind, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM bound),
targets AS (
  SELECT source, source_size,
         least(cap, coalesce((SELECT level FROM levels WHERE bind > level ORDER BY bind LIMIT 1) * weight, cap)) AS target
  FROM levels),
queued AS (
  SELECT doc_id, source, size,
         coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized)
SELECT q.doc_id, q.size, t.source_size, round(t.target, 6) AS target,
       (greatest(0, least(size, floor(target)::BIGINT - before))
      + greatest(0, least(size, floor(target)::BIGINT - before - source_size))
      + greatest(0, least(size, floor(target)::BIGINT - before - 2 * source_size)))::BIGINT AS taken,
       CASE WHEN target > 0 THEN round((before + size) / target, 9) END AS finish
FROM queued q JOIN targets t ON q.source IS NOT DISTINCT FROM t.source
"""
