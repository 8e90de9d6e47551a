"""Semi-structured profiles: map outputs are reduced and voted on, validators give flag rows, requirements are resolved.

A profile is a row with nested arrays. Rules are one filtered projection each, joined by union, so a new rule is a new
line and none of them reads more than its columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def flags(profiles: DataFrame, key: str, rules: list[tuple[str, str, Column, Column]]) -> DataFrame:
    """(key, flag, severity, path) for rules (flag, severity, condition, path); each once."""
    found = [F.when(cond, F.struct(F.lit(flag).alias("flag"), F.lit(severity).alias("severity"), path.alias("path"))) for flag, severity, cond, path in rules]
    # All rules in one scan: an array of the flags that fired, exploded.
    return profiles.select(key, F.explode(F.array_compact(F.array(*found))).alias("f")).select(key, "f.*").distinct()


def gate(profiles: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, blocking, passes) of every profile: it passes if no blocking flag fired, flagged or not."""
    n = found.filter(F.col("severity") == "blocking").groupBy(key).agg(F.count("*").alias("blocking"))
    both = profiles.select(key).join(n, key, "left").select(key, F.coalesce("blocking", F.lit(0)).alias("blocking"))
    return both.withColumn("passes", F.col("blocking") == 0)


def reduce_groups(items: DataFrame, key: str) -> DataFrame:
    """Group outputs of an entity to one row: flags by OR, the longest version (the later among equals), the highest
    confidence, notes in order of group. items(key, group_no, flag, version, confidence, note)."""
    notes = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("note") != "", F.struct("group_no", "note")))), lambda x: x["note"]), " | ")
    return items.groupBy(key).agg(
        F.bool_or("flag").alias("flag"),
        F.max_by("version", F.struct(F.length("version"), "group_no")).alias("version"),
        F.max("confidence").alias("confidence"),
        notes.alias("notes"),
        F.count("*").alias("n_groups"),
    )


def vote(values: DataFrame, key: str) -> DataFrame:
    """(key, chosen, stable, margin) by majority over runs(key, run, value): the first seen among equals, but true before
    false; stable if it beats all others together."""
    n = values.groupBy(key, "value").agg(F.count("*").alias("n"), F.min("run").alias("first"))
    best = F.max_by("value", F.struct("n", (F.col("value") == "true").alias("t"), -F.col("first")))
    top, total = F.max("n"), F.sum("n")
    return n.groupBy(key).agg(best.alias("chosen"), ((F.count("*") == 1) | (2 * top > total)).alias("stable"), F.format_string("%d/%d", top, total).alias("margin"))


def partition_batches(excerpts: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """Adds ``group_no``: runs of ``size`` excerpts of an entity in order."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return excerpts.withColumn("group_no", F.floor((place - 1) / size).cast("int"))


def resolve_requirements(requirements: DataFrame, equipment: DataFrame, families: DataFrame) -> DataFrame:
    """(req_id, device, tier): the first device, in list order, of the best tier that matches.

    Tier 1: the model's name occurs in the text. Tier 2: the text names a family the device belongs to. Candidates come
    from joins on the text's words (a model's or family's first word), so only rows that share one meet.
    requirements(req_id, text), equipment(device, ordinal, model), families(family, device).
    """
    r = requirements.select("req_id", F.concat(F.lit(" "), F.lower("text"), F.lit(" ")).alias("t"))
    words = r.select("req_id", "t", F.explode(F.array_distinct(F.split(F.trim("t"), "[^a-z0-9#]+"))).alias("w"))
    first = lambda c: F.get(F.split(F.lower(c), "[^a-z0-9#]+"), F.lit(0))
    models = equipment.select("device", "ordinal", F.lower("model").alias("name"), first(F.col("model")).alias("w"), F.lit(1).alias("tier"))
    named = families.join(equipment.select("device", "ordinal"), "device").select("device", "ordinal", F.lower("family").alias("name"), first(F.col("family")).alias("w"), F.lit(2).alias("tier"))
    hits = words.join(models.unionByName(named), "w").filter(F.contains("t", "name"))
    best = hits.groupBy("req_id").agg(F.min(F.struct("tier", "ordinal", "device")).alias("b"))
    return best.select("req_id", "b.device", "b.tier")
