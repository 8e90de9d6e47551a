"""Repairs of whole profiles: ordered rules, applied until none finds anything, with a log and with paths that follow.

A profile is rows of one long table, an element of a list each (profile, list, idx, text, section, supports, derived_from,
needed_for, source, optional); evidence is a list like the others, and a role is a row of the list ``data_roles`` as long as it
holds. ``supports``, ``derived_from`` and ``needed_for`` are paths such as ``requires_devices[2].text``.

A rule names elements to drop and elements to add. After each, lists are numbered anew and every path is led to where its element
has gone; a path whose element was dropped is cleared, and evidence that supported it goes too, as does what was derived from
it. Passes over the rules end when one changes nothing, so that repaired profiles are left alone.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .validate import COMMANDS

C = F.col
COLUMNS = ("profile", "list", "idx", "text", "section", "supports", "derived_from", "needed_for", "source", "optional")
PATHS = ("supports", "derived_from", "needed_for")
KEY = ("profile", "list", "idx")
INDEXED = r"^([a-z_]+)\[(\d+)\](.*)$"
CONTROLLABLE = "data_roles[0]"
#: What tells of a fused supply, and the words for one that evidence does not name; fixed values.
FUSED = r"(?i)\bmust\s+be\s+fused\b|\bfuse\w*\b.{0,40}\b(?:battery|cable|dc)\b|\b(?:battery|cable|dc)\b.{0,40}\bfuse\w*\b"
FUSE = "Battery/DC cable must be fused"
Rule = Callable[[DataFrame], tuple[DataFrame | None, DataFrame | None]]


def element(list_: Column, idx: Column) -> Column:
    return F.concat(list_, F.lit("["), idx.cast("string"), F.lit("]"))


def polarity(rows: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """Evidence that this device commands others does not show that it can be commanded; without other evidence the role goes."""
    support = rows.filter((C("list") == "evidence") & (C("supports") == CONTROLLABLE)).withColumn("inverted", F.coalesce(F.concat_ws(" ", "text", "section").rlike(COMMANDS), F.lit(False)))
    turned = support.filter("inverted").select(*KEY)
    lost = support.groupBy("profile").agg(F.bool_and("inverted").alias("all")).filter("all").select("profile", F.lit("data_roles").alias("list"), F.lit(0).alias("idx"))
    return turned.unionByName(lost).withColumn("repair", F.lit("polarity")), None


def repeated(rows: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """Requirements said before in the same words for the same use go."""
    of = rows.filter("list = 'requires_devices'").withColumn("first", F.min("idx").over(Window.partitionBy("profile", F.lower(F.trim("text")), "needed_for")))
    return of.filter("idx > first").select(*KEY, F.lit("repeated").alias("repair")), None


def surface_requires(rows: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """An optional surface is a device that is required for it: added where neither its path nor its name is among the requirements."""
    surfaces = rows.filter("list = 'control_surfaces' AND optional").select("profile", "text", element(C("list"), C("idx")).alias("path"), "idx")
    needed = rows.filter("list = 'requires_devices'").select("profile", C("text").alias("said"), C("needed_for").alias("use"))
    label = F.lower(F.trim(F.coalesce("text", F.lit(""))))
    there = (surfaces["profile"] == needed["profile"]) & ((needed["use"] == surfaces["path"]) | ((label != "") & F.contains(F.lower(needed["said"]), label)))
    new = surfaces.join(needed, there, "left_anti")
    return None, new.select("profile", F.lit("requires_devices").alias("list"), C("idx").alias("after"), F.coalesce(F.nullif(F.trim("text"), F.lit("")), F.lit("optional accessory")).alias("text"), C("path").alias("derived_from"), C("path").alias("needed_for"), F.lit("surface_requires").alias("repair"))


def fuse(rows: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """Evidence of a fused supply is a supply requirement, where none and no protection speaks of a fuse."""
    has = rows.filter("list IN ('supply_requirements', 'protected_by') AND lower(text) LIKE '%fuse%'").select("profile").distinct()
    cited = rows.filter((C("list") == "evidence") & F.concat_ws(" ", "supports", "section", "text").rlike(FUSED)).join(has, "profile", "left_anti")
    first = cited.groupBy("profile").agg(F.min(F.struct("idx", "text")).alias("e"))
    text = F.when(F.lower("e.text").contains("fuse"), F.trim("e.text")).otherwise(FUSE)
    return None, first.select("profile", F.lit("supply_requirements").alias("list"), F.lit(0).alias("after"), text.alias("text"), element(F.lit("evidence"), C("e.idx")).alias("derived_from"), F.lit(None).cast("string").alias("needed_for"), F.lit("fuse").alias("repair"))


RULES: tuple[Rule, ...] = (polarity, repeated, surface_requires, fuse)


def moved(rows: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` without ``gone`` (profile, list, idx), numbered anew and with paths that follow; and what their going orphaned."""
    stay = rows.join(gone.select(*KEY).distinct(), list(KEY), "left_anti")
    place = Window.partitionBy("profile", "list").orderBy("idx")
    stay = written(stay.withColumn("new", F.when(C("list") == "data_roles", C("idx")).otherwise(F.row_number().over(place) - 1)), "repair-stay")
    to = stay.select("profile", C("list").alias("_l"), C("idx").alias("_i"), C("new").alias("_n"))
    known = rows.select("profile", C("list").alias("_l"), C("idx").alias("_i")).join(to, ["profile", "_l", "_i"], "left")
    known = written(known, "repair-places")
    lost = F.lit(False)
    for name in PATHS:
        whole = F.coalesce(C(name), F.lit(""))
        stay = stay.withColumn("_l", F.regexp_extract(whole, INDEXED, 1)).withColumn("_i", F.regexp_extract(whole, INDEXED, 2).try_cast("int")).join(known.withColumn("_known", F.lit(True)), ["profile", "_l", "_i"], "left")
        # A path to an element that was never there is left for the checks to tell.
        there = C("_known").isNotNull()
        follows = F.when(there & C("_n").isNotNull(), F.concat("_l", F.lit("["), C("_n").cast("string"), F.lit("]"), F.regexp_extract(whole, INDEXED, 3))).when(~there, C(name))
        stay = stay.withColumn(f"_{name}_lost", there & C("_n").isNull()).withColumn(name, follows).drop("_l", "_i", "_n", "_known")
    lost = (C("_supports_lost") & (C("list") == "evidence")) | (C("_derived_from_lost") & (C("source") == "derived"))
    stay = written(stay.withColumn("idx", C("new").cast("int")).withColumn("_lost", lost), "repair-moved")
    return stay.select(*COLUMNS), stay.filter("_lost").select(*KEY, F.lit("orphaned").alias("repair"))


def repaired(rows: DataFrame, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """The repaired rows, and the log (profile, pass, step, repair, list, text): what each rule dropped or added."""
    rows, log, number = written(rows.select(*COLUMNS), "profiles"), [], 0
    while True:
        number += 1
        before = len(log)
        for step, rule in enumerate(rules):
            drops, adds = rule(rows)
            note = lambda df, s=step: df.select("profile", F.lit(number).alias("pass"), F.lit(s).alias("step"), "repair", "list", "text")
            while drops is not None:
                drops = written(drops.join(rows.select(*KEY, "text"), list(KEY)).dropDuplicates(list(KEY)), "repair-drops")
                if drops.isEmpty():
                    break
                log.append(note(drops))
                rows, drops = moved(rows, drops)
            if adds is not None:
                adds = written(adds, "repair-adds")
                if not adds.isEmpty():
                    log.append(note(adds))
                    ends = rows.groupBy("profile", "list").agg((F.max("idx") + 1).alias("_end"))
                    place = F.coalesce("_end", F.lit(0)) + F.row_number().over(Window.partitionBy("profile", "list").orderBy("after")) - 1
                    none = F.lit(None).cast("string")
                    new = adds.join(ends, ["profile", "list"], "left").select("profile", "list", place.cast("int").alias("idx"), "text", none.alias("section"), none.alias("supports"), "derived_from", "needed_for", F.lit("derived").alias("source"), F.lit(None).cast("boolean").alias("optional"))
                    rows = written(rows.unionByName(new), "repair-rows")
        if len(log) == before:
            break
    spark = rows.sparkSession
    empty = spark.createDataFrame([], "profile long, pass int, step int, repair string, list string, text string")
    return rows, reduce(DataFrame.unionByName, log, empty)


def ungrounded(rows: DataFrame) -> DataFrame:
    """(profile, list, idx, flag): derived elements without a path to what they are derived from, or with one that leads nowhere."""
    of = rows.filter("source = 'derived'").withColumn("_l", F.regexp_extract(F.coalesce("derived_from", F.lit("")), INDEXED, 1)).withColumn("_i", F.regexp_extract(F.coalesce("derived_from", F.lit("")), INDEXED, 2).try_cast("int"))
    there = rows.select("profile", C("list").alias("_l"), C("idx").alias("_i"))
    return of.join(there, ["profile", "_l", "_i"], "left_anti").select(*KEY, F.lit("derived_ungrounded").alias("flag"))
