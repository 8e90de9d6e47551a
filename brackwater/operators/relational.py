"""Relational shapes that recur: ordered aggregates, picks by policy, pre-aggregated joins, overlays, closures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered_text(value: Column, order: Column, sep: str = ",") -> Column:
    """Values of a group joined in the order of ``order``."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"].cast("string")), sep)


def first_of_group(value: Column, *order: Column) -> Column:
    """Value of the row that comes first by ``order``: no sort, combined before the shuffle."""
    return F.min_by(value, F.struct(*order))


def pick_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group by ``order``, which must end in a unique column. Plans as a group limit before the shuffle."""
    place = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(place)).filter("_place = 1").drop("_place")


def status_rank(status: Column, statuses: list[str]) -> Column:
    """Place of ``status`` in a preference list; unlisted ones come last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(s) for s in statuses]), status), F.lit(0)), F.lit(len(statuses) + 1))


def overlay(base: DataFrame, extra: DataFrame, keys: list[str]) -> DataFrame:
    """``extra`` replaces rows of ``base`` with equal keys and adds the others."""
    return base.join(extra.select(*keys), keys, "left_anti").unionByName(extra.select(*base.columns))


def upsert(base: DataFrame, new: DataFrame, keys: list[str], may_update: Column | None = None) -> DataFrame:
    """Full-outer merge: new rows are inserted, present ones take the new values where ``may_update`` (over ``b``) allows."""
    rest = [c for c in base.columns if c not in keys]
    b, n = base.alias("b"), new.alias("n")
    same = F.col(f"b.{keys[0]}") == F.col(f"n.{keys[0]}")
    for k in keys[1:]:
        same = same & (F.col(f"b.{k}") == F.col(f"n.{k}"))
    take = F.col(f"b.{keys[0]}").isNull() | (F.col(f"n.{keys[0]}").isNotNull() & (may_update if may_update is not None else F.lit(True)))
    out = [F.coalesce(f"b.{k}", f"n.{k}").alias(k) for k in keys]
    out += [F.when(take, F.col(f"n.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in rest]
    kind = F.when(F.col(f"b.{keys[0]}").isNull(), "inserted").when(F.col(f"n.{keys[0]}").isNull(), "kept").when(take, "updated").otherwise("refused")
    return b.join(n, same, "full_outer").select(*out, kind.alias("change"))


def duplicate_keys(df: DataFrame, keys: list[str], line: str) -> DataFrame:
    """Keys that occur more than once, with how often and on which lines."""
    twice = df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")  # counted first: unique keys gather nothing
    return df.join(twice.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.count("*").alias("n"), ordered_text(F.col(line), F.col(line)).alias("lines"))


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Set difference both ways, with the side on which a row is missing."""
    only_left = left.subtract(right).withColumn("missing_in", F.lit("right"))
    only_right = right.subtract(left).withColumn("missing_in", F.lit("left"))
    return only_left.unionByName(only_right)


def not_in(df: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """``key NOT IN (SELECT other_key FROM other)``: no rows if ``other`` holds a null, none with a null key unless ``other`` is empty.

    Two counts of ``other`` decide; the rest is a plain anti-join, which a null-aware one of this size could not be.
    """
    n, nulls = other.agg(F.count("*"), F.count_if(F.col(other_key).isNull())).first()
    if not n:
        return df
    if nulls:
        return df.filter(F.lit(False))
    return df.filter(F.col(key).isNotNull()).join(other.select(F.col(other_key).alias("_other")), F.col(key) == F.col("_other"), "left_anti")
