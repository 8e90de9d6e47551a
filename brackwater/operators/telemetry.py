"""Telemetry in batch: rolling means, buckets, latest state, bands, interpolation, anchor geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rolling_mean(value: Column, key: str, at: str, minutes: int) -> Column:
    """Mean of the last ``minutes`` up to now, both edges in."""
    seconds = F.unix_micros(F.col(at).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(seconds).rangeBetween(-minutes * 60_000_000, 0)
    return F.avg(value).over(w)


def buckets(df: DataFrame, at: str, width: str, *aggs: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """Aggregates by epoch-aligned buckets; empty buckets are left out."""
    start = F.window(F.col(at).cast("timestamp"), width)["start"].cast("timestamp_ntz")
    return df.withColumn("bucket", start).groupBy(*keys, "bucket").agg(*aggs)


def latest_state(df: DataFrame, key: str, order: list[str], path: str, value: str, paths: list[str]) -> DataFrame:
    """A column for each path with its last value so far: the state a keyed accumulator would hold after each row."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({p: F.last(F.when(F.col(path) == p, F.col(value)), ignorenulls=True).over(w) for p in paths})


def band_of(value: Column, cuts: list[float]) -> Column:
    """Index of the band [cut, next) that holds ``value``; the last is closed, values beyond the ends take the end bands."""
    n = len(cuts) - 1
    inside = sum((F.when(value >= c, 1).otherwise(0) for c in cuts[1:-1]), F.lit(0))
    return F.when(value.isNull(), None).otherwise(F.least(F.lit(n - 1), inside)).cast("int")


def bilinear(x: Column, y: Column, xs: list[float], ys: list[float], grid: list[list[float]]) -> Column:
    """Value of ``grid`` (a row for each x) at (x, y), clamped to its edges. The grid is a literal of fixed size."""

    def place(v: Column, axis: list[float]) -> tuple[Column, Column]:
        v = F.greatest(F.lit(axis[0]), F.least(F.lit(axis[-1]), v))
        low = sum((F.when(v >= a, 1).otherwise(0) for a in axis[1:-1]), F.lit(0))
        at = F.array(*[F.lit(a) for a in axis])
        left, right = F.get(at, low), F.get(at, low + 1)
        return low, (v - left) / (right - left)

    (i, fx), (j, fy) = place(x, xs), place(y, ys)
    table = F.array(*[F.lit(v) for row in grid for v in row])
    at = lambda a, b: F.get(table, a * len(ys) + b)
    low = at(i, j) + (at(i, j + 1) - at(i, j)) * fy
    high = at(i + 1, j) + (at(i + 1, j + 1) - at(i + 1, j)) * fy
    return low + (high - low) * fx


def least_squares_point(df: DataFrame, key: str, lat: Column, lon: Column, heading: Column) -> DataFrame:
    """The point nearest to all heading lines of a key, from sums alone: (key, n, x, y), null where lines are parallel.

    A line through (x, y) along unit (dx, dy) has normal (-dy, dx); the normal equations are sums of products, so partial
    aggregates meet on the reducers and no group is ever gathered.
    """
    nx, ny = -F.sin(F.radians(heading)), F.cos(F.radians(heading))
    c = nx * lat + ny * lon
    s = df.groupBy(key).agg(F.count("*").alias("n"), F.sum(nx * nx).alias("a"), F.sum(nx * ny).alias("b"), F.sum(ny * ny).alias("d"), F.sum(nx * c).alias("p"), F.sum(ny * c).alias("q"))
    det = F.col("a") * F.col("d") - F.col("b") * F.col("b")
    ok = (F.col("n") >= 2) & (F.abs(det) >= 1e-12)
    return s.select(key, "n", F.when(ok, (F.col("p") * F.col("d") - F.col("q") * F.col("b")) / det).alias("x"), F.when(ok, (F.col("a") * F.col("q") - F.col("b") * F.col("p")) / det).alias("y"))


def smallest_arc(df: DataFrame, key: str, bearing: Column) -> DataFrame:
    """(key, start, span): the smallest clockwise arc with all bearings, the rest of the widest gap; one bearing: 25 degrees each way."""
    b = df.select(key, F.pmod(F.round(bearing), F.lit(360)).cast("long").alias("b")).distinct()
    w = Window.partitionBy(key).orderBy("b")
    ends = Window.partitionBy(key)
    after = F.coalesce(F.lead("b").over(w), F.min("b").over(ends) + 360)
    gaps = b.select(key, (after - F.col("b")).alias("gap"), F.pmod(after, F.lit(360)).alias("next"))
    widest = gaps.groupBy(key).agg(F.max_by(F.struct("gap", "next"), F.struct("gap", -F.col("next"))).alias("g"))
    single = F.col("g.gap") == 360
    return widest.select(key, F.when(single, F.pmod(F.col("g.next") - 25, F.lit(360))).otherwise(F.col("g.next")).alias("start"), F.when(single, 50).otherwise(360 - F.col("g.gap")).cast("long").alias("span"))


def near_pairs(df: DataFrame, key: str, x: str, y: str, radius: float) -> DataFrame:
    """Pairs of keys within ``radius`` (plane units): joined on grid cells of that size, so far pairs are never made."""
    cell = lambda c: F.floor(F.col(c) / F.lit(radius))
    at = df.select(F.col(key).alias("k"), F.col(x).alias("x"), F.col(y).alias("y"), cell(x).alias("cx"), cell(y).alias("cy"))
    around = at.withColumn("dx", F.explode(F.array(*[F.lit(v) for v in (-1, 0, 1)]))).withColumn("dy", F.explode(F.array(*[F.lit(v) for v in (-1, 0, 1)])))
    around = around.select("k", "x", "y", (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"))
    a, b = at.alias("a"), around.alias("b")
    dist = F.sqrt(F.pow(F.col("a.x") - F.col("b.x"), F.lit(2)) + F.pow(F.col("a.y") - F.col("b.y"), F.lit(2)))
    pairs = a.join(b, (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy")) & (F.col("a.k") < F.col("b.k")))
    return pairs.select(F.col("a.k").alias("a"), F.col("b.k").alias("b"), dist.alias("distance")).filter(F.col("distance") <= radius)
