"""Matrices over cut axes: cuts, bands, resampling, and advice by band with neighbours near a seam."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_cuts(cuts: Column, low: float, high: float, fallback: list[float], most: int = 48) -> Column:
    """The first ``most`` cuts clamped, without repeats or what is no number, sorted; ``fallback`` if fewer than two are left."""
    numbers = F.filter(F.slice(cuts, 1, most), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    clamped = F.array_sort(F.array_distinct(F.transform(numbers, lambda x: F.least(F.lit(high), F.greatest(F.lit(low), x)))))
    return F.when(F.size(clamped) >= 2, clamped).otherwise(F.array(*[F.lit(x) for x in fallback]))


def bands(cuts: Column) -> Column:
    """Array of (low, high) between neighbouring sorted cuts; empty ones are left out."""
    ordered = F.array_sort(cuts)
    pairs = F.zip_with(F.slice(ordered, 1, F.greatest(F.size(ordered) - 1, F.lit(0))), F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("low"), b.alias("high")))
    return F.filter(pairs, lambda p: p["high"] > p["low"])


def band_index(of: Column, value: Column) -> Column:
    """Place of the band that holds ``value``: half-open, the last closed; beyond the ends the first or last; -1 without bands."""
    below = F.size(F.filter(of, lambda p: p["high"] <= value))
    return F.when(F.size(of) == 0, -1).otherwise(F.least(below, F.size(of) - 1))


def resampled(old: Column, new: Column) -> Column:
    """For each band of ``new`` the place of the band of ``old`` that holds its middle."""
    return F.transform(new, lambda p: band_index(old, (p["low"] + p["high"]) / 2))


def edge(value: Column, of: Column, at: Column) -> tuple[Column, Column]:
    """Distance of ``value`` to the lower and upper border of its band; infinite at the ends of the axis."""
    far = F.lit(float("inf"))
    band = F.get(of, at)
    return F.when(at > 0, F.abs(value - band["low"])).otherwise(far), F.when(at < F.size(of) - 1, F.abs(value - band["high"])).otherwise(far)


def unique_texts(texts: Column, without: Column) -> Column:
    """Texts trimmed, without blanks, without ``without`` and without repeats, whatever the case; the first spelling stays."""
    clean = F.filter(F.transform(texts, lambda t: F.trim(F.coalesce(t, F.lit("")))), lambda t: (t != "") & (F.lower(t) != F.lower(F.trim(without))))
    keys = F.transform(clean, lambda t: F.lower(t))
    return F.filter(clean, lambda t, i: F.array_position(keys, F.lower(t)) == i + 1)
