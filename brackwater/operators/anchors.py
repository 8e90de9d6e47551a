"""Anchored vessels in conflict: positions in cubes of the globe, pairs in blocks, and what a block says of its vessels.

A block of vessels meets another as two small arrays; a task makes no row a pair, but one a vessel and block (or one a pair in
conflict, where pairs are asked for).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from . import blocks

C = F.col


def distance(lat1, lon1, lat2, lon2):
    """``geo.haversine`` of arrays."""
    a = np.sin(np.radians(lat2 - lat1) / 2) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * geo.EARTH_M * np.arcsin(np.sqrt(np.minimum(1.0, a)))


def severity(d, ra, rb, boat_a, boat_b):
    """0 green, 1 amber (the larger circle reaches the other anchor), 2 red (it passes the near edge of the smaller one)."""
    larger, smaller = np.maximum(ra, rb), np.minimum(ra, rb)
    return np.where(larger >= d + smaller - np.where(ra <= rb, boat_a, boat_b), 2, np.where(d <= larger, 1, 0)).astype(np.int32)


def conflicting(a: dict, b: dict) -> tuple:
    """(i, j, sev): places of the pairs of two blocks that are in conflict. A pair whose straight line is clearly out of reach has
    no conflict, as an arc is no shorter; the distance of the others is computed."""
    wide = lambda n: (a[n][:, None], b[n][None, :])
    (ra, rb), (boat_a, boat_b) = wide("radius"), wide("boat")
    larger = np.maximum(ra, rb)
    reach = np.maximum(larger, larger - np.minimum(ra, rb) + np.where(ra <= rb, boat_a, boat_b)) + 0.01
    square = sum((p - q) ** 2 for p, q in map(wide, "xyz"))
    i, j = np.nonzero((square <= reach * reach) & (reach > 0) & (a["k"][:, None] != b["k"][None, :]))
    sev = severity(distance(a["lat"][i], a["lon"][i], b["lat"][j], b["lon"][j]), a["radius"][i], b["radius"][j], a["boat"][i], b["boat"][j])
    on = sev > 0
    return i[on], j[on], sev[on]


def met(v: DataFrame, asking: DataFrame, tell: Callable[[dict, dict], dict], schema: str) -> DataFrame:
    """What ``tell(a, b)`` says of each two blocks, a of ``asking``, b of all vessels(k, lat, lon, radius, boat, ...) near them.

    Circles matter up to the largest radius and boat. Positions are points of the globe in cubes of that edge, so that no
    latitude, pole or date line makes cells too narrow; a vessel meets those of its own cube and the 26 around it.
    """
    reach = v.agg((F.max("radius") + F.max("boat")).alias("r")).first()["r"] or 1.0
    lat, lon = F.radians("lat"), F.radians("lon")
    points = {"x": geo.EARTH_M * F.cos(lat) * F.cos(lon), "y": geo.EARTH_M * F.cos(lat) * F.sin(lon), "z": geo.EARTH_M * F.sin(lat)}
    axes = [f"c{n}" for n in points]
    placed = lambda rows: rows.withColumns(points).withColumns({f"c{n}": F.floor(C(n) / reach) for n in points}).dropna()
    at, near = placed(asking), placed(v)
    for n in axes:
        near = near.withColumn(n, F.explode(F.array(*[C(n) + i for i in (-1, 0, 1)])))
    near = near.join(at.select(*axes).distinct(), axes, "left_semi")

    def arrays(rows: pa.StructArray) -> dict:
        return {f.name: np.array(col.to_pylist()) if pa.types.is_list(f.type) else col.to_numpy(zero_copy_only=False) for f, col in zip(rows.type, rows.flatten(), strict=True)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column("_l"), batch.column("_r"), strict=True):
                yield pa.RecordBatch.from_pydict(tell(arrays(left.values), arrays(right.values)))

    return blocks.dealt(at, near, axes).select("_l", "_r").mapInArrow(work, schema)


def pairs(v: DataFrame) -> DataFrame:
    """(a, b, sev) of all pairs in conflict, both ways round."""

    def tell(a: dict, b: dict) -> dict:
        i, j, sev = conflicting(a, b)
        return {"a": a["k"][i], "b": b["k"][j], "sev": sev}

    return met(v, v, tell, "a long, b long, sev int")


def states(v: DataFrame) -> DataFrame:
    """(k, worst, conflicts) of the vessels in conflict."""

    def tell(a: dict, b: dict) -> dict:
        i, _, sev = conflicting(a, b)
        n, red = np.bincount(i, minlength=len(a["k"])), np.bincount(i[sev == 2], minlength=len(a["k"]))
        on = n > 0
        return {"k": a["k"][on], "worst": np.where(red[on] > 0, 2, 1).astype(np.int32), "n": n[on].astype(np.int64)}

    return met(v, v, tell, "k long, worst int, n long").groupBy("k").agg(F.max("worst").alias("worst"), F.sum("n").alias("conflicts"))


def brought_together(v: DataFrame, asking: DataFrame) -> DataFrame:
    """(k, met): whether a vessel of ``asking`` is, at one of the positions ``lats``, ``lons`` of its boat, in conflict with the boat of
    another at the same place in that one's lists, of those that it conflicts with at anchor."""

    def tell(a: dict, b: dict) -> dict:
        i, j, _ = conflicting(a, b)
        out = np.zeros(len(a["k"]), bool)
        for at in range(a["lats"].shape[1] if len(i) else 0):
            i, j = i[~out[i]], j[~out[i]]
            d = distance(a["lats"][i, at], a["lons"][i, at], b["lats"][j, at], b["lons"][j, at])
            out[i[severity(d, a["radius"][i], b["radius"][j], a["boat"][i], b["boat"][j]) > 0]] = True
        return {"k": a["k"], "met": out}

    return met(v, asking, tell, "k long, met boolean").groupBy("k").agg(F.bool_or("met").alias("met"))
