"""Vessels that come near each other, live: a join of two streams over an interval of time, and a state a vessel that follows.

Both sides have watermarks, so Spark lets go of rows that no later row can meet. Pairs go to a table of states, a version a
micro-batch: what touched vessels were before, and the worst and the number of pairs with what is new. A batch that is run again
writes its own version anew from the one before it, so states count no pair twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import blocks
from .replay import state_dir

#: Rows of a block of events of a cell and slot; rows of one that meet the other at once.
SIZE, STRIP = 4096, 256


def paired(left: DataFrame, right: DataFrame, cell: str, at: str, minutes: int, late: str) -> DataFrame:
    """(a, b): structs of rows of one ``cell`` whose times are within ``minutes``; the key ``vessel`` of a is the smaller.

    Time is part of the key: a row of b is held in its own slot of ``minutes``, one of a meets its slot and the two beside it, so
    that a row meets what is near in time and not all that the state has of its cell.
    """
    slot = F.floor(F.unix_micros(F.col(at)) / F.lit(minutes * 60_000_000)).cast("long")
    name = lambda df, side, slots: df.withWatermark(at, late).select(F.struct(*df.columns).alias(side), F.col(cell).alias(f"_{side}_cell"), F.col(at).alias(f"_{side}_at"), slots.alias(f"_{side}_slot"))
    gap = F.expr(f"INTERVAL {minutes} MINUTES")
    near = (F.col("_a_cell") == F.col("_b_cell")) & (F.col("_a_slot") == F.col("_b_slot")) & (F.col("_b_at") >= F.col("_a_at") - gap) & (F.col("_b_at") <= F.col("_a_at") + gap) & (F.col("a.vessel") < F.col("b.vessel"))
    around = F.explode(F.array(slot - 1, slot, slot + 1))
    return name(left, "a", around).join(name(right, "b", slot), near).select("a", "b")


def severities(pairs: DataFrame, severity: Column) -> DataFrame:
    """(vessel, sev) of both vessels of each pair in conflict."""
    return pairs.select(F.explode(F.array("a.vessel", "b.vessel")).alias("vessel"), severity.alias("sev")).filter("sev > 0")


def merged(before: DataFrame | None, found: DataFrame) -> DataFrame:
    """(vessel, worst, n): states with further severities."""
    new = found.select("vessel", F.col("sev").alias("worst"), F.lit(1).cast("long").alias("n"))
    rows = new if before is None else before.select("vessel", "worst", "n").unionByName(new)
    return rows.groupBy("vessel").agg(F.max("worst").alias("worst"), F.sum("n").alias("n"))


def kept_states(found: DataFrame) -> DataFrame:
    """Runs a stream of severities over what is there now; all versions of the states, with their micro-batch in ``batch``."""
    spark = found.sparkSession
    place = state_dir(spark, "conflicts")
    schema = "vessel long, worst int, n long, batch long"

    def follow(rows: DataFrame, number: int) -> None:
        before = None
        if number:
            known = spark.read.schema(schema).parquet(f"{place}/states").filter(F.col("batch") < number)
            last = known.agg(F.max("batch")).first()[0]
            before = known.filter(F.col("batch") == last) if last is not None else None
        merged(before, rows).write.mode("overwrite").parquet(f"{place}/states/batch={number}")

    q = found.writeStream.foreachBatch(follow).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(f"{place}/states")


def counted(events: DataFrame, minutes: int, near: float, close: float) -> DataFrame:
    """(vessel, worst, n) of what is new among events(vessel, ts, value, cell, fresh): of all pairs of events of one cell and two
    vessels that are within ``minutes`` and ``near`` of each other and of which one is fresh, how many a vessel has, and 2 where one
    is within ``close``, else 1.

    Events meet in blocks of a cell and slot of time; a task counts, and makes no row a pair.
    """
    span = minutes * 60_000_000
    at = events.dropna().select("vessel", "value", "cell", "fresh", F.unix_micros("ts").alias("at"))
    slot = F.floor(F.col("at") / F.lit(span)).cast("long")
    around = at.withColumn("slot", F.explode(F.array(slot - 1, slot, slot + 1)))

    def tell(a: dict, b: dict) -> dict:
        n, worst = np.zeros(len(a["at"]), np.int64), np.zeros(len(a["at"]), np.int32)
        for i in range(0, len(n), STRIP):
            own = {k: v[i : i + STRIP, None] for k, v in a.items()}
            gap = np.abs(own["value"] - b["value"])
            on = (gap <= near) & (np.abs(own["at"] - b["at"]) <= span) & (own["vessel"] != b["vessel"]) & (own["fresh"] | b["fresh"])
            n[i : i + STRIP], worst[i : i + STRIP] = on.sum(axis=1), 1 + (on & (gap <= close)).any(axis=1)
        met = n > 0
        return {"vessel": a["vessel"][met], "worst": worst[met], "n": n[met]}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = lambda rows: {f.name: col.to_numpy(zero_copy_only=False) for f, col in zip(rows.type, rows.flatten(), strict=True)}
        for batch in batches:
            told = [tell(arrays(left.values), arrays(right.values)) for left, right in zip(batch.column("_l"), batch.column("_r"), strict=True)]
            if told:
                yield pa.RecordBatch.from_pydict({k: np.concatenate([t[k] for t in told]) for k in told[0]})

    met = blocks.dealt(at.withColumn("slot", slot), around, ["cell", "slot"], SIZE).select("_l", "_r").mapInArrow(work, "vessel long, worst int, n long")
    return met.groupBy("vessel").agg(F.max("worst").alias("worst"), F.sum("n").alias("n"))


def counted_states(stream: DataFrame, minutes: int, near: float, close: float, late: int) -> DataFrame:
    """Runs a stream of events(vessel, ts, value, cell) over what is there now; all versions of the states of ``counted``, with their
    micro-batch in ``batch``. Events are held for as long as one that is ``late`` minutes behind the newest can meet them; later
    ones are dropped. A batch that is run again writes its own versions anew from those before it."""
    spark = stream.sparkSession
    place = state_dir(spark, "conflicts")
    states, held = "vessel long, worst int, n long, batch long", f"{stream.schema.simpleString()[7:-1].replace(':', ' ').replace(',', ', ')}, batch long"

    def last(name: str, schema: str, number: int) -> DataFrame | None:
        known = spark.read.schema(schema).parquet(f"{place}/{name}").filter(F.col("batch") < number) if number else None
        at = known.agg(F.max("batch")).first()[0] if number else None
        return None if at is None else known.filter(F.col("batch") == at).drop("batch")

    def follow(rows: DataFrame, number: int) -> None:
        kept, new = last("held", held, number), rows.withColumn("fresh", F.lit(True))
        behind = lambda df, m: df.filter(F.col("ts") >= F.lit(df.agg(F.max("ts")).first()[0]) - F.expr(f"INTERVAL {m} MINUTES"))
        if kept is not None:
            mark = kept.agg(F.max("ts")).first()[0]
            new = new.filter(F.col("ts") >= F.lit(mark) - F.expr(f"INTERVAL {late} MINUTES")).unionByName(kept.withColumn("fresh", F.lit(False)))
        behind(new.drop("fresh"), late + minutes).write.mode("overwrite").parquet(f"{place}/held/batch={number}")
        found, before = counted(new, minutes, near, close), last("states", states, number)
        every = found if before is None else before.unionByName(found)
        every.groupBy("vessel").agg(F.max("worst").alias("worst"), F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{place}/states/batch={number}")

    q = stream.writeStream.foreachBatch(follow).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(states).parquet(f"{place}/states")
