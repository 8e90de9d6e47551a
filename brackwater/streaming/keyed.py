"""Keyed state over streams: cooldown, latest values and deadband, with event-time watermarks that evict silent keys.

Each operator is a step over one key's rows of a micro-batch, in event-time order, and a state of a few fields. States are kept
by the bucket of keys (``buckets``); Spark keeps and checkpoints them, and a lost executor resumes from them. Rows later than
the watermark are dropped by Spark. With input in order the result is that of the batch twin, however the rows fall into micro-batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from . import buckets
from .replay import state_dir


def in_slices(df: DataFrame, at: str, slices: int) -> DataFrame:
    """A table as a stream of ``slices`` files in order of ``at``, one a micro-batch: a replay of what came in."""
    return replayed(df, sliced(df, at, slices))


def replayed(df: DataFrame, folder: str) -> DataFrame:
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def sliced(df: DataFrame, at: str, slices: int) -> str:
    """The folder of a table's slices."""
    spark = df.sparkSession
    folder = state_dir(spark, "replay")
    low, high = df.agg(F.min(at), F.max(at)).first()
    if low is None:
        df.write.parquet(folder)
    else:
        borders = [low + (high - low) * k / slices for k in range(1, slices)]
        for a, b in zip([None, *borders], [*borders, None], strict=True):
            part = df.filter((F.lit(True) if a is None else F.col(at) >= F.lit(a)) & (F.lit(True) if b is None else F.col(at) < F.lit(b)))
            part.coalesce(1).write.mode("append").parquet(folder)
    return folder


def finished(stream: DataFrame, name: str) -> DataFrame:
    spark: SparkSession = stream.sparkSession
    place = state_dir(spark, name)
    q = stream.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out")


#: How long a key may be silent before its state goes.
SILENT = 30 * 86_400


def kept(stream: DataFrame, group: str, at: str, columns: list[str], take: Callable, silent: float, late: str, schema: str, out: Callable) -> DataFrame:
    """``take(state, t, *row)`` (state None at first; t in microseconds) gives (state, value) for each row of a key in order of time;
    the last of a state is the time it is counted from, and it goes once the watermark is ``silent`` seconds past that.
    ``out(frame, keys, values)`` makes the resulting rows."""

    def step(bucket: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        keys, found, timed_out = buckets.unpacked(state.get[0]) if state.exists else {}, None, state.hasTimedOut
        if not timed_out:
            frame = pd.concat(list(frames))
            frame = frame[frame[at].notna()].sort_values(at, kind="stable")
            names, values = frame[buckets.KEY].tolist(), []
            for key, t, *row in zip(names, buckets.micros(frame[at]), *(frame[c].tolist() for c in columns), strict=True):
                keys[key], value = take(keys.get(key), t, *row)
                values.append(value)
            found = out(frame, names, values)
        mark = state.getCurrentWatermarkMs()
        keys = {k: s for k, s in keys.items() if s[-1] / 1000 + silent * 1000 > mark}
        if keys:
            state.update((buckets.packed(keys),))
            state.setTimeoutTimestamp(max(int(min(s[-1] for s in keys.values()) / 1000 + silent * 1000), mark + 1))
        elif state.exists:
            state.remove()
        if found is not None:
            yield found

    return buckets.dealt(stream.withWatermark(at, late), group).applyInPandasWithState(step, schema, "keys binary", "append", GroupStateTimeout.EventTimeTimeout)


def taken(columns: list[str]) -> Callable:
    """Rows of which the value is true."""
    return lambda frame, keys, values: frame.loc[pd.Series(values, index=frame.index, dtype=bool).to_numpy(), columns]


def cooldown(stream: DataFrame, group: str, at: str, seconds: float, late: str = "1 day") -> DataFrame:
    """Rows that fire, as in the batch twin; ``at`` is a timestamp. A key's state goes once the watermark passes its cooldown."""

    def fire(state, t):
        ok = state is None or t - state[0] >= seconds * 1e6
        return ((t,) if ok else state), ok

    return kept(stream, group, at, [], fire, seconds, late, stream.schema, taken(stream.columns))


def latest(stream: DataFrame, group: str, at: str, path: str, value: str, paths: list[str], late: str = "1 day", silent: float = SILENT) -> DataFrame:
    """A row (group, at, one column a path) whenever a row completes or changes a record of all ``paths``: values last seen.
    A key that has been silent for ``silent`` seconds begins anew."""
    places = {p: i for i, p in enumerate(paths)}

    def flush(state, t, p, v):
        *held, last = state or (*[None] * len(paths), None)
        if last is not None and t - last > silent * 1e6:
            held = [None] * len(paths)
        done = None
        if p in places and v is not None and v == v:
            held[places[p]] = float(v)
            done = tuple(held) if all(x is not None for x in held) else None
        return (*held, t), done

    def out(frame, keys, values):
        full = [i for i, v in enumerate(values) if v is not None]
        found = pd.DataFrame([values[i] for i in full], columns=paths, dtype=float)
        found.insert(0, at, frame[at].iloc[full].to_numpy())
        found.insert(0, buckets.KEY, [keys[i] for i in full])
        return found

    kinds = dict(stream.dtypes)
    fields = ", ".join(f"`{p}` double" for p in paths)
    rows = kept(stream, group, at, [path, value], flush, silent, late, f"{buckets.KEY} string, {at} {kinds[at]}, {fields}", out)
    return rows.select(F.col(buckets.KEY).cast(kinds[group]).alias(group), at, *[F.col(f"`{p}`") for p in paths])


def deadband(stream: DataFrame, group: str, at: str, value: str, least: float, late: str = "1 day", silent: float = SILENT) -> DataFrame:
    """Rows whose value is at least ``least`` from the last that was taken; the first of a key, or after ``silent`` seconds, is."""

    def take(state, t, v):
        before, last = state or (None, None)
        if last is not None and t - last > silent * 1e6:
            before = None
        ok = v is not None and v == v and (before is None or abs(v - before) >= least)
        return (float(v) if ok else before, t), ok

    return kept(stream, group, at, [value], take, silent, late, stream.schema, taken(stream.columns))
