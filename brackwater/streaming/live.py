"""Live state of vessels with timers: freshness of roles, retained samples, anchor watch and dwelling bands.

Each is a ``StatefulProcessor``: values in RocksDB, a bucket of keys each, event-time timers, and rows of a micro-batch taken in
event-time order. A timer lets go of what a key no longer needs, so that a silent key leaves the state: it is told as a row
where the result has one for it. With input in order of time, however it falls into micro-batches, results are those of the
batch twins (``silence`` starts a key anew in both).

Rows with a null time are left out. Rows of one time are taken in the order of ``tie``. What a task holds is one bucket's rows of a
micro-batch and its state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from . import buckets
from .replay import state_dir

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def stamp(at: int) -> pd.Timestamp:
    return pd.Timestamp(at, unit="us")


class Live(StatefulProcessor):
    """Takes a key's rows in order; subclasses say what a row and a timer do, with what ``finish`` keeps of a key and its due time.

    Every call of a state crosses to the JVM and costs more than many rows. Keys are therefore kept by the bucket: one value has
    what is kept of its keys, is got and put once a micro-batch, and has one timer, for the key that is due first.
    """

    def __init__(self, at: str, tie: str, columns: list[str]):
        self.at, self.tie, self.columns = at, tie, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.store = handle.getValueState("kept", "keys binary, due long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        by_key = buckets.by_key(rows, self.at, [self.tie, *self.columns])
        if by_key:
            self.load()
            out = []
            for name, held in by_key.items():
                held.sort(key=lambda r: (r[0], True, 0) if r[1] is None or r[1] != r[1] else (r[0], False, r[1]))
                self.begin(self.keys.get(name, (None,))[0])
                out += [(name, *x) for t, *row in held for x in self.row(t, *row)]
                self.end(name)
            self.save()
            if out:
                yield pd.DataFrame(out, columns=self.names)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.load()
        self.due = None  # Spark has let go of the timer
        out, watermark = [], timerValues.getCurrentWatermarkInMs()
        for name in [k for k, (_, due) in self.keys.items() if due <= watermark]:
            self.begin(self.keys[name][0])
            out += [(name, *x) for x in self.expired(watermark * 1000)]
            self.end(name)
        self.save()
        if out:
            yield pd.DataFrame(out, columns=self.names)

    def load(self) -> None:
        found = self.store.get()
        self.keys, self.due = (buckets.unpacked(found[0]), found[1]) if found is not None else ({}, None)

    def end(self, name: str | None) -> None:
        kept, at = self.finish()
        if kept is None:
            self.keys.pop(name, None)
        else:
            self.keys[name] = kept, -(-at // 1000) + 1

    def save(self) -> None:
        due = min((d for _, d in self.keys.values()), default=None)
        if due != self.due:
            if self.due is not None:
                self.handle.deleteTimer(self.due)
            if due is not None:
                self.handle.registerTimer(due)
        self.store.update((buckets.packed(self.keys), due)) if self.keys else self.store.clear()

    def close(self) -> None:
        pass


class Freshness(Live):
    """(key, role, at, fresh): a role turns fresh with its first value, and stale ``ttl`` after its last."""

    names = ("key", "role", "at", "fresh")

    def __init__(self, at: str, tie: str, role: str, ttl: float):
        super().__init__(at, tie, [role])
        self.ttl = int(ttl * 1e6)

    def begin(self, kept: dict | None) -> None:
        self.now = dict(kept or {})

    def row(self, t: int, tie, role: str) -> Iterator[tuple]:
        held = self.now.get(role)
        if held is not None and t > held:
            yield role, stamp(held), False
        if held is None or t > held:
            yield role, stamp(t), True
        self.now[role] = t + self.ttl

    def expired(self, watermark: int) -> Iterator[tuple]:
        for role, until in sorted(self.now.items(), key=lambda x: (x[0] is not None, x[0] or "")):
            if until < watermark:
                yield role, stamp(until), False
                del self.now[role]

    def finish(self) -> tuple[dict | None, int | None]:
        return (self.now, min(self.now.values())) if self.now else (None, None)


class Retained(Live):
    """(key, tie, n, mean, oldest): samples of the last ``keep`` seconds at each row; all go when the last of them is too old."""

    names = ("key", "tie", "n", "mean", "oldest")

    def __init__(self, at: str, tie: str, value: str, keep: float):
        super().__init__(at, tie, [value])
        self.keep = int(keep * 1e6)

    def begin(self, kept: list | None) -> None:
        self.held = list(kept or ())
        self.first = 0
        self.total = sum(v for _, v in self.held)

    def row(self, t: int, tie, value: float) -> Iterator[tuple]:
        if value is not None and value == value:
            self.held.append((t, float(value)))
            self.total += float(value)
        while self.first < len(self.held) and self.held[self.first][0] < t - self.keep:
            self.total -= self.held[self.first][1]
            self.first += 1
        n = len(self.held) - self.first
        yield tie, n, self.total / n if n else None, stamp(self.held[self.first][0]) if n else None

    def expired(self, watermark: int) -> Iterator[tuple]:
        self.held = [x for x in self.held if x[0] >= watermark - self.keep]
        self.first = 0
        return iter(())

    def finish(self) -> tuple[list | None, int | None]:
        self.held = self.held[self.first :]
        return (self.held, self.held[-1][0] + self.keep) if self.held else (None, None)


class Dwell(Live):
    """(key, tie, stable): the band in force, as ``greedy.stabilised`` has it; after ``silence`` seconds a key begins anew."""

    names = ("key", "tie", "stable")

    def __init__(self, at: str, tie: str, band: str, value: str, dwell: float, jump: float, silence: float):
        super().__init__(at, tie, [band, value])
        self.dwell, self.jump, self.silence = int(dwell * 1e6), jump, int(silence * 1e6)

    def begin(self, kept: tuple | None) -> None:
        self.state = kept or (None,) * 5

    def row(self, t: int, tie, band, value) -> Iterator[tuple]:
        current, before, waiting, since, last = self.state
        if last is not None and t - last > self.silence:
            current = before = waiting = since = None
        band = None if band is None or band != band else int(band)
        value = None if value is None or value != value else float(value)
        leap = before is not None and value is not None and abs(value - before) >= self.jump
        if current is None or band == current or leap or (band == waiting and since is not None and t - since >= self.dwell):
            current, waiting, since = band, None, None
        elif band != waiting:
            waiting, since = band, t
        self.state = current, before if value is None else value, waiting, since, t
        yield tie, current

    def expired(self, watermark: int) -> Iterator[tuple]:
        if self.state[4] is not None and self.state[4] + self.silence < watermark:
            self.state = (None,) * 5
        return iter(())

    def finish(self) -> tuple[tuple | None, int | None]:
        return (None, None) if self.state[4] is None else (self.state, self.state[4] + self.silence)


class AnchorWatch(Live):
    """(key, tie, n, x, y, watched): the point nearest to the heading lines of the slow fixes of the last ``keep`` seconds.

    With fewer than two fixes, or lines that are parallel, the point before is retained. A key that is silent for ``silence``
    seconds is let go: a row with null tie and ``watched`` false tells so, at the time of its last fix in ``at``.
    """

    names = ("key", "tie", "n", "x", "y", "watched", "at")

    def __init__(self, at: str, tie: str, lat: str, lon: str, heading: str, slow: str, keep: float, silence: float):
        super().__init__(at, tie, [lat, lon, heading, slow])
        self.keep, self.silence = int(keep * 1e6), int(silence * 1e6)

    def begin(self, kept: tuple | None) -> None:
        self.x, self.y, self.last, self.held = kept or (None, None, None, [])

    def row(self, t: int, tie, lat, lon, heading, slow) -> Iterator[tuple]:
        from math import cos, radians, sin

        if self.last is not None and t - self.last > self.silence:
            yield None, len(self.held), self.x, self.y, False, stamp(self.last)
            self.held, self.x, self.y = [], None, None
        self.last = t
        if slow:
            nx, ny = -sin(radians(heading)), cos(radians(heading))
            self.held.append((t, nx, ny, nx * lat + ny * lon))
        self.held = [f for f in self.held if f[0] >= t - self.keep]
        a, b, d = (sum(f[i] * f[j] for f in self.held) for i, j in ((1, 1), (1, 2), (2, 2)))
        p, q = (sum(f[i] * f[3] for f in self.held) for i in (1, 2))
        det = a * d - b * b
        if len(self.held) >= 2 and abs(det) >= 1e-3:
            self.x, self.y = (p * d - q * b) / det, (a * q - b * p) / det
        yield tie, len(self.held), self.x, self.y, True, stamp(t)

    def expired(self, watermark: int) -> Iterator[tuple]:
        if self.last is not None and self.last + self.silence < watermark:
            yield None, len(self.held), self.x, self.y, False, stamp(self.last)
            self.held, self.last = [], None

    def finish(self) -> tuple[tuple | None, int | None]:
        return (None, None) if self.last is None else ((self.x, self.y, self.last, self.held), self.last + self.silence)


SCHEMAS = {
    Freshness: "key string, role string, at timestamp, fresh boolean",
    Retained: "key string, tie {tie}, n int, mean double, oldest timestamp",
    Dwell: "key string, tie {tie}, stable int",
    AnchorWatch: "key string, tie {tie}, n int, x double, y double, watched boolean, at timestamp",
}


def kept_live(stream: DataFrame, key: str, processor: Live, late: str) -> DataFrame:
    """The rows of ``processor`` over a stream; input later than ``late`` behind the newest is dropped by Spark."""
    kinds = dict(stream.dtypes)
    schema = SCHEMAS[type(processor)].format(tie=kinds[processor.tie])
    out = buckets.dealt(stream.withWatermark(processor.at, late), key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")
    return out.withColumn("key", F.col("key").cast(kinds[key]))


def finished(stream: DataFrame, name: str) -> tuple[DataFrame, list[dict]]:
    """Runs a live stream over what is there now; its rows, and the rows of state after each micro-batch."""
    spark = stream.sparkSession
    place, before = state_dir(spark, name), spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        q = stream.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, before)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out"), [p["stateOperators"][0] for p in q.recentProgress if p["stateOperators"]]
