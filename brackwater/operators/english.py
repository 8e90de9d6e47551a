"""Text reduced to its English blocks and lines, by a scorer of character trigrams that is fitted on labelled text.

A scorer is one weight a bucket of hashed trigrams: the logarithm of its smoothed frequency in English over that in the other
languages. Counts are summed by Spark from counts by partition; the table of ``BUCKETS`` doubles is what tasks are given. The
chance that a segment is English is that of the sum of its trigrams' weights, tempered by its length, as neighbouring trigrams
say much the same.

A text is cut into blocks at blank lines. A block that is English stays whole; of another block of several lines, those lines
stay that are; if nothing stays, the text does as it was. Segments are scored for some texts at once, ``BYTES`` of them, however
long the rows of a batch are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 14
#: Bytes of texts whose trigrams are held at once; one longer text is held alone.
BYTES = 1 << 20
#: From this length on a segment must be English with chance SURE; a shorter one with EVEN, or be a label. Fixed values.
LONG, SURE, EVEN = 24, 0.85, 0.5
#: A label: its greatest length, and the part of it that is beyond ASCII. Fixed values.
LABEL, BEYOND = 80, 0.12
LETTERS = re.compile("[A-Za-z]{2}")
BLANK = re.compile(r"\n\s*\n")


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all trigrams of lower-case code points, and the number of the text of each; one space stands before each text."""
    whole = "".join(f" {t.lower()}" for t in texts)
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([len(t.lower()) + 1 for t in texts], np.int64)
    row = np.repeat(np.arange(len(texts)), lengths)
    if len(points) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mixed = (points[:-2] * np.uint64(961) + points[1:-1] * np.uint64(31) + points[2:]) * np.uint64(2654435761)
    same = row[:-2] == row[2:]
    return ((mixed >> np.uint64(7)) % np.uint64(BUCKETS)).astype(np.int64)[same], row[:-2][same]


def portions(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Rows of a batch in order, at most ``BYTES`` of text at once, or one row."""
    lengths = np.array(pc.fill_null(pc.binary_length(batch.column(text)), 0))
    upto, at = np.cumsum(lengths, dtype=np.int64), 0
    while at < batch.num_rows:
        before = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, before + BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


def counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, BUCKETS), np.int64)
    for batch in (part for whole in batches for part in portions(whole, "text")):
        texts, english = batch.column("text").to_pylist(), np.array(batch.column("english").to_pylist(), bool)
        bucket, row = trigrams(texts)
        for kind in (0, 1):
            total[kind] += np.bincount(bucket[english[row] == bool(kind)], minlength=BUCKETS)
    at = np.flatnonzero(total.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0, at]), pa.array(total[1, at])], names=["bucket", "other", "english"])


def fitted(labelled: DataFrame) -> np.ndarray:
    """Weights by bucket from labelled(text, lang); zeros where one side has no text."""
    rows = labelled.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", (F.col("lang") == "en").alias("english"))
    counts = np.zeros((2, BUCKETS))
    for r in rows.mapInArrow(counter, "bucket long, other long, english long").groupBy("bucket").agg(F.sum("other").alias("other"), F.sum("english").alias("english")).collect():
        counts[:, r.bucket] = r.other, r.english
    if not counts.sum(axis=1).all():
        return np.zeros(BUCKETS)
    share = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
    return np.log(share[1]) - np.log(share[0])


def chances(segments: list[str], weights: np.ndarray) -> np.ndarray:
    bucket, row = trigrams(segments)
    total = np.bincount(row, weights=weights[bucket], minlength=len(segments))
    n = np.bincount(row, minlength=len(segments))
    return 1 / (1 + np.exp(-np.clip(total / np.sqrt(np.maximum(n, 1)), -500, 500)))


def is_label(s: str) -> bool:
    return len(s) <= LABEL and bool(LETTERS.search(s)) and sum(c > "\x7f" for c in s) / len(s) < BEYOND


def is_english(s: str, chance: float) -> bool:
    return chance >= SURE if len(s) >= LONG else chance >= EVEN or is_label(s)


def kept(texts: list[str | None], weights: np.ndarray) -> list[str | None]:
    """What stays of each text."""
    blocks = [[b.strip() for b in BLANK.split(t) if b.strip()] if t else [] for t in texts]
    flat = [b for own in blocks for b in own]
    whole = iter([is_english(b, c) for b, c in zip(flat, chances(flat, weights).tolist(), strict=True)] if flat else [])
    plans: list[list[tuple[bool, list[str]]]] = []
    for own in blocks:
        plans.append([])
        for b in own:
            stays = next(whole)
            lines = [] if stays else [x.strip() for x in b.split("\n") if x.strip()]
            plans[-1].append((stays, lines if len(lines) > 1 else []))
    lines = [x for plan in plans for _, own in plan for x in own]
    line_stays = iter([is_english(x, c) for x, c in zip(lines, chances(lines, weights).tolist(), strict=True)] if lines else [])
    out: list[str | None] = []
    for text, own, plan in zip(texts, blocks, plans, strict=True):
        parts = [b if stays else "\n".join([x for x in inner if next(line_stays)]) for b, (stays, inner) in zip(own, plan, strict=True)]
        out.append("\n\n".join(p for p in parts if p) or text)
    return out


def english_only(df: DataFrame, text: str, weights: np.ndarray) -> DataFrame:
    """``df`` with ``text`` reduced to what is English in it; null and blank texts stay as they are."""
    shared = df.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portions(whole, text)):
            at = batch.schema.get_field_index(text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(kept(batch.column(at).to_pylist(), shared.value), batch.schema.field(at).type))

    return df.mapInArrow(run, df.schema)
