"""Best-fit packing of documents into sequences, by vectors of three capacities.

A document's identifiers, with an end token, are one piece, or several of exactly the sequence length of which only the
first may be shorter. A piece needs (its tokens, one document slot, its tokens squared as attention cost); a bin has a
capacity in each. Pieces are taken longest first, and each goes to the open bin that holds it under every constraint and
whose residual vector, in shares of capacity and weighted, is then shortest (``rule="norm"``), or whose residual has the
largest weighted dot product with the piece (``rule="dot"``). None that holds it: a new bin.

Pieces as long as a sequence are sequences of their own and take no part. The others are dealt at random into groups of
about ``GROUP`` pieces, which are packed independently, so memory and time of a task do not depend on the input; a group
loses at most part of its last bin, one sequence in thousands. Identifiers are never shuffled, only piece lengths are.

Null and empty texts are a piece of one end token. Repeated rows are pieces of their own, dealt like any others. An empty
table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytes_of, common, tokens

SEQUENCE = 1024
VOCABULARY = "byte_bpe_50k.json"
END = 2
GROUP = 1 << 14
#: Capacities in documents and attention cost. Both act, and hardly cost a sequence: over the 15,401 pieces of the largest
#: test table 4,466 sequences against 4,465 of plain best fit by tokens alone (4,464 is the least there could be). A sequence
#: whose one long piece leaves only crumbs of room keeps them, and crumbs of documents do not pile up in one sequence.
MAX_DOCUMENTS = 256
MAX_ATTENTION = SEQUENCE * SEQUENCE * 98 // 100
#: Weights of the shares of tokens, documents and attention cost; tokens lead, as the fewest sequences are asked for.
WEIGHTS = (1.0, 0.2, 0.2)
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def piece_bounds(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` tokens."""
    first = (n - 1) % length + 1
    return [(0, first), *((s, length) for s in range(first, n, length))]


def cutter(path: str, kind: str, end: int, length: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bytes_of.steps(batch):
                ids, rows = tokens.with_end(*tokens.encode(part.column("text"), path, kind), end)
                doc, piece, start, size, crc = [], [], [], [], []
                for d, a, b in zip(part.column("doc_id").to_pylist(), rows[:-1].tolist(), rows[1:].tolist(), strict=True):
                    for k, (s, n) in enumerate(piece_bounds(b - a, length)):
                        doc.append(d)
                        piece.append(k)
                        start.append(s)
                        size.append(n)
                        crc.append(tokens.crc(ids[a + s : a + s + n]))
                yield pa.record_batch([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, size, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def pieces(docs: DataFrame, path: str, kind: str = "byte", end: int = END, length: int = SEQUENCE) -> DataFrame:
    """Written table of pieces: one scan, one encoding."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return common.written(docs.mapInArrow(cutter(path, kind, end, length), PIECES), "pieces")


def best_fit(lengths: np.ndarray, capacity: tuple[int, int, int], weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm") -> np.ndarray:
    """Bin of each piece. Lengths must not exceed the first capacity; a piece too costly for an empty bin has its own."""
    need = np.stack([lengths, np.ones_like(lengths), lengths * lengths]).astype(np.float64)
    cap, w = np.array(capacity, np.float64), np.array(weights, np.float64)
    bins = np.zeros(len(lengths), np.int64)
    room = np.zeros((3, len(lengths)))  # residuals of the open bins, n_open of them
    name = np.zeros(len(lengths), np.int64)
    n_open = made = 0
    least = need.min(axis=1) if len(lengths) else cap
    scale = (w / cap**2)[:, None]
    for step, i in enumerate(np.argsort(-lengths, kind="stable")):
        x = need[:, i : i + 1]
        left = room[:, :n_open] - x
        fits = (left >= 0).all(axis=0)
        if fits.any():
            score = (left * left * scale).sum(axis=0) if rule == "norm" else -(room[:, :n_open] * x * scale).sum(axis=0)
            k = int(np.argmin(np.where(fits, score, np.inf)))
            room[:, k] = left[:, k]
        else:
            k, n_open = n_open, n_open + 1
            name[k], made = made, made + 1
            room[:, k] = np.maximum(cap - x[:, 0], 0)
        bins[i] = name[k]
        if step % 256 == 255:  # bins that no piece fits any more are closed
            keep = np.flatnonzero((room[:, :n_open] >= least[:, None]).all(axis=0))
            room[:, : len(keep)], name[: len(keep)], n_open = room[:, keep], name[keep], len(keep)
    return bins


def packer(capacity: tuple[int, int, int], weights: tuple[float, float, float], rule: str):
    def pack_group(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], kind="stable").reset_index(drop=True)
        bins = best_fit(rows["length"].to_numpy(), capacity, weights, rule)
        rows["sequence_id"] = ((np.int64(key[0]) << 32) | bins) * 2
        rows["offset"] = rows.groupby("sequence_id")["length"].cumsum() - rows["length"]
        return rows[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return pack_group


def pack(docs: DataFrame, path: str | None = None, kind: str = "byte", end: int = END, length: int = SEQUENCE, max_documents: int = MAX_DOCUMENTS, max_attention: int = MAX_ATTENTION, weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm", group: int = GROUP) -> DataFrame:
    """A row a piece: (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    cut = pieces(docs, path or tokens.vocabulary(VOCABULARY), kind, end, length)
    schema = PIECES + ", sequence_id long, offset long"
    full = cut.filter(F.col("length") == length).withColumns({"sequence_id": F.monotonically_increasing_id() * 2 + 1, "offset": F.lit(0).cast("long")})
    rest = cut.filter(F.col("length") < length)
    groups = max(1, -(-rest.count() // group))
    # The row number in the written table, not the document, is dealt: repeated rows spread like any others.
    dealt = rest.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int"))
    packed = dealt.groupBy("_group").applyInPandas(packer((length, max_documents, max_attention), weights, rule), schema)
    return full.unionByName(packed)


def op7_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
