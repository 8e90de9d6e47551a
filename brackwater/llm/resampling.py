"""Target-distribution importance resampling over hashed n-grams, with n-gram checksums put together by CRC algebra.

A text's features are its runs of 1 to ``N_GRAM`` consecutive words, words joined by one space; a feature's bucket is the
CRC-32 of its UTF-8 bytes modulo ``BUCKETS``. The checksum of each distinct word of a batch is taken once, alone and behind a
space. That of a run follows from its parts without its bytes: CRC-32 is affine over GF(2), so that

    crc(a + b) = shift(crc(a), len(b)) xor crc(b)

where ``shift`` by one zero byte is a 32 x 32 matrix over GF(2), and by n bytes the n-th power of it, found by squaring.
A matrix is applied to whole columns of checksums as four tables of 256, a byte of the checksum each.

Bucket counts of the corpus and of the target are summed from counts by partition (at most ``BUCKETS`` rows each). They make
a gain by bucket: an array of ``BUCKETS`` doubles, the one thing that is told to every task. A document's weight is the sum of
its gains, its score the weight and Gumbel noise from its id. Scores are range-sorted once; places in the order follow from
the places within partitions and their sizes.

Null and empty texts have no features and weight 0. Equal scores go by the smaller doc_id, null ids last; rows that repeat
an id and a score take places next to each other. A null id has the noise of the empty name. An empty table gives no rows;
an empty target has no counts. A word may be as long as the text. Further columns are not read.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytes_of, common

N_GRAM = 1
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
#: The polynomial of CRC-32 with its bits mirrored, as zlib has it.
POLYNOMIAL = 0xEDB88320
#: Checksums that a worker keeps from batch to batch: of so many words, of at most so many characters.
KEEP, KEPT_LENGTH = 300_000, 64


def times(matrix: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The product over GF(2) of a 32 x 32 matrix (a uint32 a column) and vectors (a uint32 each)."""
    out = np.zeros_like(vectors)
    for bit in range(32):
        out ^= np.where(vectors >> np.uint32(bit) & np.uint32(1), matrix[bit], np.uint32(0))
    return out


@functools.lru_cache(maxsize=64)
def squared(power: int) -> np.ndarray:
    """The matrix that shifts a checksum by 2 ** ``power`` zero bytes; ``power`` -3 shifts it by one bit."""
    if power == -3:
        return np.array([POLYNOMIAL, *(1 << i for i in range(31))], np.uint32)
    half = squared(power - 1)
    return times(half, half)


@functools.lru_cache(maxsize=4096)
def tables(n: int) -> np.ndarray:
    """The shift by ``n`` bytes as 4 x 256 products, for each byte of a checksum."""
    out = (np.arange(256, dtype=np.uint32) << np.arange(0, 32, 8, dtype=np.uint32)[:, None]).ravel()
    for power in range(n.bit_length()):
        if n >> power & 1:
            out = times(squared(power), out)
    return out.reshape(4, 256)


def shifted(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each checksum as it stands before ``lengths`` further zero bytes; a matrix a distinct length."""
    out = np.empty_like(crcs)
    order = np.argsort(lengths, kind="stable")
    kinds, starts = np.unique(lengths[order], return_index=True)
    for n, rows in zip(kinds.tolist(), np.split(order, starts[1:]), strict=True):
        c, t = crcs[rows], tables(n)
        out[rows] = t[0][c & 255] ^ t[1][c >> 8 & 255] ^ t[2][c >> 16 & 255] ^ t[3][c >> 24]
    return out


def word_spans(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which words (0-9, a-z and all beyond ASCII) begin and end; none runs over the end of a row."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = (data >= 128) | ((data >= 48) & (data <= 57)) | ((data >= 97) & (data <= 122))
    begin, end = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    # Where a row begins behind a word that runs up to it, one word ends and another begins.
    inner = rows[1:-1][inside[rows[1:-1]] & inside[rows[1:-1] + 1]]
    begin[inner] = end[inner] = True
    return np.flatnonzero(begin), np.flatnonzero(end)


_seen: dict[str, tuple[int, int]] = {}


def word_crcs(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Checksums of the words, alone and behind a space; each distinct word of the batch is read once."""
    offsets = np.empty(2 * len(begins) + 1, np.int64)
    offsets[:-1:2], offsets[1::2], offsets[-1] = begins, ends, ends[-1]
    parts = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    coded = parts.take(pa.array(np.arange(0, len(offsets) - 1, 2))).dictionary_encode()
    if len(_seen) > KEEP:
        _seen.clear()
    pairs = np.empty((len(coded.dictionary), 2), np.uint32)
    space = zlib.crc32(b" ")
    for i, word in enumerate(coded.dictionary.to_pylist()):
        pair = _seen.get(word)
        if pair is None:
            raw = word.encode()
            pair = zlib.crc32(raw), zlib.crc32(raw, space)
            if len(word) <= KEPT_LENGTH:
                _seen[word] = pair
        pairs[i] = pair
    index = coded.indices.to_numpy()
    return pairs[index, 0], pairs[index, 1]


def features(texts: pa.Array, n_gram: int = N_GRAM, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of every feature, row of it, words a row); features in any order."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    data, rows = bytes_of.view(texts)
    capital = (data >= 65) & (data <= 90)
    data = np.where(capital, data | 32, data)
    n_rows = len(rows) - 1
    begins, ends = word_spans(data, rows) if len(data) else (np.zeros(0, np.int64),) * 2
    if not len(begins):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n_rows, np.int64)
    row = np.searchsorted(rows, begins, side="right") - 1
    alone, spaced = word_crcs(data, begins, ends)
    lengths = ends - begins + 1
    found, where, crcs = [alone], [row], alone
    for n in range(2, n_gram + 1):
        # Runs of n words: those of n - 1, shifted by a space and the next word. Runs over the end of a row are left out.
        crcs = shifted(crcs[:-1], lengths[n - 1 :]) ^ spaced[n - 1 :]
        whole = row[: len(crcs)] == row[n - 1 :]
        found.append(crcs[whole])
        where.append(row[: len(crcs)][whole])
    return np.concatenate(found).astype(np.int64) % buckets, np.concatenate(where), np.bincount(row, minlength=n_rows)


def counted(n_gram: int, buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in bytes_of.steps(batch):
                total += np.bincount(features(part.column("text"), n_gram, buckets)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return count


def bucket_counts(texts: DataFrame, n_gram: int = N_GRAM, buckets: int = BUCKETS) -> np.ndarray:
    """Features by bucket over all texts: ``buckets`` numbers, whatever the table's size."""
    parts = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(counted(n_gram, buckets), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """By bucket, thousandths of the logarithm of smoothed target over smoothed source frequency, rounded down."""
    b, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((y + 1.0) * (s + b) / ((x + 1.0) * (t + b)))) for x, y in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weigher(gain: np.ndarray, n_gram: int):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bytes_of.steps(batch):
                bucket, row, words = features(part.column("text"), n_gram, len(gain))
                n = part.num_rows
                count = np.bincount(row, minlength=n)
                # Sums of whole numbers, exact in doubles far beyond any text.
                weight = np.bincount(row, weights=gain[bucket], minlength=n).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(count), pa.array(weight), pa.array(words)], names=["doc_id", "n_features", "weight", "n_words"])

    return weigh


def noise(seed: int, doc_id: Column) -> Column:
    """Thousandths of a Gumbel variate, rounded down, from the first 32 bits of a digest of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def scored(docs: DataFrame, target: DataFrame, n_gram: int = N_GRAM, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, n_words) of every row of ``docs``."""
    gain = gains(bucket_counts(docs, n_gram, buckets), bucket_counts(target, n_gram, buckets))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    weighed = rows.mapInArrow(weigher(gain, n_gram), "doc_id long, n_features long, weight long, n_words long")
    return weighed.select("doc_id", "n_features", "weight", (F.col("weight") + noise(seed, F.col("doc_id"))).alias("score"), "n_words")


def ranked(rows: DataFrame, least: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """``scored`` rows with their rank: 1, 2, 3… for the highest scores among those of ``least`` words, null for the undrawn.

    One range sort of narrow rows, written; the counts of its partitions (a row each) tell where each begins in the order.
    """
    rows = common.written(rows, "scored")
    eligible = F.col("n_words") >= least
    order = [F.when(eligible, 0).otherwise(1), F.desc("score"), F.asc_nulls_last("doc_id"), "weight", "n_features"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed = common.written(placed, "placed").withColumn("part", F.shiftright("place", 33))
    parts = placed.groupBy("part").agg(F.count("*").alias("size"), F.count(F.when(eligible, True)).alias("eligible"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    everything = Window.partitionBy()
    parts = parts.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("begin"), F.floor(F.sum("eligible").over(everything) * percent / 100).alias("drawn"))
    rank = F.col("begin") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    joined = placed.join(common.small(parts), "part")
    return joined.select("doc_id", "n_features", "weight", "score", F.when(eligible & (rank <= F.col("drawn")), rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, n_gram: int = N_GRAM, buckets: int = BUCKETS, seed: int = SEED, least: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with weight, score and, where it is drawn, its rank."""
    return ranked(scored(docs, target, n_gram, buckets, seed), least, percent)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


#: The checksum of a distinct word goes byte by byte through the table of 256 remainders, which is made by the rule.
OP12_SQL = r"""
with recursive bits as (
  select n, n::bigint as c, 0 as k from range(256) t(n)
  union all
  select n, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bits where k < 8
),
remainder as materialized (select list(c order by n) as t from bits where k = 8),
docs as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
goal as (select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from benchmark),
doc_words as (select doc_id, unnest(words) as word from docs),
goal_words as (select unnest(words) as word from goal),
word_list as materialized (select word, hex(encode(word)) as h from (select word from doc_words union select word from goal_words)),
codes as materialized (
  select word, xor(list_reduce(list_transform(range(1, length(h), 2), lambda i: (instr('0123456789ABCDEF', h[i]) - 1) * 16 + instr('0123456789ABCDEF', h[i + 1]) - 1), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295) % 10000 as bucket
  from word_list, remainder
),
s as (select bucket, count(*) as n from doc_words join codes using (word) group by 1),
t as (select bucket, count(*) as n from goal_words join codes using (word) group by 1),
size as (select (select count(*) from doc_words)::double as s, (select count(*) from goal_words)::double as t),
gain as (select b.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1) * (size.s + 10000) / ((coalesce(s.n, 0) + 1) * (size.t + 10000))))::bigint as gain
  from range(10000) b(bucket) left join s using (bucket) left join t using (bucket), size),
weights as (select doc_id, sum(gain)::bigint as weight from doc_words join codes using (word) join gain using (bucket) group by 1),
scored as (select d.doc_id, len(d.words)::bigint as n_features, coalesce(w.weight, 0) as weight,
  coalesce(w.weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || d.doc_id)[1:8])::bigint + 0.5) / 4294967296)))::bigint as score
  from docs d left join weights w using (doc_id)),
placed as (select doc_id, row_number() over (order by score desc, doc_id) as place, count(*) over () as n from scored where n_features >= 20)
select doc_id, n_features, weight, score, case when place <= floor(10 * n / 100) then place end as rank from scored left join placed using (doc_id)
"""
