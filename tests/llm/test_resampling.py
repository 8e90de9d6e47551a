"""Importance resampling against a plain version over bytes, and the checksum algebra against zlib."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from brackwater.llm import common, resampling

DATA = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_features(text, n_gram, buckets):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, n_gram + 1) for i in range(len(words) - n + 1)]


def plain(docs, target, n_gram, buckets, least=20, percent=10):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(plain_features(text, n_gram, buckets)[1])
    for text in target:
        t.update(plain_features(text, n_gram, buckets)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    rows = []
    for doc_id, text in docs:
        n, found = plain_features(text, n_gram, buckets)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in found)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    drawn = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    for i, r in enumerate(drawn[: len(drawn) * percent // 100]):
        r[4] = i + 1
    return sorted(repr(tuple(r[:5])) for r in rows)


def frames(spark, docs, target, clash=False):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    if clash:
        d = d.selectExpr("*", "1 as score", "'a' as rank", "2 as place", "3 as part", "4 as weight", "5 as n_words", "6 as n_features", "7 as drawn", "8 as begin")
    return d, spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")


ODD = [
    (1, "Words and MORE words, 12a3 and x" * 20),
    (2, None),
    (3, ""),
    (4, "w" * 300_000 + " end"),
    (5, "é   ÀÉ İ ﬀ \U0001f600ok " * 30),
    (6, "the same text " * 10),
    (6, "the same text " * 10),
    (7, "the same text " * 10),
    (None, "no id here at all " * 9),
    (None, "no id here at all " * 9),
    (8, "\x00\x7f{|}~ []^_` /0:9 @AZ az" * 8),
    (-5, "few words"),
    (9, "one two three four five six seven eight nine ten " * 2_000),
]


@pytest.mark.parametrize("n_gram", [1, 2, 3])
@pytest.mark.parametrize("clash", [False, True])
def test_against_bytes(spark, n_gram, clash):
    rng = random.Random(5)
    docs = ODD + [(100 + i, " ".join(rng.choice(["alpha", "beta", "Gamma", "naïve", "x1"]) for _ in range(rng.randrange(60)))) for i in range(80)]
    target = ["alpha beta the same", None, "", "x1 naïve Gamma and words"]
    d, t = frames(spark, docs, target, clash)
    got = resampling.resample(d, t, n_gram, 997, percent=30)
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain(docs, target, n_gram, 997, percent=30)


def test_no_rows(spark):
    d, t = frames(spark, [], [])
    assert resampling.resample(d, t).count() == 0
    d, _ = frames(spark, ODD, [])
    assert sorted(repr(tuple(r)) for r in resampling.resample(d, t, percent=50).collect()) == plain(ODD, [], 1, 10_000, percent=50)


def test_checksums_compose():
    rng = random.Random(3)
    pairs = [(rng.randbytes(rng.randrange(40)), rng.randbytes(rng.choice([0, 1, 2, 7, 255, 256, 70_001]))) for _ in range(200)]
    a, b = (np.array([zlib.crc32(p[i]) for p in pairs], np.uint32) for i in (0, 1))
    both = resampling.shifted(a, np.array([len(p[1]) for p in pairs])) ^ b
    assert both.tolist() == [zlib.crc32(p[0] + p[1]) for p in pairs]


def test_whole_table_against_sql(spark):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = resampling.op12_importance_resampling(spark, DATA)
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    rows = sorted(tuple(r) for r in c.sql(resampling.OP12_SQL).select(*names).fetchall())
    assert got.columns == names and sorted(tuple(r) for r in got.collect()) == rows
    docs = [tuple(r) for r in common.table(spark, DATA, "documents").select("doc_id", "text").collect()]
    target = [r.text for r in common.table(spark, DATA, "benchmark").collect()]
    assert sorted(map(repr, rows)) == plain(docs, target, 1, 10_000)
