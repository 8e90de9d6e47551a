"""Leaked phrases against a plain search, with what is sent to find them."""

import random

import pytest
from pyspark.sql import functions as F

from brackwater.operators import leaks
from brackwater.sources import shared


def texts(seed, n, least, most):
    rng = random.Random(seed)
    return [" ".join(rng.choices(["the", "the", "sea", "sail", "fog", "Bow", "jib"], k=rng.randrange(least, most))) for _ in range(n)]


@pytest.mark.parametrize("few", [50_000, 0])
def test_leaks_are_those_of_a_plain_search(spark, monkeypatch, few):
    monkeypatch.setattr(leaks, "FEW", few)
    items = [("a" if k % 3 else None if k % 2 else "b", k, t) for k, t in enumerate([*texts(1, 80, 0, 9), "the sea", None, "", "Fog! the, sea; sail", "Fog! the, sea; sail"])]
    phrases = [(9 - k if k < 2 else k, t) for k, t in enumerate([*texts(2, 12, 4, 9), "fog", "the sea", "sea the sea", "?", None, "The the", "the  the", *[f"fog the sea sail {x}" for x in ("on", "jib")]])]
    corpora = [("a", t) for t in texts(3, 30, 3, 7)] + [("b", t) for t in texts(4, 3, 3, 7)] + [(None, "fog"), ("b", None)]
    row = lambda t: " " + " ".join((t or "").lower().translate(str.maketrans("!,;?", "    ")).split()) + " "
    ids = {}
    for k, t in phrases:
        if row(t) != "  ":
            ids[row(t)] = min(k, ids.get(row(t), k))
    met = {(s, k, i, p) for s, k, t in items for p, i in ids.items() if row(t) != "  " and (p in row(t) or len(row(t).split()) >= 4 and row(t) in p)}
    want = {(s, k, i) for s, k, i, p in met if not any(s is not None and s == c and p in row(t) for c, t in corpora)}
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = leaks.leaked(df(items, "scope string, key long, text string"), df(phrases, "phrase_id long, text string"), df(corpora, "scope string, text string")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) and 0 < len(want) < len(met)


def test_no_phrases(spark):
    one = spark.createDataFrame([("a", 1, "the sea")], "scope string, key long, text string")
    assert leaks.leaked(one, one.select(F.col("key").alias("phrase_id"), "text").limit(0), one.select("scope", "text")).count() == 0


def test_texts_are_not_sent_a_word(spark, monkeypatch, tmp_path):
    """What is written on the way to no leak is far less than the texts."""
    monkeypatch.setattr(shared, "shared_dir", lambda spark: f"file://{tmp_path}")
    rng = random.Random(5)
    items = spark.createDataFrame([("a", k, " ".join(f"{rng.getrandbits(64):x}" for _ in range(200))) for k in range(400)], "scope string, key long, text string")
    found = leaks.leaked(items, spark.createDataFrame([(1, "the sea is deep and cold")], "phrase_id long, text string"), items.select("scope", "text"))
    assert found.count() == 0 and sum(f.stat().st_size for f in tmp_path.rglob("*") if f.is_file()) < 200_000 < 400 * 200 * 16
