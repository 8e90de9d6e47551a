"""Texts that repeat known phrases which their own corpus does not have: containment either way by runs of words, then an exclusion.

Texts are compared as rows of words. A phrase is looked for through one run of its words, and a text that may lie within a phrase
through its first run. Runs travel as hashes, beside a hash of their row: no text is sent a word, and equal rows are met once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: Words of a text that is looked for within phrases, at least; words of a run, which a shorter phrase is as a whole.
LEAST = RUN = 4
#: Runs of phrases that are sent to every task.
FEW = 50_000
C = F.col


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def row_of(words_: Column) -> Column:
    """Words with a space around each, so that containment of rows is that of strings."""
    return F.concat(F.lit(" "), F.array_join(words_, " "), F.lit(" "))


def rows_of(texts: DataFrame, *keys: str) -> DataFrame:
    """(keys, marks, row, h): texts with a word as rows of words, hashes of the words, and the one by which a row is found again."""
    rows = texts.select(*keys, words(C("text")).alias("w")).filter(F.size("w") > 0)
    rows = rows.select(*keys, F.transform("w", lambda w: F.xxhash64(w)).alias("marks"), row_of(C("w")).alias("row"))
    return rows.withColumn("h", F.xxhash64("row"))


def hashed(*words_: Column) -> Column:
    """The hash of a run, from those of its words."""
    return F.xxhash64(*words_)


def runs(marks: Column, n: int) -> Column:
    """Hashes of the distinct runs of ``n`` words, by the words' hashes; none of a shorter text."""
    at = F.when(F.size(marks) >= n, F.sequence(F.lit(0), F.size(marks) - n)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: hashed(*[F.get(marks, i + k) for k in range(n)])))


def runs_of(marks: Column, sizes: list[int]) -> Column:
    return F.concat(*[runs(marks, n) for n in sizes]) if sizes else F.array().cast("array<bigint>")


def met(rows: DataFrame, keys: list[str], own: Column, asked: DataFrame, few: bool, fits: Column) -> DataFrame:
    """Distinct (keys, phrase_id) of rows_of(keys), one of whose runs ``own`` is one of asked(run, phrase_id, phrase), if it ``fits``.

    ``keys`` that ``asked`` has too must agree. Where the phrases are few, rows are tested where they are; else hashes meet first.
    """
    on = [k for k in keys if k in asked.columns]
    if few:
        found = rows.select(*keys, "row", F.explode(own).alias("run")).join(F.broadcast(asked), [*on, "run"])
    else:
        pairs = rows.select(*on, "h", F.explode(own).alias("run")).join(asked.select(*on, "run", "phrase_id"), [*on, "run"]).select(*on, "h", "phrase_id").distinct()
        found = rows.select(*keys, "row", "h").join(pairs, [*on, "h"]).join(asked.select("phrase_id", "phrase").distinct(), "phrase_id")
    return found.filter(fits).select(*keys, "phrase_id").distinct()


def leaked(items: DataFrame, phrases: DataFrame, corpora: DataFrame) -> DataFrame:
    """(scope, key, phrase_id) of items(scope, key, text) that have a phrase's words in a row, or, with ``LEAST`` words or more, lie
    within one, where no text of corpora(scope, text) of their scope has the phrase. phrases(phrase_id, text).

    Phrases of equal words are one, under the smallest id; phrases and texts without a word take no part.
    """
    i = rows_of(items, "scope", "key")
    p = rows_of(phrases, "phrase_id").groupBy("row").agg(F.min("phrase_id").alias("phrase_id"), F.first("marks").alias("marks"))
    p = written(p.select("phrase_id", C("row").alias("phrase"), "marks", F.least(F.size("marks"), F.lit(RUN)).alias("size")), "leak-phrases")
    sizes = sorted(r[0] for r in p.select("size").distinct().collect())
    own = F.coalesce(*[F.when(C("size") == n, runs(C("marks"), n)) for n in sizes]) if sizes else runs_of(C("marks"), [])
    parts = written(p.select("phrase_id", "size", "phrase", F.explode(own).alias("run")), "leak-runs")
    # Of its runs a phrase is looked for by the one that fewest phrases have.
    shared = parts.groupBy("run").agg(F.count("*").alias("df"))
    keyed = written(parts.join(shared, "run").groupBy("phrase_id", "phrase").agg(F.min_by("run", F.struct("df", "run")).alias("run")), "leak-keys")
    every, few = runs_of(C("marks"), sizes), parts.count() <= FEW
    has = met(i, ["scope", "key"], every, keyed, few, F.contains("row", C("phrase")))
    longest = p.agg(F.max(F.size("marks"))).first()[0] or 0
    short = i.filter(F.size("marks").between(LEAST, longest))
    first = F.array(hashed(*[F.get("marks", F.lit(k)) for k in range(RUN)]))
    within = met(short, ["scope", "key"], first, parts.filter(C("size") == RUN).select("run", "phrase_id", "phrase"), few, F.contains("phrase", C("row")))
    hits = written(has.unionByName(within).distinct(), "leak-met")
    # Only phrases that were met are looked for in the corpora of their scope.
    asked = written(hits.select("scope", "phrase_id").distinct().join(keyed, "phrase_id"), "leak-asked")
    grounded = met(rows_of(corpora, "scope"), ["scope"], every, asked, asked.count() <= FEW, F.contains("row", C("phrase")))
    return hits.join(grounded, ["scope", "phrase_id"], "left_anti").select("scope", "key", "phrase_id")


def first_leak(found: DataFrame) -> DataFrame:
    """(scope, key, phrase_id, n): of each item the first phrase, and how many it repeats."""
    w = Window.partitionBy("scope", "key")
    return found.withColumn("n", F.count("*").over(w)).withColumn("at", F.row_number().over(w.orderBy("phrase_id"))).filter("at = 1").drop("at")
