"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; everything else that may be learned from, labelled or not, is unlabelled
text. A linear classifier over the presence of lower-case words minimises the risk

    prior * E_pos[loss(+)] + max(0, E_unl[loss(-)] - prior * E_pos[loss(-)])

with the logistic loss, whose second part is kept from going negative by stepping back from it; ``prior`` is the share of
toxic documents among labelled ones that are not held out, unless the sample shows it to be much less: unlabelled text has
no more positives than the least (share of unlabelled text above a score) / (share of positives above it). Its numpy
weights cover ``FEATURES`` words and word beginnings (inflected words share them), those ranked best in Spark by how far their
document frequency among positives exceeds that in unlabelled text; no least excess is asked, the decayed fit weighs them.

Learning reads at most about ``POSITIVES`` and ``UNLABELLED`` documents, whole texts, chosen by a hash of doc_id among rows
that are not held out; equal texts count once. Scoring covers every row: cuts at letter boundaries, looked up by an Arrow
hash table. Labels, lang, source and doc_id are not inputs of a score.

Null and empty texts have the score of a text without known words. With no positives to learn from, or no words in them and the rest, scores are 0. Repeated
rows get equal scores. Labels of unknown or null documents are ignored; a document labelled both ways counts as toxic.
Further columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytes_of, common

POSITIVES = 5_000
UNLABELLED = 15_000
FEATURES = 256
#: Lengths of word beginnings that are features too, marked by a hyphen.
BEGINNINGS = (4, 5, 6)
THRESHOLD = 0.3
STEPS = 400
RATE = 0.05
DECAY = 1e-3
#: The sample overrules the labels on the prior if its bound is below this part of theirs.
TRUST = 0.7
PRIOR_RANGE = (0.001, 0.5)


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Runs of letters (ASCII lowered; all bytes beyond ASCII count as letters) of all rows, and the row of each."""
    data, rows = bytes_of.view(pc.ascii_lower(pc.fill_null(texts, "")))
    letter = ((data >= 97) & (data <= 122)) | (data >= 128)
    cuts = bytes_of.cuts(letter[1:] != letter[:-1], rows)
    if len(cuts) < 2:
        return pa.array([], pa.large_string()), np.zeros(0, np.int64)
    runs = pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))])
    is_word = letter[cuts[:-1]]
    row = np.searchsorted(rows, cuts[:-1], side="right") - 1
    return runs.filter(pa.array(is_word)), row[is_word]


def terms(words_: pa.Array) -> list[pa.Array]:
    """For each word the feature it is, and those it begins with (null: too short)."""
    length = pc.utf8_length(words_)
    out = [words_]
    for n in BEGINNINGS:
        begin = pc.binary_join_element_wise(pc.utf8_slice_codeunits(words_, 0, n), pa.scalar("-", words_.type), pa.scalar("", words_.type))
        out.append(pc.if_else(pc.greater(length, n), begin, pa.scalar(None, begin.type)))
    return out


def occurrences(texts: pa.Array, features: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, feature number) of each feature that occurs in a row, without repeats; all terms are features if none are given."""
    found, row = words(texts)
    coded = found.dictionary_encode()
    columns = [t.cast(pa.large_string()) for t in terms(coded.dictionary)]
    if features is None:
        features = pc.unique(pa.concat_arrays(columns)).drop_null()
    index, pairs = coded.indices.to_numpy(), []
    for column in columns:
        number = pc.fill_null(pc.index_in(column, value_set=features.cast(pa.large_string())), -1).to_numpy()
        hit = number[index].astype(np.int64) if len(number) else np.zeros(0, np.int64)
        pairs.append(np.unique(row[hit >= 0] * max(len(features), 1) + hit[hit >= 0]))
    pair = np.unique(np.concatenate(pairs))
    return *np.divmod(pair, max(len(features), 1)), features


def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n_pos, n_unl): documents with the feature, partial by batch."""
    for batch in batches:
        for part in bytes_of.steps(batch):
            doc, word, every = occurrences(part.column("text"))
            positive = part.column("positive").to_numpy(zero_copy_only=False)[doc]
            n = [np.bincount(word[positive == p], minlength=len(every)) for p in (True, False)]
            yield pa.RecordBatch.from_arrays([every.cast(pa.string()), *(pa.array(x.astype(np.int64)) for x in n)], names=["word", "n_pos", "n_unl"])


def presence(texts: pa.Array, features: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return occurrences(texts, features)[:2]


def looker(features: list[str]):
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bytes_of.steps(batch):
                row, feature = presence(part.column("text"), pa.array(features))
                at = np.searchsorted(row, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([part.column("positive"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(feature.astype(np.int32)))], names=["positive", "features"])

    return look


class Model:
    def __init__(self, features: list[str], weights: np.ndarray, bias: float):
        self.features, self.weights, self.bias = features, weights, bias

    def scores(self, texts: pa.Array) -> np.ndarray:
        row, feature = presence(texts, pa.array(self.features, pa.string()))
        return 1 / (1 + np.exp(-(self.bias + np.bincount(row, weights=self.weights[feature], minlength=len(texts)))))


def risk(w: np.ndarray, positive: np.ndarray, row: np.ndarray, feature: np.ndarray, prior: float, decay: float = 0.0) -> tuple[float, bool, np.ndarray]:
    """The risk of weights and bias ``w``, whether its second part is negative, and the gradient to step along.

    Where the part is negative, that is the gradient of minus the part: the step leads back from fitting the sample too well.
    """
    margin = w[-1] + np.bincount(row, weights=w[feature], minlength=len(positive))
    chance = 1 / (1 + np.exp(-margin))
    loss_pos, loss_neg = np.logaddexp(0, -margin), np.logaddexp(0, margin)
    n_pos, n_unl = int(positive.sum()), int((~positive).sum())
    part = loss_neg[~positive].mean() - prior * loss_neg[positive].mean()
    # Gradients of the loss: of class + it is chance - 1, of class - it is chance.
    slope = np.zeros(len(positive))
    if part >= 0:
        slope[positive] = prior * (chance[positive] - 1) / n_pos - prior * chance[positive] / n_pos
        slope[~positive] = chance[~positive] / n_unl
    else:
        slope[positive] = prior * chance[positive] / n_pos
        slope[~positive] = -chance[~positive] / n_unl
    grad = np.append(np.bincount(feature, weights=slope[row], minlength=len(w) - 1), slope.sum())
    grad[:-1] += decay * prior * w[:-1]
    return prior * loss_pos[positive].mean() + max(0.0, part) + decay * prior / 2 * (w[:-1] ** 2).sum(), part < 0, grad


def fit(positive: np.ndarray, row: np.ndarray, feature: np.ndarray, n_features: int, prior: float, steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient descent (Adam) on the non-negative risk; positive[i] says which sample row i is of."""
    w, m, v = (np.zeros(n_features + 1) for _ in range(3))
    w[-1] = np.log(prior / (1 - prior))
    for t in range(1, steps + 1):
        _, _, grad = risk(w, positive, row, feature, prior, decay)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w[:-1], float(w[-1])


def most_prior(positive: np.ndarray, margin: np.ndarray) -> float:
    """The least bound that any score puts on the share of positives in unlabelled text."""
    pos, unl = margin[positive], margin[~positive]
    bounds = [(np.count_nonzero(unl >= t) + 1) / (len(unl) + 1) / np.mean(pos >= t) for t in np.quantile(pos, np.linspace(0.05, 0.5, 10))]
    return float(np.clip(min(bounds), *PRIOR_RANGE))


def learn(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, features: int = FEATURES) -> Model | None:
    """docs(doc_id, text), labels(doc_id, toxic)."""
    free = ~common.held_out()
    known = labels.filter(free & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.max("toxic") == 1).alias("toxic"))
    n_known, n_toxic = known.agg(F.count("*"), F.coalesce(F.count_if("toxic"), F.lit(0))).first()
    if not n_toxic:
        return None
    n_docs = docs.count()
    unit = lambda seed: F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # The sample of ids is counted, not all toxic labels: it stays small however many there are.
    toxic_ids = common.small(common.written(known.filter(F.col("toxic") & (unit(1) < positives / n_toxic)).select("doc_id"), "toxicity-ids"), 10 * common.SMALL_ROWS)
    pos = docs.join(toxic_ids, "doc_id", "left_semi").select("text", F.lit(True).alias("positive"))
    # Unlabelled text is a plain sample of all text, known toxic documents with it: the risk estimator supposes so.
    unl = docs.filter(free & (unit(2) < unlabelled / max(n_docs, 1))).select("text", F.lit(False).alias("positive"))
    rows = common.written(pos.unionByName(unl).dropDuplicates(["text", "positive"]), "toxicity-sample")
    n_pos, n_unl = rows.agg(F.count_if("positive"), F.count_if(~F.col("positive"))).first()
    if not n_pos or not n_unl:
        return None
    counted = rows.mapInArrow(frequencies, "word string, n_pos long, n_unl long").groupBy("word").agg(F.sum("n_pos").alias("p"), F.sum("n_unl").alias("u"))
    # Documents among positives, beyond what unlabelled text lets expect, in (padded) standard deviations.
    expected = (F.col("u") + 1) * F.lit(n_pos / (n_unl + 1))
    excess = (F.col("p") - expected) / F.sqrt(expected + 1)
    # The best ranked, whatever their excess: with few positives none stands out by itself, and the fit weighs them together.
    chosen = counted.select("word", excess.alias("excess")).orderBy(F.desc("excess"), "word").limit(features)
    names = sorted(r["word"] for r in chosen.collect())
    if not names:
        return None
    table = rows.mapInArrow(looker(names), "positive boolean, features array<int>").toArrow()
    lists = table.column("features").combine_chunks()
    feature = lists.flatten().to_numpy()
    row = np.repeat(np.arange(table.num_rows), lists.value_lengths().to_numpy())
    positive = table.column("positive").to_numpy()
    prior = float(np.clip(n_toxic / n_known, *PRIOR_RANGE))
    w, b = fit(positive, row, feature, len(names), prior)
    bound = most_prior(positive, b + np.bincount(row, weights=w[feature], minlength=len(positive)))
    prior = bound if bound < TRUST * prior else prior
    return Model(names, *fit(positive, row, feature, len(names), prior))


def scorer(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bytes_of.steps(batch):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in part.schema.names), pa.array(model.scores(part.column("text")))], names=[*part.schema.names, "score"])

    return score


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``score``, which replaces a column of that name."""
    docs = docs.drop("score")
    if model is None:
        return docs.withColumn("score", F.lit(0.0))
    schema = docs.schema.simpleString()[len("struct<") : -1]
    from pyspark.sql.types import DoubleType, StructType

    return docs.mapInArrow(scorer(model), StructType([*docs.schema.fields]).add("score", DoubleType())) if schema else docs


def reject(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those that score at least ``threshold``; columns stay as they are."""
    model = learn(docs.select("doc_id", "text"), labels)
    return scored(docs, model).filter(F.col("score") < threshold).select(*docs.columns)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, common.table(spark, sf_dir, "labels"))
    found = scored(docs, model)
    return found.select("doc_id", common.held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
