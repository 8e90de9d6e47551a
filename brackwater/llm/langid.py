"""Language identification by prediction by partial matching over bytes.

Each language has a tree of its own: frozen counts of bytes behind contexts of up to ``ORDER`` bytes. A byte's probability is
its share of the longest known context; a byte new to a context costs the escape (method C: distinct bytes / (count + distinct
bytes)) and is predicted by the next shorter context among the bytes not yet excluded, down to equal shares of the 256 bytes.
The code length of a text, in bits, is the sum over its bytes; the language with the shortest code is predicted.

Learning: at most about ``SAMPLE`` documents a language, whole texts, chosen by a hash of doc_id among rows that are not held
out. Spark counts every (context, byte) of them and ranks each language's contexts by their totals; a tree keeps the first
ones with all that was ever seen behind them, so the escapes of a kept context are exact. A context's own suffix is at least
as frequent, so a tree never has a gap. A tree has at most ``NODES`` nodes, however many languages there are.

As counts are frozen, trees compile into tables for scoring: a node for each context of the trees of a table, and in it each
language's code length of each byte by that language's own tree. ``TOGETHER`` languages share a table, or each has its own where
they are more than ``FEW``, which keeps all tables together in proportion to the number of languages; code lengths are the same.
Scoring is gathers and sums over bounded runs of bytes.

Null texts, and texts without a letter, are ``und`` with score 0. With nothing to learn from, all are. Repeated rows and
further columns make no difference; only doc_id, text and (for learning) lang are read. Ties go to the first by code point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytes_of, common

ORDER = 3
SAMPLE = 2000
#: Nodes of a language's tree at most.
NODES = 4096
#: Languages of a compiled table, if there are no more than FEW.
TOGETHER, FEW = 4, 16
#: Bytes scored at a time; a longer text is summed run by run.
RUN = 1 << 18
#: Distinct (context, byte) pairs a worker gathers before it hands partial counts on.
FLUSH = 16 << 20


def grams(data: np.ndarray, rows: np.ndarray, order: int) -> np.ndarray:
    """(byte, byte before, ...) of ``order`` + 1 bytes as one integer for each place with so many bytes before it in its row."""
    key = np.zeros(max(len(data) - order, 0), np.uint32)
    for k in range(order + 1):
        key |= data[order - k : len(data) - k].astype(np.uint32) << np.uint32(8 * k)
    ok = np.ones(len(key), bool)
    for k in range(1, order + 1):  # places whose context would reach into the row before
        at = rows[1:-1] - k
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return key[ok]


def counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, order, gram, n): partial counts of a batch."""
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        for lang in sorted(set(langs)):
            part = batch.filter(pa.array(langs == lang))
            for step in bytes_of.steps(part, size=FLUSH):
                data, rows = bytes_of.view(step.column("text"))
                for order in range(ORDER + 1):
                    gram, n = np.unique(grams(data, rows, order), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(np.full(len(gram), order)), pa.array(gram.astype(np.int64)), pa.array(n)], names=["lang", "order", "gram", "n"])


class Model:
    """langs; ``symbol``: column of each byte; ``child``: node behind (node, next byte back), itself if there is none; ``bits``."""

    def __init__(self, langs: list[str], symbol: np.ndarray, child: np.ndarray, bits: np.ndarray):
        self.langs, self.symbol, self.child, self.bits = langs, symbol, child, bits

    def lengths(self, data: np.ndarray, rows: np.ndarray, run: int = RUN) -> np.ndarray:
        """Code lengths in bits, a row a text and a column a language."""
        total = np.zeros((len(rows) - 1, len(self.langs)))
        for a in range(0, len(data), run):
            b = min(a + run, len(data))
            first, last = np.searchsorted(rows, a, side="right") - 1, np.searchsorted(rows, b, side="left")
            total[first:last] += bytes_of.row_sums(self._costs(data, rows, a, b), np.clip(rows[first : last + 1], a, b) - a)
        return total

    def _costs(self, data: np.ndarray, rows: np.ndarray, a: int, b: int) -> np.ndarray:
        """Bits of the bytes a .. b - 1, whose contexts may begin before a."""
        start = max(a - ORDER, 0)
        part, n = data[start:b], b - start
        node = np.zeros(n, np.int32)
        child = self.child.ravel()
        shorter = []
        for back in range(1, ORDER + 1):
            shorter.append(node)
            deeper = node.copy()
            if n > back:
                deeper[back:] = child[node[back:] * 256 + part[:-back]]
                if back > 1:  # a node not found at one length has no longer ones
                    stuck = shorter[-1] == shorter[-2]
                    deeper[stuck] = node[stuck]
            node = deeper
        for back in range(ORDER):  # the first places of a text have shorter contexts
            at = rows[:-1] + back
            at = at[(at < rows[1:]) & (at >= start) & (at < b)] - start
            node[at] = shorter[back][at]
        node, part = node[a - start :], part[a - start :]
        return self.bits.reshape(-1, len(self.langs))[node.astype(np.int64) * self.bits.shape[1] + self.symbol[part]]


class Forest:
    """The trees of all languages, in as many tables as they take."""

    def __init__(self, parts: list[Model]):
        self.parts = parts
        self.langs = [lang for part in parts for lang in part.langs]

    def lengths(self, data: np.ndarray, rows: np.ndarray, run: int = RUN) -> np.ndarray:
        """Code lengths in bits, a row a text and a column a language."""
        return np.hstack([part.lengths(data, rows, run) for part in self.parts])


def suffix(context: np.ndarray, order: int) -> np.ndarray:
    """The context without its farthest byte."""
    return context & ((1 << 8 * (order - 1)) - 1)


def found(sorted_: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``values`` in a sorted array, and whether they are there."""
    at = np.minimum(np.searchsorted(sorted_, values), max(len(sorted_) - 1, 0))
    return at, (sorted_[at] == values if len(sorted_) else np.zeros(len(values), bool))


def build(langs: list[str], counts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Model:
    """counts[order] = (language number, gram, n) of all contexts that the languages' trees keep."""
    known = np.unique(counts[0][1])  # bytes seen at all; the others share a column
    symbol = np.full(256, len(known), np.int64)
    symbol[known] = np.arange(len(known))
    width = len(known) + 1
    contexts = {k: np.unique(counts[k][1] >> 8) if k else np.zeros(1, np.int64) for k in range(ORDER + 1)}
    first = np.cumsum([0, *(len(contexts[k]) for k in range(ORDER + 1))])
    child = np.repeat(np.arange(first[-1], dtype=np.int32)[:, None], 256, axis=1)
    child[0] = 0
    bits = np.zeros((first[-1], width, len(langs)), np.float32)
    column = np.concatenate([np.ones(len(known)), [256 - len(known)]])[:, None]  # bytes behind each column
    before = None
    for order in range(ORDER + 1):
        lang, gram, n = counts[order]
        own = contexts[order]
        table = np.zeros((len(own), width, len(langs)))
        np.add.at(table, (np.searchsorted(own, gram >> 8), symbol[gram & 255], lang), n)
        if order:
            parent = np.searchsorted(contexts[order - 1], suffix(own, order))
            child[first[order - 1] + parent, own >> 8 * (order - 1)] = first[order] + np.arange(len(own))
            shorter = before[parent]
        else:
            shorter = np.full((1, width, len(langs)), 1 / 256)
        seen = table > 0
        total, distinct = table.sum(axis=1, keepdims=True), seen.sum(axis=1, keepdims=True)
        rest = (np.where(seen, 0, shorter) * column).sum(axis=1, keepdims=True)
        # A full context has nothing to escape to; a context that a language's tree lacks costs nothing to leave.
        escape = np.where(rest > 0, distinct / np.maximum(total + distinct, 1), 0.0)
        share = (1 - escape) * table / np.maximum(total, 1)
        below = np.where(total > 0, escape * shorter / np.where(rest > 0, rest, 1), shorter)
        before = np.where(seen, share, below)
        bits[first[order] : first[order + 1]] = -np.log2(np.maximum(before, 1e-300))
    return Model(langs, symbol, child.astype(np.int16) if len(child) < 1 << 15 else child, bits)


def learn(docs: DataFrame, sample: int = SAMPLE, nodes: int = NODES) -> Forest | None:
    """docs(doc_id, text, lang): the model of a bounded sample of its labelled rows that are not held out."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~common.held_out())
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("_n"))
    n_langs = sizes.count()
    if not n_langs:
        return None
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = labelled.join(common.small(sizes), "lang").filter(unit < sample / F.col("_n")).select("text", "lang")
    counted = common.written(chosen.mapInArrow(counter, "lang string, order long, gram long, n long").groupBy("lang", "order", "gram").agg(F.sum("n").alias("n")), "langid-counts")
    context = F.shiftright("gram", 8).alias("context")
    totals = counted.groupBy("lang", "order", context).agg(F.sum("n").alias("total"))
    # The root counts as a node; suffixes, at least as frequent and shorter, come before the contexts they serve.
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("order") > 0, F.desc("total"), "order", "context"))
    kept = totals.withColumn("rank", rank).filter(F.col("rank") <= max(1, nodes)).select("lang", "order", "context")
    table = counted.withColumn("context", context).join(kept, ["lang", "order", "context"]).select("lang", "order", "gram", "n").toArrow()
    if not table.num_rows:
        return None
    langs = sorted(set(table.column("lang").to_pylist()))
    number = table.column("lang").combine_chunks().dictionary_encode()
    lang = np.array([langs.index(v) for v in number.dictionary.to_pylist()])[number.indices.to_numpy()]
    order, gram, n = (table.column(c).to_numpy() for c in ("order", "gram", "n"))
    step = TOGETHER if len(langs) <= FEW else 1
    by_lang = np.argsort(lang, kind="stable")
    bounds = np.searchsorted(lang[by_lang], np.arange(0, len(langs) + step, step))
    parts = []
    for i, at in enumerate(np.split(by_lang, bounds[1:-1])):
        of = [at[order[at] == k] for k in range(ORDER + 1)]
        parts.append(build(langs[i * step : (i + 1) * step], {k: (lang[of[k]] - i * step, gram[of[k]].astype(np.int64), n[of[k]]) for k in range(ORDER + 1)}))
    return Forest(parts)


def scorer(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        names = np.array([*m.langs, "und"], dtype=object)
        for batch in batches:
            for part in bytes_of.steps(batch, size=1 << 20):
                data, rows = bytes_of.view(part.column("text"))
                bits = m.lengths(data, rows)
                best = bits.argmin(axis=1)
                # Confidence by code length gained, tempered by text length: bytes are not independent evidence.
                gap = (bits - bits.min(axis=1, keepdims=True)) / np.sqrt(np.maximum(np.diff(rows), 1))[:, None]
                sure = 1 / np.exp2(-gap).sum(axis=1)
                letter = part.column("letter").to_numpy(zero_copy_only=False)
                best[~letter] = len(m.langs)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(names[best], pa.string()), pa.array(np.where(letter, sure, 0.0))], names=["doc_id", "held_out", "lang_pred", "score"])

    return score


def predict(docs: DataFrame, model: Forest | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score)."""
    spark = docs.sparkSession
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", common.held_out().alias("held_out"), letter)
    if model is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    return rows.mapInArrow(scorer(spark.sparkContext.broadcast(model)), "doc_id long, held_out boolean, lang_pred string, score double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return predict(docs.select("doc_id", "text"), learn(docs.select("doc_id", "text", "lang")))
