"""Sentence chunks and the English filter against plain versions over whole tables."""

import re
from collections import Counter, defaultdict
from math import exp, log, sqrt

import pytest
from pyspark.sql import functions as F

from brackwater.operators import chunks, english
from brackwater.plans import catalog, chunk_queries

catalog.load()
DATA = "/root/testdata/sf0.001"


def count(text):
    return len(re.findall(r"\w+|[^\w\s]", text))


def plain_sentences(text):
    """Cut behind white space that follows end marks, or that holds a line's end."""
    cuts = [m.end() for m in re.finditer(r"[.!?]\s+|\n\s*", text) if m.end() < len(text)]
    parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
    out = []
    for p in parts:
        if out and not count(p):
            out[-1] += p
        else:
            out.append(p)
    return [p for p in out if p]


def plain_chunks(text, size, overlap):
    rest, out, carried = plain_sentences(text or ""), [], []
    while rest:
        chunk, new = list(carried), []
        while rest and (sum(map(count, [*chunk, *new, rest[0]])) <= size or not (chunk or new)):
            new.append(rest.pop(0))
        out.append((chunk, new))
        every = chunk + new
        room = min(overlap, size - count(rest[0])) if rest else 0
        carried = []
        for s in reversed(new):  # what was carried is not carried again
            if sum(map(count, carried)) + count(s) > room:
                break
            carried.insert(0, s)
        assert every
    return ["".join(a + b) for a, b in out], ["".join(b) for _, b in out]


@pytest.mark.parametrize(("size", "overlap"), [(512, 64), (20, 8), (3, 2)])
def test_chunks_are_those_of_a_plain_walk(spark, size, overlap):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(-1, None), (-2, ""), (-3, "   "), (-4, "No end"), (-5, "A b. " * 400), (-6, "w " * 3000 + ". Then more."), (-7, "3.14 is no end. e.g.this neither!?  But this\n\n is."), (-8, "\n\n Lead. x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = defaultdict(list)
    for r in chunks.chunked(df.withColumn("chunk", F.lit("clash")), ["doc_id"], size=size, overlap=overlap).collect():
        got[r.doc_id].append(r)
    for doc_id, text in rows:
        own = sorted(got[doc_id], key=lambda r: r.chunk)
        whole, fresh = plain_chunks(text, size, overlap)
        assert [r.text for r in own] == whole and [text[r.fresh : r.end] for r in own] == fresh
        assert "".join(text[r.fresh : r.end] for r in own) == (text or "") and all(r.text == text[r.start : r.end] and r.n_tokens == count(r.text) for r in own)
        assert all(r.n_tokens <= size or len(plain_sentences(r.text)) == 1 for r in own)
        assert all(count(text[r.start : r.fresh]) <= overlap for r in own)


def grams(text):
    t = f" {text.lower()}"
    for i in range(len(t) - 2):
        a, b, c = (ord(x) for x in t[i : i + 3])
        yield (((a * 961 + b * 31 + c) * 2654435761 % 2**64) >> 7) % english.BUCKETS


def plain_english(text, weight):
    def score(s):
        w = [weight[g] for g in grams(s)]
        return 1 / (1 + exp(-max(-500.0, min(500.0, sum(w) / sqrt(max(len(w), 1))))))

    def ok(s):
        label = len(s) <= 80 and re.search("[A-Za-z]{2}", s) and sum(ord(c) > 127 for c in s) / len(s) < 0.12
        return score(s) >= 0.85 if len(s) >= 24 else bool(score(s) >= 0.5 or label)

    if not text or not text.strip():
        return text
    out = []
    for block in re.split(r"\n\s*\n", text):
        block = block.strip()
        lines = [x.strip() for x in block.split("\n") if x.strip()]
        if block and ok(block):
            out.append(block)
        elif len(lines) > 1:
            out.append("\n".join(x for x in lines if ok(x)))
    return "\n\n".join(x for x in out if x) or text


def test_english_is_what_a_plain_version_keeps(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("held", chunk_queries.held_out()).collect()
    n = {True: Counter(), False: Counter()}
    for r in docs:
        if not r.held and r.text is not None and r.lang is not None:
            n[r.lang == "en"].update(grams(r.text))
    share = {k: [(n[k][b] + 0.5) / (n[k].total() + 0.5 * english.BUCKETS) for b in range(english.BUCKETS)] for k in n}
    weight = [log(share[True][b]) - log(share[False][b]) for b in range(english.BUCKETS)]
    got = {r.doc_id: r.text for r in catalog.QUERIES["english_texts"](spark, DATA).collect()}
    assert got == {r.doc_id: plain_english(r.text, weight) for r in docs}
    odd = [None, "", " \n ", "The end of the day and the night\n\nDas ist nicht so gut, sondern schlecht\nand that is the other thing here\nnoch ein deutscher Satz ist das", "x\n\n\n\ny"]
    assert english.kept(odd, english.np.array(weight)) == [plain_english(t, weight) for t in odd]


def test_held_out_documents_are_told_apart(spark):
    weights = chunk_queries.scorer(spark, DATA)
    held = [r for r in spark.read.parquet(f"{DATA}/documents.parquet").filter(chunk_queries.held_out()).collect() if r.text and r.lang]
    right = [(c >= 0.5) == (r.lang == "en") for r, c in zip(held, english.chances([r.text for r in held], weights), strict=True)]
    assert len(held) > 30 and sum(right) / len(right) > 0.97


def test_pages_keep_their_place(spark):
    rows = catalog.QUERIES["ingested_pages"](spark, DATA).collect()
    turns = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect()}
    assert {(r.conv_id, r.page) for r in rows} == {k for k, t in turns.items() if t and t.strip()}
    by = defaultdict(list)
    for r in rows:
        by[r.conv_id, r.page].append(r)
    for own in by.values():
        own.sort(key=lambda r: r.chunk)
        assert [r.chunk for r in own] == list(range(len(own))) and own[0].start == 0 and all(a.end == b.fresh for a, b in zip(own, own[1:], strict=False))


def test_nothing_to_learn_from(spark):
    assert not english.fitted(spark.createDataFrame([(1, "x", "en"), (2, None, "de")], "doc_id long, text string, lang string")).any()
    assert english.kept(["Only so"], english.np.zeros(english.BUCKETS)) == ["Only so"]


def test_few_texts_are_held_at_once(spark, monkeypatch):
    """However many rows a batch has, the scorer and the filter see ``BYTES`` of text at a time, and all rows come through in order."""
    import pyarrow as pa

    monkeypatch.setattr(english, "BYTES", 100)
    seen, trigrams = [], english.trigrams
    monkeypatch.setattr(english, "trigrams", lambda texts: seen.append(sum(len(t) for t in texts)) or trigrams(texts))
    texts = ["the end of the day", None, "", "x" * 250, *["und das ist es nicht"] * 300, "é" * 60]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string()), "english": [bool(i % 2) for i in range(len(texts))]})
    assert [t for part in english.portions(batch, "text") for t in part.column("text").to_pylist()] == texts
    assert list(english.portions(batch.slice(0, 0), "text")) == []
    full = batch.filter(pa.compute.is_valid(batch.column("text")))
    (counted,) = english.counter(iter([full]))
    assert max(seen) == 250 and sorted(seen)[-2] <= 100 and len(seen) > 50
    monkeypatch.setattr(english, "BYTES", 1 << 30)
    assert next(english.counter(iter([full]))).equals(counted)
