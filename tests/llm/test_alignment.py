"""Token alignment against a plain version that encodes every text by itself and walks its bytes."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer
from tokenizers.decoders import ByteLevel

from brackwater.llm import alignment, common, tokens

DATA = "/root/testdata/sf0.001"
A_PATH, B_PATH = tokens.vocabulary(alignment.BYTES), tokens.vocabulary(alignment.PIECES)
ODD = [
    (1, "plain words, and 12 numbers don't stop"),
    (2, None),
    (3, ""),
    (4, "  spaces   inside \n\n and\tends  "),
    (5, "a ▁ mark that no piece spells"),
    (6, "<|endoftext|> and </s> and <0x41> are text <|endoftext|>"),
    (7, "é ü \U0001f600\U0001f468‍\U0001f469 日本語 текст \u0000\x7f"),
    (8, "word" * 40_000),
    (9, "the same text"),
    (9, "the same text"),
    (None, "the same text"),
    (10, " "),
    (11, "x"),
    (12, "several words of one long line " * 8_000),
]


def plain_tokens(text, a, b):
    """(id, bytes) of both kinds, or nothing where they do not spell the text."""
    if not text:
        return [], []
    whole = (" " + text).encode()
    table = {c: i for c, i in alignment.byte_of_character().items()}
    left = [(i, bytes(table[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        right.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    return (left, right) if b"".join(x[1] for x in left) == whole == b"".join(x[1] for x in right) else ([], [])


def spans(toks):
    at = 0
    for i, raw in toks:
        yield i, at, at + len(raw)
        at += len(raw)


def plain(docs):
    a, b = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a.encode_special_tokens = True
    rows, pair_docs = [], Counter()
    for doc_id, text in docs:
        left, right = plain_tokens(text, a, b)
        left, right = list(spans(left)), list(spans(right))
        links, j = [], 0
        for i, begin, end in left:
            while j < len(right) and right[j][2] <= begin:
                j += 1
            k = j
            while k < len(right) and right[k][1] < end:
                links.append((i, right[k][0]))
                k += 1
        common_ends = sorted({x[2] for x in left} & {x[2] for x in right})
        groups, begin = defaultdict(lambda: ([], [])), 0
        bound = {}
        for g, end in enumerate(common_ends):
            bound[end] = g
        for side, toks in enumerate((left, right)):
            g = 0
            for i, _, end in toks:
                groups[g][side].append(str(i))
                g += end in bound
        text_of = ";".join(f"{','.join(groups[g][0])}|{','.join(groups[g][1])}" for g in range(len(common_ends)))
        pair_docs.update(set(links))
        rows.append((doc_id, len(left), len(right), len(common_ends), links, hashlib.sha256(text_of.encode()).hexdigest() if text_of else ""))
    best = Counter()
    for (i, _), n in pair_docs.items():
        best[i] = max(best[i], n)
    return sorted(repr((d, n, m, g, len(links), sum(pair_docs[x] == best[x[0]] for x in links), sum(pair_docs[x] for x in links), sha)) for d, n, m, g, links, sha in rows)


def got(df):
    return sorted(repr(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("clash", [False, True])
def test_odd_texts(spark, clash):
    rng = random.Random(2)
    docs = ODD + [(100 + i, "".join(rng.choice(["a", "the ", " of", "\n", "é", "12", "Ww", " ", "'s", "—", "straße"]) for _ in range(rng.randrange(30)))) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    if clash:
        df = df.selectExpr("*", "1 as key", "2 as n", "3 as keys", "4 as times", "5 as n_a", "6 as count_sum", "7 as best", "8 as path")
    assert got(alignment.align_documents(df, A_PATH, B_PATH)) == plain(docs)


def test_whole_table(spark):
    docs = [tuple(r) for r in common.table(spark, DATA, "documents").select("doc_id", "text").collect()]
    assert got(alignment.op13_align_tokens(spark, DATA)) == plain(docs)


def test_no_rows(spark):
    assert alignment.align_documents(spark.createDataFrame([], "doc_id long, text string"), A_PATH, B_PATH).count() == 0
    assert got(alignment.align_documents(spark.createDataFrame([(1, None)], "doc_id long, text string"), A_PATH, B_PATH)) == [repr((1, 0, 0, 0, 0, 0, 0, ""))]


def test_little_is_held_at_once(spark, monkeypatch):
    """Partial counts that are handed on many times, and batches of a row, give the same."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    lists = [np.unique(rng.integers(0, 50, 20)).astype(np.int64) for _ in range(60)]
    monkeypatch.setattr(alignment, "HELD", 30)
    batches = [pa.RecordBatch.from_pydict({"keys": pa.array([x.tobytes() for x in lists[i : i + 7]], pa.binary())}) for i in range(0, 60, 7)]
    total = Counter()
    parts = list(alignment.partial_counts(iter(batches)))
    for b in parts:
        total.update(dict(zip(b.column("key").to_pylist(), b.column("n").to_pylist(), strict=True)))
    assert len(parts) > 5 and total == Counter(np.concatenate(lists).tolist())


def test_shards_that_are_not_local(spark, monkeypatch):
    docs = [(i, t) for i, t in ODD if t]
    monkeypatch.setattr(alignment, "opened", lambda system, path: system.open_input_stream(path, compression=None))
    folder = common.new_dir(spark, "pairs")
    rows = alignment.aligned(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), A_PATH, B_PATH)
    ranges, best = alignment.count_pairs(rows, folder, alignment.byte_tokenizer(A_PATH).get_vocab_size())
    shards = alignment.Shards(folder, ranges)
    every = np.unique(np.frombuffer(b"".join(r["keys"] for r in rows.select("keys").collect()), np.int64))
    counts = shards.counts(every)
    plain_counts = Counter(np.concatenate([np.frombuffer(r["keys"], np.int64) for r in rows.select("keys").collect()]).tolist())
    assert counts.tolist() == [plain_counts[k] for k in every.tolist()]
    for key, n in plain_counts.items():
        assert best[key >> 32] >= n


def test_vocabulary_rules():
    """Characters stand for the bytes that the library's own decoder gives, and words part at spaces."""
    of = alignment.byte_of_character()
    assert sorted(of.values()) == list(range(256))
    assert all(ByteLevel().decode([c]) == chr(b) for c, b in of.items() if b < 128)
    assert alignment.parts_at_spaces(B_PATH)
