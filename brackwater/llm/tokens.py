"""Token identifiers of whole texts with a public tokenizer, equal cuts of a batch encoded once.

Both vocabularies split a text before they merge, and never across the places used here: ``word`` drops white space, so a
text is cut before every run of ASCII white space, and where one of ``MARKS`` follows an ASCII letter; ``byte`` lets a space
open the word behind it, so a text is cut before a space that touches a printable ASCII character on either side, where one of
``MARKS`` follows an ASCII letter or digit, between those two, and around a line end between printable ASCII characters. Cuts
are encoded once each and gathered back by index: the same identifiers for a fraction of the work. A worker keeps up to
``KEEP`` encoded cuts from batch to batch. New cuts are encoded many to a call: ``word`` cuts with a separator between them,
``byte`` cuts that begin with a space behind one another, parted again by the bytes that each identifier stands for.
"""

from __future__ import annotations

import functools
import json
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import bytes_of

KEEP = 300_000
MARKS = b".,;:!?%&$*#"
#: A byte that is a token of its own between spaces.
SEPARATOR = "\x00"
JOIN = 1000
#: Identifiers of cuts by vocabulary, as bytes: a fraction of what small arrays take.
_seen: dict[tuple[str, str], dict[str, bytes]] = {}


@functools.lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file, wherever it is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def byte_lengths(path: str) -> np.ndarray:
    """Bytes that each identifier of a byte-level vocabulary stands for: one for each character of its name."""
    vocabulary = tokenizer(path).get_vocab(with_added_tokens=True)
    out = np.zeros(max(vocabulary.values()) + 1, np.int64)
    out[list(vocabulary.values())] = [len(name) for name in vocabulary]
    return out


@functools.lru_cache(maxsize=4)
def joinable(path: str) -> bool:
    """Whether the vocabulary is byte-level and neither changes nor adds bytes, so that identifiers can be parted by bytes."""
    with open(path) as file:
        made = json.load(file)
    return made.get("normalizer") is None and not (made.get("pre_tokenizer") or {}).get("add_prefix_space", True)


def encode_bytes(words: list[str], path: str) -> list[np.ndarray]:
    """Identifiers of cuts of texts. Those with a space before and a printable character at the end are encoded in a row."""
    t = tokenizer(path)
    out: list = [None] * len(words)
    row = [i for i, w in enumerate(words) if w[0] == " " and "!" <= w[-1] <= "~"] if joinable(path) else []
    inside = set(row)
    rest = [i for i in range(len(words)) if i not in inside]
    for i, e in zip(rest, t.encode_batch_fast([words[i] for i in rest], add_special_tokens=False), strict=True):
        out[i] = np.array(e.ids, dtype=np.uint32)
    for at in range(0, len(row), JOIN):
        part = row[at : at + JOIN]
        ids = np.array(t.encode_batch_fast(["".join(words[i] for i in part)], add_special_tokens=False)[0].ids, dtype=np.uint32)
        ends = np.searchsorted(np.cumsum(byte_lengths(path)[ids]), np.cumsum([len(words[i].encode()) for i in part])) + 1
        for i, a, b in zip(part, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            out[i] = ids[a:b]
    return out


def encode_words(words: list[str], path: str) -> list[np.ndarray]:
    """Identifiers of texts of one vocabulary word or a few: joined by a separator, encoded at once, parted again."""
    t = tokenizer(path)
    mark = t.encode(SEPARATOR, add_special_tokens=False).ids
    odd = [i for i, w in enumerate(words) if SEPARATOR in w] if len(mark) == 1 else range(len(words))
    out: list = [None] * len(words)
    for i, e in zip(odd, t.encode_batch_fast([words[i] for i in odd], add_special_tokens=False), strict=True):
        out[i] = np.array(e.ids, dtype=np.uint32)
    rest = [i for i, ids in enumerate(out) if ids is None]
    for at in range(0, len(rest), JOIN):
        part = rest[at : at + JOIN]
        ids = np.array(t.encode_batch_fast([f" {SEPARATOR} ".join(words[i] for i in part)], add_special_tokens=False)[0].ids, dtype=np.uint32)
        ends = [*np.flatnonzero(ids == mark[0]).tolist(), len(ids)]
        begin = 0
        for i, end in zip(part, ends, strict=True):
            out[i] = ids[begin:end]
            begin = end + 1
    return out


def cut_offsets(data: np.ndarray, rows: np.ndarray, kind: str) -> np.ndarray:
    """Sorted distinct byte offsets at which texts are cut; row offsets are among them."""
    if kind == "word":
        space = (data == 32) | ((data >= 9) & (data <= 13))
        cut = space[1:] & ~space[:-1]
        lower = data | 32
        cut |= np.isin(data[1:], np.frombuffer(MARKS, np.uint8)) & (lower[:-1] >= 97) & (lower[:-1] <= 122) & (data[:-1] < 128)
    else:
        printable = (data > 32) & (data < 127)
        cut = np.zeros(max(len(data) - 1, 0), bool)
        cut[:] = (data[1:] == 32) & printable[:-1]
        cut[:-1] |= (data[1:-1] == 32) & printable[2:]
        lower = data | 32
        letter, digit = (lower >= 97) & (lower <= 122) & (data < 128), (data >= 48) & (data <= 57)
        cut |= np.isin(data[1:], np.frombuffer(MARKS, np.uint8)) & (letter | digit)[:-1]
        cut |= (letter[1:] & digit[:-1]) | (digit[1:] & letter[:-1])
        line = (data[1:-1] == 10) & printable[:-2] & printable[2:]
        cut[:-1] |= line
        cut[1:] |= line
    return bytes_of.cuts(cut, rows)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the runs [start, start + length), one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def encode(texts: pa.Array, path: str, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers (uint32) of all texts (null: empty), one after the other, and the n + 1 row offsets into them."""
    if kind == "word":
        texts = pc.ascii_lower(texts)  # as the vocabulary's own normaliser does
    data, rows = bytes_of.view(texts)
    cuts = cut_offsets(data, rows, kind)
    if len(cuts) < 2:
        return np.zeros(0, np.uint32), np.zeros(len(rows), np.int64)
    offsets = cuts.astype(np.int64)
    parts = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    words = parts.dictionary.to_pylist()
    seen = _seen.setdefault((path, kind), {})
    if len(seen) > KEEP:
        seen.clear()
    new = [w for w in words if w not in seen]
    seen.update(zip(new, (ids.tobytes() for ids in (encode_words if kind == "word" else encode_bytes)(new, path)), strict=True))
    ids = [seen[w] for w in words]
    lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    starts = np.cumsum(lengths) - lengths
    index = parts.indices.to_numpy()
    out = np.frombuffer(b"".join(ids), np.uint32)[ragged(starts[index], lengths[index])]
    at = np.concatenate([[0], np.cumsum(lengths[index])])
    return out, at[np.searchsorted(cuts, rows)]


def with_end(ids: np.ndarray, rows: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end`` behind each text."""
    n = len(rows) - 1
    out = np.full(len(ids) + n, end, dtype=np.uint32)
    keep = np.ones(len(out), bool)
    keep[rows[1:] + np.arange(n)] = False
    out[keep] = ids
    return out, rows + np.arange(n + 1)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
