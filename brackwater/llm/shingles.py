"""Word-shingle sets and their MinHash signatures, by array arithmetic over whole batches of text."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

from . import bytes_of

WORDS = 5
#: Odd multipliers of the word and shingle hashes (fixed, so that hashes are the same in every task).
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    one = np.ones(n, np.uint64)
    up, down = one * BASE, one * inverse
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def word_hashes(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (run of bytes above the space), and the n + 1 row offsets into them."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(rows), np.int64)
    word = data > 32
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    at_row = rows[:-1][rows[:-1] < len(data)]
    begins[at_row] = word[at_row]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    last = rows[1:][rows[1:] > 0] - 1
    ends[last] = word[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _powers(1 << max(20, int(len(data)).bit_length()))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:], dtype=np.uint64)
    return mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), np.searchsorted(start, rows)


def sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text. A text of fewer words is one shingle of all of them; no words, no shingle."""
    data, rows = bytes_of.view(texts)
    hashes, at = word_hashes(data, rows)
    full = max(len(hashes) - words + 1, 0)
    rolled = np.zeros(full, np.uint64)
    for k in range(words):
        rolled = rolled * BASE + hashes[k : k + full]
    rolled = mixed(rolled)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            whole = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for h in hashes[a:b]:
                    whole = whole * BASE + h
            out.append(mixed(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


@functools.lru_cache(maxsize=4)
def _permutations(n: int) -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(found: list[np.ndarray], n: int) -> np.ndarray:
    """MinHash signatures (uint32, a row a set); the row of an empty set is all ones."""
    out = np.full((len(found), n), np.iinfo(np.uint32).max, np.uint32)
    some = [i for i, s in enumerate(found) if len(s)]
    if some:
        every = np.concatenate([found[i] for i in some])
        at = np.cumsum([0, *(len(found[i]) for i in some)])[:-1]
        for k, a in enumerate(_permutations(n)):
            x = every * a
            x = ((x ^ (x >> np.uint64(29))) * MIX[0] >> np.uint64(32)).astype(np.uint32)
            out[some, k] = np.minimum.reduceat(x, at)
    return out


def set_id(found: np.ndarray) -> int:
    """64-bit identity of a sorted set."""
    n = len(found)
    up, _ = _powers(1 << max(20, n.bit_length()))
    return int((found * up[:n]).sum(dtype=np.uint64).astype(np.int64)) if n else 0
