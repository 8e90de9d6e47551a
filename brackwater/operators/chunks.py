"""Pages cut into chunks of whole sentences, as a table function: one row in, its chunks out."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens of a chunk, and of what it repeats of the one before.
SIZE, OVERLAP = 512, 64
TOKEN = re.compile(r"\w+|[^\w\s]")
#: A sentence runs to its end marks and the white space behind them, or to a line's end.
SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?]+(?=\s|$)\s*|\n\s*|[.!?]+|$)")


def sentences(text: str) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of sentences that together are the text; marks within words do not end one."""
    out, start, n = [], 0, 0
    for m in SENTENCE.finditer(text):
        piece = m.group()
        if not piece:
            continue
        n += len(TOKEN.findall(piece))
        if piece[-1].isspace() or m.end() == len(text):
            if n == 0 and out:  # white space belongs to what it follows
                out[-1] = (out[-1][0], m.end(), out[-1][2])
            else:
                out.append((start, m.end(), n))
            start, n = m.end(), 0
    return out


class Chunker:
    """Fills chunks sentence by sentence; each begins with the last whole sentences of the one before that fit the overlap.

    A sentence of more than a chunk's tokens is a chunk of its own. What is held is a page's sentences, as three numbers each.
    """

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple]:
        all_ = sentences(text or "")
        number = begin = at = 0
        while at < len(all_):
            total = sum(s[2] for s in all_[begin:at])
            fresh = at
            while at < len(all_) and (total + all_[at][2] <= size or at == begin):
                total += all_[at][2]
                at += 1
            yield number, all_[begin][0], all_[fresh][0], all_[at - 1][1], total
            number += 1
            if at == len(all_):
                return
            begin, carried = at, 0
            while begin > fresh and carried + all_[begin - 1][2] <= min(overlap, size - all_[at][2]):
                begin -= 1
                carried += all_[begin][2]


def chunked(pages: DataFrame, keys: list[str], text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(keys, chunk, start, fresh, end, n_tokens, text): chunks of each row of ``pages``, with their places in its text in code
    points; what stands before ``fresh`` is repeated from the chunk before. Null and empty texts have no chunks."""
    make = F.udtf(Chunker, returnType="chunk int, start int, fresh int, `end` int, n_tokens int", useArrow=True)
    rows = pages.select(*keys, F.col(text).alias("_text"))
    found = rows.lateralJoin(make(F.col("_text").outer(), F.lit(size), F.lit(overlap)))
    return found.select(*keys, "chunk", "start", "fresh", "end", "n_tokens", F.substring(F.col("_text"), F.col("start") + 1, F.col("end") - F.col("start")).alias("text"))
