"""String measures Spark has no expression for, as Arrow-batched functions."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def longest_common_substring(a: str, b: str) -> int:
    """Length of the longest run of characters that both have, by rows of a table."""
    x, y = np.frombuffer(a.encode("utf-32-le"), np.uint32), np.frombuffer(b.encode("utf-32-le"), np.uint32)
    best, row = 0, np.zeros(len(y) + 1, np.int32)
    for c in x:
        new = np.zeros_like(row)
        new[1:] = np.where(y == c, row[:-1] + 1, 0)
        best, row = max(best, int(new.max())), new
    return best


@F.pandas_udf(DoubleType())
def lcs_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Longest common substring of both texts, as a share of the first: by their words without marks, 800 characters at most."""
    short = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").lower()))[:800]
    pairs = [(short(x), short(y)) for x, y in zip(a, b, strict=True)]
    return pd.Series([longest_common_substring(x, y) / len(x) if x else None for x, y in pairs])
