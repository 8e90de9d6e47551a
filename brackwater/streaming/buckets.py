"""Keys of a stream kept by the bucket: what a call of a state costs is paid once for many keys.

A key is always in the same bucket, by its hash. What is kept of the keys of a bucket is one value, so that a task holds one
bucket, a part in ``COUNT`` of all keys.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets of a stream; a fixed value, as state is found by it.
COUNT = 1024
#: The column of the key; names that begin with an underscore are lost on the way to pandas.
KEY = "bucket_key"


def dealt(stream: DataFrame, key: str):
    """The stream grouped by bucket; ``KEY`` is the key as text, so that nulls do not change its type in pandas."""
    named = stream.withColumn(KEY, F.col(key).cast("string"))
    return named.withColumn("bucket_number", F.pmod(F.xxhash64(KEY), F.lit(COUNT)).cast("int")).groupBy("bucket_number")


def micros(times: pd.Series) -> list[int]:
    return times.to_numpy().astype("datetime64[us]").astype("int64").tolist()


def by_key(frames: Iterable[pd.DataFrame], at: str, columns: list[str]) -> dict:
    """{key: rows (at, columns)} of a bucket, times in microseconds; rows with a null time are left out."""
    found: dict = {}
    for frame in frames:
        for ok, key, *row in zip(frame[at].notna().tolist(), frame[KEY].tolist(), micros(frame[at]), *(frame[c].tolist() for c in columns), strict=True):
            if ok:
                found.setdefault(key, []).append(row)
    return found


def packed(keys: dict) -> bytes:
    return pickle.dumps(keys, pickle.HIGHEST_PROTOCOL)


def unpacked(keys: bytes) -> dict:
    return pickle.loads(bytes(keys))
