"""What the operators of this subpackage share: tables, shared folders and row keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_path as new_dir
from ..sources.shared import shared_dir, written

__all__ = ["SMALL_ROWS", "held_out", "new_dir", "shared_dir", "small", "table", "text_of", "written"]

#: Rows that may be broadcast or brought to the driver after they have been counted.
SMALL_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def held_out(doc_id: str = "doc_id") -> Column:
    """True for rows whose labels may not be learned from (remainder 2); a null id hashes as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """Marks ``df`` for broadcasting if it has at most ``rows`` rows; else leaves the join to Spark."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
