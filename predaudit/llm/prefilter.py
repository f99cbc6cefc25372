"""Fixed-size bitmaps that spare most rows of a wide table a shuffle, before an exact join decides.

A bitmap of hashed keys has ``BUCKETS`` rows of 4 KiB whatever the number of keys, so it may be broadcast; with very many
keys it fills up, lets every row pass and costs nothing but the test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 32_768  # of one bitmap of Spark's bitmap functions
BUCKETS = 1024  # 4 MiB in all


def _marked(df: DataFrame, column: str, keys: DataFrame, name: str) -> tuple[DataFrame, Column]:
    """``df`` with the bitmaps of ``keys``, and the test whether a row's key may be among them."""
    at = F.pmod(F.xxhash64(F.col(column)), F.lit(BUCKETS * BITS))
    bitmaps = (
        keys.select(at.alias("_at")).groupBy(F.floor(F.col("_at") / BITS).alias(f"_bucket_{name}"))
        .agg(F.bitmap_construct_agg(F.pmod("_at", F.lit(BITS))).alias(f"_bits_{name}"))
    )
    joined = df.join(bitmaps.hint("broadcast"), F.floor(at / BITS) == F.col(f"_bucket_{name}"), "left")
    bit = F.pmod(at, F.lit(BITS)).cast("int")
    byte = F.substring(f"_bits_{name}", F.floor(bit / 8).cast("int") + 1, F.lit(1))
    return joined, F.coalesce(F.getbit(F.conv(F.hex(byte), 16, 10).cast("long"), bit % 8) == 1, F.lit(False))


def likely_in(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows whose ``column`` is among ``keys``, and a few others. ``keys`` has the one column of the same name."""
    joined, likely = _marked(df, column, keys, "in")
    return joined.where(likely).select(*[F.col(c) for c in df.columns])


def split(df: DataFrame, column: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``column`` is certainly not among ``keys``, and all others."""
    joined, likely = _marked(df, column, keys, "in")
    columns = [F.col(c) for c in df.columns]
    return joined.where(~likely).select(*columns), joined.where(likely).select(*columns)


def without(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows whose ``column`` is not among ``keys`` (exactly; null never is). Rows the bitmap clears are not shuffled."""
    clear, doubtful = split(df, column, keys)
    return clear.unionByName(doubtful.join(keys, column, "left_anti").select(*[F.col(c) for c in df.columns]))


def among(df: DataFrame, column: str, wanted: DataFrame, others: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows whose ``column`` is in one of two disjoint sets of keys: those certainly in ``wanted``, and the doubtful ones."""
    first, in_wanted = _marked(df, column, wanted, "in")
    both, in_others = _marked(first, column, others, "out")
    columns = [F.col(c) for c in df.columns]
    return both.where(in_wanted & ~in_others).select(*columns), both.where(in_wanted & in_others).select(*columns)
