"""The value table: every distinct value of every column with its count, in one shuffle.

Distinct counts, modes, exact percentiles, outlier counts and class balance all read from it, so
the source is scanned and shuffled once. Counting before the shuffle collapses hot values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from predaudit.functions.keys import attach, group
from predaudit.functions.safe import FLOATING, INTEGRAL, clean

VALUE_COLUMNS = {"column": "string", "as_long": "long", "as_double": "double", "as_text": "string", "n": "long"}
PROFILED = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def profiled_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns with comparable values; arrays, maps, structs and binaries are only null-counted."""
    return [c for c in columns if isinstance(df.schema[c].dataType, PROFILED)]


def _typed(df: DataFrame, name: str) -> tuple[Column, Column, Column]:
    """(integer, floating, text) views of a column; exactly one is used, so no precision is lost."""
    no_long, no_double, no_text = (F.lit(None).cast(t) for t in ("long", "double", "string"))
    dtype = df.schema[name].dataType
    if isinstance(dtype, INTEGRAL):
        return F.col(name).cast("long"), no_double, no_text
    if isinstance(dtype, (*FLOATING, T.DecimalType)):
        return no_long, clean(df, name).cast("double"), no_text
    return no_long, no_double, F.col(name).cast("string")


def value_table(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(by…, column, as_long, as_double, as_text, n)``; a missing value is the all-null row."""
    columns = profiled_columns(df, columns)
    parts: list[Column] = []
    for c in columns:
        parts += [F.lit(c), *_typed(df, c)]
    if not columns:
        nothing = [F.lit(None).cast(t).alias(c) for c, t in VALUE_COLUMNS.items()]
        return df.select(*by, *nothing).where(F.lit(False))
    rows = df.select(
        *by, F.stack(F.lit(len(columns)), *parts).alias("column", "as_long", "as_double", "as_text")
    )
    return rows.groupBy(*by, "column", "as_long", "as_double", "as_text").agg(F.count(F.lit(1)).alias("n"))


def present() -> Column:
    return F.coalesce(F.col("as_long").isNotNull() | F.col("as_double").isNotNull(), F.lit(False)) | F.col(
        "as_text"
    ).isNotNull()


def number() -> Column:
    return F.coalesce(F.col("as_double"), F.col("as_long").cast("double"))


def numbers(values: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Numeric rows of a value table as ``(by…, column, v, n)``."""
    return values.select(*by, "column", number().alias("v"), "n").where(F.col("v").isNotNull())


def few_values(df: DataFrame, column: Column, by: Sequence[str], limit: int, name: str = "value") -> DataFrame:
    """``(by…, value, n)`` for the keys with at most ``limit`` distinct values; others give no row.

    Values are counted before the shuffle, and the number of distinct ones is attached to the counts.
    """
    rows = df.select(*by, column.alias(name)).where(F.col(name).isNotNull())
    counted = rows.groupBy(*by, name).agg(F.count(F.lit(1)).alias("n"))
    distinct = group(counted, by, F.count(F.lit(1)).alias("distinct"))
    return attach(counted, distinct, by, "_few").where(F.col("_few.distinct") <= limit).drop("_few")
