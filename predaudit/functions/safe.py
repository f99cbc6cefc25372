"""Arithmetic that never throws under ANSI mode and treats NaN as missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATING = (T.FloatType, T.DoubleType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
TEXTUAL = (T.StringType, T.CharType, T.VarcharType)
TEMPORAL = (T.TimestampType, T.TimestampNTZType, T.DateType)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def numeric_columns(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    wanted = df.columns if columns is None else columns
    return [c for c in wanted if is_numeric(df.schema[c].dataType)]


def text_columns(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    wanted = df.columns if columns is None else columns
    return [c for c in wanted if isinstance(df.schema[c].dataType, TEXTUAL)]


def div(a: Column, b: Column) -> Column:
    """a / b as double, null when b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def div0(a: Column, b: Column) -> Column:
    """a / b, 0 when b is 0."""
    return F.coalesce(div(a, b), F.lit(0.0))


def clean(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into null."""
    c = F.col(name)
    if isinstance(df.schema[name].dataType, FLOATING):
        return F.when(~F.isnan(c), c)
    return c


def clean_double(df: DataFrame, name: str) -> Column:
    return clean(df, name).cast("double")


def is_missing(df: DataFrame, name: str) -> Column:
    c = F.col(name)
    if isinstance(df.schema[name].dataType, FLOATING):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def finite(c: Column) -> Column:
    """NaN, which infinite inputs leave in moments and which compares above every number, as null."""
    return F.when(~F.isnan(c), c)


def corr(a: Column, b: Column) -> Column:
    """Pairwise-complete Pearson correlation, null for a constant or empty side.

    ``F.corr`` divides by zero under ANSI mode when a side is constant.
    """
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return finite(div(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def r2(squared_residuals: Column, n: Column, truth_variance: Column) -> Column:
    """1 - SSR/SST from aggregates; a constant truth scores 1 if perfect, else 0; null below 2 rows."""
    sst = n.cast("double") * truth_variance
    return F.when(sst > 0, 1.0 - F.try_divide(squared_residuals, sst)).when(
        n > 1, F.when(squared_residuals == 0, 1.0).otherwise(0.0)
    )
