"""Grouping keys: joins that keep null keys, and per-key statistics attached to rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from predaudit.functions.lineage import store

FEW_KEYS = 100_000  # rows of statistics, some ten numbers each
METRIC_COLUMNS = ("analysis", "attribute", "group", "metric", "value")


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", small: bool = False) -> DataFrame:
    """Equi-join on ``keys`` where null matches null. Spark picks the way by measured size, unless ``small`` says that the right side is known to be small.

    Keys named ``column`` or starting with ``_`` are the library's own and never null.
    """
    twin = {k: f"__{k}" for k in keys}
    renamed = right.select(
        *[F.col(k).alias(twin[k]) for k in keys],
        *[F.col(c) for c in right.columns if c not in twin],
    )
    # only keys that may be null need the null-safe form, which hashes two values per key
    nullable = {k for k in keys if left.schema[k].nullable and not k.startswith("_") and k != "column"}
    same = [
        F.col(k).eqNullSafe(F.col(twin[k])) if k in nullable else F.col(k) == F.col(twin[k]) for k in keys
    ]
    on = reduce(lambda a, b: a & b, same)
    return left.join(renamed.hint("broadcast") if small else renamed, on, how).drop(*twin.values())


def attach(df: DataFrame, stats: DataFrame, by: Sequence[str], name: str = "_stats", small: bool = False) -> DataFrame:
    """Add the statistics of each row's key as a struct column.

    Without keys ``stats`` is one row by construction (a global aggregate) and becomes a scalar
    subquery, so the rows are neither joined nor shuffled. Nor are they with ``small`` statistics, which are known to have few keys.
    """
    fields = F.struct(*[F.col(c) for c in stats.columns if c not in by])
    if not by:
        return df.withColumn(name, stats.select(fields).scalar())
    return join_on(df, stats.select(*by, fields.alias(name)), by, "left", small)


def measured(stats: DataFrame, by: Sequence[str]) -> tuple[DataFrame, bool]:
    """Statistics per key, and whether they have at most ``FEW_KEYS`` keys, so that they may be broadcast: they are computed and counted here."""
    if not by:
        return stats, True
    stored = store(stats, "statistics")
    return stored, stored.count() <= FEW_KEYS


def group(df: DataFrame, by: Sequence[str], *aggregates: Column) -> DataFrame:
    """Aggregate per key, or over the whole table when there is no key."""
    return df.groupBy(*by).agg(*aggregates) if by else df.agg(*aggregates)


def tall(
    df: DataFrame,
    by: Sequence[str],
    analysis: str,
    metrics: Sequence[str],
    attribute: str | None = None,
    group_column: str | None = None,
) -> DataFrame:
    """Wide metric columns to ``(by…, analysis, attribute, group, metric, value)``; null and NaN dropped."""
    text = F.lit(None).cast("string")
    ids = df.select(
        *by,
        F.lit(analysis).alias("analysis"),
        (F.col(attribute) if attribute else text).alias("attribute"),
        (F.col(group_column) if group_column else text).alias("group"),
        *[F.col(m).cast("double").alias(m) for m in metrics],
    )
    kept = [*by, "analysis", "attribute", "group"]
    return ids.unpivot(kept, list(metrics), "metric", "value").where(F.col("value").isNotNull() & ~F.isnan("value"))
