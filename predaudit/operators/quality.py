"""Data quality: completeness, duplicates, column profiles, outliers, correlation and scores."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from predaudit.functions.gram import pair_correlations
from predaudit.functions.keys import attach, group, join_on, measured
from predaudit.functions.lineage import store
from predaudit.functions.ordered import marks, near_quantiles, quantiles, segments
from predaudit.functions.safe import (
    FLOATING,
    TEMPORAL,
    clean_double,
    div,
    div0,
    finite,
    is_missing,
    numeric_columns,
    text_columns,
)
from predaudit.functions.values import few_values, number, numbers, present, value_table
from predaudit.spec import QUALITY, AuditSpec

CHUNK_COLUMNS = 40  # columns per aggregation, keeps generated code within the JVM method limit
CHUNK_AGGREGATES = 300
FEW_CLASSES = 20
HIGH_CORRELATION = 0.95
HIGH_SKEW = 3.0
EXTREME_Z = 4.0
QUARTILES = (0.25, 0.75)

MOMENTS = ("mean", "std", "std_pop", "min", "max", "skewness", "kurtosis")


def data_columns(df: DataFrame, by: Sequence[str] = ()) -> list[str]:
    return [c for c in df.columns if c not in by]


def _chunks(items: Sequence, size: int) -> list[list]:
    return [list(items[i : i + size]) for i in range(0, len(items), size)]


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _missing_aggregates(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    missing = [is_missing(df, c) for c in columns]
    any_missing = F.array_contains(F.array(*missing), True) if missing else F.lit(False)
    return [
        F.count(F.lit(1)).alias("rows"),
        F.count_if(any_missing).alias("rows_with_missing"),
        *[F.count_if(m).alias(f"_m{i}") for i, m in enumerate(missing)],
    ]


def _missing_metrics(columns: Sequence[str]) -> dict[str, Column]:
    zero = F.lit(0).cast("long")
    counts = [F.col(f"_m{i}") for i in range(len(columns))]
    cells = F.col("rows") * F.lit(len(columns))
    # arrays, as long chains of additions are slow to optimise
    lost = F.aggregate(F.array(*counts), zero, lambda a, b: a + b) if counts else zero
    holed = F.size(F.filter(F.array(*counts), lambda c: c > 0)).cast("long") if counts else zero
    return {
        "rows": F.col("rows"),
        "columns": F.lit(len(columns)).cast("long"),
        "cells": cells,
        "missing_cells": lost,
        "completeness_rate": div(cells - lost, cells),
        "missing_percentage": 100.0 * div(lost, cells),
        "columns_with_missing": holed,
        "percentage_columns_with_missing": 100.0 * div(holed, F.lit(len(columns))),
        "rows_with_missing": F.col("rows_with_missing"),
        "percentage_rows_with_missing": 100.0 * div(F.col("rows_with_missing"), F.col("rows")),
    }


def completeness(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cells, columns and rows with missing values per key, in one aggregation."""
    columns = data_columns(df, by)
    counts = group(df, by, *_missing_aggregates(df, columns))
    return counts.select(*by, *[c.alias(k) for k, c in _missing_metrics(columns).items()])


def missing_by_column(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by…, column, missing_count, missing_percentage)``."""
    return column_moments(df, by).select(
        *by,
        "column",
        F.col("missing").alias("missing_count"),
        (100.0 * div(F.col("missing"), F.col("rows"))).alias("missing_percentage"),
    )


def column_moments(df: DataFrame, by: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """``(by…, column, rows, missing, mean, std, std_pop, min, max, skewness, kurtosis)``.

    A plain aggregation without a shuffle of the rows; moments are null for non-numeric columns.
    """
    columns = data_columns(df, by) if columns is None else list(columns)
    numeric = set(numeric_columns(df, columns))
    frames = []
    for chunk in _chunks(columns, CHUNK_COLUMNS):
        aggregates, parts = [F.count(F.lit(1)).alias("rows")], []
        for i, c in enumerate(chunk):
            aggregates.append(F.count_if(is_missing(df, c)).alias(f"_{i}_missing"))
            parts += [F.lit(c), F.col(f"_{i}_missing")]
            if c in numeric:
                v = clean_double(df, c)
                functions = (F.avg, F.stddev_samp, F.stddev_pop, F.min, F.max, F.skewness, F.kurtosis)
                aggregates += [f(v).alias(f"_{i}_{m}") for m, f in zip(MOMENTS, functions)]
                parts += [F.col(f"_{i}_{m}") for m in MOMENTS]
            else:
                parts += [F.lit(None).cast("double") for _ in MOMENTS]
        stacked = F.stack(F.lit(len(chunk)), *parts).alias("column", "missing", *MOMENTS)
        frames.append(group(df, by, *aggregates).select(*by, "rows", stacked))
    return _union(frames).select(*by, "column", "rows", "missing", *MOMENTS)


def row_digest(df: DataFrame, columns: Sequence[str]) -> Column:
    """SHA-256 over the typed values of the columns; equal where the rows are equal.

    Every value is written out with its length, so neighbours cannot run together, and null differs from any
    text. As in grouping, 0.0 equals -0.0 and NaN equals NaN. Nested values are written as JSON with
    microseconds.
    """
    times = {"timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}
    parts = []
    for c in columns:
        v, dtype = F.col(c), df.schema[c].dataType
        if isinstance(dtype, FLOATING):
            v = F.when(v == 0, F.lit(0).cast(dtype)).otherwise(v)
        if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
            text = F.to_json(F.struct(v), {**times, "ignoreNullFields": "false"})
        else:
            text = F.hex(v) if isinstance(dtype, T.BinaryType) else v.cast("string")
        parts.append(F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text)))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def duplicates(df: DataFrame, by: Sequence[str] = (), digest: bool = True) -> DataFrame:
    """``(by…, rows, distinct_rows, duplicate_rows, duplicate_percentage)``; nulls are equal.

    Copies collapse before the shuffle, which carries a digest of each row; ``digest=False`` compares the rows themselves.
    """
    columns = data_columns(df, by)
    if digest:
        rows, keys = df.select(*by, row_digest(df, columns).alias("_row")), [*by, "_row"]
    else:
        rows, keys = df, [*by, *columns]
    distinct = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies"))
    counted = group(
        distinct, by, F.coalesce(F.sum("_copies"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("distinct_rows")
    )
    copies = F.col("rows") - F.col("distinct_rows")
    return counted.select(
        *by,
        "rows",
        "distinct_rows",
        copies.alias("duplicate_rows"),
        (100.0 * div(copies, F.col("rows"))).alias("duplicate_percentage"),
    )


def value_summary(values: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by…, column, unique_values, most_frequent)``; the smallest value wins a tie."""
    top = F.min(F.struct(-F.col("n"), "as_long", "as_double", "as_text"))
    mode = F.coalesce(
        F.col("_top.as_text"), F.col("_top.as_long").cast("string"), F.col("_top.as_double").cast("string")
    )
    return (
        values.where(present())
        .groupBy(*by, "column")
        .agg(F.count(F.lit(1)).alias("unique_values"), top.alias("_top"))
        .select(*by, "column", "unique_values", mode.alias("most_frequent"))
    )


def column_profile(df: DataFrame, by: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: type, missing, distinct, mode and, for numbers, moments and the median."""
    columns = data_columns(df, by) if columns is None else list(columns)
    values = value_table(df, columns, by)
    keys = [*by, "column"]
    medians = quantiles(numbers(values, by), keys, "v", "n", (0.5,)).select(*keys, F.col("q")[0].alias("median"))
    types = F.create_map(*[F.lit(x) for c in columns for x in (c, df.schema[c].dataType.simpleString())])
    moments = column_moments(df, by, columns)
    joined = join_on(join_on(moments, value_summary(values, by), keys, "left"), medians, keys, "left")
    return joined.select(
        *keys,
        F.element_at(types, F.col("column")).alias("dtype"),
        F.col("missing").alias("missing_count"),
        (100.0 * div(F.col("missing"), F.col("rows"))).alias("missing_percentage"),
        F.coalesce("unique_values", F.lit(0)).alias("unique_values"),
        "most_frequent",
        "mean",
        "std",
        "min",
        "max",
        "median",
        "skewness",
        "kurtosis",
    )


def iqr_outliers(
    df: DataFrame, by: Sequence[str] = (), columns: Sequence[str] | None = None, accuracy: int | None = None
) -> DataFrame:
    """``(by…, column, n, q1, q3, outlier_count, outlier_percentage)`` for every numeric column.

    The quartiles come from :func:`near_quantiles` and a further pass counts, so values are counted and shuffled only with very many keys.
    ``accuracy`` takes the quartiles from a one-pass sketch.
    """
    columns = numeric_columns(df, data_columns(df, by) if columns is None else list(columns))
    if not columns:
        return _iqr(numbers(value_table(df, columns, by), by), by)
    names = [f"_{i}" for i in range(len(columns))]
    cleaned = df.select(*by, *[clean_double(df, c).alias(name) for name, c in zip(names, columns)])
    if accuracy is None:
        found = near_quantiles(cleaned, names, by, QUARTILES, CHUNK_COLUMNS)
        if found is None:
            return _iqr(numbers(value_table(df, columns, by), by), by)
        found = store(found, "quartiles")
    frames = []
    for chunk in _chunks(list(enumerate(columns)), CHUNK_COLUMNS):
        if accuracy is None:
            cuts = group(found, by, *[F.max(F.when(F.col("column") == f"_{i}", F.struct(F.col("q")[0], F.col("q")[1]))).alias(f"q{i}") for i, _ in chunk])
            cuts = cuts.select(*by, *[F.array(*[F.col(f"q{i}.col{k}") for k in (1, 2)]).alias(f"q{i}") for i, _ in chunk])
        else:
            cuts = group(cleaned, by, *[F.percentile_approx(f"_{i}", list(QUARTILES), accuracy).alias(f"q{i}") for i, _ in chunk])
        rows, counts, parts = attach(cleaned, cuts, by, "_at", small=accuracy is None), [], []
        for i, c in chunk:
            q = F.col(f"_at.q{i}")
            fence = 1.5 * (q[1] - q[0])
            outside = (F.col(f"_{i}") < q[0] - fence) | (F.col(f"_{i}") > q[1] + fence)
            counts += [F.count(f"_{i}").alias(f"n{i}"), F.max(q[0]).alias(f"a{i}"), F.max(q[1]).alias(f"b{i}"), F.count_if(outside).alias(f"x{i}")]
            parts += [F.lit(c), *[F.col(f"{x}{i}") for x in ("n", "a", "b", "x")]]
        stacked = F.stack(F.lit(len(chunk)), *parts).alias("column", "n", "q1", "q3", "outlier_count")
        frames.append(group(rows, by, *counts).select(*by, stacked).where("n > 0"))
    return _union(frames).withColumn("outlier_percentage", 100.0 * div(F.col("outlier_count"), F.col("n")))


def _iqr(counted: DataFrame, by: Sequence[str]) -> DataFrame:
    """Outliers from counted values. Without keys there is a row of quartiles per column, which may be broadcast; so may those of few keys."""
    keys = [*by, "column"]
    cuts = quantiles(counted, keys, "v", "n", QUARTILES).select(
        *keys, F.col("n"), F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3")
    )
    cuts, few = measured(cuts, by)
    fence = 1.5 * (F.col("q3") - F.col("q1"))
    if few:
        outside = (F.col("v") < F.col("q1") - fence) | (F.col("v") > F.col("q3") + fence)
        found = join_on(counted.withColumnRenamed("n", "times"), cuts, keys, small=True).groupBy(*keys).agg(
            F.max("n").alias("n"), F.max("q1").alias("q1"), F.max("q3").alias("q3"), F.sum(F.when(outside, F.col("times"))).alias("outlier_count")
        )
    else:
        fences = cuts.select(*keys, marks((F.col("q1") - fence, -1), (F.col("q3") + fence, 1)).alias("marks"))
        beyond = segments(counted, keys, "v", ["n"], fences).where("segment != 1").groupBy(*keys).agg(F.sum("n").alias("outlier_count"))
        found = join_on(cuts, beyond, keys, "left")
    return found.select(*keys, "n", "q1", "q3", F.coalesce("outlier_count", F.lit(0).cast("long")).alias("outlier_count")).withColumn(
        "outlier_percentage", 100.0 * div(F.col("outlier_count"), F.col("n"))
    )


def outlier_summary(outliers: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by…, outlier_percentage, columns_with_outliers)`` over all numeric values."""
    return group(
        outliers,
        by,
        (100.0 * div0(F.sum("outlier_count"), F.sum("n"))).alias("outlier_percentage"),
        F.count_if(F.col("outlier_count") > 0).alias("columns_with_outliers"),
    )


def extreme_values(
    df: DataFrame, z: float, by: Sequence[str] = (), columns: Sequence[str] | None = None, sample: bool = False
) -> DataFrame:
    """``(by…, column, n, extremes)``: values further than ``z`` standard deviations from the mean.

    Two narrow passes, one for the moments and one for the counts; rows are not shuffled.
    """
    columns = numeric_columns(df, data_columns(df, by) if columns is None else list(columns))
    deviation = F.stddev_samp if sample else F.stddev_pop
    frames = []
    for chunk in _chunks(columns, CHUNK_COLUMNS):
        cleaned = df.select(*by, *[clean_double(df, c).alias(f"_{i}") for i, c in enumerate(chunk)])
        moments = group(
            cleaned,
            by,
            *[f(f"_{i}").alias(f"{m}{i}") for i in range(len(chunk)) for m, f in (("m", F.avg), ("s", deviation))],
        )
        rows = attach(cleaned, moments, by, "_at")
        counts, parts = [], []
        for i, c in enumerate(chunk):
            score = F.try_divide(F.abs(F.col(f"_{i}") - F.col(f"_at.m{i}")), F.col(f"_at.s{i}"))
            counts += [F.count(f"_{i}").alias(f"n{i}"), F.count_if((score > z) & ~F.isnan(score)).alias(f"x{i}")]
            parts += [F.lit(c), F.col(f"n{i}"), F.col(f"x{i}")]
        stacked = F.stack(F.lit(len(chunk)), *parts).alias("column", "n", "extremes")
        frames.append(group(rows, by, *counts).select(*by, stacked))
    if not frames:
        nothing = [F.lit(None).cast(t).alias(c) for c, t in (("column", "string"), ("n", "long"), ("extremes", "long"))]
        return df.select(*by, *nothing).where(F.lit(False))
    return _union(frames)


def correlations(df: DataFrame, by: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """``(by…, a, b, corr)`` for every pair of numeric columns, on rows where both are present: one scan, no row is opened."""
    columns = numeric_columns(df, data_columns(df, by) if columns is None else list(columns))
    if len(columns) < 2:
        nothing = [F.lit(None).cast(t).alias(c) for c, t in (("a", "string"), ("b", "string"), ("corr", "double"))]
        return df.select(*by, *nothing).where(F.lit(False))
    found = pair_correlations(df, {c: clean_double(df, c) for c in columns}, by)
    names = F.array(*[F.lit(c) for c in columns])
    return found.select(*by, F.element_at(names, F.col("i") + 1).alias("a"), F.element_at(names, F.col("j") + 1).alias("b"), "corr")


def correlation_matrix(df: DataFrame, by: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """The full symmetric matrix, diagonal included, as ``(by…, a, b, corr)``."""
    columns = numeric_columns(df, data_columns(df, by) if columns is None else list(columns))
    upper = correlations(df, by, columns)
    lower = upper.select(*by, F.col("b").alias("a"), F.col("a").alias("b"), "corr")
    constant = column_moments(df, by, columns).select(
        *by, F.col("column").alias("a"), F.col("column").alias("b"), F.when(F.col("std_pop") > 0, 1.0).alias("corr")
    )
    return _union([upper, lower, constant])


def vector_quality(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """``(by…, missing, infinite, diversity)`` of predictions or truths; NaN and null are missing."""
    missing = is_missing(df, name)
    v = F.col(name)
    numeric = name in numeric_columns(df)
    infinite = F.abs(v.cast("double")) == float("inf") if numeric else F.lit(False)
    counted = df.select(*by, F.when(~missing, v).alias("_v"), infinite.alias("_i"))
    counts = counted.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n"), F.count_if("_i").alias("_inf"))
    return group(
        counts,
        by,
        F.coalesce(F.sum(F.when(F.col("_v").isNull(), F.col("_n"))), F.lit(0)).alias("missing"),
        F.coalesce(F.sum("_inf"), F.lit(0)).alias("infinite"),
        div(F.count(F.lit(1)), F.sum("_n")).alias("diversity"),
    )


def class_balance(df: DataFrame, column: str, by: Sequence[str] = (), limit: int = FEW_CLASSES) -> DataFrame:
    """``(by…, classes, class_balance_ratio)`` where the column has at most ``limit`` values."""
    counts = few_values(df, F.when(~is_missing(df, column), F.col(column)), by, limit)
    return group(
        counts, by, F.count(F.lit(1)).alias("classes"), div(F.min("n"), F.max("n")).alias("class_balance_ratio")
    ).where(F.col("classes") > 0)


def column_flags(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by…, column, zero_variance, highly_skewed)`` for numeric columns."""
    present_rows = F.col("rows") - F.col("missing")
    return (
        column_moments(df, by, numeric_columns(df, data_columns(df, by)))
        .where(present_rows > 0)
        .select(
            *by,
            "column",
            ((present_rows > 1) & (F.col("min") == F.col("max"))).alias("zero_variance"),
            F.coalesce(finite(F.abs("skewness")) > HIGH_SKEW, F.lit(False)).alias("highly_skewed"),
        )
    )


def profiling_summary(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Row count with the numbers of columns per kind, which come from the schema."""
    columns = data_columns(df, by)
    temporal = [c for c in columns if isinstance(df.schema[c].dataType, TEMPORAL)]
    sizes = {
        "total_columns": len(columns),
        "numeric_columns": len(numeric_columns(df, columns)),
        "categorical_columns": len(text_columns(df, columns)),
        "datetime_columns": len(temporal),
    }
    rows = group(df, by, F.count(F.lit(1)).alias("total_rows"))
    return rows.select(*by, "total_rows", *[F.lit(v).cast("long").alias(k) for k, v in sizes.items()])


def consistency(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by…, consistency)``: 0.1 off per category column that mixes lower case with other spelling."""
    texts = text_columns(df, data_columns(df, by))
    rows = group(df, by, F.count(F.lit(1)).alias("rows"))
    if not texts:
        return rows.select(*by, F.lit(1.0).alias("consistency"))
    text = F.col("as_text")
    lower = (text == F.lower(text)) & text.rlike(r"\p{Ll}")
    mixed = (
        value_table(df, texts, by)
        .where(text.isNotNull())
        .groupBy(*by, "column")
        .agg(F.count(F.lit(1)).alias("distinct"), F.count_if(lower).alias("lower"))
    )
    judged = attach(mixed, rows, by, "_r")
    bad = (
        (F.col("distinct") * 2 < F.col("_r.rows"))
        & (F.col("distinct") > 1)
        & (F.col("lower") > 0)
        & (F.col("lower") < F.col("distinct"))
    )
    flagged = group(judged, by, F.count_if(bad).alias("mixed"))
    score = F.greatest(F.lit(0.0), 1.0 - 0.1 * F.coalesce(F.col("_f.mixed"), F.lit(0)))
    return attach(rows, flagged, by, "_f").select(*by, score.alias("consistency"))


def validity(df: DataFrame, spec: AuditSpec, by: Sequence[str] = ()) -> DataFrame:
    """``(by…, validity)``: 0.3 off each for bad predictions and truths, 0.05 per extreme column."""
    penalties = []
    for name in (spec.prediction, spec.truth):
        if name:
            bad = is_missing(df, name)
            if name in numeric_columns(df):
                bad = bad | (F.abs(F.col(name).cast("double")) == float("inf"))
            penalties.append(0.3 * F.max(F.when(bad, 1).otherwise(0)))
    base = group(
        df, by, (F.lit(1.0) - reduce(lambda a, b: a + b, penalties, F.lit(0.0))).alias("_base")
    )
    wild = group(
        extreme_values(df, EXTREME_Z, by),
        by,
        F.count_if(F.col("extremes") > F.col("n") * 0.01).alias("wild"),
    )
    score = F.greatest(F.lit(0.0), F.col("_base") - 0.05 * F.coalesce(F.col("_w.wild"), F.lit(0)))
    return attach(base, wild, by, "_w").select(*by, score.alias("validity"))


def quality_scores(df: DataFrame, spec: AuditSpec, by: Sequence[str] = ()) -> DataFrame:
    """``(by…, completeness, uniqueness, consistency, validity)``."""
    scores = completeness(df, by).select(*by, F.col("completeness_rate").alias("completeness"))
    scores = attach(scores, duplicates(df, by), by, "_d")
    scores = attach(scores, consistency(df, by), by, "_c")
    scores = attach(scores, validity(df, spec, by), by, "_v")
    return scores.select(
        *by,
        "completeness",
        (1.0 - F.col("_d.duplicate_percentage") / 100.0).alias("uniqueness"),
        F.col("_c.consistency").alias("consistency"),
        F.col("_v.validity").alias("validity"),
    )


WIDE_METRICS = (
    "completeness_rate",
    "missing_percentage",
    "columns_with_missing",
    "percentage_columns_with_missing",
    "rows_with_missing",
    "percentage_rows_with_missing",
    "duplicate_rows",
    "duplicate_percentage",
    "numeric_columns",
    "categorical_columns",
    "total_columns",
    "outlier_percentage",
    "columns_with_outliers",
    "predictions_missing",
    "predictions_infinite",
    "prediction_diversity",
    "true_values_missing",
    "true_values_infinite",
    "class_balance_ratio",
    "highly_correlated_features",
    "highly_skewed_features",
    "confidence_score",
)


def confidence() -> Column:
    """1 minus penalties for missing cells, duplicates, outliers and broken predictions, at least 0."""

    def share(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0.0)) / 100.0

    broken = F.coalesce(F.col("predictions_missing"), F.lit(0)) + F.coalesce(
        F.col("predictions_infinite"), F.lit(0)
    )
    score = (
        1.0
        - 0.3 * share("missing_percentage")
        - F.least(0.2 * share("duplicate_percentage"), F.lit(0.2))
        - F.least(0.2 * share("outlier_percentage"), F.lit(0.2))
        - F.when(broken > 0, 0.3).otherwise(0.0)
    )
    return F.greatest(F.lit(0.0), score)


def _aggregate(df: DataFrame, by: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """All aggregates per key in one scan; very wide tables take one scan per chunk."""
    chunks = _chunks(aggregates, CHUNK_AGGREGATES)
    wide = group(df, by, *chunks[0])
    for chunk in chunks[1:]:
        more = group(df, by, *chunk)
        wide = join_on(wide, more, by) if by else attach(wide, more, by, "_more").select("*", "_more.*").drop("_more")
    return wide


def _profile_aggregates(df: DataFrame, numeric: Sequence[str], spec: AuditSpec) -> list[Column]:
    """Per numeric column min, max and skewness, and infinite predictions."""
    values = {c: clean_double(df, c) for c in numeric}
    found = []
    for i, v in enumerate(values.values()):
        found += [F.min(v).alias(f"_lo{i}"), F.max(v).alias(f"_hi{i}"), F.skewness(v).alias(f"_skew{i}")]
        found.append(F.count(v).alias(f"_n{i}"))
    for tag, name in (("p", spec.prediction), ("y", spec.truth)):
        if name:
            found.append(F.count_if(is_missing(df, name)).alias(f"_{tag}_missing"))
            infinite = F.abs(F.col(name).cast("double")) == float("inf") if name in values else F.lit(False)
            found.append(F.count_if(infinite).alias(f"_{tag}_infinite"))
    return found


def quality_metrics(df: DataFrame, spec: AuditSpec, by: Sequence[str] = ()) -> DataFrame:
    """Tall quality metrics, the confidence score and a flag per constant column.

    The source is read four times, whatever the number of columns: one aggregation without a shuffle for everything that needs no
    distinct values, one for duplicate rows, one for correlations, and one value table for distinct values and quartiles. Their results are stacked
    as small facts and turned into one row per key by one more aggregation, which keeps the plan flat.
    """
    columns = data_columns(df, by)
    numeric = numeric_columns(df, columns)
    vectors = [c for c in (spec.prediction, spec.truth) if c]
    wide = _aggregate(df, by, [*_missing_aggregates(df, columns), *_profile_aggregates(df, numeric, spec)])
    first = {k: c for k, c in _missing_metrics(columns).items() if k in (*WIDE_METRICS, "rows")}
    for tag, name, label in (("p", spec.prediction, "predictions"), ("y", spec.truth, "true_values")):
        if name:
            first |= {f"{label}_missing": F.col(f"_{tag}_missing"), f"{label}_infinite": F.col(f"_{tag}_infinite")}
    if numeric:
        skews = F.array(*[F.col(f"_skew{i}") for i in range(len(numeric))])
        high = F.size(F.filter(skews, lambda x: F.coalesce(finite(F.abs(x)) > HIGH_SKEW, F.lit(False))))
        first["highly_skewed_features"] = F.when(high > 0, high)
    constant = [F.when((F.col(f"_n{i}") > 1) & (F.col(f"_lo{i}") == F.col(f"_hi{i}")), F.lit(c)) for i, c in enumerate(numeric)]
    named = F.array_compact(F.array(*constant)).cast("array<string>")
    facts = [_facts(wide, by, first, F.transform(named, lambda c: _fact(c, "zero_variance", F.lit(1.0))))]
    copies = duplicates(df, by)
    facts.append(_facts(copies, by, {k: F.col(k) for k in ("duplicate_rows", "duplicate_percentage")}))
    values = value_table(df, list(dict.fromkeys([*numeric, *vectors])), by).where(present())
    kinds = values.where(F.col("column").isin(vectors)).groupBy(*by, "column").agg(
        F.count(F.lit(1)).alias("distinct"), F.min("n").alias("least"), F.max("n").alias("most")
    )
    facts.append(_facts(kinds, by, {f"_{k}": F.col(k) for k in ("distinct", "least", "most")}, attribute=F.col("column")))
    if numeric:
        counted = values.select(*by, "column", number().alias("v"), "n").where(F.col("column").isin(numeric))
        outside = outlier_summary(_iqr(counted, by), by)
        facts.append(_facts(outside, by, {k: F.col(k) for k in ("outlier_percentage", "columns_with_outliers")}))
    if len(numeric) > 1:
        pairs = group(correlations(df, by, numeric), by, F.count_if(F.abs("corr") > HIGH_CORRELATION).alias("high"))
        facts.append(_facts(pairs, by, {"highly_correlated_features": F.col("high")}))

    def fact(metric: str, attribute: str | None = None) -> Column:
        same = (F.col("metric") == metric) & (F.col("attribute") == attribute if attribute else F.lit(True))
        return F.max(F.when(same, F.col("value")))

    needed = [k for k in WIDE_METRICS[:-1] if k not in ("numeric_columns", "categorical_columns", "total_columns")]
    needed = [k for k in needed if k not in ("prediction_diversity", "class_balance_ratio")]
    collected = [fact("rows").alias("rows"), *[fact(k).alias(k) for k in needed]]
    collected += [fact(f"_{k}", c).alias(f"_{k}{i}") for i, c in enumerate(vectors) for k in ("distinct", "least", "most")]
    collected.append(F.collect_list(F.when(F.col("metric") == "zero_variance", F.col("attribute"))).alias("_constant"))
    row = group(_union(facts), by, *collected)
    nothing = F.lit(None).cast("double")
    picked = {k: F.col(k) for k in needed}
    picked |= {"numeric_columns": F.lit(len(numeric)), "categorical_columns": F.lit(len(text_columns(df, columns))), "total_columns": F.lit(len(columns))}
    for k in ("outlier_percentage", "columns_with_outliers"):
        picked[k] = F.coalesce(F.col(k), F.lit(0.0))
    if len(numeric) > 1:
        picked["highly_correlated_features"] = F.coalesce("highly_correlated_features", F.lit(0.0))
    if spec.prediction:
        seen = F.coalesce("_distinct0", F.lit(0)) + F.when(F.col("predictions_missing") > 0, 1).otherwise(0)
        picked["prediction_diversity"] = div(seen, F.col("rows"))
    if spec.truth:
        i = len(vectors) - 1
        picked["class_balance_ratio"] = F.when(F.col(f"_distinct{i}") <= FEW_CLASSES, div(F.col(f"_least{i}"), F.col(f"_most{i}")))
    for k in WIDE_METRICS[:-1]:
        picked.setdefault(k, nothing)
    flat = row.select(*by, *[c.cast("double").alias(k) for k, c in picked.items()], "_constant")
    scored = flat.withColumn("confidence_score", confidence())
    # one pass over the single row per key emits the metrics and the constant columns together
    text = F.lit(None).cast("string")
    metrics = F.array(*[_fact(text, k, F.col(k)) for k in WIDE_METRICS])
    flags = F.transform("_constant", lambda c: _fact(c, "zero_variance", F.lit(1.0)))
    opened = scored.select(*by, F.inline(F.concat(metrics, flags))).where(F.col("value").isNotNull() & ~F.isnan("value"))
    return opened.select(
        *by, F.lit(QUALITY).alias("analysis"), "attribute", text.alias("group"), "metric", "value"
    )


def _fact(attribute: Column, metric: str, value: Column) -> Column:
    return F.struct(attribute.alias("attribute"), F.lit(metric).alias("metric"), value.cast("double").alias("value"))


def _facts(df: DataFrame, by: Sequence[str], metrics: dict[str, Column], more: Column | None = None, attribute: Column | None = None) -> DataFrame:
    """``(by…, attribute, metric, value)`` from the columns of a row per key."""
    attribute = F.lit(None).cast("string") if attribute is None else attribute
    listed = F.array(*[_fact(attribute, k, c) for k, c in metrics.items()])
    return df.select(*by, F.inline(listed if more is None else F.concat(listed, more)))
