"""Tables behind charts: histograms, boxes, scatter samples, rankings and matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from predaudit.functions.keys import attach, group, measured
from predaudit.functions.ordered import column_quantiles, value_quantiles
from predaudit.functions.safe import clean_double, div0, numeric_columns
from predaudit.operators.quality import completeness, data_columns
from predaudit.operators.regression import residuals
from predaudit.spec import AuditSpec

BOX = (0.0, 0.25, 0.5, 0.75, 1.0)
BINS = 30
TOP_FEATURES, TOP_INTERACTIONS, IMPORTANCE_BINS = 15, 10, 20

# Words in a metric name that decide its category, in this order.
CATEGORIES = {
    "Performance": "accuracy precision recall f1 r2 rmse mae".split(),
    "Quality": "completeness quality missing duplicate".split(),
    "Bias": "bias fairness disparate demographic".split(),
}


def histogram(
    df: DataFrame, columns: dict[str, Column], by: Sequence[str] = (), bins: int = BINS
) -> DataFrame:
    """``(by…, column, bin, lower, upper, n)`` with equal bins between each column's min and max.

    Bin 1 starts at the minimum and the last bin includes the maximum; empty bins give no row.
    """
    names = list(columns)
    rows = df.select(*by, *[F.nanvl(columns[c].cast("double"), F.lit(None)).alias(f"_{i}") for i, c in enumerate(names)])
    spans = group(rows, by, *[f(f"_{i}").alias(f"{t}{i}") for i in range(len(names)) for t, f in (("lo", F.min), ("hi", F.max))])
    spans, few = measured(spans, by)
    parts: list[Column] = []
    for i, c in enumerate(names):
        parts += [F.lit(c), F.col(f"_{i}"), F.col(f"_at.lo{i}"), F.col(f"_at.hi{i}")]
    long = attach(rows, spans, by, "_at", small=few).select(
        *by, F.stack(F.lit(len(names)), *parts).alias("column", "v", "lo", "hi")
    )
    v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
    place = F.coalesce(F.floor(F.try_divide((v - lo) * bins, hi - lo)) + 1, F.lit(1))
    binned = long.where(v.isNotNull()).select(*by, "column", "lo", "hi", F.least(place, F.lit(bins)).cast("int").alias("bin"))
    width = (hi - lo) / bins
    return (
        binned.groupBy(*by, "column", "bin", "lo", "hi")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            *by,
            "column",
            "bin",
            (lo + (F.col("bin") - 1) * width).alias("lower"),
            (lo + F.col("bin") * width).alias("upper"),
            "n",
        )
    )


def feature_histograms(df: DataFrame, by: Sequence[str] = (), limit: int | None = None, bins: int = BINS) -> DataFrame:
    """Histograms of the numeric columns, or of the first ``limit`` ones."""
    names = numeric_columns(df, data_columns(df, by))[:limit]
    return histogram(df, {c: clean_double(df, c) for c in names}, by, bins)


def residual_histograms(df: DataFrame, spec: AuditSpec, by: Sequence[str] = (), bins: int = BINS) -> DataFrame:
    """Histograms of residuals, truths and predictions."""
    columns = {"residual": F.col("r"), "actual": F.col("y"), "predicted": F.col("p")}
    return histogram(residuals(df, spec, by), columns, by, bins)


def distribution_summary(df: DataFrame, column: str, by: Sequence[str] = (), accuracy: int | None = None) -> DataFrame:
    """``(by…, mean, median, std)`` drawn next to a distribution."""
    v = clean_double(df, column)
    moments = group(df, by, F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))
    median = value_quantiles(df, "q", v, by, (0.5,), accuracy)
    return attach(moments, median, by, "_m").select(*by, "mean", F.col("_m.q")[0].alias("median"), "std")


def column_boxes(
    df: DataFrame, by: Sequence[str] = (), limit: int | None = None, accuracy: int | None = None
) -> DataFrame:
    """Five numbers per numeric column, or for the first ``limit`` ones."""
    names = numeric_columns(df, data_columns(df, by))[:limit]
    boxes = column_quantiles(df, {c: clean_double(df, c) for c in names}, by, BOX, accuracy)
    labels = ("min", "q1", "median", "q3", "max")
    return boxes.select(*by, "column", "n", *[F.col("q")[i].alias(c) for i, c in enumerate(labels)])


def completeness_cells(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by…, label, cells)`` for complete and missing cells."""
    counts = completeness(df, by)
    pairs = F.stack(
        F.lit(2), F.lit("Complete"), F.col("cells") - F.col("missing_cells"), F.lit("Missing"), F.col("missing_cells")
    )
    return counts.select(*by, pairs.alias("label", "cells"))


def residual_points(
    df: DataFrame, spec: AuditSpec, by: Sequence[str] = (), order: str | None = None, points: int | None = None, seed: int = 42
) -> DataFrame:
    """``(by…, [index,] actual, predicted, residual, absolute_error)`` for scatter charts.

    ``points`` samples to about that many rows; ``order`` adds a column to plot residuals against.
    """
    kept = clean_double(df, spec.truth).isNotNull() & clean_double(df, spec.prediction).isNotNull()
    rows = df.where(kept)
    if points is not None:
        total = rows.agg(F.count(F.lit(1)).alias("n"))
        marked = attach(rows.withColumn("_u", F.rand(seed)), total, (), "_t")
        rows = marked.where(F.col("_u") * F.col("_t.n") < points)
    y, p = clean_double(df, spec.truth), clean_double(df, spec.prediction)
    extra = [F.col(order).alias("index")] if order else []
    return rows.select(
        *by, *extra, y.alias("actual"), p.alias("predicted"), (y - p).alias("residual"), F.abs(y - p).alias("absolute_error")
    )


def top_features(importance: DataFrame, limit: int = TOP_FEATURES) -> DataFrame:
    """The ``limit`` most important features."""
    return importance.orderBy(F.desc("importance"), "feature").limit(limit)


def top_correlations(correlation: DataFrame, limit: int = TOP_FEATURES) -> DataFrame:
    """The ``limit`` strongest target correlations, with their sign."""
    sign = F.when(F.col("corr") < 0, "negative").otherwise("positive").alias("sign")
    return correlation.orderBy(F.desc(F.abs("corr")), "feature").limit(limit).select("feature", "corr", sign)


def top_interactions(interactions: DataFrame, limit: int = TOP_INTERACTIONS) -> DataFrame:
    """The ``limit`` strongest interactions."""
    return interactions.orderBy(F.desc("strength"), "feature_a", "feature_b").limit(limit)


def importance_histogram(importance: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Histogram of the importances."""
    return histogram(importance, {"importance": F.col("importance")}, by, IMPORTANCE_BINS)


def metric_categories(metrics: DataFrame) -> DataFrame:
    """The metrics table with a ``category`` by words in the metric name."""
    name = F.lower("metric")
    category = None
    for label, words in CATEGORIES.items():
        hit = name.rlike("|".join(words))
        category = F.when(hit, label) if category is None else category.when(hit, label)
    return metrics.withColumn("category", category.otherwise("Other"))


def percent_of_total(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Each metric value as a percentage of the sum per key."""
    total = F.sum("value").over(Window.partitionBy(*by))
    return metrics.withColumn("percentage", 100.0 * div0(F.col("value"), total))


def group_matrix(rows: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Tall ``(by…, group, metric, value)`` to one column per metric; a missing cell is 0."""
    picks = [
        F.coalesce(F.max(F.when(F.col("metric") == m, F.col("value"))), F.lit(0.0)).alias(m) for m in metrics
    ]
    return rows.groupBy(*by, "group").agg(*picks)
