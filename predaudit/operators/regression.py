"""Regression performance. ``r`` is truth minus prediction; rows missing either are left out."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from predaudit.functions.keys import attach, group, measured, tall
from predaudit.functions.normal import fitted_ks_p_value, normal_cdf, shapiro_wilk
from predaudit.functions.ordered import marks, running_totals, segments, value_quantiles
from predaudit.functions.safe import clean_double, corr, div, r2
from predaudit.spec import PERFORMANCE, AuditSpec

EPSILON = 2.220446049250313e-16  # double machine epsilon, the floor of |y| in the percentage error
METRICS = (
    "r2_score",
    "mean_squared_error",
    "root_mean_squared_error",
    "mean_absolute_error",
    "mean_absolute_percentage_error",
    "explained_variance_score",
    "residual_mean",
    "residual_std",
    "residual_skewness",
    "residual_kurtosis",
    "relative_mae",
    "relative_rmse",
    "max_error",
    "pearson_correlation",
)
DISTRIBUTION = (
    "prediction_mean",
    "prediction_std",
    "prediction_min",
    "prediction_max",
    "prediction_range",
    "prediction_median",
    "prediction_skewness",
    "prediction_kurtosis",
)
QQ_POINTS = 99
SHAPIRO_ROWS = 5000  # the test has no published weights beyond
PICK_BITS = 14  # of a hash: ranges that are counted before rows are drawn


def residuals(df: DataFrame, spec: AuditSpec, by: Sequence[str] = ()) -> DataFrame:
    """``(by…, y, p, r)``; NaN and null rows dropped, column pruning left to the scan."""
    pair = df.select(*by, clean_double(df, spec.truth).alias("y"), clean_double(df, spec.prediction).alias("p"))
    return pair.where(F.col("y").isNotNull() & F.col("p").isNotNull()).withColumn("r", F.col("y") - F.col("p"))


def regression_metrics(df: DataFrame, spec: AuditSpec, by: Sequence[str] = ()) -> DataFrame:
    """All metrics wide, one pass; ``n`` is 0 with null metrics for empty input."""
    y, p, r = F.col("y"), F.col("p"), F.col("r")
    sums = group(
        residuals(df, spec, by),
        by,
        F.count(F.lit(1)).alias("n"),
        F.sum(r * r).alias("_ss"),
        F.avg(r * r).alias("mean_squared_error"),
        F.avg(F.abs(r)).alias("mean_absolute_error"),
        F.avg(F.abs(r) / F.greatest(F.abs(y), F.lit(EPSILON))).alias("mean_absolute_percentage_error"),
        F.var_pop(y).alias("_vy"),
        F.var_pop(r).alias("_vr"),
        F.avg(r).alias("residual_mean"),
        F.stddev_pop(r).alias("residual_std"),
        F.skewness(r).alias("residual_skewness"),
        F.kurtosis(r).alias("residual_kurtosis"),
        F.avg(F.abs(y)).alias("_ay"),
        F.max(F.abs(r)).alias("max_error"),
        corr(y, p).alias("pearson_correlation"),
    )
    rmse = F.sqrt("mean_squared_error")
    vy, vr = F.col("_vy"), F.col("_vr")
    explained = F.when(vy > 0, 1.0 - F.try_divide(vr, vy)).when(
        F.col("n") > 0, F.when(vr == 0, 1.0).otherwise(0.0)
    )
    return sums.select(
        *by,
        "n",
        r2(F.col("_ss"), F.col("n"), vy).alias("r2_score"),
        "mean_squared_error",
        rmse.alias("root_mean_squared_error"),
        "mean_absolute_error",
        "mean_absolute_percentage_error",
        explained.alias("explained_variance_score"),
        "residual_mean",
        "residual_std",
        "residual_skewness",
        "residual_kurtosis",
        div(F.col("mean_absolute_error"), F.col("_ay")).alias("relative_mae"),
        div(rmse, F.col("_ay")).alias("relative_rmse"),
        "max_error",
        "pearson_correlation",
    )


def performance(df: DataFrame, spec: AuditSpec, by: Sequence[str] = ()) -> DataFrame:
    """Tall metrics, or the prediction distribution when there is no truth."""
    if spec.truth is None:
        return tall(prediction_distribution(df, spec, by), by, PERFORMANCE, DISTRIBUTION)
    return tall(regression_metrics(df, spec, by), by, PERFORMANCE, METRICS)


def jarque_bera(df: DataFrame, spec: AuditSpec, by: Sequence[str] = ()) -> DataFrame:
    """``(by…, n, statistic, p_value)`` of the residuals; chi-square with two degrees of freedom."""
    r = F.col("r")
    moments = group(
        residuals(df, spec, by),
        by,
        F.count(F.lit(1)).alias("n"),
        F.skewness(r).alias("_s"),
        F.kurtosis(r).alias("_k"),
    )
    statistic = F.col("n") / 6.0 * (F.col("_s") * F.col("_s") + F.col("_k") * F.col("_k") / 4.0)
    return moments.select(*by, "n", statistic.alias("statistic"), F.exp(-statistic / 2.0).alias("p_value"))


def ks_normality(df: DataFrame, spec: AuditSpec, by: Sequence[str] = ()) -> DataFrame:
    """Kolmogorov-Smirnov test of all residuals against the normal fitted to them: ``(by…, n, statistic, p_value)``.

    Exact over counted values, and the p-value allows for the fitted mean and deviation. Keys whose residuals do not vary are left out; the
    p-value is null below five residuals.
    """
    rows = residuals(df, spec, by)
    counts = rows.groupBy(*by, "r").agg(F.count(F.lit(1)).alias("n"))
    fitted = group(rows, by, F.avg("r").alias("mean"), F.stddev_samp("r").alias("std"))
    placed = attach(running_totals(counts, by, "r", ["n"]), fitted, by, "_f").where(F.col("_f.std") > 0)
    expected = normal_cdf((F.col("r") - F.col("_f.mean")) / F.col("_f.std"))
    total = F.col("n_total").cast("double")
    gap = F.greatest(expected - F.col("n_below") / total, (F.col("n_below") + F.col("n")) / total - expected)
    found = group(placed, by, F.max("n_total").alias("n"), F.max(gap).alias("statistic")).where(F.col("n").isNotNull())
    return found.withColumn("p_value", fitted_ks_p_value(F.col("statistic"), F.col("n")))


def shapiro_normality(df: DataFrame, spec: AuditSpec, by: Sequence[str] = (), rows: int = SHAPIRO_ROWS) -> DataFrame:
    """Shapiro-Wilk test of a sample of each key's residuals: ``(by…, n, statistic, p_value)``.

    The sample are the ``rows`` residuals whose identifiers (or, without one, whose whole rows) have the smallest hashes: the same on every run, and merged like
    a minimum. Keys with fewer than three residuals, or equal ones, are left out.
    """
    if not 3 <= rows <= SHAPIRO_ROWS:
        raise ValueError(f"the test is known for 3 to {SHAPIRO_ROWS} rows")
    scalars = [spec.identifier] if spec.identifier else [f.name for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
    drawn = residuals(df.withColumn("_pick", F.xxhash64(*scalars)), spec, [*by, "_pick"])
    if by:
        sample = _first(drawn, by, rows)
    else:
        sample = drawn.orderBy("_pick", "r").limit(rows)
    test = F.pandas_udf(_shapiro, "statistic double, p_value double")
    tested = group(sample, by, F.count("r").alias("n"), F.collect_list("r").alias("_r")).withColumn("_t", test("_r"))
    return tested.where(F.col("_t.statistic").isNotNull()).select(*by, "n", "_t.statistic", "_t.p_value")


def _first(drawn: DataFrame, by: Sequence[str], rows: int) -> DataFrame:
    """The ``rows`` first rows of each key by ``_pick`` and ``r``.

    The first ``PICK_BITS`` bits of the hashes make ranges. Counts per range say how far the wanted rows reach; only rows up to there are counted by value and ordered, so
    a task holds the wanted rows and one range of a key.
    """
    place = F.shiftright("_pick", 64 - PICK_BITS)
    before = Window.partitionBy(*by).orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    sizes = drawn.groupBy(*by, place.alias("_place")).agg(F.count(F.lit(1)).alias("n"))
    reached = sizes.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("_before") < rows)
    last, few = measured(reached.groupBy(*by).agg(F.max("_place").alias("place")), by)
    counted = attach(drawn, last, by, "_last", small=few).where(place <= F.col("_last.place")).groupBy(*by, "_pick", "r").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*by).orderBy("_pick", "r").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.least(F.col("n"), rows - F.coalesce(F.sum("n").over(order), F.lit(0))).alias("n")
    return counted.select(*by, "r", taken).where("n > 0").select(*by, F.explode(F.array_repeat("r", F.col("n").cast("int"))).alias("r"))


def _shapiro(samples: pd.Series) -> pd.DataFrame:
    found = [shapiro_wilk(list(values)) or (None, None) for values in samples]
    return pd.DataFrame(found, columns=["statistic", "p_value"], dtype="float64")


def residual_outliers(
    df: DataFrame, spec: AuditSpec, by: Sequence[str] = (), accuracy: int | None = None
) -> DataFrame:
    """Residuals beyond 1.5 interquartile ranges: fences, threshold, count and percentage.

    Quartiles of few keys are broadcast to the rows; with very many keys the counted residuals are summed up between the fences.
    """
    rows = residuals(df, spec, by)
    cuts = value_quantiles(rows, "r", F.col("r"), by, (0.25, 0.75), accuracy).select(
        *by, F.col("r")[0].alias("q25"), F.col("r")[1].alias("q75")
    )
    cuts, few = measured(cuts.withColumn("outlier_threshold", 1.5 * (F.col("q75") - F.col("q25"))), by)
    low, high = F.col("q25") - F.col("outlier_threshold"), F.col("q75") + F.col("outlier_threshold")
    if few:
        fences = cuts.select(*by, low.alias("low"), high.alias("high"))
        outside = (F.col("r") < F.col("_f.low")) | (F.col("r") > F.col("_f.high"))
        sums = group(attach(rows, fences, by, "_f", small=True).withColumn("_out", outside), by, F.count(F.lit(1)).alias("n"), F.count_if("_out").alias("outlier_count"))
    else:
        counts = rows.groupBy(*by, "r").agg(F.count(F.lit(1)).alias("n"))
        found = segments(counts, by, "r", ["n"], cuts.select(*by, marks((low, -1), (high, 1)).alias("marks")))
        sums = group(found, by, F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("segment") != 1, F.col("n"))), F.lit(0)).alias("outlier_count"))
    return attach(sums, cuts, by, "_q", small=few).select(
        *by, "n", "_q.q25", "_q.q75", "_q.outlier_threshold", "outlier_count", (100.0 * div(F.col("outlier_count"), F.col("n"))).alias("outlier_percentage")
    )


def error_bands(df: DataFrame, spec: AuditSpec, by: Sequence[str] = ()) -> DataFrame:
    """Share of rows whose absolute residual is within 1, 2 and 3 population standard deviations."""
    rows = residuals(df, spec, by)
    spread, few = measured(group(rows, by, F.stddev_pop("r").alias("std")), by)
    if few:
        shares = [F.avg((F.abs("r") <= k * F.col("_s.std")).cast("double")).alias(f"errors_within_{k}_std") for k in (1, 2, 3)]
        return group(attach(rows, spread, by, "_s", small=True), by, *shares)
    sizes = rows.select(*by, F.abs("r").alias("size")).groupBy(*by, "size").agg(F.count(F.lit(1)).alias("n"))
    bands = spread.select(*by, marks(*[(k * F.col("std"), 1) for k in (1, 2, 3)]).alias("marks"))
    found = segments(sizes, by, "size", ["n"], bands)
    shares = [
        (F.coalesce(F.sum(F.when(F.col("segment") < k, F.col("n"))), F.lit(0)) / F.sum("n")).alias(f"errors_within_{k}_std") for k in (1, 2, 3)
    ]
    return group(found, by, *shares)


def quartile_performance(
    df: DataFrame, spec: AuditSpec, by: Sequence[str] = (), accuracy: int | None = None
) -> DataFrame:
    """R², MAE and count per quartile of the truth. Bins are closed at both ends, so a row on a
    boundary counts in two of them.

    Quartiles of few keys are broadcast to the rows. With very many keys every value of the truth is a row with its moments, which are summed
    up between the quartiles and at them.
    """
    rows = residuals(df, spec, by)
    cuts, few = measured(value_quantiles(rows, "y", F.col("y"), by, (0.0, 0.25, 0.5, 0.75, 1.0), accuracy), by)
    r, y = F.col("r"), F.col("_q.y")
    if few:
        bins = F.array(*[F.when(F.col("y").between(y[i], y[i + 1]), F.lit(f"quartile_{i + 1}")) for i in range(4)])
        binned = attach(rows, cuts, by, "_q", small=True).select(*by, "y", "r", F.explode(F.array_compact(bins)).alias("bin"))
        sums = binned.groupBy(*by, "bin").agg(
            F.sum(r * r).alias("ss"), F.var_pop("y").alias("variance"), F.sum(F.abs(r)).alias("size"), F.count(F.lit(1)).cast("double").alias("n")
        )
        variance = F.col("variance")
    else:
        moments = rows.groupBy(*by, "y").agg(
            F.count(F.lit(1)).cast("double").alias("n"), F.sum(r * r).alias("ss"), F.sum(F.abs(r)).alias("size")
        )
        center = group(rows, by, F.avg("y").alias("mean"))
        weighted = attach(moments, center, by, "_c").withColumn("d", F.col("y") - F.col("_c.mean")).withColumns(
            {"sy": F.col("n") * F.col("d"), "syy": F.col("n") * F.col("d") * F.col("d"), "values": F.lit(1)}
        )
        edges = cuts.select(*by, marks(*[(F.col("y")[i], tie) for i in range(5) for tie in (-1, 1)]).alias("marks"))
        measures = ["n", "ss", "size", "sy", "syy", "values"]
        found = attach(segments(weighted.select(*by, "y", *measures), by, "y", measures, edges), cuts, by, "_q")
        # segment 2e + 1 lies at edge e, segment 2e + 2 between it and the next; edges may be equal
        low, high = F.floor((F.col("segment") - 1) / 2).cast("int"), F.floor(F.col("segment") / 2).cast("int")
        bins = F.array(*[F.when((y[i] <= F.get(y, low)) & (F.get(y, high) <= y[i + 1]), F.lit(f"quartile_{i + 1}")) for i in range(4)])
        binned = found.select(*by, *measures, F.explode(F.array_compact(bins)).alias("bin"))
        sums = binned.groupBy(*by, "bin").agg(*[F.sum(m).alias(m) for m in measures])
        mean = F.col("sy") / F.col("n")
        variance = F.when(F.col("values") == 1, 0.0).otherwise(F.greatest(F.lit(0.0), F.col("syy") / F.col("n") - mean * mean))
    n = F.col("n")
    return sums.select(
        *by, "bin", r2(F.col("ss"), n, variance).alias("r2"), (F.col("size") / n).alias("mae"), n.cast("long").alias("sample_count")
    )


def qq_points(
    df: DataFrame, spec: AuditSpec, by: Sequence[str] = (), points: int = QQ_POINTS, accuracy: int | None = None
) -> DataFrame:
    """``(by…, prob, theoretical, sample)``: normal quantiles against residual quantiles."""
    probs = [i / (points + 1) for i in range(1, points + 1)]
    sample = value_quantiles(residuals(df, spec, by), "r", F.col("r"), by, probs, accuracy)
    grid = F.array(
        *[F.struct(F.lit(p).alias("prob"), F.lit(NormalDist().inv_cdf(p)).alias("theoretical")) for p in probs]
    )
    pairs = sample.select(*by, F.explode(F.arrays_zip(grid.alias("grid"), F.col("r").alias("sample"))).alias("_z"))
    return pairs.select(*by, "_z.grid.prob", "_z.grid.theoretical", "_z.sample")


def prediction_distribution(
    df: DataFrame, spec: AuditSpec, by: Sequence[str] = (), accuracy: int | None = None
) -> DataFrame:
    """Moments, range and median of the predictions alone."""
    rows = df.select(*by, clean_double(df, spec.prediction).alias("p")).where(F.col("p").isNotNull())
    p = F.col("p")
    moments = group(
        rows,
        by,
        F.avg(p).alias("prediction_mean"),
        F.stddev_pop(p).alias("prediction_std"),
        F.min(p).alias("prediction_min"),
        F.max(p).alias("prediction_max"),
        (F.max(p) - F.min(p)).alias("prediction_range"),
        F.skewness(p).alias("prediction_skewness"),
        F.kurtosis(p).alias("prediction_kurtosis"),
    )
    median = value_quantiles(rows, "p", p, by, (0.5,), accuracy)
    return attach(moments, median, by, "_m").select(
        *by, *[(F.col("_m.p")[0] if m == "prediction_median" else F.col(m)).alias(m) for m in DISTRIBUTION]
    )
