"""Group fairness. Protected attributes are unpivoted to ``(attribute, group)`` and counted once.

Classification keeps truth and prediction in the counting key, so one small table of counts yields
rates, odds, accuracy and class distributions. Regression aggregates moments per group directly.
Missing groups are dropped unless ``spec.null_group`` names them "null".
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from predaudit.functions.keys import attach, group, join_on, tall
from predaudit.functions.ordered import column_quantiles, quantiles, value_quantiles
from predaudit.functions.safe import clean, clean_double, div, div0, r2
from predaudit.operators.classification import label_pair
from predaudit.spec import BIAS, BINARY, REGRESSION, AuditSpec

HIGH, MODERATE = 0.3, 0.1  # bias severity
FAIR_RATIO = 0.8  # disparate impact below this counts as biased
NULL_GROUP = "null"


def present_attributes(df: DataFrame, spec: AuditSpec) -> list[str]:
    return [a for a in spec.protected if a in df.columns]


def _groups(df: DataFrame, spec: AuditSpec, attributes: Sequence[str]) -> Column:
    """The generator of ``(attribute, group)`` pairs of a row."""
    parts: list[Column] = []
    for a in attributes:
        g = clean(df, a).cast("string")
        parts += [F.lit(a), F.coalesce(g, F.lit(NULL_GROUP)) if spec.null_group else g]
    return F.stack(F.lit(len(attributes)), *parts).alias("attribute", "group")


def group_counts(df: DataFrame, spec: AuditSpec, by: Sequence[str] = ()) -> DataFrame:
    """``(by…, attribute, group, truth, prediction, n)`` for classification."""
    y, p = label_pair(df, spec) if spec.truth else (F.lit(None).cast("string"), clean(df, spec.prediction))
    rows = df.select(*by, y.alias("truth"), p.alias("prediction"), _groups(df, spec, present_attributes(df, spec)))
    kept = F.col("group").isNotNull() & F.col("prediction").isNotNull()
    if spec.truth:
        kept = kept & F.col("truth").isNotNull()
    return (
        rows.where(kept)
        .groupBy(*by, "attribute", "group", "truth", "prediction")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _label(df: DataFrame, name: str, value) -> Column:
    return F.lit(value).cast(df.schema[name].dataType)


def _classification_groups(df: DataFrame, spec: AuditSpec, by: Sequence[str]) -> DataFrame:
    counts = group_counts(df, spec, by)
    y, p, n = F.col("truth"), F.col("prediction"), F.col("n")
    is_pos = p == _label(counts, "prediction", spec.positive)
    true_pos = y == _label(counts, "truth", spec.positive)

    def total(when: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, n)), F.lit(0))

    code = p.try_cast("double") if dict(counts.dtypes)["prediction"] == "string" else p.cast("double")
    sums = counts.groupBy(*by, "attribute", "group").agg(
        F.sum("n").alias("n"),
        total(is_pos).alias("positives"),
        div(F.sum(code * n), F.sum(n)).alias("_mean_code"),
        total(true_pos & is_pos).alias("tp"),
        total(~true_pos & is_pos).alias("fp"),
        total(~true_pos & ~is_pos).alias("tn"),
        total(true_pos & ~is_pos).alias("fn"),
        total(y == p).alias("correct"),
    )
    if spec.problem == BINARY:
        rate = div(F.col("positives"), F.col("n"))
    else:
        # exactly two distinct predictions over all rows: share of the positive; else mean code
        labels = df.select(*by, clean(df, spec.prediction).alias("_p")).where(F.col("_p").isNotNull())
        distinct = group(labels.distinct(), by, F.count(F.lit(1)).alias("labels"))
        sums = attach(sums, distinct, by, "_d")
        rate = F.when(F.col("_d.labels") == 2, div(F.col("positives"), F.col("n"))).otherwise(F.col("_mean_code"))
    has_truth = spec.truth is not None
    odds = has_truth and spec.problem == BINARY
    nothing = F.lit(None).cast("double")
    return sums.select(
        *by,
        "attribute",
        "group",
        "n",
        rate.alias("positive_rate"),
        (div0(F.col("tp"), F.col("tp") + F.col("fn")) if odds else nothing).alias("tpr"),
        (div0(F.col("fp"), F.col("fp") + F.col("tn")) if odds else nothing).alias("fpr"),
        (div(F.col("correct"), F.col("n")) if has_truth else nothing).alias("accuracy"),
        nothing.alias("mae"),
        nothing.alias("r2"),
        nothing.alias("rmse"),
        nothing.alias("mean_prediction"),
        nothing.alias("std_prediction"),
    )


def _regression_rows(df: DataFrame, spec: AuditSpec, by: Sequence[str]) -> DataFrame:
    y = clean_double(df, spec.truth) if spec.truth else F.lit(None).cast("double")
    attributes = present_attributes(df, spec)
    rows = df.select(*by, *attributes, y.alias("_y"), clean_double(df, spec.prediction).alias("_p"))
    kept = F.col("_p").isNotNull()
    return rows.where(kept & F.col("_y").isNotNull() if spec.truth else kept)


def _regression_groups(df: DataFrame, spec: AuditSpec, by: Sequence[str], accuracy: int | None) -> DataFrame:
    rows = _regression_rows(df, spec, by)
    median = value_quantiles(rows, "p", F.col("_p"), by, (0.5,), accuracy)
    marked = attach(rows, median, by, "_m").withColumn("_above", F.col("_p") > F.col("_m.p")[0])
    long = marked.select(*by, "_y", "_p", "_above", _groups(rows, spec, present_attributes(df, spec)))
    r = F.col("_y") - F.col("_p")
    sums = (
        long.where(F.col("group").isNotNull())
        .groupBy(*by, "attribute", "group")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(F.col("_above").cast("double")).alias("positive_rate"),
            F.avg(F.abs(r)).alias("mae"),
            F.avg(r * r).alias("_mse"),
            F.sum(r * r).alias("_ss"),
            F.var_pop("_y").alias("_vy"),
            F.avg("_p").alias("mean_prediction"),
            F.stddev_pop("_p").alias("std_prediction"),
        )
    )
    nothing = F.lit(None).cast("double")
    score = r2(F.col("_ss"), F.col("n"), F.col("_vy"))
    # a group whose truth is constant scores 0 here, perfect or not
    score = F.when(F.col("_vy").isNotNull(), F.when(F.col("_vy") > 0, score).otherwise(0.0))
    return sums.select(
        *by,
        "attribute",
        "group",
        "n",
        "positive_rate",
        nothing.alias("tpr"),
        nothing.alias("fpr"),
        nothing.alias("accuracy"),
        "mae",
        score.alias("r2"),
        F.sqrt("_mse").alias("rmse"),
        "mean_prediction",
        "std_prediction",
    )


def group_metrics(
    df: DataFrame, spec: AuditSpec, by: Sequence[str] = (), accuracy: int | None = None
) -> DataFrame:
    """Wide table with one row per ``(by…, attribute, group)``: size, rates, accuracy or errors."""
    if not present_attributes(df, spec):
        raise ValueError("bias analysis needs at least one protected attribute that is in the data")
    if spec.problem == REGRESSION:
        return _regression_groups(df, spec, by, accuracy)
    return _classification_groups(df, spec, by)


def attribute_metrics(groups: DataFrame, by: Sequence[str] = (), scale: DataFrame | None = None) -> DataFrame:
    """Gaps between groups per attribute, wide; attributes with one group are skipped.

    ``scale`` (``by…, mean_abs_truth``) divides the MAE gap, which is in the unit of the truth.
    """

    def gap(c: str) -> Column:
        return F.max(c) - F.min(c)

    high, low = F.max("positive_rate"), F.min("positive_rate")
    gaps = (
        groups.groupBy(*by, "attribute")
        .agg(
            F.count(F.lit(1)).alias("_groups"),
            F.when(high > 0, F.try_divide(low, high)).otherwise(0.0).alias("disparate_impact_ratio"),
            (high - low).alias("demographic_parity_diff"),
            gap("tpr").alias("tpr_difference"),
            gap("fpr").alias("fpr_difference"),
            gap("accuracy").alias("accuracy_difference"),
            gap("mae").alias("mae_difference"),
            gap("r2").alias("r2_difference"),
        )
        .where(F.col("_groups") > 1)
        .drop("_groups")
    )
    if scale is not None:
        gaps = attach(gaps, scale, by, "_scale")
        gaps = gaps.withColumn("mae_difference", div(F.col("mae_difference"), F.col("_scale.mean_abs_truth")))
        gaps = gaps.drop("_scale")
    return gaps


GAPS = (
    "disparate_impact_ratio",
    "demographic_parity_diff",
    "tpr_difference",
    "fpr_difference",
    "accuracy_difference",
    "mae_difference",
    "r2_difference",
)


def _tall_gaps(gaps: DataFrame, by: Sequence[str]) -> DataFrame:
    return tall(gaps, by, BIAS, GAPS, attribute="attribute")


def bias_score(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by…, overall_bias_score, attributes, attributes_with_bias, bias_severity)``.

    The score is the mean of |1 - disparate impact| and every gap, at most 1, and 0 with no gap.
    """
    value, metric = F.col("value"), F.col("metric")
    ratio = metric == "disparate_impact_ratio"
    distance = F.when(ratio, F.abs(1.0 - value)).otherwise(value)
    score = F.least(F.lit(1.0), F.coalesce(F.avg(distance), F.lit(0.0)))
    summary = group(
        metrics,
        by,
        score.alias("overall_bias_score"),
        F.count_if(ratio).alias("attributes"),
        F.count_if(ratio & (value < FAIR_RATIO)).alias("attributes_with_bias"),
    )
    s = F.col("overall_bias_score")
    severity = F.when(s > HIGH, "high").when(s > MODERATE, "moderate").otherwise("low")
    return summary.withColumn("bias_severity", severity)


def fairness_metrics(
    df: DataFrame,
    spec: AuditSpec,
    by: Sequence[str] = (),
    normalised: bool = False,
    accuracy: int | None = None,
) -> DataFrame:
    """Tall gap metrics per attribute and the overall bias score."""
    scale = None
    if normalised and spec.problem == REGRESSION and spec.truth:
        rows = _regression_rows(df, spec, by)
        scale = group(rows, by, F.avg(F.abs("_y")).alias("mean_abs_truth"))
    gaps = _tall_gaps(attribute_metrics(group_metrics(df, spec, by, accuracy), by, scale), by)
    text = F.lit(None).cast("string")
    overall = bias_score(gaps, by).select(
        *by,
        F.lit(BIAS).alias("analysis"),
        text.alias("attribute"),
        text.alias("group"),
        F.lit("overall_bias_score").alias("metric"),
        F.col("overall_bias_score").alias("value"),
    )
    return gaps.unionByName(overall)


def group_statistics(
    df: DataFrame, spec: AuditSpec, by: Sequence[str] = (), accuracy: int | None = None
) -> DataFrame:
    """Size and share per group with its rates, accuracy or errors, and the median prediction.

    The share is of all rows, also those whose group is missing.
    """
    groups = group_metrics(df, spec, by, accuracy)
    if spec.problem == REGRESSION:
        rows = _regression_rows(df, spec, by)
    else:
        kept = clean(df, spec.prediction).isNotNull()
        if spec.truth:
            kept = kept & clean(df, spec.truth).isNotNull()
        rows = df.where(kept)
    total = group(rows, by, F.count(F.lit(1)).alias("rows"))
    share = (100.0 * div(F.col("n"), F.col("_t.rows"))).alias("percentage_of_total")
    sized = attach(groups, total, by, "_t").select(*groups.columns, share)
    if spec.problem != REGRESSION:
        return sized
    long = rows.select(*by, "_p", _groups(rows, spec, present_attributes(df, spec)))
    keys = [*by, "attribute", "group"]
    counts = (
        long.where(F.col("group").isNotNull()).groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("k"))
    )
    medians = quantiles(counts, keys, "_p", "k", (0.5,)).select(*keys, F.col("q")[0].alias("median_prediction"))
    return join_on(sized, medians, keys, "left")


def group_distribution(df: DataFrame, spec: AuditSpec, by: Sequence[str] = ()) -> DataFrame:
    """``(by…, attribute, group, value, n, share)``: how predictions spread inside each group."""
    keys = [*by, "attribute", "group"]
    counts = (
        group_counts(df, spec, by)
        .groupBy(*keys, F.col("prediction").cast("string").alias("value"))
        .agg(F.sum("n").alias("n"))
    )
    sizes = counts.groupBy(*keys).agg(F.sum("n").alias("_size"))
    return join_on(counts, sizes, keys).select(*keys, "value", "n", div(F.col("n"), F.col("_size")).alias("share"))


def intersectional(df: DataFrame, spec: AuditSpec, by: Sequence[str] = (), cube: bool = True) -> DataFrame:
    """Mean prediction, size and (with truth) accuracy or MAE for combinations of the attributes.

    ``cube=False`` keeps the pairs of the first two attributes; otherwise every subset is rolled up
    and a null attribute stands for "all". ``level`` counts the attributes that are set.
    """
    attributes = present_attributes(df, spec)
    if len(attributes) < 2:
        raise ValueError("intersectional analysis needs two protected attributes")
    if not cube:
        attributes = attributes[:2]
    if spec.problem == REGRESSION or not spec.truth:
        y, p = (clean_double(df, spec.truth) if spec.truth else F.lit(None)), clean_double(df, spec.prediction)
    else:
        y, p = label_pair(df, spec)
    parts = []
    for a in attributes:
        g = clean(df, a).cast("string")
        parts.append((F.coalesce(g, F.lit(NULL_GROUP)) if spec.null_group else g).alias(a))
    rows = df.select(*by, *parts, y.alias("_y"), p.alias("_p")).where(F.col("_p").isNotNull())
    for a in attributes:
        rows = rows.where(F.col(a).isNotNull())
    if spec.truth:
        rows = rows.where(F.col("_y").isNotNull())
    number = F.col("_p").try_cast("double") if dict(rows.dtypes)["_p"] == "string" else F.col("_p").cast("double")
    measures = [F.count(F.lit(1)).alias("n"), F.avg(number).alias("mean_prediction")]
    if spec.problem == REGRESSION:
        if spec.truth:
            measures.append(F.avg(F.abs(F.col("_y") - F.col("_p"))).alias("mae"))
    else:
        positive = F.col("_p") == _label(rows, "_p", spec.positive)
        measures.append(F.avg(positive.cast("double")).alias("positive_rate"))
        if spec.truth:
            hit = (F.col("_y") == F.col("_p")).cast("double")
            measures.append(F.avg(hit).alias("accuracy"))
            if spec.problem == BINARY:
                actual = F.col("_y") == _label(rows, "_y", spec.positive)
                measures.append(
                    div0(F.count_if(actual & positive), F.count_if(actual)).alias("tpr")
                )
                measures.append(
                    div0(F.count_if(~actual & positive), F.count_if(~actual)).alias("fpr")
                )
    if not cube:
        return rows.groupBy(*by, *attributes).agg(*measures)
    sets = _subsets(attributes)
    rolled = rows.groupingSets([[F.col(c) for c in (*by, *s)] for s in sets], *by, *attributes).agg(
        *measures, *[F.grouping(a).alias(f"_g_{a}") for a in attributes]
    )
    level = sum((1 - F.col(f"_g_{a}").cast("int") for a in attributes), F.lit(0))
    return rolled.withColumn("level", level).drop(*[f"_g_{a}" for a in attributes])


def _subsets(items: Sequence[str]) -> list[list[str]]:
    sets: list[list[str]] = [[]]
    for item in items:
        sets += [[*s, item] for s in sets]
    return sets


def group_boxes(
    df: DataFrame, spec: AuditSpec, by: Sequence[str] = (), attribute: str | None = None, accuracy: int | None = None
) -> DataFrame:
    """Box of the predictions per group of one attribute: five numbers and rows beyond the fences."""
    attribute = attribute or present_attributes(df, spec)[0]
    one = spec.with_(protected=(attribute,))
    rows = _regression_rows(df, one.with_(truth=None), by)
    long = rows.select(*by, "_p", _groups(rows, one, [attribute])).where(F.col("group").isNotNull())
    keys = [*by, "attribute", "group"]
    probs = (0.0, 0.25, 0.5, 0.75, 1.0)
    if accuracy is None:
        counts = long.groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("k"))
        boxes = quantiles(counts, keys, "_p", "k", probs)
    else:
        boxes = column_quantiles(long, {"p": F.col("_p")}, keys, probs, accuracy).drop("column")
        counts = long.withColumn("k", F.lit(1))
    q = F.col("q")
    named = boxes.select(
        *keys,
        "n",
        *[q[i].alias(c) for i, c in enumerate(("min", "q1", "median", "q3", "max"))],
    )
    fence = 1.5 * (F.col("q3") - F.col("q1"))
    outside = (F.col("_p") < F.col("q1") - fence) | (F.col("_p") > F.col("q3") + fence)
    beyond = (
        join_on(counts, named.select(*keys, "q1", "q3"), keys)
        .where(outside)
        .groupBy(*keys)
        .agg(F.sum("k").alias("outliers"))
    )
    return join_on(named, beyond, keys, "left").withColumn("outliers", F.coalesce("outliers", F.lit(0)))
