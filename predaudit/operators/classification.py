"""Classification performance. Everything without a score derives from the confusion counts.

Rows whose truth or prediction is missing are left out, as no label can be compared there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from predaudit.functions.keys import attach, group, join_on, tall
from predaudit.functions.ordered import running_totals
from predaudit.functions.safe import clean, clean_double, div, div0, is_numeric
from predaudit.spec import BINARY, PERFORMANCE, AuditSpec

EPSILON = 2.220446049250313e-16  # double machine epsilon, the clip of the log loss
PERFECT = "None (perfect classification)"
BASIC = ("accuracy", "precision", "recall", "f1_score", "matthews_corr", "cohen_kappa")


def label_pair(df: DataFrame, spec: AuditSpec) -> tuple[Column, Column]:
    """Truth and prediction brought to one type: the same, or double for numbers, else string."""
    y, p = clean(df, spec.truth), clean(df, spec.prediction)
    ty, tp = df.schema[spec.truth].dataType, df.schema[spec.prediction].dataType
    if ty == tp:
        return y, p
    common = "double" if is_numeric(ty) and is_numeric(tp) else "string"
    return y.cast(common), p.cast(common)


def confusion_counts(df: DataFrame, spec: AuditSpec, by: Sequence[str] = ()) -> DataFrame:
    """``(by…, truth, prediction, n)`` for the pairs that occur: the one shuffle of the rows."""
    y, p = label_pair(df, spec)
    return (
        df.select(*by, y.alias("truth"), p.alias("prediction"))
        .where(F.col("truth").isNotNull() & F.col("prediction").isNotNull())
        .groupBy(*by, "truth", "prediction")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def label_totals(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by…, label, support, predicted, hits)`` over the union of true and predicted labels."""
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("truth") == F.col("prediction"), F.col("n")).otherwise(zero)
    sides = counts.select(
        *by,
        F.stack(
            F.lit(2), F.col("truth"), F.col("n"), zero, hit, F.col("prediction"), zero, F.col("n"), zero
        ).alias("label", "support", "predicted", "hits"),
    )
    return sides.groupBy(*by, "label").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])


def _label_scores(totals: DataFrame) -> DataFrame:
    """Precision, recall and F1 per label, 0 where undefined."""
    return totals.select(
        "*",
        div0(F.col("hits"), F.col("predicted")).alias("precision"),
        div0(F.col("hits"), F.col("support")).alias("recall"),
        div0(2 * F.col("hits"), F.col("predicted") + F.col("support")).alias("f1_score"),
    )


def basic_metrics(totals: DataFrame, spec: AuditSpec, by: Sequence[str] = ()) -> DataFrame:
    """Size, accuracy, precision, recall, F1, Matthews correlation and Cohen's kappa, one row per key."""
    scored = _label_scores(totals)
    label_type = totals.schema["label"].dataType
    positive = F.col("label") == F.lit(spec.positive).cast(label_type)
    t, p, hits = (F.col(c).cast("double") for c in ("support", "predicted", "hits"))

    def averaged(metric: str) -> Column:
        if spec.problem == BINARY:
            return F.coalesce(F.max(F.when(positive, F.col(metric))), F.lit(0.0))
        return div0(F.sum(F.col(metric) * t), F.sum(t))

    sums = group(
        scored,
        by,
        F.sum(t).alias("_n"),
        F.sum(hits).alias("_c"),
        F.sum(t * p).alias("_tp"),
        F.sum(t * t).alias("_tt"),
        F.sum(p * p).alias("_pp"),
        *[averaged(m).alias(m) for m in ("precision", "recall", "f1_score")],
    ).where(F.col("_n") > 0)
    n, c, tp, tt, pp = (F.col(f"_{x}") for x in ("n", "c", "tp", "tt", "pp"))
    observed, expected = div(c, n), div(tp, n * n)
    return sums.select(
        *by,
        n.cast("long").alias("n"),
        observed.alias("accuracy"),
        "precision",
        "recall",
        "f1_score",
        div0(c * n - tp, F.sqrt((n * n - pp) * (n * n - tt))).alias("matthews_corr"),
        div(observed - expected, 1.0 - expected).alias("cohen_kappa"),
    )


def performance(df: DataFrame, spec: AuditSpec, by: Sequence[str] = ()) -> DataFrame:
    """Tall metrics; AUC and log loss join in when scores are given."""
    if spec.truth is None:
        return prediction_metrics(df, spec, by)
    totals = label_totals(confusion_counts(df, spec, by), by)
    result = tall(basic_metrics(totals, spec, by), by, PERFORMANCE, BASIC)
    if spec.problem == BINARY and spec.score:
        scored = _auc(score_counts(df, spec, by), by, "roc_auc")
        result = result.unionByName(tall(scored, by, PERFORMANCE, ["roc_auc", "log_loss"]))
    elif spec.problem != BINARY and spec.class_scores:
        auc = multiclass_auc(df, spec, by)
        result = result.unionByName(tall(auc, by, PERFORMANCE, ["roc_auc_ovr"]))
    return result


def confusion_matrix(df: DataFrame, spec: AuditSpec, by: Sequence[str] = (), dense: bool = True) -> DataFrame:
    """Counts per (truth, prediction); ``dense`` adds the zero cells over the union of labels.

    A dense matrix has labels² cells by definition. With very many labels ask for the sparse form.
    """
    counts = confusion_counts(df, spec, by)
    if not dense:
        return counts
    labels = group(label_totals(counts, by), by, F.sort_array(F.collect_set("label")).alias("_labels"))
    cells = labels.select(*by, F.explode("_labels").alias("truth"), "_labels").select(
        *by, "truth", F.explode("_labels").alias("prediction")
    )
    keys = [*by, "truth", "prediction"]
    return join_on(cells, counts, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n"))


def class_report(df: DataFrame, spec: AuditSpec, by: Sequence[str] = ()) -> DataFrame:
    """Per label precision, recall, F1 and support, with accuracy, macro and weighted averages."""
    totals = label_totals(confusion_counts(df, spec, by), by)
    scored = _label_scores(totals)
    measures = ("precision", "recall", "f1_score")
    per_label = scored.select(*by, F.col("label").cast("string").alias("label"), *measures, "support")
    weight = F.col("support").cast("double")
    sums = group(
        scored,
        by,
        F.sum("support").alias("support"),
        div0(F.sum("hits"), F.sum("support")).alias("accuracy"),
        *[F.avg(m).alias(f"macro_{m}") for m in measures],
        *[div0(F.sum(F.col(m) * weight), F.sum(weight)).alias(f"weighted_{m}") for m in measures],
    ).where(F.col("support") > 0)
    averages = sums.select(
        *by,
        F.inline(
            F.array(
                F.struct(
                    F.lit("accuracy").alias("label"),
                    *[F.col("accuracy").alias(m) for m in measures],
                    F.col("support"),
                ),
                *[
                    F.struct(
                        F.lit(f"{kind} avg").alias("label"),
                        *[F.col(f"{kind}_{m}").alias(m) for m in measures],
                        F.col("support"),
                    )
                    for kind in ("macro", "weighted")
                ],
            )
        ),
    )
    return per_label.unionByName(averages)


def most_confused(df: DataFrame, spec: AuditSpec, by: Sequence[str] = ()) -> DataFrame:
    """Per true class: support, accuracy and the label it is most often mistaken for."""
    wrong = F.col("truth") != F.col("prediction")
    # min over (-n, label) is the most frequent wrong label, the smallest one on ties
    worst = F.min(F.when(wrong, F.struct(-F.col("n"), F.col("prediction").alias("label"))))
    return (
        confusion_counts(df, spec, by)
        .groupBy(*by, F.col("truth").alias("label"))
        .agg(
            F.sum("n").alias("support"),
            div0(F.sum(F.when(~wrong, F.col("n"))), F.sum("n")).alias("accuracy"),
            worst.alias("_worst"),
        )
        .select(
            *by,
            F.col("label").cast("string").alias("label"),
            "support",
            "accuracy",
            F.coalesce(F.col("_worst.label").cast("string"), F.lit(PERFECT)).alias("most_confused_with"),
        )
    )


def score_counts(df: DataFrame, spec: AuditSpec, by: Sequence[str] = ()) -> DataFrame:
    """``(by…, score, pos, neg)``: positives and negatives per distinct score."""
    y, _ = label_pair(df, spec.with_(prediction=spec.truth))
    positive = F.col("_y") == F.lit(spec.positive).cast(df.schema[spec.truth].dataType)
    return (
        df.select(*by, y.alias("_y"), clean_double(df, spec.score).alias("score"))
        .where(F.col("_y").isNotNull() & F.col("score").isNotNull())
        .groupBy(*by, "score")
        .agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    )


def _auc(counts: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    below = running_totals(counts, keys, "score", ["pos", "neg"])
    pos, neg_below, neg = (F.col(c).cast("double") for c in ("pos", "neg_below", "neg"))
    wins = F.sum(pos * (neg_below + neg / 2))
    clipped = F.greatest(F.least(F.col("score"), F.lit(1.0 - EPSILON)), F.lit(EPSILON))
    loss = -F.sum(pos * F.ln(clipped) + neg * F.ln(1.0 - clipped))
    return group(
        below,
        keys,
        F.max("pos_total").alias("positives"),
        F.max("neg_total").alias("negatives"),
        wins.alias("_wins"),
        loss.alias("_loss"),
    ).select(
        *keys,
        "positives",
        "negatives",
        div(F.col("_wins"), F.col("positives").cast("double") * F.col("negatives")).alias(name),
        div(F.col("_loss"), F.col("positives") + F.col("negatives")).alias("log_loss"),
    )


def roc_auc(df: DataFrame, spec: AuditSpec, by: Sequence[str] = ()) -> DataFrame:
    """``(by…, positives, negatives, roc_auc)``; ties count one half, one class alone gives null."""
    return _auc(score_counts(df, spec, by), by, "roc_auc").drop("log_loss")


def log_loss(df: DataFrame, spec: AuditSpec, by: Sequence[str] = ()) -> DataFrame:
    """``(by…, log_loss)`` with scores clipped away from 0 and 1."""
    y = clean(df, spec.truth)
    s = F.greatest(F.least(clean_double(df, spec.score), F.lit(1.0 - EPSILON)), F.lit(EPSILON))
    positive = y == F.lit(spec.positive).cast(df.schema[spec.truth].dataType)
    rows = df.select(*by, y.alias("_y"), positive.alias("_pos"), s.alias("_s")).where(
        F.col("_y").isNotNull() & clean_double(df, spec.score).isNotNull()
    )
    loss = -F.avg(F.when(F.col("_pos"), F.ln("_s")).otherwise(F.ln(1.0 - F.col("_s"))))
    return group(rows, by, loss.alias("log_loss"))


def multiclass_auc(df: DataFrame, spec: AuditSpec, by: Sequence[str] = (), per_class: bool = False) -> DataFrame:
    """One-vs-rest AUC weighted by support, from one score column per class."""
    parts: list[Column] = []
    for label, column in spec.class_scores:
        parts += [F.lit(str(label)), clean_double(df, column)]
    counts = (
        df.select(
            *by,
            clean(df, spec.truth).cast("string").alias("_y"),
            F.stack(F.lit(len(spec.class_scores)), *parts).alias("label", "score"),
        )
        .where(F.col("_y").isNotNull() & F.col("score").isNotNull())
        .groupBy(*by, "label", "score")
        .agg(
            F.count_if(F.col("_y") == F.col("label")).alias("pos"),
            F.count_if(F.col("_y") != F.col("label")).alias("neg"),
        )
    )
    per_label = _auc(counts, [*by, "label"], "roc_auc").drop("log_loss")
    if per_class:
        return per_label
    weight = F.when(F.col("roc_auc").isNotNull(), F.col("positives").cast("double"))
    return group(per_label, by, div(F.sum(F.col("roc_auc") * weight), F.sum(weight)).alias("roc_auc_ovr"))


def _curve(df: DataFrame, spec: AuditSpec, by: Sequence[str], x: str, y: str, point, end: Column) -> DataFrame:
    """A point per distinct score; the highest score also emits the curve's ``end``."""
    below = running_totals(score_counts(df, spec, by), by, "score", ["pos", "neg"])
    tp = F.col("pos_total") - F.col("pos_below")
    fp = F.col("neg_total") - F.col("neg_below")
    here = F.struct(F.col("score").alias("threshold"), *[c.alias(n) for c, n in zip(point(tp, fp), (x, y))])
    highest = (tp == F.col("pos")) & (fp == F.col("neg"))
    return below.select(*by, F.inline(F.when(highest, F.array(here, end)).otherwise(F.array(here))))


def roc_points(df: DataFrame, spec: AuditSpec, by: Sequence[str] = ()) -> DataFrame:
    """``(by…, threshold, fpr, tpr)`` per distinct score, plus (0, 0) at an infinite threshold."""
    end = F.struct(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )

    def rates(tp: Column, fp: Column) -> tuple[Column, Column]:
        return div(fp, F.col("neg_total")), div(tp, F.col("pos_total"))

    return _curve(df, spec, by, "fpr", "tpr", rates, end)


def pr_points(df: DataFrame, spec: AuditSpec, by: Sequence[str] = ()) -> DataFrame:
    """``(by…, threshold, precision, recall)`` per distinct score, plus the final (1, 0) point."""
    end = F.struct(
        F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
    )

    def precision_recall(tp: Column, fp: Column) -> tuple[Column, Column]:
        return div0(tp, tp + fp), div(tp, F.col("pos_total"))

    return _curve(df, spec, by, "precision", "recall", precision_recall, end)


def value_histogram(df: DataFrame, spec: AuditSpec, by: Sequence[str] = ()) -> DataFrame:
    """``(by…, type, value, n)``: how often each label is predicted and is true."""
    columns = {"Predicted": spec.prediction} | ({"Actual": spec.truth} if spec.truth else {})
    parts: list[Column] = []
    for kind, column in columns.items():
        parts += [F.lit(kind), clean(df, column).cast("string")]
    return (
        df.select(*by, F.stack(F.lit(len(columns)), *parts).alias("type", "value"))
        .where(F.col("value").isNotNull())
        .groupBy(*by, "type", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def prediction_shares(df: DataFrame, spec: AuditSpec, by: Sequence[str] = ()) -> DataFrame:
    """``(by…, value, n, proportion)`` of the predictions alone."""
    counts = (
        df.select(*by, clean(df, spec.prediction).alias("value"))
        .where(F.col("value").isNotNull())
        .groupBy(*by, "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    total = group(counts, by, F.sum("n").alias("_total"))
    return attach(counts, total, by, "_t").select(
        *by, "value", "n", div(F.col("n"), F.col("_t._total")).alias("proportion")
    )


def prediction_metrics(df: DataFrame, spec: AuditSpec, by: Sequence[str] = ()) -> DataFrame:
    """Without truth: distinct count, most common prediction, entropy and the share of each class."""
    shares = prediction_shares(df, spec, by)
    q = F.col("proportion")
    summary = group(
        shares,
        by,
        F.count(F.lit(1)).alias("unique_predictions"),
        F.min(F.struct(-F.col("n"), F.col("value").alias("value"))).alias("_top"),
        (-F.sum(q * F.log2(q + F.lit(1e-10)))).alias("prediction_entropy"),
    ).withColumn("most_common_prediction", F.col("_top.value").cast("string").try_cast("double"))
    names = ["unique_predictions", "most_common_prediction", "prediction_entropy"]
    classes = shares.select(
        *by,
        F.lit(PERFORMANCE).alias("analysis"),
        F.lit(None).cast("string").alias("attribute"),
        F.col("value").cast("string").alias("group"),
        F.lit("class_proportion").alias("metric"),
        q.alias("value"),
    )
    return tall(summary, by, PERFORMANCE, names).unionByName(classes)
