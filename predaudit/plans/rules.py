"""Findings: threshold rules over the tall metrics, as rows with a tag and a plain text.

The tall metrics of a key are folded into one row (a map of table-level metrics, a short list of
attribute gaps and of feature importances), so each rule is a column expression over that row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from predaudit.functions.keys import group
from predaudit.spec import BIAS, EXPLAINABILITY, PERFORMANCE, QUALITY, REGRESSION, AuditSpec

INSIGHT, RECOMMENDATION = "insight", "recommendation"
OVERALL = "overall"  # in place of an analysis, for the line about the whole
CRITICAL, WARN, FAIR, FIX, NOTE = "critical", "warning", "fairness", "fix", "note"

Rule = tuple[Column, str, str, "str | Column"]  # condition, rule id, tag, text

FINDING = "struct<rule:string,tag:string,attribute:string,value:double,text:string>"


def metric(name: str, default: float | None = None) -> Column:
    found = F.element_at("m", name)
    return found if default is None else F.coalesce(found, F.lit(float(default)))


def _struct(rule: str, tag: str, text: str | Column, value: Column | None, attribute: Column | None) -> Column:
    return F.struct(
        F.lit(rule).alias("rule"),
        F.lit(tag).alias("tag"),
        (attribute if attribute is not None else F.lit(None)).cast("string").alias("attribute"),
        (value if value is not None else F.lit(None)).cast("double").alias("value"),
        (F.lit(text) if isinstance(text, str) else text).alias("text"),
    )


def chain(value: Column, *rules: Rule, attribute: Column | None = None) -> list[Column]:
    """An if / else-if chain: the first rule that holds gives the finding."""
    expression = None
    for condition, rule, tag, text in rules:
        finding = _struct(rule, tag, text, value, attribute)
        expression = F.when(condition, finding) if expression is None else expression.when(condition, finding)
    return [expression]


def both(condition: Column, value: Column, *texts: tuple[str, str, str], attribute: Column | None = None) -> list[Column]:
    """Several findings for one condition."""
    return [F.when(condition, _struct(r, tag, text, value, attribute)) for r, tag, text in texts]


def _classification(kind: str) -> list[Column]:
    a, p, r = metric("accuracy", 0), metric("precision", 0), metric("recall", 0)
    f1, mcc, auc = metric("f1_score", 0), metric("matthews_corr", 0), metric("roc_auc")
    if kind == INSIGHT:
        return [
            *chain(
                a,
                (a < 0.5, "accuracy_low", WARN, "Less than half of the predictions are right; retrain the model"),
                (a < 0.7, "accuracy_moderate", NOTE, "Accuracy is moderate; tuning can help"),
                (a > 0.9, "accuracy_high", NOTE, "Accuracy is very high"),
            ),
            *chain(
                p,
                ((p > 0.8) & (r < 0.6), "conservative", NOTE, "The model is cautious: precise, but it misses positives"),
                ((p < 0.6) & (r > 0.8), "aggressive", NOTE, "The model is eager: it finds positives with many false alarms"),
                ((p > 0.8) & (r > 0.8), "balanced", NOTE, "Precision and recall are both high"),
            ),
            *chain(
                mcc,
                (mcc < 0.3, "mcc_low", NOTE, "Matthews correlation is low; the model is weak"),
                (mcc > 0.7, "mcc_high", NOTE, "Matthews correlation is strong"),
            ),
            *chain(
                auc,
                (auc < 0.6, "auc_low", NOTE, "The score separates the classes poorly"),
                (auc > 0.8, "auc_high", NOTE, "The score separates the classes well"),
            ),
        ]
    return [
        *both(
            a < 0.7,
            a,
            ("more_data", FIX, "Engineer features or collect more training data"),
            ("other_algorithms", NOTE, "Compare other algorithms and ensembles"),
        ),
        *both(p < 0.7, p, ("raise_precision", NOTE, "Raise the decision threshold or weigh the classes to gain precision")),
        *both(r < 0.7, r, ("raise_recall", NOTE, "Lower the decision threshold or rebalance the classes to gain recall")),
        *both(f1 < 0.6, f1, ("improve_f1", FAIR, "F1 is poor; the model needs a general improvement")),
        *both(mcc < 0.5, mcc, ("check_balance", NOTE, "Check class balance and data quality")),
    ]


def _regression(kind: str) -> list[Column]:
    r2, skew = metric("r2_score", 0), F.abs(metric("residual_skewness", 0))
    kurt, corr = F.abs(metric("residual_kurtosis", 0)), metric("pearson_correlation", 0)
    mape = metric("mean_absolute_percentage_error", float("inf"))
    if kind == INSIGHT:
        finite = mape < float("inf")
        return [
            *chain(
                r2,
                (r2 < 0, "r2_negative", WARN, "R² is negative; predicting the mean would be better"),
                (r2 < 0.3, "r2_low", NOTE, "R² is low"),
                (r2 < 0.7, "r2_moderate", NOTE, "R² is moderate"),
                (r2 > 0.9, "r2_high", NOTE, "R² is excellent"),
            ),
            *chain(
                skew,
                (skew > 1, "skew_high", NOTE, "Residuals are strongly skewed; the model may be biased"),
                (skew > 0.5, "skew_moderate", NOTE, "Residuals are somewhat skewed; look for outliers"),
            ),
            *chain(kurt, (kurt > 2, "heavy_tails", NOTE, "Residuals have heavy tails")),
            *chain(
                mape,
                (finite & (mape < 0.1), "mape_excellent", NOTE, "The mean percentage error is below 10 %"),
                (finite & (mape < 0.2), "mape_good", NOTE, "The mean percentage error is below 20 %"),
                (finite & (mape > 0.5), "mape_poor", WARN, "The mean percentage error is above 50 %"),
            ),
            *chain(
                corr,
                (corr < 0.7, "corr_low", NOTE, "Predictions correlate weakly with the truth"),
                (corr > 0.95, "corr_high", NOTE, "Predictions follow the truth almost linearly"),
            ),
        ]
    bias, spread = F.abs(metric("residual_mean", 0)), metric("residual_std", 1)
    return [
        *both(
            r2 < 0.5,
            r2,
            ("more_features", FIX, "Engineer features or add polynomial terms"),
            ("other_algorithms", NOTE, "Try other regression algorithms"),
        ),
        *both(
            mape > 0.3,
            mape,
            ("check_quality", NOTE, "The error is large; check the data quality"),
            ("robust_methods", NOTE, "Remove outliers or use robust regression"),
        ),
        *both(
            skew > 1,
            skew,
            ("transform_target", NOTE, "Try a log transform of the target"),
            ("residual_patterns", NOTE, "Look for patterns in the residuals"),
        ),
        *both(bias > 0.1 * spread, bias, ("residual_bias", FAIR, "The mean residual is not zero; the model is biased")),
    ]


def _per_attribute(rules: Callable[[Column], list[Column]]) -> Column:
    """The rules of every attribute, in attribute order."""
    return F.flatten(F.transform("attributes", lambda a: F.array_compact(F.array(*rules(a)))))


def _bias(kind: str) -> Column:
    score = metric("overall_bias_score", 0)

    def gap(a: Column, name: str, default: float) -> Column:
        return F.coalesce(F.element_at(a["gaps"], name), F.lit(default))

    def insight(a: Column) -> list[Column]:
        di, parity, tpr = (
            gap(a, "disparate_impact_ratio", 1.0),
            gap(a, "demographic_parity_diff", 0.0),
            gap(a, "tpr_difference", 0.0),
        )
        name = a["name"]
        return [
            *chain(
                di,
                (di < 0.8, "disparate_impact", CRITICAL, F.format_string("%s: disparate impact, ratio %.2f", name, di)),
                (di < 0.9, "possible_bias", WARN, F.format_string("%s: possible bias, ratio %.2f", name, di)),
                attribute=name,
            ),
            *chain(
                parity,
                (
                    parity > 0.2,
                    "parity_gap",
                    NOTE,
                    F.format_string("%s: positive rates differ by %.2f", name, parity),
                ),
                attribute=name,
            ),
            *chain(
                tpr,
                (tpr > 0.1, "tpr_gap", FAIR, F.format_string("%s: true positive rates differ", name)),
                attribute=name,
            ),
        ]

    def advice(a: Column) -> list[Column]:
        di, parity, tpr = (
            gap(a, "disparate_impact_ratio", 1.0),
            gap(a, "demographic_parity_diff", 0.0),
            gap(a, "tpr_difference", 0.0),
        )
        name = a["name"]

        def one(when: Column, value: Column, rule: str, tag: str, text: str) -> Column:
            return F.when(when, _struct(rule, tag, F.concat(name, F.lit(": " + text)), value, name))

        return [
            one(di < 0.8, di, "tune_thresholds", FAIR, "tune thresholds per group"),
            one(di < 0.8, di, "parity_constraints", NOTE, "train with parity constraints"),
            one(tpr > 0.15, tpr, "equalise_odds", NOTE, "post-process towards equal odds"),
            one(parity > 0.25, parity, "resample", NOTE, "re-sample or re-weight the groups"),
        ]

    if kind == INSIGHT:
        overall = chain(
            score,
            (score < 0.1, "bias_low", NOTE, "Overall bias is low"),
            (score < 0.3, "bias_moderate", WARN, "Overall bias is moderate"),
            (F.lit(True), "bias_high", CRITICAL, "Overall bias is high"),
        )
        return F.concat(F.array(*overall), _per_attribute(insight))
    head = both(
        score > 0.3,
        score,
        ("mitigate_bias", FIX, "Mitigate bias before, during or after training"),
        ("balance_groups", NOTE, "Collect data that is balanced over the groups"),
    )
    tail = both(
        score > 0.2,
        score,
        ("regular_audits", NOTE, "Audit for bias regularly"),
        ("fair_algorithms", NOTE, "Consider fairness-aware algorithms"),
    )
    return F.concat(
        F.array_compact(F.array(*head)), _per_attribute(advice), F.array_compact(F.array(*tail))
    )


def _quality(kind: str) -> list[Column]:
    missing, dup, out = metric("missing_percentage", 0), metric("duplicate_percentage", 0), metric("outlier_percentage", 0)
    bad = metric("predictions_missing", 0) + metric("predictions_infinite", 0)
    balance, pairs = metric("class_balance_ratio", 1), metric("highly_correlated_features", 0)
    skewed = metric("highly_skewed_features", 0)
    if kind == INSIGHT:
        return [
            *chain(
                missing,
                (missing > 20, "missing_high", CRITICAL, F.format_string("%.1f%% of the cells are missing", missing)),
                (missing > 5, "missing_moderate", WARN, F.format_string("%.1f%% of the cells are missing", missing)),
                (missing == 0, "missing_none", NOTE, "No cell is missing"),
            ),
            *chain(
                dup,
                (dup > 10, "duplicates_high", NOTE, F.format_string("%.1f%% of the rows are duplicates", dup)),
                (dup > 0, "duplicates_some", NOTE, F.format_string("%.1f%% of the rows are duplicates", dup)),
            ),
            *chain(
                out,
                (out > 15, "outliers_high", NOTE, F.format_string("%.1f%% of the values are outliers", out)),
                (out > 5, "outliers_moderate", NOTE, F.format_string("%.1f%% of the values are outliers", out)),
            ),
            *chain(bad, (bad > 0, "bad_predictions", WARN, F.format_string("%.0f predictions are missing or infinite", bad))),
            *chain(
                balance,
                (balance < 0.1, "imbalance_severe", FAIR, "The classes are severely imbalanced"),
                (balance < 0.3, "imbalance_moderate", NOTE, "The classes are imbalanced"),
            ),
            *chain(pairs, (pairs > 0, "correlated", NOTE, F.format_string("%.0f pairs of columns are highly correlated", pairs))),
            *chain(skewed, (skewed > 0, "skewed", NOTE, F.format_string("%.0f columns are highly skewed", skewed))),
        ]
    good = (missing < 5) & (dup < 1) & (out < 5)
    return [
        *both(
            missing > 10,
            missing,
            ("impute", FIX, "Impute missing values or drop incomplete rows"),
            ("missing_pattern", NOTE, "Find out why values are missing"),
        ),
        *both(dup > 1, dup, ("deduplicate", NOTE, "Remove duplicate rows")),
        *both(
            out > 10,
            out,
            ("treat_outliers", NOTE, "Check outliers, then transform or remove them"),
            ("robust_models", NOTE, "Use models that tolerate outliers"),
        ),
        *both(bad > 0, bad, ("fix_predictions", WARN, "Repair missing and infinite predictions first")),
        *both(balance < 0.2, balance, ("rebalance", FAIR, "Resample or weigh the classes")),
        *both(pairs > 3, pairs, ("reduce_features", NOTE, "Select features or reduce dimensions")),
        *chain(
            missing,
            (good, "quality_good", NOTE, "Data quality is good"),
            (F.lit(True), "monitor_quality", NOTE, "Monitor data quality and validate inputs"),
        ),
    ]


def _explain(kind: str, columns: int) -> Column:
    failed = F.coalesce(metric("no_numeric_features"), metric("analysis_failed")).isNotNull()
    none = F.size("features") == 0
    skipped = metric("analysis_skipped").isNotNull()
    concentration, diversity = metric("importance_concentration", 0), metric("feature_diversity", 0)
    gini, important = metric("importance_gini", 0), metric("num_important_features", 0)
    strongest = F.get("interactions", F.lit(0))
    strength = F.coalesce(-strongest["order"], F.lit(0.0))

    def only(rule: str, tag: str, text: str) -> Column:
        return F.array(_struct(rule, tag, text, None, None))

    if kind == INSIGHT:
        names = F.array_join(F.transform(F.slice("features", 1, 3), lambda f: f["name"]), ", ")
        rows = [
            _struct("top_features", NOTE, F.concat(F.lit("Most important features: "), names), None, None),
            *chain(
                concentration,
                (concentration > 0.7, "concentrated", NOTE, "Few features carry most of the importance"),
                (concentration < 0.3, "distributed", NOTE, "Importance is spread over many features"),
            ),
            *chain(
                diversity,
                (diversity < 0.2, "diversity_low", WARN, "Few features matter; engineer more"),
                (diversity > 0.6, "diversity_good", NOTE, "Many features matter"),
            ),
            *chain(
                gini,
                (gini > 0.7, "unequal", NOTE, "Importance is distributed very unequally"),
                (gini < 0.3, "equal", FAIR, "Importance is distributed fairly equally"),
            ),
            *chain(
                strength,
                (
                    strength > 0.1,
                    "strong_interaction",
                    NOTE,
                    F.concat(F.lit("Strong interaction: "), strongest["name"]),
                ),
            ),
        ]
        return (
            F.when(skipped, only("needs_truth", NOTE, "Explanations need true values"))
            .when(failed, only("not_explained", WARN, "The explanation could not be made"))
            .when(none, only("no_importance", WARN, "No feature importance was computed"))
            .otherwise(F.array_compact(F.array(*rows)))
        )
    low = F.size(F.filter("features", lambda f: -f["order"] < 0.01))
    rows = [
        *both(low > F.size("features") * 0.5, low, ("drop_features", FIX, "Drop features of little importance")),
        *both(
            concentration > 0.8,
            concentration,
            ("regularise", WARN, "The model hangs on few features; regularise it"),
            ("balance_importance", NOTE, "Engineer features that share the importance"),
        ),
        *both(strength > 0.1, strength, ("interaction_features", NOTE, "Add interaction or polynomial features")),
        *chain(
            important,
            (important < 3, "few_important", NOTE, "Very few features matter; more relevant data may help"),
            (important > F.lit(columns * 0.8), "many_important", NOTE, "Most features matter; the model may be complex"),
        ),
    ]
    found = F.array_compact(F.array(*rows))
    good = only("explainable", NOTE, "The importance is distributed reasonably")
    return (
        F.when(skipped, only("provide_truth", NOTE, "Provide true values for explanations"))
        .when(none, only("check_data", NOTE, "No importance could be computed; check the data"))
        .otherwise(F.when(F.size(found) == 0, good).otherwise(found))
    )


def facts(metrics: DataFrame, spec: AuditSpec, by: Sequence[str] = ()) -> DataFrame:
    """One row per key: table-level metrics as a map, attribute gaps and importances as short arrays."""
    order = F.create_map(*[F.lit(x) for i, a in enumerate(spec.protected) for x in (a, i)]) if spec.protected else None
    rows = metrics.where(F.col("group").isNull())
    name, value, attribute = F.col("metric"), F.col("value"), F.col("attribute")
    global_metric = attribute.isNull()
    position = F.element_at(order, attribute) if order is not None else F.lit(0)
    gap = F.when(
        (F.col("analysis") == BIAS) & ~global_metric, F.struct(position.alias("i"), attribute.alias("name"), name.alias("k"), value.alias("v"))
    )
    folded = group(
        rows,
        by,
        F.map_from_entries(F.collect_list(F.when(global_metric, F.struct("metric", "value")))).alias("m"),
        F.array_sort(F.collect_list(gap)).alias("_gaps"),
        F.array_sort(
            F.collect_list(F.when(name == "feature_importance", F.struct((-value).alias("order"), attribute.alias("name"))))
        ).alias("features"),
        F.array_sort(
            F.collect_list(F.when(name == "feature_interactions", F.struct((-value).alias("order"), attribute.alias("name"))))
        ).alias("interactions"),
        F.collect_set("analysis").alias("present"),
    )
    names = F.array_distinct(F.transform("_gaps", lambda g: g["name"]))
    attributes = F.transform(
        names,
        lambda a: F.struct(
            a.alias("name"),
            F.map_from_entries(
                F.transform(
                    F.filter("_gaps", lambda g: g["name"] == a), lambda g: F.struct(g["k"].alias("k"), g["v"].alias("v"))
                )
            ).alias("gaps"),
        ),
    )
    return folded.withColumn("attributes", attributes).drop("_gaps")


def findings(metrics: DataFrame, spec: AuditSpec, by: Sequence[str] = (), columns: int = 0) -> DataFrame:
    """``(by…, analysis, kind, rule_order, rule, tag, attribute, value, text)``.

    ``columns`` is the width of the audited table, which one explainability rule compares with.
    """
    row = facts(metrics, spec, by)
    performance = _regression if spec.problem == REGRESSION else _classification
    good = F.array(_struct("performance_good", NOTE, "The model performs well", None, None))
    fair = F.array(_struct("fairness_good", NOTE, "The model is fair; keep monitoring it", None, None))

    def or_else(found: Column, fallback: Column) -> Column:
        return F.when(F.size(found) > 0, found).otherwise(fallback)

    def compact(parts: list[Column]) -> Column:
        return F.array_compact(F.array(*parts))

    if spec.truth is None:
        perf = {
            INSIGHT: F.array(_struct("no_truth", NOTE, "Only predictions were analysed", None, None)),
            RECOMMENDATION: F.array(_struct("obtain_truth", NOTE, "Obtain true values to judge performance", None, None)),
        }
    else:
        perf = {
            INSIGHT: compact(performance(INSIGHT)),
            RECOMMENDATION: or_else(compact(performance(RECOMMENDATION)), good),
        }
    arrays = {
        (PERFORMANCE, INSIGHT): perf[INSIGHT],
        (PERFORMANCE, RECOMMENDATION): perf[RECOMMENDATION],
        (BIAS, INSIGHT): _bias(INSIGHT),
        (BIAS, RECOMMENDATION): or_else(_bias(RECOMMENDATION), fair),
        (QUALITY, INSIGHT): compact(_quality(INSIGHT)),
        (QUALITY, RECOMMENDATION): compact(_quality(RECOMMENDATION)),
        (EXPLAINABILITY, INSIGHT): _explain(INSIGHT, columns),
        (EXPLAINABILITY, RECOMMENDATION): _explain(RECOMMENDATION, columns),
    }
    blocks = F.array(
        *[
            F.struct(
                F.lit(analysis).alias("analysis"),
                F.lit(kind).alias("kind"),
                F.when(F.array_contains("present", analysis), found).cast(f"array<{FINDING}>").alias("found"),
            )
            for (analysis, kind), found in arrays.items()
        ]
    )
    opened = row.select(*by, F.inline(blocks)).select(
        *by, "analysis", "kind", F.posexplode("found").alias("position", "finding")
    )
    return opened.select(*by, "analysis", "kind", (F.col("position") + 1).alias("rule_order"), "finding.*")


def _belongs(analysis: str, tags: tuple[str, ...] | None) -> Callable[[Column], Column]:
    def test(finding: Column) -> Column:
        same = finding["analysis"] == analysis
        return same & finding["tag"].isin(*tags) if tags else same

    return test


def _picked(rows: DataFrame, by: Sequence[str], plan: list[tuple[str, int, tuple[str, ...] | None]], cap: int, kind: str) -> DataFrame:
    """Per key the first findings of each analysis in plan order, ``cap`` in all."""
    found = F.array_sort(
        F.collect_list(F.struct("rule_order", "analysis", "rule", "tag", "attribute", "value", "text"))
    )
    folded = group(rows.where(F.col("kind") == kind), by, found.alias("_all"))
    parts = []
    for analysis, count, tags in plan:
        parts.append(F.slice(F.filter("_all", _belongs(analysis, tags)), 1, count))
    chosen = F.slice(reduce(F.concat, parts), 1, cap)
    opened = folded.select(*by, F.posexplode(chosen).alias("position", "f"))
    fields = [F.col("f." + c).alias(c) for c in ("analysis", "rule", "tag", "attribute", "value", "text")]
    return opened.select(*by, (F.col("position") + 1).alias("rank"), *fields)


def key_insights(rows: DataFrame, scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """At most six insights per key, the overall line first."""
    plan = [
        (PERFORMANCE, 2, None),
        (BIAS, 2, (CRITICAL, WARN)),
        (QUALITY, 1, (CRITICAL,)),
        (EXPLAINABILITY, 1, None),
    ]
    picked = _picked(rows, by, plan, 5, INSIGHT).withColumn("rank", F.col("rank") + 1)
    s = F.col("overall_score")
    line = chain(
        s,
        (s > 0.8, "overall_good", NOTE, "Performance and fairness are good overall"),
        (s > 0.6, "overall_moderate", WARN, "Performance is moderate, some areas can improve"),
        (F.lit(True), "overall_poor", CRITICAL, "The model has significant issues"),
    )[0]
    overall = scores.select(*by, line.alias("f")).select(
        *by, F.lit(1).alias("rank"), F.lit(OVERALL).alias("analysis"), "f.*"
    )
    return overall.unionByName(picked)


def priority_recommendations(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """At most five recommendations per key: bias, quality, performance, explainability."""
    plan = [
        (BIAS, 2, (CRITICAL, FAIR)),
        (QUALITY, 2, (FIX,)),
        (PERFORMANCE, 2, None),
        (EXPLAINABILITY, 1, None),
    ]
    return _picked(rows, by, plan, 5, RECOMMENDATION)
