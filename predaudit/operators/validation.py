"""Validation issues as rows: one per failed rule, with severity, column and affected rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from predaudit.functions.keys import attach, group, join_on
from predaudit.functions.safe import is_missing, numeric_columns, text_columns
from predaudit.functions.values import present, value_table
from predaudit.operators.quality import column_moments, completeness, data_columns, duplicates, extreme_values
from predaudit.spec import AuditSpec

ERROR, WARNING, INFO = "error", "warning", "info"
MANY_VALUES = 50
MANY_COLUMNS = 1000
FEW_CLASSES = 20
Z_LIMIT = 5.0


def _issue(
    when: Column,
    rule: str,
    severity: str,
    message: Column | str,
    suggestion: str,
    value: Column | None = None,
    affected: Column | None = None,
    column: Column | None = None,
) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(
        when,
        F.struct(
            F.lit(rule).alias("rule"),
            F.lit(severity).alias("severity"),
            (column if column is not None else F.lit(None)).cast("string").alias("column"),
            (affected if affected is not None else F.lit(None)).cast("long").alias("affected_rows"),
            (value if value is not None else F.lit(None)).cast("double").alias("value"),
            text.alias("message"),
            F.lit(suggestion).alias("suggestion"),
        ),
    )


def _emit(df: DataFrame, by: Sequence[str], issues: Sequence[Column]) -> DataFrame:
    return df.select(*by, F.inline(F.array_compact(F.array(*issues))))


def prediction_facts(df: DataFrame, spec: AuditSpec, by: Sequence[str] = ()) -> DataFrame:
    """``(by…, distinct, smallest, largest, missing, infinite)`` of the predictions."""
    bad = is_missing(df, spec.prediction)
    infinite = (
        F.abs(F.col("_p").cast("double")) == float("inf")
        if spec.prediction in numeric_columns(df)
        else F.lit(False)
    )
    counts = (
        df.select(*by, F.when(~bad, F.col(spec.prediction)).alias("_p"))
        .groupBy(*by, "_p")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return group(
        counts,
        by,
        F.count(F.lit(1)).alias("distinct"),
        F.min("n").alias("smallest"),
        F.max("n").alias("largest"),
        F.coalesce(F.sum(F.when(F.col("_p").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
        F.coalesce(F.sum(F.when(infinite, F.col("n"))), F.lit(0)).alias("infinite"),
    )


def _table_issues(df: DataFrame, spec: AuditSpec, by: Sequence[str]) -> DataFrame:
    columns = data_columns(df, by)
    has_prediction = spec.prediction in df.columns
    n = F.col("rows")
    facts = completeness(df, by).select(*by, "rows", "missing_cells", "missing_percentage")
    facts = attach(facts, duplicates(df, by), by, "_d")
    missing = F.col("missing_percentage")
    copies, copy_share = F.col("_d.duplicate_rows"), F.col("_d.duplicate_percentage")
    issues = [
        _issue(n == 0, "empty_data", ERROR, "The table has no rows", "Provide a table with rows"),
        _issue(
            (n > 0) & F.lit(not has_prediction),
            "no_predictions",
            ERROR,
            "The prediction column is absent",
            "Name an existing prediction column",
        ),
        _issue(
            missing > 50,
            "missing_overall",
            ERROR,
            F.format_string("%.1f%% of all cells are missing", missing),
            "Impute the gaps or use other data",
            missing,
        ),
        _issue(
            (missing > 20) & (missing <= 50),
            "missing_overall",
            WARNING,
            F.format_string("%.1f%% of all cells are missing", missing),
            "Plan an imputation",
            missing,
        ),
        _issue(
            copy_share > 10,
            "duplicates",
            WARNING,
            F.format_string("%d duplicate rows (%.1f%%)", copies, copy_share),
            "Remove duplicates so that they do not leak between splits",
            copy_share,
            copies,
        ),
        _issue(
            (copy_share <= 10) & (copies > 1),
            "duplicates",
            INFO,
            F.format_string("%d duplicate rows", copies),
            "Check that the duplicates are meant",
            copy_share,
            copies,
        ),
        _issue(n < 10, "sample_size", ERROR, F.format_string("Only %d rows", n), "Provide at least 10 rows", n),
        _issue(
            (n >= 10) & (n < 100),
            "sample_size",
            WARNING,
            F.format_string("Only %d rows", n),
            "More rows make the metrics more reliable",
            n,
        ),
        _issue(F.lit(not columns), "no_columns", ERROR, "The table has no columns", "Provide feature columns"),
        _issue(
            F.lit(len(columns) > MANY_COLUMNS),
            "many_columns",
            WARNING,
            f"{len(columns)} columns",
            "Select features first",
            F.lit(len(columns)),
        ),
        _issue(
            F.lit(not numeric_columns(df, columns)),
            "no_numeric_columns",
            WARNING,
            "No numeric column",
            "Correlation and explanations need numeric columns",
        ),
    ]
    for a in spec.protected:
        if a not in df.columns:
            issues.append(
                _issue(
                    F.lit(True),
                    "protected_absent",
                    ERROR,
                    f"Protected attribute '{a}' is not a column",
                    "Correct the attribute list",
                    column=F.lit(a),
                )
            )
    if has_prediction:
        facts = attach(facts, prediction_facts(df, spec, by), by, "_p")
        distinct, nans, infs = F.col("_p.distinct"), F.col("_p.missing"), F.col("_p.infinite")
        issues += [
            _issue(
                nans > 0,
                "prediction_nan",
                ERROR,
                F.format_string("%d predictions are NaN or null", nans),
                "Make the model predict every row",
                nans,
            ),
            _issue(
                infs > 0,
                "prediction_infinite",
                ERROR,
                F.format_string("%d predictions are infinite", infs),
                "Make the model predict finite values",
                infs,
            ),
            _issue(
                distinct == 1,
                "prediction_constant",
                ERROR,
                "All predictions are the same",
                "Check the training and the export of the model",
            ),
            _issue(
                (distinct != 1) & (distinct.cast("double") < n * 0.01),
                "prediction_diversity",
                WARNING,
                F.format_string("Only %d distinct predictions in %d rows", distinct, n),
                "Check whether the model is too coarse",
                distinct,
            ),
            _issue(
                (distinct <= FEW_CLASSES) & (F.col("_p.smallest") < F.col("_p.largest") * 0.01),
                "prediction_imbalance",
                WARNING,
                "The predicted classes are severely imbalanced",
                "Check whether the data or the model causes it",
            ),
        ]
    if spec.truth:
        lost = group(df, by, F.count_if(is_missing(df, spec.truth)).alias("lost"))
        facts = attach(facts, lost, by, "_y")
        issues.append(
            _issue(
                F.col("_y.lost") > 0,
                "truth_nan",
                WARNING,
                F.format_string("%d true values are missing", F.col("_y.lost")),
                "Leave out rows without truth",
                F.col("_y.lost"),
            )
        )
    return _emit(facts, by, issues)


def _column_issues(df: DataFrame, spec: AuditSpec, by: Sequence[str]) -> DataFrame:
    columns = data_columns(df, by)
    texts = text_columns(df, columns)
    protected = [a for a in spec.protected if a in columns]
    keys = [*by, "column"]
    facts = column_moments(df, by, columns)
    counted = list(dict.fromkeys([*texts, *protected]))
    distinct = (
        value_table(df, counted, by)
        .where(present())
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("distinct"))
    )
    facts = join_on(facts, distinct, keys, "left")
    facts = join_on(facts, extreme_values(df, Z_LIMIT, by, columns, sample=True).drop("n"), keys, "left")
    name = F.col("column")
    share = 100.0 * F.try_divide(F.col("missing").cast("double"), F.col("rows").cast("double"))
    there = F.col("rows") - F.col("missing")
    issues = [
        _issue(
            share > 50,
            "missing_column",
            WARNING,
            F.format_string("%.1f%% of '%s' is missing", share, name),
            "Drop the column or impute it",
            share,
            F.col("missing"),
            name,
        ),
        _issue(
            name.isin(texts) & (F.col("distinct") > MANY_VALUES) if texts else F.lit(False),
            "high_cardinality",
            WARNING,
            F.format_string("'%s' has %d distinct values", name, F.col("distinct")),
            "Group or encode the values",
            F.col("distinct"),
            column=name,
        ),
        _issue(
            (there > 1) & (F.col("min") == F.col("max")),
            "zero_variance",
            WARNING,
            F.format_string("All values of '%s' are the same", name),
            "Drop the column, it carries no information",
            column=name,
        ),
        _issue(
            F.col("extremes") > 0,
            "extreme_values",
            WARNING,
            F.format_string("'%s' has %d values beyond 5 standard deviations", name, F.col("extremes")),
            "Check these values for errors",
            F.col("extremes"),
            F.col("extremes"),
            name,
        ),
        _issue(
            name.isin(protected) & (F.col("distinct") > MANY_VALUES) if protected else F.lit(False),
            "protected_cardinality",
            WARNING,
            F.format_string("Protected attribute '%s' has %d groups", name, F.col("distinct")),
            "Merge groups before the bias analysis",
            F.col("distinct"),
            column=name,
        ),
    ]
    return _emit(facts, by, issues)


def validation_issues(df: DataFrame, spec: AuditSpec, by: Sequence[str] = ()) -> DataFrame:
    """``(by…, rule, severity, column, affected_rows, value, message, suggestion)``."""
    issues = _table_issues(df, spec, by)
    return issues.unionByName(_column_issues(df, spec, by)) if data_columns(df, by) else issues


def validation_summary(issues: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Issue counts per severity and whether the table is valid (no error)."""
    severity = F.col("severity")
    counts = group(
        issues,
        by,
        F.count(F.lit(1)).alias("total_issues"),
        F.count_if(severity == ERROR).alias("error_count"),
        F.count_if(severity == WARNING).alias("warning_count"),
        F.count_if(severity == INFO).alias("info_count"),
    )
    return counts.withColumn("is_valid", F.col("error_count") == 0)


def prediction_match(df: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """When predictions live in a second table: rows on each side and rows without a partner.

    Both sides are counted per key before the shuffle, so a hot key costs one row per task.
    """
    left = df.select(F.col(key).alias("_k"), F.lit(1).alias("_l"), F.lit(0).alias("_r"))
    right = predictions.select(F.col(key).alias("_k"), F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    per_key = left.unionByName(right).groupBy("_k").agg(F.sum("_l").alias("l"), F.sum("_r").alias("r"))
    unmatched = F.col("_k").isNull()
    return per_key.agg(
        F.coalesce(F.sum("l"), F.lit(0)).alias("data_rows"),
        F.coalesce(F.sum("r"), F.lit(0)).alias("prediction_rows"),
        F.coalesce(F.sum(F.when((F.col("r") == 0) | unmatched, F.col("l"))), F.lit(0)).alias("data_unmatched"),
        F.coalesce(F.sum(F.when((F.col("l") == 0) | unmatched, F.col("r"))), F.lit(0)).alias(
            "predictions_unmatched"
        ),
    )
