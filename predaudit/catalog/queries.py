"""One registered query per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from predaudit.catalog.views import FAULTY, SPECS, faulty_spec, table, view
from predaudit.operators import charts, classification, explain, fairness, quality, regression, roles, surrogate, validation
from predaudit.plans import report
from predaudit.sources import load, sinks
from predaudit.spec import AUTO, BIAS, QUALITY, REGRESSION
from predaudit.streaming import monitor

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(c: Column) -> Column:
    """Digits that survive another order of summation: about nine significant ones."""
    size = F.abs(c)
    return (
        F.when(size < 5e-7, 0.0)
        .when(size < 1e3, F.round(c, 6))
        .when(size < 1e6, F.round(c, 3))
        .when(size < 1e9, F.round(c, 0))
        .otherwise(F.round(c, -3))
    )


def tidy(df: DataFrame) -> DataFrame:
    doubles = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[rounded(F.col(c)).alias(c) if c in doubles else F.col(c) for c in df.columns])


def lean(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return tidy(metrics.select(*by, F.coalesce("attribute", F.lit("")).alias("attribute"), "metric", "value"))


# --- classification ---------------------------------------------------------------------------


@query
def clf_metrics(spark, sf_dir):
    return lean(classification.performance(view(spark, sf_dir, "risk"), SPECS["risk"]))


@query
def clf_metrics_by_segment(spark, sf_dir):
    by = ["c_mktsegment", "r_name"]
    return lean(classification.performance(view(spark, sf_dir, "risk"), SPECS["risk"], by), by)


@query
def clf_metrics_multiclass(spark, sf_dir):
    return lean(classification.performance(view(spark, sf_dir, "orders_scored"), SPECS["orders_scored"]))


@query
def mcc_kappa(spark, sf_dir):
    by = ["o_orderpriority"]
    spec = SPECS["orders_scored"].with_(class_scores=())
    metrics = classification.performance(view(spark, sf_dir, "orders_scored"), spec, by)
    return lean(metrics.where(F.col("metric").isin("matthews_corr", "cohen_kappa")), by)


@query
def confusion_matrix(spark, sf_dir):
    return classification.confusion_matrix(view(spark, sf_dir, "orders_scored"), SPECS["orders_scored"])


@query
def class_report(spark, sf_dir):
    return tidy(classification.class_report(view(spark, sf_dir, "orders_scored"), SPECS["orders_scored"]))


@query
def most_confused(spark, sf_dir):
    by = ["c_mktsegment"]
    return tidy(classification.most_confused(view(spark, sf_dir, "orders_scored"), SPECS["orders_scored"], by))


@query
def roc_auc(spark, sf_dir):
    return tidy(classification.roc_auc(view(spark, sf_dir, "risk"), SPECS["risk"], ["r_name"]))


@query
def multiclass_auc(spark, sf_dir):
    data, spec = view(spark, sf_dir, "orders_scored"), SPECS["orders_scored"]
    return tidy(classification.multiclass_auc(data, spec, per_class=True))


@query
def log_loss(spark, sf_dir):
    return tidy(classification.log_loss(view(spark, sf_dir, "risk"), SPECS["risk"], ["c_mktsegment"]))


@query
def roc_points(spark, sf_dir):
    points = classification.roc_points(view(spark, sf_dir, "risk"), SPECS["risk"])
    finite = F.when(F.col("threshold") < float("inf"), F.col("threshold")).otherwise(-1.0)
    return points.select(finite.alias("threshold"), *[rounded(F.col(c)).alias(c) for c in ("fpr", "tpr")])


@query
def pr_points(spark, sf_dir):
    points = classification.pr_points(view(spark, sf_dir, "risk"), SPECS["risk"])
    threshold = F.coalesce("threshold", F.lit(-1.0)).alias("threshold")
    return points.select(threshold, *[rounded(F.col(c)).alias(c) for c in ("precision", "recall")])


@query
def label_histogram(spark, sf_dir):
    return classification.value_histogram(view(spark, sf_dir, "orders_scored"), SPECS["orders_scored"])


@query
def pred_distribution(spark, sf_dir):
    metrics = classification.prediction_metrics(view(spark, sf_dir, "orders_scored"), SPECS["orders_scored"])
    return tidy(metrics.select(F.coalesce("group", F.lit("")).alias("label"), "metric", "value"))


# --- regression -------------------------------------------------------------------------------


@query
def reg_metrics(spark, sf_dir):
    return lean(regression.performance(view(spark, sf_dir, "items"), SPECS["items"]))


@query
def reg_metrics_by_flag(spark, sf_dir):
    by = ["l_returnflag", "l_linestatus"]
    return lean(regression.performance(view(spark, sf_dir, "items"), SPECS["items"], by), by)


@query
def jarque_bera(spark, sf_dir):
    return tidy(regression.jarque_bera(view(spark, sf_dir, "items"), SPECS["items"], ["l_returnflag"]))


@query
def ks_normality(spark, sf_dir):
    by = ["l_returnflag"]
    return tidy(regression.ks_normality(view(spark, sf_dir, "items"), SPECS["items"], by))


@query
def shapiro_normality(spark, sf_dir):
    by = ["l_returnflag"]
    return tidy(regression.shapiro_normality(view(spark, sf_dir, "items"), SPECS["items"], by))


@query
def residual_outliers(spark, sf_dir):
    return tidy(regression.residual_outliers(view(spark, sf_dir, "items"), SPECS["items"], ["l_returnflag"]))


@query
def residual_outliers_overall(spark, sf_dir):
    return tidy(regression.residual_outliers(view(spark, sf_dir, "items"), SPECS["items"]))


@query
def error_bands(spark, sf_dir):
    return tidy(regression.error_bands(view(spark, sf_dir, "items"), SPECS["items"], ["l_linestatus"]))


@query
def quartile_perf(spark, sf_dir):
    return tidy(regression.quartile_performance(view(spark, sf_dir, "items"), SPECS["items"]))


@query
def qq_points(spark, sf_dir):
    points = regression.qq_points(view(spark, sf_dir, "items"), SPECS["items"])
    return tidy(points.select("prob", "sample"))


@query
def reg_distribution(spark, sf_dir):
    return tidy(regression.prediction_distribution(view(spark, sf_dir, "items"), SPECS["items"], ["l_returnflag"]))


# --- fairness ---------------------------------------------------------------------------------


@query
def fairness_groups(spark, sf_dir):
    groups = fairness.group_metrics(view(spark, sf_dir, "risk"), SPECS["risk"])
    return tidy(groups.select("attribute", "group", "n", "positive_rate", "tpr", "fpr", "accuracy"))


@query
def fairness_metrics(spark, sf_dir):
    return lean(fairness.fairness_metrics(view(spark, sf_dir, "risk"), SPECS["risk"]))


@query
def fairness_metrics_by_region(spark, sf_dir):
    spec = SPECS["risk"].with_(protected=("c_mktsegment", "o_orderpriority"))
    return lean(fairness.fairness_metrics(view(spark, sf_dir, "risk"), spec, ["r_name"]), ["r_name"])


@query
def fairness_docs(spark, sf_dir):
    return lean(fairness.fairness_metrics(view(spark, sf_dir, "docs"), SPECS["docs"]))


@query
def fairness_multiclass(spark, sf_dir):
    return lean(fairness.fairness_metrics(view(spark, sf_dir, "orders_scored"), SPECS["orders_scored"]))


@query
def fairness_regression(spark, sf_dir):
    return lean(fairness.fairness_metrics(view(spark, sf_dir, "items"), SPECS["items"], normalised=True))


@query
def bias_score(spark, sf_dir):
    spec = SPECS["risk"].with_(protected=("c_mktsegment", "o_orderpriority"))
    metrics = fairness.fairness_metrics(view(spark, sf_dir, "risk"), spec, ["r_name"])
    return tidy(fairness.bias_score(metrics.where(F.col("attribute").isNotNull()), ["r_name"]))


@query
def group_stats(spark, sf_dir):
    stats = fairness.group_statistics(view(spark, sf_dir, "risk"), SPECS["risk"])
    return tidy(stats.select("attribute", "group", "n", "percentage_of_total", "positive_rate", "accuracy"))


@query
def group_stats_regression(spark, sf_dir):
    stats = fairness.group_statistics(view(spark, sf_dir, "items"), SPECS["items"])
    kept = "attribute group n percentage_of_total positive_rate mae rmse r2 mean_prediction std_prediction median_prediction"
    return tidy(stats.select(*kept.split()))


@query
def group_distribution(spark, sf_dir):
    return tidy(fairness.group_distribution(view(spark, sf_dir, "orders_scored"), SPECS["orders_scored"]))


@query
def intersectional(spark, sf_dir):
    cells = fairness.intersectional(view(spark, sf_dir, "risk"), SPECS["risk"])
    names = SPECS["risk"].protected
    return tidy(cells.withColumns({a: F.coalesce(a, F.lit("*")) for a in names}))


@query
def intersectional_pairs(spark, sf_dir):
    cells = fairness.intersectional(view(spark, sf_dir, "items"), SPECS["items"], cube=False)
    return tidy(cells)


@query
def group_boxes(spark, sf_dir):
    return tidy(fairness.group_boxes(view(spark, sf_dir, "items"), SPECS["items"]))


@query
def group_matrix(spark, sf_dir):
    metrics = ("positive_rate", "accuracy", "tpr")
    groups = fairness.group_metrics(view(spark, sf_dir, "risk"), SPECS["risk"])
    rows = groups.select("attribute", "group", *metrics).unpivot(["attribute", "group"], list(metrics), "metric", "value")
    return tidy(charts.group_matrix(rows, metrics, ["attribute"]))


# --- data quality -----------------------------------------------------------------------------


@query
def completeness(spark, sf_dir):
    return tidy(quality.completeness(view(spark, sf_dir, "nulls")))


@query
def missing_by_column(spark, sf_dir):
    return tidy(quality.missing_by_column(view(spark, sf_dir, "nulls"), ["l_linestatus"]))


@query
def duplicates(spark, sf_dir):
    return tidy(quality.duplicates(view(spark, sf_dir, "copies")))


@query
def duplicates_by_digest(spark, sf_dir):
    return tidy(quality.duplicates(view(spark, sf_dir, "copies"), ["lang"], digest=True))


@query
def duplicates_of_events(spark, sf_dir):
    return tidy(quality.duplicates(table(spark, sf_dir, "events")))


@query
def corr_wide(spark, sf_dir):
    return tidy(quality.correlations(view(spark, sf_dir, "wide")))


@query
def column_profile(spark, sf_dir):
    profile = quality.column_profile(view(spark, sf_dir, "nulls")).drop("dtype")
    numbers = ("mean", "std", "min", "max", "median", "skewness", "kurtosis")
    return tidy(profile.withColumns({c: F.coalesce(c, F.lit(-1.0)) for c in numbers}))


@query
def iqr_outliers(spark, sf_dir):
    return tidy(quality.iqr_outliers(view(spark, sf_dir, "items"), ["l_returnflag"]))


@query
def corr_matrix(spark, sf_dir):
    matrix = quality.correlation_matrix(view(spark, sf_dir, "nulls"))
    return tidy(matrix.withColumn("corr", F.coalesce("corr", F.lit(-9.0))))


@query
def vector_quality(spark, sf_dir):
    return tidy(quality.vector_quality(view(spark, sf_dir, "nulls"), "l_tax", ["l_linestatus"]))


@query
def class_balance(spark, sf_dir):
    return tidy(quality.class_balance(view(spark, sf_dir, "orders_scored"), "true_label", ["o_orderpriority"]))


@query
def column_flags(spark, sf_dir):
    return quality.column_flags(view(spark, sf_dir, "nulls"))


@query
def extreme_values(spark, sf_dir):
    return quality.extreme_values(table(spark, sf_dir, "events"), 3.0)


@query
def profiling_summary(spark, sf_dir):
    return quality.profiling_summary(table(spark, sf_dir, "lineitem"))


@query
def quality_scores(spark, sf_dir):
    spec = SPECS["items"].with_(prediction="l_quantity", truth="l_tax")
    return tidy(quality.quality_scores(view(spark, sf_dir, "nulls"), spec))


@query
def quality_metrics(spark, sf_dir):
    return lean(quality.quality_metrics(view(spark, sf_dir, "orders_scored"), SPECS["orders_scored"]))


@query
def histograms(spark, sf_dir):
    return tidy(charts.feature_histograms(view(spark, sf_dir, "nulls"), bins=10))


@query
def residual_histograms(spark, sf_dir):
    return tidy(charts.residual_histograms(view(spark, sf_dir, "items"), SPECS["items"], ["l_returnflag"]))


@query
def column_boxes(spark, sf_dir):
    return tidy(charts.column_boxes(view(spark, sf_dir, "items")))


@query
def distribution_summary(spark, sf_dir):
    return tidy(charts.distribution_summary(view(spark, sf_dir, "items"), "prediction", ["l_linestatus"]))


@query
def completeness_cells(spark, sf_dir):
    return charts.completeness_cells(view(spark, sf_dir, "nulls"))


@query
def residual_points(spark, sf_dir):
    return charts.residual_points(view(spark, sf_dir, "items"), SPECS["items"], order="l_orderkey")


# --- validation -------------------------------------------------------------------------------


def _issues(spark, sf_dir):
    spec = SPECS["items"].with_(prediction="l_quantity", truth="l_tax", protected=("l_linestatus", "absent"))
    return validation.validation_issues(view(spark, sf_dir, "nulls"), spec)


@query
def validation_issues(spark, sf_dir):
    issues = _issues(spark, sf_dir).select(
        "rule",
        "severity",
        F.coalesce("column", F.lit("")).alias("column"),
        F.coalesce("affected_rows", F.lit(-1)).alias("affected_rows"),
    )
    return issues


@query
def validation_rules(spark, sf_dir):
    """Every rule on tables that break it."""
    parts = []
    for name in FAULTY:
        issues = validation.validation_issues(view(spark, sf_dir, name), faulty_spec(name))
        parts.append(
            issues.select(
                F.lit(name).alias("data"), "rule", "severity", F.coalesce("column", F.lit("")).alias("column"),
                F.coalesce("affected_rows", F.lit(-1)).alias("affected_rows"), F.coalesce("value", F.lit(-1.0)).alias("value"),
            )
        )
    return tidy(reduce(DataFrame.unionByName, parts))


@query
def validation_summary(spark, sf_dir):
    return validation.validation_summary(_issues(spark, sf_dir))


@query
def prediction_match(spark, sf_dir):
    data = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "key")
    scored = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "key")
    return validation.prediction_match(data, scored, "key")


# --- roles and configuration ------------------------------------------------------------------


def _joined(df: DataFrame) -> DataFrame:
    """Lists of names as text."""
    lists = {f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)}
    return df.select(*[F.array_join(c, ",").alias(c) if c in lists else F.col(c) for c in df.columns])


@query
def column_roles(spark, sf_dir):
    found = roles.column_roles(view(spark, sf_dir, "docs"))
    return found.select("column", "role", "confidence", F.array_join("suggestions", ",").alias("suggestions"))


@query
def column_roles_by_token(spark, sf_dir):
    found = roles.column_roles(table(spark, sf_dir, "customer"), token_match=True)
    return found.select("column", "role", "confidence")


@query
def column_facts(spark, sf_dir):
    return roles.column_facts(view(spark, sf_dir, "nulls")).select("column", "kind", "rows", "missing", "distinct")


@query
def suggest_columns(spark, sf_dir):
    found = roles.column_roles(view(spark, sf_dir, "docs"))
    return roles.suggest_columns(found, roles.PROTECTED)


@query
def protected_attributes(spark, sf_dir):
    return roles.protected_attributes(view(spark, sf_dir, "docs").withColumnRenamed("lang", "language_group"))


@query
def data_config(spark, sf_dir):
    return _joined(sinks.flatten(roles.data_config(roles.column_roles(view(spark, sf_dir, "docs")))))


@query
def smart_config(spark, sf_dir):
    return _joined(roles.smart_config(view(spark, sf_dir, "docs"), {"truth": "true_label", "protected": ["lang"]}))


@query
def config_confidence(spark, sf_dir):
    data = view(spark, sf_dir, "docs")
    found = roles.column_roles(data)
    return tidy(roles.config_confidence(data, roles.smart_config(data, roles=found), found))


@query
def suggested_analyses(spark, sf_dir):
    data = view(spark, sf_dir, "docs")
    return _joined(roles.suggested_analyses(data, roles.smart_config(data)))


@query
def problem_type(spark, sf_dir):
    parts = []
    for name in ("docs", "orders_scored", "items", "risk"):
        found = roles.problem_modes(view(spark, sf_dir, name), SPECS[name])
        parts.append(found.select(F.lit(name).alias("data"), "*").unpivot("data", list(roles.PROBLEM_MODES), "mode", "problem"))
    return reduce(DataFrame.unionByName, parts)


@query
def problem_type_by_flag(spark, sf_dir):
    return roles.problem_type(view(spark, sf_dir, "items"), SPECS["items"], ["l_returnflag"])


@query
def configuration_issues(spark, sf_dir):
    spec = SPECS["risk"].with_(problem=REGRESSION, features=("absent",))
    issues = roles.configuration_issues(view(spark, sf_dir, "risk"), spec, [BIAS, QUALITY])
    return issues.withColumn("column", F.coalesce("column", F.lit("")))


@query
def prepared_missing(spark, sf_dir):
    return tidy(load.prepare(view(spark, sf_dir, "nulls"), SPECS["items"].with_(timestamp=None)).missing)


# --- explanations -----------------------------------------------------------------------------


def _frame(spark, sf_dir, by=()):
    return explain.feature_frame(view(spark, sf_dir, "items"), SPECS["items"], by)


@query
def target_corr(spark, sf_dir):
    by = ["l_returnflag"]
    return tidy(explain.target_correlation(*_frame(spark, sf_dir, by), by))


@query
def interactions(spark, sf_dir):
    return tidy(explain.interactions(*_frame(spark, sf_dir)))


@query
def interactions_wide(spark, sf_dir):
    return tidy(explain.interactions(*explain.feature_frame(view(spark, sf_dir, "wide"), SPECS["wide"])))


@query
def explain_all_pairs(spark, sf_dir):
    return lean(explain.explain_metrics(view(spark, sf_dir, "wide"), SPECS["wide"], top=None))


@query
def importance_stats(spark, sf_dir):
    return tidy(explain.importance_statistics(explain.correlation_importance(*_frame(spark, sf_dir))))


@query
def feature_ranking(spark, sf_dir):
    by = ["l_returnflag"]
    return tidy(explain.feature_ranking(explain.correlation_importance(*_frame(spark, sf_dir, by), by), by))


@query
def top_features(spark, sf_dir):
    return tidy(charts.top_features(explain.correlation_importance(*_frame(spark, sf_dir)), 3))


@query
def top_correlations(spark, sf_dir):
    return tidy(charts.top_correlations(explain.target_correlation(*_frame(spark, sf_dir)), 3))


@query
def top_interactions(spark, sf_dir):
    return tidy(charts.top_interactions(explain.interactions(*_frame(spark, sf_dir)), 3))


@query
def importance_histogram(spark, sf_dir):
    return tidy(charts.importance_histogram(explain.correlation_importance(*_frame(spark, sf_dir))))


@query
def encoded_features(spark, sf_dir):
    spec = SPECS["items"].with_(features=("l_returnflag", "l_linestatus"))
    frame, names = explain.feature_frame(view(spark, sf_dir, "items"), spec)
    return tidy(explain.target_correlation(frame, names))


@query
def rf_importance(spark, sf_dir):
    return tidy(explain.forest_importance(*_frame(spark, sf_dir), REGRESSION))


@query
def surrogate_splits(spark, sf_dir):
    """The best first split of every key, for classes and for numbers."""
    by, found = ["l_returnflag"], []
    for name in ("picked", "items"):
        frame, names = explain.feature_frame(view(spark, sf_dir, name), SPECS[name], by)
        splits = surrogate.first_splits(frame, names, SPECS[name].problem, by)
        found.append(splits.select(F.lit(SPECS[name].problem).alias("problem"), *splits.columns))
    return tidy(found[0].unionByName(found[1]))


@query
def surrogate_importance(spark, sf_dir):
    by = ["l_returnflag", "l_linestatus"]
    return tidy(surrogate.surrogate_importance(*_frame(spark, sf_dir, by), REGRESSION, by))


@query
def perm_importance(spark, sf_dir):
    features = ["l_quantity", "l_discount", "l_tax"]
    data = table(spark, sf_dir, "lineitem").withColumn("_key", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    price = F.col("l_quantity") * 1500.0 * (1 - F.col("l_discount"))
    found = explain.permutation_importance(
        data, features, "l_extendedprice", "_key", lambda rows: rows.withColumn("prediction", price), REGRESSION
    )
    return found.select("feature", F.round("importance", 1).alias("importance"))


@query
def explain_metrics(spark, sf_dir):
    return lean(explain.explain_metrics(view(spark, sf_dir, "items"), SPECS["items"]))


# --- findings, score, report ------------------------------------------------------------------


def _audit(spark, sf_dir, by=()):
    spec = SPECS["risk"].with_(protected=tuple(a for a in SPECS["risk"].protected if a not in by))
    return report.audit(view(spark, sf_dir, "risk"), spec, by).whole()


@query
def overall_score(spark, sf_dir):
    return tidy(_audit(spark, sf_dir).scores)


@query
def audit_auto(spark, sf_dir):
    """The problem is found out from the values."""
    audit = report.audit(view(spark, sf_dir, "risk"), SPECS["risk"].with_(problem=AUTO)).whole()
    return tidy(audit.scores.select(F.lit(audit.spec.problem).alias("problem_type"), "overall_score"))


@query
def audit_status(spark, sf_dir):
    audit = report.audit(view(spark, sf_dir, "risk"), SPECS["risk"].with_(protected=()))
    return audit.status.select("analysis", "status", F.coalesce("reason", F.lit("")).alias("reason"))


@query
def score_parts(spark, sf_dir):
    audit = _audit(spark, sf_dir, ["r_name"])
    return tidy(report.score_parts(audit.metrics, audit.spec, audit.by))


@query
def findings(spark, sf_dir):
    return tidy(_audit(spark, sf_dir).findings.drop("text"))


@query
def key_insights(spark, sf_dir):
    return tidy(_audit(spark, sf_dir, ["r_name"]).insights)


@query
def priority_recommendations(spark, sf_dir):
    return tidy(_audit(spark, sf_dir, ["r_name"]).recommendations)


@query
def audit_report(spark, sf_dir):
    return sinks.report_json(_audit(spark, sf_dir, ["r_name"]).report, ["r_name"])


@query
def quick_summary(spark, sf_dir):
    audit = _audit(spark, sf_dir, ["r_name"])
    return report.quick_summary(audit.report, audit.spec, audit.by)


@query
def flat_metrics(spark, sf_dir):
    return tidy(sinks.flat_row(_audit(spark, sf_dir)))


@query
def flat_maps(spark, sf_dir):
    return tidy(sinks.flatten_maps(_audit(spark, sf_dir, ["r_name"]).report, ["r_name"]))


@query
def metric_categories(spark, sf_dir):
    metrics = quality.quality_metrics(view(spark, sf_dir, "orders_scored"), SPECS["orders_scored"])
    shares = charts.percent_of_total(charts.metric_categories(metrics), ["category"])
    return tidy(shares.select("category", "metric", "percentage"))


# --- monitoring -------------------------------------------------------------------------------


@query
def windowed_metrics(spark, sf_dir):
    metrics = monitor.windowed_metrics(view(spark, sf_dir, "timed"), SPECS["timed"])
    day = F.date_format("window_start", "yyyy-MM-dd").alias("day")
    return tidy(metrics.select(day, *[c for c in metrics.columns if not c.startswith("window_")]))


@query
def windowed_multiclass(spark, sf_dir):
    metrics = monitor.windowed_metrics(view(spark, sf_dir, "timed_orders"), SPECS["timed_orders"])
    day = F.date_format("window_start", "yyyy-MM-dd").alias("day")
    return tidy(metrics.select(day, *[c for c in metrics.columns if not c.startswith("window_")]))


@query
def windowed_scores(spark, sf_dir):
    scores = monitor.windowed_scores(view(spark, sf_dir, "timed"), SPECS["timed"])
    day = F.date_format("window_start", "yyyy-MM-dd").alias("day")
    return tidy(scores.select(day, *[c for c in scores.columns if not c.startswith("window_")]))


@query
def windowed_drift(spark, sf_dir):
    events, columns = table(spark, sf_dir, "events"), ["value", "event_type"]
    moved = monitor.windowed_drift(events, "ts", columns, monitor.bin_edges(events, columns))
    return tidy(moved.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "column", "psi"))


@query
def drift_psi(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    late = F.dayofmonth("ts") > 15
    return tidy(monitor.population_stability(events, late, ["value", "event_type"]))
