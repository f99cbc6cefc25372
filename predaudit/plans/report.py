"""The whole audit: metrics of the selected analyses, overall score, findings and the report row."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property, reduce

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.errors.exceptions.captured import UnknownException, convert_exception
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from predaudit.functions.keys import attach, group
from predaudit.functions.lineage import cut, store
from predaudit.operators import classification, explain, fairness, quality, regression, roles
from predaudit.plans import rules
from predaudit.spec import ANALYSES, BIAS, EXPLAINABILITY, PERFORMANCE, QUALITY, REGRESSION, AuditSpec

# Weight of each analysis in the overall score.
WEIGHTS = {PERFORMANCE: 0.4, BIAS: 0.3, QUALITY: 0.2, EXPLAINABILITY: 0.1}
NEUTRAL = 0.5
DONE, FAILED, SKIPPED = "done", "failed", "skipped"
STATUS = "analysis string, status string, reason string"
METRIC_TYPES = {"analysis": "string", "attribute": "string", "group": "string", "metric": "string", "value": "double"}


def _performance(df: DataFrame, spec: AuditSpec, by: Sequence[str]) -> DataFrame:
    operator = regression if spec.problem == REGRESSION else classification
    return operator.performance(df, spec, by)


OPERATORS: dict[str, Callable[..., DataFrame]] = {
    PERFORMANCE: _performance,
    BIAS: fairness.fairness_metrics,
    QUALITY: quality.quality_metrics,
    EXPLAINABILITY: explain.explain_metrics,
}


def left_out(df: DataFrame, spec: AuditSpec, analyses: Sequence[str] | None = None) -> dict[str, str | None]:
    """The wanted analyses in order, each with the reason why it cannot run, if there is one."""
    wanted = list(ANALYSES if analyses is None else analyses)
    unknown = [a for a in wanted if a not in OPERATORS]
    if unknown:
        raise ValueError(f"unknown analyses: {unknown}")
    predicted = None if spec.prediction in df.columns else "no prediction column"
    protected = None if fairness.present_attributes(df, spec) else "no protected attribute"
    reasons = {PERFORMANCE: predicted, BIAS: predicted or protected}
    return {a: reasons.get(a) for a in wanted}


def analysis_metrics(
    df: DataFrame, spec: AuditSpec, by: Sequence[str], analysis: str, importance: DataFrame | str = "correlation",
    predict: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Tall metrics of one analysis; ``predict`` makes the importance that of permutations (see :func:`explain.permutation_importance`)."""
    if analysis != EXPLAINABILITY:
        return OPERATORS[analysis](df, spec, by)
    if predict is not None:
        features = spec.feature_columns(df.columns, tuple(by))
        importance = explain.permutation_importance(df, features, spec.truth, spec.identifier, predict, spec.problem, by=by)
    return explain.explain_metrics(df, spec, by, importance)


def all_metrics(
    df: DataFrame, spec: AuditSpec, by: Sequence[str] = (), analyses: Sequence[str] | None = None
) -> DataFrame:
    """One tall table of the metrics of all analyses that have their columns, as a plan."""
    spec = roles.resolved(df, spec)
    parts = [OPERATORS[a](df, spec, by) for a, reason in left_out(df, spec, analyses).items() if reason is None]
    return reduce(DataFrame.unionByName, parts)


def score_parts(metrics: DataFrame, spec: AuditSpec, by: Sequence[str] = ()) -> DataFrame:
    """``(by…, analysis, score, weight)`` of the analyses that are present."""
    value = F.col("value")

    def first(analysis: str, name: str) -> Column:
        hit = (F.col("analysis") == analysis) & (F.col("metric") == name) & F.col("attribute").isNull()
        return F.max(F.when(hit & F.col("group").isNull(), value))

    if spec.problem == REGRESSION:
        r2 = F.coalesce(first(PERFORMANCE, "r2_score"), F.lit(0.0))
        performance = F.greatest(F.lit(0.0), F.least(F.lit(1.0), r2))
    else:
        performance = F.coalesce(first(PERFORMANCE, "accuracy"), F.lit(NEUTRAL))
    scores = {
        PERFORMANCE: performance,
        BIAS: 1.0 - F.coalesce(first(BIAS, "overall_bias_score"), F.lit(NEUTRAL)),
        QUALITY: F.coalesce(first(QUALITY, "confidence_score"), F.lit(1.0)),
        EXPLAINABILITY: F.coalesce(first(EXPLAINABILITY, "feature_diversity"), F.lit(NEUTRAL)),
    }
    wide = group(
        metrics,
        by,
        *[s.alias(a) for a, s in scores.items()],
        *[F.max(F.col("analysis") == a).alias(f"_{a}") for a in scores],
    )
    parts = F.array(
        *[
            F.when(
                F.col(f"_{a}"),
                F.struct(F.lit(a).alias("analysis"), F.col(a).alias("score"), F.lit(WEIGHTS[a]).alias("weight")),
            )
            for a in scores
        ]
    )
    return wide.select(*by, F.inline(F.array_compact(parts)))


def overall_score(metrics: DataFrame, spec: AuditSpec, by: Sequence[str] = ()) -> DataFrame:
    """``(by…, overall_score)``: the weighted mean over the analyses that are present, else 0.5."""
    parts = score_parts(metrics, spec, by)
    mean = F.try_divide(F.sum(F.col("score") * F.col("weight")), F.sum("weight"))
    return group(parts, by, F.coalesce(mean, F.lit(NEUTRAL)).alias("overall_score"))


def _cause(error: Exception) -> JavaObject | None:
    """The innermost cause of an error that comes from a job."""
    cause = getattr(error, "java_exception", None)
    while cause is not None and cause.getCause() is not None:
        cause = cause.getCause()
    return cause


def _of_job(error: Exception) -> bool:
    """Whether a job died (lost executors, a full disk, files that cannot be read): its cause is then none of the errors of plans and values that Spark names."""
    cause = _cause(error)
    return cause is not None and isinstance(convert_exception(cause), UnknownException)


def _reason(error: Exception) -> str:
    """First line of what went wrong, from the innermost cause if the error comes from a task; the last line if it is a trace of Python."""
    cause = _cause(error)
    lines = str(cause.getMessage() if cause is not None else error).partition("JVM stacktrace:")[0].strip().split("\n")
    return lines[-1 if any(line.startswith("Traceback (most recent call last)") for line in lines) else 0][:500]


class Audit:
    """The tables of one audit. Nothing is computed before one of them is asked for.

    ``metrics`` are computed once, analysis by analysis, into reliable storage; an analysis that cannot deal with the data costs its own rows and is named in
    ``status`` and in the report. A job that dies (lost executors, a full disk, files that cannot be read) is no result and raises its error. All other tables
    derive from the metrics, a few rows per key.
    """

    def __init__(
        self, df: DataFrame, spec: AuditSpec, by: Sequence[str], analyses: dict[str, str | None],
        compute: Callable[[DataFrame, str], DataFrame] | None = None, metrics: DataFrame | None = None,
    ):
        self.df, self.spec, self.by = df, spec, tuple(by)
        self._analyses, self._compute, self._given = analyses, compute, metrics

    @cached_property
    def rows(self) -> DataFrame:
        """The audited table, computed once for all analyses, which read it many times; as it is if it cannot be written."""
        if self._given is not None:
            return self.df
        try:
            return store(self.df, "audit-rows")
        except (PySparkException, Py4JJavaError):  # e.g. a type that files cannot hold, or a column that only some analyses compute
            return self.df

    @cached_property
    def _results(self) -> tuple[list[DataFrame], list[tuple]]:
        parts, status = [], []
        for analysis, reason in self._analyses.items():
            if reason is None:
                try:
                    parts.append(cut(self._compute(self.rows, analysis)))
                    status.append((analysis, DONE, None))
                except (PySparkException, Py4JJavaError, ValueError) as error:  # data that an analysis cannot deal with
                    if _of_job(error):
                        raise
                    status.append((analysis, FAILED, _reason(error)))
            else:
                status.append((analysis, SKIPPED, reason))
        return parts, status

    @cached_property
    def metrics(self) -> DataFrame:
        """Tall metrics of all analyses that ran."""
        if self._given is not None:
            return self._given
        parts, _ = self._results
        return reduce(DataFrame.unionByName, parts) if parts else self.df.select(*self.by, *[F.lit(None).cast(t).alias(c) for c, t in METRIC_TYPES.items()]).where(F.lit(False))

    @cached_property
    def _status(self) -> list[tuple]:
        if self._given is None:
            return self._results[1]
        there = {r["analysis"] for r in self._given.select("analysis").distinct().collect()}
        return [(a, DONE, None) if a in there else (a, SKIPPED, "no metrics given") for a in self._analyses]

    @cached_property
    def status(self) -> DataFrame:
        """``(analysis, status, reason)``: done, failed or skipped, one row per wanted analysis."""
        return self.df.sparkSession.createDataFrame(self._status, STATUS)

    @property
    def failed(self) -> dict[str, str]:
        """The analyses that failed, with their reasons."""
        return {a: reason for a, status, reason in self._status if status == FAILED}

    def whole(self) -> Audit:
        """This audit once its analyses ran, if none failed; else an error that names them."""
        if self.failed:
            raise RuntimeError("failed analyses: " + "; ".join(f"{a}: {reason}" for a, reason in self.failed.items()))
        return self

    @cached_property
    def scores(self) -> DataFrame:
        return overall_score(self.metrics, self.spec, self.by)

    @cached_property
    def findings(self) -> DataFrame:
        return rules.findings(self.metrics, self.spec, self.by, len(quality.data_columns(self.df, self.by)))

    @cached_property
    def insights(self) -> DataFrame:
        return rules.key_insights(self.findings, self.scores, self.by)

    @cached_property
    def recommendations(self) -> DataFrame:
        return rules.priority_recommendations(self.findings, self.by)

    @cached_property
    def report(self) -> DataFrame:
        return report_rows(self.rows, self.spec, self.by, self.metrics, self.scores, self.findings, self.insights, self.recommendations, self._status)


def audit(
    df: DataFrame, spec: AuditSpec, by: Sequence[str] = (), analyses: Sequence[str] | None = None, importance: DataFrame | str = "correlation",
    predict: Callable[[DataFrame], DataFrame] | None = None,
) -> Audit:
    """Every table of an audit, per key of ``by`` or for the whole table.

    A problem ``auto`` is found out here, for the whole table. ``importance`` and ``predict`` say which feature importance the audit rests on: correlation, a
    surrogate forest per key, the library's forest, a table of importances, or permutations scored by ``predict``.
    """
    spec = roles.resolved(df, spec)
    return Audit(df, spec, by, left_out(df, spec, analyses), lambda rows, a: analysis_metrics(rows, spec, by, a, importance, predict))


def audit_metrics(df: DataFrame, metrics: DataFrame, spec: AuditSpec, by: Sequence[str] = ()) -> Audit:
    """The same from a metrics table, e.g. one that was written and read back."""
    return Audit(df, spec, by, dict.fromkeys(ANALYSES), metrics=metrics)


def report_rows(
    df: DataFrame,
    spec: AuditSpec,
    by: Sequence[str],
    metrics: DataFrame,
    scores: DataFrame,
    found: DataFrame,
    insights: DataFrame,
    recommendations: DataFrame,
    status: Sequence[tuple],
) -> DataFrame:
    """One row per key: size, the analyses with their status, score, metrics per analysis as maps, findings as ordered arrays.

    What a failed analysis would have given is null, and so is the score; the line about the whole is left out of the insights.
    """
    failed = {a for a, state, _ in status if state == FAILED}
    if failed:
        insights = insights.where(F.col("analysis") != rules.OVERALL)
    name = F.concat_ws("_", "attribute", "metric", "group")
    maps = [
        F.map_from_entries(
            F.collect_list(F.when(F.col("analysis") == a, F.struct(name.alias("k"), F.col("value").alias("v"))))
        ).alias(f"{a}_metrics")
        for a in ANALYSES
    ]

    def unless(missing: bool, value: Column, alias: str) -> Column:
        return (F.when(F.lit(False), value) if missing else value).alias(alias)

    def texts(rows: DataFrame, alias: str) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct("rank", "text")))
        return group(rows, by, F.transform(ordered, lambda r: r["text"]).alias(alias))

    def listed(kind: str, analysis: str) -> Column:
        hit = (F.col("kind") == kind) & (F.col("analysis") == analysis)
        ordered = F.array_sort(F.collect_list(F.when(hit, F.struct("rule_order", "text"))))
        return F.transform(ordered, lambda r: r["text"]).alias(f"{analysis}_{kind}s")

    kinds = (rules.INSIGHT, rules.RECOMMENDATION)
    lists = group(found, by, *[listed(k, a) for a in ANALYSES for k in kinds])
    sizes = group(df, by, F.count(F.lit(1)).alias("sample_size"))
    report = attach(sizes, scores, by, "_s")
    report = attach(report, group(metrics, by, *maps), by, "_m")
    report = attach(report, texts(insights, "key_insights"), by, "_i")
    report = attach(report, texts(recommendations, "priority_recommendations"), by, "_r")
    report = attach(report, lists, by, "_l")
    return report.select(
        *by,
        F.lit(spec.problem).alias("problem_type"),
        "sample_size",
        F.lit(len(quality.data_columns(df, by))).alias("feature_count"),
        F.array(*[F.struct(*map(F.lit, row)) for row in status]).cast(f"array<struct<{STATUS}>>").alias("analyses"),
        unless(bool(failed), F.col("_s.overall_score"), "overall_score"),
        F.col("_i.key_insights").alias("key_insights"),
        F.col("_r.priority_recommendations").alias("priority_recommendations"),
        *[unless(a in failed, F.col(f"_m.{a}_metrics"), f"{a}_metrics") for a in ANALYSES],
        *[unless(a in failed, F.col(f"_l.{a}_{k}s"), f"{a}_{k}s") for a in ANALYSES for k in kinds],
    )


def quick_summary(report: DataFrame, spec: AuditSpec, by: Sequence[str] = ()) -> DataFrame:
    """Rounded score, three findings of each kind and the key metrics, one row per key."""
    if spec.problem == REGRESSION:
        keys = {"r2_score": "r2_score", "rmse": "root_mean_squared_error", "mae": "mean_absolute_error"}
    else:
        keys = {k: k for k in ("accuracy", "precision", "recall", "f1_score")}

    def rounded(analysis: str, name: str) -> Column:
        return F.bround(F.element_at(f"{analysis}_metrics", name), 3)

    return report.select(
        *by,
        "problem_type",
        F.bround("overall_score", 3).alias("overall_score"),
        "sample_size",
        "feature_count",
        F.slice("key_insights", 1, 3).alias("key_insights"),
        F.slice("priority_recommendations", 1, 3).alias("priority_recommendations"),
        *[rounded(PERFORMANCE, m).alias(k) for k, m in keys.items()],
        rounded(BIAS, "overall_bias_score").alias("bias_score"),
        rounded(QUALITY, "completeness_rate").alias("completeness"),
        rounded(QUALITY, "confidence_score").alias("confidence_score"),
    )
