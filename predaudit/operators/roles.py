"""Column roles, problem type and configuration, from column names and one data profile."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from predaudit.functions.keys import attach, group
from predaudit.functions.safe import FLOATING, TEMPORAL, clean, is_missing, numeric_columns, text_columns
from predaudit.functions.values import profiled_columns, value_table
from predaudit.operators.quality import completeness
from predaudit.spec import (
    AUTO,
    BIAS,
    BINARY,
    EXPLAINABILITY,
    MULTICLASS,
    PERFORMANCE,
    QUALITY,
    REGRESSION,
    AuditSpec,
)

PREDICTION, TRUTH, PROBABILITY = "prediction", "true_value", "probability"
PROTECTED, TIMESTAMP, IDENTIFIER, FEATURE = "protected_attribute", "timestamp", "identifier", "feature"

# The name keywords of each role, in tie order of the roles.
KEYWORDS = {
    PREDICTION: (
        "prediction pred predicted predict output y_pred forecast estimate score class label"
    ).split(),
    TRUTH: "true actual real ground_truth target y_true label correct reference expected".split(),
    PROBABILITY: "prob probability confidence score likelihood prob_ proba confidence_score".split(),
    PROTECTED: (
        "gender race ethnicity age religion disability sexual_orientation nationality protected "
        "sensitive demographic group category"
    ).split(),
    TIMESTAMP: "time date timestamp created updated datetime period when at".split(),
    IDENTIFIER: "id identifier key index row record unique uuid guid".split(),
}
# The protected-attribute detector also knows this word.
PROTECTED_EXTRA = ["sex"]

EXACT, EDGE, INSIDE = 1.0, 0.8, 0.6  # name scores
LOW_CONFIDENCE, FEATURE_CONFIDENCE = 0.3, 0.5
FEW_CATEGORIES, FEW_CLASSES, PROTECTED_VALUES = 20, 20, 10


def name_score(name: Column, keywords: Sequence[str], token_match: bool = False) -> Column:
    """1 for an equal name, 0.8 at its start or end, 0.6 inside it; ``token_match`` wants whole words."""
    if token_match:
        words = F.split(name, "_")
        scores = [
            F.when(name == k, EXACT)
            .when(F.array_contains(words, k) | F.contains(F.concat(F.lit("_"), name, F.lit("_")), F.lit(f"_{k}_")), EDGE)
            .otherwise(0.0)
            for k in keywords
        ]
    else:
        scores = [
            F.when(name == k, EXACT)
            .when(name.startswith(k) | name.endswith(k), EDGE)
            .when(name.contains(k), INSIDE)
            .otherwise(0.0)
            for k in keywords
        ]
    return F.greatest(*scores) if len(scores) > 1 else scores[0]


PROBLEM_MODES = ("engine", "analyzer", "config", "column")


def column_facts(df: DataFrame) -> DataFrame:
    """One row per column with what the role rules need.

    ``distinct`` is counted exactly, from the value table.
    """
    columns = df.columns
    comparable = profiled_columns(df, columns)
    texts = set(text_columns(df))
    aggregates, parts = [F.count(F.lit(1)).alias("rows")], []
    absent = F.lit(None)
    for i, c in enumerate(columns):
        dtype = df.schema[c].dataType
        kind = (
            "text"
            if c in texts
            else "time"
            if isinstance(dtype, TEMPORAL)
            else "float"
            if isinstance(dtype, FLOATING)
            else "int"
            if isinstance(dtype, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
            else "bool"
            if isinstance(dtype, T.BooleanType)
            else "other"
        )
        low = high = dated = absent
        aggregates.append(F.count_if(is_missing(df, c)).alias(f"_{i}_missing"))
        if kind == "float":
            aggregates += [F.min(clean(df, c)).alias(f"_{i}_min"), F.max(clean(df, c)).alias(f"_{i}_max")]
            low, high = F.col(f"_{i}_min"), F.col(f"_{i}_max")
        if kind == "text":
            v = F.col(c)
            unparsed = F.count_if(v.isNotNull() & F.try_to_timestamp(v).isNull())
            aggregates.append((unparsed == 0).alias(f"_{i}_dated"))
            dated = F.col(f"_{i}_dated")
        parts += [
            F.lit(i),
            F.lit(c),
            F.lit(kind),
            F.col(f"_{i}_missing"),
            low.cast("double"),
            high.cast("double"),
            dated.cast("boolean"),
        ]
    names = ("ordinal", "column", "kind", "missing", "low", "high", "dated")
    facts = df.agg(*aggregates).select("rows", F.stack(F.lit(len(columns)), *parts).alias(*names))
    exact = (
        value_table(df, comparable)
        .where(F.coalesce("as_text", F.col("as_long").cast("string"), F.col("as_double").cast("string")).isNotNull())
        .groupBy("column")
        .agg(F.count(F.lit(1)).alias("exact"))
    )
    return facts.join(exact, "column", "left").select(
        "ordinal",
        "column",
        "kind",
        "rows",
        "missing",
        F.coalesce("exact", F.lit(0)).alias("distinct"),
        "low",
        "high",
        "dated",
    )


def column_roles(df: DataFrame, token_match: bool = False) -> DataFrame:
    """``(ordinal, column, role, confidence, suggestions)``: name scores, overwritten by data scores."""
    name = F.lower("column")
    kind, distinct = F.col("kind"), F.col("distinct")
    filled = F.col("missing") < F.col("rows")
    binary = F.when((distinct == 2) & kind.isin("int", "bool"), 0.7)
    data = {
        PREDICTION: binary,
        TRUTH: binary,
        PROBABILITY: F.when((kind == "float") & (F.col("low") >= 0) & (F.col("high") <= 1), 0.8),
        PROTECTED: F.when((kind == "text") & (distinct < FEW_CATEGORIES), 0.4),
        TIMESTAMP: F.when((kind == "time") | ((kind == "text") & filled & F.col("dated")), 0.9),
        IDENTIFIER: F.when((distinct == F.col("rows")) & (distinct > 10), 0.8),
    }
    scored = F.array(
        *[
            F.struct(
                (-F.coalesce(data[role], name_score(name, words, token_match))).alias("order"),
                F.lit(i).alias("tie"),
                F.lit(role).alias("role"),
            )
            for i, (role, words) in enumerate(KEYWORDS.items())
        ]
    )
    ranked = F.array_sort(scored)
    best = F.col("_ranked")[0]
    low = -best["order"] < LOW_CONFIDENCE
    return (
        column_facts(df)
        .withColumn("_ranked", ranked)
        .select(
            "ordinal",
            "column",
            F.when(low, FEATURE).otherwise(best["role"]).alias("role"),
            F.when(low, FEATURE_CONFIDENCE).otherwise(-best["order"]).alias("confidence"),
            F.transform(
                F.filter(F.slice("_ranked", 1, 3), lambda s: -s["order"] > LOW_CONFIDENCE), lambda s: s["role"]
            ).alias("suggestions"),
        )
    )


def suggest_columns(roles: DataFrame, role: str) -> DataFrame:
    """Columns of one role, the most confident first."""
    return roles.where(F.col("role") == role).orderBy(F.desc("confidence"), "ordinal").select("column", "confidence")


def protected_attributes(df: DataFrame) -> DataFrame:
    """``(column)``: names with a protected keyword that are text or have at most 10 values."""
    words = KEYWORDS[PROTECTED] + PROTECTED_EXTRA
    named = reduce(lambda a, b: a | b, [F.lower("column").contains(w) for w in words])
    return (
        column_facts(df)
        .where(named & ((F.col("kind") == "text") | (F.col("distinct") <= PROTECTED_VALUES)))
        .select("column")
    )




def data_config(roles: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """One row: the first column of each single role, all columns of the others."""
    role, sure = F.col("role"), F.col("confidence") >= min_confidence

    def first(wanted: str) -> Column:
        return F.min(F.when(sure & (role == wanted), F.struct("ordinal", "column")))["column"]

    def every(wanted: str) -> Column:
        picked = F.collect_list(F.when(sure & (role == wanted), F.struct("ordinal", "column")))
        return F.transform(F.array_sort(picked), lambda s: s["column"])

    return roles.agg(
        first(PREDICTION).alias("prediction"),
        first(TRUTH).alias("truth"),
        every(PROBABILITY).alias("probabilities"),
        every(PROTECTED).alias("protected"),
        first(TIMESTAMP).alias("timestamp"),
        first(IDENTIFIER).alias("identifier"),
        every(FEATURE).alias("features"),
    )


def smart_config(df: DataFrame, preferences: dict | None = None, roles: DataFrame | None = None) -> DataFrame:
    """User preferences first, filled up from roles with confidence of at least 0.5.

    Preferred lists are extended by detected columns. Without any feature, the numeric columns that
    have no other role become features.
    """
    wish = dict(preferences or {})
    found = data_config(roles if roles is not None else column_roles(df), 0.5)

    def single(key: str) -> Column:
        return F.coalesce(F.lit(wish[key]), F.col(key)) if wish.get(key) else F.col(key)

    def several(key: str) -> Column:
        mine = F.array(*[F.lit(c) for c in wish.get(key) or ()]).cast("array<string>")
        return F.array_distinct(F.concat(mine, F.col(key)))

    config = found.select(
        *[single(k).alias(k) for k in ("prediction", "truth", "timestamp", "identifier")],
        *[several(k).alias(k) for k in ("probabilities", "protected", "features")],
    )
    singles = F.array("prediction", "truth", "timestamp", "identifier")
    taken = F.array_compact(F.concat(singles, F.col("probabilities"), F.col("protected")))
    numeric = F.array(*[F.lit(c) for c in numeric_columns(df)]).cast("array<string>")
    features = F.when(F.size("features") > 0, F.col("features")).otherwise(F.array_except(numeric, taken))
    return config.withColumn("features", features)


def to_spec(config: DataFrame, problem: str = AUTO) -> AuditSpec:
    """The one configuration row as a spec; this round trip decides the plan of the audit."""
    row = config.first()
    probabilities = row["probabilities"] or []
    return AuditSpec(
        prediction=row["prediction"],
        truth=row["truth"],
        score=probabilities[0] if probabilities else None,
        protected=tuple(row["protected"] or ()),
        features=tuple(row["features"] or ()) or None,
        timestamp=row["timestamp"],
        identifier=row["identifier"],
        problem=problem,
    )


def _value_facts(df: DataFrame, name: str, by: Sequence[str], tag: str) -> DataFrame:
    """``(by…, <tag>_distinct, <tag>_integral)`` from the distinct values, which are counted exactly."""
    v = F.col("_v")
    values = df.select(*by, clean(df, name).alias("_v")).where(v.isNotNull()).distinct()
    number = values.schema["_v"].dataType
    as_double = v.try_cast("double") if isinstance(number, T.StringType) else v.cast("double")
    whole = F.coalesce(as_double == F.floor(as_double), F.lit(False))
    if isinstance(number, (*FLOATING, T.DecimalType)):
        whole = whole & (F.abs(as_double) < float("inf"))
    return group(values, by, F.count("_v").alias(f"{tag}_distinct"), F.bool_and(whole).alias(f"{tag}_integral"))


def problem_modes(df: DataFrame, spec: AuditSpec, by: Sequence[str] = ()) -> DataFrame:
    """``(by…, engine, analyzer, config, column)``: the problem under the rules of every mode, from one row of facts per key.

    ``engine``: predictions with 2 values are binary; whole numbers with up to 20 multiclass; then
    the same for a whole-number truth; else regression. ``analyzer``: float predictions with more
    than 20 values are regression, 2 binary, up to 20 multiclass. ``config``: the prediction column
    alone decides, else the truth; multiclass wants whole numbers or, by column, an int or text type.
    """
    facts = _value_facts(df, spec.prediction, by, "p")
    pd, pi = F.col("p_distinct"), F.col("p_integral")
    engine = F.when(pd == 2, BINARY).when(pi & (pd <= FEW_CLASSES), MULTICLASS)
    if spec.truth:
        facts = attach(facts, _value_facts(df, spec.truth, by, "y"), by, "_t")
        yd, yi = F.col("_t.y_distinct"), F.col("_t.y_integral")
        few = (yd <= FEW_CLASSES) & yi
        engine = engine.when(few & (yd == 2), BINARY).when(few, MULTICLASS)
    discrete = isinstance(df.schema[spec.prediction].dataType, (T.LongType, T.IntegerType, T.StringType))
    rules = {
        "engine": engine,
        "analyzer": F.when(pd == 2, BINARY).when(pd <= FEW_CLASSES, MULTICLASS),
        "config": F.when(pd == 2, BINARY).when((pd <= FEW_CLASSES) & pi, MULTICLASS),
        "column": F.when(pd == 2, BINARY).when((pd <= FEW_CLASSES) & F.lit(discrete), MULTICLASS),
    }
    return facts.select(*by, *[rule.otherwise(REGRESSION).alias(mode) for mode, rule in rules.items()])


def problem_type(df: DataFrame, spec: AuditSpec, by: Sequence[str] = (), mode: str = "engine") -> DataFrame:
    """``(by…, problem)`` under the rules of one mode of :func:`problem_modes`."""
    if mode not in PROBLEM_MODES:
        raise ValueError(f"unknown mode {mode!r}")
    return problem_modes(df, spec, by).select(*by, F.col(mode).alias("problem"))


def resolved(df: DataFrame, spec: AuditSpec) -> AuditSpec:
    """The spec with its problem found out from one row of facts, if it is ``auto``; without predictions there is nothing to tell by."""
    if spec.problem != AUTO:
        return spec
    found = problem_type(df, spec).first() if spec.prediction in df.columns else None
    return spec.with_(problem=found["problem"] if found else BINARY)


def suggested_analyses(df: DataFrame, config: DataFrame) -> DataFrame:
    """``(analyses)``: quality always, the others when their columns are there."""
    explains = (F.size("features") > 0) | F.lit(bool(numeric_columns(df)))
    chosen = F.array(
        F.lit(QUALITY),
        F.when(F.col("prediction").isNotNull(), PERFORMANCE),
        F.when(F.size("protected") > 0, BIAS),
        F.when(explains, EXPLAINABILITY),
    )
    return config.select(F.array_compact(chosen).alias("analyses"))


def config_confidence(df: DataFrame, config: DataFrame, roles: DataFrame) -> DataFrame:
    """``(prediction_column, true_value_column, protected_attributes, overall)`` confidences."""
    sure = roles.agg(
        F.map_from_entries(F.collect_list(F.struct("column", "confidence"))).alias("by_column")
    )
    known = attach(config, sure, (), "_r")
    known = attach(known, completeness(df).select("rows", "completeness_rate"), (), "_c")

    def of(column: Column) -> Column:
        return F.coalesce(F.element_at("_r.by_column", column), F.lit(FEATURE_CONFIDENCE))

    found = F.array_compact(F.transform("protected", lambda a: F.element_at("_r.by_column", a)))
    total = F.aggregate(found, F.lit(0.0), lambda a, b: a + b)
    protected = F.coalesce(F.try_divide(total, F.size(found)), F.lit(0.5))
    scores = known.select(
        F.when(F.col("prediction").isNotNull(), of(F.col("prediction"))).alias("prediction_column"),
        F.when(F.col("truth").isNotNull(), of(F.col("truth"))).alias("true_value_column"),
        F.when(F.size("protected") > 0, protected).alias("protected_attributes"),
        F.col("_c.completeness_rate").alias("_complete"),
        F.least(F.lit(1.0), F.col("_c.rows") / 1000.0).alias("_size"),
    )
    parts = F.array_compact(F.array("prediction_column", "true_value_column", "protected_attributes"))
    mean = F.coalesce(F.try_divide(F.aggregate(parts, F.lit(0.0), lambda a, b: a + b), F.size(parts)), F.lit(0.5))
    numeric_share = F.lit(len(numeric_columns(df)) / len(df.columns))
    overall = (F.coalesce("_complete", F.lit(0.0)) + F.col("_size") + numeric_share + mean) / 4.0
    return scores.select(
        "prediction_column", "true_value_column", "protected_attributes", overall.alias("overall")
    )


def configuration_issues(df: DataFrame, spec: AuditSpec, analyses: Sequence[str]) -> DataFrame:
    """``(issue, column)`` rows for a configuration that does not fit the data."""
    wanted = [*spec.role_columns, *spec.protected, *(spec.features or ())]
    absent = [c for c in dict.fromkeys(wanted) if c not in df.columns]
    facts = df.agg(F.count(F.lit(1)).alias("rows"))
    suspicious = F.lit(False)
    if spec.problem == REGRESSION and spec.prediction in df.columns:
        facts = attach(facts, _value_facts(df, spec.prediction, (), "p"), (), "_p")
        suspicious = F.col("_p.p_distinct") <= 10

    def issue(when: Column, text: str, column: str | None = None) -> Column:
        return F.when(when, F.struct(F.lit(text).alias("issue"), F.lit(column).cast("string").alias("column")))

    no_numbers = EXPLAINABILITY in analyses and not numeric_columns(df)
    no_groups = BIAS in analyses and not spec.protected
    issues = [issue(F.lit(True), "missing_column", c) for c in absent]
    issues += [
        issue(F.lit(not spec.prediction), "no_prediction_column"),
        issue(F.col("rows") < 10, "sample_size"),
        issue(F.lit(no_numbers), "explainability_needs_numeric_columns"),
        issue(F.lit(no_groups), "bias_needs_protected_attributes"),
        issue(suspicious, "regression_with_few_predictions", spec.prediction),
    ]
    return facts.select(F.inline(F.array_compact(F.array(*issues))))
