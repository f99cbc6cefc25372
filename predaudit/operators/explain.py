"""Feature importance, target correlation, interactions and statistics about them."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from predaudit.functions.gram import product_correlations
from predaudit.functions.keys import attach, group, join_on, measured, tall
from predaudit.functions.lineage import cut
from predaudit.functions.safe import clean_double, corr, div0, numeric_columns, text_columns
from predaudit.operators.quality import CHUNK_COLUMNS, _chunks, _union
from predaudit.operators.surrogate import deep_splits, importances, surrogate_importance
from predaudit.spec import EXPLAINABILITY, REGRESSION, AuditSpec

TOP_FEATURES = 10
IMPORTANT = 0.01
ENCODED_VALUES = 20
REPEATS, SEED, TREES, MAX_DEPTH = 5, 42, 50, 30
FOREST_BINS = 31  # cuts of a feature
SHUFFLE_ROWS = 100_000  # rows per bucket inside which a feature is permuted
TARGET = "_target"


def feature_frame(
    df: DataFrame, spec: AuditSpec, by: Sequence[str] = (), labels: bool = False
) -> tuple[DataFrame, list[str]]:
    """``(by…, _target, features…)`` as doubles with gaps filled by the mean, and the feature names.

    Numeric features only; when there is none, text features with up to 20 values become codes in
    alphabetical order. An empty name list says that nothing can be explained. A text truth that holds no
    numbers leaves no rows, unless ``labels`` asks for it as it is, as a forest does.
    """
    wanted = spec.feature_columns(df.columns, tuple(by))
    names = numeric_columns(df, wanted)
    if spec.truth in numeric_columns(df):
        target = clean_double(df, spec.truth)
    else:
        target = F.col(spec.truth).cast("string") if labels else F.col(spec.truth).try_cast("double")
    if names:
        rows = df.select(*by, target.alias(TARGET), *[clean_double(df, c).alias(c) for c in names])
    else:
        names, codes = _codes(df, text_columns(df, wanted))
        rows = df
        for c, levels in codes.items():
            position = F.array_position(F.lit(levels), F.col(c))
            rows = rows.withColumn(c, F.when(F.col(c).isNotNull(), position - 1).cast("double"))
        rows = rows.select(*by, target.alias(TARGET), *names)
    if not names:
        return rows, []
    means, few = measured(group(rows, by, *[F.avg(c).alias(c) for c in names]), by)
    filled = attach(rows.where(F.col(TARGET).isNotNull()), means, by, "_mean", small=few)
    return (
        filled.select(*by, TARGET, *[F.coalesce(F.col(c), F.col(f"_mean.`{c}`")).alias(c) for c in names]),
        names,
    )


def _codes(df: DataFrame, texts: Sequence[str]) -> tuple[list[str], dict[str, list[str]]]:
    """Sorted levels of the text columns that have at most 20 of them: a bounded read for the plan."""
    if not texts:
        return [], {}
    about = df.agg(*[F.approx_count_distinct(c).alias(c) for c in texts]).first()
    small = [c for c in texts if about[c] <= 5 * ENCODED_VALUES]
    if not small:
        return [], {}
    levels = df.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in small]).first()
    codes = {c: list(levels[c]) for c in small if 0 < len(levels[c]) <= ENCODED_VALUES}
    return list(codes), codes


def target_correlation(frame: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(by…, feature, corr)`` of a feature frame; 0 for a constant feature, absent without a numeric target."""
    frames = []
    for chunk in _chunks(list(names), CHUNK_COLUMNS):
        parts: list[Column] = []
        for i, c in enumerate(chunk):
            parts += [F.lit(c), F.coalesce(F.col(f"_{i}"), F.lit(0.0))]
        values = [corr(F.col(c), F.col(TARGET)).alias(f"_{i}") for i, c in enumerate(chunk)]
        stacked = F.stack(F.lit(len(chunk)), *parts).alias("feature", "corr")
        frames.append(group(frame, by, F.count(TARGET).alias("_n"), *values).where("_n > 0").select(*by, stacked))
    return _union(frames)


def correlation_importance(frame: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(by…, feature, importance)``: the absolute target correlation."""
    return target_correlation(frame, names, by).select(*by, "feature", F.abs("corr").alias("importance"))


def feature_effects(frame: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(by…, feature_a, feature_b, value)``: target correlations (``feature_b`` null; 0 for a constant feature) and interactions.

    An interaction is what the product of two features adds to the better one, for all pairs, in one scan. Pairs with a constant feature or product
    have none.
    """
    names = list(names)
    found = product_correlations(frame, names, TARGET, by)
    last = len(names)
    single = found.where(F.col("j") == last).drop("j", "n")
    text = F.array(*[F.lit(c) for c in names])

    def name(index: str) -> Column:
        return F.element_at(text, F.col(index) + 1)

    pairs = found.where((F.col("j") < last) & F.col("corr").isNotNull())
    for side, position in (("a", "i"), ("b", "j")):
        alone = single.select(*by, F.col("i").alias(position), F.abs("corr").alias(f"_{side}"))
        pairs = join_on(pairs, alone, [*by, position])
    gain = F.greatest(F.lit(0.0), F.abs("corr") - F.greatest("_a", "_b"))
    known = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    strengths = pairs.where(known).select(*by, name("i").alias("feature_a"), name("j").alias("feature_b"), gain.alias("value"))
    alone = single.select(*by, name("i").alias("feature_a"), F.lit(None).cast("string").alias("feature_b"), F.coalesce("corr", F.lit(0.0)).alias("value"))
    return alone.unionByName(strengths)


def interactions(frame: DataFrame, names: Sequence[str], by: Sequence[str] = (), top: int | None = None) -> DataFrame:
    """``(by…, feature_a, feature_b, strength)``: what the product adds over the better single feature, for all pairs.

    ``top`` keeps the pairs among so many features of each key, the best by |target correlation|.
    """
    if len(names) < 2:
        empty = [F.lit(None).cast(t).alias(c) for c, t in (("feature_a", "string"), ("feature_b", "string"), ("strength", "double"))]
        return frame.select(*by, *empty).where(F.lit(False))
    return _among_best(feature_effects(frame, names, by), names, by, top)


def _among_best(effects: DataFrame, names: Sequence[str], by: Sequence[str], top: int | None) -> DataFrame:
    pairs = effects.where(F.col("feature_b").isNotNull()).withColumnRenamed("value", "strength")
    if top is None or len(names) <= top:
        return pairs
    ordinal = F.create_map(*[F.lit(x) for i, c in enumerate(names) for x in (c, i)])
    ranked = F.array_sort(F.collect_list(F.struct((-F.abs("value")).alias("value"), F.element_at(ordinal, F.col("feature_a")).alias("at"), "feature_a")))
    best = group(effects.where(F.col("feature_b").isNull()), by, F.transform(F.slice(ranked, 1, top), lambda f: f["feature_a"]).alias("best"))
    chosen = attach(pairs, best, by, "_best")
    return chosen.where(F.array_contains("_best.best", F.col("feature_a")) & F.array_contains("_best.best", F.col("feature_b"))).drop("_best")


def forest_importance(
    frame: DataFrame, names: Sequence[str], problem: str, trees: int = TREES, max_depth: int = MAX_DEPTH
) -> DataFrame:
    """``(feature, importance)``: impurity importance of a random forest fitted to the truth.

    Trees grow to ``max_depth``, level by level over sums of rows with the same codes (see :mod:`predaudit.operators.surrogate`). Each node may split on a third
    of the features, for classes on their square root. Features without any value are left out of the forest and have importance 0.
    """
    rows = frame.where(F.col(TARGET).isNotNull())
    present = frame.agg(*[F.count(c).alias(c) for c in names]).first()
    used = [c for c in names if present[c]]
    if not used:
        raise ValueError("no feature has a value")
    if rows.isEmpty():
        raise ValueError("no row has a truth")
    share = len(used) if trees == 1 else math.ceil(len(used) / 3 if problem == REGRESSION else math.sqrt(len(used)))
    splits = deep_splits(rows, used, problem, trees, max_depth, FOREST_BINS, share)
    every = frame.sparkSession.range(1).select(F.lit(0).cast("long").alias("key"))
    return importances(splits, every, names)


def permutation_importance(
    df: DataFrame,
    features: Sequence[str],
    truth: str,
    identifier: str,
    predict: Callable[[DataFrame], DataFrame],
    problem: str,
    repeats: int = REPEATS,
    bucket_rows: int = SHUFFLE_ROWS,
    rows: int | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """``(by…, feature, importance)``: mean loss of accuracy, or rise of squared error, without a feature.

    ``predict`` adds a ``prediction`` column to a frame with the feature columns, e.g. a fitted
    pipeline's ``transform``; key columns are passed on to it. Per repeat, rows fall into random buckets of their key and each row takes the
    features of the next row of its bucket in random order: one window per bucket, never a global
    one. The row of every feature variant is then built in place, without another shuffle. Order and buckets come from digests of the
    identifier; rows without one are dealt by their values.

    Repeats are computed here, one after the other, and each drops its shuffle before the next begins, so the disk holds the rows once and not once per
    repeat. A row is shuffled as its bucket, its digest, the truth and the features. ``df`` is read once per repeat, and before for its size and loss.
    """
    features, by = list(features), list(by)
    name = F.coalesce(F.col(identifier).cast("string"), F.xxhash64(F.col(truth), *features).cast("string"))
    size = df.count() if rows is None else rows
    buckets = max(1, -(-size // bucket_rows))
    # as an expression over the columns that are shuffled, it is computed after the shuffle
    ring = Window.partitionBy(*by, "_bucket").orderBy("_order", F.xxhash64("_y", *features))
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = F.struct(*features)
    variants = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                *[(F.col(f"_other.`{c}`") if c == f else F.col(c)).alias(c) for c in features],
            )
            for f in features
        ]
    )

    def permuted(repeat: int) -> DataFrame:
        digests = [F.md5(F.concat_ws(":", name, F.lit(repeat), F.lit(seed))) for seed in (SEED, SEED + 1)]
        bucket = F.pmod(F.conv(F.substring(digests[0], 1, 12), 16, 10).cast("long"), F.lit(buckets))
        dealt = df.select(*by, bucket.alias("_bucket"), F.unhex(digests[1]).alias("_order"), F.col(truth).alias("_y"), *features)
        # dealt out before the window, so that what the window adds to a row is not shuffled
        shuffled = dealt.repartition(*by, "_bucket").withColumn("_other", F.coalesce(F.lead(own).over(ring), F.first(own).over(whole)))
        return shuffled.select(*by, "_y", F.inline(variants))

    def loss(scored: DataFrame) -> Column:
        if problem == REGRESSION:
            return F.avg(F.pow(F.col("_y").cast("double") - F.col("prediction").cast("double"), 2))
        return 1.0 - F.avg((F.col("_y").cast("double") == F.col("prediction").cast("double")).cast("double"))

    before = predict(df.select(*by, F.col(truth).alias("_y"), *features))
    before = group(before, by, loss(before).alias("loss"))
    per_repeat = []
    for repeat in range(repeats):
        after = predict(permuted(repeat))
        per_repeat.append(cut(after.groupBy(*by, "feature").agg(loss(after).alias("loss")), drop_shuffles=True))
    mean = _union(per_repeat).groupBy(*by, "feature").agg(F.avg("loss").alias("loss"))
    return attach(mean, before, by, "_b").select(
        *by, "feature", (F.col("loss") - F.col("_b.loss")).alias("importance")
    )


def _by_rank(importance: DataFrame, by: Sequence[str]) -> DataFrame:
    """Importances as one sorted array per key: a row per feature is what a key holds."""
    return group(
        importance, by, F.sort_array(F.collect_list("importance"), asc=False).alias("_v")
    ).where(F.size("_v") > 0)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


STATISTICS = (
    "top_feature_importance",
    "top_3_importance_sum",
    "importance_concentration",
    "importance_gini",
    "num_important_features",
    "feature_diversity",
    "mean_importance",
    "std_importance",
    "min_importance",
    "max_importance",
    "median_importance",
    "effective_feature_count",
    "importance_entropy",
    "feature_utilization_rate",
)


def importance_statistics(importance: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Concentration, Gini, diversity, moments and entropy of the importances, one row per key.

    The Gini coefficient is taken over importances scaled to sum to 1.
    """
    v, n = F.col("_v"), F.size("_v").cast("double")
    total, top3 = _total(v), _total(F.slice("_v", 1, 3))
    important = F.size(F.filter("_v", lambda x: x > IMPORTANT)).cast("double")
    mean = total / n
    variance = _total(F.transform("_v", lambda x: (x - mean) * (x - mean))) / n
    # descending position i (from 0) is ascending position n - i, so its weight n + 1 - (n - i) is i + 1
    weighted = _total(F.transform("_v", lambda x, i: (i + 1) * x))
    gini = F.when(total == 0, 0.0).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), (n + 1.0 - 2.0 * F.try_divide(weighted, total)) / n))
    )
    shares = F.filter(F.transform("_v", lambda x: F.try_divide(x, total)), lambda q: q > 0)
    entropy = F.coalesce(-_total(F.transform(shares, lambda q: q * F.log2(q))), F.lit(0.0))
    half = F.floor((F.size("_v") - 1) / 2).cast("int")
    median = (F.get("_v", half) + F.get("_v", F.size("_v") - 1 - half)) / 2.0
    return _by_rank(importance, by).select(
        *by,
        v[0].alias("top_feature_importance"),
        top3.alias("top_3_importance_sum"),
        div0(top3, total).alias("importance_concentration"),
        gini.alias("importance_gini"),
        important.alias("num_important_features"),
        (important / n).alias("feature_diversity"),
        mean.alias("mean_importance"),
        F.sqrt(variance).alias("std_importance"),
        F.array_min(v).alias("min_importance"),
        F.array_max(v).alias("max_importance"),
        median.alias("median_importance"),
        important.alias("effective_feature_count"),
        F.when(total == 0, 0.0).otherwise(entropy).alias("importance_entropy"),
        (important / n).alias("feature_utilization_rate"),
    )


def feature_ranking(importance: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by…, rank, feature, importance, importance_percentage, level)``; ties by feature name.

    Levels: high above the 75th percentile, low up to the 25th, medium between.
    """
    order = Window.partitionBy(*by).orderBy(F.desc("importance"), "feature")
    whole = Window.partitionBy(*by)
    ascending = F.sort_array(F.collect_list("importance").over(whole))
    at = [(F.size("_a") - 1) * p for p in (0.25, 0.75)]

    def cut(h: Column) -> Column:
        low, high = F.get("_a", F.floor(h).cast("int")), F.get("_a", F.ceil(h).cast("int"))
        return low + (high - low) * (h - F.floor(h))

    value = F.col("importance")
    level = F.when(value > cut(at[1]), "high").when(value > cut(at[0]), "medium").otherwise("low")
    return (
        importance.withColumn("rank", F.row_number().over(order))
        .withColumn("importance_percentage", 100.0 * div0(value, F.sum("importance").over(whole)))
        .withColumn("_a", ascending)
        .select(*by, "rank", "feature", "importance", "importance_percentage", level.alias("level"))
    )


def _status(df: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    return tall(group(df, by, F.max(F.lit(1.0)).alias(name)), by, EXPLAINABILITY, [name])


def explain_metrics(
    df: DataFrame,
    spec: AuditSpec,
    by: Sequence[str] = (),
    importance: DataFrame | str = "correlation",
    top: int | None = TOP_FEATURES,
) -> DataFrame:
    """Tall explainability metrics: statistics, each feature's importance and correlation, interactions.

    ``importance`` is ``"correlation"``, ``"surrogate"`` (a forest per key, see the module of that name), ``"forest"`` (the library's forest, no
    keys) or a ``(by…, feature, importance)`` table, e.g. of :func:`permutation_importance`. A forest that cannot be fitted gives way to
    correlation. ``top`` limits interactions to the pairs among so many best features; None keeps all.
    """

    if spec.truth is None:
        return _status(df, by, "analysis_skipped")
    frame, names = feature_frame(df, spec, by)
    text = F.lit(None).cast("string")
    if not names:
        return _status(df, by, "no_numeric_features")
    measured = feature_effects(frame, names, by)
    correlation = measured.where(F.col("feature_b").isNull()).select(*by, F.col("feature_a").alias("feature"), F.col("value").alias("corr"))
    pairs = _among_best(measured, names, by, top)
    if isinstance(importance, str):
        plain = correlation.select(*by, "feature", F.abs("corr").alias("importance"))
        if importance == "correlation":
            importance = plain
        elif importance == "surrogate":
            importance = surrogate_importance(feature_frame(df, spec, by, labels=spec.problem != REGRESSION)[0], names, spec.problem, by)
        elif importance == "forest" and not by:
            try:
                importance = forest_importance(feature_frame(df, spec, labels=True)[0], names, spec.problem)
            except (ValueError, IllegalArgumentException):  # no usable rows or features
                importance = plain
        else:
            raise ValueError(f"cannot compute {importance!r} importance here")

    def rows(table: DataFrame, metric: str, attribute: Column, value: str) -> DataFrame:
        return table.select(
            *by,
            F.lit(EXPLAINABILITY).alias("analysis"),
            attribute.alias("attribute"),
            text.alias("group"),
            F.lit(metric).alias("metric"),
            F.col(value).alias("value"),
        )

    parts = [
        tall(importance_statistics(importance, by), by, EXPLAINABILITY, STATISTICS),
        rows(importance, "feature_importance", F.col("feature"), "importance"),
        rows(correlation, "target_correlation", F.col("feature"), "corr"),
        rows(
            pairs,
            "feature_interactions",
            F.concat_ws("×", "feature_a", "feature_b"),
            "strength",
        ),
    ]
    return reduce(DataFrame.unionByName, parts)
