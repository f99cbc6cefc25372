"""Metrics over time windows, the same plan for a batch table and a stream, and drift.

Only sums and counts enter the state of a window, so it stays small: of labels and pairs of them, of equal ranges of the score, of bins of a column. What
follows from the counts of a window is aggregated again when the watermark passes its end. Exact medians and duplicates cannot be kept
incrementally and stay batch-only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from predaudit.functions.keys import attach
from predaudit.functions.safe import clean, clean_double, div, div0, numeric_columns, r2
from predaudit.operators.classification import BASIC, basic_metrics, label_pair, label_totals
from predaudit.spec import MULTICLASS, REGRESSION, AuditSpec

PSI_BINS = 10
PSI_FLOOR = 1e-4  # share given to an empty bin so that the logarithm exists
SCORE_RANGES = 1000
SURE = 1e-15  # scores are kept this far from 0 and 1 in the log loss


def timed(df: DataFrame, spec: AuditSpec, watermark: str | None = None) -> DataFrame:
    """The table with a ``timestamp`` typed event time and, on request, a watermark on it."""
    rows = df.withColumn(spec.timestamp, F.col(spec.timestamp).cast("timestamp"))
    return rows.withWatermark(spec.timestamp, watermark) if watermark else rows


def _binary_sums(df: DataFrame, spec: AuditSpec) -> dict[str, Column]:
    y, p = label_pair(df, spec)
    positive = F.lit(spec.positive).cast(df.select(y.alias("y")).schema["y"].dataType)
    true, called = y == positive, p == positive
    return {
        "n": F.count(F.lit(1)),
        "tp": F.count_if(true & called),
        "fp": F.count_if(~true & called),
        "fn": F.count_if(true & ~called),
        "hits": F.count_if(y == p),
    }


def _regression_sums(df: DataFrame, spec: AuditSpec) -> dict[str, Column]:
    y, p = clean_double(df, spec.truth), clean_double(df, spec.prediction)
    r = y - p
    return {
        "n": F.count(F.lit(1)),
        "ss": F.sum(r * r),
        "mean_absolute_error": F.avg(F.abs(r)),
        "mean_squared_error": F.avg(r * r),
        "residual_mean": F.avg(r),
        "residual_std": F.stddev_pop(r),
        "vy": F.var_pop(y),
    }


def windowed_metrics(
    df: DataFrame,
    spec: AuditSpec,
    by: Sequence[str] = (),
    every: str = "1 day",
    slide: str | None = None,
    session_gap: str | None = None,
    watermark: str | None = None,
) -> DataFrame:
    """``(by…, window_start, window_end, n, metrics…)`` per tumbling, sliding or session window.

    On a stream give a ``watermark``: rows later than it are dropped, and append mode emits a window
    when the watermark passes its end.
    """
    rows = timed(df, spec, watermark)
    known = clean(df, spec.truth).isNotNull() & clean(df, spec.prediction).isNotNull()
    ts = F.col(spec.timestamp)
    window = F.session_window(ts, session_gap) if session_gap else F.window(ts, every, slide or every)
    if spec.problem == MULTICLASS:
        return _multiclass_windows(rows.where(known), spec, by, window)
    sums = _regression_sums(df, spec) if spec.problem == REGRESSION else _binary_sums(df, spec)
    grouped = rows.where(known).groupBy(*by, window.alias("_window")).agg(*[c.alias(k) for k, c in sums.items()])
    place = [*by, F.col("_window.start").alias("window_start"), F.col("_window.end").alias("window_end"), "n"]
    if spec.problem == REGRESSION:
        return grouped.select(
            *place,
            r2(F.col("ss"), F.col("n"), F.col("vy")).alias("r2_score"),
            "mean_squared_error",
            F.sqrt("mean_squared_error").alias("root_mean_squared_error"),
            "mean_absolute_error",
            "residual_mean",
            "residual_std",
        )
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return grouped.select(
        *place,
        div(F.col("hits"), F.col("n")).alias("accuracy"),
        div0(tp, tp + fp).alias("precision"),
        div0(tp, tp + fn).alias("recall"),
        div0(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
        div(tp + fp, F.col("n")).alias("positive_rate"),
        div(tp + fn, F.col("n")).alias("base_rate"),
    )


def _multiclass_windows(rows: DataFrame, spec: AuditSpec, by: Sequence[str], window: Column) -> DataFrame:
    """The averaged metrics of :func:`classification.performance` per window, from its counts of (truth, prediction).

    On a stream the three aggregations follow one another: counts of pairs, of labels, metrics.
    """
    y, p = label_pair(rows, spec)
    counts = (
        rows.select(*by, spec.timestamp, y.alias("truth"), p.alias("prediction"))
        .groupBy(*by, window.alias("_window"), "truth", "prediction").agg(F.count(F.lit(1)).alias("n"))
    )
    keys = [*by, "_window"]
    metrics = basic_metrics(label_totals(counts, keys), spec, keys)
    return metrics.select(*by, F.col("_window.start").alias("window_start"), F.col("_window.end").alias("window_end"), "n", *BASIC)


def windowed_scores(
    df: DataFrame, spec: AuditSpec, by: Sequence[str] = (), every: str = "1 day", slide: str | None = None, watermark: str | None = None,
    ranges: int = SCORE_RANGES,
) -> DataFrame:
    """``(by…, window_start, window_end, n, positives, roc_auc, log_loss, brier_score)`` of binary scores per window.

    Scores are counted in equal ``ranges`` of [0, 1], so the AUC takes scores of one range as tied; the others are exact.
    """
    rows = timed(df, spec, watermark)
    score, y = clean_double(df, spec.score), clean(df, spec.truth)
    positive = (y == F.lit(spec.positive).cast(df.schema[spec.truth].dataType)).cast("long")
    sure = F.least(F.greatest(score, F.lit(SURE)), F.lit(1 - SURE))
    at = F.least(F.greatest(F.floor(score * ranges), F.lit(0)), F.lit(ranges - 1)).cast("int")
    window = F.window(F.col(spec.timestamp), every, slide or every)
    counted = (
        rows.where(score.isNotNull() & y.isNotNull())
        .select(*by, spec.timestamp, at.alias("at"), positive.alias("y"), sure.alias("s"), score.alias("raw"))
        .groupBy(*by, window.alias("_window"), "at")
        .agg(
            F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"),
            F.sum(-F.when(F.col("y") == 1, F.log("s")).otherwise(F.log(1 - F.col("s")))).alias("loss"),
            F.sum(F.pow(F.col("raw") - F.col("y"), 2)).alias("squares"),
        )
    )
    sums = counted.groupBy(*by, "_window").agg(
        F.array_sort(F.collect_list(F.struct("at", "pos", "neg"))).alias("_ranges"), F.sum("pos").alias("positives"), F.sum("neg").alias("_neg"),
        F.sum("loss").alias("_loss"), F.sum("squares").alias("_squares"),
    )  # at most one element per range
    zero = F.struct(F.lit(0.0).alias("won"), F.lit(0).cast("long").alias("below"))

    def next_range(total: Column, x: Column) -> Column:
        won = total["won"] + x["pos"] * (total["below"] + x["neg"] / 2.0)
        return F.struct(won.alias("won"), (total["below"] + x["neg"]).alias("below"))

    n = (F.col("positives") + F.col("_neg")).cast("double")
    won = F.aggregate("_ranges", zero, next_range, lambda total: total["won"])
    return sums.select(
        *by, F.col("_window.start").alias("window_start"), F.col("_window.end").alias("window_end"), n.cast("long").alias("n"), "positives",
        div(won, F.col("positives").cast("double") * F.col("_neg")).alias("roc_auc"), (F.col("_loss") / n).alias("log_loss"),
        (F.col("_squares") / n).alias("brier_score"),
    )


def write_windows(metrics: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append finished windows of a streaming metrics table to Parquet, exactly once."""
    writer = metrics.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


def bin_edges(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Smallest and largest value of the numeric ones of the columns, of a table that says what is usual: one row is read."""
    numeric = numeric_columns(df, list(columns))
    if not numeric:
        return {}
    row = df.agg(*[f(clean_double(df, c)).alias(f"{t}{i}") for i, c in enumerate(numeric) for t, f in (("lo", F.min), ("hi", F.max))]).first()
    return {c: (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(numeric) if row[f"lo{i}"] is not None}


def _bin(v: Column, lo: Column | float, hi: Column | float, bins: int) -> Column:
    """Equal bins between two values, with an open one at either end, as text."""
    lo, hi = (F.lit(x) if isinstance(x, float) else x for x in (lo, hi))
    inner = F.least(F.coalesce(F.floor(F.try_divide((v - lo) * bins, hi - lo)), F.lit(0)), F.lit(bins - 1)) + 1
    return F.when(v.isNotNull(), F.when(v < lo, 0).when(v > hi, bins + 1).otherwise(inner).cast("string"))


def _stability(base: Column, now: Column) -> Column:
    """Population stability index of two maps of counts."""

    def share(counts: Column, total: Column, key: Column) -> Column:
        return F.greatest(F.coalesce(F.element_at(counts, key) / total, F.lit(0.0)), F.lit(PSI_FLOOR))

    def total(counts: Column) -> Column:
        return F.aggregate(F.map_values(counts), F.lit(0.0), lambda a, n: a + n)

    def step(sum_: Column, key: Column) -> Column:
        a, b = share(base, total(base), key), share(now, total(now), key)
        return sum_ + (b - a) * F.ln(b / a)

    return F.aggregate(F.array_sort(F.array_union(F.map_keys(base), F.map_keys(now))), F.lit(0.0), step)


class LastWindow(StatefulProcessor):
    """Pairs every closed window of a key with the one before it: keeps the counts of the last one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "counts string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows)).sort_values("window_start")
        before = self.last.get()[0] if self.last.exists() else None
        out = found.assign(base=[before, *found["now"].iloc[:-1]])
        self.last.update((found["now"].iloc[-1],))
        yield out[["column", "window_start", "window_end", "base", "now"]].dropna(subset=["base"])

    def close(self) -> None:
        pass


def windowed_drift(
    df: DataFrame, timestamp: str, columns: Sequence[str], edges: dict[str, tuple[float, float]], every: str = "1 day", watermark: str | None = None,
    bins: int = PSI_BINS,
) -> DataFrame:
    """``(window_start, window_end, column, psi)``: how each column's distribution moved since the last window that had any of its values.

    Numbers fall into equal bins between the ``edges`` of their column (see :func:`bin_edges`), text into its values. On a stream the counts of a closed
    window are aggregated to one map per column, and keyed state holds that of the window before; it needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    rows = df.withColumn(timestamp, F.col(timestamp).cast("timestamp"))
    rows = rows.withWatermark(timestamp, watermark) if watermark else rows
    parts: list[Column] = []
    for c in columns:
        value = _bin(clean_double(df, c), *edges[c], bins) if c in edges else clean(df, c).cast("string")
        parts += [F.lit(c), value]
    counts = (
        rows.select(timestamp, F.inline(F.array(*[F.struct(parts[i].alias("column"), parts[i + 1].alias("bin")) for i in range(0, len(parts), 2)])))
        .where(F.col("bin").isNotNull()).groupBy(F.window(timestamp, every).alias("_window"), "column", "bin").agg(F.count(F.lit(1)).alias("n"))
    )
    tables = counts.groupBy("_window", "column").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("bin", "n")))).alias("now")).select(
        "column", F.col("_window.start").alias("window_start"), F.col("_window.end").alias("window_end"), F.to_json("now").alias("now")
    )
    if df.isStreaming:
        pairs = tables.groupBy("column").transformWithStateInPandas(
            LastWindow(), "column string, window_start timestamp, window_end timestamp, base string, now string", "append", "none"
        )
    else:
        pairs = tables.withColumn("base", F.lag("now").over(Window.partitionBy("column").orderBy("window_start"))).where("base is not null")
    maps = [F.from_json(c, "map<string,long>").alias(c) for c in ("base", "now")]
    return pairs.select("window_start", "window_end", "column", *maps).select(
        "window_start", "window_end", "column", _stability(F.col("base"), F.col("now")).alias("psi")
    )


def population_stability(
    df: DataFrame, current: Column, columns: Sequence[str], bins: int = PSI_BINS
) -> DataFrame:
    """``(column, psi)`` between the rows where ``current`` is false (the base) and where it is true.

    Numbers fall into equal bins between the base's min and max, with one open bin at either end;
    text falls into its values. Both sides are counted in one aggregation, without a join.
    """
    numeric = numeric_columns(df, list(columns))
    marked = df.withColumn("_now", current).where(F.col("_now").isNotNull())
    spans = marked.agg(
        F.lit(0).alias("_"),
        *[f(F.when(~F.col("_now"), clean_double(df, c))).alias(f"{t}{i}") for i, c in enumerate(numeric) for t, f in (("lo", F.min), ("hi", F.max))],
    )
    rows = attach(marked, spans, (), "_at")
    parts: list[Column] = []
    for c in columns:
        if c in numeric:
            i = numeric.index(c)
            parts += [F.lit(c), _bin(clean_double(df, c), F.col(f"_at.lo{i}"), F.col(f"_at.hi{i}"), bins)]
        else:
            parts += [F.lit(c), clean(df, c).cast("string")]
    counts = (
        rows.select("_now", F.stack(F.lit(len(columns)), *parts).alias("column", "bin"))
        .where(F.col("bin").isNotNull())
        .groupBy("column", "bin")
        .agg(F.count_if(~F.col("_now")).alias("base"), F.count_if("_now").alias("now"))
    )
    sizes = counts.groupBy("column").agg(F.sum("base").alias("_base"), F.sum("now").alias("_now"))
    shares = counts.join(sizes, "column")
    a = F.greatest(div0(F.col("base"), F.col("_base")), F.lit(PSI_FLOOR))
    b = F.greatest(div0(F.col("now"), F.col("_now")), F.lit(PSI_FLOOR))
    return shares.groupBy("column").agg(F.sum((b - a) * F.ln(b / a)).alias("psi"))
