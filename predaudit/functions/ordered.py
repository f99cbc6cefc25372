"""Exact order statistics and running totals that no single task has to hold.

Both start from counted distinct values, so a hot value is one row. Each value gets two
order-preserving codes from its own binary form: its power of two cut into 1024 equal pieces, and
that piece cut into 262144 again. The codes need no statistics of the data, so a recomputed task
gives the same ones. A pair of codes holds at most 2^24 different doubles and a first code at most
2^18 second ones. A key has one short row per occupied first code, thousands in practice. So every
window below is bounded, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from predaudit.functions.keys import attach, group, join_on, measured
from predaudit.functions.lineage import store

PIECES, SUBPIECES = 1024, 262_144
BEFORE = (Window.unboundedPreceding, -1)


def coded(counts: DataFrame, value: str) -> DataFrame:
    """Add ``_c1`` and ``_c2`` so that ordering by them agrees with ordering by ``value``.

    Rounding in the logarithm can move a value next to a power of two into the neighbouring piece,
    but never past another value, as every step is non-decreasing in the size of the value.
    """
    size = F.abs(value)
    finite = (size > 0) & (size < float("inf"))
    exponent = F.floor(F.log2(size))
    # scaling by powers of two is exact, so the second code continues where the first one stops
    place = (size / F.pow(F.lit(2.0), exponent) - 1.0) * PIECES
    rows = counts.withColumns(
        {"_e": F.when(finite, exponent + 1100).when(size > 0, 3000).otherwise(0), "_at": F.when(finite, place).otherwise(0.0)}
    )
    first = F.greatest(F.least(F.floor("_at"), F.lit(PIECES - 1)), F.lit(0))
    second = F.greatest(F.least(F.floor((F.col("_at") - first) * SUBPIECES), F.lit(SUBPIECES - 1)), F.lit(0))
    sign = F.when(F.col(value) < 0, -1).otherwise(1)
    return rows.withColumns(
        {"_c1": (sign * (F.col("_e") * PIECES + first)).cast("int"), "_c2": (sign * second).cast("int")}
    ).drop("_e", "_at")


def running_totals(
    counts: DataFrame, keys: Sequence[str], value: str, measures: Sequence[str]
) -> DataFrame:
    """Add ``<m>_below`` (sum over smaller values) and ``<m>_total`` (sum per key) for each measure."""
    rows = coded(counts, value)
    outer, inner = [*keys, "_c1"], [*keys, "_c1", "_c2"]

    def before(partition: Sequence[str], order: str, column: str) -> Column:
        window = Window.partitionBy(*partition).orderBy(order).rowsBetween(*BEFORE)
        return F.coalesce(F.sum(column).over(window), F.lit(0))

    pieces = rows.groupBy(*inner).agg(*[F.sum(m).alias(m) for m in measures])
    second = pieces.select(*inner, *[before(outer, "_c2", m).alias(f"_{m}_2") for m in measures])
    whole = Window.partitionBy(*keys)
    first = (
        pieces.groupBy(*outer)
        .agg(*[F.sum(m).alias(m) for m in measures])
        .select(
            *outer,
            *[before(keys, "_c1", m).alias(f"_{m}_1") for m in measures],
            *[F.sum(m).over(whole).alias(f"{m}_total") for m in measures],
        )
    )
    local = rows.select("*", *[before(inner, value, m).alias(f"_{m}_3") for m in measures])
    joined = join_on(local, join_on(second, first, outer), inner)
    below = {f"{m}_below": F.col(f"_{m}_1") + F.col(f"_{m}_2") + F.col(f"_{m}_3") for m in measures}
    return joined.select(
        *counts.columns, *[f"{m}_total" for m in measures], *[c.alias(k) for k, c in below.items()]
    )


def quantiles(
    counts: DataFrame, keys: Sequence[str], value: str, weight: str, probs: Sequence[float]
) -> DataFrame:
    """Exact linear-interpolated quantiles: ``(keys…, n, q)`` with ``q`` an array aligned to ``probs``.

    Totals per first code locate the pieces with the wanted ranks, totals per second code narrow them
    down, and only the few pieces left are sorted.
    """
    rows = coded(counts, value)
    pieces = rows.groupBy(*keys, "_c1").agg(F.sum(weight).alias("_w"))
    return _ranked(rows, _reached(pieces, keys, probs), keys, value, weight, probs)


def near_quantiles(
    df: DataFrame, columns: Sequence[str], by: Sequence[str], probs: Sequence[float], width: int
) -> DataFrame | None:
    """``(by…, column, n, q)`` as :func:`quantiles` of columns of doubles, whose values are not counted first.

    A pass over all columns counts pieces on a logarithmic scale; another per ``width`` columns keeps the values between the ends of the pieces
    with wanted ranks. Only counts of pieces and these values are shuffled, and rows meet the ends by ``by`` once. Pieces and
    values are computed and written here. With more pieces than may be broadcast, as very many keys have, there is no result.
    """
    keys, outer = [*by, "column"], [*by, "column", "_c1"]
    cells = df.unpivot(list(by), list(columns), "column", "_v").where(F.col("_v").isNotNull())
    pieces = cells.withColumn("_c1", _scaled(F.col("_v"))).groupBy(*outer).agg(
        F.count(F.lit(1)).alias("_w"), F.min("_v").alias("_low"), F.max("_v").alias("_high")
    )
    first, few = measured(_reached(pieces, keys, probs, "_w", "_low", "_high"), outer)
    if not few:
        return None
    parts = []
    for at in range(0, len(columns), width):
        chunk = columns[at : at + width]
        ends = []
        for i, c in enumerate(chunk):
            for j, p in enumerate(probs):
                here = (F.col("column") == c) & _wanted([p], "_w")
                ends += [F.min(F.when(here, F.col("_low"))).alias(f"l{i}_{j}"), F.max(F.when(here, F.col("_high"))).alias(f"h{i}_{j}")]
        rows = attach(df, group(first, by, *ends), by, "_ends", small=True)
        kept = []
        for i, c in enumerate(chunk):
            within = [F.col(c).between(F.col(f"_ends.l{i}_{j}"), F.col(f"_ends.h{i}_{j}")) for j in range(len(probs))]
            kept.append(F.when(reduce(lambda x, y: x | y, within), F.col(c)).alias(c))
        parts.append(rows.select(*by, *kept).unpivot(list(by), list(chunk), "column", "_v").where(F.col("_v").isNotNull()))
    counted = reduce(DataFrame.unionByName, parts).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_k"))
    near = coded(store(counted, "near-quantiles"), "_v")
    inside = F.col("_c1").cast("long") * SUBPIECES + F.col("_c2")
    near = near.withColumn("_c2", inside).withColumn("_c1", _scaled(F.col("_v")))
    return _ranked(near, first.select(*outer, "_start", "_n"), keys, "_v", "_k", probs)


def _scaled(value: Column) -> Column:
    """A code in the order of the values, of which every power of two has about ``PIECES``."""
    size = F.abs(value)
    code = F.when(size == float("inf"), 3_000_000).when(size > 0, F.floor(F.ln(size) * (PIECES / math.log(2))) + 1_200_000).otherwise(0)
    return (F.when(value < 0, -1).otherwise(1) * code).cast("int")


def _place(p: Column) -> Column:
    return p * (F.col("_n") - 1)


def _start(partition: Sequence[str], order: str, column: str) -> Column:
    window = Window.partitionBy(*partition).orderBy(order).rowsBetween(*BEFORE)
    return F.coalesce(F.sum(column).over(window), F.lit(0))


def _holds(rank: Column, count: str) -> Column:
    return (rank >= F.col("_start")) & (rank < F.col("_start") + F.col(count))


def _wanted(probs: Sequence[float], count: str) -> Column:
    """Whether a wanted rank falls among the rows from ``_start`` on."""
    return F.exists(_grid(probs), lambda p: _holds(F.floor(_place(p)), count) | _holds(F.ceil(_place(p)), count))


def _grid(probs: Sequence[float]) -> Column:
    return F.lit([float(p) for p in probs])


def _reached(pieces: DataFrame, keys: Sequence[str], probs: Sequence[float], *kept: str) -> DataFrame:
    """``(keys…, _c1, _start, _n)`` and what is to be ``kept`` of the pieces ``(keys…, _c1, _w)`` that hold a wanted rank."""
    whole = Window.partitionBy(*keys)
    return (
        pieces.select("*", _start(keys, "_c1", "_w").alias("_start"), F.sum("_w").over(whole).alias("_n"))
        .where(_wanted(probs, "_w"))
        .select(*keys, "_c1", "_start", "_n", *kept)
    )


def _ranked(rows: DataFrame, first: DataFrame, keys: Sequence[str], value: str, weight: str, probs: Sequence[float]) -> DataFrame:
    """Quantiles from coded counts, of which those in the pieces ``first`` are looked at."""
    outer, inner = [*keys, "_c1"], [*keys, "_c1", "_c2"]
    grid = _grid(probs)
    second = (
        join_on(rows, first, outer)
        .groupBy(*inner, "_start", "_n")
        .agg(F.sum(weight).alias("_w"))
        .select(*inner, "_n", "_w", (F.col("_start") + _start(outer, "_c2", "_w")).alias("_start"))
        .where(_wanted(probs, "_w"))
        .select(*inner, "_start", "_n")
    )
    ends = F.transform(grid, lambda p: F.array(F.floor(_place(p)).cast("long"), F.ceil(_place(p)).cast("long")))
    ranks = F.filter(F.array_distinct(F.flatten(ends)), lambda r: _holds(r, weight))
    found = group(
        join_on(rows, second, inner)
        .withColumn("_start", F.col("_start") + _start(inner, value, weight))
        .where(_wanted(probs, weight))
        .select(*keys, "_n", F.col(value).cast("double").alias("_v"), F.explode(ranks).alias("_rank")),
        keys,
        F.max("_n").alias("_n"),
        F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"),
    )

    def at(rank: Column) -> Column:
        return F.element_at("_at", rank.cast("long"))

    def between(p: Column) -> Column:
        h = _place(p)
        low, high = at(F.floor(h)), at(F.ceil(h))
        return F.when(low == high, low).otherwise(low + (high - low) * (h - F.floor(h)))

    return found.where(F.col("_n").isNotNull()).select(
        *keys, F.col("_n").alias("n"), F.transform(grid, between).alias("q")
    )


def segments(counts: DataFrame, keys: Sequence[str], value: str, measures: Sequence[str], marks: DataFrame) -> DataFrame:
    """``(keys…, segment, measures…)``: sums of the measures between marks, segment ``i`` lying behind ``i`` of the key's marks.

    ``marks`` has the keys and an ascending array ``marks`` of structs ``(at, tie)``: a mark with tie -1 lies before the values equal to it, with 1
    behind them. Whole pieces are summed where no mark falls into them; only the pieces around a mark are looked at value by value, so
    no row meets its key's marks in a join, and sums of other segments cost no digits. Keys without marks are left out.
    """
    rows = coded(counts.select(*keys, value, *measures), value)
    opened = marks.select(*keys, F.posexplode("marks").alias("_ord", "_m")).select(
        *keys, "_ord", F.col("_m.at").alias(value), F.col("_m.tie").alias("_tie")
    ).where(F.col(value).isNotNull())
    placed = coded(opened, value)
    zero = [F.lit(None).cast(rows.schema[m].dataType).alias(m) for m in measures]

    def level(source: DataFrame, inside: Sequence[str], order: str) -> DataFrame:
        """Rows of a level with their segment, but for those whose last code is also that of a mark."""
        both = source.withColumns({"_ord": F.lit(None).cast("int"), "_tie": F.lit(0)}).unionByName(
            placed.select(*[c for c in source.columns if c not in measures], "_ord", "_tie", *zero)
        )
        ordered = Window.partitionBy(*inside).orderBy(order, "_tie", "_ord").rowsBetween(*BEFORE)
        found = both.withColumns({"_last": F.max("_ord").over(ordered), "_least": F.min("_ord").over(Window.partitionBy(*inside))})
        if order != value:
            found = found.withColumn("_near", F.count("_ord").over(Window.partitionBy(*inside, order))).where("_near = 0")
        at = F.coalesce(F.col("_last") + 1, F.col("_least"))  # the marks of one partition follow one another
        return found.where("_tie = 0").select(*keys, at.alias("segment"), *measures).where(F.col("segment").isNotNull())

    outer, inner = [*keys, "_c1"], [*keys, "_c1", "_c2"]
    sums = [F.sum(m).alias(m) for m in measures]
    first = level(rows.groupBy(*outer).agg(*sums), keys, "_c1")
    second = level(join_on(rows.groupBy(*inner).agg(*sums), placed.select(*outer).distinct(), outer, "left_semi"), outer, "_c2")
    third = level(join_on(rows, placed.select(*inner).distinct(), inner, "left_semi"), inner, value)
    return first.unionByName(second).unionByName(third).groupBy(*keys, "segment").agg(*sums)


def marks(*cuts: tuple[Column, int]) -> Column:
    """Ascending marks for :func:`segments` from ``(value, tie)`` pairs that are in order."""
    return F.array(*[F.struct(at.cast("double").alias("at"), F.lit(tie).alias("tie")) for at, tie in cuts])


def column_quantiles(
    df: DataFrame, columns: dict[str, Column], by: Sequence[str], probs: Sequence[float], accuracy: int | None = None
) -> DataFrame:
    """``(by…, column, n, q)`` for numeric expressions; ``accuracy`` switches to a one-pass sketch."""
    parts: list[Column] = []
    for name, c in columns.items():
        parts += [F.lit(name), c.cast("double")]
    rows = df.select(*by, F.stack(F.lit(len(columns)), *parts).alias("column", "v")).where(
        F.col("v").isNotNull() & ~F.isnan("v")
    )
    if accuracy is not None:
        return rows.groupBy(*by, "column").agg(
            F.count(F.lit(1)).alias("n"), F.percentile_approx("v", list(probs), accuracy).alias("q")
        )
    counts = rows.groupBy(*by, "column", "v").agg(F.count(F.lit(1)).alias("n"))
    return quantiles(counts, [*by, "column"], "v", "n", probs)


def value_quantiles(
    df: DataFrame, name: str, value: Column, by: Sequence[str], probs: Sequence[float], accuracy: int | None = None
) -> DataFrame:
    """One row per key with the quantiles of one expression as the array column ``name``."""
    rows = df.select(*by, value.cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    if accuracy is not None:
        return group(rows, by, F.percentile_approx("v", list(probs), accuracy).alias(name))
    counts = rows.groupBy(*by, "v").agg(F.count(F.lit(1)).alias("n"))
    return quantiles(counts, by, "v", "n", probs).select(*by, F.col("q").alias(name))
