"""Second moments of all pairs of columns, and of their products with a target, from matrix products over Arrow batches.

A task multiplies the matrix of its values with itself (with a mask for missing ones), so a row is never opened into its pairs, and hands on one row per
key and pair. Moments are centred within a batch and merged by differences of means, so large means cost no digits and a constant column
has a variance of exactly 0.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HELD = 4_000_000  # numbers of moments that a task holds before it hands them on

Moments = tuple[np.ndarray, ...]  # n, mean x, mean y, squares x, squares y, products; each a matrix over pairs


def _first(x: np.ndarray) -> np.ndarray:
    """The first present value of each column."""
    known = ~np.isnan(x)
    return np.where(known.any(0), x[known.argmax(0), np.arange(x.shape[1])], 0.0)


def pair_moments(x: np.ndarray, _: np.ndarray | None = None) -> Moments:
    """Moments of every pair of columns over the rows that have both; NaN is missing."""
    shift = _first(x)
    mask = (~np.isnan(x)).astype(float)
    endless = np.isinf(x)
    z = np.where(np.isnan(x) | endless, 0.0, x - np.where(np.isinf(shift), 0.0, shift))
    n = mask.T @ mask
    some = np.maximum(n, 1.0)
    sums, squares = z.T @ mask, (z * z).T @ mask
    cxx = squares - sums * sums / some
    cxy = z.T @ z - sums * sums.T / some
    if endless.any():
        bad = (endless.T @ mask) + (mask.T @ endless) > 0
        cxy[bad] = np.nan
    mean = np.where(np.isinf(shift), 0.0, shift)[:, None] + sums / some
    return n, mean, mean.T, np.maximum(cxx, 0.0), np.maximum(cxx, 0.0).T, cxy


def product_moments(x: np.ndarray, y: np.ndarray) -> Moments:
    """Moments of the product of every pair of columns with ``y``; a column of ones makes it the columns themselves."""
    shift, y0 = _first(x), y[0]
    mask = (~np.isnan(x)).astype(float)
    z, v = np.where(np.isnan(x), 0.0, x - shift), (y - y0)[:, None]
    zz = z * z
    n = mask.T @ mask
    some = np.maximum(n, 1.0)
    a, b = shift[:, None], shift[None, :]
    # the product is q + a zb + b za + a b with q = za zb, where z is what a value differs by from the shift
    q, za = z.T @ z, z.T @ mask
    q_za = zz.T @ z
    squares = zz.T @ mask
    u = q + a * za.T + b * za
    uu = zz.T @ zz + a * a * squares.T + b * b * squares + 2 * a * q_za.T + 2 * b * q_za + 2 * a * b * q
    zy = (z * v).T @ mask
    uy = z.T @ (z * v) + a * zy.T + b * zy
    sy, syy = mask.T @ (mask * v), mask.T @ (mask * v * v)
    return n, a * b + u / some, y0 + sy / some, np.maximum(uu - u * u / some, 0.0), np.maximum(syy - sy * sy / some, 0.0), uy - u * sy / some


def merged(one: Moments, two: Moments) -> Moments:
    n = one[0] + two[0]
    share = two[0] / np.maximum(n, 1.0)
    weight = one[0] * share
    dx, dy = two[1] - one[1], two[2] - one[2]
    first = one[0] == 0
    means = [np.where(first, b, a + d * share) for a, b, d in ((one[1], two[1], dx), (one[2], two[2], dy))]
    return (n, *means, one[3] + two[3] + dx * dx * weight, one[4] + two[4] + dy * dy * weight, one[5] + two[5] + dx * dy * weight)


def _partial(moments, keys: int, width: int, target: bool):
    """Partial moments of the pairs ``i < j`` of ``width`` columns that follow the keys, and the target, if there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Moments] = {}
        i, j = np.triu_indices(width, 1)
        schema: list = []

        def rows() -> Iterator[pa.RecordBatch]:
            for key, found in held.items():
                values = [m[i, j] for m in found]
                columns = [pa.array([k] * len(i), f.type) for k, f in zip(key, schema)]
                columns += [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(values[0])]
                columns += [pa.array(v, mask=values[0] == 0) for v in values[1:]]  # pairs without a common row have no moments
                names = [f.name for f in schema] + ["i", "j", "n", "mx", "my", "cxx", "cyy", "cxy"]
                yield pa.RecordBatch.from_arrays(columns, names=names)
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            schema = [batch.schema.field(c) for c in range(keys)]
            x = np.column_stack([batch.column(keys + c).to_numpy(zero_copy_only=False) for c in range(width)])
            y = batch.column(keys + width).to_numpy(zero_copy_only=False) if target else None
            groups: dict[tuple, list[int]] = {}
            if keys:
                for at, key in enumerate(zip(*[batch.column(c).to_pylist() for c in range(keys)])):
                    groups.setdefault(key, []).append(at)
            for key, at in groups.items() if keys else [((), slice(None))]:
                with np.errstate(invalid="ignore", over="ignore"):
                    found = moments(x[at], None if y is None else y[at])
                    held[key] = merged(held[key], found) if key in held else found
            if len(held) * width * width * 6 > HELD:
                yield from rows()
        yield from rows()

    return run


def _correlated(rows: DataFrame, by: Sequence[str], width: int, moments, target: bool) -> DataFrame:
    """``(by…, i, j, n, corr)`` from rows of keys, columns and perhaps a target."""
    fields = [*[rows.schema[c] for c in by], T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType())]
    fields += [T.StructField(c, T.DoubleType()) for c in ("n", "mx", "my", "cxx", "cyy", "cxy")]
    partial = rows.mapInArrow(_partial(moments, len(by), width, target), T.StructType(fields))
    pair = [*by, "i", "j"]
    whole = Window.partitionBy(*pair)
    # means are taken from the smallest of them, so equal ones differ by exactly 0
    n, dx, dy = F.col("n"), F.col("dx"), F.col("dy")
    moved = partial.withColumns({"dx": F.col("mx") - F.min("mx").over(whole), "dy": F.col("my") - F.min("my").over(whole)})
    sums = moved.groupBy(*pair).agg(
        F.sum(n).alias("n"), F.sum(n * dx).alias("dx"), F.sum(n * dy).alias("dy"),
        *[F.sum(F.col(c) + n * a * b).alias(c) for c, a, b in (("cxx", dx, dx), ("cyy", dy, dy), ("cxy", dx, dy))],
    )

    def central(name: str, a: Column, b: Column) -> Column:
        return F.col(name) - F.try_divide(a * b, n)

    product = F.sqrt(central("cxx", dx, dx)) * F.sqrt(central("cyy", dy, dy))
    value = F.try_divide(central("cxy", dx, dy), F.when(product > 0, product))
    return sums.select(*pair, n.cast("long").alias("n"), F.when(value.isNotNull() & ~F.isnan(value), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))).alias("corr"))


def pair_correlations(df: DataFrame, columns: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """``(by…, i, j, n, corr)``: correlation of the columns at positions ``i < j`` over the rows that have both; null if one is constant."""
    rows = df.select(*by, *[c.cast("double").alias(f"_x{i}") for i, c in enumerate(columns.values())])
    return _correlated(rows, by, len(columns), pair_moments, False)


def product_correlations(df: DataFrame, columns: Sequence[str], target: str, by: Sequence[str] = ()) -> DataFrame:
    """``(by…, i, j, n, corr)``: correlation of ``target`` with the product of the columns at ``i < j``; ``j`` is ``len(columns)`` for a column alone."""
    rows = df.where(F.col(target).isNotNull()).select(
        *by, *[F.col(f"`{c}`").cast("double").alias(f"_x{i}") for i, c in enumerate(columns)], F.lit(1.0).alias("_one"), F.col(target).cast("double").alias("_y")
    )
    return _correlated(rows, by, len(columns) + 1, product_moments, True)
