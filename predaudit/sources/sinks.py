"""Writing metrics and reports. Results are small; inputs are never collected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from predaudit.functions.keys import attach, group
from predaudit.plans.report import Audit


def flat_name() -> Column:
    """``<analysis>_…`` names: attribute gaps as attribute_metric, importances as metric_attribute."""
    nested = F.col("analysis") == "explainability"
    share = F.col("metric") == "class_proportion"
    plain = (
        F.when(share, F.concat(F.lit("class_"), F.col("group"), F.lit("_proportion")))
        .when(nested, F.concat_ws("_", "metric", "attribute"))
        .otherwise(F.concat_ws("_", "attribute", "metric"))
    )
    return F.concat_ws("_", "analysis", plain)


def flat_row(audit: Audit) -> DataFrame:
    """One wide row per key: every metric under its flat name, the score, sizes and problem type, and the failed analyses if there are any.

    The pivot reads the metric names first; they number metrics times columns, not rows.
    """
    by = list(audit.by)
    named = audit.metrics.select(*by, flat_name().alias("name"), "value")
    names = sorted(r["name"] for r in named.select("name").distinct().collect())
    picks = [F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names]
    wide = group(named, by, *picks)
    about = ("overall_score", "sample_size", "feature_count", "problem_type")
    failed = [F.lit("; ".join(f"{a}: {reason}" for a, reason in audit.failed.items())).alias("failed_analyses")] if audit.failed else []
    wide = attach(wide, audit.report.select(*by, *about), by, "_z")
    return wide.select(
        *by,
        *[F.col(f"`{n}`") for n in names],
        *[F.col(f"_z.{c}").alias(c) for c in about],
        *failed,
    )


def report_json(report: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by…, report)``: each report row as one JSON document."""
    fields = [c for c in report.columns if c not in by]
    return report.select(*by, F.to_json(F.struct(*fields)).alias("report"))


def write_report(audit: Audit, path: str, fmt: str = "json", mode: str = "error") -> None:
    """The report rows as JSON, or the flat metric rows as CSV."""
    if fmt == "json":
        audit.report.write.mode(mode).json(path)
    elif fmt == "csv":
        flat_row(audit).write.mode(mode).csv(path, header=True)
    else:
        raise ValueError(f"unsupported report format {fmt!r}")


def write_metrics(metrics: DataFrame, path: str, fmt: str = "json", mode: str = "error") -> None:
    """The tall metrics alone."""
    writer = metrics.write.mode(mode)
    if fmt == "json":
        writer.json(path)
    elif fmt == "csv":
        writer.csv(path, header=True)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unsupported metrics format {fmt!r}")


def flatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """Struct fields as top-level columns, names joined with ``sep``."""

    def leaves(schema: T.StructType, path: Column | None, prefix: str) -> list[Column]:
        found = []
        for field in schema.fields:
            here = F.col(f"`{field.name}`") if path is None else path.getField(field.name)
            name = f"{prefix}{sep}{field.name}" if prefix else field.name
            if isinstance(field.dataType, T.StructType):
                found += leaves(field.dataType, here, name)
            else:
                found.append(here.alias(name))
        return found

    return df.select(*leaves(df.schema, None, ""))


def flatten_maps(df: DataFrame, by: Sequence[str] = (), sep: str = "_") -> DataFrame:
    """``(by…, name, value)`` for all entries of the numeric map columns, names joined with ``sep``."""
    maps = [f.name for f in df.schema.fields if isinstance(f.dataType, T.MapType)]

    def named(column: str) -> Column:
        entries = F.map_entries(F.col(column).cast("map<string,double>"))
        renamed = F.transform(
            entries, lambda e: F.struct(F.concat(F.lit(column + sep), e["key"]).alias("name"), e["value"].alias("value"))
        )
        return F.coalesce(renamed, F.array().cast("array<struct<name:string,value:double>>"))

    return df.select(*by, F.inline(F.concat(*[named(c) for c in maps])))
