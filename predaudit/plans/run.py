"""From the path of a table to the report of its audit."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from predaudit.operators import roles
from predaudit.plans.report import Audit, audit
from predaudit.sources.load import load, prepare
from predaudit.sources.sinks import write_report
from predaudit.spec import AUTO, AuditSpec


def audit_path(
    spark: SparkSession, path: str, spec: AuditSpec | None = None, by: Sequence[str] = (), out: str | None = None, fmt: str | None = None,
    importance: DataFrame | str = "correlation", predict: Callable[[DataFrame], DataFrame] | None = None, **options: str,
) -> Audit:
    """Read a table, find the roles of its columns (unless ``spec`` names them) and its problem, convert texts, audit it and write the report.

    ``out`` is the folder of the JSON report; without it nothing is computed before a table of the audit is asked for.
    """
    data = load(spark, path, fmt, **options)
    if spec is None:
        found = roles.column_roles(data)
        spec = roles.to_spec(roles.smart_config(data, roles=found), AUTO)
        if not spec.protected:
            spec = spec.with_(protected=tuple(r["column"] for r in roles.protected_attributes(data).collect()))  # some of the columns
    done = audit(prepare(data, spec).data, spec, by, importance=importance, predict=predict)
    if out is not None:
        write_report(done, out)
    return done
