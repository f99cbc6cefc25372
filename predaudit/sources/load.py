"""Reading scored tables by path and preparing their columns."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from predaudit.functions.safe import text_columns
from predaudit.operators.quality import missing_by_column
from predaudit.sources.json_array import stored_lines
from predaudit.spec import AuditSpec

LARGE_JSON = 64 * 2**20

FORMATS = {".csv": "csv", ".txt": "csv", ".tsv": "tsv", ".json": "json", ".jsonl": "jsonl", ".parquet": "parquet"}


def file_format(path: str) -> str:
    suffix = PurePosixPath(path.rstrip("/")).suffix.lower()
    if suffix not in FORMATS:
        raise ValueError(f"unknown file extension {suffix!r}")
    return FORMATS[suffix]


def _bytes(spark: SparkSession, path: str) -> int:
    """Size of all files at a path; their contents are not read."""
    return spark.read.format("binaryFile").load(path).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def load(
    spark: SparkSession, path: str, fmt: str | None = None, schema: T.StructType | str | None = None, **options: str
) -> DataFrame:
    """CSV and TSV with a header, JSON arrays, JSON lines or Parquet.

    Give a ``schema`` for large text files: inferring one reads the files twice. Small JSON files are parsed as a whole; arrays of more than
    ``LARGE_JSON`` bytes are cut up by many tasks and read from lines below the shared folder.
    """
    fmt = fmt or file_format(path)
    reader = spark.read.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt in ("csv", "tsv"):
        separator = "\t" if fmt == "tsv" else options.get("sep", ",")
        return reader.csv(path, header=True, inferSchema=schema is None, sep=separator)
    if fmt == "json":
        lines = stored_lines(spark, path) if _bytes(spark, path) > LARGE_JSON else None
        return reader.json(lines) if lines else reader.json(path, multiLine=True)
    if fmt == "jsonl":
        return reader.json(path)
    if fmt == "parquet":
        return reader.parquet(path)
    raise ValueError(f"unsupported format {fmt!r}")


@dataclass(frozen=True)
class Prepared:
    """A table with converted role columns, its missing cells per column and what was converted."""

    data: DataFrame
    missing: DataFrame
    has_temporal_data: bool
    timestamp_conversion_failed: bool
    dtypes: dict[str, str]


def prepare(df: DataFrame, spec: AuditSpec) -> Prepared:
    """Text predictions and truths become numbers if every value converts, the timestamp likewise.

    One aggregation decides, since the answer changes the schema.
    """
    texts = set(text_columns(df))
    numbers = [c for c in (spec.prediction, spec.truth) if c in texts]
    stamp = spec.timestamp if spec.timestamp in texts else None
    checks = [F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()) for c in numbers]
    if stamp:
        checks.append(F.count_if(F.col(stamp).isNotNull() & F.try_to_timestamp(F.col(stamp)).isNull()))
    failures = list(df.agg(*checks).first()) if checks else []
    data = df
    for c, bad in zip(numbers, failures):
        if bad == 0:
            data = data.withColumn(c, F.col(c).cast("double"))
    failed = bool(stamp) and failures[-1] > 0
    if stamp and not failed:
        data = data.withColumn(stamp, F.to_timestamp(F.col(stamp)))
    elif spec.timestamp and isinstance(df.schema[spec.timestamp].dataType, (T.DateType, T.TimestampNTZType)):
        data = data.withColumn(spec.timestamp, F.col(spec.timestamp).cast("timestamp"))
    missing = missing_by_column(df).where(F.col("missing_count") > 0)
    return Prepared(data, missing, bool(spec.timestamp) and not failed, failed, dict(data.dtypes))


def preview(df: DataFrame, rows: int = 10) -> DataFrame:
    """The first rows."""
    return df.limit(rows)
