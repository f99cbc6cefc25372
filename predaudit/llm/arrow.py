"""Rows of Python tuples as Arrow batches, for functions that run inside tasks."""

from __future__ import annotations

import pyarrow as pa


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)
