"""Columns of a caller whose names an operator uses inside."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def aside(docs: DataFrame, inside: Iterable[str]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns of the names ``inside`` renamed, and what renames them back."""
    taken, wanted, moved = {c.lower() for c in docs.columns}, {c.lower() for c in inside}, {}
    for c in docs.columns:
        if c.lower() in wanted:
            name = f"{c}_of_caller"
            while name.lower() in taken:
                name += "_"
            taken.add(name.lower())
            moved[c] = name
    return docs.withColumnsRenamed(moved), {name: c for c, name in moved.items()}
