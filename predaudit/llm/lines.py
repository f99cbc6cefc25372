"""Repeated lines: each counted line stays in one document only.

Lines are exploded and keyed by the digest of their normal form (ASCII white space stripped at both ends, A-Z lower-cased). Per key the
smallest document and whether there is another are aggregated, combined before the shuffle. Lines of repeated keys outside
that document are dropped, and the texts that lose any are put together again by position. Only these texts are
shuffled; a fixed-size bitmap tells the others apart.

Defined results: a null text is one empty line; lines are equal if their keys are; a line repeated within one document only stays; a null doc_id is one document
that ranks after all others; rows that share doc_id and text lose the same lines; a very long text is a long list of lines in one task; an empty table
gives no rows; columns named like the results are replaced, all others kept whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from predaudit.functions.lineage import store
from predaudit.llm.names import aside
from predaudit.llm.prefilter import split

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LAST = 2**63 - 1  # rank of a null doc_id


def _body() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _rank() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))


def _row_key() -> Column:
    """Tells rows apart: equal only for rows that share doc_id and text."""
    return F.xxhash64("doc_id", F.lit(":"), _body())


def keyed_lines(docs: DataFrame, least: int) -> DataFrame:
    """``(row, rank, at, key)`` of all lines whose normal form has at least ``least`` characters."""
    lines = docs.select(
        _row_key().alias("row"), _rank().alias("rank"),
        F.posexplode(F.split(_body(), "\n", -1)).alias("at", "line"),
    )
    normal = F.translate(F.btrim("line", F.lit(SPACE)), UPPER, LOWER)
    return lines.select("row", "rank", "at", normal.alias("normal")).where(F.length("normal") >= least).select(
        "row", "rank", "at", F.unhex(F.md5("normal")).alias("key")
    )


def dropped_lines(docs: DataFrame, least: int = 10) -> DataFrame:
    """``(rank, row, drops)``: positions of the lines that a row loses, for rows that lose any."""
    lines = keyed_lines(docs, least)
    repeated = store(
        lines.groupBy("key").agg(F.min("rank").alias("first"), F.max("rank").alias("last")).where("first != last").select("key", "first"),
        "line-keys",
    )
    lost = lines.join(repeated, "key").where("rank != first")
    return lost.groupBy("rank", "row").agg(F.collect_set("at").alias("drops"))  # at most the lines of one document


def drop_repeated_lines(docs: DataFrame, least: int = 10) -> DataFrame:
    """All rows and columns of ``docs`` with the text that is left, ``n_lines`` (before) and ``n_dropped``."""
    order = [*docs.columns, *[c for c in ("n_lines", "n_dropped") if c not in docs.columns]]
    docs, back = aside(docs, ("rank", "row", "drops", "_rank", "_row"))
    drops = store(dropped_lines(docs, least), "line-drops")
    rows = docs.withColumns({"text": _body(), "n_lines": F.size(F.split(_body(), "\n", -1)).cast("long"), "_rank": _rank(), "_row": _row_key()})
    whole, doubtful = split(rows, "_row", drops.select(F.col("row").alias("_row")))
    joined = doubtful.join(drops, (F.col("_row") == F.col("row")) & (F.col("_rank") == F.col("rank")), "left")
    columns = [F.col(c) for c in rows.columns if c not in ("_rank", "_row", "text", "n_dropped")]
    lines = F.filter(F.split("text", "\n", -1), lambda line, at: ~F.array_contains("drops", at))
    zero = F.lit(0).cast("long").alias("n_dropped")
    hit = joined.where("row is not null").select(*columns, F.array_join(lines, "\n").alias("text"), F.size("drops").cast("long").alias("n_dropped"))
    spared = joined.where("row is null").select(*columns, "text", zero)
    left = whole.select(*columns, "text", zero).unionByName(hit).unionByName(spared)
    return left.withColumnsRenamed(back).select(*[F.col(f"`{c}`") for c in order])
