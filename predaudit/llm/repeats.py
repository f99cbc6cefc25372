"""Repeated passages: lines and paragraphs are cut into sentence units, hashed, and kept where they occur first.

A unit is a stretch of a line up to a sentence end, however short; a passage that was pasted into the middle of a paragraph therefore still shares its inner
units with other copies. Units are normalised (lower case, single spaces) and digested to 128 bits. Per digest the earliest occurrence, by doc_id
and then by offset, stays; all others are removed. Offsets are code points of the original text, end exclusive.

Whether a unit repeats within its own document is seen where the document is read; between documents, the smallest doc_id per digest
is aggregated, combined before the shuffle, and joined back. A unit that every document shares is one row of that table.

Repeated units that follow one another form a run. Only runs of at least ``passage`` words are removed, so that a short sentence that two
documents share by chance stays. What is left of a passage are its first and last sentence where they were cut or joined with others; a passage that consists of no
whole sentence is not found.

Defined results: null and empty texts have no units; a null doc_id ranks after all others and counts as one document; rows that share a doc_id keep the
same units; repeated rows are reported once; a very long text is a very long list of units, read by one task; an empty table gives no rows; other columns, whatever
their names, are passed on by :func:`remove_repeated`, but for one named ``removed``, which is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh3_128_digest

from predaudit.functions.lineage import store

PASSAGE_WORDS = 10
LAST = 2**63 - 1

_BREAK = re.compile(r"\n|(?<=[.!?])[^\S\n]+")


def units(text: str | None) -> list[tuple[int, int, int, bytes]]:
    """``(start, end, words, digest)`` of all units that have a word."""
    found, start = [], 0
    for stop, after in [*((m.start(), m.end()) for m in _BREAK.finditer(text or "")), (len(text or ""), 0)]:
        if stop > start:
            words = text[start:stop].lower().split()
            if words:
                found.append((start, stop, len(words), xxh3_128_digest(" ".join(words).encode())))
        start = after
    return found


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for rank, row, text in zip(*[c.to_pylist() for c in batch.columns]):
            seen = set()
            for no, (start, end, words, digest) in enumerate(units(text)):
                rows.append((rank, row, no, start, end, words, digest, digest in seen))
                seen.add(digest)
            if len(rows) > 50_000:
                yield _batch(rows)
                rows = []
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.bool_())
    columns = list(zip(*rows)) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), t) for c, t in zip(columns, types)], names=["rank", "row", "no", "start", "end", "words", "digest", "again"]
    )


def _rank() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))


def _row() -> Column:
    """Tells the rows of one doc_id apart; equal for equal texts."""
    return F.xxhash64(F.col("text").cast("string"))


def _repeated(docs: DataFrame, passage: int) -> DataFrame:
    """``(rank, row, start, end, words, first)``."""
    rows = docs.select(_rank().alias("rank"), _row().alias("row"), F.col("text").cast("string").alias("text")).mapInArrow(
        _exploded, "rank long, row long, no int, start int, end int, words int, digest binary, again boolean"
    )
    found = store(rows, "repeat-units")
    several = store(
        found.groupBy("digest").agg(F.min("rank").alias("first"), F.max("rank").alias("last"), F.max("again").alias("within"))
        .where("first != last or within").select("digest", "first"), "repeat-digests",
    )
    later = found.join(several, "digest").where((F.col("rank") != F.col("first")) | F.col("again")).drop("digest", "again")
    document = ["rank", "row"]
    removed = later.dropDuplicates([*document, "no"])  # of rows that are repeated as a whole
    follows = F.col("no") - F.row_number().over(Window.partitionBy(*document).orderBy("no"))  # equal for units in sequence
    runs = removed.withColumn("run", follows).withColumn("run_words", F.sum("words").over(Window.partitionBy(*document, "run")))
    return runs.where(F.col("run_words") >= passage).select(*document, "start", "end", "words", "first")


def repeated_units(docs: DataFrame, passage: int = PASSAGE_WORDS) -> DataFrame:
    """``(doc_id, start, end, words, first_doc_id)``: one row per unit to remove, and where its first occurrence is."""
    doc, first = (F.when(F.col(c) != LAST, F.col(c)).alias(name) for c, name in (("rank", "doc_id"), ("first", "first_doc_id")))
    return _repeated(docs, passage).select(doc, *[F.col(c).cast("long").alias(c) for c in ("start", "end", "words")], first)


def _cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
    def left(text: str | None, removed) -> str | None:
        if text is None or removed is None:
            return text
        pieces, at = [], 0
        for span in sorted(removed, key=lambda s: s["start"]):
            pieces.append(text[at : span["start"]])
            at = span["end"]
        return "".join([*pieces, text[at:]])

    return pd.Series([left(t, s) for t, s in zip(texts, spans)], dtype=object)


def remove_repeated(docs: DataFrame, passage: int = PASSAGE_WORDS) -> DataFrame:
    """All rows and columns of ``docs`` with the text that is left and ``removed``, the spans of the original text that are not."""
    first = F.when(F.col("first") != LAST, F.col("first"))
    span = F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), first.alias("first_doc_id"))
    spans = _repeated(docs, passage).groupBy("rank", "row").agg(F.collect_set(span).alias("spans"))  # of one document
    kept = [c for c in docs.columns if c not in ("text", "removed")]
    rows = docs.select(_rank().alias("rank"), _row().alias("row"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("rest"), F.col("text").cast("string").alias("text"))
    joined = rows.join(store(spans, "repeat-spans"), ["rank", "row"], "left")
    cut = F.pandas_udf(_cut, "string")
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(cut("text", "spans"))
    left = joined.select("rest", text.alias("text"), F.col("spans").alias("removed"))
    return left.select(*["text" if c == "text" else F.col(f"rest.`{c}`") for c in docs.columns if c != "removed"], "removed")
