"""One large JSON array read by many tasks.

The file is cut at every closing brace, which a text source can do in parallel. Where a block of it begins, nobody knows whether that is inside a string and
how deep in the nesting. So there are two passes: the first sums up each block for both cases (does it end inside a string, how far does the nesting
change, how many commas stand at which depth), a few numbers per block, from which the state at the start of every block follows. The second deals the
elements of the array out: those that lie in one block are whole, the pieces of the others are put together. Elements become lines, which the JSON reader
takes from there, so schemas, options and corrupt records are its business.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from predaudit.functions.lineage import shared_dir

_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*+("?)|[\[\]{},]', re.S)
_STRING_END = re.compile(r'(?:[^"\\]|\\.)*+"', re.S)


class Scan:
    """Reads the pieces of a text one after another, and knows whether it is inside a string, and how deep."""

    def __init__(self, inside: bool = False, depth: int = 0):
        self.inside, self.depth = inside, depth

    def tokens(self, text: str) -> Iterator[tuple[int, str, int]]:
        """``(position, token, depth)`` of brackets and commas outside strings; the depth is that around the token."""
        at = 0
        if self.inside:
            end = _STRING_END.match(text)
            if end is None:
                return
            at, self.inside = end.end(), False
        for m in _TOKEN.finditer(text, at):
            token = m[0][0]
            if token == '"':
                self.inside = not m[1]
            elif token in "[{":
                yield m.start(), token, self.depth
                self.depth += 1
            elif token in "]}":
                self.depth -= 1
                yield m.start(), token, self.depth
            else:
                yield m.start(), token, self.depth


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str]]:
    for batch in batches:
        for text, path, start in zip(*[c.to_pylist() for c in batch.columns]):
            yield (path, start), text + "}"  # the one added to the end of a file stands behind its array


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[tuple[str, int], list] = {}
    for block, text in _blocks(batches):
        if block not in found:
            found[block] = [text.lstrip()[:1], [(Scan(inside), Counter()) for inside in (False, True)]]
        for scan, commas in found[block][1]:
            for _, token, depth in scan.tokens(text):
                if token == ",":
                    commas[depth] += 1
    rows = [
        (path, start, first, inside, scan.inside, scan.depth, list(commas.keys()), list(commas.values()))
        for (path, start), (first, cases) in found.items()
        for inside, (scan, commas) in zip((False, True), cases)
    ]
    types = [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = ["path", "start", "first", "inside", "ends_inside", "change", "depths", "commas"]
    columns = list(zip(*rows)) or [()] * len(types)
    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)


def block_states(summaries: list) -> dict[tuple[str, int], tuple[bool, int, int]]:
    """``(inside a string, depth, number of the open element)`` where each block begins, from the summaries of all blocks."""
    case = {(s["path"], s["start"], s["inside"]): s for s in summaries}
    states, path = {}, None
    for block in sorted({(s["path"], s["start"]) for s in summaries}):
        if block[0] != path:
            path, inside, depth, element = block[0], False, 0, 0
        states[block] = inside, depth, element
        s = case[(*block, inside)]
        element += dict(zip(s["depths"], s["commas"])).get(1 - depth, 0)
        inside, depth = s["ends_inside"], depth + s["change"]
    return states


def _elements(states: dict[tuple[str, int], tuple[bool, int, int]]):
    """``(path, element, start, text, whole)``: the elements of the array and the pieces of those that blocks cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, block, closed = [], None, False
        piece: list[str] = []

        def put(whole: bool) -> None:
            text = "".join(piece).replace("\n", " ").replace("\r", " ").strip()
            if text:
                rows.append((block[0], element, block[1], text if whole else "".join(piece).replace("\n", " ").replace("\r", " "), whole))
            piece.clear()

        for here, text in _blocks(batches):
            if here != block:
                if block is not None and not closed:
                    put(False)
                piece.clear()
                block = here
                inside, depth, element = states[here]
                scan, begun, closed = Scan(inside, depth), depth == 0, depth < 0
            at = 0
            for position, token, depth in () if closed else scan.tokens(text):
                if depth == 0 and token == "[":
                    at, begun = position + 1, True
                elif depth <= 0 and token in "]}":
                    piece.append(text[at:position])
                    put(begun)
                    closed = True
                    break
                elif depth == 1 and token == ",":
                    piece.append(text[at:position])
                    put(begun)
                    at, begun, element = position + 1, True, element + 1
            if not closed:
                piece.append(text[at:])
            if len(rows) > 10_000:
                yield _batch(rows)
                rows = []
        if block is not None and not closed:
            put(False)
        yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    columns = list(zip(*rows)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=["path", "element", "start", "text", "whole"])


def array_elements(spark: SparkSession, path: str) -> DataFrame | None:
    """``(text)``: the elements of the JSON arrays at ``path``, each on one line. None if a file does not hold an array."""
    chunks = spark.read.text(path, lineSep="}").select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    summaries = chunks.mapInArrow(
        _summaries, "path string, start long, first string, inside boolean, ends_inside boolean, change long, depths array<long>, commas array<long>"
    ).collect()  # two rows per block
    if not summaries or any(s["first"] != "[" for s in summaries if s["start"] == 0):
        return None
    rows = chunks.mapInArrow(_elements(block_states(summaries)), "path string, element long, start long, text string, whole boolean")
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda p: p["text"])
    joined = rows.where(~F.col("whole")).groupBy("path", "element").agg(F.trim(F.array_join(pieces, "")).alias("text")).where("text <> ''")
    return rows.where("whole").select("text").unionByName(joined.select("text"))


def stored_lines(spark: SparkSession, path: str) -> str | None:
    """A folder of JSON lines with the elements of the arrays at ``path``, below the shared folder. None if there is no array."""
    elements = array_elements(spark, path)
    if elements is None:
        return None
    out = f"{shared_dir(spark)}/json/lines-{uuid.uuid4().hex}"
    elements.write.text(out)
    return out
