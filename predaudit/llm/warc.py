"""WARC records in seekable Zstandard bundles.

Every page is one record. Records are gathered into frames of about ``FRAME_BYTES``, each an independent Zstandard frame (a record never
spans two), and frames into bundles of about ``BUNDLE_BYTES``. A bundle ends in a seek table of the public seekable format: a skippable
frame with the compressed and the decompressed size of every frame and a footer. The index maps each record to its bundle, its
frame and its place within the frame, so one record costs one seek and one small frame.

Of records with the same payload the one with the smallest page_id is a response, the others are revisits that refer to it and keep its HTTP
headers but not its payload. Payloads that occur once, the most by far, are told apart by a fixed-size bitmap and go straight to a
bundle; only the others are joined with the table of repeated payloads.

Tasks write bundles under names of their own. The index, which Spark commits per task, says which bundles count, so files of lost
or repeated attempts are never read.

Defined results: a null html is an empty payload; a null page_id ranks after all others; rows that repeat both page_id and payload are
records of the same type; control characters in a url are percent-encoded and a null url leaves the header out; an empty table
writes no bundle.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from predaudit.functions.lineage import shared_dir, store
from predaudit.llm.arrow import to_batch
from predaudit.llm.prefilter import split

FRAME_BYTES = 2**20
BUNDLE_BYTES = 2**26
LEVEL = 3
# Fixed values of the seekable format: skippable frame, footer, and the descriptor of a table without checksums.
SKIPPABLE, SEEKABLE, PLAIN = 0x184D2A5E, 0x8F92EAB1, 0
DATE = "1970-01-01T00:00:00Z"  # pages have no date
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = pa.schema(
    [("page_id", pa.int64()), ("record_type", pa.string()), ("bundle", pa.string()), *[(c, pa.int64()) for c in ("frame", "frame_at", "frame_bytes", "at", "bytes")]]
)
INDEX_DDL = "page_id long, record_type string, bundle string, frame long, frame_at long, frame_bytes long, at long, bytes long"
RECORD = pa.schema(
    [("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
     ("url", pa.string()), ("payload", pa.binary())]
)
RECORD_DDL = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, url string, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _number(name: str) -> int | None:
    number = name[len("<urn:x-page:") : -1]
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record. A revisit has the HTTP headers of its response only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    headers = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest(payload)}",
    ]
    if url is not None:
        headers.append("WARC-Target-URI: " + "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    if revisit:
        headers += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {_name(refers_to)}"]
    headers.append(f"Content-Length: {len(block)}")
    return "\r\n".join(headers).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int) -> tuple[tuple, int]:
    """The record at ``at`` as a row of ``RECORD``, and where the next one begins. A payload that does not match its digest is an error."""
    end = data.index(b"\r\n\r\n", at)
    headers = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
    begin, length = end + 4, int(headers["Content-Length"])
    block = data[begin : begin + length]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(line.split(b": ")[1]) for line in http.split(b"\r\n") if line.startswith(b"Content-Length: "))
    kind, declared = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or digest(payload) != declared):
        raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
    refers = _number(headers["WARC-Refers-To"]) if kind == "revisit" else None
    row = (_number(headers["WARC-Record-ID"]), kind, refers, size, declared, headers.get("WARC-Target-URI"), payload if kind == "response" else None)
    return row, begin + length + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), PLAIN, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(file) -> list[tuple[int, int, int]]:
    """``(offset, compressed, decompressed)`` of every frame of an open bundle, from its footer."""
    size = file.size()
    file.seek(size - 9)
    count, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    file.seek(size - 9 - 8 * count)
    sizes = list(struct.iter_unpack("<II", file.read(8 * count)))
    frames, at = [], 0
    for compressed, plain in sizes:
        frames.append((at, compressed, plain))
        at += compressed
    return frames


class _Bundle:
    """A bundle being written by one task: at most one frame of records is held in memory."""

    def __init__(self, folder: str):
        system, path = FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        name = f"bundle-{uuid.uuid4().hex}.warc.zst"
        self.uri, self.file = f"{folder}/{name}", system.open_output_stream(f"{path}/{name}", compression=None)
        self.at, self.frames, self.index, self.held, self.rows = 0, [], [], bytearray(), []

    def add(self, page_id: int | None, kind: str, data: bytes) -> None:
        if self.held and len(self.held) + len(data) > FRAME_BYTES:
            self.flush()
        self.rows.append((page_id, kind, len(self.held), len(data)))
        self.held += data

    def flush(self) -> None:
        if self.held:
            frame = zstandard.ZstdCompressor(level=LEVEL).compress(bytes(self.held))
            self.file.write(frame)
            self.index += [(p, k, self.uri, len(self.frames), self.at, len(frame), at, n) for p, k, at, n in self.rows]
            self.frames.append((len(frame), len(self.held)))
            self.at += len(frame)
            self.held, self.rows = bytearray(), []

    def close(self) -> pa.RecordBatch:
        self.flush()
        self.file.write(seek_table(self.frames))
        self.file.close()
        return to_batch(self.index, INDEX)


def _written(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in batches:
            payloads = batch.column(2).cast(pa.binary()).to_pylist()
            for page, url, refers, revisit, payload in zip(*[batch.column(i).to_pylist() for i in (0, 1, 3, 4)], payloads):
                bundle = bundle or _Bundle(folder)
                bundle.add(page, "revisit" if revisit else "response", record(page, url, payload or b"", refers, revisit))
                if bundle.at >= BUNDLE_BYTES:
                    yield bundle.close()
                    bundle = None
        if bundle:
            yield bundle.close()

    return run


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write all pages below ``folder`` (a path or URI every executor reaches) and return the index, itself kept there as Parquet."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"), F.unhex(F.sha2(payload, 256)).alias("_payload"),
    )
    repeated = store(
        rows.groupBy("_payload").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("_payload", "first"),
        "warc-repeated",
    )
    once, doubtful = split(rows, "_payload", repeated.select("_payload"))
    never, no = F.lit(None).cast("long"), F.lit(False)
    joined = doubtful.join(repeated.withColumn("found", F.lit(True)), "_payload", "left")
    revisit = F.coalesce(F.col("found"), no) & ~F.col("page_id").eqNullSafe(F.col("first"))
    records = once.select("page_id", "url", "html", never.alias("refers_to"), no.alias("revisit")).unionByName(
        joined.select("page_id", "url", "html", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))
    )
    records.mapInArrow(_written(folder), INDEX_DDL).write.parquet(f"{folder}/index")
    return pages.sparkSession.read.schema(INDEX_DDL).parquet(f"{folder}/index")


def _records(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                system, path = FileSystem.from_uri(uri)
                with system.open_input_file(path) as file:
                    for at, compressed, plain in read_seek_table(file):
                        file.seek(at)
                        data = zstandard.ZstdDecompressor().decompress(file.read(compressed), max_output_size=plain)
                        rows, place = [], 0
                        while place < len(data):
                            row, place = parse(data, place)
                            rows.append(row if with_payload else (*row[:-1], None))
                        yield to_batch(rows, RECORD)

    return run


def read(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """All records of the bundles that the index names, read by their own seek tables, one frame at a time."""
    spread = 4 * index.sparkSession.sparkContext.defaultParallelism
    return index.select("bundle").distinct().repartition(spread).mapInArrow(_records(with_payload), RECORD_DDL)


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, data = None, b""
    for batch in batches:
        rows = []
        for uri, frame_at, frame_bytes, at in zip(*[c.to_pylist() for c in batch.columns]):
            if (uri, frame_at) != last:
                system, path = FileSystem.from_uri(uri)
                with system.open_input_file(path) as file:
                    file.seek(frame_at)
                    data = zstandard.ZstdDecompressor().decompress(file.read(frame_bytes))
                last = (uri, frame_at)
            rows.append(parse(data, at)[0])
        yield to_batch(rows, RECORD)


def lookup(index: DataFrame, page_ids: DataFrame) -> DataFrame:
    """The records of ``page_ids`` (one column page_id), by offsets from the index: only frames that hold one are read."""
    wanted = index.join(page_ids.select(F.col("page_id").cast("long").alias("page_id")).distinct(), "page_id")
    places = wanted.select("bundle", "frame_at", "frame_bytes", "at").repartition("bundle").sortWithinPartitions("bundle", "frame_at", "at")
    return places.mapInArrow(_found, RECORD_DDL)


def new_folder(spark: SparkSession) -> str:
    """A fresh folder for one set of bundles below the shared folder."""
    return f"{shared_dir(spark)}/warc/{uuid.uuid4().hex}"
