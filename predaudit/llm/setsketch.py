"""Near-duplicate documents by SetSketch registers, banding, a joint likelihood and exact verification.

1. Every document gets the sorted set of its word shingles and ``REGISTERS`` registers: for each of as many hash functions the
   minimum over the set, turned into an exponentially distributed value and stored as its truncated logarithm to base ``BASE``.
   Registers of a union are the maxima of the registers, and two are equal with a probability close to the similarity.
2. Documents with the same set are one node, named by their smallest doc_id. Nodes with equal registers in a band of ``BAND`` meet
   in a bucket. A pair of similarity 0.75 meets in none of the 40 bands with probability (1 - 0.75^4)^40 < 3e-7.
3. In each bucket all nodes are compared with the smallest one. The number of registers that are greater, smaller and equal gives the
   likelihood of every similarity, with the set sizes known. A pair is discarded if 0.75 is less likely than the best estimate
   by a factor e^16; by Chernoff's bound that hits a linked pair with probability below 2e-7. A size ratio below 0.75 rules a link out
   altogether. The rest is verified on the full sets of the whole texts.
4. Buckets that hold several components of these links are cut into blocks, and pairs of blocks are compared in full, by bit matrices of
   their shingles. Only links that join components leave the task, so no group of copies is expanded into its pairs.
5. Components are formed of all verified links.

Defined results: a null or wordless text has an empty set and no links; fewer words than a shingle make one shingle; rows with a null
doc_id are not linked, have a null component and are kept; rows that share a doc_id act as one node in links, but only copies of others are dropped; a very
long text is one set in one task; an empty table gives no rows; other columns are kept whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from predaudit.functions.lineage import store
from predaudit.llm.components import components
from predaudit.llm.names import aside
from predaudit.llm.prefilter import likely_in, without
from predaudit.llm.shingles import mix, shingle_set

REGISTERS, BAND = 160, 4
BASE, RATE, LARGEST = 1.001, 20.0, 2**16 - 1
MARGIN = 16.0  # of the log-likelihood
MEMBERS = 64  # compared with one copy of a hub's text
BLOCK, BLOCK_SHINGLES = 256, 2**19  # documents and shingles of a bucket that are compared in one task at a time
COLUMNS = 2**15  # of a bit matrix

_FACTORS = (np.random.RandomState(7).randint(0, 2**31, REGISTERS).astype(np.uint32) * np.uint32(2) + np.uint32(1))[:, None]


def registers(shingles: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of 64-bit hashes."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 2**32 - 1, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(least, (_FACTORS * x[i : i + 2048]).min(axis=1), out=least)
    value = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, LARGEST).astype(np.uint16)


def bands(sketch: np.ndarray) -> np.ndarray:
    """One hash per band of registers."""
    packed = np.ascontiguousarray(sketch).view(np.uint64)
    return mix(packed ^ mix(np.arange(1, len(packed) + 1, dtype=np.uint64))).view(np.int64)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def _log_likelihood(j, u, v, more, fewer, equal):
    tiny = 1e-12
    p, q = np.maximum(_p(u - v * j), tiny), np.maximum(_p(v - u * j), tiny)
    return more * np.log(p) + fewer * np.log(q) + equal * np.log(np.maximum(1 - p - q, tiny))


def estimate(n_a, n_b, more, fewer, equal, threshold: float):
    """Most likely similarity of each pair, and whether ``threshold`` is still plausible or the size ratio rules it out."""
    n_a, n_b = np.asarray(n_a, np.float64), np.asarray(n_b, np.float64)
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    reach = high.copy()
    for _ in range(40):  # the log-likelihood is concave in the similarity
        a, b = low + (high - low) * 0.382, low + (high - low) * 0.618
        left = _log_likelihood(a, u, v, more, fewer, equal) > _log_likelihood(b, u, v, more, fewer, equal)
        low, high = np.where(left, low, a), np.where(left, b, high)
    best = (low + high) / 2
    at = _log_likelihood(np.minimum(threshold, reach), u, v, more, fewer, equal)
    lost = _log_likelihood(best, u, v, more, fewer, equal) - at
    fits = np.minimum(n_a, n_b) >= threshold * np.maximum(n_a, n_b)
    return best, fits & ((best >= threshold) | (lost <= MARGIN))


def _binary(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, keys, sketches, banded, texts = [], [], [], [], []
        for text in _binary(batch, "text"):
            texts.append(hashlib.md5(text or b"").digest())
            found = shingle_set(text)
            sketch = registers(found) if len(found) else None
            sizes.append(len(found))
            keys.append(xxh3_128_digest(found.tobytes()) if len(found) else None)
            sketches.append(None if sketch is None else sketch.tobytes())
            banded.append(None if sketch is None else bands(sketch))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                pa.array(sketches, pa.binary()), pa.array(banded, pa.list_(pa.int64())), pa.array(texts, pa.binary()),
            ],
            names=["doc_id", "n_shingles", "set_key", "sketch", "bands", "text_key"],
        )


def sketch_documents(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, set_key, sketch, bands, text_key)`` of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _sketches, "doc_id long, n_shingles long, set_key binary, sketch binary, bands array<long>, text_key binary"
    )


def _matrix(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(len(column), REGISTERS)


def _plausible(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = _matrix(_binary(batch, "sketch_a")), _matrix(_binary(batch, "sketch_b"))
                sizes = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("n_a", "n_b")]
                _, keep = estimate(*sizes, (x > y).sum(1), (x < y).sum(1), (x == y).sum(1), threshold)
                yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in (0, 1)], names=["a", "b"])

    return run


def plausible_pairs(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``(a, b)`` whose registers leave a similarity of ``threshold`` plausible."""
    sides = [
        nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
        for x in "ab"
    ]
    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(
        _plausible(threshold), "a long, b long"
    )


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.cast(pa.binary()).to_pylist() if pa.types.is_string(c.type) else c.to_pylist() for c in batch.columns])


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hubs, found = None, [], []
        for hub, chunk, role, node, text in _rows(batches):  # a hub's own text comes before its members
            if (hub, chunk) != at:
                at, hubs = (hub, chunk), []
            own = shingle_set(text)
            if not role:
                hubs.append(own)
                continue
            for other in hubs:
                common = len(np.intersect1d(own, other, assume_unique=True))
                if 100 * common >= percent * (len(own) + len(other) - common):
                    found.append((node, hub))
                    break
            if len(found) >= 10_000:
                yield _edges(found)
                found = []
        yield _edges(found)

    return run


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def verified(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs of rows of ``docs`` whose full sets share at least ``percent`` hundredths of their union."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return verified_texts(pairs, lambda wanted: likely_in(docs, "doc_id", wanted), percent)


def verified_texts(pairs: DataFrame, texts_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """The pairs whose full sets share at least ``percent`` hundredths of their union; ``texts_of`` gives ``(doc_id, text)`` of wanted ids, and of a few others.

    Members are sent to their hub in chunks of about ``MEMBERS``, each with one copy of the hub's text; rows of a chunk are read
    one after another, so a task holds one hub's set and one member's.
    """
    degree = pairs.groupBy(F.col("b").alias("hub")).agg(F.count(F.lit(1)).alias("members"))
    chunks = degree.select("hub", F.ceil(F.col("members") / MEMBERS).alias("chunks"))
    members = pairs.join(chunks, pairs["b"] == chunks["hub"]).select(
        F.col("a").alias("doc_id"), "hub", F.pmod(F.xxhash64("a"), "chunks").alias("chunk"), F.lit(1).alias("role")
    )
    own = chunks.select(
        F.col("hub").alias("doc_id"), "hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"),
        F.lit(0).alias("role"),
    )
    needed = store(members.union(own), "nd-needed")
    rows = texts_of(needed.select("doc_id")).join(needed, "doc_id").select("hub", "chunk", "role", "doc_id", "text")
    return (
        rows.repartition("hub", "chunk").sortWithinPartitions("hub", "chunk", "role").mapInArrow(_verify(percent), "a long, b long")
    )


def common_counts(sets: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Size of the intersection of each set in ``rows`` with every set, by bit matrices over the shingles that several sets share."""
    found = np.zeros((len(rows), len(sets)), np.int64)
    _, which, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    shared = times > 1
    column = (np.cumsum(shared) - 1)[which]
    owner, column = owner[shared[which]], column[shared[which]]
    for low in range(0, int(shared.sum()), COLUMNS):
        here = (column >= low) & (column < low + COLUMNS)
        dense = np.zeros((len(sets), COLUMNS), bool)
        dense[owner[here], column[here] - low] = True
        bits = np.packbits(dense[:, : max(64, -(-int(column[here].max() - low + 1) // 64) * 64)], axis=1).view(np.uint64)
        for at, row in enumerate(rows):
            found[at] += np.bitwise_count(bits & bits[row]).sum(1, dtype=np.int64)
    return found


def _links(rows: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links between components within a cell of ``(node, block, component, text)``, verified on the full sets: a spanning forest of them."""
    rows.sort(key=lambda r: r[:3])
    node, component = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
    if (component == component[0]).all():
        return []
    sets = [shingle_set(r[3]) for r in rows]
    size = np.array([len(x) for x in sets])
    names, members = np.unique(component, return_counts=True)
    smaller = np.flatnonzero(component != names[members.argmax()])  # every pair across components has one of these
    common = common_counts(sets, smaller)
    linked = 100 * common >= percent * (size[smaller][:, None] + size[None, :] - common)
    parent = {int(c): int(c) for c in names}

    def root(c: int) -> int:
        while parent[c] != c:
            c = parent[c]
        return c

    found = []
    for at, x in enumerate(smaller):
        for y in np.flatnonzero(linked[at] & (component != component[x])):
            p, q = root(int(component[x])), root(int(component[y]))
            if p != q:
                parent[max(p, q)] = min(p, q)
                found.append((int(node[x]), int(node[y])))
    return found


def _cells(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, found = None, [], []
        for band, i, j, *row in _rows(batches):
            if (band, i, j) != at:
                found += _links(held, percent) if len(held) > 1 else []
                held, at = [], (band, i, j)
                if len(found) >= 10_000:
                    yield _edges(found)
                    found = []
            held.append(row)
        yield _edges(found + (_links(held, percent) if len(held) > 1 else []))

    return run


def _labelled(df: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    named = labels.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    return df.join(named, F.col("node") == F.col("_node"), "left").withColumn(
        column, F.coalesce("_component", "node")
    ).drop("_node", "_component")


def _left_over(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, dealt to cells of one or two blocks of a bucket.

    Two members of the bucket's main component need no comparison, so every cell has a block of the others: a group of copies is
    sent once per block of strays, not once per block of copies.
    """
    current = store(_labelled(members, labels, "component"), "nd-members")
    sizes = current.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = (
        sizes.groupBy("band").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("several"))
        .where("several > 1").select("band", F.col("main.component").alias("main"), F.col("main.n").alias("n_main"), (F.col("all") - F.col("main.n")).alias("n_others"))
    )
    stray = F.col("component") != F.col("main")

    def blocks(n: str) -> Column:
        return F.ceil(F.greatest(F.col(n) / BLOCK, F.col("mass") * F.col(n) / F.col("size") / BLOCK_SHINGLES))

    dealt = (
        current.join(store(mixed, "nd-mixed"), "band").withColumns({"strays": blocks("n_others"), "copies": blocks("n_main")})
        .withColumn(
            "block",
            F.when(stray, F.pmod(F.xxhash64("node"), "strays")).otherwise(F.col("strays") + F.pmod(F.xxhash64("node"), "copies")),
        )
    )
    partners = F.sequence(F.lit(0).cast("long"), F.when(stray, F.col("strays") + F.col("copies") - 1).otherwise(F.col("strays") - 1))
    return dealt.withColumn("other", F.explode(partners)).select(
        "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.col("node").alias("doc_id"),
        "block", "component",
    )


def _classes(docs: DataFrame, percent: int) -> DataFrame:
    """``(doc_id, text_key, n_shingles, component_id, kept)`` of every row; ``text_key`` is the digest of its text."""
    threshold = percent / 100
    sketched = store(sketch_documents(docs), "nd-sketches")
    named = sketched.where(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    sets = store(named.groupBy("set_key").agg(F.min("doc_id").alias("node")), "nd-sets")
    nodes = store(
        named.withColumnRenamed("doc_id", "node").join(sets, ["node", "set_key"])
        .dropDuplicates(["node", "set_key"]).select("node", "n_shingles", "sketch", "bands"), "nd-nodes",
    )
    exploded = nodes.select("node", "n_shingles", F.explode("bands").alias("band"))
    buckets = (
        exploded.groupBy("band")
        .agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("size"), F.sum("n_shingles").alias("mass")).where("size > 1")
    )
    members = store(exploded.select("node", "band").join(store(buckets, "nd-buckets"), "band"), "nd-bucketed")
    star = members.where("node != least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    links = store(verified(store(plausible_pairs(star, nodes, threshold), "nd-star"), docs, percent), "nd-links")
    labels = components(links)

    cells = store(_left_over(members, labels), "nd-cells")
    texts = likely_in(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", cells.select("doc_id"))
    rows = texts.join(cells, "doc_id").select("band", "i", "j", "doc_id", "block", "component", "text")
    across = rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(_cells(percent), "a long, b long")
    labels = components(links.union(store(across, "nd-across")))

    rows = sketched.select("doc_id", "text_key", "n_shingles", "set_key")
    linked = _labelled(rows.where(F.col("set_key").isNotNull()).join(sets, "set_key", "left"), labels, "component_id")
    alone = rows.where(F.col("set_key").isNull()).withColumn("component_id", F.col("doc_id"))  # all empty texts would meet in one key
    every = linked.select(*alone.columns).unionByName(alone)
    return every.select(
        "doc_id", "text_key", "n_shingles",
        F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"),
    )


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every row of ``docs``."""
    return _classes(docs, percent).drop("text_key")


def _row(doc_id: Column, text_key: Column) -> Column:
    """Tells rows apart: equal only for rows that share doc_id and text."""
    return F.concat(text_key, F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def drop_near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The document with the smallest doc_id of every group, with all columns. Only rows that may go are shuffled.

    Rows are told apart by doc_id and text, so one that shares only the doc_id of a copy stays.
    """
    gone = _classes(docs, percent).where("not kept").select(_row(F.col("doc_id"), F.col("text_key")).alias("_row")).distinct()
    order = docs.columns
    docs, back = aside(docs, ("_row",))
    text_key = F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    keyed = docs.withColumn("_row", _row(F.col("doc_id").cast("long"), text_key))
    return without(keyed, "_row", store(gone, "nd-gone")).drop("_row").withColumnsRenamed(back).select(*[F.col(f"`{c}`") for c in order])
