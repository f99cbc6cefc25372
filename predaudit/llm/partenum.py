"""Similarity join of documents by PartEnum signatures over bands of set sizes, with parity sketches and exact verification.

1. Set sizes are cut into bands ``[l, floor(100 l / percent)]``. Linked sets lie in one band or in two neighbouring ones, so there is an instance
   of the join for every band, which its sets and those of the band below take part in. In it, linked sets differ in at most ``k`` elements.
2. An instance divides the feature domain (hashes of shingles) into more than ``k + 1`` ranges. What a set has in a range is an element
   of its own, and a linked pair disagrees in at most ``k`` of these. So of the subsets a set has in its ranges, the ``k + 1`` first in an order
   that is the same for all sets hold one that the other set has among its own first: these are the signatures. Large subsets come
   first, since small ones are shared by chance. A set with at most ``k`` ranges that are not empty has one more signature, for the case that
   the pair agrees in empty ranges only. No linked pair is missed, whatever the hash values.
3. Documents with the same text are one node, named by their smallest doc_id. Signatures are sorted and packed in the tasks that make them, a stretch of
   nodes at a time, and dealt by their value to slabs of bounded size, where equal ones meet; one that a stretch holds several times is sent once.
   Nodes that share a signature form a bucket, where each is compared with the smallest. A parity sketch (one bit for the number of elements that
   hash to it being odd) differs in no more bits than the sets differ in elements, so it rules out pairs exactly; the others are verified on the
   full sets of the whole texts.
4. Buckets that hold several components of these links are cut into blocks whose sketches are compared in full. Every node that may have a
   partner in another component is verified against the closest one; what is then still open is compared in full, by bit matrices of the shingles.

No group of copies is expanded into its pairs, and no bucket meets in one task.

Defined results: a null or wordless text has an empty set and no links; fewer words than a shingle make one shingle; rows with a null doc_id are not
linked and have a null component; rows of one doc_id and different texts are linked each by its own set; a very long text is one set in one task; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from predaudit.functions.lineage import store
from predaudit.llm.components import components
from predaudit.llm.prefilter import likely_in, without
from predaudit.llm.setsketch import BLOCK, BLOCK_SHINGLES, _cells, verified_texts
from predaudit.llm.shingles import mix, shingle_set

STRETCH = 300_000  # signatures that are packed together
SLICE = 1000  # texts that are taken out of a batch at a time
SLAB = 32_000_000  # bytes of text whose signatures, about one for ten bytes, meet in one task at a time
LOW_BITS = 40
LOW = np.uint64(2**LOW_BITS - 1)
SKETCH_BLOCK = 2048  # nodes of a bucket whose sketches are compared in one task at a time
ROUNDS = 2  # of verifying the closest partner before what is left is compared in full


def band(size: int, percent: int) -> tuple[int, int]:
    """Number and largest size of the band of a set size."""
    number, low = 0, 1
    while (high := low * 100 // percent) < size:
        number, low = number + 1, high + 1
    return number, high


def difference(sizes: int, percent: int) -> int:
    """The most elements in which two sets of together ``sizes`` elements differ if they are linked."""
    return sizes * (100 - percent) // (100 + percent)


def signatures(found: np.ndarray, percent: int) -> np.ndarray:
    """Signatures of a sorted set of hashes in the instances of its own band and of the next."""
    number, high = band(len(found), percent)
    out = []
    for instance, largest in ((number, high), (number + 1, (high + 1) * 100 // percent)):
        k = difference(2 * largest, percent)
        if not k and instance > number:
            continue  # no set of the next band is linked with this one
        ranges = k + 1 + max(3, (k + 1) // 5) if k else 1  # without differences the whole set is the signature
        index = ((found >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
        held = np.diff(np.append(first, len(found)))
        name = np.uint64(instance) << np.uint64(32)
        content = mix(np.add.reduceat(mix(found), first) ^ mix(name + index[first] + np.uint64(1)))
        if len(first) > k:
            content = content[np.lexsort((content, -held))[: k + 1]]
        else:
            content = np.append(content, mix(np.array([name], np.uint64)))
        out.append(content)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def parity(found: np.ndarray) -> np.ndarray:
    """Parity sketch of a set, of at least twice as many bits as it has elements, in bytes."""
    bits = max(64, 1 << (2 * len(found) - 1).bit_length())
    at = (mix(found ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(bool), bitorder="little")


def folded(sketch: np.ndarray, length: int) -> np.ndarray:
    """The sketch of the same set in ``length`` bytes."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, length), axis=0)


def _binary(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def _slab(signed: np.ndarray, slabs: int) -> np.ndarray:
    return (((signed >> np.uint64(32)) * np.uint64(slabs)) >> np.uint64(32)).astype(np.int64)


def _bucket(signed: np.ndarray, slab: np.ndarray) -> np.ndarray:
    """Name of a bucket: the slab and the low bits of the signature."""
    return ((slab.astype(np.uint64) << np.uint64(LOW_BITS)) | (signed & LOW)).view(np.int64)


MADE = pa.schema([
    ("text_key", pa.binary()), ("node", pa.int64()), ("n_shingles", pa.int64()), ("sketch", pa.binary()),  # of a text
    ("band", pa.int64()),  # with node: a further node of a bucket
    ("slab", pa.int32()), ("low", pa.binary()), ("at", pa.binary()), ("nodes", pa.binary()),  # signatures of a stretch of nodes
])


def _filled(rows: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(rows, f.type) for f in MADE], schema=MADE)


def _packed(nodes: list[int], signed: list[np.ndarray], slabs: int) -> Iterator[pa.RecordBatch]:
    """Signatures of a stretch of nodes, one row per slab; and a row for every further node of a bucket that the stretch has several nodes of."""
    values = np.concatenate(signed)
    owner = np.repeat(np.arange(len(nodes)), [len(x) for x in signed])
    names = np.array(nodes, np.int64)
    order = np.lexsort((names[owner], values))
    values, owner = values[order], owner[order]
    first = np.concatenate([[True], values[1:] != values[:-1]])
    several = np.zeros(len(values), bool)
    several[:-1] = ~first[1:] & first[:-1]
    slab = _slab(values, slabs)
    again = np.flatnonzero(~first)
    again = again[names[owner[again]] != names[owner[again - 1]]]  # rows that repeat a doc_id and a text
    if len(again):
        yield _filled(
            len(again), slab=pa.array(slab[again].astype(np.int32)), band=pa.array(_bucket(values[again], slab[again])), node=pa.array(names[owner[again]])
        )
    at = (owner[first] | (several[first] << 15)).astype(np.uint16)
    values, slab = values[first], slab[first]
    low = (values & LOW).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : LOW_BITS // 8]
    ends = np.flatnonzero(np.concatenate([slab[1:] != slab[:-1], [True]])) + 1
    starts = np.concatenate([[0], ends[:-1]])
    flag = at & np.uint16(1 << 15)
    held, tables = [], []
    for i, j in zip(starts, ends):  # with very many slabs a row names few of the nodes
        used, index = np.unique(at[i:j] & np.uint16(2**15 - 1), return_inverse=True)
        held.append((index.astype(np.uint16) | flag[i:j]).tobytes())
        tables.append(names[used].tobytes())
    yield _filled(
        len(ends), slab=pa.array(slab[starts].astype(np.int32)), low=pa.array([low[i:j].tobytes() for i, j in zip(starts, ends)], pa.binary()),
        at=pa.array(held, pa.binary()), nodes=pa.array(tables, pa.binary()),
    )


def _made(percent: int, slabs: int):
    """From ``(text_key, node, text)``: size and sketch of every text, and the signatures of those that have a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, signed, held = [], [], 0
        for batch in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
            sizes, sketches = [], []
            for node, text in zip(batch.column(1).to_pylist(), _binary(batch.column(2))):
                found = shingle_set(text)
                sizes.append(len(found))
                sketches.append(parity(found).tobytes() if len(found) else None)
                if len(found) and node is not None:
                    signed.append(signatures(found, percent))
                    nodes.append(node)
                    held += len(signed[-1])
                    if held >= STRETCH or len(nodes) == 2**15 - 1:
                        yield from _packed(nodes, signed, slabs)
                        nodes, signed, held = [], [], 0
            yield _filled(
                len(sizes), text_key=batch.column(0).cast(pa.binary()), node=batch.column(1), n_shingles=pa.array(sizes, pa.int64()),
                sketch=pa.array(sketches, pa.binary()),
            )
        if nodes:
            yield from _packed(nodes, signed, slabs)

    return run


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(band, node)`` of the signatures of a slab that several nodes have. Rows come sorted by slab."""
    current, held = None, []

    def shared() -> Iterator[pa.RecordBatch]:
        count = np.array([len(at) // 2 for _, at, _ in held])
        low = np.zeros((count.sum(), 8), np.uint8)
        low[:, : LOW_BITS // 8] = np.frombuffer(b"".join(x for x, _, _ in held), np.uint8).reshape(-1, LOW_BITS // 8)
        value = low.reshape(-1).view("<u8")
        at = np.frombuffer(b"".join(x for _, x, _ in held), np.uint16)
        tables = [np.frombuffer(x, np.int64) for _, _, x in held]
        held.clear()  # a slab has millions of signatures, so nothing is kept longer than needed
        place = np.repeat(np.cumsum([0, *[len(t) for t in tables[:-1]]]), count)
        place += at & np.uint16(2**15 - 1)
        node = np.concatenate(tables)[place]
        del low, tables, place
        order = np.argsort(value, kind="stable")
        value = value[order]
        node = node[order]
        several = (at >> np.uint16(15)).astype(bool)[order]
        del order, at
        same = np.concatenate([[False], value[1:] == value[:-1], [False]])
        keep = same[1:] | same[:-1] | several
        band = (np.uint64(current) << np.uint64(LOW_BITS)) | value[keep]
        yield pa.RecordBatch.from_arrays([pa.array(band.view(np.int64)), pa.array(node[keep])], names=["band", "node"])

    for batch in batches:
        passed = batch.filter(batch.column(1).is_valid())
        if passed.num_rows:
            yield passed.select(["band", "node"])
        for slab, band_, _, *packed in zip(*[c.to_pylist() for c in batch.filter(batch.column(1).is_null()).columns]):
            if band_ is None:
                if slab != current and held:
                    yield from shared()
                    held = []
                current = slab
                held.append(packed)
    if held:
        yield from shared()


def shared_signatures(made: DataFrame, slabs: int) -> DataFrame:
    """``(band, node)``: the buckets of several nodes, from the signatures in ``made``."""
    rows = made.where("slab is not null").select("slab", "band", "node", "low", "at", "nodes")
    return rows.repartition(min(slabs, 10_000), "slab").sortWithinPartitions("slab").mapInArrow(_meeting, "band long, node long")


def distinct_buckets(bands: DataFrame) -> DataFrame:
    """``(band, least, size)`` of one bucket for each set of members, told apart by the smallest, their number and 64 bits of hash of all.

    Sets that share one signature mostly share many.
    """
    members = F.bit_xor(F.xxhash64("node")).alias("members")
    buckets = bands.groupBy("band").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("size"), members).where("size > 1")
    return buckets.groupBy("least", "size", "members").agg(F.min("band").alias("band")).select("band", "least", "size")


def _close(one: np.ndarray, n_one, others: np.ndarray, n_others: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Differing bits of sketches of one length, and whether they allow a link."""
    apart = np.bitwise_count(one ^ others).sum(1, dtype=np.int64)
    fits = 100 * np.minimum(n_one, n_others) >= percent * np.maximum(n_one, n_others)
    return apart, fits & (apart * (100 + percent) <= (100 - percent) * (n_one + n_others))


def _possible(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = (batch.column(i).to_numpy() for i in (2, 3))
            keep = []
            for x, y, a, b in zip(_binary(batch.column(4)), _binary(batch.column(5)), n_a, n_b):
                length = min(len(x), len(y))
                x, y = (folded(np.frombuffer(s, np.uint8), length).view(np.uint64) for s in (x, y))
                keep.append(bool(_close(x, a, y[None, :], np.array([b]), percent)[1][0]))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], names=["a", "b"])

    return run


def possible_pairs(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` of nodes whose parity sketches allow a link."""
    sides = [nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab"]
    joined = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")
    return joined.mapInArrow(_possible(percent), "a long, b long")


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    named = labels.select("node", F.col("component").alias("_label"))
    return members.drop("component").join(named, "node", "left").withColumn("component", F.coalesce("_label", "node")).drop("_label")


def _mixed(members: DataFrame) -> DataFrame:
    """Buckets ``(band, main, n_main, n_others, mass, size)`` of several components; ``main`` has the most members."""
    sizes = members.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("mass"))
    whole = sizes.groupBy("band").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("size"), F.sum("mass").alias("mass"), F.count(F.lit(1)).alias("several"))
    return whole.where("several > 1").select(
        "band", F.col("main.component").alias("main"), F.col("main.n").alias("n_main"), (F.col("size") - F.col("main.n")).alias("n_others"), "mass", "size"
    )


def _dealt(members: DataFrame, block: int, block_mass: int) -> DataFrame:
    """``(band, i, j, block, node, component)``: members of mixed buckets, dealt to cells of one or two blocks of a bucket.

    Members of the main component need no comparison with each other, so they meet only blocks of others.
    """
    mixed = store(_mixed(members), "pe-mixed")
    stray = F.col("component") != F.col("main")

    def blocks(n: str) -> Column:
        return F.ceil(F.greatest(F.col(n) / block, F.col("mass") * F.col(n) / F.col("size") / block_mass))

    dealt = members.select("band", "node", "component").join(mixed, "band").withColumns({"strays": blocks("n_others"), "copies": blocks("n_main")})
    at = F.when(stray, F.pmod(F.xxhash64("node"), "strays")).otherwise(F.col("strays") + F.pmod(F.xxhash64("node"), "copies"))
    partners = F.sequence(F.lit(0).cast("long"), F.when(stray, F.col("strays") + F.col("copies") - 1).otherwise(F.col("strays") - 1))
    return dealt.withColumn("block", at).withColumn("other", F.explode(partners)).select(
        "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "component"
    )


def _closest_in_cell(rows: list[tuple], percent: int) -> Iterator[tuple[int, int | None]]:
    """``(node, partner)``: nodes of a cell of ``(node, block, component, n, sketch)`` that may have a link to another component.

    The partner is the closest such node; members of the cell's largest component have none, as their links are seen from the other end.
    """
    length = min(len(r[4]) for r in rows)
    sketches = np.stack([folded(np.frombuffer(r[4], np.uint8), length) for r in rows]).view(np.uint64)
    node, block, component, n = (np.array([r[i] for r in rows]) for i in range(4))
    names, members = np.unique(component, return_counts=True)
    least = np.full(len(rows), 2.0)
    closest = np.zeros(len(rows), np.int64)
    largest = names[members.argmax()]
    for x in np.flatnonzero(component != largest):
        other = (component != component[x]) & ((block != block[x]) | (block[0] == block[-1]))
        apart, allowed = _close(sketches[x], n[x], sketches, n, percent)
        share = np.where(allowed & other, apart / (n + n[x]), 2.0)
        if (best := share.argmin()) != x and share[best] < least[x]:
            least[x], closest[x] = share[best], node[best]
        better = share < least
        least[better], closest[better] = share[better], node[x]
    for x in np.flatnonzero(least < 2):
        yield int(node[x]), int(closest[x]) if component[x] != largest else None


def _closest(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, found = None, [], []

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], pa.int64()) for i in range(3)], names=["band", "node", "partner"])

        for batch in batches:
            for band_, i, j, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if (band_, i, j) != at:
                    if len(held) > 1:
                        found += [(at[0], *pair) for pair in _closest_in_cell(held, percent)]
                    held, at = [], (band_, i, j)
                    if len(found) > 20_000:
                        yield rows()
                        found = []
                held.append(row)
        if len(held) > 1:
            found += [(at[0], *pair) for pair in _closest_in_cell(held, percent)]
        yield rows()

    return run


def closest_partners(members: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """``(band, node, partner)`` of members of mixed buckets whose sketches allow a link to another component, with the closest in each cell."""
    dealt = _dealt(members, SKETCH_BLOCK, SKETCH_BLOCK * 1024)
    rows = dealt.join(nodes.select("node", "n_shingles", "sketch"), "node")
    sorted_ = rows.select("band", "i", "j", "node", "block", "component", "n_shingles", "sketch").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "block")
    return sorted_.mapInArrow(_closest(percent), "band long, node long, partner long")


def _compared(members: DataFrame, texts_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """Verified links ``(a, b)`` between components of buckets, all pairs compared on full sets."""
    cells = store(_dealt(members, BLOCK, BLOCK_SHINGLES), "pe-cells").withColumnRenamed("node", "doc_id")
    rows = texts_of(cells.select("doc_id")).join(cells, "doc_id").select("band", "i", "j", "doc_id", "block", "component", "text")
    return rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(_cells(percent), "a long, b long")


def _keyed(docs: DataFrame) -> DataFrame:
    """With the key of the text, and a name for rows of the same doc_id and text."""
    keyed = docs.withColumn("text_key", F.unhex(F.md5("text")))
    return keyed.withColumn("name", F.concat("text_key", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))


def linked_classes(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row of ``docs``; the component is the smallest doc_id that links lead to."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = _keyed(docs)
    rows = store(keyed.select("doc_id", "text_key", F.octet_length("text").alias("bytes")), "pe-rows")
    texts = store(rows.groupBy("text_key").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("rows")), "pe-texts")
    # one row of each text: rows of texts that stand alone are passed on without a shuffle
    name = F.concat("text_key", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    copies = rows.join(texts.where("rows > 1").drop("rows"), "text_key").where(~F.col("doc_id").eqNullSafe(F.col("node"))).select(name.alias("name")).distinct()
    copies = store(copies, "pe-copies")
    ones = without(keyed, "name", copies).withColumnRenamed("doc_id", "node")
    slabs = max(1, -(-rows.agg(F.coalesce(F.sum(F.col("bytes").cast("long")), F.lit(0))).first()[0] // SLAB))
    schema = "text_key binary, node long, n_shingles long, sketch binary, band long, slab int, low binary, at binary, nodes binary"
    made = store(ones.select("text_key", "node", "text").mapInArrow(_made(percent, slabs), schema), "pe-made")
    nodes = made.where("text_key is not null").select("text_key", "node", "n_shingles", "sketch").dropDuplicates(["text_key"])
    nodes = store(nodes, "pe-nodes")
    named = nodes.where("node is not null and n_shingles > 0")

    def single(wanted: DataFrame) -> DataFrame:
        """Texts of wanted nodes. Other rows go first, so the texts of copies are not shuffled to be dropped."""
        near = _keyed(likely_in(docs.where("doc_id is not null"), "doc_id", wanted))
        return without(near, "name", copies).select("doc_id", "text")

    bands = store(shared_signatures(made, slabs), "pe-bands")
    buckets = store(distinct_buckets(bands), "pe-buckets")
    members = bands.join(buckets, "band").join(named.select("node", "n_shingles").dropDuplicates(["node"]), "node")
    members = store(members.select("band", "node", "n_shingles", "least", "size"), "pe-members")
    star = members.where("node != least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    links = store(verified_texts(store(possible_pairs(star, named, percent), "pe-star"), single, percent), "pe-links")
    labels = components(links)
    members = members.where("size > 2").drop("least", "size")  # of two members one is the smallest, with which the other was compared
    for _ in range(ROUNDS):
        members = store(_labelled(members, labels), "pe-labelled")
        found = store(closest_partners(members, named, percent), "pe-closest")
        if found.isEmpty():
            break
        pairs = found.where("partner is not null").select(F.greatest("node", "partner").alias("a"), F.least("node", "partner").alias("b")).distinct()
        more = store(verified_texts(store(pairs, "pe-pairs"), single, percent), "pe-links")
        links = links.unionByName(more)
        labels = components(links)
        members = members.join(found.select("band", "node").distinct(), ["band", "node"], "left_semi")
    else:
        members = store(_labelled(members, labels), "pe-labelled")
        links = links.unionByName(store(_compared(members, single, percent), "pe-links"))
        labels = components(links)
    classes = _labelled(texts.select("text_key", "node").where("node is not null"), labels)
    known = classes.join(nodes.select("text_key", "n_shingles"), "text_key").select("text_key", "n_shingles", "component")
    unknown = nodes.where("node is null").select("text_key", "n_shingles", F.lit(None).cast("long").alias("component"))
    linked = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")))
    return rows.join(known.unionByName(unknown), "text_key").select("doc_id", "n_shingles", linked.alias("component_id"))
