"""Benchmark decontamination by spaced seeds and substitution-tolerant verification.

A mask of ones and zeros slides over the words of a text; the words under its ones are hashed, those under its zeros are ignored. A passage
in which single words were replaced therefore still shares hashes with the benchmark item. Hashes of the documents are held against
a bitmap of all hashes of the benchmark, a fixed number of bytes whatever either side holds; what passes is joined with the benchmark's
hashes exactly. Each hit gives an alignment of item and document, and the item counts as leaked if among some
``WINDOW`` consecutive words of it (all, if it has fewer) at least ``PERCENT`` hundredths stand in the document at their place.

Items of fewer than ``SPACED`` words have unspaced masks, so short that the words that may be replaced cannot hit every part of the item: whatever the rule
accepts has a hit. Only masks that some item needs are laid over the documents.

Documents with equal texts are verified once. Words are lower-cased, without ASCII punctuation.

Defined results: null or empty texts have no hits; items of fewer than ``LEAST_WORDS`` words are not looked for, since one or two words are no
leak; equal items are reported under the smallest item_id, those without any item_id under null; documents with a null doc_id are reported with it;
``drop_leaked`` tells documents by their texts, so all rows of a leaked text go, whatever their doc_id, and no other row does; a very long text is
read by one task and verified only where it has hits; an empty table on either side gives no rows; other columns are kept whatever their names.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from predaudit.functions.lineage import store
from predaudit.llm.names import aside
from predaudit.llm.prefilter import BITS, without
from predaudit.llm.shingles import mix, word_hashes

MASKS = ("111111", "110110011", "1011010011", "1100101011")
SHORT_MASKS = ("11", "111", "1111")
LEAST_WORDS, SPACED = 3, 12  # words of the shortest item, and of the shortest that the spaced masks serve
WINDOW, PERCENT = 13, 80
BUCKETS = 512  # bitmaps of 4 KiB: 2 MiB in all
PROBES = 3

_ODD = np.random.RandomState(9).randint(0, 2**62, 16).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_PUNCTUATION = string.punctuation.encode()


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the words of a text."""
    return word_hashes(text.lower().encode().translate(None, _PUNCTUATION).split()) if text else np.empty(0, np.uint64)


def masks_for(words: int) -> tuple[int, ...]:
    """Numbers of the masks for an item of so many words."""
    if words < LEAST_WORDS:
        return ()
    if words >= SPACED:
        return tuple(range(len(MASKS)))
    replaced = words - -(-words * PERCENT // 100)
    return (len(MASKS) + SHORT_MASKS.index("1" * (words // (replaced + 1))),)


def seeds(words: np.ndarray, masks: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes under masks at all positions, those positions, and the masks."""
    hashes, places, numbers = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for number in masks:
        mask = (*MASKS, *SHORT_MASKS)[number]
        n = len(words) - len(mask) + 1
        if n > 0:
            total = np.full(n, number + 1, np.uint64) * _ODD[15]
            for j in (j for j, bit in enumerate(mask) if bit == "1"):
                total += words[j : j + n] * _ODD[j]
            hashes.append(mix(total))
            places.append(np.arange(n, dtype=np.int64))
            numbers.append(np.full(n, number, np.int64))
    return np.concatenate(hashes), np.concatenate(places), np.concatenate(numbers)


def _probes(hashes: np.ndarray) -> list[np.ndarray]:
    size = np.uint64(BUCKETS * BITS)
    return [(hashes >> np.uint64(13 * k)) % size for k in range(PROBES)]


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items, found = [], [seeds(np.empty(0, np.uint64), ())]
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = tokens(text)
            found.append(seeds(words, masks_for(len(words))))
            items += [item] * len(found[-1][0])
        hashes, places, masks = (np.concatenate(part) for part in zip(*found))
        bits = np.stack(_probes(hashes), 1).astype(np.int64) if len(hashes) else np.empty((0, PROBES), np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(items, pa.binary()), pa.array(hashes.view(np.int64)), pa.array(places), pa.array(masks),
                pa.ListArray.from_arrays(pa.array(np.arange(0, len(hashes) * PROBES + 1, PROBES), pa.int32()), pa.array(bits.reshape(-1))),
            ],
            names=["item", "hash", "item_at", "mask", "bits"],
        )


def _bitmap(seed_rows: DataFrame) -> np.ndarray:
    """Which of the fixed number of bits any seed sets: at most ``BUCKETS`` rows of 4 KiB."""
    bits = seed_rows.select(F.explode("bits").alias("bit"))
    rows = (
        bits.groupBy(F.floor(F.col("bit") / BITS).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.pmod("bit", F.lit(BITS))).alias("bitmap")).collect()
    )
    filled = np.zeros((BUCKETS, BITS // 8), np.uint8)
    for bucket, bitmap in rows:
        filled[bucket] = np.frombuffer(bytes(bitmap), np.uint8)
    return filled.reshape(-1)


def _suspects(shared, masks: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hashes, at, _ = seeds(tokens(text), masks)
                for k in range(PROBES):
                    bit = _probes(hashes)[k]
                    hit = (bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    hashes, at = hashes[hit], at[hit]
                if len(at):
                    rows.append((doc, hashlib.md5(text.encode()).digest(), text, hashes.view(np.int64), at))
            columns = list(zip(*rows)) if rows else [[]] * 5
            types = (pa.int64(), pa.binary(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, types)], names=["doc_id", "key", "text", "hashes", "at"]
            )

    return run


def best_alignment(document: np.ndarray, item: np.ndarray, offsets: list[int]) -> tuple[int, int, int] | None:
    """``(matching words, best matches in a window, offset)`` of the best alignment that counts as a leak."""
    best, width = None, min(WINDOW, len(item))
    for offset in offsets:
        low, high = max(0, -offset), min(len(item), len(document) - offset)
        same = np.zeros(len(item), np.int64)
        same[low:high] = document[low + offset : high + offset] == item[low:high]
        sums = np.concatenate([[0], np.cumsum(same)])
        most = int((sums[width:] - sums[:-width]).max())
        if 100 * most >= PERCENT * width and (best is None or (int(sums[-1]), most, -offset) > (best[0], best[1], -best[2])):
            best = int(sums[-1]), most, offset
    return best


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, last = [], (None, None)
        for key, item, offsets, text, item_text in zip(*[c.to_pylist() for c in batch.columns]):
            if last[0] != key:
                last = key, tokens(text)
            words = tokens(item_text)
            if found := best_alignment(last[1], words, offsets):
                rows.append((key, item, len(words), found[0], found[2]))
        columns = list(zip(*rows)) if rows else [[]] * 5
        types = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(columns, types)], names=["key", "item_id", "item_words", "matching_words", "first_word"]
        )


def _leaked(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with hits ``(doc_id, key, …)`` and the leaks ``(key, item_id, …)`` of their texts; ``key`` is the digest of a text."""
    text = F.col("text").cast("string")
    items = store(
        benchmark.where(F.col("text").isNotNull()).groupBy(text.alias("item_text")).agg(F.min(F.col("item_id").cast("long")).alias("item_id"))
        .select(F.unhex(F.md5("item_text")).alias("item"), "item_id", "item_text"), "leak-items",
    )
    seed_rows = store(
        items.select("item", "item_text").mapInArrow(_item_seeds, "item binary, hash long, item_at long, mask long, bits array<long>"), "leak-seeds"
    )
    masks = tuple(sorted(r["mask"] for r in seed_rows.select("mask").distinct().collect()))  # at most all there are
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(seed_rows))
    suspects = store(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(
            _suspects(shared, masks), "doc_id long, key binary, text string, hashes array<long>, at array<long>"
        ), "leak-suspects",
    )
    one_of_each = store(suspects.select("key", "text", "hashes", "at").dropDuplicates(["key"]), "leak-texts")
    hits = one_of_each.select("key", F.explode(F.arrays_zip("hashes", "at")).alias("hit")).select("key", "hit.hashes", "hit.at")
    aligned = (
        hits.join(seed_rows, hits["hashes"] == seed_rows["hash"])
        .groupBy("key", "item").agg(F.collect_set(F.col("at") - F.col("item_at")).alias("offsets"))
    )  # the offsets of an item in one document: at most as many as the two have words
    found = (
        aligned.join(one_of_each.select("key", "text"), "key").join(items, "item")
        .select("key", "item_id", "offsets", "text", "item_text")
        .mapInArrow(_verified, "key binary, item_id long, item_words long, matching_words long, first_word long")
    )
    return suspects, store(found, "leaks")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, item_words, matching_words, first_word)``: one row per document and item it contains.

    ``first_word`` is where in the document the item's first word would stand (below 0 if the document begins later).
    """
    suspects, found = _leaked(docs, benchmark)
    return (
        suspects.select("doc_id", "key").distinct().join(found, "key")
        .select("doc_id", "item_id", "item_words", "matching_words", "first_word")
    )


def drop_leaked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that contain no benchmark item, with all columns."""
    order = docs.columns
    gone = _leaked(docs, benchmark)[1].select(F.col("key").alias("_text")).distinct()
    docs, back = aside(docs, ("_text",))
    keyed = docs.withColumn("_text", F.coalesce(F.unhex(F.md5(F.col("text").cast("string"))), F.lit(b"")))  # null texts stay
    return without(keyed, "_text", store(gone, "leak-documents")).drop("_text").withColumnsRenamed(back).select(*[F.col(f"`{c}`") for c in order])
