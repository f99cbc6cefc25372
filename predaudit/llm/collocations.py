"""Phrase collocations by Toivonen's mining: a sample proposes phrases, full passes count them and their negative border exactly.

1. Single words are counted over all documents. A sample of documents, chosen by the hash of their identifiers, is mined level by level for phrases of frequent
   words, with a lowered threshold. What is frequent there is proposed. Only this guess depends on the sample, no result.
2. A full pass over all documents counts every phrase whose shorter phrases (without its last and without its first word) are both
   proposed: the proposed phrases and their negative border. All pairs of frequent words belong to it.
3. Phrases of the border that turn out frequent are failures of the sample. A frequent phrase that was not counted has a smallest part that was not
   proposed; that part was in the border, so it is a failure. A further pass therefore counts all phrases that hold a failure and consist of frequent
   words, to full length, and nothing is left open. It also writes out the words of the phrases counted before.

A phrase is known by 96 bits of hash while it is counted. Proposed phrases and failures reach the tasks as bitmaps of bounded size
(``bitmap``): a phrase they let through by chance is counted in vain, and none is lost. Counts are combined in each task over some million
words before they are shuffled, so a phrase that every document shares costs one row per such stretch.

A frequent phrase is scored by its weakest cut: ``floor(scale * a / (l + r))``. It is dropped if a longer frequent phrase holds it and has at
least ``absorbed`` hundredths of its occurrences.

Defined results: a null text is empty; a null lang is ``und``; repeated rows count each time; pieces end at ``. , ; : ! ?`` and line breaks; ties are ranked by
the phrase in byte order; an empty table gives no rows; other columns are ignored; a very long text is counted in stretches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh3_64_intdigest, xxh64_intdigest

from predaudit.functions.lineage import store
from predaudit.llm.shingles import mix

LONGEST = 4
STRETCH = 24_000_000  # bytes of text whose phrases are counted together in a task
BUFFER = 1_000_000  # bytes that are cut into words together, but for longer pieces
SHARE = 8  # one of so many documents is in the sample
LARGEST_BITMAP = 2**28  # bits: 32 MiB
_MAP = 32_768  # bits of one of Spark's bitmaps
NAMES = 1_000_000  # phrases whose names a task remembers to have given

_WORD, _SPACE, _END = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _SPACE
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = _END
_ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)


def _random(seed: int, n: int) -> np.ndarray:
    return np.random.RandomState(seed).randint(0, 2**62, n).astype(np.uint64) * np.uint64(2) + np.uint64(1)


_ODD = _random(29, 2 * LONGEST + 2)
_BYTES = [_random(31 + part, 256) for part in (0, 1)]  # random numbers of the bytes, A-Z like a-z
for _table in _BYTES:
    _table[0x41:0x5B] = _table[0x61:0x7B]
_BASES = [int(x) for x in _random(37, 2)]


def _powers(size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of both bases and of their inverses modulo 2^64."""

    def of(base: int) -> np.ndarray:
        factors = np.full(size, base, np.uint64)
        factors[0] = 1
        return np.cumprod(factors, dtype=np.uint64)

    return [(of(base), of(pow(base, -1, 2**64))) for base in _BASES]


class Words:
    """Words of a stretch of texts as two 64-bit hashes each, how many words follow to the end of their piece, and where they stand.

    The hash of a word is the sum of random numbers of its bytes, each times a power of an odd base that tells places apart; it comes from running sums over
    the whole buffer. For two different words both halves agree with a probability of about 2^-120.
    """

    def __init__(self, texts: list[tuple[bytes, bytes]], powers: list[tuple[np.ndarray, np.ndarray]]) -> None:
        parts, langs, at, size = [], [], [], 0
        for lang, text in texts:
            parts.append(text)
            langs.append(lang)
            at.append(size)
            size += len(text) + 1
        self.buffer = b"\n".join([*parts, b""])
        raw = np.frombuffer(self.buffer, np.uint8)
        kind = _KIND[raw]
        edge = np.diff((kind == _WORD).view(np.int8), prepend=0, append=0)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        piece = np.cumsum(kind == _END)[self.start]
        last = np.flatnonzero(np.diff(piece, append=-1))  # last word of each piece
        n = len(self.start)
        self.left = np.repeat(last, np.diff(last, prepend=-1)) - np.arange(n) + 1
        known = list(dict.fromkeys(langs))
        number = {lang: i for i, lang in enumerate(known)}
        of_text = np.array([number[lang] for lang in langs], np.int64)
        self.langs, self.lang = known, of_text[np.searchsorted(at, self.start, side="right") - 1]
        self.hash, self._of_lang = [], []
        if len(raw) > len(powers[0][0]):  # a long piece
            powers = _powers(len(raw))
        for table, (power, inverse), name in zip(_BYTES, powers, (xxh3_64_intdigest, xxh64_intdigest)):
            sums = np.cumsum(table[raw] * power[: len(raw)], dtype=np.uint64)
            total = sums[self.end - 1] - np.where(self.start > 0, sums[self.start - 1], np.uint64(0))
            self.hash.append(mix(total * inverse[self.start]))
            self._of_lang.append(np.array([name(lang) for lang in known], np.uint64)[self.lang])

    def text(self, i: int, size: int) -> str:
        """The phrase of ``size`` words at place ``i``."""
        return b" ".join(self.buffer[self.start[j] : self.end[j]] for j in range(i, i + size)).lower().decode()

    def keys(self, size: int, part: int) -> np.ndarray:
        """The key (``part`` 0, 64 bits) or its check (1, 32 bits) of all phrases of ``size`` words, also of those that cross the end of a piece."""
        n = len(self.whole(size))
        total = self._of_lang[part][:n] * _ODD[LONGEST] + np.uint64(size)
        for j in range(size):
            total += self.hash[part][j : j + n] * _ODD[j]
        return mix(total) >> np.uint64(32 * part)

    def whole(self, size: int) -> np.ndarray:
        """Whether a phrase of ``size`` words at each place stays within its piece."""
        return self.left[: max(0, len(self.start) - max(size, 1) + 1)] >= size


def _member(bits: np.ndarray | None, keys: np.ndarray) -> np.ndarray:
    if bits is None:
        return np.zeros(len(keys), bool)
    found = np.ones(len(keys), bool)
    for turn in (0, 31):
        bit = (keys >> np.uint64(turn)) & np.uint64(len(bits) * 8 - 1)
        found &= ((bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
    return found


def _counted(words: Words, size: int, bits: np.ndarray | None) -> np.ndarray:
    """Places of phrases of ``size`` words that are counted if the phrases in ``bits`` are proposed."""
    whole = words.whole(size)
    if size < 2:
        return whole
    shorter = _member(bits, words.keys(size - 1, 0))
    return whole & shorter[:-1] & shorter[1:]


def _cut(text: bytes) -> Iterator[bytes]:
    """A text in parts of about ``BUFFER`` bytes that end where pieces do."""
    ends = text.translate(_ENDS) if len(text) > BUFFER else text
    at = 0
    while len(text) - at > BUFFER:
        end = ends.rfind(b"\n", at, at + BUFFER)
        end = end if end > at else ends.find(b"\n", at + BUFFER)
        if end < 0:
            break
        yield text[at:end]
        at = end + 1
    yield text[at:]


def _buffers(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    held, n, powers = [], 0, _powers(2 * BUFFER)
    for batch in batches:
        for lang, text in zip(*[c.cast(pa.binary()).to_pylist() for c in batch.columns]):
            for part in _cut(text):
                held.append((lang, part))
                n += len(part) + 1
                if n >= BUFFER:
                    yield Words(held, powers)
                    held, n = [], 0
    if held:
        yield Words(held, powers)


def _summed(size: int, keys: list[np.ndarray], checks: list[np.ndarray]) -> pa.RecordBatch:
    key, check = np.concatenate(keys), np.concatenate(checks)
    order = np.argsort(key)
    key, check = key[order], check[order]
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (check[1:] != check[:-1])]))
    times = np.diff(np.append(first, len(key)))
    columns = [np.full(len(first), size, np.int32), key[first].view(np.int64), check[first].view(np.int64), times.astype(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["size", "key", "check", "a"])


def _counts(sizes: tuple[int, ...], proposed):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = proposed and proposed.value
        held: dict[int, tuple[list, list]] = {size: ([], []) for size in sizes}
        n = 0
        for words in _buffers(batches):
            for size in sizes:
                at = np.flatnonzero(_counted(words, size, bits))
                if len(at):
                    for part in (0, 1):
                        held[size][part].append(words.keys(size, part)[at])
            n += len(words.buffer)
            if n >= STRETCH:
                for size, (keys, checks) in held.items():
                    if keys:
                        yield _summed(size, keys, checks)
                    keys.clear()
                    checks.clear()
                n = 0
        for size, (keys, checks) in held.items():
            if keys:
                yield _summed(size, keys, checks)

    return run


def phrase_counts(texts: DataFrame, sizes: tuple[int, ...], least: int, proposed=None) -> DataFrame:
    """``(size, key, check, a)`` of the phrases with at least ``least`` occurrences among those that ``proposed`` lets be counted.

    The phrase of size 0 stands for its language and occurs at every word.
    """
    rows = texts.select("lang", "text").mapInArrow(_counts(sizes, proposed), "size int, key long, check long, a long")
    return rows.repartition("key").groupBy("size", "key", "check").agg(F.sum("a").alias("a")).where(F.col("a") >= least)  # the tasks have combined already


def bitmap(phrases: DataFrame):
    """A broadcast bitmap of the keys of ``phrases``: 16 bits for each, but at most ``LARGEST_BITMAP``. The driver joins its parts of 4 KiB."""
    n = phrases.count()
    bits = min(LARGEST_BITMAP, max(_MAP, 1 << (16 * n).bit_length()))
    at = F.explode(F.array(*[F.shiftrightunsigned("key", turn).bitwiseAND(F.lit(bits - 1)) for turn in (0, 31)]))
    made = phrases.select(at.alias("bit")).groupBy(F.floor(F.col("bit") / _MAP).alias("part")).agg(
        F.bitmap_construct_agg(F.pmod("bit", F.lit(_MAP))).alias("bits")
    )
    whole = np.zeros((bits // _MAP, _MAP // 8), np.uint8)
    for part, held in made.toLocalIterator():
        whole[part] = np.frombuffer(bytes(held), np.uint8)
    return phrases.sparkSession.sparkContext.broadcast(whole.reshape(-1))


def sampled(texts: DataFrame, share: int) -> DataFrame:
    return texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0) if share > 1 else texts


def proposals(sample: DataFrame, words: DataFrame, lowered: int) -> DataFrame:
    """``(size, key, check)`` of phrases that occur ``lowered`` times in the sample, as do the shorter ones they are made of; ``words`` are the frequent words."""
    found, known = None, words
    for size in range(2, LONGEST + 1):
        bits = bitmap(known)
        longer = store(phrase_counts(sample, (size,), lowered, bits).select("size", "key", "check"), f"tm-proposed-{size}")
        found = longer if found is None else found.unionByName(longer)
        known = words.unionByName(found)
        bits.unpersist()
    return found


def _holds(found: dict[int, np.ndarray], size: int, n: int) -> np.ndarray:
    """Whether the phrase of ``size`` words at each of ``n`` places holds one of the shorter phrases marked in ``found``."""
    held = np.zeros(n, bool)
    for shorter in range(1, size):
        for j in range(size - shorter + 1):
            held |= found[shorter][j : j + n]
    return held


def _second(wanted, failures, frequent_words, proposed):
    """Names of the phrases in ``wanted`` (with ``a`` 0), and counts of the phrases that hold a failure and were not counted before."""

    def rows(words: Words, size: int, at: np.ndarray, keys: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(at), size, np.int32)), pa.array(keys.view(np.int64)), pa.array(words.keys(size, 1)[at].view(np.int64)),
                pa.array([words.langs[words.lang[i]].decode() for i in at], pa.string()),
                pa.array([words.text(i, size) for i in at], pa.string()), pa.array(times),
            ],
            names=["size", "key", "check", "lang", "phrase", "a"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for words in _buffers(batches):
            failed = {}
            for size in range(LONGEST + 1):
                keys, whole = words.keys(size, 0), words.whole(size)
                at = np.flatnonzero(whole & _member(wanted.value, keys))
                found, first = np.unique(keys[at], return_index=True)
                new = np.array([k not in seen for k in found.tolist()], bool)
                if new.any():
                    if len(seen) > NAMES:
                        seen.clear()
                    seen.update(found[new].tolist())
                    yield rows(words, size, at[first[new]], found[new], np.zeros(int(new.sum()), np.int64))
                if failures is None or not size:
                    continue
                if size > 1:
                    there = whole & _holds(failed, size, len(keys)) & ~_counted(words, size, proposed.value)
                    for j in range(size):
                        there &= usual[j : j + len(keys)]
                    at = np.flatnonzero(there)
                    if len(at):
                        both = np.stack([keys[at], words.keys(size, 1)[at]], 1)
                        _, first, times = np.unique(both, axis=0, return_index=True, return_counts=True)
                        yield rows(words, size, at[first], keys[at[first]], times.astype(np.int64))
                else:
                    usual = _member(frequent_words.value, keys)
                failed[size] = whole & _member(failures.value, keys)

    return run


def frequent(texts: DataFrame, least: int, share: int = SHARE) -> DataFrame:
    """``(lang, phrase, size, a)`` of all phrases of 1 to ``LONGEST`` words with at least ``least`` occurrences, counted exactly; ``size`` 0: all words."""
    key, schema = ["size", "key", "check"], "size int, key long, check long, lang string, phrase string, a long"
    words = store(phrase_counts(texts, (0, 1), least), "tm-words")
    single = words.where("size = 1").select(key)
    longer = proposals(sampled(texts, share), single, max(2, least // (2 * share)) if share > 1 else least)
    proposed = bitmap(single.unionByName(longer))
    counted = store(phrase_counts(texts, tuple(range(2, LONGEST + 1)), least, proposed), "tm-counted").unionByName(words)
    # what the sample holds is named from there, so the other documents are asked for the names of the rest only
    there = single.join(phrase_counts(sampled(texts, share), (1,), 1).select(key), key, "left_semi").unionByName(longer)
    there = store(there, "tm-there")
    border = store(counted.join(there, key, "left_anti").select(key), "tm-border")
    failures = border.where(F.col("size").between(2, LONGEST - 1))
    failed = None if failures.isEmpty() else bitmap(failures)
    second = texts.select("lang", "text").mapInArrow(_second(bitmap(border), failed, bitmap(single), proposed), schema).unionByName(
        sampled(texts, share).select("lang", "text").mapInArrow(_second(bitmap(counted.join(there, key, "left_semi")), None, None, None), schema)
    )
    rows = store(second, "tm-second")
    names = rows.where("a = 0").select("size", "key", "check", "lang", "phrase").dropDuplicates(key)
    first = names.join(counted, key).select("lang", "phrase", "size", "a")
    further = rows.where("a > 0").groupBy("lang", "phrase", "size").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    return first.unionByName(further.select("lang", "phrase", "size", "a"))


def _exact(column: Column) -> Column:
    return column.cast("decimal(38,0)")


def scored(phrases: DataFrame, scale: int = 2_000_000) -> DataFrame:
    """``(lang, phrase, size, a, l, r, score)`` of the phrases of two and more words, at their weakest cut (of equal ones the first)."""
    word = F.split("phrase", " ")
    cuts = phrases.where("size > 1").select(
        "lang", "phrase", "size", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), word.alias("words")
    ).select(
        "lang", "phrase", "size", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("head"),
        F.array_join(F.slice("words", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("tail"),
    )
    side = phrases.select("lang", "phrase", "a")
    both = cuts.join(side.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l")), ["lang", "head"]).join(
        side.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r")), ["lang", "tail"]
    )
    scores = both.withColumns({"top": _exact(F.col("a")) * scale, "below": _exact(F.col("l")) + _exact(F.col("r"))}).withColumn("score", F.expr("top div below"))
    weakest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    return scores.groupBy("lang", "phrase", "size", "a").agg(weakest).select(
        "lang", "phrase", "size", "a", "cut.l", "cut.r", F.col("cut.score").alias("score")
    )


def absorbed(phrases: DataFrame, percent: int) -> DataFrame:
    """``(lang, phrase)`` of phrases that a longer one holds with at least ``percent`` hundredths of their occurrences."""
    words = F.split("phrase", " ")
    inner = (
        phrases.where("size > 2").select("lang", "size", F.col("a").alias("longer"), words.alias("words"))
        .withColumn("length", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
        .withColumn("at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("length") + 1)))
        .select("lang", F.array_join(F.slice("words", F.col("at"), F.col("length")), " ").alias("phrase"), "longer")
        .groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    )
    return inner.join(phrases, ["lang", "phrase"]).where(_exact(F.col("longer")) * 100 >= _exact(F.col("a")) * percent).select("lang", "phrase")


def collocations(docs: DataFrame, least: int = 30, percent: int = 80, top: int = 2000, share: int = SHARE) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``top`` phrases of two to four words of each language, counted over all documents."""
    texts = docs.select(
        "doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    phrases = store(frequent(texts, least, share), "tm-phrases")
    kept = scored(phrases).join(absorbed(phrases, percent), ["lang", "phrase"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    totals = phrases.where("size = 0").select("lang", F.col("a").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
