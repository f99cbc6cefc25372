"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio between trusted and raw text.

Two multinomials over ``FEATURES`` hashed words and word pairs are counted: one over all documents (raw), one over trusted ones
(labelled as good). A document's score is the sum over its features of log(trusted / raw), divided by their number; it is kept
if it meets the threshold that best separates labelled documents. One half of the labels, by a hash of doc_id, serves the trusted
counts and the other the threshold, as documents score higher where they were counted themselves. Raw counts and scores use
every document, the threshold every label of its half; the trusted counts use at most ``TRUSTED_DOCUMENTS`` documents, the
first by that hash, which bounds the identifiers sent to all tasks.

A document's tables of words and counts live in one task only for that document; what tasks share is the table of ratios,
``FEATURES`` numbers whatever the corpus.

Defined results: a null or wordless text has no words, fails the base rules and scores 0; labels of one document are combined
(good only if all are); without a label of either kind the threshold is 0 (trusted and raw equally likely); an empty table gives no
rows; columns named like the results are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from predaudit.functions.lineage import store
from predaudit.llm.shingles import mix, word_hashes

FEATURES = 2**16
TRUSTED_DOCUMENTS = 20_000
SMOOTHING = 0.5
SCORE_STEP = 1e-3  # width of the score classes among which the threshold is chosen

_SYMBOL = re.compile(rb"[#*$%&|<>]")
_SECOND = np.uint64(0x9E3779B97F4A7C15)
_SPACE = b" \t\n\x0b\x0c\r"

SCHEMA = T.StructType(
    [
        *[T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        T.StructField("score", T.DoubleType()),
    ]
)


def features(words: np.ndarray) -> np.ndarray:
    """Hashed features of a text's words: each word and each pair of neighbours."""
    pairs = mix(words[:-1] * _SECOND + words[1:])
    return (np.concatenate([words, pairs]) % np.uint64(FEATURES)).astype(np.int64)


def _repeated_words(words: np.ndarray) -> int:
    """Words covered by a window of three words that occurs at least twice."""
    n = len(words) - 2
    if n < 2:
        return 0
    windows = mix(mix(mix(words[:n]) + words[1 : n + 1]) * _SECOND + words[2:])
    order = np.argsort(windows, kind="stable")
    ordered = windows[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n + 2, bool)
    for shift in range(3):
        covered[shift : shift + n] |= twice
    return int(covered.sum())


def _duplicate_lines(text: bytes) -> int:
    lines = Counter(line for line in text.split(b"\n") if line.strip(_SPACE))
    return sum(lines.values()) - len(lines)


def _code_points(data: bytes) -> int:
    """Code points of UTF-8 text: every byte but the continuation bytes."""
    raw = np.frombuffer(data, np.uint8)
    return len(raw) - int(((raw & 0xC0) == 0x80).sum())


def measure(text: bytes | None, ratios: np.ndarray) -> tuple:
    """``(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score)`` of a text."""
    text = text or b""
    words = text.split()
    if not words:
        return 0, 0, len(_SYMBOL.findall(text)), 0, 0, 0.0
    hashed = word_hashes(words)
    found = features(hashed)
    return (
        len(words), _code_points(b"".join(words)), len(_SYMBOL.findall(text)), _duplicate_lines(text),
        _repeated_words(hashed), float(ratios[found].sum() / len(found)),
    )


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(FEATURES, np.int64)
    for batch in batches:
        for text in batch.column(0).cast(pa.binary()).to_pylist():
            if text and (words := text.split()):
                total += np.bincount(features(word_hashes(words)), minlength=FEATURES)
    kept = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(total[kept])], names=["feature", "n"])


def feature_counts(texts: DataFrame) -> np.ndarray:
    """Counts of all features, added up per task before the shuffle; ``FEATURES`` numbers at most reach the driver."""
    rows = (
        texts.select(F.col("text").cast("string").alias("text")).mapInArrow(_counted, "feature long, n long")
        .groupBy("feature").agg(F.sum("n").alias("n")).collect()
    )
    counts = np.zeros(FEATURES)
    for feature, n in rows:
        counts[feature] = n
    return counts


def labelled(labels: DataFrame) -> DataFrame:
    """``(doc_id, good)``, one row per labelled document."""
    return (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.min(F.col("quality").cast("int") == 1).alias("good"))
    )


def _for_counts() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0


def log_ratios(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """log(trusted / raw) of every feature, smoothed by equal pseudo-counts."""
    trusted_ids = (
        labelled(labels).where(F.col("good") & _for_counts()).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRUSTED_DOCUMENTS)
    )
    raw = feature_counts(docs)
    trusted = feature_counts(docs.join(trusted_ids.hint("broadcast"), "doc_id"))  # bounded by TRUSTED_DOCUMENTS
    share = [(x + SMOOTHING) / (x.sum() + SMOOTHING * FEATURES) for x in (trusted, raw)]
    return np.log(share[0] / share[1])


def measured(docs: DataFrame, ratios: np.ndarray) -> Column:
    """Struct of the base counts and the score of ``docs.text``."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)  # FEATURES numbers

    @F.pandas_udf(SCHEMA)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [measure(None if t is None else t.encode(), shared.value) for t in texts]
        return pd.DataFrame(rows, columns=SCHEMA.names)

    return run(F.col("text").cast("string"))


def score_threshold(scores: DataFrame, labels: DataFrame) -> float:
    """The class limit at which most good documents score above and most others below; the lowest of equal ones.

    ``scores`` has doc_id and score. Labelled documents count as totals per score class; each kind has the same weight.
    """
    step = F.floor(F.col("score") / SCORE_STEP)
    totals = (
        scores.join(labelled(labels).where(~_for_counts()), "doc_id").groupBy(step.alias("step"))
        .agg(F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad"))
        .orderBy("step").collect()
    )  # scores lie within the logarithms of the ratios, so the classes are bounded
    good, bad = sum(r["good"] for r in totals), sum(r["bad"] for r in totals)
    if not good or not bad:
        return 0.0
    best, at, good_above, bad_below = -1.0, 0.0, good, 0
    for r in totals:
        if (value := good_above / good + bad_below / bad) > best + 1e-12:
            best, at = value, float(r["step"] * SCORE_STEP)
        good_above, bad_below = good_above - r["good"], bad_below + r["bad"]
    return at


def _kept(q: str, threshold: float) -> tuple[Column, Column]:
    """``base_failed`` and ``kept`` from the fields of the struct (or the columns) ``q``."""
    at = (lambda name: F.col(f"{q}.{name}")) if q else F.col
    failed = (at("n_words") < 50) | (at("n_repeat_words") * 100 > at("n_words") * 50)
    return failed, ~failed & (at("score") >= threshold)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts, score and verdict of every document, without its text."""
    ratios = log_ratios(docs, labels)
    scored = store(docs.select("doc_id", measured(docs, ratios).alias("_q")).select("doc_id", "_q.*"), "quality")
    failed, kept = _kept("", score_threshold(scored.select("doc_id", "score"), labels))
    return scored.withColumns({"base_failed": failed, "kept": kept})


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with all columns. Texts are measured again in place, which spares them a shuffle."""
    ratios = log_ratios(docs, labels)
    measured_docs = docs.withColumn("_q", measured(docs, ratios))
    scores = store(measured_docs.select("doc_id", F.col("_q.score").alias("score")), "quality-scores")
    return measured_docs.where(_kept("_q", score_threshold(scores, labels))[1]).drop("_q")
