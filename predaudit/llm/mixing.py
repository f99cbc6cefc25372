"""Temperature mixing of sources, realised as budgeted block permutations. DataFrame functions only.

1. A source's share of all tokens (words), to the power of an exponent and normalised, is its weight. 1 keeps the shares, 0 makes
   all equal. The exponent is the largest, in millionths, for which the entropy of the weights reaches ``entropy`` times its
   maximum, unless a source would be repeated more than ``repeats`` times; then the smallest that respects this limit. Both are
   monotone, so both are found by bisection, ``SECTIONS`` points at a time: one aggregation of the table of sources each.
2. A source's weight times the budget is what it may spend. It is read in passes; each deals its documents, by a hash of pass
   and doc_id, to blocks of about ``BLOCK_ROWS`` and orders a block by that hash. Totals per block show which blocks fit, and only
   within blocks are tokens summed row by row, so no source, however large, is sorted as a whole.
3. A row is taken while the tokens up to its end are within the budget of its source; documents longer than the whole budget of their source are left
   out and do not count, so what a source leaves unspent is less than one of its other documents. ``position`` is where a row begins in its
   source's budget; ordered by it, every stretch of the mixture has the weights of the whole.

Defined results: a null source is the source ''; null or wordless texts have no tokens; a source without tokens has no weight and gives no
rows; rows that share source and doc_id are dealt alike, ties ordered by tokens; a document longer than its source's budget is left out; an empty table gives no
rows; columns named like the results are replaced, all others kept whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from predaudit.functions.lineage import store
from predaudit.llm.names import aside

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_ROWS = 4096
MILLION = 1_000_000
SECTIONS = 100
INSIDE = ("_source", "_size", "_rows", "_budget", "_blocks", "_from", "_key", "_s", "_e", "_b", "_tokens", "_limit", "_before")


@dataclass(frozen=True)
class Mixture:
    """Exponent in millionths and the table ``(_source, _size, _rows, _budget, _blocks)`` of the sources."""

    exponent: int
    sources: DataFrame


def _source() -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit(""))


def with_tokens(docs: DataFrame) -> DataFrame:
    counted = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD))
    return docs.withColumn("n_tokens", counted.cast("long"))


def _section(sources: DataFrame, exponents: list[int], total: int, budget: int) -> dict[int, tuple[float, float]]:
    """Entropy and largest number of repeats under each exponent."""
    share, power = F.col("_size") / F.lit(float(total)), F.col("k") / F.lit(float(MILLION))
    raised = sources.withColumn("k", F.explode(F.array(*[F.lit(k) for k in exponents]))).select(
        "k", F.pow(share, power).alias("w"), F.log(share).alias("l"), (F.pow(share, power) / F.col("_size")).alias("r")
    )
    sums = raised.groupBy("k").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.col("l")).alias("s"), F.max("r").alias("r"))
    return {
        row["k"]: (row["h"], row["repeats"])
        for row in sums.select(
            "k", (F.log("z") - F.col("k") / F.lit(float(MILLION)) * F.col("s") / F.col("z")).alias("h"),
            (F.col("r") / F.col("z") * budget).alias("repeats"),
        ).collect()  # SECTIONS rows
    }


def _exponent(sources: DataFrame, total: int, budget: int, entropy: float, repeats: float) -> int:
    """Largest exponent with enough entropy, raised as far as the limit of repeats asks."""
    target = sources.agg(F.log(F.count(F.lit(1)).cast("double"))).first()[0] * entropy
    spread, limit = [0, MILLION], [0, MILLION]  # wanted: last with enough entropy, first within the limit
    known: dict[int, tuple[float, float]] = {}
    while spread[0] < spread[1] or limit[0] < limit[1]:
        asked = set()
        for low, high in (spread, limit):
            if low < high:
                step = max(1, (high - low) // SECTIONS)
                asked |= {*range(low, high, step), high}
        known |= _section(sources, sorted(asked - known.keys()), total, budget)
        enough = [k for k in known if spread[0] <= k <= spread[1] and known[k][0] >= target]
        spread[0] = max(enough, default=0)
        spread[1] = min([k - 1 for k in known if k > spread[0] and known[k][0] < target], default=MILLION)
        within = [k for k in known if limit[0] <= k <= limit[1] and known[k][1] <= repeats]
        limit[1] = min(within, default=MILLION)
        limit[0] = max([k + 1 for k in known if k < limit[1] and known[k][1] > repeats], default=0)
        spread[1], limit[0] = max(spread), min(limit)
    return max(spread[0], limit[0])


def fit(docs: DataFrame, entropy: float = 0.95, repeats: float = 4.0, budget_share: float = 1.0) -> Mixture | None:
    """Weights of the sources for a budget of ``budget_share`` times all tokens; None without tokens."""
    sources = store(
        with_tokens(docs).groupBy(_source().alias("_source"))
        .agg(F.sum("n_tokens").alias("_size"), F.count(F.lit(1)).alias("_rows")).where("_size > 0"), "mix-sources",
    )
    total = sources.agg(F.sum("_size")).first()[0]
    if not total:
        return None
    budget = int(total * budget_share)
    exponent = _exponent(sources, total, budget, entropy, repeats)
    raised = F.pow(F.col("_size") / F.lit(float(total)), F.lit(exponent / MILLION))
    z = sources.agg(F.sum(raised)).first()[0]
    spent = F.floor(raised / F.lit(z) * F.lit(float(budget)) + 0.5)
    return Mixture(
        exponent,
        store(
            sources.withColumn("_budget", spent.cast("long"))
            .withColumn("_blocks", F.ceil(F.col("_rows") / BLOCK_ROWS).cast("long")), "mix-budgets",
        ),
    )


def mix(docs: DataFrame, mixture: Mixture | None) -> DataFrame:
    """The rows of the mixture: all columns, ``n_tokens``, ``epoch``, ``block``, ``start_token`` and ``position``.

    A document of a source that is repeated has one row per pass.
    """
    docs, back = aside(docs, INSIDE)
    if mixture is None:
        empty = {"epoch": F.lit(0).cast("long"), "block": F.lit(0).cast("long"), "start_token": F.lit(0).cast("long"), "position": F.lit(0.0)}
        return with_tokens(docs).where(F.lit(False)).withColumns(empty).withColumnsRenamed(back)
    sources = mixture.sources
    passes = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_budget") / F.col("_size")) - 1)
    key = F.conv(F.substring(F.md5(F.concat_ws(":", "epoch", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 15), 16, 10)
    dealt = (
        with_tokens(docs).withColumn("_from", _source()).join(sources, F.col("_from") == F.col("_source"))
        .where("n_tokens <= _budget and _budget > 0").withColumn("epoch", F.explode(passes))
        .withColumn("_key", key.cast("long")).withColumn("block", F.col("_key") % F.col("_blocks"))
    )
    before = Window.partitionBy("_s").orderBy("_e", "_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        dealt.groupBy(F.col("_source").alias("_s"), F.col("epoch").alias("_e"), F.col("block").alias("_b"))
        .agg(F.sum("n_tokens").alias("_tokens"), F.first("_budget").alias("_limit"))
        .withColumn("_before", F.coalesce(F.sum("_tokens").over(before), F.lit(0)))
        .where(F.col("_before") <= F.col("_limit")).select("_s", "_e", "_b", "_before")
    )
    same = (F.col("_source") == F.col("_s")) & (F.col("epoch") == F.col("_e")) & (F.col("block") == F.col("_b"))
    within = (
        Window.partitionBy("_source", "epoch", "block").orderBy("_key", "doc_id", "n_tokens")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = (
        dealt.join(blocks, same)
        .withColumn("start_token", F.col("_before") + F.sum("n_tokens").over(within) - F.col("n_tokens"))
        .where(F.col("start_token") + F.col("n_tokens") <= F.col("_budget"))
        .withColumn("position", F.col("start_token") / F.col("_budget"))
    )
    added = ["n_tokens", "epoch", "block", "start_token", "position"]
    return placed.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in added], *added).withColumnsRenamed(back)


def mix_sources(docs: DataFrame, entropy: float = 0.95, repeats: float = 4.0, budget_share: float = 1.0) -> DataFrame:
    """Fit and realise in one call."""
    return mix(docs, fit(docs, entropy, repeats, budget_share))
