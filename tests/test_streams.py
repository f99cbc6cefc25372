"""Replayed streams give the rows of the batch plan for every closed window."""

import pytest
from pyspark.sql import functions as F

from predaudit.spec import MULTICLASS, AuditSpec
from predaudit.streaming import monitor as M

MANY = AuditSpec("p", "y", timestamp="ts", problem=MULTICLASS)
SCORED = AuditSpec("p", "y", "score", timestamp="ts")


@pytest.fixture(scope="module")
def events(spark):
    at = F.xxhash64("id")
    return spark.range(3000).select(
        "id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 200).alias("ts"), F.pmod(at, F.lit(3)).cast("int").alias("y"),
        F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)).cast("int").alias("p"), (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(997)) / 997).alias("score"),
        F.when(F.col("id") % 7 > 0, F.col("id") % 100 + F.col("id") / 50).alias("v"),
        F.concat(F.lit("t"), F.pmod(F.xxhash64("id", F.lit(3)), F.floor(F.col("id") / 900) + 2)).alias("kind"),
    )


def _replayed(spark, events, build, path):
    """Closed windows of a stream that reads the rows file by file, in order."""
    for part in range(6):  # one file after another, so that none is late
        events.where(F.floor(F.col("id") / 500) == part).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    query = M.write_windows(build(stream), f"{path}/out", f"{path}/checkpoint", once=True)
    query.awaitTermination()
    assert query.exception() is None
    return spark.read.parquet(f"{path}/out")


def _rows(df, *keys):
    return {tuple(r[k] for k in keys): {c: r[c] for c in df.columns if c not in keys and c != "window_end"} for r in df.collect()}


def _agree(streamed, batch, keys, least):
    got, want = _rows(streamed, *keys), _rows(batch, *keys)
    assert len(got) >= least and got.keys() <= want.keys()
    for key, row in got.items():
        assert row == pytest.approx(want[key]), key


def test_multiclass_metrics_on_a_stream(spark, events, tmp_path):
    streamed = _replayed(spark, events, lambda s: M.windowed_metrics(s, MANY, watermark="1 hour"), tmp_path)
    _agree(streamed, M.windowed_metrics(events, MANY), ["window_start"], 4)


def test_score_metrics_on_a_stream(spark, events, tmp_path):
    events = events.withColumn("y", (F.col("y") == 1).cast("int"))
    streamed = _replayed(spark, events, lambda s: M.windowed_scores(s, SCORED, watermark="1 hour"), tmp_path)
    _agree(streamed, M.windowed_scores(events, SCORED), ["window_start"], 4)


def test_scores_against_plain_python(spark, events):
    import math

    events = events.withColumn("y", (F.col("y") == 1).cast("int"))
    rows = events.collect()
    for r in M.windowed_scores(events, SCORED, ranges=997).collect():
        mine = [(x["score"], x["y"]) for x in rows if r["window_start"] <= x["ts"] < r["window_end"]]
        pos, neg = [s for s, y in mine if y], [s for s, y in mine if not y]
        wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
        assert r["n"] == len(mine) and r["positives"] == len(pos) and r["roc_auc"] == pytest.approx(wins / len(pos) / len(neg), abs=2e-3)
        assert r["brier_score"] == pytest.approx(sum((s - y) ** 2 for s, y in mine) / len(mine))
        sure = [(min(max(s, 1e-15), 1 - 1e-15), y) for s, y in mine]
        assert r["log_loss"] == pytest.approx(-sum(math.log(s if y else 1 - s) for s, y in sure) / len(mine))


def test_drift_on_a_stream(spark, events, tmp_path):
    columns, store = ["v", "kind"], "spark.sql.streaming.stateStore.providerClass"
    edges = M.bin_edges(events, columns)
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        streamed = _replayed(spark, events, lambda s: M.windowed_drift(s, "ts", columns, edges, watermark="1 hour"), tmp_path)
    finally:
        spark.conf.set(store, before)
    _agree(streamed, M.windowed_drift(events, "ts", columns, edges), ["window_start", "column"], 6)


def test_drift_between_two_windows_is_that_of_two_halves(spark, events):
    two = events.where("ts < timestamp_seconds(1700000000 + 3 * 86400)").withColumn(
        "ts", F.when(F.col("v") % 2 < 1, F.timestamp_seconds(F.lit(1_700_000_000))).otherwise(F.timestamp_seconds(F.lit(1_700_900_000)))
    )
    late = F.col("ts") > F.timestamp_seconds(F.lit(1_700_500_000))
    edges = M.bin_edges(two.where(~late), ["v", "kind"])
    got = {r["column"]: r["psi"] for r in M.windowed_drift(two, "ts", ["v", "kind"], edges).collect()}
    assert got == pytest.approx({r["column"]: r["psi"] for r in M.population_stability(two, late, ["v", "kind"]).collect()})
