"""Audits that find out the problem, rest on other importances and survive failing analyses; JSON arrays; one call from path to report."""

import json
import random

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from predaudit.catalog import queries as Q
from predaudit.operators import explain
from predaudit.plans import report as P
from predaudit.plans.run import audit_path
from predaudit.sources import json_array, load, sinks
from predaudit.spec import AUTO, REGRESSION, AuditSpec

from conftest import metrics


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.range(400).select(
        "id", (F.col("id") % 2).alias("k"), (F.col("id") % 13).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"),
        (3.0 * (F.col("id") % 13) + (F.col("id") % 7) * 0.1).alias("y"), (3.0 * (F.col("id") % 13) + F.col("id") / 1000).alias("p"),
    )


SPEC = AuditSpec("p", "y", identifier="id", features=("a", "b"), problem=AUTO)


def test_the_problem_is_found_out(numbers):
    audit = P.audit(numbers, SPEC, analyses=["performance"])
    assert audit.spec.problem == REGRESSION and metrics(audit.metrics)[None, "r2_score"] > 0.99
    assert [tuple(r) for r in audit.status.collect()] == [("performance", "done", None)]


def test_a_failing_analysis_costs_only_its_rows(numbers, monkeypatch):
    monkeypatch.setitem(P.OPERATORS, "quality", lambda df, spec, by: df.select(F.col("not there")))
    strange = numbers.withColumn("a", F.raise_error(F.lit("broken value")).cast("double"))
    audit = P.audit(strange, SPEC.with_(problem=REGRESSION, protected=("none",)))
    status = {r["analysis"]: (r["status"], r["reason"]) for r in audit.status.collect()}
    assert {k: v[0] for k, v in status.items()} == {"performance": "done", "bias": "skipped", "quality": "failed", "explainability": "failed"}
    assert "broken value" in status["explainability"][1] and status["bias"][1] == "no protected attribute"
    assert {r["analysis"] for r in audit.metrics.select("analysis").distinct().collect()} == {"performance"}
    assert audit.scores.first()["overall_score"] > 0.99 and audit.report.count() == 1


def test_nothing_runs_before_a_table_is_asked_for(numbers, monkeypatch):
    monkeypatch.setitem(P.OPERATORS, "performance", lambda *_: pytest.fail("computed"))
    P.audit(numbers, SPEC.with_(problem=REGRESSION))


def test_importance_of_permutations_and_of_a_surrogate(numbers):
    def predict(rows):
        return rows.withColumn("prediction", 3.0 * F.col("a"))

    for by in ([], ["k"]):
        for choice in ({"predict": predict}, {"importance": "surrogate"}):
            audit = P.audit(numbers, SPEC, by, analyses=["explainability"], **choice)
            rows = audit.metrics.where("metric = 'feature_importance'").collect()
            found = {(r["k"] if by else 0, r["attribute"]): r["value"] for r in rows}
            assert len(found) == 2 * (2 if by else 1) and all(found[k, "a"] > 10 * abs(found[k, "b"]) for k, _ in found)


def test_permutation_by_key_and_without_identifiers(spark, numbers):
    gone = numbers.withColumn("id", F.lit(None).cast("long"))
    rows = explain.permutation_importance(gone, ["a", "b"], "y", "id", lambda r: r.withColumn("prediction", 3.0 * F.col("a")), REGRESSION, bucket_rows=50, by=["k"])
    found = {(r["k"], r["feature"]): r["importance"] for r in rows.collect()}
    assert len(found) == 4 and found[0, "a"] > 1 and found[1, "a"] > 1 and found[0, "b"] == pytest.approx(0)


def test_one_call_from_path_to_report(spark, tmp_path):
    rng = random.Random(1)
    rows = [{"record_id": i, "prediction": float(i % 2), "true_label": i % 3 % 2, "gender": rng.choice("fm"), "income": rng.random()} for i in range(300)]
    (tmp_path / "scored.json").write_text(json.dumps(rows))
    audit = audit_path(spark, str(tmp_path / "scored.json"), out=str(tmp_path / "report"))
    assert audit.spec.problem == "binary" and audit.spec.protected == ("gender",) and audit.spec.identifier == "record_id"
    assert {r["status"] for r in audit.status.collect()} == {"done"}
    assert spark.read.json(str(tmp_path / "report")).first()["sample_size"] == 300


def _value(rng, depth=0):
    kind = rng.randrange(8 if depth < 3 else 5)
    if kind < 2:
        return [rng.random(), None][kind]
    if kind < 5:
        return "".join(rng.choice('ab{}[],:"\\\n é') for _ in range(rng.randrange(9)))
    return {"s": _value(rng, depth + 1)} if kind == 5 else [str(_value(rng, 3)) for _ in range(rng.randrange(4))]


def test_json_arrays_cut_anywhere(spark, tmp_path):
    rng = random.Random(5)
    rows = [{"id": i, "text": "".join(rng.choice('ab{}[],:"\\\n é') for _ in range(rng.randrange(60))), "deep": {"list": [{"x": i}, {"x": 1}]}} for i in range(3000)]
    for name, indent in (("flat", None), ("pretty", 2)):
        (tmp_path / f"{name}.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=False))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for name in ("flat", "pretty"):
            elements = json_array.array_elements(spark, str(tmp_path / f"{name}.json"))
            assert sorted((json.loads(r["text"]) for r in elements.collect()), key=lambda r: r["id"]) == rows
            assert spark.read.text(str(tmp_path / f"{name}.json"), lineSep="}").rdd.getNumPartitions() > 10
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_large_arrays_read_like_small_ones(spark, tmp_path, monkeypatch):
    rows = [{"a": i, "b": f"x}}{i}"} for i in range(50)]
    (tmp_path / "rows.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "one.json").write_text('{"a": 1, "b": [1, 2]}')
    (tmp_path / "none.json").write_text("[]")
    small = load.load(spark, str(tmp_path / "rows.json"))
    monkeypatch.setattr(load, "LARGE_JSON", 0)
    large = load.load(spark, str(tmp_path / "rows.json"))
    assert large.schema == small.schema and sorted(large.collect()) == sorted(small.collect()) and small.count() == 50
    assert load.load(spark, str(tmp_path / "one.json")).count() == 1
    assert load.load(spark, str(tmp_path / "none.json"), schema="a int").count() == 0


def test_block_states_of_random_documents():
    rng = random.Random(3)
    for _ in range(100):
        data = [_value(rng) if rng.random() < 0.3 else {"v": _value(rng), "w}": _value(rng)} for _ in range(rng.randrange(10))]
        text = json.dumps(data, indent=rng.choice([None, 2]), ensure_ascii=False)
        scan, commas = json_array.Scan(), 0
        for chunk in text.split("}"):
            commas += sum(token == "," and depth == 1 for _, token, depth in scan.tokens(chunk + "}"))
            if scan.depth < 0:
                break
        assert commas == max(0, len(data) - 1)


def _broken(df, spec, by):
    return df.select(F.raise_error(F.lit("broken value")).alias("analysis"))


def test_a_report_names_failed_analyses_and_gives_no_score(spark, numbers, monkeypatch, tmp_path):
    monkeypatch.setitem(P.OPERATORS, "quality", _broken)
    audit = P.audit(numbers, SPEC.with_(problem=REGRESSION), ["k"])
    assert audit.report.count() == 2
    for row in audit.report.collect():
        status = {r["analysis"]: (r["status"], r["reason"]) for r in row["analyses"]}
        assert {a: s for a, (s, _) in status.items()} == {"performance": "done", "bias": "skipped", "quality": "failed", "explainability": "done"}
        assert "broken value" in status["quality"][1] and status["bias"][1] == "no protected attribute" and status["performance"][1] is None
        assert row["overall_score"] is None and row["quality_metrics"] is None and row["quality_insights"] is None and row["quality_recommendations"] is None
        assert row["performance_metrics"]["r2_score"] > 0.99 and row["bias_metrics"] == {} and row["key_insights"]
        assert not [text for text in row["key_insights"] if "overall" in text or "some areas" in text or "significant issues" in text]
    document = json.loads(sinks.report_json(audit.report, ["k"]).first()["report"])
    assert "quality_metrics" not in document and {"analysis": "quality", "status": "failed"}.items() <= document["analyses"][2].items()
    flat = sinks.flat_row(audit).first()
    assert "broken value" in flat["failed_analyses"] and flat["overall_score"] is None
    with pytest.raises(RuntimeError, match="quality: .*broken value"):
        audit.whole()


def test_a_whole_report_has_its_score(numbers):
    audit = P.audit(numbers, SPEC.with_(problem=REGRESSION)).whole()
    row = audit.report.first()
    assert row["overall_score"] > 0.9 and [r["status"] for r in row["analyses"]] == ["done", "skipped", "done", "done"] and row["quality_metrics"]
    assert "failed_analyses" not in sinks.flat_row(audit).columns
    read = P.audit_metrics(numbers, audit.metrics.where("analysis != 'quality'"), audit.spec).report.first()
    assert [(r["status"], r["reason"]) for r in read["analyses"]][2] == ("skipped", "no metrics given")


def test_a_job_that_dies_is_no_result(spark, numbers, monkeypatch, tmp_path):
    numbers.write.parquet(str(tmp_path / "rows"))
    gone = spark.read.parquet(str(tmp_path / "rows"))
    for part in (tmp_path / "rows").glob("part-*"):
        part.write_bytes(b"cut")
    monkeypatch.setitem(P.OPERATORS, "quality", lambda df, spec, by: gone.select(F.lit("quality").alias("analysis"), "id"))
    with pytest.raises(Py4JJavaError):
        P.audit(numbers, SPEC.with_(problem=REGRESSION)).report


def test_registered_audits_do_not_pass_over_failures(spark, numbers, monkeypatch):
    rows = numbers.selectExpr("id o_orderkey", "cast(id % 2 as int) prediction", "cast(id % 3 % 2 as int) true_label", "a / 13 score", "'x' c_mktsegment", "'y' o_orderpriority", "'z' r_name")
    monkeypatch.setattr(Q, "view", lambda *_: rows)
    assert {r["status"] for r in json.loads(Q.audit_report(spark, "").first()["report"])["analyses"]} == {"done"}
    monkeypatch.setitem(P.OPERATORS, "quality", _broken)
    for name in ("audit_report", "overall_score"):
        with pytest.raises(RuntimeError, match="quality"):
            Q.QUERIES[name](spark, "")


def test_errors_of_python_workers_are_named(numbers, monkeypatch):
    def broken(batches):
        raise ModuleNotFoundError("No module named 'absent'")
        yield

    monkeypatch.setitem(P.OPERATORS, "quality", lambda df, spec, by: df.select("id").mapInArrow(broken, "id long"))
    with pytest.raises(RuntimeError, match="^failed analyses: quality: ModuleNotFoundError: No module named 'absent'$"):
        P.audit(numbers, SPEC.with_(problem=REGRESSION), analyses=["quality"]).whole()
