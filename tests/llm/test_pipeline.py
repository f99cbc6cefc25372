"""The pipeline: every stage's decisions take effect, columns stay, clean documents are kept; guards on the package."""

import random
import re
from pathlib import Path

import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from predaudit.functions.lineage import store
from predaudit.llm import registry

ROOT = Path(__file__).resolve().parents[2]
SMALL = "/root/testdata/sf0.001"
NATIVE = ("mixing.py", "secrets.py", "sharding.py", "prefilter.py", "components.py")


@pytest.mark.skipif(not Path(SMALL).exists(), reason="test tables are not here")
def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    rows = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = store(stage(spark, docs, SMALL), f"test-{name}")
        if name != "sharding":
            assert docs.columns == columns
        now = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert now <= ids and (name == "mixing" or docs.count() <= rows)
        ids, rows = now, docs.count()
    assert {"shard", "slot"} <= set(docs.columns) and rows > 80
    assert sorted(r["slot"] for r in docs.where("shard = 3").collect()) == list(range(docs.where("shard = 3").count()))


def test_odd_rows_and_empty_tables(spark, make_docs, tmp_path):
    from .conftest import odd_rows, words

    rng = random.Random(3)
    leak = " ".join(words(rng, 20))
    base = " ".join(words(rng, 80))
    plain = {100 + i: " ".join(words(rng, 90)) for i in range(12)}
    rows = [*odd_rows(), *plain.items(), (300, base), (301, base), (None, base), (302, f"{' '.join(words(rng, 60))} {leak}"), (302, plain[100] + " more")]
    spark.createDataFrame([(1, leak), (None, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(100, 1, 0), (4, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    make_docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    left = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [r["doc_id"] for r in left]
    assert {1, 2, 3, 4, 301} & set(ids) == set() and not any(leak in r["text"] for r in left)
    assert set(left[0].asDict()) >= {"shard", "slot", "lang"}
    empty = tmp_path / "none"
    make_docs([]).write.parquet(f"{empty}/documents.parquet")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(empty)).collect() == []


def test_registered_queries():
    assert [n for n in range(1, 14) if not any(q.startswith(f"op{n}_") for q in registry.LLM_QUERIES)] == []
    assert set(registry.LLM_QUERIES) <= set(queries()) and set(registry.LLM_ORACLES) <= set(oracle_sql())
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_native_operators_have_no_python_workers():
    for name in NATIVE:
        text = (ROOT / "predaudit/llm" / name).read_text()
        assert not re.search(r"udf|mapInArrow|mapInPandas|applyInPandas|import pandas|import pyarrow|toPandas", text), name


def test_nothing_else_imports_the_package():
    others = [p for p in (ROOT / "predaudit").rglob("*.py") if "llm" not in p.parts]
    assert not [p.name for p in others if "predaudit.llm" in p.read_text()]
