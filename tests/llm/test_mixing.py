"""Mixing against its reference SQL on skewed sources, and its laws."""

import math
from collections import defaultdict

import duckdb

from predaudit.llm import mixing, oracles
from predaudit.llm.mixing import fit, mix, mix_sources

from .conftest import odd_rows, words


def _texts(rng):
    return {i: " ".join(words(rng, rng.randrange(1, 60))) for i in range(700)}


def _source(i):
    return "hot" if i % 3 == 0 else "small" if i % 100 == 1 else f"s{i % 7}"


def test_rows_equal_sql_where_weights_move(make_docs, rng, tmp_path):
    docs = make_docs(_texts(rng), _source)
    path = str(tmp_path / "documents")
    docs.coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}/*.parquet'")
    columns = ["doc_id", "source", "n_tokens", "epoch", "block", "start_token", "position"]
    want = con.execute(f"select {', '.join(columns)} from ({oracles.OP5})").fetchall()
    got = [tuple(r) for r in mix_sources(docs).select(columns).collect()]
    assert sorted(got) == sorted(want) and 0 < fit(docs).exponent < mixing.MILLION


def test_weights_budgets_and_limits(make_docs, rng, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 32)
    texts = _texts(rng)
    docs, size = make_docs(texts, _source), defaultdict(int)
    for i, t in texts.items():
        size[_source(i)] += len(t.split())
    total = sum(size.values())
    for entropy, repeats in ((0.97, 1000.0), (1.0, 2.0), (0.5, 4.0)):
        mixture = fit(docs, entropy, repeats)
        a = mixture.exponent / mixing.MILLION

        def weights(a):
            raised = {s: (n / total) ** a for s, n in size.items()}
            return {s: x / sum(raised.values()) for s, x in raised.items()}

        w = weights(a)
        h = -sum(x * math.log(x) for x in w.values()) / math.log(len(w))
        most = max(w[s] * total / size[s] for s in size)
        assert h >= entropy - 1e-9 or most > repeats * 0.999
        assert most <= repeats + 1e-9
        if a < 1:
            nearer = weights(a + 1e-6)
            assert -sum(x * math.log(x) for x in nearer.values()) / math.log(len(w)) < entropy or most > repeats * 0.999
        taken, longest = defaultdict(int), max(len(t.split()) for t in texts.values())
        seen = defaultdict(list)
        for r in mix(docs, mixture).collect():
            taken[r["source"]] += r["n_tokens"]
            seen[r["doc_id"]].append(r["epoch"])
        assert all(w[s] * total - longest <= taken[s] <= w[s] * total + 1 for s in size)
        assert all(sorted(e) == sorted(set(e)) for e in seen.values())


def test_long_documents_leave_room_for_others(make_docs, rng):
    texts = {i: " ".join(words(rng, 20)) for i in range(40)} | {100: " ".join(words(rng, 900))} | {i: " ".join(words(rng, 30)) for i in range(200, 400)}
    docs = make_docs(texts, lambda i: "small" if i <= 100 else "large")
    mixture = fit(docs, 0.2, 4.0, 0.2)
    budget = {r["_source"]: r["_budget"] for r in mixture.sources.collect()}
    rows = mix(docs, mixture).collect()
    taken = sum(r["n_tokens"] for r in rows if r["source"] == "small")
    assert budget["small"] < 900 and budget["small"] - 20 < taken <= budget["small"] and 100 not in {r["doc_id"] for r in rows}
    assert {(r["_size"], r["_s"], r["_source"], r["size"]) for r in rows} == {("own _size", "own _s", "own _source", "own size")}


def test_odd_rows_and_empty_table(make_docs):
    rows = mix_sources(make_docs(odd_rows(), lambda i: None if i == 4 else "s")).collect()
    assert {r["doc_id"] for r in rows} >= {4, 6} and all(r["lang"] == "en" for r in rows)
    assert mix_sources(make_docs([])).collect() == [] and mix_sources(make_docs({1: None, 2: ""})).collect() == []
