"""Near-duplicates against all pairs of full shingle sets."""

import numpy as np

from predaudit.llm import setsketch
from predaudit.llm.components import components
from predaudit.llm.setsketch import drop_near_duplicates, estimate, near_duplicates, registers
from predaudit.llm.shingles import shingle_set

from .conftest import odd_rows, words


def _brute(rows):
    sets = [(i, set(shingle_set((t or "").encode()).tolist())) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return {i: (len(s), root(i)) for i, s in sets}


def _edited(rng, base, edits):
    out = list(base)
    for at in rng.sample(range(len(out)), edits):
        out[at] = f"edit{rng.randrange(10**6)}"
    return " ".join(out)


def test_links_equal_brute_force_with_a_hot_group(make_docs, rng):
    base = words(rng, 150)
    texts = {i: " ".join(words(rng, rng.randrange(3, 200))) for i in range(100, 200)}
    texts |= {i: _edited(rng, base, rng.randrange(0, 6)) for i in range(1000, 1120)}  # many of them just below and above the threshold
    texts |= {i: " ".join(base) for i in range(2000, 2060)}
    texts |= {i + 3000: texts[i].upper() for i in range(100, 130)}
    texts |= {5000: "a b c", 5001: "A  b\tc", 5002: "a b d"}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(make_docs(texts)).collect()}
    assert got == _brute(list(texts.items()))


def test_blocks_give_the_same_links(make_docs, rng, monkeypatch):
    monkeypatch.setattr(setsketch, "BLOCK", 16)
    monkeypatch.setattr(setsketch, "MEMBERS", 8)
    base = words(rng, 120)
    texts = {i: _edited(rng, base, rng.randrange(0, 7)) for i in range(150)}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(make_docs(texts)).collect()}
    assert got == _brute(list(texts.items()))


def test_registers_merge_and_estimate(rng):
    a, b = (np.unique(np.array([rng.getrandbits(64) for _ in range(n)], np.uint64)) for n in (900, 700))
    assert (np.maximum(registers(a), registers(b)) == registers(np.union1d(a, b))).all()
    c = np.union1d(a[:600], b)
    x, y, true = registers(a), registers(c), 600 / (900 + 700)
    best, keep = estimate([len(a)], [len(c)], np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([(x == y).sum()]), 0.75)
    assert abs(best[0] - true) < 0.15 and not keep[0]


def test_odd_rows_and_empty_table(make_docs):
    rows = near_duplicates(make_docs(odd_rows())).collect()
    assert len(rows) == len(odd_rows())
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by_id[1]["n_shingles"] == by_id[2]["n_shingles"] == by_id[3]["n_shingles"] == 0 and by_id[4]["n_shingles"] == 1
    assert all(r["component_id"] is None and r["kept"] for r in rows if r["doc_id"] is None)
    assert all(r["kept"] and r["component_id"] == i for i, r in by_id.items())
    assert near_duplicates(make_docs([])).collect() == []
    assert drop_near_duplicates(make_docs({1: "a b c d e f", 2: "a b c d e f"})).select("doc_id", "lang").collect() == [(1, "en")]


def test_only_copies_go(make_docs, rng):
    a, b = " ".join(words(rng, 30)), " ".join(words(rng, 30))
    docs = make_docs([(1, a), (2, a), (2, b), (3, ""), (None, a), (4, a.upper())])
    left = drop_near_duplicates(docs)
    assert left.columns == docs.columns and {r["_row"] for r in left.collect()} == {"own _row"}
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == sorted([(1, a), (2, b), (3, ""), (None, a)], key=str)


def test_components_of_paths_and_stars(spark, rng):
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(250)] + [(i, i + 1) for i in range(500, 540)] + [(900, i) for i in range(901, 950)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for e in edges for x in e if root(x) != x}
