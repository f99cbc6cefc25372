"""The similarity join against all pairs of full shingle sets."""

import numpy as np
import pytest

from predaudit.llm import partenum
from predaudit.llm.partenum import band, difference, folded, linked_classes, parity, signatures
from predaudit.llm.shingles import shingle_set

from .conftest import odd_rows, words


def _brute(rows, percent=80):
    sets = [(i, set(shingle_set((t or "").encode()).tolist())) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return {i: (len(s), root(i)) for i, s in sets}


def _got(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def _edited(rng, base, edits):
    out = list(base)
    for at in rng.sample(range(len(out)), edits):
        out[at] = f"edit{rng.randrange(10**6)}"
    return " ".join(out)


def _corpus(rng):
    base, other, stock = words(rng, 160), words(rng, 40), words(rng, 40)
    texts = {i: " ".join([*words(rng, rng.randrange(3, 200)), *(stock if i % 3 else [])]) for i in range(100, 220)}
    texts |= {i: _edited(rng, base, rng.randrange(0, 6)) for i in range(1000, 1100)}  # many just below and above the threshold
    texts |= {i: _edited(rng, other, rng.randrange(0, 3)) for i in range(1500, 1540)}
    texts |= {i: " ".join(base[: rng.randrange(120, 160)]) for i in range(1700, 1730)}
    texts |= {i: " ".join(base) for i in range(2000, 2040)}
    texts |= {i + 3000: texts[i].upper() for i in range(100, 130)}
    return texts | {5000: "a b c", 5001: "A  b\tc", 5002: "a b d", 5003: "a b c d e f g h i", 5004: "a b c d e f g h"}


def test_links_equal_brute_force(make_docs, rng):
    texts = _corpus(rng)
    assert _got(linked_classes(make_docs(texts))) == _brute(list(texts.items()))


def test_small_blocks_and_full_comparison_give_the_same_links(make_docs, rng, monkeypatch):
    monkeypatch.setattr(partenum, "SKETCH_BLOCK", 16)
    monkeypatch.setattr(partenum, "BLOCK", 16)
    monkeypatch.setattr(partenum, "ROUNDS", 1)
    texts = _corpus(rng)
    assert _got(linked_classes(make_docs(texts))) == _brute(list(texts.items()))


@pytest.mark.parametrize("percent", [75, 80, 90])
def test_linked_sets_share_a_signature_and_sketches_never_rule_them_out(percent):
    random, linked = np.random.RandomState(5), 0
    for turn in range(1500):
        size = random.randint(1, 300) if turn % 3 else random.randint(1, 14)
        base = random.randint(0, 2**63, 2 * size + 200).astype(np.uint64)
        gone, new = random.randint(0, size // 4 + 2, 2)
        a, b = np.unique(base[:size]), np.unique(np.concatenate([base[gone:size], base[size : size + new]]))
        if not len(b):
            continue
        common = len(np.intersect1d(a, b))
        union = len(a) + len(b) - common
        x, y = parity(a), parity(b)
        length = min(len(x), len(y))
        assert np.bitwise_count(folded(x, length) ^ folded(y, length)).sum() <= union - common
        if 100 * common >= percent * union and common < union:
            linked += 1
            assert union - common <= difference(len(a) + len(b), percent)
            assert abs(band(len(a), percent)[0] - band(len(b), percent)[0]) <= 1
            assert len(np.intersect1d(signatures(a, percent), signatures(b, percent)))
    assert linked > 50


def test_texts_of_copies_are_left_out_before_links_are_verified(make_docs, rng, monkeypatch):
    sizes, without = [], partenum.without

    def counted(df, column, keys):
        sizes.append(df.count())
        return without(df, column, keys)

    monkeypatch.setattr(partenum, "without", counted)
    base = words(rng, 100)
    texts = {i: " ".join(base) for i in range(60)}  # copies
    texts |= {i: " ".join(words(rng, 50)) for i in range(100, 160)}  # without links
    texts |= {200: " ".join(base[:97]), 201: _edited(rng, base, 1)}
    rows = [*texts.items(), (200, texts[30]), (300, texts[200])]  # a row of a node that is a copy of another text
    got = linked_classes(make_docs(rows)).collect()
    assert sorted({(r["doc_id"], r["component_id"]) for r in got}) == sorted({(i, 0 if i < 60 or i >= 200 else i) for i, _ in rows})
    assert sizes[0] == len(rows) and len(sizes) > 1 and max(sizes[1:]) < 10


def test_odd_rows_and_empty_table(make_docs):
    rows = linked_classes(make_docs([*odd_rows(), (None, "same text here")])).collect()
    assert len(rows) == len(odd_rows()) + 1
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert [by_id[i]["n_shingles"] for i in (1, 2, 3, 4, 5, 6)] == [0, 0, 0, 1, 1, 1]
    assert all(r["component_id"] == i for i, r in by_id.items())
    assert all(r["component_id"] is None for r in rows if r["doc_id"] is None)
    assert linked_classes(make_docs([])).collect() == []
