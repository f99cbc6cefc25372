"""Collocations against plain counting."""

import re
from collections import Counter

import pytest

from predaudit.llm import collocations as module
from predaudit.llm.collocations import collocations, scored

from .conftest import odd_rows


def _brute(rows, least, percent=80, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, 5):
                f.update((lang, tuple(w[i : i + size])) for i in range(len(w) - size + 1))
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    held = set()
    for (lang, w), a in found.items():
        for size in range(2, len(w)):
            held |= {(lang, w[i : i + size]) for i in range(len(w) - size + 1) if 100 * a >= percent * f[lang, w[i : i + size]]}
    rows = []
    for (lang, w), a in found.items():
        if (lang, w) not in held:
            cuts = [(2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
            score, _, left, right = min(cuts)
            rows.append((lang, " ".join(w), a, left, right, n[lang], score))
    out = []
    for lang in n:
        best = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        out += [(lang, i + 1, *r[1:]) for i, r in enumerate(best)]
    return sorted(out)


def _texts(rng):
    stock = ["at the end of the day", "New York City", "ad hoc", "ß über Straße", "again again again again again"]
    vocabulary = [f"w{i}" for i in range(12)]
    return [
        (rng.choice(["en", "de", None]), " ".join(rng.choice([rng.choice(stock), rng.choice(vocabulary), rng.choice(vocabulary).upper() + rng.choice(".,;:!?\n\v\f\r ")]) for _ in range(rng.randrange(60))))
        for _ in range(300)
    ]


def _docs(spark, rows):
    return spark.createDataFrame([(i, lang, text, 1, "k", 2) for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, a int, phrase string, rank int")


@pytest.mark.parametrize("share,stretch", [(1, 10**7), (8, 100), (1000, 2000)])  # a sample of all, some and hardly any documents
def test_phrases_equal_brute_force(spark, rng, monkeypatch, share, stretch):
    monkeypatch.setattr(module, "STRETCH", stretch)
    monkeypatch.setattr(module, "BUFFER", min(module.BUFFER, stretch))
    rows = _texts(rng)
    got = sorted(tuple(r) for r in collocations(_docs(spark, rows), least=12, top=40, share=share).collect())
    want = _brute(rows, 12, top=40)
    assert got == want and max(len(r[2].split()) for r in want) == 4 and {r[0] for r in want} == {"en", "de", "und"}


def test_all_failures_of_the_sample_are_made_good(spark, rng, monkeypatch):
    rows = _texts(rng)
    monkeypatch.setattr(module, "proposals", lambda texts, *_: texts.selectExpr("2 as size", "0L as key", "0L as check").limit(0))
    got = sorted(tuple(r) for r in collocations(_docs(spark, rows), least=12).collect())
    assert got == _brute(rows, 12)


def test_words_of_one_hash_are_equal(rng):
    texts = [(b"en", " ".join(rng.choice("abcAB.") * rng.randrange(1, 4) + rng.choice("xyé") for _ in range(200)).encode()) for _ in range(40)]
    words = module.Words(texts, module._powers(1 << 20))
    by_hash = {}
    for i in range(len(words.start)):
        by_hash.setdefault((int(words.hash[0][i]), int(words.hash[1][i])), set()).add(words.text(i, 1))
    assert all(len(x) == 1 for x in by_hash.values()) and len(by_hash) == len({w for x in by_hash.values() for w in x})
    assert [x for t in texts for x in module._cut(t[1])] == [t[1] for t in texts]


def test_scores_beyond_64_bits(spark):
    big = 6 * 10**17
    rows = spark.createDataFrame([("en", "a b", 2, big), ("en", "a", 1, 2 * big), ("en", "b", 1, 3 * big)], "lang string, phrase string, size int, a long")
    assert [tuple(r) for r in scored(rows).collect()] == [("en", "a b", 2, big, 2 * big, 3 * big, 400_000)]


def test_odd_rows_and_empty_table(make_docs):
    got = [tuple(r) for r in collocations(make_docs(odd_rows())).collect()]
    assert got == _brute([("en", t) for _, t in odd_rows()], 30) and got[0][2] == "long long long long"
    assert collocations(make_docs([])).collect() == []
