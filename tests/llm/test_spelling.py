"""Spelling variants against all pairs of words."""

import re
import zlib
from collections import Counter

import pytest

from predaudit.llm.spelling import Acceptors, one_edit, parts, variants, vocabulary

from .conftest import odd_rows


def _near(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    u, v = sorted((u, v), key=len)
    return len(v) - len(u) == 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def _brute(counts, ratio=10):
    near = {w: [v for v in counts if v != w and _near(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda v: (-counts[v], v))
            if counts[best] >= ratio * counts[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, n, len(near[w]), form.get(w), counts.get(form.get(w)), root(w)) for w, n in counts.items())


def _rows(df):
    return sorted((tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect()), key=lambda r: r[0])


def _words(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


def test_composition_equals_all_pairs(rng):
    for _ in range(300):
        m = rng.randint(1, 6)
        found = sorted({"".join(rng.choice("abc") for _ in range(m + rng.randint(0, 1))) for _ in range(rng.randint(1, 40))})
        short, long = ([w for w in found if len(w) == m + k] for k in (0, 1))
        if short:
            machines = Acceptors()
            roots = machines.add(short), machines.add(long) if long else None
            got = sorted((short[i], (long if insertion else short)[j]) for i, j, insertion in one_edit(machines, *roots))
            assert got == sorted([(u, v) for u in short for v in short if u < v and _near(u, v)] + [(u, v) for u in short for v in long if _near(u, v)])


def test_acceptor_is_minimal():
    machines = Acceptors()
    root = machines.add(sorted(a + b + c for a in "abcd" for b in "xy" for c in "mn"))
    assert len(machines.arcs) == 4 and machines.size[root] == 16


@pytest.mark.parametrize("largest", [10_000, 3])  # 3: parts divided again and again
def test_variants_equal_brute_force(spark, rng, largest):
    letters = "abcü"
    counts = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))): rng.choice([2, 2, 3, 20, 30, 300, 5000]) for _ in range(400)}
    counts |= {"prefix" + "".join(rng.choice("ab") for _ in range(4)): rng.choice([2, 20, 200]) for _ in range(40)}
    counts |= {"x" * n: n for n in range(1, 60)} | {"y" * 4000: 2, "y" * 2000 + "z" + "y" * 1999: 40}
    assert _rows(variants(_words(spark, counts), largest=largest)) == _brute(counts)


def test_a_pair_meets_in_one_part(spark):
    counts = {w: 2 for w in ("abcdefg", "abcdefgh", "xabcdefg", "abcxdefg", "abydefg", "abcdeff")}
    rows = parts(_words(spark, counts)).collect()
    assert all(r["fixed"] == r["word"][: r["p"]] + r["word"][len(r["word"]) - r["s"] :] for r in rows)
    assert _rows(variants(_words(spark, counts))) == _brute(counts)


def test_vocabulary_with_noise(make_docs, rng):
    stems = ["Überraschung", "colour", "Neighbour", "rÉsumés", "shorter", "spelling"]
    texts = {i: " ".join(rng.choice([*stems, "tiny", "x-ray7"]) + rng.choice(" ,.1") for _ in range(80)) for i in range(200)}
    counts = Counter()
    for i, text in texts.items():
        for run in re.findall("[A-Za-zÀ-ÿ]+", text):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    want = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    words = vocabulary(make_docs(texts), noise=31)
    assert {r["word"]: r["n"] for r in words.collect()} == want
    assert _rows(variants(words)) == _brute(want) and any(r[5] != r[0] for r in _brute(want))


def test_odd_rows_and_empty_table(make_docs, spark):
    rows = odd_rows() + [(8, "lengthy " * 3), (9, None), (None, "lengthy " + "q" * 100_000), (10, "q" * 100_000)]
    assert {r["word"][:8]: r["n"] for r in vocabulary(make_docs(rows)).collect()} == {"lengthy": 4, "q" * 8: 2}
    assert _rows(variants(vocabulary(make_docs(rows))))[0] == ("lengthy", 4, 0, None, None, "lengthy")
    assert variants(vocabulary(make_docs([]))).collect() == []
