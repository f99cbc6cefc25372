"""Leaks against a search of every alignment of every item and document."""

from itertools import combinations

import numpy as np
import pytest

from predaudit.llm.decontaminate import PERCENT, WINDOW, best_alignment, drop_leaked, leaks, masks_for, seeds, tokens

from .conftest import odd_rows, words


def test_copies_and_substitutions_are_found(spark, make_docs, rng):
    items = {i: words(rng, n) for i, n in enumerate([40, 25, 16, 13, 9, 6, 2])}
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(90, " ".join(items[0])), (91, None)], "item_id long, text string")
    texts, planted = {}, {}
    for d in range(120):
        host, i = words(rng, rng.randrange(20, 120)), d % 8
        if i < 7:
            w = list(items[i])
            for at in range(0, len(w), 8 if d % 2 and len(w) >= 13 else 10**6):
                if at:
                    w[at] = "other"
            at = rng.randrange(len(host))
            host[at:at] = [x.capitalize() + "," for x in w]
            planted[d] = i
        texts[d] = " ".join(host)
    got = {(r["doc_id"], r["item_id"]) for r in leaks(make_docs(texts), benchmark).collect()}
    want = set()
    for d, text in texts.items():
        doc = tokens(text)
        for i, w in items.items():
            item = tokens(" ".join(w))
            if len(w) >= 3 and best_alignment(doc, item, list(range(-len(item), len(doc)))):
                want.add((d, i))
    assert want == {(d, i) for d, i in planted.items() if i < 6} and got == want
    kept = {r["doc_id"] for r in drop_leaked(make_docs(texts), benchmark).collect()}
    assert kept == texts.keys() - {d for d, _ in want}


def test_odd_rows_and_empty_tables(spark, make_docs):
    benchmark = spark.createDataFrame([(1, "nobody's text is long enough to be found here")], "item_id long, text string")
    assert leaks(make_docs(odd_rows()), benchmark).collect() == []
    named = make_docs([(None, "Nobody's text, is long enough: to be found here!"), (3, "x")])
    assert [(r["doc_id"], r["item_id"]) for r in leaks(named, benchmark).collect()] == [(None, 1)]
    assert [tuple(r) for r in drop_leaked(named, benchmark).select("doc_id", "text").collect()] == [(3, "x")]
    assert leaks(make_docs([]), benchmark).collect() == [] and leaks(named, benchmark.limit(0)).collect() == []


@pytest.mark.parametrize("n", range(3, 17))
def test_every_placement_that_the_rule_accepts_has_a_hit(n):
    item = np.arange(1, n + 1).astype(np.uint64) * np.uint64(77)
    mine = set(zip(*(part.tolist() for part in seeds(item, masks_for(n)))))
    width = min(n, WINDOW)
    for gone in combinations(range(n), n - -(-n * PERCENT // 100) if n < WINDOW else width - -(-width * PERCENT // 100)):
        text = item.copy()
        text[list(gone)] = 5
        assert best_alignment(text, item, [0]) and mine & set(zip(*(part.tolist() for part in seeds(text, masks_for(n)))))


def test_short_items_and_items_without_an_id(spark, make_docs, rng):
    host, long = words(rng, 30), words(rng, 20)
    items = ["one two three four", "alpha beta gamma delta epsilon zeta", "tiny item", "red green blue"]
    benchmark = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(None, " ".join(long)), (None, " ".join(long))], "item_id long, text string")
    texts = {
        1: " ".join([*host, "One two, three four!", *host]), 2: "x alpha beta other delta epsilon zeta y", 3: " ".join([*host, *long]), 4: "a tiny item here",
        5: "red green blue", 6: "one two other four", 7: " ".join(host),
    }
    got = {(r["doc_id"], r["item_id"]) for r in leaks(make_docs(texts), benchmark).collect()}
    assert got == {(1, 0), (2, 1), (3, None), (5, 3)}
    assert {r["doc_id"] for r in drop_leaked(make_docs(texts), benchmark).collect()} == {4, 6, 7}


def test_only_leaked_texts_go(spark, make_docs):
    benchmark = spark.createDataFrame([(1, "this passage of the benchmark must not be in the corpus")], "item_id long, text string")
    leaked = "It says: this passage of the benchmark must not be in the corpus."
    docs = make_docs([(1, leaked), (1, "another text of the same doc_id"), (None, leaked), (None, "a text without an id"), (None, None)])
    left = drop_leaked(docs, benchmark)
    assert left.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"], r["_text"]) for r in left.collect()), key=str) == sorted(
        [(1, "another text of the same doc_id", "own _text"), (None, "a text without an id", "own _text"), (None, None, "own _text")], key=str
    )
