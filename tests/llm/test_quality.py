"""Base counts against plain Python, the ratio against held-out documents."""

import re
from collections import Counter

from predaudit.llm.quality import keep_good, quality

from .conftest import odd_rows, words


def _base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines, seen = 0, set()
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(covered)


def test_counts_and_verdicts(spark, make_docs, rng):
    texts = {}
    for i in range(160):
        w = words(rng, 80, 300)
        texts[i] = " ".join(w) if i % 4 else " ".join(f"{x}%%" for x in w)
    texts |= {500: "é x y\né x y\n\n a b\t<|>", 501: "a b c " * 40, 502: "ü" * 30}
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(120)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    docs = make_docs(texts)
    rows = {r["doc_id"]: r for r in quality(docs, labels).collect()}
    for i, text in texts.items():
        r = rows[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == _base(text)
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
    held_out = [i for i in range(120, 160)]
    assert all(rows[i]["kept"] == (i % 4 > 0) for i in held_out)
    assert {r["doc_id"] for r in keep_good(docs, labels).collect()} == {i for i, r in rows.items() if r["kept"]}


def test_odd_rows_no_labels_and_empty_table(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality(make_docs(odd_rows()), none).collect()
    assert len(rows) == len(odd_rows()) and all(r["base_failed"] and not r["kept"] for r in rows)
    assert quality(make_docs([]), none).collect() == []
