"""Repeated lines and repeated passages against plain Python over the whole table."""

import re

from predaudit.llm.lines import drop_repeated_lines
from predaudit.llm.repeats import remove_repeated, repeated_units

from .conftest import odd_rows, words

SPACE = " \t\n\x0b\x0c\r"


def _lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def test_lines(make_docs, rng):
    stock = [" ".join(words(rng, 4)) for _ in range(12)] + ["short", "ÜBER die Zeile", "  padded line here\t", "PADDED line Here"]
    texts = {i: "\n".join(rng.choice([*stock, "", " ".join(words(rng, 5))]) for _ in range(rng.randrange(1, 30))) for i in range(120)}
    first, several = {}, set()
    for i in sorted(texts):
        for line in texts[i].split("\n"):
            key = _lower(line.strip(SPACE))
            if len(key) >= 10:
                if first.setdefault(key, i) != i:
                    several.add(key)
    for r in drop_repeated_lines(make_docs(texts)).collect():
        lines = texts[r["doc_id"]].split("\n")
        kept = [x for x in lines if (k := _lower(x.strip(SPACE))) not in several or first[k] == r["doc_id"]]
        assert (r["text"], r["n_lines"], r["n_dropped"]) == ("\n".join(kept), len(lines), len(lines) - len(kept))
        assert (r["row"], r["drops"], r["rank"]) == ("own row", "own drops", "own rank")


def test_lines_of_odd_rows(make_docs):
    rows = drop_repeated_lines(make_docs([*odd_rows(), (7, "nobody's text\nkept")])).collect()
    assert len(rows) == len(odd_rows()) + 1 and all(r["lang"] == "en" for r in rows)
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by_id[1]["text"] == "" and by_id[1]["n_lines"] == 1 and by_id[6]["n_dropped"] == 0
    assert {(r["text"], r["n_dropped"]) for r in rows if r["doc_id"] is None} == {("", 1), ("", 0)}
    assert by_id[7]["n_dropped"] == 0 and drop_repeated_lines(make_docs([])).collect() == []


def _sentences(rng, n):
    return " ".join(" ".join(words(rng, rng.randrange(6, 14))).capitalize() + "." for _ in range(n))


def _plain_units(text):
    """Units by another way: (start, end, words)."""
    out, start = [], 0
    for at in range(len(text) + 1):
        ends = at == len(text) or text[at] == "\n" or (text[at] in " \t" and at and text[at - 1] in ".!?")
        if ends:
            if text[start:at].split():
                out.append((start, at, len(text[start:at].split())))
            start = at + 1
    return out


def _brute(texts, passage):
    """Spans to remove of each document, in order of doc_id."""
    seen, out = set(), {}
    for i in sorted(texts):
        repeated, runs = [], []
        for no, (start, end, n) in enumerate(_plain_units(texts[i])):
            unit = " ".join(texts[i][start:end].lower().split())
            if unit in seen:
                repeated.append((no, start, end, n))
            seen.add(unit)
        for x in repeated:
            if not runs or runs[-1][-1][0] + 1 != x[0]:
                runs.append([])
            runs[-1].append(x)
        out[i] = {(s, e) for run in runs if sum(x[3] for x in run) >= passage for _, s, e, _ in run}
    return out


def test_passages_in_lines_and_in_the_middle_of_lines(make_docs, rng):
    shared, stock = [_sentences(rng, 7) for _ in range(3)], "Licensed under some terms of use that all of us know."
    texts = {}
    for i in range(90):
        parts = [_sentences(rng, rng.randrange(1, 5)) for _ in range(3)] + [stock, "Short one."]
        if i % 3 == 0:
            parts[1] += " " + shared[i % 9 // 3] + " " + _sentences(rng, 2)
        if i % 7 == 0:  # into the middle of a sentence
            half = parts[0].split(" ")
            parts[0] = " ".join([*half[:3], shared[0], *half[3:]])
        if i % 10 == 0:
            parts.append(parts[0])
        texts[i] = "\n".join(parts)
    want = _brute(texts, 10)
    got = {i: set() for i in texts}
    for r in repeated_units(make_docs(texts)).collect():
        part = texts[r["doc_id"]][r["start"] : r["end"]]
        assert re.fullmatch(r"\S.*\S", part) and len(part.split()) == r["words"] and r["first_doc_id"] <= r["doc_id"]
        got[r["doc_id"]].add((r["start"], r["end"]))
    assert got == want
    assert all(len(got[i]) > 6 for i in texts if i % 3 == 0 and i > 8) and all(len(got[i]) > 4 for i in texts if i % 7 == 0 and i)
    left = {r["doc_id"]: r["text"] for r in remove_repeated(make_docs(texts)).collect()}
    for i, text in texts.items():
        for s, e in sorted(want[i], reverse=True):
            text = text[:s] + text[e:]
        assert left[i] == text


def test_random_tables_and_passages_of_fifty_words(make_docs, rng):
    vocabulary = [f"v{i}" for i in range(40)]
    passages = [" ".join(words(rng, rng.randrange(4, 9))) + "." for _ in range(12)]
    long = [" ".join(passages[i : i + 8]) for i in (0, 4)]
    texts = {
        i: " ".join(rng.choice([rng.choice(passages), rng.choice(vocabulary), rng.choice(vocabulary) + rng.choice(".!?"), "\n", "\t", *long]) for _ in range(rng.randrange(40)))
        for i in range(150)
    }
    for passage in (1, 10, 25):
        got = {i: set() for i in texts}
        for r in repeated_units(make_docs(texts), passage).collect():
            got[r["doc_id"]].add((r["start"], r["end"]))
        # a blank before the first word of a unit belongs to no unit in the operator
        strip = {i: {(s + len(texts[i][s:e]) - len(texts[i][s:e].lstrip(" \t")), e) for s, e in spans} for i, spans in _brute(texts, passage).items()}
        assert {i: {(s + len(texts[i][s:e]) - len(texts[i][s:e].lstrip(" \t")), e) for s, e in spans} for i, spans in got.items()} == strip


def test_repeats_of_odd_rows(make_docs):
    passage = "one two three four five six. " * 6
    assert repeated_units(make_docs(odd_rows())).collect() == [] and repeated_units(make_docs([])).collect() == []
    rows = repeated_units(make_docs([(None, passage), (3, "Other words. " + passage)])).collect()
    assert {(r["doc_id"], r["first_doc_id"]) for r in rows} == {(None, 3), (3, 3)}
    assert remove_repeated(make_docs(odd_rows())).count() == len(odd_rows())
    copies = [(None, "Own. " + passage)] * 3 + [(1, passage)]
    assert repeated_units(make_docs(copies)).count() == 6 + 5
    assert [r["text"].strip() for r in remove_repeated(make_docs(copies)).collect() if r["doc_id"] is None] == ["Own."] * 3
    rows = {r["doc_id"]: r for r in remove_repeated(make_docs({1: passage, 2: "Other. " + passage})).collect()}
    assert rows[2]["text"].strip() == "Other." and (rows[2]["rest"], rows[2]["row"], rows[2]["spans"]) == ("own rest", "own row", "own spans")
    assert (len(rows[1]["removed"]), len(rows[2]["removed"])) == (5, 6)


def test_rows_of_one_doc_id_and_of_none_are_cut_at_their_own_spans(make_docs):
    passage = "one two three four five six. " * 6
    rows = [(1, passage), (2, "Own. " + passage), (2, "This other text of the same doc_id stays as it is."), (None, "Nobody's. " + passage)]
    left = {r["text"].strip() for r in remove_repeated(make_docs(rows)).collect() if r["doc_id"] != 1}
    assert left == {"Own.", "This other text of the same doc_id stays as it is.", "Nobody's."}
