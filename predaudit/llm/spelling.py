"""Spelling variants: words of a vocabulary that differ by one edit, found by composing automata.

The vocabulary is an acceptor of its words. Composed with a transducer that inserts, deletes or replaces exactly one letter and with the
same acceptor again, it accepts the pairs of words that are one edit apart. The composition is enumerated in parts, each with an initial state
of its own:

1. An edit leaves one half of a word untouched. So every word goes to the part of its first half, whose initial state is the one this prefix
   leads to, and to the part of its second half, whose words all end in it. A pair meets in exactly one part: in that of the prefix if the first
   difference lies behind it, else in that of the suffix. Parts know the length of the shorter word, so a word goes to parts of its own length
   (to be replaced in or inserted into) and of one letter less (to be deleted from).
2. Parts of more than ``PART`` words are divided again by the halves of what is still free, until none is left or one letter is free. A
   prefix that a third of the vocabulary shares is thus only a longer prefix, and no pair is lost.
3. In a part the words between prefix and suffix form a minimal acyclic acceptor with numbered words. The composed states are found
   level by level, those that reach no final state are trimmed, and the accepted paths are read off as pairs of numbers.

Per word only the number of its near words and the best of them leave a part.

Defined results: null and empty texts have no words; a null doc_id counts as empty text in the noise hash; repeated rows count each time; words of any
length work; of equally frequent near words the smallest in code-point order is the form; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from predaudit.functions.lineage import store

PART = 4096  # words of one part
FLUSH = 200_000  # distinct words that a task counts before it hands them on

Arcs = dict[str, tuple[int, int]]  # letter -> next state, number of words of smaller letters


def _words(counts: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])


def _counted(least: int, noise: int):
    run_of_letters = re.compile(f"[a-zÀ-ÿ]{{{least},}}")  # shorter runs cannot give a word

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                start = zlib.crc32(b":" if doc is None else b"%d:" % doc)
                for word, times in Counter(run_of_letters.findall((text or b"").lower().decode())).items():
                    if noise and not (h := zlib.crc32(word.encode(), start)) % noise:
                        word = word[: (at := h % len(word))] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    counts[word] += times
                if len(counts) > FLUSH:
                    yield _words(counts)
                    counts.clear()
        yield _words(counts)

    return run


def vocabulary(docs: DataFrame, least_length: int = 7, least_count: int = 2, noise: int = 0) -> DataFrame:
    """``(word, n)`` of the runs of letters in whole texts, A-Z lower-cased.

    With ``noise`` a letter is left out of every run whose hash with the doc_id it divides, as a typing error that can be computed again.
    """
    runs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_counted(least_length, noise), "word string, n long")
    return runs.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# Automata. A state is its arcs; state numbers index the list of states. All words below a state have the same length.


class Acceptors:
    """Minimal acyclic acceptors that share their states; every word of a language has a number."""

    def __init__(self) -> None:
        self.arcs: list[Arcs] = []
        self.size: list[int] = []
        self._known: dict[tuple, int] = {}

    def _state(self, children: list[tuple[str, int]]) -> int:
        key = tuple(children)
        if key not in self._known:
            arcs, total = {}, 0
            for letter, child in children:
                arcs[letter] = (child, total)
                total += self.size[child]
            self._known[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.size.append(total if children else 1)
        return self._known[key]

    def add(self, words: list[str]) -> int:
        """The initial state of the acceptor of sorted distinct words of one length. Word ``i`` has number ``i``."""
        length, last = len(words[0]), words[0]
        open_: list[list[tuple[str, int]]] = [[] for _ in range(length + 1)]
        for word in [*words[1:], None]:
            common = 0
            if word is not None:
                while word[common] == last[common]:
                    common += 1
            for depth in range(length, common if word is not None else 0, -1):
                open_[depth - 1].append((last[depth - 1], self._state(open_[depth])))
                open_[depth] = []
            last = word
        return self._state(open_[0])


def one_edit(machines: Acceptors, short: int, long: int | None) -> Iterator[tuple[int, int, bool]]:
    """Pairs of numbers of words one edit apart: of two words of ``short``, or of one of ``short`` and one of ``long`` with a letter more (True)."""
    arcs = machines.arcs
    replaced = [(short, 0)]  # before the edit both acceptors are in the same state
    inserted = [(short, long, 0, 0)] if long is not None else []
    levels: list[list[tuple]] = []  # pairs that enter the state behind the edit at each level
    while replaced or inserted:
        born, next_replaced, next_inserted = [], [], []
        for state, i in replaced:
            out = [(x, child, i + n) for x, (child, n) in arcs[state].items()]
            next_replaced += [(child, n) for _, child, n in out]
            born += [(p, q, a, b, False) for at, (_, p, a) in enumerate(out) for _, q, b in out[at + 1 :]]
        for state, other, i, j in inserted:
            here, there = arcs[state], arcs[other]
            for y, (q, b) in there.items():
                if not here:
                    born.append((None, None, i, j + b, True))  # a letter at the very end
                for x in here.keys() & arcs[q].keys():
                    (p, a), (r, c) = here[x], arcs[q][x]
                    if x != y:  # else the same word comes of an insertion further on
                        born.append((p, r, i + a, j + b + c, True))
                if y in here:
                    p, a = here[y]
                    next_inserted.append((p, q, i + a, j + b))
        levels.append(born)
        replaced, inserted = next_replaced, next_inserted
    needed = [{(p, q) for p, q, *_ in born if p is not None} for born in levels]
    steps: dict[tuple, list[tuple]] = {}
    for at, pairs in enumerate(needed):
        for p, q in pairs:
            both = arcs[p].keys() & arcs[q].keys()
            steps[p, q] = [((arcs[p][x][0], arcs[q][x][0]), arcs[p][x][1], arcs[q][x][1]) for x in both]
            if both:
                if at + 1 == len(needed):
                    needed.append(set())
                needed[at + 1].update(pair for pair, *_ in steps[p, q])
    final = {pair for pair in steps if not arcs[pair[0]]}
    alive = set(final)
    for pairs in reversed(needed):
        for pair in pairs:
            steps[pair] = [step for step in steps[pair] if step[0] in alive]
            if steps[pair]:
                alive.add(pair)
    paths: list[tuple] = []
    for at in range(len(needed)):
        nexts = []
        for p, q, i, j, insertion in [*paths, *(levels[at] if at < len(levels) else ())]:
            if p is None or (p, q) in final:
                yield i, j, insertion
            else:
                nexts += [(*pair, i + a, j + b, insertion) for pair, a, b in steps[p, q]]
        paths = nexts
    yield from ((i, j, insertion) for p, q, i, j, insertion in paths if (p, q) in final)


def _near_in_part(m: int, p: int, s: int, rows: list[tuple[str, int]]) -> Iterator[tuple[str, int, int, str]]:
    """``(word, near words, n of the best, the best)`` of words that share their first ``p`` and last ``s`` letters and have ``m`` or ``m + 1``."""
    machines, groups = Acceptors(), []
    for length in (m, m + 1):
        groups.append(sorted((word[p : length - s], word, n) for word, n in rows if len(word) == length))
    shorter, longer = groups
    if not shorter or len(rows) < 2:
        return
    roots = [machines.add([middle for middle, *_ in group]) if group else None for group in groups]
    near: dict[str, list] = {}

    def link(word: str, other: str, n: int) -> None:
        found = near.setdefault(word, [0, -1, ""])
        found[0] += 1
        if n > found[1] or n == found[1] and other < found[2]:
            found[1:] = [n, other]

    for i, j, insertion in one_edit(machines, *roots):
        a, b = shorter[i], (longer if insertion else shorter)[j]
        if insertion and s and b[0].startswith(a[0]):
            continue  # they differ only behind the prefix, so they meet in another part
        link(a[1], b[1], b[2])
        link(b[1], a[1], a[2])
    yield from ((word, *found) for word, found in near.items())


def _enumerated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("word", pa.string()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])
    rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns]))
    found: list[tuple] = []
    for (m, p, s, _), part in groupby(rows, key=lambda row: row[:4]):
        found += _near_in_part(m, p, s, [row[4:] for row in part])
        if len(found) > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)
            found = []
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)


def _divided(rows: DataFrame) -> DataFrame:
    """Every row once with the first and once with the second half of its free letters fixed."""
    half = F.floor((F.col("m") - F.col("p") - F.col("s")) / 2).cast("int")
    sides = F.array(
        F.struct((F.col("p") + half).alias("p"), F.col("s")),
        F.struct(F.col("p"), (F.col("m") - F.col("p") - half).alias("s")),
    )
    both = rows.select("m", F.explode(sides).alias("side"), "word", "n").where("side.s < m")  # no letter is free before a whole word
    fixed = F.concat(F.expr("left(word, side.p)"), F.expr("right(word, side.s)"))
    return both.select("m", F.col("side.p").alias("p"), F.col("side.s").alias("s"), fixed.alias("fixed"), "word", "n")


def parts(words: DataFrame, largest: int = PART) -> DataFrame:
    """``(m, p, s, fixed, word, n)``: the words of every part; ``m`` is the length of the shorter words, ``fixed`` the ``p + s`` letters they share."""
    length = F.length("word")
    rows = words.select(F.explode(F.array(length, length - 1)).alias("m"), F.lit(0).alias("p"), F.lit(0).alias("s"), "word", "n").where("m > 0")
    key, settled = ["m", "p", "s", "fixed"], []
    rows = _divided(rows)
    while True:
        large = store(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("size")).where((F.col("size") > largest) & F.expr("m - p - s > 1")).select(*key), "sv-large")
        if large.isEmpty():
            return reduce(DataFrame.unionByName, [*settled, rows])
        settled.append(rows.join(large, key, "left_anti").select(*key, "word", "n"))
        rows = _divided(rows.join(large, key, "left_semi"))


def near_words(words: DataFrame, largest: int = PART) -> DataFrame:
    """``(word, n_near, best, best_n)`` of the words of ``(word, n)`` that have words one edit away, ``best`` the most frequent of them."""
    key = ["m", "p", "s", "fixed"]
    dealt = parts(words, largest).select(*key, "word", "n").repartition(*key).sortWithinPartitions(*key)
    found = dealt.mapInArrow(_enumerated, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", F.col("best.word").alias("best"), (-F.col("best.less")).alias("best_n")
    )


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of the words of ``(word, form)``: where the forms lead to. Every form is more frequent, so there is no circle."""
    steps = store(forms.select("word", F.col("form").alias("root")), "sv-steps")
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = store(steps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "sv-steps")
        if moved.where("moved").isEmpty():
            return steps
        steps = moved.select("word", "root")


def variants(words: DataFrame, ratio: int = 10, largest: int = PART) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` of every word of ``(word, n)``. The form is the most frequent near word if it is ``ratio`` times as frequent."""
    words = store(words, "sv-words")
    counted = words.join(near_words(words, largest), "word", "left")
    known = F.coalesce(F.col("best_n") >= ratio * F.col("n"), F.lit(False))
    rows = store(
        counted.select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(known, F.col("best")).alias("form"),
            F.when(known, F.col("best_n")).alias("form_n"),
        ),
        "sv-forms",
    )
    roots = _roots(rows.where("form is not null").select("word", "form"))
    return rows.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
