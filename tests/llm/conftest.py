import random

import pytest

#: Names that the operators use inside.
CLASHING = (
    "size", "shard", "rank", "key", "hash", "row", "drops", "removed", "rest", "spans", "_offset", "_in_shard", "_size", "_s", "_source", "_row", "_text",
    "_set", "node", "component", "band", "word", "phrase", "mask", "item",
)
DOCS = "doc_id long, text string, lang string, source string, n_chars long, label int, " + ", ".join(f"{c} string" for c in CLASHING)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from ``{doc_id: text}`` or pairs, with extra columns whose names clash with those the operators use inside."""

    def make(texts, source="s"):
        pairs = list(texts.items()) if isinstance(texts, dict) else list(texts)
        rows = [
            (i, t, "en", source(i) if callable(source) else source, None if t is None else len(t), 7, *[f"own {c}" for c in CLASHING]) for i, t in pairs
        ]
        return spark.createDataFrame(rows, DOCS)

    return make


def words(rng: random.Random, n: int, vocabulary: int = 4000) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture
def rng():
    return random.Random(11)


#: Null, empty, blank, tiny, very long, repeated rows, a null identifier.
def odd_rows():
    return [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "long " * 60_000), (6, "same text here"), (6, "same text here"), (None, "nobody's text"), (None, None)]
