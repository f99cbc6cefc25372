"""Sharding against a brute-force minimax partition of the same order of groups."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from predaudit.llm.sharding import fit, shard_documents

from .conftest import odd_rows


def _key(text):
    return int(hashlib.md5((text or "").encode()).hexdigest()[:15], 16)


def _capacity(sizes, shards):
    def runs(c):
        n, held = 1, 0
        for s in sizes:
            if held + s > c:
                n, held = n + 1, 0
            held += s
        return n

    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if runs(mid) <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("hot", [0, 300])
def test_capacity_is_minimal_and_groups_stay_whole(spark, make_docs, rng, hot):
    texts = {i: "x" * rng.randrange(1, 400) + str(rng.randrange(150)) for i in range(600)}
    texts |= {10_000 + i: "the hot group " * 3 for i in range(hot)}
    docs, shards = make_docs(texts), 7
    rows = shard_documents(docs, shards).collect()
    groups = defaultdict(int)
    for t in texts.values():
        groups[_key(t)] += len(t.encode()) + 8
    total = sum(groups.values())
    heavy = sorted(((s, k) for k, s in groups.items() if s > total / (shards * 16)), key=lambda x: (-x[0], x[1]))
    order = [s for s, _ in heavy] + [groups[k] for k in sorted(groups.keys() - {k for _, k in heavy})]
    per_shard, slots, shard_of = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in rows:
        assert r["size"] == len(texts[r["doc_id"]].encode()) + 8 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())
        per_shard[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        shard_of[r["text"]].add(r["shard"])
        assert (r["_offset"], r["_in_shard"]) == ("own _offset", "own _in_shard")
    capacity = _capacity(order, shards)
    assert fit(docs, shards).capacity == capacity and max(per_shard.values()) <= capacity
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in shard_of.values())
    assert len(per_shard) == shards and len(rows) == len(texts)
    rest = sorted(per_shard.values())[:-1] if hot else list(per_shard.values())
    assert max(rest) - min(rest) < 2 * max(s for s in order if s != max(order)) + 1


def test_odd_rows_and_empty_table(make_docs):
    rows = shard_documents(make_docs(odd_rows()), 3).collect()
    assert len(rows) == len(odd_rows()) and {r["size"] for r in rows if r["text"] in (None, "")} == {8}
    assert {r["text_crc32"] for r in rows if r["text"] is None} == {0} and all(r["lang"] == "en" for r in rows)
    assert shard_documents(make_docs([]), 3).collect() == []
