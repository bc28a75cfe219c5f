import hashlib
import zlib
from collections import defaultdict

from chronoscope.llm import sharding


def greedy(sizes, capacity):
    n, used = 1, 0
    for s in sizes:
        if s > capacity:
            return 10**9
        if used + s > capacity:
            n, used = n + 1, 0
        used += s
    return n


def brute_capacity(texts, shards):
    groups = defaultdict(int)
    for t in texts:
        groups["!" if t is None else hashlib.sha256(t.encode()).hexdigest()] += len((t or "").encode()) + 16
    sizes = [groups[k] for k in sorted(groups)]
    low, high = max(sizes), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if greedy(sizes, middle) <= shards else (middle + 1, high)
    return low


def check(rows, source, shards):
    texts = [t for _, t in source]
    assert len(rows) == len(source)
    load, slots, where = defaultdict(int), defaultdict(list), {}
    for r in rows:
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert max(load.values()) == brute_capacity(texts, shards)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(0 <= k < shards for k in load)
    by_id = dict(source)
    for r in rows:
        assert where.setdefault(by_id[r["doc_id"]], r["shard"]) == r["shard"]


def test_documents_against_brute_force(documents, texts):
    rows = sharding.shard_manifest(documents).collect()
    check(rows, list(texts.items()), 40)
    assert {r["law"] for r in rows} == {"bytes"}
    assert all(r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in rows)
    assert all(r["grown_shard"] is None for r in rows)


def test_refinement_finds_the_same_capacity(documents, texts, monkeypatch):
    monkeypatch.setattr(sharding, "FIRST_DIGITS", 1)
    monkeypatch.setattr(sharding, "MORE_DIGITS", 1)
    monkeypatch.setattr(sharding, "FETCH", 5)
    check(sharding.shard_manifest(documents, 7).collect(), list(texts.items()), 7)


def test_edges(edge_docs, no_docs):
    out = sharding.shard_documents(edge_docs, 4)
    rows = out.collect()
    assert len(rows) == edge_docs.count()
    assert set(edge_docs.columns) <= set(out.columns)
    by_text = defaultdict(set)
    for r in rows:
        by_text[r["text"]].add(r["shard"])
        assert r["size"] == len((r["text"] or "").encode()) + 16
    assert all(len(s) == 1 for s in by_text.values())
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_manifest(no_docs).collect() == []
