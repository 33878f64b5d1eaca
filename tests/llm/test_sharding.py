import zlib

import numpy as np

from sensorloom.llm import sharding


def test_exact_shards_and_slots(make_docs, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 7)
    rows = [(k, f"text {k % 9}" if k % 5 else None) for k in range(997)] + [(3, "text 3"), (3, "text 3"), (None, ""), (None, "é")]
    out = sharding.shuffled_shards(make_docs(rows).repartition(5)).collect()
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in out), key=str) == sorted(
        ((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows), key=str
    )
    slots = {}
    for r in out:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(slots) == list(range(24))
    sizes = [len(s) for s in slots.values()]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r["law"] for r in out} == {"rows"} and {r["grown_shard"] for r in out} == {None}


def test_shuffle_is_uniform_and_repeatable(make_docs):
    docs = make_docs([(k, str(k)) for k in range(2400)])
    first = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shuffled_shards(docs).collect()}
    assert first == {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shuffled_shards(docs).collect()}
    rank = np.array([first[k][0] * 100 + first[k][1] for k in range(2400)])
    assert abs(np.corrcoef(np.arange(2400), rank)[0, 1]) < 0.08
    assert np.bincount(rank[:1200] // 100, minlength=24).std() < 10


def test_matrix_margins_and_law():
    counts = [100, 0, 1, 57]
    draws = np.array([sharding.communication_matrix(counts, 4, seed) for seed in range(400)])
    assert (draws.sum(axis=2) == counts).all()
    sizes = draws.sum(axis=1)
    assert (sizes.max(axis=1) - sizes.min(axis=1) <= 1).all() and (sizes.sum(axis=1) == 158).all()
    assert abs(draws[:, 0, 0].mean() - 100 * 40 / 158) < 0.6


def test_large_populations(monkeypatch):
    rng = np.random.default_rng(1)
    want = [sharding.hypergeometric(rng, 300, 700, 200) for _ in range(4000)]
    monkeypatch.setattr(sharding, "NUMPY_LIMIT", 1)
    got = [sharding.hypergeometric(rng, 300, 700, 200) for _ in range(4000)]
    assert abs(np.mean(got) - np.mean(want)) < 0.5 and abs(np.std(got) / np.std(want) - 1) < 0.06
    assert 0 <= sharding.hypergeometric(rng, 3 * 10**10, 7 * 10**10, 10**6) <= 10**6
    assert sharding.hypergeometric(rng, 5, 0, 3) == 3 and sharding.hypergeometric(rng, 0, 5, 3) == 0


def test_empty_table(make_docs):
    assert sharding.shuffled_shards(make_docs([])).count() == 0
