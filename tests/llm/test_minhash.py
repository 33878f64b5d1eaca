import random

import numpy as np
import pytest

from sensorloom.llm import minhash
from sensorloom.llm.graph import components
from sensorloom.llm.words import shingle_set


def brute(rows, shingle, percent):
    """Component ids by comparing all pairs."""

    def shingles(text):
        words = (text or "").encode().lower().split()
        return {tuple(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))} if words else set()

    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if rows[a][0] is not None and rows[b][0] is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                old, new = label[a], label[b]
                label = [new if c == old else c for c in label]
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[label[k]] = min(least.get(label[k], i), i)
    return sorted(((i, len(sets[k]), least.get(label[k]) if i is not None else None) for k, (i, _) in enumerate(rows)), key=str)


def corpus(n=120, seed=3):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 400)}" for _ in range(120)]
    rows = []
    for k in range(n):
        words = list(base) if k % 3 else [f"v{rng.randint(0, 10**6)}" for _ in range(rng.randint(1, 60))]
        for _ in range(rng.choice([0, 1, 2, 4, 6])):
            words[rng.randrange(len(words))] = f"u{rng.randint(0, 10**6)}"
        rows.append((1000 - k, " ".join(words)))
    return rows


ODD = [(5, None), (6, ""), (7, " \t\n"), (8, "One two"), (9, "ONE  two"), (None, "one two"), (10, "é è ê"), (10, "é è ê")]


@pytest.mark.parametrize("members", [1024, 8])
def test_components_as_by_brute_force(make_docs, monkeypatch, members):
    monkeypatch.setattr(minhash, "MEMBERS", members)
    rows = corpus() + ODD
    got = minhash.near_duplicates(make_docs(rows), shingle=4, percent=80).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows, 4, 80)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_deduplicated_rows_keep_their_columns(make_docs):
    rows = corpus() + ODD
    docs = make_docs(rows)
    kept = minhash.deduplicated(docs)
    assert kept.columns == docs.columns
    want = {i for i, _, c in brute(rows, 5, 80) if i == c and i is not None}
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in got if i is not None) == sorted(want) and got.count(None) == 1


def test_empty_table(make_docs):
    assert minhash.near_duplicates(make_docs([])).count() == 0
    assert minhash.deduplicated(make_docs([])).count() == 0


def test_estimate_is_near_the_similarity(spark):
    rng = np.random.default_rng(2)
    values = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    sets = [np.sort(values[:1000]), np.sort(np.r_[values[:800], values[1000:1200]])]
    low = minhash.packed(minhash.minima(sets)).tolist()
    row = spark.createDataFrame([(low[0], low[1])], "x array<long>, y array<long>").select(minhash.estimate("x", "y").alias("e")).first()
    assert abs(row["e"] - 800 / 1200) < minhash.MARGIN
    assert len(shingle_set("a b c d e f", 5)) == 2


def test_components_of_chains_and_hubs(spark):
    links = [(k, k + 1) for k in range(50)] + [(100, k) for k in range(101, 160)] + [(200, 201), (201, 200), (300, 300)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(51)}, **{k: 100 for k in range(100, 160)}, 200: 200, 201: 200}


@pytest.mark.parametrize("shingles", [1 << 20, 900])
def test_blocks_bounded_by_shingles_and_very_long_texts(make_docs, monkeypatch, shingles):
    monkeypatch.setattr(minhash, "SHINGLES", shingles)
    monkeypatch.setattr(minhash, "MEMBERS", 16)
    long = [f"l{k}" for k in range(300_000)]
    near = [*long[:150_000], "changed", *long[150_001:]]
    rows = corpus(60, seed=5) + [(2000, " ".join(long)), (2001, " ".join(near)), (2002, " ".join(long[:200_000])), (2003, "word " * 1_000_000)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(make_docs(rows), shingle=4).collect()}
    assert got == {i: (n, c) for i, n, c in brute(rows, 4, 80)}


def test_worker_caches_are_bounded_and_emptied():
    from sensorloom.llm import words

    text = " ".join(f"w{k}" for k in range(400_000))
    assert len(words.word_hashes(text)) == 400_000
    cache = words.worker_cache("word hashes", words._Hashes)
    assert cache.held <= words.CACHE_BYTES + words.SLICE_BYTES * 40
    assert list(words.forgetting(iter)([1, 2])) == [1, 2] and not cache
    words.worker_cache("other", dict)
    assert list(words._KEPT) == ["other"]
