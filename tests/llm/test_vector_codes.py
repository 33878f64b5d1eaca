import hashlib
import math
import random

import numpy as np
import pytest

from sensorloom.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label string, id long, vec string, code int, error int, same int"


def brute(rows, entries=256):
    """Plain integer arithmetic on Python numbers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = max(1, -(-max((len(r[1]) for r in kept), default=0) // 4))
    ints = [[math.floor(1024 * float(np.float32(x))) for x in r[1]] + [0] * (4 * width - len(r[1])) for r in kept]
    rank = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, list(map(float, np.float32(kept[k][1])))))
    part = lambda k, p: ints[k][p * width : (p + 1) * width]
    books = [[part(k, p) for k in rank[:entries]] for p in range(4)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def nearest(p):
        return [min(range(len(books[p])), key=lambda e: (apart(part(k, p), books[p][e]), e)) for k in range(len(kept))]

    for _ in range(4):
        for p in range(4):
            own = nearest(p)
            for e in range(len(books[p])):
                members = [part(k, p) for k in range(len(kept)) if own[k] == e]
                if members:
                    books[p][e] = [sum(c) // len(members) for c in zip(*members)]
    codes = [nearest(p) for p in range(4)]
    errors = [sum(apart(part(k, p), books[p][codes[p][k]]) for p in range(4)) for k in range(len(kept))]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    total = {label: sum(e for e, r in zip(errors, kept) if r[2] == label) for label in {r[2] for r in kept}}
    return sorted(
        (str(r[0]), "".join(f"{codes[p][k]:02x}" for p in range(4)), errors[k], total[r[2]], sha) for k, r in enumerate(kept)
    )


def found(spark, rows):
    table = vc.product_codes(spark.createDataFrame([(*r, 1, "v", 2, 3, 4) for r in rows], SCHEMA))
    return sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in table.collect())


def test_codes_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    base = [[rng.gauss(0, 0.3) for _ in range(8)] for _ in range(30)]
    rows = [(k, [x + rng.choice([0, 0, 0.004]) * rng.random() for x in rng.choice(base)], rng.choice(["a", "b", None])) for k in range(500)]
    rows += [(600 + k, base[0], "hot") for k in range(200)]  # one frequent vector
    rows += [(900, None, "a"), (901, [0.1, None] * 4, "a"), (902, [float("nan")] * 8, None), (903, [float("inf")] * 8, "b"), (904, [0.0] * 8, None), (None, base[1], "n"), (3, base[2], "a")]
    expected = brute(rows)
    assert found(spark, rows) == expected
    monkeypatch.setattr(vc, "BLOCK_ROWS", 64)
    monkeypatch.setattr(vc, "LEAF_ROWS", 1)
    assert found(spark, rows) == expected


def test_few_rows_odd_lengths_and_large_values(spark):
    rows = [(k, [1000.5 * k, -3.0, 0.25 * k], "x") for k in range(5)] + [(9, [], "y"), (10, [2.5], None), (11, [1e5, -1e5, 7.0, 8.0, 9.0], "x")]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    assert found(spark, [(1, None, "x")]) == []
    huge = [(1, [3e38, 0.0, 0.0, 0.0], "x"), (2, [-3e38, 0.0, 0.0, 0.0], "x")]
    assert [r[2] for r in found(spark, huge)] == [0, 0]


@pytest.mark.parametrize("seed", range(6))
def test_trees_hold_their_bounds_and_settle_exactly(seed):
    rng = np.random.default_rng(seed)
    n, width = int(rng.integers(1, 700)), int(rng.integers(1, 6))
    points = rng.integers(-40, 40, (n, width)) * int(10 ** rng.integers(0, 7))
    points[rng.random(n) < 0.3] = points[0]
    tree = vc.CoverTree(points)
    assert sorted(tree.order) == list(range(n))
    for k in range(len(tree.route)):
        rows = tree.order[tree.low[k] : tree.high[k]]
        apart = np.sqrt(((points[rows] - points[tree.route[k]]) ** 2).sum(axis=1))
        assert apart.max() <= tree.radius[k] * (1 + 1e-12)
        below = slice(tree.first[k], tree.first[k] + tree.children[k])
        if tree.children[k]:
            assert list(tree.low[below])[0] == tree.low[k] and list(tree.high[below])[-1] == tree.high[k]
    again = vc.CoverTree.from_bytes(tree.to_bytes(), points)
    entries = points[rng.integers(0, n, 20)] + rng.integers(-3, 3, (20, width))
    entries[5] = entries[4]
    distances = ((points[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (again.codes(entries) == distances.argmin(axis=1)).all()
    sums, counts = np.zeros_like(entries), np.zeros(len(entries), np.int64)
    again.add_sums(entries, sums, counts)
    owner = distances.argmin(axis=1)
    assert all((sums[e] == points[owner == e].sum(axis=0)).all() and counts[e] == (owner == e).sum() for e in range(len(entries)))


def test_tight_groups_are_settled_as_whole_subtrees():
    rng = np.random.default_rng(5)
    centres = rng.integers(-10**6, 10**6, (8, 16))
    points = np.concatenate([c + rng.integers(-5, 6, (250, 16)) for c in centres])
    runs, owners = vc.CoverTree(points).settled(centres)
    assert len(runs) < 40 and sorted(set(owners)) == list(range(8))
