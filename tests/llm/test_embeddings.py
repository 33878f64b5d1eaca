import numpy as np
import pytest

from sensorloom.llm import embeddings


def brute(rows, threshold):
    vectors = []
    for _, v in rows:
        ok = v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        vectors.append(np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok else None)
    label, links = list(range(len(rows))), [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            x, y = vectors[a], vectors[b]
            if x is None or y is None or len(x) != len(y) or rows[a][0] is None or rows[b][0] is None or x @ y < threshold:
                continue
            links[a] += 1
            links[b] += 1
            old, new = label[a], label[b]
            label = [new if c == old else c for c in label]
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[label[k]] = min(least.get(label[k], i), i)
    return sorted(((i, links[k], least.get(label[k]) if i is not None else None) for k, (i, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("block", [512, 16])
def test_links_as_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(8)
    centre = rng.standard_normal(24)
    rows = [(1000 - k, rng.standard_normal(24).tolist()) for k in range(150)]
    rows += [(2000 + k, (centre + 0.12 * rng.standard_normal(24)).tolist()) for k in range(60)]  # a group larger than a list
    rows += [(3000 + k, rows[3][1]) for k in range(5)] + [(3100, (np.array(rows[4][1]) * 3).tolist())]
    rows += [(1, None), (2, []), (3, [0.0] * 24), (4, [float("nan")] * 24), (5, [None] + [1.0] * 23), (6, [1.0, 0.0]), (7, [2.0, 0.0]), (None, rows[3][1])]
    vectors = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, node string")
    out, audit = embeddings.near_duplicates(vectors)
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in out.collect()), key=str)
    assert got == brute(rows, 0.95) and audit.recall >= 0.9


@pytest.mark.parametrize("block", [512, 16])
def test_links_between_dense_groups(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(3)
    axes = np.linalg.qr(rng.standard_normal((24, 3)))[0].T
    turned = 0.97 * axes[0] + np.sqrt(1 - 0.97**2) * axes[1]
    rows = [(k, (c + 0.005 * rng.standard_normal(24)).tolist()) for c, at in ((axes[0], 0), (turned, 100), (axes[2], 200)) for k in range(at, at + 40)]
    out, _ = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in out.collect()), key=str)
    assert got == brute(rows, 0.95) and {c for _, _, c in got} == {0, 200}


def test_audit_counts_queries_and_its_failure_ends_in_all_pairs(spark, monkeypatch):
    """Without a useful forest the dense group's links hide the missing pairs; no graph at all still gives every link."""
    rng = np.random.default_rng(5)
    pairs = rng.standard_normal((20, 24))
    rows = [(k, (pairs[k % 20] + 0.02 * rng.standard_normal(24)).tolist()) for k in range(40)]
    centre = rng.standard_normal(24)
    rows += [(100 + k, (centre + 0.02 * rng.standard_normal(24)).tolist()) for k in range(40)]
    real = embeddings.forest
    monkeypatch.setattr(embeddings, "MAX_FORESTS", 1)
    monkeypatch.setattr(embeddings, "forest", lambda nodes, seed, n: real(nodes, seed, n).filter("similarity >= 0.97").join(nodes.filter("first_id >= 100").select("node"), "node", "left_semi"))
    out, audit = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in out.collect()), key=str)
    assert got == brute(rows, 0.95) and audit.exact


def test_empty_table(spark):
    out, audit = embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert out.count() == 0 and audit.recall == 1.0
