import random

import numpy as np
import pytest

from sensorloom.llm import licenses, quality, rules


def test_rules_against_plain_counts():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(["a ", "b ", "c\n", "#x ", "é\t", "\n", "the ", "AB "]) for _ in range(rng.randint(0, 80)))
        words = text.split()
        n = len(words)
        runs = [tuple(words[k : k + 8]) for k in range(n - 7)]
        covered = {k + j for k, run in enumerate(runs) if runs.count(run) > 1 for j in range(8)}
        lines = [line for line in text.split("\n") if line.split()]
        got = dict(zip(rules.MEASURES, rules.measured(text)))
        assert got["n_words"] == n and got["word_chars"] == sum(map(len, words)) and got["n_symbols"] == text.count("#")
        assert got["n_dup_lines"] == len(lines) - len(set(lines)) and got["n_repeat_words"] == len(covered)
        assert got["n_stutter"] == sum(a == b for a, b in zip(words, words[1:]))


def test_ledger_policies_and_ablations(make_docs):
    clean = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    rows = [(1, clean), (2, None), (3, "short"), (4, clean.upper()), (5, " ".join(w + "#$%" for w in clean.split())), (6, "spam " * 100), (None, clean)]
    entries = rules.ledger(make_docs(rows))
    full = rules.POLICIES["full-1"]
    kept = {r["doc_id"]: r["kept"] for r in entries.select("doc_id", rules.passes(full).alias("kept")).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False, None: True}
    table = {r["rule"]: r for r in rules.ablations(entries, full).collect()}
    assert table["few_words"]["n_failed"] == 2 and table["few_words"]["n_kept_without"] == 4
    assert table["symbols"]["n_failed_alone"] == 1 and all(r["n_kept"] == 2 for r in table.values())
    docs = make_docs(rows)
    passed = rules.kept_rows(docs, full)
    assert passed.columns == docs.columns and {r["doc_id"] for r in passed.collect()} == {1, None}
    assert rules.ledger(make_docs([])).count() == 0


def graded_corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    rows, grades = [], []
    for k in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 80))]
        grade = rng.choice([0, 1, 2, 2, 2])
        if grade == 1:
            words[rng.randrange(len(words))] = rng.choice(["vile", "nasty"])
        if grade == 0:
            words = [w + "$$" for w in words]
        rows.append((k, " ".join(words)))
        grades.append(grade)
    return rows, grades


def test_classifier_on_held_out_documents(spark, make_docs):
    rows, grades = graded_corpus(900, 1)
    rated = spark.createDataFrame(list(enumerate(grades))[:600], "doc_id long, grade int")
    docs = make_docs([*rows, (9000, None), (None, "")])
    model = quality.train(docs, rated)
    assert (np.diff(model.thresholds) > 0).all()
    got = {r["doc_id"]: r for r in quality.graded(docs, model).collect()}
    right = [got[k]["kept"] == (grades[k] == 2) for k in range(600, 900)]
    assert sum(right) / len(right) > 0.95
    means = [np.mean([got[k]["expected_grade"] for k in range(600, 900) if grades[k] == g]) for g in (0, 1, 2)]
    assert means[0] < means[1] < means[2]
    kept = quality.selected(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {k for k, r in got.items() if r["kept"]}


def test_ratings_and_no_labels(spark, make_docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, 0, 1), (3, 1, None), (4, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r["doc_id"]: r["grade"] for r in quality.ratings(labels).collect()} == {1: 1, 2: 0, 3: 2}
    docs = make_docs([(1, "a b"), (2, None)])
    model = quality.train(docs, quality.ratings(labels.limit(0)))
    assert all(r["kept"] for r in quality.graded(docs, model).collect())
    assert quality.graded(make_docs([]), model).count() == 0


def test_bound_on_training_rows(spark, make_docs):
    rows, grades = graded_corpus(60, 2)
    rated = spark.createDataFrame(list(enumerate(grades)), "doc_id long, grade int")
    model = quality.train(make_docs(rows), rated, max_train=1)
    assert len(model.index) == 0  # one document supports no feature


@pytest.mark.parametrize("percent", [80, 60])
def test_block_matches_as_by_brute_force(make_docs, percent):
    known = licenses.templates()
    rng = random.Random(6)
    words = sorted(set().union(*(t.words for t in known)))
    rows = []
    for k in range(80):
        lines = []
        for _ in range(rng.randint(1, 4)):
            base = list(rng.choice(known).words)
            rng.shuffle(base)
            lines.append(" ".join(base[: rng.randint(1, len(base))] + rng.sample(words, rng.randint(0, 5))).upper())
        rows.append((k, "\n".join(lines)))
    docs = make_docs(rows)
    order = licenses.rarity_order(docs, words)
    got = {(r["doc_id"], r["block"], r["template"], round(r["containment"], 9)) for r in licenses.block_matches(docs, known, order, percent).collect()}
    want = set()
    for i, text in rows:
        for b, line in enumerate(text.lower().split("\n")):
            for t in known:
                common = len(t.words & set(line.split()))
                if 100 * common >= percent * len(t.words):
                    want.add((i, b, t.number, round(common / len(t.words), 9)))
    assert got == want


def test_phrases_and_odd_rows(make_docs):
    rows = [(1, "It is Under the MIT License, under the mit license.\nCC BY-NC 4.0"), (1, "other"), (2, None), (None, "apache license version 2"), (3, ""), (3, "")]
    got = sorted((tuple(r) for r in licenses.scan(make_docs(rows)).collect()), key=str)
    assert (1, 15, 3, 2, 10, "cc-by-nc,mit", "cc-by-nc,mit", 1.0) in got
    assert (1, 1, 0, None, None, "", "", 0.0) in got and (2, 0, 0, None, None, "", "", 0.0) in got
    assert (None, 4, 1, 0, 0, "apache-2", "apache-2", 1.0) in got
    assert len(got) == len(rows) and licenses.scan(make_docs([])).count() == 0
