from collections import Counter
from itertools import permutations

import pytest

from sensorloom.llm import interactions

NAMES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
DOCS = "doc_id long, text string, source string, part string, mask int, key string, n long, id long"
LABELS = "doc_id long, quality int, toxic int"


def failed(row, rows):
    text = row[1] or ""
    words = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    twin = row[0] is not None and any(o[0] is not None and o[0] < row[0] and (o[1] or "") == text for o in rows)
    tests = [
        len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
        any(c in "#$%&*|" for c in text), twin,
    ]
    return "".join(f for f, t in zip("ABCDE", tests) if t)


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    fails = [(r[2] or "", r[0], failed(r, rows)) for r in rows]
    out, share = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for part in {p for p, _, _ in fails}:
            left = [(i, f) for p, i, f in fails if p == part]
            for step, letter in enumerate(order, 1):
                here = [(i, f) for i, f in left if letter in f]
                left = [(i, f) for i, f in left if letter not in f]
                every = [f for p, _, f in fails if p == part]
                share[part, letter] += len(here)
                out[part, order, step] = [
                    len(left), len(here), sum(letter in f for f in every) - len(here), every.count(letter),
                    sum(i in good for i, _ in here), sum(i in toxic for i, _ in here),
                ]
    return {k: [*v, share[k[0], k[1][k[2] - 1]]] for k, v in out.items()}


def found(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "p", 3, "k", 7, 9) for r in rows], DOCS)
    table = interactions.audit(interactions.mask_counts(docs, spark.createDataFrame(labels, LABELS))).collect()
    assert len({(r["part"], r["filter_order"], r["step"]) for r in table}) == len(table)
    return {(r["part"], r["filter_order"], r["step"]): [r[n] for n in NAMES] for r in table}


def test_every_order_against_plain_filters(spark):
    long = " ".join(f"w{k}" for k in range(260))
    texts = [long, "one two", None, "", long + " #", "ab " * 300, "AB cd " * 150, long.upper(), "a | b", "x" * 5000, "words not split\x1fhere", "\t\n\v\f\r "]
    rows = [(k, texts[k % len(texts)], ["src0", "src0", None, "", "ünï"][k % 5]) for k in range(60)]
    rows += [(None, long, "src0"), (None, "one two", "src9"), (7, "one two", "src0"), (7, "one two", "src0"), (100, long, "src0"), (100, long, "src1")]
    labels = [(k, k % 2, (k // 2) % 2) for k in range(0, 60, 3)] + [(None, 1, 1), (0, 0, 1), (0, 1, None), (9, None, None)]
    assert found(spark, rows, labels) == brute(rows, labels)


def test_empty_tables(spark):
    assert found(spark, [], []) == {}
    assert found(spark, [(1, "a", "s")], []) == brute([(1, "a", "s")], [])


@pytest.mark.parametrize("n", [3, 5])
def test_removal_steps_are_first_failures(n):
    steps = interactions.removal_steps(n)
    for mask in range(1 << n):
        for k, order in enumerate(permutations(range(n))):
            assert steps[mask, k] == next((s for s, f in enumerate(order) if mask >> f & 1), n)


def test_a_long_text_is_read_whole():
    text = "word " * 2_000_000 + "the last #"
    assert interactions.text_mask(text) == 0b1010 and interactions.text_mask(text[:-1]) == 0b0010
