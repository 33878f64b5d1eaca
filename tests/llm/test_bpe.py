import hashlib
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from sensorloom.llm import bpe, lengths

PATH = public_tokenizers.path("byte_bpe_50k.json")


def texts():
    rng = random.Random(5)
    parts = [" ", "  ", "\n", "\t", "a", "é", "'s", "1", "!", " ", "<|endoftext|>", "the", "ation", "日本", "😀", "aaaa", "_"]
    odd = ["", " ", "  a  b \n c", "a\n\n b\t\tc  \n", "<|endoftext|>", "x" * 3000, " " * 50 + "z", "don't I'll", "12 345,67"]
    return odd + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(1500)]


def test_ids_and_text_as_the_tokenizers_library():
    library = Tokenizer.from_file(PATH)
    encoder = bpe.Encoder(open(PATH, "rb").read())
    for text in texts():
        want = library.encode(text, add_special_tokens=False).ids
        got = encoder.encode(text)
        assert got.tolist() == want, text
        assert encoder.decode(got) == library.decode(want, skip_special_tokens=False)


def test_slices_and_cache_do_not_change_ids(monkeypatch):
    text = " ".join(texts())
    want = bpe.Encoder(open(PATH, "rb").read()).encode(text).tolist()
    monkeypatch.setattr(bpe, "SLICE_CHARS", 37)
    monkeypatch.setattr(bpe, "CACHE_CHUNKS", 11)
    encoder = bpe.Encoder(open(PATH, "rb").read())
    assert encoder.encode(text).tolist() == want
    runs = list(encoder.encode_batches([None, text, "", text]))
    assert np.concatenate([c for _, c in runs]).tolist() == [0, len(want), 0, len(want)]
    assert np.concatenate([i for i, _ in runs]).tolist() == want + want


def test_digests_and_round_trip(make_docs):
    rows = [(1, "Hello <|endoftext|> world"), (2, None), (None, ""), (3, "é" * 500), (3, "é" * 500)]
    docs = make_docs(rows)
    library = Tokenizer.from_file(PATH)
    want = []
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, bpe.token_digests(docs, PATH).collect()), key=key) == sorted(want, key=key)
    assert {r["decoded"] for r in bpe.encode_documents(docs, PATH).collect()} == {t or "" for _, t in rows}
    assert bpe.token_digests(make_docs([]), PATH).count() == 0


def test_context_report_against_brute_force(make_docs, monkeypatch):
    monkeypatch.setattr(lengths, "LENGTH_BITS", 2)
    rows = [(k, "a b" * (k % 7)) for k in range(40)] + [(None, None)]
    library = Tokenizer.from_file(PATH)
    each = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t in rows]
    got = {r["length"]: r for r in lengths.context_report(lengths.length_histogram(make_docs(rows), PATH)).collect()}
    assert sorted(got) == sorted(set(each))
    for length, r in got.items():
        assert r["n_docs"] == each.count(length)
        assert r["n_docs_from"] == sum(x >= length for x in each)
        assert r["n_docs_above"] == sum(x > length for x in each)
        assert r["tokens_from"] == sum(x for x in each if x >= length)
        assert r["truncated_tokens"] == sum(min(x, length) for x in each)
        assert abs(r["quantile"] - sum(x <= length for x in each) / len(each)) < 1e-12
        assert (r["total_docs"], r["total_tokens"]) == (len(each), sum(each))
    assert lengths.context_report(lengths.length_histogram(make_docs([]), PATH)).count() == 0
