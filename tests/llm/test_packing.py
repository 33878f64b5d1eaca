import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from sensorloom.llm import packing, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_every_id_once_and_windows_full(make_docs):
    words = ["alpha", "beta", "gamma", "delta", "omega", "kappa"]
    rows = [(k, " ".join(words[(k + j * (k % 5)) % 6] for j in range(3 + 17 * k % 90))) for k in range(60)]
    rows += [(100, None), (101, ""), (7, rows[7][1]), (None, "no id"), (200, "long text " * 2000)]
    window = 64
    out = packing.pack(make_docs(rows), PATH, window).collect()
    library = Tokenizer.from_file(PATH)
    pieces, expected = {}, {}
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        expected.setdefault(i, []).append(ids)
    for r in out:
        pieces.setdefault(r["doc_id"], []).append(r)
    assert set(pieces) == set(expected)
    for i, many in expected.items():
        ids, mine = many[0], sorted(pieces[i], key=lambda r: r["start"])
        assert sum(r["length"] for r in mine) == len(ids) * len(many)
        for r in mine:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert len(part) == r["length"] and r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["doc_tokens"] == len(ids)
        covered = np.bincount(np.concatenate([np.arange(r["start"], r["start"] + r["length"]) for r in mine]))
        assert (covered == len(many)).all()
    sequences = {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append(r)
    sizes = []
    for mine in sequences.values():
        at = 0
        for r in sorted(mine, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        sizes.append(at)
    assert max(sizes) <= window and sum(s < window for s in sizes) <= 1  # one shard


def test_similar_units_share_windows():
    rng = np.random.default_rng(1)
    topics = [rng.integers(1000 * t, 1000 * t + 40, (30, 50)) for t in (1, 2, 3)]
    tails = [topics[k % 3][k // 3].astype("<u2") for k in range(90)]
    frequency = np.zeros(50257, np.int64)
    for t in tails:
        frequency[np.unique(t)] += 1
    stats = packing.Statistics(len(tails), sum(map(len, tails)), frequency)
    windows = {}
    for unit, _, _, number, _ in packing.fill_windows(tails, stats, 500):
        windows.setdefault(number, set()).add(unit % 3)
    assert sum(len(topics) == 1 for topics in windows.values()) >= len(windows) - 3


def test_scores_are_bm25():
    tails = [np.array(t, "<u2") for t in ([5, 5, 7], [5, 9], [9, 9, 9, 11])]
    frequency = np.bincount(np.concatenate([np.unique(t) for t in tails]), minlength=20)
    stats = packing.Statistics(3, 9, frequency)
    got = packing.Index(tails, stats).scores(0)
    for k, tail in enumerate(tails):
        want = 0.0
        for term in (5, 7):
            tf = int((tail == term).sum())
            idf = np.log1p((3 - frequency[term] + 0.5) / (frequency[term] + 0.5))
            want += idf * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(tail) / 3))
        assert abs(got[k] - want) < 1e-12


def test_empty_table(make_docs):
    assert packing.pack(make_docs([]), PATH).count() == 0


def test_ids_of_any_type_and_many_empty_documents(spark):
    rows = [(k, "" if k % 3 else f"some words of document {k}") for k in range(3000)]
    for kind in ("int", "string", "smallint", "long"):
        docs = spark.createDataFrame([(str(k) if kind == "string" else k, t) for k, t in rows], f"doc_id {kind}, text string")
        out = packing.pack(docs, PATH)
        assert out.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
        pieces = out.collect()
        assert len({r["doc_id"] for r in pieces}) == 3000
        sizes = {}
        for r in pieces:
            sizes[r["sequence_id"]] = sizes.get(r["sequence_id"], 0) + r["length"]
        assert sum(v < packing.WINDOW for v in sizes.values()) <= 1


def test_plain_texts_need_no_merge_rounds(monkeypatch):
    with open(PATH, "rb") as file:
        encoder = token_files.Ids(file.read())
    texts = ["one plain text, and its words", None, "", "more words " * 300]
    library = Tokenizer.from_file(PATH)
    expected = [library.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]
    monkeypatch.setattr(encoder.rounds, "merge_words", lambda *args: 1 / 0)
    rows = packing.tails(encoder, texts, 64)
    assert rows["doc_tokens"] == [len(ids) for ids in expected]
    for ids, crcs, tail in zip(expected, rows["full_crcs"], rows["tail"]):
        whole = len(ids) // 64
        assert crcs == [zlib.crc32(np.array(ids[64 * k : 64 * k + 64], "<u4").tobytes()) for k in range(whole)]
        assert np.frombuffer(tail, "<u2").tolist() == ids[64 * whole :]
