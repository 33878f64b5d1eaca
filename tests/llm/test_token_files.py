import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyarrow.fs import FileSelector

from sensorloom.lineage import shared_folder
from sensorloom.llm import token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = tokenizers.Tokenizer.from_file(PATH)


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_ids_of_odd_texts():
    with open(PATH, "rb") as file:
        ids = token_files.Ids(file.read())
    rng = random.Random(1)
    alphabet = ["a", "b", " ", "  ", "\n", "\t", "é", "日", "1", "'s", "'ll", "!", "<|endoftext|>", "\u00a0", "\x85", "\u200b", "٣", "_", "ǅ", "\U0001f600", " " * 300]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(400)] + [" \n" * 5000, "\n" * 9000 + "x", "a" * 20_000]
    assert ids.compiled is not None
    for text in texts:
        assert ids.of(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    for odd in (" " * 2_000_000, "日本語 " * 600_000):  # longer than a slice
        assert len(ids.of(odd)) == len(ids.rounds.encode(odd))


def corpus():
    rng = random.Random(8)
    words = ["river", "stone", "Wörter", "12", "x=1;", "\n", "日本", "the", "<|endoftext|>"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for k in rng.sample(range(1000), 300)]
    return rows + [(-5, None), (2000, ""), (2001, "a" * 40_000), (2002, "long words of one text " * 20_000), (7_000_000_000, "far")]


def test_files_against_the_library(spark, make_docs, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_BYTES", 3000)
    rows, start, expected = corpus(), 0, {}
    for i, text in sorted(rows):
        ids = ids_of(text)
        expected[i] = (start, len(ids), crc(ids))
        start += len(ids)
    got = token_files.round_trip(make_docs(rows), PATH, end_id=2).collect()
    assert len(got) == len(rows) and {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in got} == expected


def test_repeated_and_null_ids_lie_gapless(spark, make_docs):
    rows = [(5, "five")] * 40 + [(5, "other"), (None, "no id"), (None, None), (1, "one")]
    got = sorted(token_files.round_trip(make_docs(rows), PATH).collect(), key=lambda r: r["start"])
    assert [r["start"] for r in got] == list(np.cumsum([0, *(r["n_tokens"] for r in got[:-1])]))
    assert got[0]["doc_id"] == 1 and [r["doc_id"] for r in got[-2:]] == [None, None]
    assert sorted(r["ids_crc32"] for r in got) == sorted(crc(ids_of(t)) for _, t in rows)
    runs = [r["ids_crc32"] for r in got if r["doc_id"] == 5]
    assert sum(a != b for a, b in zip(runs, runs[1:])) == 1


def test_empty_table_and_other_id_types(spark, make_docs):
    assert token_files.round_trip(make_docs([]), PATH).collect() == []
    named = spark.createDataFrame([("b", "two words"), ("a", "one")], "doc_id string, text string")
    got = {r["doc_id"]: r["start"] for r in token_files.round_trip(named, PATH).collect()}
    assert got == {"a": 0, "b": len(ids_of("one"))}
    small = spark.createDataFrame([(2, "two words"), (1, "one")], "doc_id int, text string")
    assert {r["doc_id"] for r in token_files.round_trip(small, PATH).collect()} == {1, 2}


@pytest.fixture
def folder(spark, make_docs):
    place = f"{shared_folder(spark)}/tokens-{random.randrange(1 << 60)}"
    token_files.write(make_docs(corpus()), PATH, place)
    return place


def test_short_document_access_reads_single_frames(spark, folder):
    texts = dict(corpus())
    wanted = [2001, -5, 2000, 123456]
    got = {r["doc_id"]: list(r["ids"]) for r in token_files.lookup(spark, folder, wanted).collect()}
    assert got == {i: ids_of(texts[i]) for i in wanted if i in texts}


def test_files_name_their_dictionary_and_reject_another(spark, folder):
    files = token_files.manifest(spark, folder).orderBy("partition", "place").collect()
    assert [r["first_id"] for r in files] == sorted(r["first_id"] for r in files)
    reader = token_files.Reader(folder)
    file, kind, _, index, _ = reader.open(files[0]["path"])
    assert kind.itemsize == 2 and index.num_rows == files[0]["n_docs"]
    held = [x.path for x in reader.store.get_file_info(FileSelector(reader.place)) if x.path.endswith(".zdict")]
    assert len(held) == 1
    with reader.store.open_output_stream(held[0]) as out:
        out.write(b"other")
    with pytest.raises(ValueError, match="other content"):
        token_files.Reader(folder).open(files[0]["path"])


def test_files_of_lost_attempts_are_not_read(spark, folder):
    before = token_files.digests(spark, folder).count()
    reader = token_files.Reader(folder)
    with reader.store.open_output_stream(f"{reader.place}/frames-000000-0000-lost.tok") as out:
        out.write(b"half a file")
    assert token_files.digests(spark, folder).count() == before


def test_dictionary_helps_short_documents(spark, make_docs):
    rng = random.Random(2)
    phrases = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "common", "phrase"]) for _ in range(6)) for _ in range(12)]
    docs = make_docs([(k, " ".join(rng.choice(phrases) for _ in range(4)) + f" {k}") for k in range(600)])
    learned = token_files.train_dictionary(docs, PATH)
    share = spark.sparkContext.broadcast
    sizes = [token_files.encoded(docs, PATH, share(d), 2, "doc_id", "text").agg({"n_bytes": "sum"}).first()[0] for d in (b"", learned)]
    assert learned and sizes[1] < 0.8 * sizes[0]
