"""Token ids in binary files: one zstandard frame per document, a shared dictionary and an index of offsets.

A dictionary is trained on serialised id arrays. Every document's ids (with an end id) are compressed by themselves with
it, so that one document is read by its index entry and its frame, however short it is.

A folder holds ``dictionary-<sha256>.zdict``, binary files of frames, and the table ``manifest`` with a row per file. A
file is a header (magic, bytes of an id, SHA-256 of the dictionary), the frames, the index as an Arrow stream (``id``,
``n_tokens``, ``offset``) and a footer (offset of the index, magic). Tasks write files under names of their own and return
manifest rows; only files in the committed manifest count, so those of lost or repeated attempts are never read.

Documents lie in ascending id order, files too: ties by checksum and number of tokens, null ids last, so that repeated rows
are neighbours. Null and empty texts hold the end id only. Texts are whole. Ids may be of any type that Spark can sort. An
empty table gives an empty manifest. Further columns are ignored, whatever their names.

The dictionary is fitted on a bounded sample (``SAMPLE_DOCS`` documents expected, chosen by a hash of id and text over the
whole table, with at most ``SAMPLE_BYTES`` of each, from a place that the hash chooses); it changes sizes, never contents.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
import zstandard
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorloom.lineage import shared_folder, stored
from sensorloom.llm import bpe
from sensorloom.llm.words import forgetting, worker_cache
from sensorloom.sources.files import filesystem

MAGIC = b"TOKFRM01"
HEADER = struct.Struct("<8sI32s")
FOOTER = struct.Struct("<Q8s")
FILE_BYTES = 64 << 20  # frames of a file, but for a longer document
FILE_DOCS = 1 << 20
READ_BYTES = 4 << 20
LEVEL = 3
DICTIONARY_BYTES = 64 << 10
SAMPLE_DOCS = 2048
SAMPLE_BYTES = 4 << 10
MIN_SAMPLES = 16  # fewer give no dictionary
ROWS = 512  # documents of a batch that is sent on
LONG_SPACE = re.compile(r"\s{200}")

MANIFEST = "path string, partition int, place int, n_docs long, n_tokens long, first_id {0}, last_id {0}, n_bytes long"


class Ids:
    """Ids of whole texts by one vocabulary.

    The compiled encoder takes texts as they are; it needs ids in the order of merges, and its pattern matching does not bear
    long runs of white space. Other texts, those that hold special tokens and very long ones go through the merge rounds.
    """

    def __init__(self, content: bytes):
        self.rounds = bpe.Encoder(content)
        self.special = re.compile("|".join(map(re.escape, self.rounds.special))) if self.rounds.special else None
        self.dtype = np.dtype("<u2" if self.rounds.n_ids <= 1 << 16 else "<u4")
        self.compiled = None
        if (np.diff(self.rounds.made) > 0).all():
            names = {v: k for k, v in self.rounds.special.items()}
            pieces = {self.rounds.decode_bytes(np.array([i])): i for i in range(self.rounds.n_ids) if i not in names}
            self.compiled = tiktoken.Encoding("vocabulary", pat_str=bpe.PATTERN, mergeable_ranks=pieces, special_tokens={})

    def clear(self) -> None:
        self.rounds.clear()

    def of(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, self.dtype)
        plain = self.compiled is not None and len(text) <= bpe.SLICE_CHARS and not LONG_SPACE.search(text)
        if plain and not (self.special and self.special.search(text)):
            return np.array(self.compiled.encode_ordinary(text), self.dtype)
        return self.rounds.encode(text).astype(self.dtype)


def loaded(content: bytes) -> Ids:
    return worker_cache(("ids", hash(content)), lambda: Ids(content))


def train_dictionary(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> bytes:
    """A zstandard dictionary from a bounded sample of the documents' id arrays; empty where there are too few."""
    n = docs.count()
    draw = F.xxhash64(docs[id_col], docs[text_col])
    chance = min(1.0, SAMPLE_DOCS / max(n, 1))
    low = min(2**63 - 1, int(-(2**63) + chance * 2**64))
    chosen = docs.filter(draw <= F.lit(low)).select(draw.alias("draw"), docs[text_col].alias("text"))
    content = bpe.vocabulary(docs.sparkSession, path)

    def run(batches):
        ids = loaded(content.value)
        width = ids.dtype.itemsize
        for batch in batches:
            for draw, text in zip(*(c.to_pylist() for c in batch.columns)):
                raw = ids.of(text).tobytes()
                at = draw % max(1, (len(raw) - SAMPLE_BYTES) // width) * width
                yield pa.RecordBatch.from_arrays([pa.array([draw]), pa.array([raw[at : at + SAMPLE_BYTES]], pa.binary())], names=["draw", "piece"])

    pieces = chosen.mapInArrow(forgetting(run), "draw long, piece binary").dropDuplicates(["draw"]).limit(2 * SAMPLE_DOCS).collect()
    samples = [bytes(r["piece"]) for r in sorted(pieces, key=lambda r: r["draw"]) if len(r["piece"]) >= 8]
    if len(samples) < MIN_SAMPLES:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 4), samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # samples too alike or too small to learn from
        return b""


def encoded(docs: DataFrame, path: str, dictionary, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n_tokens, crc, salt, n_bytes, frame) of every document; ``dictionary`` is a broadcast."""
    content = bpe.vocabulary(docs.sparkSession, path)

    def run(batches):
        ids = loaded(content.value)
        shared = zstandard.ZstdCompressionDict(dictionary.value) if dictionary.value else None
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=True)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                counts, crcs, frames = [], [], []
                for text in part.column(1):
                    own = np.append(ids.of(text.as_py()), ids.dtype.type(end_id))
                    counts.append(len(own))
                    crcs.append(zlib.crc32(own.astype("<u4").tobytes()))
                    frames.append(packer.compress(own.tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(counts, pa.int64()),
                        pa.array(crcs, pa.int64()),
                        pa.array(range(at, at + part.num_rows), pa.int64()),
                        pa.array(list(map(len, frames)), pa.int64()),
                        pa.array(frames, pa.binary()),
                    ],
                    names=["id", "n_tokens", "crc", "salt", "n_bytes", "frame"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return chosen.mapInArrow(forgetting(run), f"id {kind}, n_tokens long, crc long, salt long, n_bytes long, frame binary")


class _File:
    """One file being written."""

    def __init__(self, store: FileSystem, folder: str, width: int, sha: bytes, place: int):
        self.path = f"frames-{TaskContext.get().partitionId():06d}-{place:04d}-{uuid.uuid4().hex}.tok"
        self.out = store.open_output_stream(f"{folder}/{self.path}")
        self.out.write(HEADER.pack(MAGIC, width, sha))
        self.place, self.at, self.index = place, HEADER.size, []

    def add(self, batch: pa.RecordBatch) -> None:
        lengths = batch.column(2).to_numpy(zero_copy_only=False)
        ends = self.at + np.cumsum(lengths)
        self.index.append(pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ends - lengths)], names=["id", "n_tokens", "offset"]))
        for frame in batch.column(3):
            self.out.write(frame.as_buffer())
        self.at = int(ends[-1])

    def full(self) -> bool:
        return self.at >= FILE_BYTES or sum(b.num_rows for b in self.index) >= FILE_DOCS

    def close(self) -> tuple:
        sink = pa.BufferOutputStream()
        table = pa.Table.from_batches(self.index)
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        self.out.write(sink.getvalue())
        self.out.write(FOOTER.pack(self.at, MAGIC))
        self.out.close()
        ids, tokens = table["id"], table["n_tokens"].to_numpy()
        return self.path, TaskContext.get().partitionId(), self.place, table.num_rows, int(tokens.sum()), ids[0], ids[-1], self.at


def write(docs: DataFrame, path: str, folder: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all documents and write them to ``folder``. Each text is encoded once; then only frames are moved and sorted."""
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, path, id_col, text_col)
    sha = hashlib.sha256(dictionary).digest()
    store, place = filesystem(folder)
    store.create_dir(place, recursive=True)
    with store.open_output_stream(f"{place}/dictionary-{sha.hex()}.zdict") as out:
        out.write(dictionary)
    frames = stored(encoded(docs, path, spark.sparkContext.broadcast(dictionary), end_id, id_col, text_col), "token-frames")
    total = frames.agg(F.sum("n_bytes")).first()[0] or 0
    n_files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // FILE_BYTES))
    order = [F.col("id").asc_nulls_last(), "crc", "n_tokens", "salt"]
    moved = frames.repartitionByRange(n_files, *order).sortWithinPartitions(*order).select("id", "n_tokens", "n_bytes", "frame")
    with open(path, "rb") as file:
        width = Ids(file.read()).dtype.itemsize

    def run(batches):
        store, place = filesystem(folder)
        file, n = None, 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                file = file or _File(store, place, width, sha, n)
                ends = file.at + np.cumsum(batch.column(2).slice(at).to_numpy(zero_copy_only=False))
                take = min(batch.num_rows - at, int(np.searchsorted(ends, FILE_BYTES)) + 1)
                file.add(batch.slice(at, take))
                at += take
                if file.full():
                    yield manifest_row(file.close())
                    file, n = None, n + 1
        if file:
            yield manifest_row(file.close())

    kind = frames.schema["id"].dataType.simpleString()
    moved.mapInArrow(run, MANIFEST.format(kind)).write.parquet(f"{folder.rstrip('/')}/manifest")


def manifest_row(values: tuple) -> pa.RecordBatch:
    names = [part.split()[0] for part in MANIFEST.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), values[5].type, values[6].type, pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([v.as_py() if isinstance(v, pa.Scalar) else v], k) for v, k in zip(values, kinds)], names=names)


class Reader:
    """Reads the files of one folder, each checked against the dictionary whose hash it holds."""

    def __init__(self, folder: str):
        self.store, self.place = filesystem(folder)
        self.packers: dict[bytes, zstandard.ZstdDecompressor] = {}

    def _packer(self, sha: bytes) -> zstandard.ZstdDecompressor:
        if sha not in self.packers:
            with self.store.open_input_stream(f"{self.place}/dictionary-{sha.hex()}.zdict") as file:
                held = file.read()
            if hashlib.sha256(held).digest() != sha:
                raise ValueError(f"the dictionary {sha.hex()} has other content than its name says")
            self.packers[sha] = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held) if held else None)
        return self.packers[sha]

    def open(self, path: str):
        """(file, type of the ids, decompressor, index as a table, end of the frames), from the file's header and tail only."""
        file = self.store.open_input_file(f"{self.place}/{path}")
        magic, width, sha = HEADER.unpack(file.read_at(HEADER.size, 0))
        at, again = FOOTER.unpack(file.read_at(FOOTER.size, file.size() - FOOTER.size))
        if magic != MAGIC or again != MAGIC:
            raise ValueError(f"{path} is not a whole file of token frames")
        index = pa.ipc.open_stream(file.read_at(file.size() - FOOTER.size - at, at)).read_all()
        return file, np.dtype(f"<u{width}"), self._packer(sha), index, at

    def documents(self, path: str, wanted: set | None = None) -> Iterator[tuple[pa.Table, list[np.ndarray]]]:
        """Index rows and id arrays, a few MB of frames at a time; ``wanted``: only these ids, each by a read of its own frame."""
        file, kind, packer, index, end = self.open(path)
        starts = index["offset"].to_numpy()
        ends = np.append(starts[1:], end)
        with file:
            if wanted is not None:
                for k in [k for k, i in enumerate(index["id"].to_pylist()) if i in wanted]:
                    frame = file.read_at(int(ends[k] - starts[k]), int(starts[k]))
                    yield index.slice(k, 1), [np.frombuffer(packer.decompress(frame), kind)]
                return
            at = 0
            while at < len(starts):
                upto = max(at + 1, int(np.searchsorted(ends, starts[at] + READ_BYTES, "right")))
                data = file.read_at(int(ends[upto - 1] - starts[at]), int(starts[at]))
                cuts = zip(starts[at:upto] - starts[at], ends[at:upto] - starts[at])
                yield index.slice(at, upto - at), [np.frombuffer(packer.decompress(data[a:b]), kind) for a, b in cuts]
                at = upto


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The committed files with ``start``, the number of ids in all files before."""
    files = spark.read.parquet(f"{folder.rstrip('/')}/manifest")
    before = Window.orderBy("partition", "place").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""

    def run(batches):
        reader = Reader(folder)
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns)):
                for index, arrays in reader.documents(path):
                    counts = np.array(list(map(len, arrays)), np.int64)
                    ends = start + np.cumsum(counts)
                    start = int(ends[-1])
                    yield pa.RecordBatch.from_arrays(
                        [
                            index["id"].combine_chunks(),
                            pa.array(ends - counts),
                            pa.array(counts),
                            pa.array([zlib.crc32(a.astype("<u4").tobytes()) for a in arrays], pa.int64()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    files = manifest(spark, folder).select("path", "start")
    kind = spark.read.parquet(f"{folder.rstrip('/')}/manifest").schema["first_id"].dataType.simpleString()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(tasks).mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, folder: str, ids: list) -> DataFrame:
    """(doc_id, ids) of the documents with one of ``ids`` (a short list): only files whose range meets them are opened."""
    wanted = set(ids)
    files = spark.read.parquet(f"{folder.rstrip('/')}/manifest")
    kind = files.schema["first_id"].dataType
    inside = [F.col("first_id").isNull() | F.col("last_id").isNull()] + [F.lit(i).cast(kind).between(F.col("first_id"), F.col("last_id")) for i in wanted]
    met = inside[0]
    for one in inside[1:]:
        met = met | one

    def run(batches):
        reader = Reader(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for index, arrays in reader.documents(path, wanted):
                    yield pa.RecordBatch.from_arrays(
                        [index["id"].combine_chunks(), pa.array([a.astype(np.int64) for a in arrays], pa.list_(pa.int64()))], names=["doc_id", "ids"]
                    )

    return files.filter(met).select("path").mapInArrow(run, f"doc_id {kind.simpleString()}, ids array<long>")


def round_trip(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Write all documents to a folder of their own in the shared folder and read their digests back."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    write(docs, path, folder, end_id)
    return digests(spark, folder)
