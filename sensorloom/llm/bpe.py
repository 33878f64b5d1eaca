"""BPE encoding and decoding in batched numpy merge rounds.

The symbols of many words lie in one flat array. In every round each word merges its lowest-ranked
pair; pairs are looked up by binary search over sorted pair keys, and only pairs that touch a merge
are looked up again. Each chunk of text (a space and what follows it up to the next space before a
non-space) is encoded once per cache period and then fetched by its number.

Null texts are empty texts; an empty text has no ids. Equal texts and repeated rows give equal ids.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from sensorloom.llm.words import Numbered, forgetting, worker_cache

# The splitting pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

SLICE_CHARS = 1 << 20  # a longer text is encoded in slices, cut where no word can span
CACHE_CHUNKS = 1 << 19  # distinct chunks kept before those used once are forgotten,
CACHE_BYTES = 200 << 20  # or about as many bytes
NO_RANK = np.int32(2**31 - 1)


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    printable = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class _Numbers(Numbered):
    """Chunk -> number; a chunk seen first gets the next number and is listed as pending."""

    def clear(self) -> None:
        super().clear()
        self.pending: list[str] = []

    def __missing__(self, chunk: str) -> int:
        number = self[chunk] = len(self)
        self.pending.append(chunk)
        self.held += 3 * len(chunk) + 220
        return number


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all elements of the segments, segment after segment."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """Encoder and decoder of one vocabulary file's content."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        vocab = spec["model"]["vocab"]
        character = byte_characters()
        self.byte_ids = np.array([vocab[character[b]] for b in range(256)], np.int64)
        keys, made = [], []
        for merge in spec["model"]["merges"]:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            keys.append(vocab[left] << 32 | vocab[right])
            made.append(vocab[left + right])
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys = np.array(keys, np.int64)[order]
        self.ranks = order.astype(np.int32)
        self.made = np.array(made, np.int64)  # by rank
        first = np.full(max(vocab.values()) + 1, -1, np.int64)
        first[self.made[::-1]] = np.arange(len(made))[::-1]
        left_rank, right_rank = first[self.keys >> 32], first[self.keys & 0xFFFFFFFF]
        if (np.maximum(left_rank, right_rank) >= self.ranks).any():
            raise ValueError("a merge precedes the merge that makes its part; rounds would not keep the order of merges")
        pairs = np.arange(1 << 16)
        self.byte_ranks = self._rank(self.byte_ids[pairs >> 8], self.byte_ids[pairs & 255])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        names = sorted(self.special, key=len, reverse=True)
        self.special_split = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.pattern = regex.compile(PATTERN)
        self.boundary = re.compile(r" (?=\S)")
        self.odd_space = re.compile(r" (?:\s|$)")
        byte_of = {c: b for b, c in character.items()}
        pieces = {i: bytes(byte_of[c] for c in token) for token, i in vocab.items()}
        pieces |= {i: token.encode() for token, i in self.special.items()}
        self.n_ids = max(pieces) + 1
        self.bytes_flat, self.bytes_start, self.bytes_len = self._table([pieces.get(i, b"") for i in range(self.n_ids)])
        self.text_flat, self.text_start, self.text_len = self._table([b"%d," % i for i in range(self.n_ids)])
        self.clear()

    def _forget(self):
        """Keep the chunks used more than once."""
        kept = self.numbers.trim()
        lengths = self.lengths[kept]
        self.flat = self.flat[_spread(self.starts[kept], lengths)]
        self.starts, self.lengths, self.used = np.cumsum(lengths) - lengths, lengths, len(self.flat)

    @staticmethod
    def _table(entries: list[bytes]):
        lengths = np.array([len(e) for e in entries], np.int64)
        return np.frombuffer(b"".join(entries), np.uint8), np.cumsum(lengths) - lengths, lengths

    def clear(self):
        """Start the cache of chunks anew."""
        self.numbers = _Numbers()
        self.flat, self.starts, self.lengths, self.used = np.empty(1 << 16, np.uint16 if self.n_ids <= 65536 else np.uint32), np.empty(0, np.int64), np.empty(0, np.int64), 0

    # -- merge rounds -------------------------------------------------------------------------------------------

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def merge_words(self, data: bytes, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words that lie one after the other in ``data`` (byte counts given), and the number of ids of each."""
        raw = np.frombuffer(data, np.uint8).astype(np.int64)
        sym = self.byte_ids[raw]
        word = np.repeat(np.arange(len(counts)), counts)
        rank = np.full(len(sym), NO_RANK, np.int32)  # of the pair that starts here
        rank[:-1] = np.where(word[1:] == word[:-1], self.byte_ranks[raw[:-1] << 8 | raw[1:]], NO_RANK)
        done_sym, done_word = [], []
        while len(sym):
            heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[heads, len(sym)])
            least = np.minimum.reduceat(rank, heads)
            live = np.repeat(least != NO_RANK, sizes)
            done_sym.append(sym[~live])
            done_word.append(word[~live])
            least = np.repeat(least, sizes)[live]
            sym, word, rank = sym[live], word[live], rank[live]
            if not len(sym):
                break
            hit = np.flatnonzero(rank == least)
            # in a run of one symbol every second pair overlaps the one before it
            run_head = np.r_[True, np.diff(hit) != 1]
            offset = hit - np.maximum.accumulate(np.where(run_head, hit, 0))
            hit = hit[offset % 2 == 0]
            sym[hit] = self.made[rank[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            at = hit - np.arange(len(hit))  # where the merged symbols lie afterwards
            sym, word, rank = sym[keep], word[keep], rank[keep]
            touched = np.zeros(len(sym), bool)
            touched[at] = touched[at[at > 0] - 1] = True
            stale = np.flatnonzero(touched)
            rank[stale] = NO_RANK
            stale = stale[stale < len(sym) - 1]
            stale = stale[word[stale] == word[stale + 1]]
            rank[stale] = self._rank(sym[stale], sym[stale + 1])
        sym, word = np.concatenate(done_sym or [sym]), np.concatenate(done_word or [word])
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(counts))

    # -- texts --------------------------------------------------------------------------------------------------

    def _learn(self):
        """Encode the pending chunks and append them to the cache."""
        pending, self.numbers.pending = self.numbers.pending, []
        heads = [k for k, c in enumerate(pending) if c[0] == "\t"]
        chunks = [" " + c for c in pending]
        for k in heads:
            chunks[k] = pending[k][1:]
        # what follows a space can be split in one text with its neighbours; the heads of texts go one by one
        words, at = [], 0
        for k in [*heads, len(chunks)]:
            words += self.pattern.findall("".join(chunks[at:k]))
            if k < len(chunks):
                words += self.pattern.findall(chunks[k])
            at = k + 1
        data = "".join(chunks).encode()
        raw = np.frombuffer(data, np.uint8)
        char_at = np.r_[np.flatnonzero((raw & 0xC0) != 0x80), len(raw)]
        word_ends = char_at[np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))]
        chunk_bytes = char_at[np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)))]
        ids, counts = self.merge_words(data, np.diff(np.r_[0, word_ends]))
        per_chunk = np.diff(np.r_[0, np.searchsorted(word_ends, chunk_bytes, "right")])
        ends = np.r_[0, np.cumsum(counts)]
        chunk_ends = ends[np.cumsum(per_chunk)]
        lengths = np.diff(np.r_[0, chunk_ends])
        need = self.used + len(ids)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(need, self.flat.dtype)])
        self.flat[self.used : need] = ids
        self.starts = np.r_[self.starts, self.used + chunk_ends - lengths]
        self.lengths = np.r_[self.lengths, lengths]
        self.used = need

    def _chunks(self, text: str) -> list[str]:
        """Keys of the text's chunks: what follows each space before a non-space; a text's head is marked by a tab."""
        parts = self.boundary.split(text) if self.odd_space.search(text) else text.split(" ")
        if parts[0]:
            parts[0] = "\t" + parts[0]
            return parts
        return parts[1:]

    def _slices(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > SLICE_CHARS:
            cut = self.boundary.search(text, at + SLICE_CHARS)
            if not cut:
                break
            yield text[at : cut.start()]
            at = cut.start()
        if at < len(text):
            yield text[at:]

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without special tokens, one after the other, and their numbers."""
        numbers, per_text = [], []
        chunks_of, number_of = self._chunks, self.numbers.__getitem__
        for text in texts:
            before = len(numbers)
            if text:
                numbers += map(number_of, chunks_of(text))
            per_text.append(len(numbers) - before)
        if self.numbers.pending:
            self._learn()
        index = np.array(numbers, np.int64)
        lengths = self.lengths[index] if len(index) else index
        ids = self.flat[_spread(self.starts[index], lengths)] if len(index) else self.flat[:0].copy()
        ends = np.r_[0, np.cumsum(lengths)]
        counts = np.diff(ends[np.r_[0, np.cumsum(np.array(per_text, np.int64))]])
        times = np.bincount(index, minlength=len(self.numbers))
        self.numbers.count(np.arange(len(times)), times)
        if len(self.numbers) > CACHE_CHUNKS or self.numbers.held > CACHE_BYTES:
            self._forget()
        return ids, counts

    def encode_batches(self, texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For runs of whole texts (None: empty): their ids one after the other, and the number of ids of each."""
        pieces: list[tuple[int, str | int]] = []  # (text in the run, slice or special id)
        run, chars = 0, 0
        for text in texts:
            for part in self.special_split.split(text or "") if self.special_split else [text or ""]:
                if part in self.special:
                    pieces.append((run, self.special[part]))
                else:
                    pieces += [(run, s) for s in self._slices(part)]
            run, chars = run + 1, chars + len(text or "")
            if chars >= SLICE_CHARS:
                yield self._encode_run(pieces, run)
                pieces, run, chars = [], 0, 0
        if run:
            yield self._encode_run(pieces, run)

    def _encode_run(self, pieces, run: int) -> tuple[np.ndarray, np.ndarray]:
        ids, owners, sizes = [], [], []
        at = 0
        while at < len(pieces):
            upto, chars = at, 0
            while upto < len(pieces) and (upto == at or chars < SLICE_CHARS):
                chars += len(pieces[upto][1]) if isinstance(pieces[upto][1], str) else 0
                upto += 1
            part = pieces[at:upto]
            plain, counts = self._plain([p if isinstance(p, str) else "" for _, p in part])
            if any(not isinstance(p, str) for _, p in part):
                cuts = np.split(plain, np.cumsum(counts)[:-1])
                cuts = [c if isinstance(p, str) else np.array([p], plain.dtype) for c, (_, p) in zip(cuts, part)]
                plain, counts = np.concatenate(cuts), np.array([len(c) for c in cuts])
            ids.append(plain)
            owners += [o for o, _ in part]
            sizes.append(counts)
            at = upto
        counts = np.bincount(owners, np.concatenate(sizes), run).astype(np.int64) if owners else np.zeros(run, np.int64)
        return (np.concatenate(ids) if ids else self.flat[:0].copy()), counts

    def encode(self, text: str | None) -> np.ndarray:
        return next(self.encode_batches([text]))[0]

    # -- back to text -------------------------------------------------------------------------------------------

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for, special tokens included."""
        return self.bytes_flat[_spread(self.bytes_start[ids], self.bytes_len[ids])].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        return self.text_flat[_spread(self.text_start[ids], self.text_len[ids])].tobytes()[:-1]


def loaded(content: bytes) -> Encoder:
    """The worker's encoder for this vocabulary."""
    return worker_cache(("encoder", hash(content)), lambda: Encoder(content))


def vocabulary(spark: SparkSession, path: str):
    """Broadcast of a vocabulary file's content (its size is that of the file, independent of the data)."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``ids`` (array of int) and ``decoded`` (the text rebuilt from the ids)."""
    content = vocabulary(docs.sparkSession, path)

    def run(batches):
        encoder = loaded(content.value)
        for batch in batches:
            done = 0
            for ids, counts in encoder.encode_batches(batch.column(1).to_pylist()):
                cuts = np.split(ids, np.cumsum(counts)[:-1])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(done, len(counts)),
                        pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(ids.astype(np.int32))),
                        pa.array([encoder.decode(c) for c in cuts], pa.string()),
                    ],
                    names=["id", "ids", "decoded"],
                )
                done += len(counts)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(forgetting(run), f"id {kind}, ids array<int>, decoded string")


def token_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number of ids, digest of the ids and digest of the decoded text of every document, made where the ids are made.

    The same rows as hashing the columns of :func:`encode_documents`, without carrying ids and texts to the JVM.
    """
    import hashlib

    content = vocabulary(docs.sparkSession, path)

    def run(batches):
        encoder = loaded(content.value)
        for batch in batches:
            done = 0
            for ids, counts in encoder.encode_batches(batch.column(1).to_pylist()):
                cuts = np.split(ids, np.cumsum(counts)[:-1])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(done, len(counts)),
                        pa.array(counts),
                        pa.array([hashlib.sha256(encoder.decimal(c)).hexdigest() for c in cuts], pa.string()),
                        pa.array([hashlib.sha256(encoder.decode(c).encode()).hexdigest() for c in cuts], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
                done += len(counts)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(
        forgetting(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
