"""Packing documents into training windows with lexically similar neighbours.

Every document is encoded once, by the compiled encoder where it bears the text, and ends with id 0. Its whole windows are sequences of their own; what is left
(its tail) is a unit of the retrieval. Units are dealt into shards of similar size by the rarest tokens they hold,
so that similar units lie in one shard; each shard builds a BM25 inverted index over its units, with document
frequencies and the mean length counted over all units. In a shard, a seed's window is filled greedily with the
unused unit that scores best; a unit that does not fit whole is cut, and its rest seeds the next window. So every
window is full but the last of each shard.

Null texts are empty: such a document is the single id 0. Repeated rows are documents of their own. A null id stays
null. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.lineage import stored
from sensorloom.llm import bpe, token_files
from sensorloom.llm.words import forgetting

WINDOW = 1024
SHARD_TOKENS = 1 << 20  # tail tokens of one shard, which one task packs in memory
END = 0  # the id that ends every document
ROWS = 512  # documents of a batch that is sent on
QUERY_TERMS = 32  # a seed is queried by its terms of highest weight
K1, B = 1.2, 0.75


@dataclass(frozen=True)
class Statistics:
    """Corpus statistics of BM25; ``frequency`` has one entry per vocabulary id."""

    units: int
    tokens: int
    frequency: np.ndarray

    def idf(self) -> np.ndarray:
        return np.log1p((self.units - self.frequency + 0.5) / (self.frequency + 0.5))


def units(docs: DataFrame, path: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: number of ids, checksums of its whole windows, the tail's ids (little-endian) and its routing key."""
    content = bpe.vocabulary(docs.sparkSession, path)

    def run(batches):
        encoder = token_files.loaded(content.value)
        for batch in batches:
            for done in range(0, batch.num_rows, ROWS):
                rows = tails(encoder, batch.column(1).slice(done, ROWS).to_pylist(), window)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(done, len(rows["key"])),
                        pa.array(rows["doc_tokens"], pa.int64()),
                        pa.array(rows["full_crcs"], pa.list_(pa.int64())),
                        pa.array(rows["tail"], pa.binary()),
                        pa.array(rows["key"], pa.int64()),
                    ],
                    names=["doc_id", "doc_tokens", "full_crcs", "tail", "key"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(
        forgetting(run), f"doc_id {kind}, doc_tokens long, full_crcs array<long>, tail binary, key long"
    )


def tails(encoder: token_files.Ids, texts: list, window: int) -> dict[str, list]:
    """The columns of :func:`units` but for the id."""
    rows = {"doc_tokens": [], "full_crcs": [], "tail": [], "key": []}
    for text in texts:
        own = np.append(encoder.of(text), END).astype("<u4")
        whole = len(own) // window
        data = own.tobytes()
        rows["doc_tokens"].append(len(own))
        rows["full_crcs"].append([zlib.crc32(data[4 * window * k : 4 * window * (k + 1)]) for k in range(whole)])
        tail = own[whole * window :]
        rows["tail"].append(tail.astype(encoder.dtype).tobytes())
        rows["key"].append(routing_key(tail))
    return rows


def routing_key(tail: np.ndarray) -> int:
    """The three highest ids as one number: a vocabulary numbers its tokens from frequent to rare."""
    key, rest = 0, tail
    for _ in range(3):
        top = int(rest.max()) if len(rest) else 0
        key = key << 20 | top
        rest = rest[rest < top]
    return key


def statistics(table: DataFrame, n_ids: int) -> Statistics:
    """Unit and token totals and unit frequency per id; the driver gets one row per vocabulary id."""

    def run(batches):
        frequency, total, tokens = np.zeros(n_ids, np.int64), 0, 0
        for batch in batches:
            for tail in batch.column(0).to_pylist():
                ids = np.frombuffer(tail, _kind(n_ids))
                if len(ids):
                    frequency[np.unique(ids)] += 1
                    total, tokens = total + 1, tokens + len(ids)
        seen = np.flatnonzero(frequency)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[seen, -1, -2]), pa.array(np.r_[frequency[seen], total, tokens])], names=["id", "n"]
        )

    rows = table.select("tail").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    found = {r["id"]: r["n"] for r in rows}
    frequency = np.zeros(n_ids, np.int64)
    for i, n in found.items():
        if i >= 0:
            frequency[i] = n
    return Statistics(found.get(-1, 0), found.get(-2, 0), frequency)


def _kind(n_ids: int) -> str:
    return "<u2" if n_ids <= 65536 else "<u4"


class Index:
    """BM25 inverted index of one shard's units."""

    def __init__(self, tails: list[np.ndarray], stats: Statistics):
        n_ids = len(stats.frequency)
        lengths = np.array([len(t) for t in tails], np.int64)
        owner = np.repeat(np.arange(len(tails)), lengths)
        pairs, tf = np.unique(np.concatenate(tails).astype(np.int64) * len(tails) + owner if len(tails) else np.empty(0, np.int64), return_counts=True)
        terms, self.unit = np.divmod(pairs, max(1, len(tails)))
        self.starts = np.searchsorted(terms, np.arange(n_ids + 1))
        idf = stats.idf()
        mean = stats.tokens / max(1, stats.units)
        self.weight = idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[self.unit] / mean))
        # a unit's own terms of highest weight are its query, without the end token, which every unit holds
        order = np.lexsort((terms, -self.weight, self.unit))
        order = order[terms[order] != END]
        heads = np.searchsorted(self.unit[order], np.arange(len(tails) + 1))
        self.queries = [terms[order[heads[k] : min(heads[k + 1], heads[k] + QUERY_TERMS)]] for k in range(len(tails))]
        self.n = len(tails)

    def met(self, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Units that hold a term of the seed's query, ascending, and their scores."""
        spans = [slice(self.starts[t], self.starts[t + 1]) for t in self.queries[seed]]
        if not spans:
            return np.empty(0, np.int64), np.empty(0)
        scores = np.bincount(np.concatenate([self.unit[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.n)
        units = np.flatnonzero(scores)
        return units, scores[units]

    def scores(self, seed: int) -> np.ndarray:
        """Scores of all units."""
        out = np.zeros(self.n)
        units, found = self.met(seed)
        out[units] = found
        return out

    def neighbours(self, seed: int) -> np.ndarray:
        """The units met, the most similar first (the first unit where scores are equal)."""
        units, found = self.met(seed)
        return units[np.argsort(-found, kind="stable")]


def fill_windows(tails: list[np.ndarray], stats: Statistics, window: int) -> list[tuple[int, int, int, int, int]]:
    """(unit, first id, number of ids, window number, offset in the window) of each piece; every id once."""
    index = Index(tails, stats)
    unused = np.array([len(t) > 0 for t in tails], bool)
    pieces, number, offset, after = [], 0, 0, 0
    seed, at = -1, 0  # the unit in hand and its first id that is not yet placed
    similar: Iterator[int] = iter(())
    while True:
        if seed < 0:  # a new window, or nothing similar is left: the next unused unit
            while after < len(tails) and not unused[after]:
                after += 1
            if after == len(tails):
                break
            seed, at = after, 0
            unused[seed] = False
        if offset == 0:
            similar = iter(index.neighbours(seed).tolist())
        take = min(window - offset, len(tails[seed]) - at)
        pieces.append((seed, at, take, number, offset))
        at, offset = at + take, offset + take
        if offset == window:
            number, offset = number + 1, 0
            if at == len(tails[seed]):
                seed = -1
            continue
        seed, at = next((k for k in similar if unused[k]), -1), 0
        if seed >= 0:
            unused[seed] = False
    return pieces


def pack(docs: DataFrame, path: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: which ids of which document lie where in which sequence, with their checksum."""
    content = bpe.vocabulary(docs.sparkSession, path)
    n_ids = bpe.Encoder(content.value).n_ids
    kind = _kind(n_ids)
    table = stored(units(docs, path, window, id_col, text_col), "packing-units")
    stats = statistics(table, n_ids)
    shared = docs.sparkSession.sparkContext.broadcast(stats)  # one number per vocabulary id
    id_type = table.schema["doc_id"].dataType.simpleString()

    def run(batches):
        rows, id_kind = [], None
        for batch in batches:
            id_kind = batch.column(0).type
            rows += zip(*(c.to_pylist() for c in batch.columns))
        if not rows:
            return
        shard = TaskContext.get().partitionId() << 32
        rows.sort(key=lambda r: (r[4], r[0] is None, r[0], r[3]))  # the same order whenever the task runs again
        tails = [np.frombuffer(r[3], kind) for r in rows]
        out, sequence = [], 0
        for doc_id, doc_tokens, crcs, _, _ in rows:
            for k, crc in enumerate(crcs):
                out.append((doc_id, k * window, window, crc, doc_tokens, shard + sequence, 0))
                sequence += 1
        for unit, first, length, number, offset in fill_windows(tails, shared.value, window):
            doc_id, doc_tokens = rows[unit][0], rows[unit][1]
            crc = zlib.crc32(tails[unit][first : first + length].astype("<u4").tobytes())
            out.append((doc_id, doc_tokens - len(tails[unit]) + first, length, crc, doc_tokens, shard + sequence + number, offset))
        for at in range(0, len(out), 1 << 16):
            columns = list(zip(*out[at : at + (1 << 16)]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], id_kind), *(pa.array(c, pa.int64()) for c in columns[1:])],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    shards = max(1, -(-stats.tokens // SHARD_TOKENS))
    # equal keys are told apart by the id, so that a large group of copies is dealt over several shards
    dealt = table.repartitionByRange(shards, "key", F.xxhash64("doc_id", "tail"))
    return dealt.mapInArrow(
        run, f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
