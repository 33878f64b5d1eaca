"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Every text becomes hashed features: presence of its lower-cased words and their starts, share of its word shapes,
and classes of its repetition. One weight vector is shared by all grades, and ordered thresholds t_1 <= t_2 give
P(grade >= k) = sigmoid(w . x - t_k); their sum is the expected grade, the last one the tail probability by which
documents are selected. The model is fitted in one task on a bounded sample of rated documents (``MAX_TRAIN``, those
with the least hash of their id) and applied to all documents.

Grades: 0 poor, 1 fluent but toxic, 2 good; of several ratings of a document the lowest counts, ratings without
quality are left out and a null toxicity is none. Without any rating every document has probability 1 and is kept.
Null and empty texts have no words; they are scored by their repetition class alone, like any other text. Repeated
rows get equal scores.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm.words import CACHE_BYTES, Numbered, forgetting, split_words, worker_cache

MAX_TRAIN = 16_000  # rated documents that the model is fitted on, at most
DIMENSIONS = 1 << 18
MIN_DOCUMENTS = 4  # a feature of fewer rated documents gets no weight,
MIN_SCORE = 4.0  # nor one whose documents reach each grade as often as all do, within so many standard errors
START_BYTES = 5
PENALTY = 1e-5
STEPS = 400
FREQUENT = 10  # features of at least one in so many rated documents are fitted as a dense matrix, at most 40 bytes a feature value
SELECT_AT = 0.5

_EDGES = b".,;:!?\"'()[]{}<>|*#$%&_-"
_SHAPES = [(re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[0-9]+"), b"0"), (re.compile(rb"([^aA0])\1+"), rb"\1")]


def _bucket(name: bytes) -> int:
    return xxhash.xxh3_64_intdigest(name) % DIMENSIONS


class _Features(Numbered):
    """Word -> number; ``word``, ``start`` and ``shape`` hold its features by number."""

    def clear(self) -> None:
        super().clear()
        self.word, self.start, self.shape = [], [], []

    def forget(self) -> None:
        """Keep the words used more than once."""
        held = self.word, self.start, self.shape
        kept = self.trim().tolist()
        self.word, self.start, self.shape = ([of[k] for k in kept] for of in held)

    def __missing__(self, raw: bytes) -> int:
        number = self[raw] = len(self.word)
        self.held += len(raw) + 290
        shape = raw
        for pattern, sign in _SHAPES:
            shape = pattern.sub(sign, shape)
        word = raw.lower().strip(_EDGES)
        self.word.append(_bucket(b"w" + word))
        self.start.append(_bucket(b"p" + word[:START_BYTES]))
        self.shape.append(_bucket(b"s" + shape))
        return number


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct feature numbers of a whole text and their values."""
    seen = worker_cache("word features", _Features)
    if seen.held > CACHE_BYTES:
        seen.forget()
    number = seen.__getitem__
    parts = [np.fromiter(map(number, words), np.int64, len(words)) for words in split_words(text or "")]
    words = np.concatenate(parts) if parts else np.empty(0, np.int64)
    distinct, counts = _counted(words)
    seen.count(distinct, counts)
    n = len(words)
    found = distinct.tolist()
    word = np.array([seen.word[k] for k in found] + [seen.start[k] for k in found], np.int64)
    shape = np.array([seen.shape[k] for k in found], np.int64)
    word = np.sort(word)
    word = word[np.r_[True, word[1:] != word[:-1]]] if n else word
    order = np.argsort(shape, kind="stable")
    shapes, sizes = _counted(shape)
    share = np.add.reduceat(counts[order] / n, np.cumsum(sizes) - sizes) if n else np.empty(0)
    repeat = int(10 * (words[1:] == words[:-1]).mean()) if n > 1 else 0
    fresh = int(10 * len(distinct) / n) if n else 0
    size = min(8, n.bit_length() // 2)
    classes = np.array([_bucket(b"r%d" % repeat), _bucket(b"f%d,%d" % (fresh, size))])
    index = np.concatenate([word, shapes, classes])
    value = np.concatenate([np.ones(len(word)), 4 * share, np.ones(2)])
    order = np.argsort(index, kind="stable")
    index, value = index[order], value[order]
    heads = np.flatnonzero(np.r_[True, index[1:] != index[:-1]])
    return index[heads], np.add.reduceat(value, heads)


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and their counts."""
    if not len(values):
        return values, values
    ordered = np.sort(values)
    heads = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    return ordered[heads], np.diff(np.r_[heads, len(ordered)])


@dataclass(frozen=True)
class Model:
    """Weights of the features that have one, and the ordered thresholds."""

    index: np.ndarray
    weight: np.ndarray
    thresholds: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros(DIMENSIONS)
        out[self.index] = self.weight
        return out


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit(grades: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], n_grades: int = 3) -> Model:
    """Maximum penalised likelihood by gradient steps with adapted step sizes (Adam)."""
    owner = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
    index = np.concatenate([i for i, _ in rows]).astype(np.int64)
    value = np.concatenate([v for _, v in rows]).astype(np.float64)
    count = np.bincount(index, minlength=DIMENSIONS)
    often = np.zeros(DIMENSIONS, bool)
    for k in range(1, n_grades):
        above = grades >= k
        differs = np.bincount(index, above[owner] - above.mean(), DIMENSIONS)
        often |= np.abs(differs) >= MIN_SCORE * np.sqrt(count) * max(above.std(), 1e-9)
    often &= count >= MIN_DOCUMENTS
    columns = np.flatnonzero(often)
    keep = often[index]
    owner, value = owner[keep], value[keep]
    index = np.searchsorted(columns, index[keep])
    n, d = len(grades), len(columns)
    frequent = np.bincount(index, minlength=d) * FREQUENT >= n
    wide = np.flatnonzero(frequent)
    dense = np.zeros((n, len(wide)), np.float32)
    held = frequent[index]
    dense[owner[held], np.searchsorted(wide, index[held])] = value[held]
    owner, index, value = owner[~held], index[~held], value[~held]
    top = n_grades - 1
    # thresholds start at the shares of the grades; the differences are kept positive as exponentials
    above = np.array([(grades >= k).mean() for k in range(1, n_grades)]).clip(1e-3, 1 - 1e-3)
    start = np.maximum.accumulate(-np.log(above / (1 - above)) + 1e-3 * np.arange(top))
    state = np.r_[np.zeros(d), start[0], np.log(np.diff(start) + 1e-2)]
    first, second = np.zeros_like(state), np.zeros_like(state)
    for step in range(1, STEPS + 1):
        weight = state[:d]
        gaps = np.exp(state[d + 1 :])
        thresholds = state[d] + np.r_[0, np.cumsum(gaps)]
        score = np.bincount(owner, value * weight[index], n) + dense @ weight[wide].astype(np.float32)
        tail = np.c_[np.ones(n), _sigmoid(score[:, None] - thresholds), np.zeros(n)]
        density = tail * (1 - tail)
        at = np.arange(n)
        p = (tail[at, grades] - tail[at, grades + 1]).clip(1e-12)
        d_low, d_high = density[at, grades] / p, density[at, grades + 1] / p
        d_score = -(d_low - d_high) / n
        d_threshold = np.zeros(top + 2)
        np.add.at(d_threshold, grades, d_low / n)
        np.add.at(d_threshold, grades + 1, -d_high / n)
        d_threshold = d_threshold[1:-1]
        d_weight = np.bincount(index, value * d_score[owner], d) + PENALTY * weight
        d_weight[wide] += d_score.astype(np.float32) @ dense
        gradient = np.r_[
            d_weight,
            d_threshold.sum(),
            [d_threshold[k:].sum() * gaps[k - 1] for k in range(1, top)],
        ]
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        rate = 0.05 * (1 if step < STEPS // 2 else 2 - 2 * step / STEPS)
        state -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return Model(columns, state[:d], state[d] + np.r_[0, np.cumsum(np.exp(state[d + 1 :]))])


def ratings(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from quality and toxicity labels."""
    grade = F.when(labels["quality"] == 0, 0).when(F.coalesce(labels["toxic"], F.lit(0)) == 1, 1).otherwise(2)
    rated = labels.filter(labels["quality"].isNotNull() & labels["doc_id"].isNotNull())
    return rated.groupBy(rated["doc_id"]).agg(F.min(grade).cast("int").alias("grade"))


def train(docs: DataFrame, rated: DataFrame, max_train: int = MAX_TRAIN, n_grades: int = 3, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most ``max_train`` rated documents; ``rated`` has columns doc_id and grade."""
    sample = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    chosen = source.join(F.broadcast(sample), "doc_id").select("doc_id", "grade", "text")  # at most max_train small rows

    def extract(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [features(t) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).cast(pa.string()),
                        part.column(1),
                        pa.array([i.tolist() for i, _ in found], pa.list_(pa.int32())),
                        pa.array([v.tolist() for _, v in found], pa.list_(pa.float32())),
                    ],
                    names=["doc_id", "grade", "index", "value"],
                )

    def learn(batches):
        rows = []
        for batch in batches:
            ids, grades = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows += zip(ids, grades, (x.values.to_numpy() for x in batch.column(2)), (x.values.to_numpy() for x in batch.column(3)))
        if not rows:
            return
        rows.sort(key=lambda r: (r[0], r[1], len(r[2])))  # the same sums whenever the task runs again
        model = fit(np.array([r[1] for r in rows], np.int64), [(r[2], r[3]) for r in rows], n_grades)
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.index.tolist()], pa.list_(pa.int32())), pa.array([model.weight.tolist()], pa.list_(pa.float64())), pa.array([model.thresholds.tolist()], pa.list_(pa.float64()))],
            names=["index", "weight", "thresholds"],
        )

    extracted = chosen.mapInArrow(forgetting(extract), "doc_id string, grade int, index array<int>, value array<float>")
    fitted = extracted.repartition(1).mapInArrow(learn, "index array<int>, weight array<double>, thresholds array<double>").collect()
    if not fitted:
        return Model(np.empty(0, np.int64), np.empty(0), np.full(n_grades - 1, -50.0))
    model = fitted[0]
    return Model(np.array(model["index"], np.int64), np.array(model["weight"]), np.array(model["thresholds"]))


def scorer(spark: SparkSession, model: Model):
    """Function of a text column: struct of ``expected`` (grade) and ``tail`` (probability of the highest grade)."""
    shared = spark.sparkContext.broadcast(model)  # at most one weight per hashed feature

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def run(batches):
            weight = shared.value.dense()
            for texts in batches:
                total = np.empty(len(texts))
                for k, text in enumerate(texts):
                    index, value = features(text)
                    total[k] = weight[index] @ value
                tail = _sigmoid(total[:, None] - shared.value.thresholds)
                yield pd.DataFrame({"expected": tail.sum(axis=1), "tail": tail[:, -1]})

        yield from forgetting(run)(batches)

    return F.pandas_udf(score, "expected double, tail double")


def graded(docs: DataFrame, model: Model, select_at: float = SELECT_AT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, expected_grade, tail_probability and kept."""
    grade = scorer(docs.sparkSession, model)
    scored = docs.select(docs[id_col].alias("doc_id"), grade(docs[text_col]).alias("grade"))
    return scored.select(
        "doc_id", F.col("grade.expected").alias("expected_grade"), F.col("grade.tail").alias("tail_probability"), (F.col("grade.tail") >= select_at).alias("kept")
    )


def selected(docs: DataFrame, model: Model, select_at: float = SELECT_AT, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose tail probability reaches ``select_at``, with all their columns."""
    grade = scorer(docs.sparkSession, model)
    return docs.filter(grade(docs[text_col])["tail"] >= select_at)
