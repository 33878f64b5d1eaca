"""Which filter removes what, under every order of five filters, by min-plus removal ranks.

Each document becomes a mask of the filters it fails. A mask matrix (0 where a filter fails, infinity elsewhere) and the
matrix of inverse permutations (the step at which each filter runs in each order) are combined by minimum of sums; the
result is the step at which a document of that mask goes, in every order at once. Documents are counted by part and mask
in Spark, and the removal steps scatter these counts over orders and steps.

Only the filter on copies looks beyond one text. It needs no join of equal texts: of the rows of one text just those
with its smallest id pass, and these are met by an equality join on text digest and id, which no frequent text makes uneven.

Null texts are empty texts; an empty text fails A, and B, C, D pass (nothing exceeds zero). Texts are read whole, long ones
slice by slice. Rows of one text and one id (repeated rows) do not remove each other; each counts. A null id is neither
smaller nor larger than another: such rows pass E and fail no other row. Null parts count under the empty string. A document
is good or toxic if any of its labels says so; rated ids may repeat, null ids have no labels. An empty table gives no rows.
Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.lineage import stored
from sensorloom.llm.words import split_words

FILTERS = "ABCDE"
MIN_WORDS = 200
DISTINCT_PERCENT = 50
UPPER_PERCENT = 2
SYMBOLS = re.compile(rb"[#$%&*|]")
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"

COPY_BIT = 1 << FILTERS.index("E")
WEIGHTS = ("n", "good", "toxic")
ORDERS = ["".join(order) for order in permutations(FILTERS)]


def text_mask(text: str) -> int:
    """Bits of the filters A to D that a whole text fails."""
    n_words, distinct, n_upper, symbol = 0, set(), 0, False
    for words in split_words(text):
        n_words += len(words)
        distinct.update(words)
    data = text.encode()
    n_upper = len(data) - len(data.translate(None, UPPER))
    symbol = SYMBOLS.search(data) is not None
    failed = (n_words < MIN_WORDS, 100 * len(distinct) < DISTINCT_PERCENT * n_words, 100 * n_upper > UPPER_PERCENT * len(text), symbol)
    return sum(1 << bit for bit, fails in enumerate(failed) if fails)


def removal_steps(n_filters: int = len(FILTERS)) -> np.ndarray:
    """(mask, order) -> step from 0 at which a document of the mask goes; ``n_filters`` where it stays."""
    masks = np.arange(1 << n_filters)
    cost = np.where(masks[:, None] >> np.arange(n_filters) & 1, 0.0, np.inf)
    position = np.argsort(np.array(list(permutations(range(n_filters)))), axis=1)  # inverse permutations
    return np.minimum((cost[:, None, :] + position[None, :, :]).min(axis=2), n_filters).astype(np.int64)


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, mask, key) of every row: the mask of A to D and a digest of the whole text."""

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([text_mask(t) for t in texts], pa.int32()),
                    pa.array([hashlib.sha256(t.encode()).digest() for t in texts], pa.binary()),
                ],
                names=["id", "part", "mask", "key"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(docs[id_col].alias("id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), docs[text_col].alias("text"))
    return chosen.mapInArrow(run, f"id {kind}, part string, mask int, key binary")


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask of all five filters, n, good, toxic): rows, good rows and toxic rows. One row per part and mask."""
    rated = labels.groupBy(labels["doc_id"].alias("id")).agg(
        F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic")
    )
    # one row per (text, id, part), so that repeated rows do not gather in a join; read twice, so written once
    alike = marked(docs, id_col, text_col, part_col).groupBy("id", "part", "mask", "key").agg(F.count("*").alias("n"))
    rows = stored(alike.join(rated, "id", "left").na.fill(0, ["good", "toxic"]), "filter-masks")
    weights = [F.col("n"), F.col("n") * F.col("good"), F.col("n") * F.col("toxic")]
    sums = [F.sum(w).alias(name) for w, name in zip(weights, WEIGHTS)]
    every = rows.groupBy("part", "mask").agg(*sums)
    least = rows.groupBy("key").agg(F.min("id").alias("id")).filter("id IS NOT NULL")
    first = rows.join(least, ["key", "id"], "left_semi").unionByName(rows.filter("id IS NULL")).groupBy("part", "mask").agg(*sums)
    copies = every.unionByName(first.select("part", "mask", *((-F.col(w)).alias(w) for w in WEIGHTS)))
    copies = copies.withColumn("mask", F.col("mask").bitwiseOR(F.lit(COPY_BIT)))
    return first.unionByName(copies).groupBy("part", "mask").agg(*(F.sum(w).alias(w) for w in WEIGHTS))


def scattered(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Figures of all orders and steps, shaped (part, order, step), from counts shaped (weight, part, mask)."""
    n_filters, steps = len(FILTERS), removal_steps()
    order = np.array([[FILTERS.index(f) for f in name] for name in ORDERS])
    gone = steps[:, :, None] == np.arange(n_filters)  # mask, order, step
    removed, good, toxic = (np.tensordot(c, gone.astype(np.int64), axes=(1, 0)) for c in counts)
    fails = (np.arange(1 << n_filters)[:, None, None] >> order[None] & 1).astype(bool)
    earlier = fails & (steps[:, :, None] < np.arange(n_filters))
    alone = counts[0][:, 1 << order]
    by_filter = np.zeros((counts.shape[1], n_filters), np.int64)
    np.add.at(by_filter, (slice(None), order), removed)
    return {
        "kept": counts[0].sum(axis=1)[:, None, None] - removed.cumsum(axis=2),
        "removed": removed,
        "redundant": np.tensordot(counts[0], earlier.astype(np.int64), axes=(1, 0)),
        "unique_fails": alone,
        "good_lost": good,
        "toxic_lost": toxic,
        "shapley": by_filter[:, order],
    }


def audit(counts: DataFrame) -> DataFrame:
    """One row per part, order and step from the counts of :func:`mask_counts`; a part is 600 rows made in one place."""
    n_masks = 1 << len(FILTERS)
    sums = [F.sum(F.when(F.col("mask") == m, F.col(w)).otherwise(0)) for w in WEIGHTS for m in range(n_masks)]
    parts = counts.groupBy("part").agg(F.array(*sums).alias("counts"))
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def run(batches):
        per_part = len(ORDERS) * len(FILTERS)
        orders = pa.array(np.repeat(np.array(ORDERS, object), len(FILTERS)), pa.string())
        steps = pa.array(np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS)))
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                held = np.array(some.column(1).to_pylist(), np.int64).reshape(some.num_rows, len(WEIGHTS), n_masks).transpose(1, 0, 2)
                found = scattered(held)
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0).take(pa.array(np.repeat(np.arange(some.num_rows), per_part))),
                        pa.concat_arrays([orders] * some.num_rows),
                        pa.concat_arrays([steps] * some.num_rows),
                        *(pa.array(found[name].ravel()) for name in names),
                    ],
                    names=["part", "filter_order", "step", *names],
                )

    return parts.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{n} long" for n in names))
