"""A uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows lie in the partitions in which they are read. How many rows each partition sends to each shard is drawn
first, exactly as a uniform permutation of all rows would deal them (a table with the partitions' row counts
and the shards' sizes as margins). Then every partition permutes its rows by itself and cuts them by its matrix row,
rows move to their shard once, and each shard permutes what it got; positions come from ranges of random keys, so that
no task holds a whole shard.

Law ``rows``: shard sizes differ by one at most. The random keys are hashes of a row's id, content and occurrence, so a lost task
draws the same again. Null texts have size 8 and the checksum of the empty text. Null ids and repeated rows are dealt
like any other row. With fewer rows than shards some shards are empty; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.lineage import cut_lineage

SHARDS = 24
SEED = 20240917
RANGE_ROWS = 1 << 16  # rows of a shard that one task orders
NUMPY_LIMIT = 10**9  # population up to which numpy draws exactly


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """Number of good ones in a sample without replacement, from populations of any size.

    Beyond numpy's limit the draw is by inversion from the mode outwards, whose expected number of steps is the
    standard deviation; terms follow from their neighbours, so no large factorial is taken but the mode's.
    """
    if good + bad < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, sample)) if sample else 0
    low, high = max(0, sample - bad), min(good, sample)
    mode = min(high, max(low, (sample + 1) * (good + 1) // (good + bad + 2)))
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    # near the mode the density is that of a normal up to a factor close to one; its log comes from Stirling differences
    p_mode = math.exp(choose(good, mode) + choose(bad, sample - mode) - choose(good + bad, sample)) if good + bad < 1 << 40 else 1 / math.sqrt(2 * math.pi * max(1e-9, _variance(good, bad, sample)))
    left = right = mode
    p_left = p_right = p_mode
    u = rng.random() - p_mode
    while u > 0 and (left > low or right < high):
        if right < high:
            p_right *= (good - right) * (sample - right) / ((right + 1) * (bad - sample + right + 1))
            right += 1
            u -= p_right
            if u <= 0:
                return right
        if left > low:
            p_left *= left * (bad - sample + left) / ((good - left + 1) * (sample - left + 1))
            left -= 1
            u -= p_left
            if u <= 0:
                return left
    return mode


def _variance(good: int, bad: int, sample: int) -> float:
    total = good + bad
    return sample * (good / total) * (bad / total) * (total - sample) / max(1, total - 1)


def communication_matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows that each partition sends to each shard; columns sum to the shard sizes, which differ by one at most."""
    rng = np.random.default_rng(seed)
    total = sum(counts)
    left = [total // shards + (s < total % shards) for s in range(shards)]
    out = []
    for count in counts:
        row, rest, open_rows = [], count, sum(left)
        for s in range(shards):
            take = hypergeometric(rng, left[s], open_rows - left[s], rest)
            open_rows -= left[s]
            left[s] -= take
            rest -= take
            row.append(take)
        out.append(row)
    return out


def _position() -> Column:
    """A row's place in its partition."""
    return F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))


def shuffled_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size (bytes plus 8), text_crc32, shard and slot (gapless from 0 in each shard)."""
    text = docs[text_col]
    rows = docs.select(
        docs[id_col].alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    # the partitions and the order in them are fixed here: the counts, the cuts and the positions see the same
    local = cut_lineage(rows.sortWithinPartitions(F.xxhash64(F.lit(seed), "doc_id", "size", "text_crc32"), "doc_id", "size", "text_crc32"))
    placed = local.select("*", F.spark_partition_id().alias("part"), _position().alias("place"))
    counts = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one number per partition
    parts = sorted(counts)
    matrix = communication_matrix([counts[p] for p in parts], shards, seed)
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("ends", T.ArrayType(T.LongType()))])
    ends = docs.sparkSession.createDataFrame([(p, np.cumsum(m).tolist()) for p, m in zip(parts, matrix)], schema)
    sent = placed.join(ends, "part").select(
        "doc_id", "size", "text_crc32",
        F.size(F.filter("ends", lambda end: end <= F.col("place"))).alias("shard"),
        F.xxhash64(F.lit(seed + 1), "doc_id", "size", "text_crc32", "part", "place").alias("draw"),
    )
    total = sum(counts.values())
    ranges = max(1, -(-total // (shards * RANGE_ROWS)))
    # the draw's range: equal slices of the 64-bit line
    slice_of = F.floor((F.shiftrightunsigned("draw", 11).cast("double") / F.lit(float(1 << 53))) * ranges).cast("int")
    sent = sent.withColumn("slice", slice_of)
    sizes = sent.groupBy("shard", "slice").agg(F.count("*").alias("n"))
    before = sizes.select(
        "shard", "slice", (F.sum("n").over(Window.partitionBy("shard").orderBy("slice")) - F.col("n")).alias("first")
    )
    order = Window.partitionBy("shard", "slice").orderBy(F.shiftrightunsigned("draw", 11), "draw", "doc_id", "text_crc32")
    numbered = sent.join(before, ["shard", "slice"]).withColumn("slot", F.row_number().over(order) - 1 + F.col("first"))
    return numbered.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
