"""Token counts for every context limit from one exact histogram of encoded lengths.

Documents are aggregated by encoded length where they are encoded; the histogram has one row per distinct length
(far fewer than documents), and suffix sums over it answer totals, quantiles and truncated totals for every limit.

Null and empty texts have length 0. Repeated rows count each. An empty table gives an empty histogram.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from sensorloom.lineage import stored
from sensorloom.llm import bpe
from sensorloom.llm.words import forgetting

LENGTH_BITS = 12  # lengths with the same leading part share one window of the suffix sums


def length_histogram(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """(length, n_docs) over all documents, written once; every task sends one row per length it has met."""
    content = bpe.vocabulary(docs.sparkSession, path)

    def run(batches):
        encoder = bpe.loaded(content.value)
        for batch in batches:
            counts = np.concatenate([np.empty(0, np.int64), *(c for _, c in encoder.encode_batches(batch.column(0).to_pylist()))])
            lengths, n = np.unique(counts, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(lengths), pa.array(n)], names=["length", "n_docs"])

    found = docs.select(docs[text_col].alias("text")).mapInArrow(forgetting(run), "length long, n_docs long")
    return stored(found.groupBy("length").agg(F.sum("n_docs").alias("n_docs")), "length-histogram")


def context_report(histogram: DataFrame) -> DataFrame:
    """For every length that occurs, taken as a context limit: documents and tokens at or above it and in total.

    ``truncated_tokens`` is what is left of all tokens when each document is cut at that limit; for a limit between
    two lengths it grows linearly with slope ``n_docs_above``. ``quantile`` is the share of documents not longer.
    The suffix sums run in two levels: within blocks of lengths, and over the blocks' totals.
    """
    block = F.shiftright("length", LENGTH_BITS)
    rows = histogram.withColumn("block", block)
    tokens = F.col("length") * F.col("n_docs")
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum(tokens).alias("block_tokens"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("block_docs").over(later), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("block_tokens").over(later), F.lit(0)).alias("later_tokens"),
        F.sum("block_docs").over(every).alias("all_docs"),
        F.sum("block_tokens").over(every).alias("all_tokens"),
    )
    down = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = rows.join(blocks, "block")
    at_least = joined.withColumns(
        {
            "n_docs_from": F.sum("n_docs").over(down) + F.col("later_docs"),
            "tokens_from": F.sum(tokens).over(down) + F.col("later_tokens"),
        }
    )
    return at_least.select(
        "length",
        "n_docs",
        "n_docs_from",
        "tokens_from",
        (F.col("n_docs_from") - F.col("n_docs")).alias("n_docs_above"),
        (F.col("all_tokens") - F.col("tokens_from") + F.col("length") * F.col("n_docs_from")).alias("truncated_tokens"),
        ((F.col("all_docs") - F.col("n_docs_from") + F.col("n_docs")) / F.col("all_docs")).alias("quantile"),
        F.col("all_docs").alias("total_docs"),
        F.col("all_tokens").alias("total_tokens"),
    )
