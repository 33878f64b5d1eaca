"""Quality rules as a ledger of failure bits and measurements.

Every rule is evaluated once per document: the ledger stores what was measured and one bit per failed rule. A policy
is a version of a set of rules (a mask); applying it, or leaving a rule out of it, needs the bits only. Ablations are
counted from the table of distinct bit patterns, of which there are few whatever the number of documents.

Words are ``[^\\x20\\x09-\\x0D]+``. Null texts are empty: no words, so ``few_words`` fails. Repeated rows are judged
alike, null ids stay null, an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.words import forgetting, windows, word_hashes

REPEAT_WINDOW = 8
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_stutter")

# rule -> condition of failure on the measurements; a rule's bit is its place here, so rules are only ever appended
RULES: dict[str, Callable[[Mapping[str, Column]], Column]] = {
    "few_words": lambda m: m["n_words"] < 20,
    "repeated_words": lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"],
    "symbols": lambda m: 10 * m["n_symbols"] > m["n_words"],
    "duplicate_lines": lambda m: (m["n_dup_lines"] >= 4) & (100 * m["n_dup_lines"] > 30 * m["n_lines"]),
    "capitals": lambda m: m["n_upper"] > m["n_lower"],
    "short_words": lambda m: m["word_chars"] < 2 * m["n_words"],
    "long_words": lambda m: m["word_chars"] > 20 * m["n_words"],
    "stutter": lambda m: 100 * m["n_stutter"] > 20 * m["n_words"],
}
BASE = ("few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    """A version of the rules that documents must pass."""

    name: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return reduce(lambda mask, rule: mask | 1 << list(RULES).index(rule), self.rules, 0)


POLICIES = {p.name: p for p in (Policy("base-1", BASE), Policy("full-1", tuple(RULES)))}


def measured(text: str | None) -> tuple[int, ...]:
    """``MEASURES`` of a whole text."""
    if not text:
        return (0,) * len(MEASURES)
    words = word_hashes(text)
    n = len(words)
    runs = windows(words, REPEAT_WINDOW)
    repeated = 0
    if len(runs) > 1:
        order = np.argsort(runs, kind="stable")
        same = runs[order[1:]] == runs[order[:-1]]
        again = np.unique(np.r_[order[1:][same], order[:-1][same]])
        cover = np.zeros(n + 1, np.int64)
        cover[again] += 1
        cover[again + REPEAT_WINDOW] -= 1
        repeated = int((np.cumsum(cover[:n]) > 0).sum())
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    raw = np.frombuffer(text.encode(), np.uint8)
    return (
        n,
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        int(((raw >= 65) & (raw <= 90)).sum()),
        int(((raw >= 97) & (raw <= 122)).sum()),
        int((words[1:] == words[:-1]).sum()),
    )


def failure_bits(measures: Mapping[str, Column]) -> Column:
    """The bits of the failed rules, from the measurements."""
    bits = (F.when(failed(measures), F.lit(1 << k)).otherwise(F.lit(0)) for k, failed in enumerate(RULES.values()))
    return reduce(lambda a, b: a.bitwiseOR(b), bits).cast("long")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, the measurements and ``failed_bits``."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                columns = list(zip(*map(measured, part.column(1).to_pylist())))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", *MEASURES])

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(
        forgetting(run), ", ".join([f"doc_id {kind}", *(f"{m} long" for m in MEASURES)])
    )
    return found.withColumn("failed_bits", failure_bits({m: F.col(m) for m in MEASURES}))


def passes(policy: Policy, bits: Column | None = None) -> Column:
    """Whether a row of the ledger passes a policy."""
    return (F.col("failed_bits") if bits is None else bits).bitwiseAND(F.lit(policy.mask)) == 0


def ablations(entries: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail it alone, and that are kept with and without it."""
    patterns = entries.groupBy("failed_bits").agg(F.count("*").alias("n"))
    names = list(RULES)
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for r in policy.rules)))
    rows = patterns.select("n", F.col("failed_bits").bitwiseAND(F.lit(policy.mask)).alias("bits"), rules.alias("r")).select("n", "bits", "r.*")
    n_if = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0))
    return rows.groupBy("rule").agg(
        n_if(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        n_if(F.col("bits") == F.col("bit")).alias("n_failed_alone"),
        n_if(F.col("bits") == 0).alias("n_kept"),
        n_if((F.col("bits") == 0) | (F.col("bits") == F.col("bit"))).alias("n_kept_without"),
    )


def kept_rows(docs: DataFrame, policy: Policy, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass a policy, with all their columns."""

    @F.pandas_udf(", ".join(f"{m} long" for m in MEASURES))
    def measure(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measured(t) for t in texts], columns=list(MEASURES))

    found = measure(docs[text_col])
    return docs.filter(passes(policy, failure_bits({m: found[m] for m in MEASURES})))
