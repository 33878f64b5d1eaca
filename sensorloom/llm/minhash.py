"""Near-duplicate documents by b-bit MinHash.

A document's set are its distinct word shingles (as 64-bit hashes). Documents with equal sets form a class and are
handled once. Of each class's minima under ``PERMUTATIONS`` hash functions only the low two bits are kept, packed into
64-bit words; hashes of ``ROWS`` full minima at a time are the band keys. Classes that share a band key are
candidates. The share of equal low bits, corrected for chance equality of two bits, estimates the similarity by bit
counts; candidates that can reach the threshold within ``MARGIN`` are confirmed on their full sets.

A band's bucket is never expanded into its pairs. First each member meets the bucket's least and greatest member,
and the most promising of all its partners is confirmed. Buckets that then still hold several components go on in
blocks of about ``MEMBERS`` members and ``SHINGLES`` shingles: a task compares the members of two blocks in place, first
by their packed bits and then, where some pair across components is promising, by their full sets, and sends only links
that join components. Members of a bucket's largest component need not meet each other; they are sent once per block of
the others, and the others once per block. So every promising pair across components is tested on full sets.

Null, empty and word-less texts have an empty set and are linked with nothing. Repeated rows stay rows of their own;
a row with a null id is linked with nothing, has a null component and is kept. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.lineage import stored
from sensorloom.llm.graph import components
from sensorloom.llm.words import ODD, forgetting, mixed, shingle_set

ROWS, BANDS = 4, 28  # a pair of similarity 0.8 shares no band with a chance of 4e-7
PERMUTATIONS = ROWS * BANDS
BITS = 2
LANES = 32  # kept minima per 64-bit word
WORDS = -(-PERMUTATIONS // LANES)
MARGIN = 0.2  # over four standard deviations of the estimate at similarity 0.8
BLOCK = 1 << 16  # shingles whose minima are taken at a time
MEMBERS = 1024  # members of a bucket's block, and
SHINGLES = 1 << 20  # shingles, but for a member that has more by itself

_RANDOM = np.random.default_rng(7)
FACTORS = _RANDOM.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _RANDOM.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """Minimum of each hash function over each non-empty set; one row per set."""
    out = np.empty((len(sets), PERMUTATIONS), np.uint64)
    lengths = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    starts = np.cumsum(lengths) - lengths
    at = 0
    while at < len(sets):
        upto = max(at + 1, int(np.searchsorted(starts, starts[at] + BLOCK)))
        values = flat[starts[at] : starts[upto - 1] + lengths[upto - 1]]
        heads = starts[at:upto] - starts[at]
        work = np.empty_like(values)
        for k in range(PERMUTATIONS):
            np.multiply(values, FACTORS[k], out=work)
            np.add(work, OFFSETS[k], out=work)
            out[at:upto, k] = np.minimum.reduceat(work, heads)
        at = upto
    return mixed(out)  # low bits of a product depend on few bits of its factors


def packed(signatures: np.ndarray) -> np.ndarray:
    """The low bits of the minima, ``LANES`` to a 64-bit word."""
    low = np.zeros((len(signatures), WORDS * LANES), np.uint64)
    low[:, :PERMUTATIONS] = signatures & np.uint64((1 << BITS) - 1)
    shifts = np.arange(LANES, dtype=np.uint64) * np.uint64(BITS)
    return np.bitwise_or.reduce(low.reshape(len(low), WORDS, LANES) << shifts, axis=2).view(np.int64)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One key per band from its full minima and its number."""
    grouped = signatures.reshape(len(signatures), BANDS, ROWS) * ODD[:ROWS]
    return mixed(grouped.sum(axis=2, dtype=np.uint64) + ODD[30] * np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def signatures(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, hash of the text, set size, fingerprint of the set, packed low bits and band keys (null without a set)."""

    def run(batches):
        for batch in batches:
            texts = batch.column(2)
            for at in range(0, batch.num_rows, 512):
                sets = [shingle_set(t, shingle) for t in texts.slice(at, 512).to_pylist()]
                full = [k for k, s in enumerate(sets) if len(s)]
                low, keys = [None] * len(sets), [None] * len(sets)
                if full:
                    minimum = minima([sets[k] for k in full])
                    for k, a, b in zip(full, packed(minimum).tolist(), band_keys(minimum).tolist()):
                        low[k], keys[k] = a, b
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(sets)),
                        batch.column(1).slice(at, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array(low, pa.list_(pa.int64())),
                        pa.array(keys, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "text_hash", "n_shingles", "fingerprint", "low_bits", "keys"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    text = docs[text_col]
    return docs.select(docs[id_col].alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(
        forgetting(run),
        f"doc_id {kind}, text_hash long, n_shingles long, fingerprint binary, low_bits array<long>, keys array<long>",
    )


def estimate(left: str, right: str):
    """Similarity from two packed signatures: equal lanes by bit counts, corrected for equality by chance."""
    lanes = 0x5555555555555555  # the low bit of every lane
    differing = F.lit(0)
    for k in range(WORDS):
        x = F.col(left)[k].bitwiseXOR(F.col(right)[k])
        differing = differing + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(lanes)))
    chance = 1 / 2**BITS
    return (1 - differing / F.lit(float(PERMUTATIONS)) - chance) / (1 - chance)


def promising(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) whose set sizes allow the threshold and whose estimate comes near it, with the estimate."""
    side = lambda c: classes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("low_bits").alias(f"low_{c}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return joined.filter(sizes).withColumn("estimate", estimate("low_a", "low_b")).filter(F.col("estimate") >= percent / 100 - MARGIN).select("a", "b", "estimate")


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union of their full shingle sets."""

    def run(batches):
        kept: dict[int, np.ndarray] = {}

        def of(node, text):
            if node not in kept:
                if len(kept) >= 16:
                    kept.pop(next(iter(kept)))
                kept[node] = shingle_set(text, shingle)
            return kept[node]

        for batch in batches:
            found = []
            for at in range(0, batch.num_rows, 256):
                for a, b, text_a, text_b in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    x, y = of(a, text_a), of(b, text_b)
                    both = np.sort(np.concatenate([x, y]))
                    common = int((both[1:] == both[:-1]).sum())
                    if 100 * common >= percent * (len(x) + len(y) - common):
                        found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    side = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))
    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(forgetting(run), "a long, b long").distinct()


def _groups(batches):
    """Tables of the rows of each (key, low, high), from batches sorted by these columns."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
        parts = [table.column(c).to_numpy() for c in ("key", "low", "high")]
        heads = np.flatnonzero(np.logical_or.reduce([p[1:] != p[:-1] for p in parts])) + 1
        for start, end in zip(np.r_[0, heads[:-1]], heads) if len(heads) else ():
            yield table.slice(start, end - start)
        rest = table.slice(heads[-1] if len(heads) else 0)
    if rest is not None and rest.num_rows:
        yield rest


def _promising_partners(table: pa.Table, percent: int):
    """For each member outside the bucket's main component: its place and the places of its promising partners.

    A pair is looked at in its first common band only, in one direction, and not if both are of one component.
    """
    column = lambda c: table.column(c).to_numpy()
    component, main, n, block, node = (column(c) for c in ("component", "main", "n", "block", "node"))
    low, high, key = int(column("low")[0]), int(column("high")[0]), int(column("key")[0])
    bits = np.asarray(table.column("low_bits").combine_chunks().flatten()).reshape(len(n), WORDS).view(np.uint64)
    keys = np.asarray(table.column("keys").combine_chunks().flatten()).reshape(len(n), BANDS)
    lanes, chance = np.uint64(0x5555555555555555), 1 / 2**BITS
    for i in np.flatnonzero(component != main):
        able = (component != component[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
        able &= (component == main) | (node < node[i])
        if low != high:
            able &= block != block[i]
        at = np.flatnonzero(able)
        if not len(at):
            continue
        x = bits[at] ^ bits[i]
        differing = np.bitwise_count((x | (x >> np.uint64(1))) & lanes).sum(axis=1)
        at = at[(1 - differing / PERMUTATIONS - chance) / (1 - chance) >= percent / 100 - MARGIN]
        if len(at):
            shared = keys[at] == keys[i]
            at = at[keys[i][shared.argmax(axis=1)] == key]
        if len(at):
            yield i, at


def bucket_links(placed: DataFrame, classes: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs (a, b) of components that a link joins, from the members of buckets that hold several components.

    ``placed``: key, node, component, main (the bucket's largest component), and members and shingles of the bucket
    (``size``, ``shingles``) and of its main component (``main_size``, ``main_shingles``). Blocks of the others come first.
    """
    blocks = lambda n, shingles: F.greatest(F.ceil(n / MEMBERS), F.ceil(shingles / SHINGLES), F.lit(1)).cast("int")
    one = (F.col("size") <= MEMBERS) & (F.col("shingles") <= SHINGLES)
    others = F.when(one, 1).otherwise(blocks(F.col("size") - F.col("main_size"), F.col("shingles") - F.col("main_shingles")))
    mains = F.when(one, 0).otherwise(blocks(F.col("main_size"), F.col("main_shingles")))
    rows = placed.select("key", "node", "component", "main", others.alias("others"), mains.alias("mains"))
    apart = (F.col("component") == F.col("main")) & (F.col("mains") > 0)
    draw = F.xxhash64("node")
    block = F.when(apart, F.col("others") + F.pmod(draw, F.greatest("mains", F.lit(1)))).otherwise(F.pmod(draw, F.col("others"))).cast("int")
    last = F.when(apart, F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1
    met = rows.select("key", "node", "component", "main", block.alias("block"), F.explode(F.sequence(F.lit(0), last)).alias("partner")).select(
        "key", F.least("block", "partner").alias("low"), F.greatest("block", "partner").alias("high"), "block", "node", "component", "main"
    )
    own = classes.select("node", F.col("n"), "low_bits", "keys")
    fields = "key long, low int, high int, block int, node long, component long, main long, n long, low_bits array<long>, keys array<long>"
    names = [f.split()[0] for f in fields.split(", ")]
    grouped = lambda df: df.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "node")

    def taking_part(batches):
        for table in _groups(batches):
            part = set()
            for i, partners in _promising_partners(table, percent):
                part.add(int(i))
                part.update(partners.tolist())
            if part:
                yield from table.take(pa.array(sorted(part))).to_batches()

    def as_sets(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(t, shingle).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])

    def link(batches):
        for table in _groups(batches):
            sets = [np.frombuffer(v, np.uint64) for v in table.column("shingles").to_pylist()]
            lengths = np.array([len(v) for v in sets])
            owner = np.repeat(np.arange(len(sets)), lengths)
            flat = np.concatenate(sets)
            order = np.argsort(flat, kind="stable")
            ordered, owner = flat[order], owner[order]
            part = table.column("component").to_numpy()
            joined: dict[int, int] = {}

            def root(c):
                while c in joined:
                    c = joined[c]
                return c

            found = []
            for i, partners in _promising_partners(table, percent):
                open_ones = [j for j in partners.tolist() if root(part[j]) != root(part[i])]
                if not open_ones:
                    continue
                first, last = np.searchsorted(ordered, sets[i], "left"), np.searchsorted(ordered, sets[i], "right")
                common = np.bincount(np.concatenate([owner[a:b] for a, b in zip(first, last)]), minlength=len(sets))
                for j in open_ones:
                    if 100 * common[j] >= percent * (lengths[i] + lengths[j] - common[j]) and root(part[j]) != root(part[i]):
                        joined[root(part[j])] = root(part[i])
                        found.append((part[i], part[j]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    chosen = grouped(met.join(own, "node").select(*names)).mapInArrow(taking_part, fields)
    sets = texts.mapInArrow(forgetting(as_sets), "node long, shingles binary")
    return grouped(chosen.join(sets, "node").select(*names, "shingles")).mapInArrow(link, "a long, b long").distinct()


def labelled(docs: DataFrame, shingle: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, n_shingles and component_id (least id reachable by links)."""
    rows = stored(signatures(docs, shingle, id_col, text_col), "minhash-signatures")
    grouped = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("fingerprint").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("first"),
        F.first("n_shingles").alias("n"),
        F.first("low_bits").alias("low_bits"),
        F.first("keys").alias("keys"),
    )
    classes = stored(
        grouped.select(
            F.monotonically_increasing_id().alias("node"), "fingerprint", F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash"), "n", "low_bits", "keys"
        ),
        "minhash-classes",
    )
    entries = classes.select("node", "n", F.explode("keys").alias("key"))
    buckets = entries.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("least"), F.max("node").alias("greatest")).filter("size > 1")
    members = stored(entries.join(buckets.select("key", "least", "greatest"), "key"), "minhash-members")

    pivots = members.select("node", F.explode(F.array("least", "greatest")).alias("pivot")).filter("node <> pivot").distinct()
    first = promising(pivots.select(F.col("node").alias("a"), F.col("pivot").alias("b")), classes, percent)
    best = first.groupBy("a").agg(F.max_by("b", F.struct("estimate", "b")).alias("b"))
    wanted = members.select("node").distinct().join(classes, "node").select("node", "doc_id", "text_hash")
    source = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(docs[text_col]).alias("text_hash"), docs[text_col].alias("text"))
    texts = stored(source.join(wanted, ["doc_id", "text_hash"]).select("node", "text"), "minhash-texts")
    links = stored(confirmed(best, texts, shingle, percent), "minhash-links")
    labels = components(links)

    # buckets that still hold several components
    placed = members.select("key", "node", "n").join(labels, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("component"))
    counted = placed.groupBy("key", "component").agg(F.count("*").alias("members"), F.sum("n").alias("held"))
    largest = F.max(F.struct("members", "component", "held")).alias("largest")
    mains = counted.groupBy("key").agg(F.count("*").alias("parts"), F.sum("members").alias("size"), F.sum("held").alias("shingles"), largest).filter("parts > 1")
    mains = mains.select(
        "key", "size", "shingles", F.col("largest.component").alias("main"), F.col("largest.members").alias("main_size"), F.col("largest.held").alias("main_shingles")
    )
    more = stored(bucket_links(placed.drop("n").join(mains, "key"), classes, texts, shingle, percent), "minhash-more-links")
    # the links found last join components, so only these are taken further
    merged = components(more).select(F.col("node").alias("old"), F.col("component").alias("new"))

    named = classes.join(labels, "node", "left").select("fingerprint", "doc_id", F.coalesce("component", "node").alias("old"))
    named = named.join(merged, "old", "left").select("fingerprint", "doc_id", F.coalesce("new", "old").alias("component"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    ids = named.join(least, "component").select("fingerprint", "component_id")
    out = rows.select("doc_id", "text_hash", "n_shingles", "fingerprint").join(ids, "fingerprint", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept (it is the component's least id)."""
    out = labelled(docs, shingle, percent, id_col, text_col)
    return out.select("doc_id", "n_shingles", "component_id", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept"))


def deduplicated(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates, with all their columns: of each component the least id stays.

    Of rows that repeat an id and a text one stays.
    """
    out = stored(labelled(docs, shingle, percent, id_col, text_col), "minhash-labels")
    same = lambda other: docs[id_col].eqNullSafe(other["doc_id"]) & F.xxhash64(docs[text_col]).eqNullSafe(other["text_hash"])
    gone = out.filter("doc_id <> component_id").select("doc_id", "text_hash").distinct()
    twice = out.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", "text_hash")
    away = gone.unionByName(twice).distinct()
    once = docs.join(away, same(away), "left_anti")
    again = twice.join(gone, twice["doc_id"].eqNullSafe(gone["doc_id"]) & (twice["text_hash"] == gone["text_hash"]), "left_anti")
    return once.unionByName(docs.join(again, same(again), "left_semi").dropDuplicates([id_col, text_col]))
