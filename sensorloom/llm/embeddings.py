"""Near-duplicate embeddings by NN-descent.

Equal vectors form one class. The neighbour graph starts from a forest: in each tree vectors are ordered by the signs
of random projections and neighbours in blocks of that order are compared. It is refined by joining neighbours of
neighbours until hardly an entry changes. A list of ``LIST_SIZE`` entries that all reach the threshold is saturated:
its links with other saturated nodes, of its own component and of all others, are counted block by block; only pairs
of blocks that are too far apart to hold a link are left out. Edges that reach the threshold are kept. The recall is audited against brute force for a bounded
sample of queries, as the average per query and apart for queries that are not saturated, and while either is under
``RECALL`` another forest and descent follow. Where ``MAX_FORESTS`` do not reach it, all pairs are compared in blocks.

Similarity is the cosine in double precision. Vectors that are null, empty, zero, or hold null or non-finite components
are linked with nothing, and vectors of different lengths are not linked. Equal vectors are linked with each other.
Repeated rows count as vectors of their own; a row with a null id is linked with nothing, has a null component and is
kept. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.lineage import stored
from sensorloom.llm.graph import components

LIST_SIZE = 16
TREES = 10
SIGNS = 48  # projections per tree; the order of their signs adapts to the number of vectors
BLOCK = 512
PARTITION_ROWS = 1 << 14
FLOOR = 0.6  # a neighbour under this similarity does not lead to linked vectors
AUDIT_QUERIES = 256
RECALL = 0.97
MAX_FORESTS = 6
CHANGED = 0.001  # share of list entries whose change ends the descent


@dataclass(frozen=True)
class Audit:
    """Links of the sampled queries by brute force, how many of them the graph has, and the average share found per query
    with links: over all such queries, and over those that are not saturated. ``exact`` where all pairs were compared."""

    true_links: int
    found_links: int
    forests: int
    query_recall: float = 1.0
    open_recall: float = 1.0
    exact: bool = False

    @property
    def recall(self) -> float:
        return min(self.query_recall, self.open_recall)


def _units(column) -> np.ndarray:
    """Matrix of the unit vectors of a binary column of equal lengths."""
    return np.stack([np.frombuffer(v, np.float64) for v in column])


def unit_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector): the unit vector's doubles as bytes, null where it is no valid vector."""

    def run(batches):
        for batch in batches:
            out = []
            for values in batch.column(1).to_pylist():
                unit = None
                if values and all(v is not None for v in values):
                    x = np.array(values, np.float64)
                    norm = np.linalg.norm(x / np.abs(x).max()) * np.abs(x).max() if np.isfinite(x).all() and x.any() else 0.0
                    unit = (x / norm).tobytes() if norm > 0 and np.isfinite(norm) else None
                out.append(unit)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "vector"])

    kind = vectors.schema[id_col].dataType.simpleString()
    return vectors.select(vectors[id_col].alias("vec_id"), vectors[vector_col].alias("v")).mapInArrow(run, f"vec_id {kind}, vector binary")


def _merged(lists: DataFrame) -> DataFrame:
    """(node, other, similarity) cut to the best ``LIST_SIZE`` entries of each node."""
    best = F.slice(F.sort_array(F.collect_set(F.struct("similarity", "other")), asc=False), 1, LIST_SIZE)
    return lists.groupBy("node").agg(best.alias("best")).select("node", F.explode("best").alias("e")).select("node", "e.other", "e.similarity")


def forest(nodes: DataFrame, seed: int, n_nodes: int) -> DataFrame:
    """Entries (node, other, similarity) of at least ``FLOOR`` from blocks of each tree's order."""

    def order(batches):
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(SIGNS, dtype=np.int64)[::-1]
        for batch in batches:
            size = np.array([len(v) // 8 for v in batch.column(1).to_pylist()])
            keys = np.zeros((batch.num_rows, TREES), np.int64)
            for d in np.unique(size):
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, int(d)]).standard_normal((int(d), TREES * SIGNS))
                own = np.flatnonzero(size == d)
                signs = (_units(batch.column(1).take(pa.array(own)).to_pylist()) @ planes[d]) > 0
                keys[own] = signs.reshape(len(own), TREES, SIGNS) @ weights
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(size.astype(np.int32)), pa.array(keys.tolist(), pa.list_(pa.int64()))],
                names=["node", "vector", "dim", "keys"],
            )

    def compare(batches):
        found = [batch for batch in batches if batch.num_rows]
        if not found:
            return
        table = pa.Table.from_batches(found).sort_by([(c, "ascending") for c in ("tree", "dim", "key", "node")])
        node = table.column("node").to_numpy()
        group = table.column("tree").to_numpy().astype(np.int64) << 32 | table.column("dim").to_numpy()
        heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else []
        for start, end in zip(heads, np.r_[heads[1:], len(group)]):
            for at in range(start, end, BLOCK // 2):  # blocks overlap by half
                upto = min(at + BLOCK, end)
                if upto - at < 2:
                    continue
                units = _units(table.column("vector").slice(at, upto - at).to_pylist())
                similarity = units @ units.T
                np.fill_diagonal(similarity, -2)
                keep = min(LIST_SIZE, upto - at - 1)
                top = np.argpartition(-similarity, keep - 1, axis=1)[:, :keep]
                value = np.take_along_axis(similarity, top, axis=1)
                row, column = np.nonzero(value >= FLOOR)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[at + row]), pa.array(node[at + top[row, column]]), pa.array(value[row, column])], names=["node", "other", "similarity"]
                )
                if upto == end:
                    break

    keyed = nodes.select("node", "vector").mapInArrow(order, "node long, vector binary, dim int, keys array<long>")
    rows = keyed.select("node", "vector", "dim", F.posexplode("keys").alias("tree", "key"))
    # equal keys, as of one large group, are told apart by the node and so dealt over several tasks
    dealt = rows.repartitionByRange(max(1, -(-n_nodes * TREES // PARTITION_ROWS)), "tree", "dim", "key", "node")
    return dealt.mapInArrow(compare, "node long, other long, similarity double")


def _compared(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, similarity) of pairs of nodes."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                value = [float(np.frombuffer(x, np.float64) @ np.frombuffer(y, np.float64)) if len(x) == len(y) else -1.0 for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(value, pa.float64())], names=["a", "b", "similarity"])

    side = lambda c: nodes.select(F.col("node").alias(c), F.col("vector").alias(f"vector_{c}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "vector_a", "vector_b")
    return joined.mapInArrow(run, "a long, b long, similarity double")


def _saturated(lists: DataFrame, threshold: float) -> DataFrame:
    """Nodes whose whole list reaches the threshold."""
    return lists.groupBy("node").agg(F.count("*").alias("n"), F.min("similarity").alias("least")).filter((F.col("n") >= LIST_SIZE) & (F.col("least") >= threshold)).select("node")


def descend(lists: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Refine the lists of nodes that are not saturated by neighbours of neighbours, until hardly an entry changes."""
    while True:
        both = lists.select("node", "other").unionByName(lists.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct()
        open_ends = both.join(_saturated(lists, threshold), "node", "left_anti")
        next_ones = lists.select(F.col("node").alias("other"), F.col("other").alias("far"))
        reached = open_ends.join(next_ones, "other").select("node", F.col("far").alias("other")).unionByName(open_ends).filter("node <> other").distinct()
        fresh = reached.join(lists.select("node", "other"), ["node", "other"], "left_anti")
        pairs = fresh.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
        near = _compared(pairs, nodes).filter(F.col("similarity") >= FLOOR)
        entries = near.select(F.col("a").alias("node"), F.col("b").alias("other"), "similarity").unionByName(
            near.select(F.col("b").alias("node"), F.col("a").alias("other"), "similarity")
        )
        refined = stored(_merged(lists.unionByName(entries)), "embedding-lists")
        new = refined.join(lists.select("node", "other"), ["node", "other"], "left_anti").count()
        size = refined.count()
        lists = refined
        if new <= CHANGED * size:
            return lists


def _components_of(linked: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Least node of each node's component in a symmetric matrix of links."""
    least = nodes.copy()
    while True:
        found = np.minimum(least, np.where(linked, least[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (found == least).all():
            return least
        least = found


def _block_pairs(cut: DataFrame, threshold: float) -> DataFrame:
    """(part_a, block_a, part_b, block_b): each unordered pair of blocks that can hold a link, a block with itself too.

    A block has a pivot, its mean direction, and a radius, the largest angle to it. Blocks whose pivots are further apart
    than both radii and the threshold's angle hold no link (triangle inequality of angles), so no link is passed over.
    """

    def pivot(table: pa.Table) -> pa.Table:
        units = _units(table.column("vector").to_pylist())
        mean = units.mean(axis=0)
        norm = np.linalg.norm(mean)
        mean = mean / norm if norm > 1e-6 else units[0]
        radius = float(np.arccos(np.clip((units @ mean).min(), -1, 1)))
        own = table.select(["part", "block"]).slice(0, 1)
        return own.append_column("dim", pa.array([len(mean)], pa.int32())).append_column("pivot", pa.array([mean.tobytes()], pa.binary())).append_column("radius", pa.array([radius]))

    pivots = stored(cut.select("part", "block", "vector").groupBy("part", "block").applyInArrow(pivot, "part long, block int, dim int, pivot binary, radius double"), "embedding-pivots")
    sizes = pivots.groupBy("dim").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("groups"))
    dealt = pivots.join(sizes, "dim").withColumn("own", F.pmod(F.xxhash64("part", "block"), F.col("groups")).cast("int"))
    met = dealt.withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    met = met.select("dim", F.least("own", "partner").alias("low"), F.greatest("own", "partner").alias("high"), "own", "part", "block", "pivot", "radius")
    reach = float(np.arccos(np.clip(threshold, -1, 1))) + 1e-6  # more than rounding adds to an angle

    def near(table: pa.Table) -> pa.Table:
        own, low, high, part, block, radius = (table.column(c).to_numpy() for c in ("own", "low", "high", "part", "block", "radius"))
        units = _units(table.column("pivot").to_pylist())
        first, second = np.flatnonzero(own == low), np.flatnonzero(own == high)
        angle = np.arccos(np.clip(units[first] @ units[second].T, -1, 1))
        close = angle <= radius[first][:, None] + radius[second][None, :] + reach
        if low[0] == high[0]:
            close = np.triu(close)
            np.fill_diagonal(close, True)
        a, b = np.nonzero(close)
        a, b = first[a], second[b]
        return pa.table({"part_a": part[a], "block_a": block[a], "part_b": part[b], "block_b": block[b]})

    return met.groupBy("dim", "low", "high").applyInArrow(near, "part_a long, block_a int, part_b long, block_b int")


def _block_links(members: DataFrame, threshold: float, connected: bool = True) -> tuple[DataFrame, DataFrame]:
    """(node, n) links of each node of (node, part, vector, weight) with all other members, counted block by block, and
    (a, b) nodes that those links join. Where ``connected``, links inside a part are known to join it and are left out."""
    sizes = members.groupBy("part").agg(F.count("*").alias("size"))
    number = F.ceil(F.col("size") / BLOCK)
    cut = stored(members.join(sizes, "part").select("part", F.pmod(F.xxhash64("node"), number).cast("int").alias("block"), "node", "vector", "weight"), "embedding-blocks")
    pairs = stored(_block_pairs(cut, threshold).select(F.monotonically_increasing_id().alias("pair"), "*"), "embedding-pairs")
    same = (F.col("part_a") == F.col("part_b")) & (F.col("block_a") == F.col("block_b"))
    within = F.col("part_a") == F.col("part_b")
    side = lambda c: pairs.select("pair", F.col(f"part_{c}").alias("part"), F.col(f"block_{c}").alias("block"), F.lit(c == "a").alias("first"), same.alias("same"), within.alias("within"))
    met = side("a").unionByName(side("b").filter(~F.col("same"))).join(cut, ["part", "block"])

    def count(table: pa.Table) -> pa.Table:
        head, node, weight = (table.column(c).to_numpy() for c in ("first", "node", "weight"))
        vectors = _units(table.column("vector").to_pylist())
        first = np.flatnonzero(head)
        second = first if table.column("same")[0].as_py() else np.flatnonzero(~head)
        linked = np.zeros((len(node), len(node)), bool)
        linked[np.ix_(first, second)] = (vectors[first] @ vectors[second].T) >= threshold
        np.fill_diagonal(linked, False)
        linked |= linked.T
        n = linked @ weight
        least = node if connected and table.column("within")[0].as_py() else _components_of(linked, node)
        own = n > 0
        return pa.table({"node": node[own], "n": n[own], "least": least[own]})

    found = stored(met.groupBy("pair").applyInArrow(count, "node long, n long, least long"), "embedding-dense")
    joined = found.filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    return found.groupBy("node").agg(F.sum("n").alias("n")), joined


def audit(nodes: DataFrame, lists: DataFrame, parts: DataFrame, threshold: float, n_nodes: int, forests: int, queries: int = AUDIT_QUERIES) -> Audit:
    """Recall per query for about ``queries`` saturated and as many other classes chosen by hash, against all classes in blocks.

    Links between two saturated nodes are counted in blocks later, so they count as found.
    """
    n_full = parts.count()
    rate = lambda n: int(min(1.0, queries / max(1, n)) * (1 << 20))
    marked = nodes.join(parts.select("node", F.lit(True).alias("full")), "node", "left")
    limit = F.when(F.col("full"), rate(n_full)).otherwise(rate(n_nodes - n_full))
    picked = marked.filter(F.pmod(F.xxhash64("node", F.lit("audit")), 1 << 20) < limit).select("node", "vector", "full")
    chosen = [r for kind in ("full", "full IS NULL") for r in picked.filter(kind).orderBy("node").limit(2 * queries).collect()]
    if not chosen:
        return Audit(0, 0, forests)
    shared = nodes.sparkSession.sparkContext.broadcast([(r["node"], bytes(r["vector"])) for r in chosen])  # at most 4 * queries vectors

    def brute(batches):
        by_size: dict[int, list] = {}
        for node, vector in shared.value:
            by_size.setdefault(len(vector), []).append((node, vector))
        sides = {size: (np.array([n for n, _ in rows]), _units([v for _, v in rows])) for size, rows in by_size.items()}
        for batch in batches:
            nodes_here, vectors = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for at in range(0, len(vectors), 4096):
                sizes = np.array([len(v) for v in vectors[at : at + 4096]])
                for size, (ids, units) in sides.items():
                    own = at + np.flatnonzero(sizes == size)
                    if not len(own):
                        continue
                    q, v = np.nonzero(units @ _units([vectors[k] for k in own]).T >= threshold)
                    a, b = ids[q], nodes_here[own[v]]
                    yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], names=["node", "other"])

    true = nodes.select("node", "vector").mapInArrow(brute, "node long, other long")
    held = lists.filter(F.col("similarity") >= threshold)
    held = held.select("node", "other").unionByName(held.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct().withColumn("held", F.lit(True))
    marked = (
        true.join(held, ["node", "other"], "left")
        .join(parts.select("node", F.col("part").alias("part_a")), "node", "left")
        .join(parts.select(F.col("node").alias("other"), F.col("part").alias("part_b")), "other", "left")
    )
    found = F.coalesce(F.col("held"), F.col("part_a").isNotNull() & F.col("part_b").isNotNull(), F.lit(False))
    each = marked.groupBy("node").agg(F.count("*").alias("n"), F.sum(found.cast("long")).alias("found"), F.first("part_a").isNull().alias("open")).collect()  # one row per query
    share = lambda rows: sum(r["found"] / r["n"] for r in rows) / len(rows) if rows else 1.0
    return Audit(sum(r["n"] for r in each), sum(r["found"] for r in each), forests, share(each), share([r for r in each if r["open"]]))


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, Audit]:
    """One row per vector (vec_id, n_links, component_id, kept), and the audit of the links."""
    rows = stored(unit_vectors(vectors, id_col, vector_col), "embedding-units")
    grouped = rows.filter("vector IS NOT NULL AND vec_id IS NOT NULL").groupBy("vector").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("weight"))
    nodes = stored(grouped.select(F.monotonically_increasing_id().alias("node"), "vector", "first_id", "weight"), "embedding-classes")
    n_nodes = nodes.count()
    lists = None
    for forests in range(1, MAX_FORESTS + 1):
        entries = forest(nodes, 100 + forests, n_nodes)
        lists = stored(_merged(entries if lists is None else lists.unionByName(entries)), "embedding-lists")
        lists = descend(lists, nodes, threshold)
        full = _saturated(lists, threshold)
        edges = lists.filter(F.col("similarity") >= threshold).select(F.col("node").alias("a"), F.col("other").alias("b"))
        inner = edges.join(full.withColumnRenamed("node", "a"), "a", "left_semi").join(full.withColumnRenamed("node", "b"), "b", "left_semi")
        # a saturated node without a saturated neighbour in its list is a part of its own
        inside = full.join(components(inner), "node", "left").select("node", F.coalesce("component", "node").alias("part"))
        parts = stored(inside, "embedding-parts")
        seen = audit(nodes, lists, parts, threshold, n_nodes, forests)
        if seen.recall >= RECALL:
            break
    else:  # the graph stays short of links: all pairs are compared, as one part per length
        seen = Audit(seen.true_links, seen.true_links, forests, exact=True)
        parts = nodes.select("node", F.octet_length("vector").cast("long").alias("part"))
        edges = edges.limit(0)

    # links between saturated nodes, of one part or of two, are counted in blocks, the others come from the lists
    dense, joined = _block_links(parts.join(nodes.select("node", "vector", "weight"), "node"), threshold, connected=not seen.exact)
    sides = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    placed = sides.join(parts.select(F.col("node").alias("a"), F.col("part").alias("part_a")), "a", "left").join(
        parts.select(F.col("node").alias("b"), F.col("part").alias("part_b")), "b", "left"
    )
    sparse = placed.filter("part_a IS NULL OR part_b IS NULL").join(nodes.select(F.col("node").alias("b"), "weight"), "b")
    links = dense.unionByName(sparse.select(F.col("a").alias("node"), F.col("weight").alias("n"))).groupBy("node").agg(F.sum("n").alias("n"))
    if not seen.exact:
        joined = joined.unionByName(edges).unionByName(parts.select(F.col("node").alias("a"), F.col("part").alias("b")))
    labels = components(joined)
    named = nodes.join(links, "node", "left").join(labels, "node", "left")
    named = named.select("vector", "first_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    result = named.join(least, "component").select("vector", "n_links", "component_id")
    linked = rows.withColumn("own", F.when(F.col("vec_id").isNotNull(), F.col("vector"))).drop("vector")
    out = linked.join(result.withColumnRenamed("vector", "own"), "own", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept")), seen
