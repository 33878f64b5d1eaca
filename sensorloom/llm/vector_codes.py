"""Product codes of vectors by Lloyd's method over partition-local cover trees.

Components become integers ``floor(SCALE * x)``; vectors are cut into ``PARTS`` equal consecutive parts with a codebook of at
most ``ENTRIES`` entries each. Every partition sorts its vectors into blocks and builds, per block and part, a cover tree:
a node is a routing point, the distance to its farthest descendant and a run of rows, siblings lie more than the node's
covering distance apart, and cumulative sums over the rows give the sum of any node's run. Trees are built once and written
to the shared folder. In every round a node whose nearest entry is nearer to all its rows than any other entry, by the
triangle inequality, gives its whole run to it; only nodes that stay ambiguous pass on to their children, and what is still
ambiguous in a leaf is compared exactly, row by row. A child with its parent's routing point takes over the distances.
Partial sums per task and entry are added up in Spark; the driver sees the codebooks only (``PARTS * ENTRIES`` rows).

All arithmetic is on integers, so results do not depend on partitions, blocks or the order of rows. Distances are matrix
products of doubles where these hold every value exactly, else of 64-bit integers.

Rows whose vector is null or holds a null or non-finite component are dropped. Rows with equal ids are rows of their own; the
first entries are the smallest (id, vector), null ids last. With fewer rows than entries the codebook is that short; an empty
table gives no rows. Equal distances go to the lower index. Vectors of other lengths than the longest, or of a length
that the parts do not divide, are filled up with zeros at the end. Integers beyond ``limit(width)`` in size (more than 10^8 at 64
components) are set to it, so that sums of squares stay within 64 bits. Null labels are one label. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.lineage import stored

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
BLOCK_ROWS = 2048  # rows of one tree
LEAF_ROWS = 12
SHRINK = 1.6  # covering distance of a node against that of its children
EXACT = 1 << 53  # below it doubles hold every integer
CHUNK = 1 << 12  # nodes or rows compared with a codebook at once


def limit(width: int) -> int:
    """Largest size of an integer component: squared distances summed over ``width`` components stay below 2^62."""
    return math.isqrt((1 << 62) // max(width, 1)) // 2


def floored(values: np.ndarray, width: int) -> np.ndarray:
    bound = float(limit(width))
    return np.clip(np.floor(values.astype(np.float64) * SCALE), -bound, bound).astype(np.int64)


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances between all points and all entries."""
    largest = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * largest * largest * max(points.shape[1], 1) < EXACT else np.int64
    p, e = points.astype(kind), entries.astype(kind)
    return (p * p).sum(axis=1)[:, None] + (e * e).sum(axis=1) - 2 * (p @ e.T)


class CoverTree:
    """Cover tree over the rows of one block and part: nodes in breadth-first order, rows in tree order."""

    def __init__(self, points: np.ndarray):
        n = len(points)
        order = np.arange(n)
        route, low, high, radius, first, children = [0], [0], [n], [0.0], [0], [0]
        distance = np.sqrt(squared(points, points[:1])[:, 0])  # of the row in each place to its node's routing point
        covering = [0.0]
        at = 0
        while at < len(route):
            a, b = low[at], high[at]
            radius[at] = float(distance[a:b].max(initial=0.0))
            first[at] = len(route)
            if radius[at] > 0 and b - a > LEAF_ROWS:
                cover = min(radius[at], covering[at] or math.inf) / SHRINK
                near = distance[a:b] <= cover
                rows, apart = order[a:b], distance[a:b]
                groups = [(route[at], rows[near], apart[near])]
                rows = rows[~near]
                while len(rows):
                    to = np.sqrt(squared(points[rows], points[rows[:1]])[:, 0])
                    near = to <= cover
                    groups.append((int(rows[0]), rows[near], to[near]))
                    rows = rows[~near]
                for point, rows, apart in groups:
                    order[a : a + len(rows)], distance[a : a + len(rows)] = rows, apart
                    route.append(point)
                    low.append(a)
                    a += len(rows)
                    high.append(a)
                    covering.append(cover)
                    radius.append(0.0)
                    first.append(0)
                    children.append(0)
                children[at] = len(groups)
            at += 1
        self.order, self.route = order, np.array(route)
        self.low, self.high, self.radius = np.array(low), np.array(high), np.array(radius)
        self.first, self.children = np.array(first), np.array(children)
        self._of(points)

    def _of(self, points: np.ndarray) -> None:
        self.points = points
        self.sums = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points[self.order], axis=0)])

    def to_bytes(self) -> bytes:
        columns = [np.array([len(self.order), len(self.route)], np.int64), self.order, self.route, self.low, self.high, self.first, self.children]
        return b"".join([*(c.astype("<i4").tobytes() for c in columns), self.radius.astype("<f8").tobytes()])

    @classmethod
    def from_bytes(cls, data: bytes, points: np.ndarray) -> CoverTree:
        tree = cls.__new__(cls)
        rows, nodes = np.frombuffer(data, "<i4", 2)
        cuts = np.cumsum([2, rows, nodes, nodes, nodes, nodes, nodes])
        ints = np.frombuffer(data, "<i4", cuts[-1])
        tree.order, tree.route, tree.low, tree.high, tree.first, tree.children = np.split(ints, cuts[:-1])[1:]
        tree.radius = np.frombuffer(data, "<f8", nodes, int(cuts[-1]) * 4)
        tree._of(points)
        return tree

    def settled(self, entries: np.ndarray):
        """(runs, entry of each run): runs of rows, in tree order, that belong to one entry; together they are all rows."""
        runs, owners = [], []
        nodes, apart = np.array([0]), squared(self.points[self.route[:1]], entries)
        while len(nodes):
            best = apart.argmin(axis=1)
            here = np.arange(len(nodes))
            root = np.sqrt(apart.astype(np.float64))
            nearest = root[here, best]
            root[here, best] = np.inf
            # of two entries the nearer by more than twice the radius is nearer to every row below; the margin covers rounding
            sure = (nearest + 2 * self.radius[nodes]) * (1 + 1e-9) < root.min(axis=1, initial=np.inf)
            sure |= self.radius[nodes] == 0
            runs.append(np.stack([self.low[nodes[sure]], self.high[nodes[sure]]], axis=1))
            owners.append(best[sure])
            leaf = ~sure & (self.children[nodes] == 0)
            if leaf.any():
                places = spread(self.low[nodes[leaf]], self.high[nodes[leaf]])
                runs.append(np.stack([places, places + 1], axis=1))
                owners.append(nearest_entries(self.points[self.order[places]], entries)[0])
            descend = np.flatnonzero(~sure & ~leaf)
            parent = np.repeat(descend, self.children[nodes[descend]])
            below = spread(self.first[nodes[descend]], self.first[nodes[descend]] + self.children[nodes[descend]])
            fresh = self.route[below] != self.route[nodes[parent]]
            further = apart[parent]
            further[fresh] = squared(self.points[self.route[below[fresh]]], entries)
            nodes, apart = below, further
        return np.concatenate(runs), np.concatenate(owners)

    def add_sums(self, entries: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> None:
        """Add the rows' sums and counts to those of their entries."""
        runs, owners = self.settled(entries)
        np.add.at(sums, owners, self.sums[runs[:, 1]] - self.sums[runs[:, 0]])
        np.add.at(counts, owners, runs[:, 1] - runs[:, 0])

    def codes(self, entries: np.ndarray) -> np.ndarray:
        """Entry of every row, in the rows' own order."""
        runs, owners = self.settled(entries)
        found = np.empty(len(self.order), np.int64)
        found[self.order[spread(runs[:, 0], runs[:, 1])]] = np.repeat(owners, runs[:, 1] - runs[:, 0])
        return found


def spread(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All integers of the half-open ranges, range after range."""
    lengths = (high - low).astype(np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(low - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def nearest_entries(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry (the lower index where distances are equal) and its squared distance, by comparison with all entries."""
    found, apart = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for at in range(0, len(points), CHUNK):
        to = squared(points[at : at + CHUNK], entries)
        found.append(to.argmin(axis=1))
        apart.append(to[np.arange(len(to)), found[-1]].astype(np.int64))
    return np.concatenate(found), np.concatenate(apart)


def cleaned(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, vec) of the rows whose vector holds finite components only."""
    infinite = float("inf")
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == infinite))
    chosen = vectors.select(vectors[id_col].alias("id"), vectors[label_col].alias("label"), vectors[vector_col].cast("array<double>").alias("vec"))
    return chosen.filter(F.col("vec").isNotNull() & ~bad)


def planted(rows: DataFrame, width: int) -> DataFrame:
    """Blocks of rows with their integers and the trees of all parts, written once."""

    def grown(ids, labels, vecs) -> pa.RecordBatch:
        held = np.zeros((len(vecs), width))
        lengths = np.diff(vecs.offsets.to_numpy())
        held[np.arange(width) < lengths[:, None]] = vecs.flatten().to_numpy()
        ints = floored(held, width)
        trees = [CoverTree(part).to_bytes() for part in np.split(ints, PARTS, axis=1)]
        return pa.RecordBatch.from_arrays(
            [
                pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), labels),
                pa.array([ints.astype("<i4" if np.abs(ints).max(initial=0) < 1 << 31 else "<i8").tobytes()], pa.binary()),
                pa.array([trees], pa.list_(pa.binary())),
            ],
            names=["ids", "labels", "ints", "trees"],
        )

    def run(batches):
        waiting, n = [], 0
        for batch in batches:
            waiting.append(batch)
            n += batch.num_rows
            if n >= BLOCK_ROWS:
                table = pa.Table.from_batches(waiting).combine_chunks()
                cut = n - n % BLOCK_ROWS
                for at in range(0, cut, BLOCK_ROWS):
                    yield grown(*(c.chunk(0) for c in table.slice(at, BLOCK_ROWS).combine_chunks().columns))
                waiting, n = table.slice(cut).to_batches(), n - cut
        if n:
            yield grown(*(c.chunk(0) for c in pa.Table.from_batches(waiting).combine_chunks().columns))

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return stored(rows.mapInArrow(run, f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, ints binary, trees array<binary>"), "cover-trees")


def trees_of(ints: bytes, trees: list[bytes], n: int, width: int) -> list[CoverTree]:
    kind = "<i4" if len(ints) == 4 * n * width else "<i8"
    parts = np.split(np.frombuffer(ints, kind).reshape(n, width).astype(np.int64), PARTS, axis=1)
    return [CoverTree.from_bytes(tree, part) for tree, part in zip(trees, parts)]


def improved(blocks: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """One round of Lloyd's method: every entry becomes the floored mean of its parts; unused entries stay."""
    shared = blocks.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        sums = [np.zeros(book.shape, np.int64) for book in shared.value]
        counts = [np.zeros(len(book), np.int64) for book in shared.value]
        for batch in batches:
            for ids, ints, trees in zip(batch.column(0), batch.column(1), batch.column(2)):
                for part, tree in enumerate(trees_of(ints.as_py(), trees.as_py(), len(ids), width)):
                    tree.add_sums(shared.value[part], sums[part], counts[part])
        for part, (s, c) in enumerate(zip(sums, counts)):
            used = np.flatnonzero(c)
            if len(used):
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * s.shape[1], pa.int32()), pa.array(s[used].ravel()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(used), part, np.int32)), pa.array(used.astype(np.int32)), pa.array(c[used]), flat],
                    names=["part", "entry", "n", "sums"],
                )

    found = blocks.select("ids", "ints", "trees").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    exact = [F.sum(F.col("sums")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(width // PARTS)]
    after = [book.copy() for book in books]
    for row in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *exact).collect():
        after[row["part"]][row["entry"]] = [int(row[f"s{k}"]) // row["n"] for k in range(width // PARTS)]
    shared.unpersist()
    return after


def fitted(rows: DataFrame, blocks: DataFrame, width: int) -> list[np.ndarray]:
    """Codebooks after ``ROUNDS`` rounds from the parts of the rows with the smallest ids."""
    start = rows.orderBy(F.col("id").asc_nulls_last(), "vec").limit(ENTRIES).collect()
    held = np.zeros((len(start), width))
    for k, row in enumerate(start):
        held[k, : len(row["vec"])] = row["vec"]
    books = np.split(floored(held, width), PARTS, axis=1)
    for _ in range(ROUNDS):
        books = improved(blocks, books, width)
    return books


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def coded(blocks: DataFrame, books: list[np.ndarray], width: int, kinds: dict[str, str]) -> DataFrame:
    """(id, label, codes, error) of every row of the blocks."""
    shared = blocks.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                ids, labels = batch.column(0).slice(k, 1).flatten(), batch.column(1).slice(k, 1).flatten()
                grown = trees_of(batch.column(2)[k].as_py(), batch.column(3)[k].as_py(), len(ids), width)
                codes, error = np.empty((len(ids), PARTS), np.uint8), np.zeros(len(ids), np.int64)
                for part, tree in enumerate(grown):
                    own = tree.codes(shared.value[part])
                    codes[:, part] = own
                    error += ((tree.points - shared.value[part][own]) ** 2).sum(axis=1)
                names = [row.tobytes().hex() for row in codes]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(names, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return blocks.select("ids", "labels", "ints", "trees").mapInArrow(run, f"vec_id {kinds['id']}, label {kinds['label']}, code string, error long")


def product_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of every kept row."""
    rows = cleaned(vectors, id_col, vector_col, label_col)
    longest = rows.agg(F.max(F.size("vec"))).first()[0] or 0
    width = max(1, -(-longest // PARTS)) * PARTS
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    blocks = planted(rows, width)
    books = fitted(rows, blocks, width)
    found = stored(coded(blocks, books, width, kinds), "vector-codes")
    totals = found.groupBy(F.col("label").alias("same")).agg(F.sum("error").alias("label_error"))
    joined = found.join(totals, found["label"].eqNullSafe(totals["same"]), "left")
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
