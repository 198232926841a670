"""Vector code compression: product codes by Lloyd's rounds over two trees, in exact integers.

Vectors become integers and are cut into parts; each part position has a codebook. Tasks hold vectors
in blocks. For each part position a block keeps a tree over its parts: halves along the widest
dimension, down to leaves with their boxes, counts and cached sums. A tree of the same form is put
over the entries of the codebook, which is small and goes to every task. Both trees are walked level
by level: an entry node is dropped for a data node when even its nearest corner lies farther away
than the farthest corner of another one. A data node left with one entry is assigned whole, and its
cached sum goes into that entry's; in uncertain leaves each part is compared with the entries left,
in integers. Ties are never pruned, so the result is that of comparing everything.

The blocks are written once and read in each round; per round a task returns one sum per entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from engram.session import checkpoint

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows of a block, and parts of a leaf of its trees.
BLOCK, LEAF = 4096, 32
#: Integers beyond this are cut off here, so that a sum of 4096 squared differences fits 63 bits.
LARGEST = 1 << 24


def _edges(n: int, level: int) -> np.ndarray:
    """Where the nodes of a level begin among ``n`` points, and the end."""
    return (np.arange((1 << level) + 1) * n) >> level


class Tree:
    """A balanced tree over points: boxes of all nodes by level, and running sums in tree order.

    ``order`` lists the points in tree order; ``points`` are in tree order already where it is given.
    """

    def __init__(self, points: np.ndarray, leaf: int, order: np.ndarray | None = None):
        n = len(points)
        self.depth = 0
        while n >> self.depth > leaf:
            self.depth += 1
        self.order = self._halved(points) if order is None else order
        self.points = points[self.order] if order is None else points
        self.edges = _edges(n, self.depth)
        low, high = (f.reduceat(self.points, self.edges[:-1]) for f in (np.minimum, np.maximum))
        self.boxes = [(low, high)]
        for _ in range(self.depth):
            low, high = np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2])
            self.boxes.insert(0, (low, high))
        self.running = np.zeros((n + 1, points.shape[1]), np.int64)
        np.cumsum(self.points, axis=0, out=self.running[1:])

    def _halved(self, points: np.ndarray) -> np.ndarray:
        order = np.arange(len(points))
        for level in range(self.depth):
            edges, cuts = _edges(len(points), level), _edges(len(points), level + 1)[1::2]
            for a, cut, b in zip(edges[:-1], cuts, edges[1:]):
                own = points[order[a:b]]
                widest = np.argmax(own.max(axis=0) - own.min(axis=0))
                order[a:b] = order[a:b][np.argpartition(own[:, widest], cut - a)]
        return order


def _candidates(data: Tree, entries: Tree) -> np.ndarray:
    """For each leaf of ``data``, which leaves of ``entries`` may hold the nearest entry of one of its points."""
    alive, at, own = np.ones((1, 1), bool), 0, 0
    steps = max(data.depth, entries.depth)
    for step in range(steps + 1):
        down, across = (tree.depth * step // max(1, steps) for tree in (data, entries))
        alive = np.repeat(np.repeat(alive, 1 << (down - at), axis=0), 1 << (across - own), axis=1)
        at, own = down, across
        (low, high), (entry_low, entry_high) = data.boxes[at], entries.boxes[own]
        above, below = entry_high[None] - low[:, None], high[:, None] - entry_low[None]
        near = np.maximum(np.maximum(-above, -below), 0)
        far = np.maximum(above, below)
        most = np.where(alive, (far * far).sum(axis=2), np.iinfo(np.int64).max).min(axis=1)
        alive &= (near * near).sum(axis=2) <= most[:, None]
    return alive


def assigned(data: Tree, entries: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entry of ``book`` nearest to each point (in tree order), and sums and counts of points by entry.

    ``entries`` is a tree over ``book``. Of equally near entries the first is taken.
    """
    alive = _candidates(data, entries)
    sizes = np.diff(entries.edges)
    nearest = np.empty(len(data.points), np.int64)
    sums, counts = np.zeros(book.shape, np.int64), np.zeros(len(book), np.int64)
    norms = (book * book).sum(axis=1)
    bound = max(int(np.abs(data.points).max()), int(np.abs(book).max()), 1)
    # whole numbers below 2**53 are exact in floating point too, where products are faster
    kind = float if bound * bound * book.shape[1] < 1 << 51 else np.int64
    for leaf, (a, b) in enumerate(zip(data.edges[:-1], data.edges[1:])):
        left = entries.order[np.repeat(alive[leaf], sizes)]
        if len(left) == 1:
            nearest[a:b] = left[0]
            sums[left[0]] += data.running[b] - data.running[a]
            counts[left[0]] += b - a
            continue
        left.sort()
        products = data.points[a:b].astype(kind) @ book[left].T.astype(kind)
        nearest[a:b] = left[np.argmin(norms[left] - 2 * products, axis=1)]
        np.add.at(sums, nearest[a:b], data.points[a:b])
        counts += np.bincount(nearest[a:b], minlength=len(book))
    return nearest, sums, counts


def integers(vectors: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(vectors.astype(float) * SCALE), -LARGEST, LARGEST).astype(np.int32)


STORED = "parts binary, places binary, n int"


def _blocks(dims: int):
    """Blocks of rows (carried, vector): each part in the order of its tree, and these orders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK):
                rows = batch.slice(first, BLOCK)
                vectors = integers(rows.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
                trees = [Tree(p, LEAF) for p in np.split(vectors, PARTS, axis=1)]
                yield pa.RecordBatch.from_arrays([
                    pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column(0)),
                    pa.array([np.stack([t.points for t in trees]).tobytes()], pa.binary()),
                    pa.array([np.stack([t.order for t in trees]).astype(np.int32).tobytes()], pa.binary()),
                    pa.array([rows.num_rows], pa.int32()),
                ], names=["carried", "parts", "places", "n"])

    return run


def _stored(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[tuple[pa.Array, list]]:
    """For each block: what is carried, and a (tree, nearest entries, sums, counts) for each part position."""
    entries = [Tree(book, 1) for book in books]
    for batch in batches:
        for i in range(batch.num_rows):
            n = batch.column("n")[i].as_py()
            parts = np.frombuffer(batch.column("parts")[i].as_buffer(), np.int32).reshape(PARTS, n, -1).astype(np.int64)
            places = np.frombuffer(batch.column("places")[i].as_buffer(), np.int32).reshape(PARTS, n)
            trees = [Tree(p, LEAF, order) for p, order in zip(parts, places)]
            yield batch.column("carried")[i].values, [(t, *assigned(t, e, b)) for t, e, b in zip(trees, entries, books)]


def _sums(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for _, parts in _stored(batches, books):
            for k, (_, _, more, n) in enumerate(parts):
                sums[k] += more
                counts[k] += n
        part, entry = np.nonzero(counts)
        if len(part):
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array(entry), pa.array(counts[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))],
                names=["part", "entry", "n", "sums"],
            )

    return run


def _codes(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for carried, parts in _stored(batches, books):
            codes = np.empty((len(carried), PARTS), np.int32)
            errors = np.zeros(len(carried), np.int64)
            for k, (tree, nearest, _, _) in enumerate(parts):
                codes[tree.order, k] = nearest
                off = tree.points - books[k][nearest]
                errors[tree.order] += (off * off).sum(axis=1)
            ends = pa.array(np.arange(0, codes.size + 1, PARTS, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [carried, pa.ListArray.from_arrays(ends, pa.array(codes.ravel())), pa.array(errors)],
                names=["carried", "codes", "error"],
            )

    return run


def usable(vector: str) -> Column:
    """Whether a vector can be coded: no null or non-finite component, and parts of equal length."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & (F.size(vector) > 0) & (F.size(vector) % PARTS == 0), F.lit(False))


def compressed(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """``vec_id, label, codes (array), error`` of every usable row, and the codebooks (part, entry, component).

    Components x become floor(1024 * x), cut off at 2**24. Vectors that are null or hold null or
    non-finite components are left out, and so are those whose length isn't a multiple of four or isn't
    that of the usable row of the smallest id (ids null last, then by components). Rows repeating an id
    or a vector count each. The codebooks start as the parts of the 256 first rows in that order (all,
    where there are fewer). Other columns are ignored, whatever their names. An empty table gives no
    rows and no codebooks.
    """
    kept = rows.select(
        F.struct(F.col(vec_id).alias("vec_id"), F.col(label).alias("label")).alias("carried"), F.col(vector).alias("v")
    ).where(usable("v")).withColumn("v", F.col("v").cast("array<double>"))
    order = [F.col("carried.vec_id").asc_nulls_last(), F.col("v")]
    least = kept.orderBy(*order).limit(1).collect()
    kind = dict(kept.dtypes)["carried"]
    if not least:
        return kept.select("carried.*", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error")), np.zeros((PARTS, 0, 0), np.int64)
    dims = len(least[0].v)
    kept = kept.where(F.size("v") == dims)
    first = np.array([r.v for r in kept.orderBy(*order).limit(ENTRIES).select("v").collect()])
    books = np.stack(np.split(integers(first).astype(np.int64), PARTS, axis=1))
    blocks = checkpoint(kept.mapInArrow(_blocks(dims), f"carried array<{kind}>, {STORED}"))
    width = dims // PARTS
    for _ in range(ROUNDS):
        found = blocks.mapInArrow(_sums(books), "part long, entry long, n long, sums array<long>").groupBy("part", "entry").agg(
            F.sum("n").alias("n"), F.array(*(F.sum(F.get("sums", F.lit(j))) for j in range(width))).alias("sums")
        ).collect()
        books = books.copy()
        for r in found:  # one row per entry at most
            books[r.part, r.entry] = [s // r.n for s in r.sums]
    return blocks.mapInArrow(_codes(books), f"carried {kind}, codes array<int>, error long").select("carried.*", "codes", "error"), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in order, as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
