"""Near-duplicate embeddings: spherical k-means cells and blocked cosine products.

Centres are fitted on a bounded sample; every vector is then placed in the cell of its nearest
centre. Two unit vectors whose cosine reaches the threshold are at most ``c = sqrt(2 - 2 t)``
apart, so a vector can only have links into another cell when it lies within ``c`` of the plane
between the two centres and within the cell's radius plus the threshold's angle of its centre; lent
to all such cells, the search is exact whatever the centres and the vectors are (on the sphere the
distance from the plane is at most the sine of the threshold's angle, slightly less than ``c``).
``exact=False`` is an estimate for vectors whose differences spread evenly over all dimensions: it
bounds that distance by four times ``c / sqrt(dimensions)`` and misses links of vectors that lie
in few dimensions.

Within a cell its members are dealt over blocks of bounded size, and each pair of blocks is one
matrix product in one task. A pair of blocks returns counts and a spanning forest of its links,
never the pairs. Equal vectors are one class throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from engram.llm.components import components
from engram.llm.sampling import least_hashed
from engram.session import checkpoint

#: Bound of the sample that centres are fitted on, and of their number.
SAMPLE, CENTRES, SWEEPS = 16384, 1024, 8
#: Mean members of a cell's block, and guests that meet a block at once.
BLOCK, GUESTS = 1024, 4096
#: Standard deviations of a difference along one direction that lending allows for unless exact.
DEVIATIONS = 4.0
#: Slack of the geometric bounds against rounding.
EPS = 1e-6


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision, safe for very small and large components."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def centres(sample: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Spherical k-means on unit rows; an empty cell keeps its centre."""
    dice = np.random.default_rng(seed)
    found = sample[dice.permutation(len(sample))[:k]].copy()
    for _ in range(SWEEPS):
        home = np.argmax(sample @ found.T, axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, home, sample)
        length = np.sqrt((sums * sums).sum(axis=1))
        found[length > 1e-9] = (sums / np.maximum(length, 1e-9)[:, None])[length > 1e-9]
    return found


def _matrix(column: pa.Array) -> np.ndarray:
    return unit(np.array(column.to_pylist(), np.float64).reshape(len(column), -1))


def _place(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared.value
        for batch in batches:
            if batch.num_rows:
                products = _matrix(batch.column(1)) @ cells.T
                home = np.argmax(products, axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(home), pa.array(products.max(axis=1))], names=["cls", "v", "copies", "cell", "near"])

    return run


def _lend(shared, threshold: float, exact: bool, count: bool):
    """The cells before its own that a vector is lent to; or how many vectors each cell borrows."""
    chord, angle = np.sqrt(2 - 2 * threshold), np.arccos(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, radius = shared.value
        gaps = np.sqrt(np.maximum(2 - 2 * cells @ cells.T, 0))
        reach_of = np.sin(angle) if exact else chord * min(1.0, DEVIATIONS / cells.shape[1] ** 0.5)
        for batch in batches:
            if not batch.num_rows:
                continue
            products = _matrix(batch.column(1)) @ cells.T
            home = batch.column(3).to_numpy()
            own = products[np.arange(len(home)), home][:, None]
            reach = (own - products <= reach_of * gaps[home] + 2 * EPS) & (
                np.arccos(np.clip(products, -1, 1)) <= radius[None, :] + angle + EPS)
            reach &= np.arange(len(cells))[None, :] < home[:, None]
            if count:
                some = np.flatnonzero(reach.any(axis=0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some.astype(np.int32)), pa.array(reach.sum(axis=0)[some].astype(np.int64))], names=["cell", "c"])
            else:
                row, cell = np.nonzero(reach)
                taken = batch.select([0, 1, 2]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell.astype(np.int32))], names=["cls", "v", "copies", "cell"])

    return run


def _product(threshold: float):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        same = key[1] == 0 and key[2] == key[3]
        if same:
            right = left
        if not len(left) or not len(right):
            return pd.DataFrame({"cls": [], "n": [], "other": []}).astype("int64")
        a, b = (unit(np.array(x["v"].tolist(), np.float64)) for x in (left, right))
        near = a @ b.T >= threshold
        if same:
            np.fill_diagonal(near, False)
        ca, cb, wa, wb = left["cls"].to_numpy(), right["cls"].to_numpy(), left["copies"].to_numpy(), right["copies"].to_numpy()
        rows, columns = near.any(axis=1), near.any(axis=0)
        if not rows.any():
            return pd.DataFrame({"cls": [], "n": [], "other": []}).astype("int64")
        near, ca, cb, wa, wb = near[rows][:, columns], ca[rows], cb[columns], wa[rows], wb[columns]
        top = np.iinfo(np.int64).max
        own, other = ca.copy(), cb.copy()
        while True:  # least label over links until it is stable: a forest of the links in linear space
            new = np.minimum(own, np.where(near, other[None, :], top).min(axis=1))
            back = np.minimum(other, np.where(near, new[:, None], top).min(axis=0))
            if (new == own).all() and (back == other).all():
                break
            own, other = new, back
        out = [pd.DataFrame({"cls": ca, "n": near @ wb, "other": own})]
        if not same:
            out.append(pd.DataFrame({"cls": cb, "n": wa @ near, "other": other}))
        return pd.concat(out).astype("int64")

    return run


def near_vectors(
    table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.95, seed: int = 0, exact: bool = True
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``table``.

    Rows are linked when the cosine of their vectors, in double precision, is at least
    ``threshold`` (above 0). Vectors that are null, empty, zero or hold a null or non-finite
    component link with nothing, nor do rows without an id; vectors of different lengths never
    link. Repeated rows link with each other like other equal vectors. Other columns are ignored;
    an empty table gives an empty result.
    """
    spark = table.sparkSession
    rows = table.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = F.col("v").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0) & F.col("id").isNotNull()
    classes = checkpoint(rows.where(usable).groupBy("v").agg(F.min("id").alias("cls"), F.count("*").alias("copies")).select("cls", "v", "copies"))
    found = None
    for (length,) in classes.select(F.size("v")).distinct().sort(F.size("v")).collect():  # vectors have one or few lengths
        own = classes.where(F.size("v") == length)
        part = _links(spark, own, threshold, seed, exact)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "cls bigint, n bigint, other bigint")
    found = checkpoint(found)
    counts = found.groupBy("cls").agg(F.sum("n").alias("n"))
    joined = components(found.select(F.col("cls").alias("a"), F.col("other").alias("b")))
    by_class = classes.join(counts, "cls", "left").join(joined.withColumnRenamed("id", "cls"), "cls", "left").select(
        "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "cls").alias("component_id"))
    keyed = rows.select("id", F.when(usable, F.col("v")).alias("v"))
    out = keyed.join(by_class, "v", "left").select(
        F.col("id").alias(vec_id), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(vec_id) == F.col("component_id"), F.lit(True)))


def _links(spark, classes: DataFrame, threshold: float, seed: int, exact: bool) -> DataFrame:
    """Per class and pair of blocks: copies linked to it, and a class of smaller id joined with it."""
    kind = classes.schema["v"].dataType.simpleString()
    n = classes.count()
    k = int(max(1, min(CENTRES, n**0.5 / 4)))
    sample = least_hashed(classes, SAMPLE, n, "cls").select("v").toArrow().column("v").combine_chunks()
    cells = centres(_matrix(sample), k, seed)
    placed = checkpoint(classes.mapInArrow(
        _place(spark.sparkContext.broadcast(cells)), f"cls bigint, v {kind}, copies bigint, cell int, near double"))
    radius, blocks, slots = np.full(k, -10.0), np.ones(k, np.int64), np.zeros(k, np.int64)
    for cell, near, size in placed.groupBy("cell").agg(F.min("near"), F.count("*")).collect():  # k rows
        radius[cell], blocks[cell] = np.arccos(np.clip(near, -1, 1)), -(-size // BLOCK)
    shared = spark.sparkContext.broadcast((cells, radius))
    counted = placed.mapInArrow(_lend(shared, threshold, exact, True), "cell int, c bigint")
    for cell, size in counted.groupBy("cell").agg(F.sum("c")).collect():  # k rows
        slots[cell] = -(-size // GUESTS)

    def of(numbers: np.ndarray):
        return F.element_at(F.array(*(F.lit(int(x)) for x in numbers)), F.col("cell") + 1)

    own = ["cls", "v", "copies", "cell"]
    home = placed.select(*own, of(blocks).alias("blocks"), of(slots).alias("slots")).withColumn(
        "block", F.pmod(F.xxhash64("cls", F.lit(seed)), F.col("blocks")).cast("int"))
    guests = placed.mapInArrow(_lend(shared, threshold, exact, False), f"cls bigint, v {kind}, copies bigint, cell int").select(
        *own, of(blocks).alias("blocks"), F.pmod(F.xxhash64("cls", F.lit(seed)), of(slots)).cast("int").alias("j"))
    all_blocks = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    sides = [
        home.select(*own, F.lit(0).alias("lent"), F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"), F.lit(0).alias("side")),
        home.select(*own, F.lit(0).alias("lent"), F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"), F.lit(1).alias("side")).where("i < j"),
        home.where("slots > 0").select(*own, F.lit(1).alias("lent"), F.col("block").alias("i"), F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("j"), F.lit(0).alias("side")),
        guests.select(*own, F.lit(1).alias("lent"), all_blocks.alias("i"), "j", F.lit(1).alias("side")),
    ]
    dealt = sides[0]
    for more in sides[1:]:
        dealt = dealt.unionByName(more)
    return dealt.groupBy("cell", "lent", "i", "j").applyInPandas(_product(threshold), "cls bigint, n bigint, other bigint")
