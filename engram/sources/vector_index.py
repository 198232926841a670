"""A persisted inverted-file index of vectors: k-means cells as partitions of a table.

A row lies in the cell of its nearest centre (by cosine); cells are folders, so a search that probes
few cells reads few files. Rows come in named batches, which can be written again without effect.
What was found is ranked by the exact cosine. Without ``probes`` every cell is read, and the result
is that of comparing everything.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.operators import search
from engram.session import checkpoint

#: Vectors per cell that the centres are fitted on, and the most cells.
FITTED, MAX_CELLS = 64, 65_536
#: Cell of vectors that have no direction or another length than the centres; always probed.
OUTSIDE = -1
_ROWS = "id string, embedding array<double>, batch string, cell int"


def _length(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))


class VectorIndex:
    """An index under one root folder. Rows have ``id`` (string) and ``embedding``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._model: KMeansModel | None = None

    @classmethod
    def create(cls, spark: SparkSession, root: str, vectors: DataFrame, cells: int | None = None, seed: int = 1) -> "VectorIndex":
        """Fit the centres on a bounded sample, ``FITTED`` vectors per cell, and write all rows as batch ``0``.

        There are as many cells as the root of the number of vectors by default. Null vectors are left
        out; a table without any usable vector gives an index of no cells, which still takes batches.
        """
        index = cls(spark, root)
        rows = index._typed(vectors)
        size = F.size("embedding")
        counted = rows.where(_length(F.col("embedding")) > 0).groupBy(size.alias("dims")).count().orderBy(F.desc("count"), "dims").first()
        if counted is not None:
            n = counted["count"]
            k = cells or max(1, min(MAX_CELLS, round(n**0.5)))
            one_of = max(1, n // (FITTED * k))
            sample = rows.where((size == counted["dims"]) & (_length(F.col("embedding")) > 0) & (F.pmod(F.xxhash64("id"), F.lit(one_of)) == 0))
            fit = KMeans(k=k, seed=seed, maxIter=10, distanceMeasure="cosine", featuresCol="v")
            index._model = fit.fit(sample.select(array_to_vector("embedding").alias("v")))
            index._model.write().overwrite().save(f"{index.root}/model")
        index.append(vectors, "0")
        return index

    @staticmethod
    def _typed(vectors: DataFrame) -> DataFrame:
        return vectors.where(F.col("embedding").isNotNull()).select(
            F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    @property
    def model(self) -> KMeansModel | None:
        if self._model is None and self._exists("model"):
            self._model = KMeansModel.load(f"{self.root}/model")
        return self._model

    @property
    def centres(self) -> np.ndarray:
        """Unit vectors, a row per cell."""
        if self.model is None:
            return np.zeros((0, 0))
        rows = np.stack(self.model.clusterCenters())
        return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)

    def append(self, vectors: DataFrame, batch: str) -> None:
        """Write rows as a batch; the same batch again replaces itself."""
        rows = self._typed(vectors)
        inside = (F.size("embedding") == self.centres.shape[1]) & (_length(F.col("embedding")) > 0)
        placed = rows.where(~inside).withColumn("cell", F.lit(OUTSIDE))
        if self.model is not None:
            moved = self.model.transform(rows.where(inside).withColumn("v", array_to_vector("embedding")).withColumnRenamed("id", "_id"))
            name = self.model.getPredictionCol()
            placed = placed.unionByName(moved.select(F.col("_id").alias("id"), "embedding", F.col(name).alias("cell")))
        # a few files per cell; adaptive execution splits the large ones
        placed.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{self.root}/rows/batch={batch}")

    def rows(self, cells: Sequence[int] | None = None) -> DataFrame:
        """``id, embedding, batch, cell`` of all rows, or of those in some cells (only their files are read)."""
        if not self._exists("rows"):
            return self.spark.createDataFrame([], _ROWS)
        rows = self.spark.read.schema(_ROWS).option("basePath", f"{self.root}/rows").parquet(f"{self.root}/rows")
        return rows if cells is None else rows.where(F.col("cell").isin([int(c) for c in cells]))

    def probed(self, query: Sequence[float], probes: int) -> list[int]:
        """The cells of the ``probes`` centres nearest to a vector, and the one outside."""
        centres = self.centres
        if len(query) != centres.shape[1]:
            return [OUTSIDE]
        scores = centres @ np.asarray(query, dtype=np.float64)
        return [OUTSIDE, *np.argsort(-scores, kind="stable")[:probes].tolist()]

    def top_k(self, query: Sequence[float], k: int, probes: int | None = None) -> DataFrame:
        """``id, embedding, score`` of the k nearest rows to one vector; an empty one finds none."""
        cells = None if probes is None else self.probed(query, probes)
        return search.search_chunks(self.rows(cells).drop("batch", "cell"), query, k)

    def top_k_per_query(self, queries: DataFrame, k: int, probes: int | None = None, block: int = search.QUERY_BLOCK) -> DataFrame:
        """``query_id, id, score, rn``: the k nearest rows to each of many vectors.

        With ``probes`` a block of queries is broadcast with the cells of each; the files of these cells
        are read once, and a row is compared only with the queries that probe its cell.
        """
        if probes is None:
            return search.top_k_per_query(self.rows(), queries, k, block)
        answers = []
        for part in search.query_blocks(queries, block):
            asked: dict[int, list[tuple[str, np.ndarray]]] = {}
            for query_id, vector in part:
                for cell in self.probed(vector, probes):
                    asked.setdefault(cell, []).append((query_id, vector))
            held = self.spark.sparkContext.broadcast(asked)
            found = self.rows(list(asked)).select("id", "embedding", "cell").mapInArrow(
                _nearest_in_cells(held, k), "query_id string, id string, score double")
            answers.append(checkpoint(search.best_of(found, k).drop("rn")))
            held.destroy()
        if not answers:
            return self.spark.createDataFrame([], "query_id string, id string, score double, rn int")
        return search.best_of(reduce(DataFrame.unionByName, answers), k)

    def recall(self, queries: DataFrame, k: int, probes: int) -> float:
        """Share of the exact k nearest rows that are found with ``probes``; 1.0 where there are none."""
        exact = checkpoint(self.top_k_per_query(queries, k).select("query_id", "id"))
        found = self.top_k_per_query(queries, k, probes).select("query_id", "id")
        n = exact.count()
        return exact.join(found, ["query_id", "id"], "left_semi").count() / n if n else 1.0

    def tuned_probes(self, queries: DataFrame, k: int, least: float = 0.9) -> int:
        """The smallest power of two of probes (all cells at most) with a recall of ``least`` on some queries."""
        probes = 1
        while probes < len(self.centres) and self.recall(queries, k, probes) < least:
            probes *= 2
        return min(probes, max(1, len(self.centres)))


def _nearest_in_cells(held, k: int):
    """``held``: a broadcast map from cell to (query_id, vector)."""

    class _Value:
        def __init__(self, value: list) -> None:
            self.value = value

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, list[tuple[float, str]]] = {}
        for batch in batches:
            cells = batch.column(2).to_numpy(zero_copy_only=False)
            for cell in np.unique(cells):
                rows = batch.take(pa.array(np.flatnonzero(cells == cell)))
                for found in search.nearest_in_partition(_Value(held.value.get(int(cell), [])), k)(iter([rows])):
                    fresh: dict[str, list[tuple[float, str]]] = {}
                    for query_id, i, score in zip(*(found.column(j).to_pylist() for j in range(3))):
                        fresh.setdefault(query_id, []).append((score, i))
                    for query_id, more in fresh.items():
                        best[query_id] = sorted(best.get(query_id, []) + more, key=lambda f: (-f[0], f[1]))[:k]
        out = [(q, i, s) for q, found in best.items() for s, i in found]
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[j] for o in out], t) for j, t in enumerate((pa.string(), pa.string(), pa.float64()))],
                ["query_id", "id", "score"])

    return scan
