"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from engram.session import checkpoint

#: Edges for each task of a step, and the least tasks; more would leave small graphs as very many small files.
TASK_EDGES, LEAST_TASKS = 1 << 16, 8


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def in_tasks(rows: DataFrame, count: int, each: int = TASK_EDGES) -> DataFrame:
    """The rows in no more tasks than ``count`` of them need at ``each`` a task; none is shuffled."""
    return rows.coalesce(max(LEAST_TASKS, -(-count // each)))


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int | None = None) -> DataFrame:
    """``id, component`` of every node of an edge; the component is its smallest id.

    Alternates large-star and small-star steps until nothing changes. Each step is a combinable
    minimum per node and a join that adaptive execution may split, so a hub is never one task; a
    step has as many tasks as its edges need, whatever the number of shuffle partitions. Lineage is
    cut by a reliable checkpoint. ``most``: about how many edges there are, where that is known before. Edges with a null end and loops are ignored, repeats change
    nothing, no edges give no rows.
    """
    edges = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    edges = checkpoint(edges if most is None else in_tasks(edges, most))
    mark = _mark(edges)

    def dealt(rows: DataFrame) -> DataFrame:
        return in_tasks(rows, mark[0])

    while mark[0]:
        edges = dealt(edges)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = dealt(both.groupBy("u").agg(F.min("v").alias("m"))).select("u", F.least("u", "m").alias("m"))
        large = dealt(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = dealt(large.distinct())
        least = dealt(large.groupBy("u").agg(F.min("v").alias("m")))
        small = dealt(large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = checkpoint(dealt(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()))
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    roots = dealt(edges.select("v").distinct())
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        roots.select(F.col("v").alias("id"), F.col("v").alias("component"))
    )
