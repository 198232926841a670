"""Connected components by random contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.operators.skew import HOT_ROWS, join_back
from engram.session import checkpoint

#: Edges, in both directions, that one task may hold; fewer are contracted there at once.
FEW_EDGES = 1 << 20


def connected_components(edges: DataFrame, a: str, b: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The smallest id connected with each node of an edge: id, component.

    In each round a node joins whichever of itself and its neighbours has the least hash, with a new
    hash per round, and the edges move to these representatives; the nodes left shrink by a constant
    share in expectation, on long paths too. Where half of the nodes have one neighbour, these join it in
    the first round, and the others stay. Representatives are a combinable minimum, and joins on
    hubs are salted. The last ``FEW_EDGES`` meet in one task. Loops and edges with a null end are ignored.
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    both = ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b")))
    live, rounds = checkpoint(both.distinct()), []
    while count := live.count():
        if count <= FEW_EDGES:
            kind = live.schema["a"].dataType.simpleString()
            joined = checkpoint(live.repartition(1).mapInArrow(_contracted, f"id {kind}, rep {kind}"))
            rounds.append((joined, joined.count()))
            break

        def marked(node: str) -> Column:
            return F.struct(F.xxhash64(F.lit(len(rounds)), node).alias("h"), F.col(node).alias("id"))

        least = live.groupBy(F.col("a").alias("id")).agg(F.min(marked("b")).alias("m"), F.count(F.lit(1)).alias("n"))
        rep = F.least("m", marked("id"))["id"]
        if not rounds:
            least = checkpoint(least)
            nodes, leaves = least.agg(F.count(F.lit(1)), F.count(F.when(F.col("n") == 1, 1))).first()
            if leaves * 2 >= nodes:
                rep = F.when(F.col("n") == 1, F.col("m.id")).otherwise(F.col("id"))
        joined = checkpoint(least.select("id", rep.alias("rep")))
        rounds.append((joined, joined.count()))
        for end in ("a", "b"):
            moved = joined.select(F.col("id").alias(end), F.col("rep").alias("_rep"))
            # no node can be hot in a table of so few rows
            met = live.join(moved, end) if count <= hot_rows else checkpoint(join_back(live, moved, [end], hot_rows=hot_rows))
            live = met.drop(end).withColumnRenamed("_rep", end)
        live = checkpoint(live.select("a", "b").filter("a <> b").distinct())
    if not rounds:
        return both.select(F.col("a").alias("id"), F.col("b").alias("component"))
    found, nodes = rounds.pop()
    while rounds:
        later = found.select(F.col("id").alias("rep"), F.col("rep").alias("_rep"))
        earlier, nodes = rounds.pop()
        met = (
            earlier.join(later, "rep", "left") if nodes <= hot_rows
            else join_back(earlier, later, ["rep"], "left", salt_on=["id"], hot_rows=hot_rows)
        )
        found = checkpoint(met.select("id", F.coalesce("_rep", "rep").alias("rep")))
    named = found.groupBy("rep").agg(F.min("id").alias("component"))
    met = found.join(named, "rep") if nodes <= hot_rows else join_back(found, named, ["rep"], salt_on=["id"], hot_rows=hot_rows)
    return met.select("id", "component")


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A representative of the component of each node: id, rep; every edge comes in both directions."""
    edges = pa.Table.from_batches(batches)
    ids = pa.chunked_array([*edges["a"].chunks, *edges["b"].chunks]).combine_chunks().dictionary_encode()
    places = ids.indices.to_numpy()
    a, b = places[:len(edges)], places[len(edges):]
    rep = np.arange(len(ids.dictionary))
    while (rep[a] != rep[b]).any():
        np.minimum.at(rep, rep[a], rep[b])
        while (rep[rep] != rep).any():
            rep = rep[rep]
    yield pa.RecordBatch.from_arrays([ids.dictionary, ids.dictionary.take(pa.array(rep))], ["id", "rep"])
