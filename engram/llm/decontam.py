"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents long, so set similarity says nothing; what counts is the share
of an item's shingles that a document holds. Items are partitioned by the size of their shingle
sets (powers of two). Each item is sketched by the shingles at sixteen MinHash minima; a document
of at least the partition's needed size becomes a candidate when it holds three or more of the
sixteen, which an item contained to 0.8 misses about once in a hundred million. Candidates are
then verified by the exact shared count of whole sets.

The items are a query set: they are taken in blocks of a bounded number, each block a broadcast
sketch (at most 16 entries an item) and one pass over all documents. Documents are never shuffled
whole; a candidate document carries its own set to the verification.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from engram.llm import kernels
from engram.llm.near_dedup import shingle_table
from engram.session import checkpoint

HASHES, NEEDED_HITS = 16, 3
#: Items of one block and so of one pass over the documents; bounds the broadcast to about 6 MB.
BLOCK = 16384

_odd = kernels.mix(np.arange(71, 71 + HASHES, dtype=np.uint64)) | np.uint64(1)


def sketch(items: list[tuple[int, np.ndarray]], containment: float) -> dict[str, np.ndarray]:
    """Sorted sketch entries of a block: shingle, item number, multiplicity; and each item's partition."""
    entries: list[tuple[int, int, int]] = []
    least = np.zeros(len(items), np.int64)
    for i, (_, shingles) in enumerate(items):
        partition = len(shingles).bit_length() - 1
        least[i] = math.ceil(containment * (1 << partition) - 1e-9)  # smallest document that can hold one
        chosen = [int(shingles[np.argmin(shingles * a)]) for a in _odd]
        entries += [(s, i, chosen.count(s)) for s in set(chosen)]
    entries.sort()
    shingle, item, times = (np.array([e[k] for e in entries], np.uint64 if k == 0 else np.int64) for k in range(3))
    light = np.zeros(1 << 20, bool)
    light[(shingle >> np.uint64(44)).astype(np.int64)] = True
    return {"shingle": shingle, "item": item, "times": times, "least": least, "light": light,
            "ids": np.array([i for i, _ in items], np.int64)}


def _hits(found: np.ndarray, block: dict[str, np.ndarray]) -> np.ndarray:
    """Numbers of the block's items that the document of these shingles may contain."""
    found = found[block["light"][(found >> np.uint64(44)).astype(np.int64)]]
    low = np.searchsorted(block["shingle"], found, "left")
    spans = np.searchsorted(block["shingle"], found, "right") - low
    if not spans.any():
        return np.zeros(0, np.int64)
    low, spans = low[spans > 0], spans[spans > 0]
    entry = np.repeat(low, spans) + np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans)
    hits = np.bincount(block["item"][entry], weights=block["times"][entry])
    return np.flatnonzero(hits >= NEEDED_HITS)


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            data, offsets = kernels.texts(batch.column(1))
            for a, b in kernels.pieces(offsets):
                hashes, at = kernels.shingles(data, offsets[a : b + 1])
                maybe = np.zeros(b - a, np.int64)
                if len(hashes):
                    hit = block["light"][(hashes >> np.uint64(44)).astype(np.int64)]
                    maybe = np.diff(np.concatenate([[0], np.cumsum(hit)])[at])
                rows, items, sets = [], [], []
                for d in np.flatnonzero(maybe):
                    own = np.unique(hashes[at[d] : at[d + 1]])
                    chosen = _hits(own, block)
                    chosen = chosen[block["least"][chosen] <= len(own)]
                    if len(chosen):
                        rows.append(a + int(d))
                        items.append(block["ids"][chosen].tolist())
                        sets.append(own)
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(rows)), pa.array(items, pa.list_(pa.int64())), kernels.as_lists(sets)],
                        names=["doc", "items", "own"],
                    )

    return run


def contained_items(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", containment: float = 0.8,
) -> DataFrame:
    """``doc_id, item_id, n_item, n_shared, containment`` of each item that a document contains.

    A pair is returned when the document holds at least ``containment`` (whole hundredths) of the
    item's distinct five-word shingles. Items and texts of one to four words are one shingle;
    null or empty ones have none and never match. Rows without an id are left out. Repeated rows
    of a document give one row per item; an item id with several texts matches by the best one.
    Other columns are ignored; without items or documents the result is empty.
    """
    spark = docs.sparkSession
    item_sets = checkpoint(
        shingle_table(items.where(F.col(item_id).isNotNull()), item_id, item_text)
        .where(F.size("shingles") > 0).toDF("item", "shingles").distinct()
    )
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    blocks = max(1, math.ceil(item_sets.count() / BLOCK))
    found = None
    for number in range(blocks):
        own = item_sets if blocks == 1 else item_sets.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == number)
        taken = [(r.item, np.array(r.shingles, np.int64).view(np.uint64)) for r in own.collect()]  # one block of queries
        shared = spark.sparkContext.broadcast(sketch(taken, containment))
        some = rows.mapInArrow(_search(shared), "doc bigint, items array<bigint>, own array<bigint>")
        found = some if found is None else found.unionByName(some)
    shared_size = F.size(F.array_intersect("own", "shingles")).cast("long")
    return (
        found.select("doc", F.explode("items").alias("item"), "own").join(item_sets, "item")
        .select("doc", "item", F.size("shingles").cast("long").alias("n_item"), shared_size.alias("n_shared"))
        .where(F.lit(100) * F.col("n_shared") >= round(containment * 100) * F.col("n_item"))
        .groupBy("doc", "item").agg(F.max(F.struct(F.col("n_shared") / F.col("n_item"), "n_item", "n_shared")).alias("best"))
        .select(
            F.col("doc").alias(doc_id), F.col("item").alias(item_id), "best.n_item", "best.n_shared",
            F.col("best.col1").alias("containment"),
        )
    )


def contaminated(docs: DataFrame, items: DataFrame, **names) -> DataFrame:
    """``doc_id, items`` of the documents that contain an item."""
    doc_id, item_id = names.get("doc_id", "doc_id"), names.get("item_id", "item_id")
    return contained_items(docs, items, **names).groupBy(doc_id).agg(F.sort_array(F.collect_set(item_id)).alias("items"))
