"""Shards that match the mixture: proportional stratified interleaving.

Rows of each source are ranked in a seeded order; all rows are then sorted by their fractional
rank ``(2 rank - 1) / (2 n)`` within the source, and the sequence is cut into shards of equal
counts, so every stretch of it holds each source in proportion.

Neither ranking gathers a source or the table: ranks are counted inside bounded buckets (by hash
within a source, by fractional rank overall) and completed by running sums over bucket counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from engram.session import checkpoint

#: Rows that one bucket, and so one window group, holds on average.
BUCKET_ROWS = 4096
_ADDED = ("size", "text_crc32", "shard", "slot")


def _bytes(text: str) -> Column:
    return F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b""))


def interleaved(
    docs: DataFrame, shards: int, seed: str = "0", doc_id: str = "doc_id", text: str = "text", source: str = "source",
    carry: list[str] | None = None,
) -> DataFrame:
    """The columns of ``docs`` (or those named in ``carry``) with ``size, text_crc32, shard, slot``.

    Columns of ``docs`` with those names are replaced.

    Shard counts differ by one at most and slots are gapless from 0. The order depends on the
    seed, ids and texts only. Null ids, sources and texts are values of their own (a null text has
    no bytes); equal rows share a place in an order that makes no difference. An empty table gives
    an empty result.
    """
    names = [c for c in (docs.columns if carry is None else carry) if c.lower() not in _ADDED]
    safe = [f"c{i}" for i in range(len(names))]
    rows = docs.select(
        *(F.col(f"`{c}`").alias(s) for c, s in zip(names, safe)),
        (F.length(_bytes(text)) + 8).cast("long").alias("_size"),
        F.crc32(_bytes(text)).alias("_crc"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))).alias("_key"),
        F.col(source).alias("_source"),
    )
    n = rows.count()
    parts = max(1, n // BUCKET_ROWS)
    prefix = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("_part", F.floor(prefix * parts / F.lit(1 << 32)).cast("long"))
    counts = rows.groupBy("_source", "_part").agg(F.count("*").alias("c"))
    by_source = Window.partitionBy("_source")
    before = checkpoint(counts.select(
        F.col("_source").alias("s"), F.col("_part").alias("p"),
        (F.sum("c").over(by_source.orderBy("_part")) - F.col("c")).alias("_before"),
        F.sum("c").over(by_source).alias("_n"),
    ))
    order = [F.col("_key"), F.col("_crc"), F.col("_size")]
    ranked = (
        rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_source", "_part").orderBy(*order)))
        .join(before, F.col("_source").eqNullSafe(F.col("s")) & (F.col("_part") == F.col("p")))
        .withColumn("_rank", F.col("_rank") + F.col("_before"))
        .withColumn("_at", (2 * F.col("_rank") - 1) / (2 * F.col("_n")))
        .withColumn("_slice", F.floor(F.col("_at") * parts).cast("long"))
        .drop("s", "p", "_before", "_part", "_n", "_rank")
    )
    ranked = checkpoint(ranked)
    slices = ranked.groupBy("_slice").agg(F.count("*").alias("c"))
    # one row per bucket: a running sum over the bucket counts alone
    running = slices.select(F.col("_slice"), (F.sum("c").over(Window.orderBy("_slice")) - F.col("c")).alias("_before"))
    place = Window.partitionBy("_slice").orderBy("_at", *order)
    # shard k takes the positions p with p * shards // n = k
    shard = F.expr(f"(_position * {shards}L) div {max(n, 1)}L")
    first = F.expr(f"(shard * {max(n, 1)}L + {shards - 1}L) div {shards}L")
    return (
        ranked.withColumn("_position", F.row_number().over(place) - 1)
        .join(running, "_slice").withColumn("_position", F.col("_position") + F.col("_before"))
        .withColumn("shard", shard.cast("int")).withColumn("slot", F.col("_position") - first)
        .select(*(F.col(s).alias(c) for c, s in zip(names, safe)), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), "shard", "slot")
    )
