"""Joins, ordered shifts and text assembly that hold when one key is hot.

A key is hot when it has more rows than ``HOT_ROWS``. Hot keys are found with a
mergeable heavy-hitter sketch, so no key-by-key count is shuffled, and at most
``MAX_HOT_KEYS`` of them come out: that list and at most ``MAX_CUTS`` cuts are broadcast here.
A key the sketch misses is still joined rightly, only unsalted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram.session import checkpoint

HOT_ROWS = 2_000_000
MAX_HOT_KEYS = 1000
TRACKED_KEYS = 16384
SKETCH_GROUPS = 128
MAX_CUTS = (1 << 17) - 1
#: Bits of the bitmap that keys are hashed to; 16 MB at most are broadcast.
KEY_BITS = 1 << 27
SAMPLED = 8


def hot_keys(rows: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Hashes of the hot keys and the number of ways to split each."""
    hashed = rows.select(F.xxhash64(*keys).alias("h"), F.spark_partition_id().alias("p"))
    # sketches are merged in two steps, so that no task receives one per map task
    sketches = hashed.groupBy(F.pmod("p", F.lit(SKETCH_GROUPS)).alias("g")).agg(
        F.expr(f"approx_top_k_accumulate(h, {TRACKED_KEYS})").alias("s")
    )
    # grouped, so that no rows give no sketch
    top = sketches.groupBy(F.lit("all").alias("a")).agg(F.expr(f"approx_top_k_combine(s, {TRACKED_KEYS})").alias("s"))
    counted = top.select(F.inline(F.expr(f"approx_top_k_estimate(s, {MAX_HOT_KEYS})")).alias("_hot", "_rows"))
    ways = F.ceil(F.col("_rows") / F.lit(hot_rows)).cast("int")
    return counted.filter(F.col("_rows") > hot_rows).select("_hot", ways.alias("_ways"))


def salted(
    rows: DataFrame, hot: DataFrame, keys: Sequence[str], salt_on: Sequence[str] | None = None
) -> DataFrame:
    """Spread the rows of hot keys over ``_salt`` by a hash of ``salt_on``."""
    salts = [F.col(c) for c in (salt_on or rows.columns)]
    return (
        rows.withColumn("_hot", F.xxhash64(*keys))
        .join(F.broadcast(hot), "_hot", "left")
        .withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*salts), "_ways"), F.lit(0)).cast("int"))
        .drop("_hot", "_ways")
    )


def copied(per_key: DataFrame, hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Copy the rows of each hot key to every ``_salt`` its rows were spread over."""
    return (
        per_key.withColumn("_hot", F.xxhash64(*keys))
        .join(F.broadcast(hot), "_hot", "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_ways", F.lit(1)) - 1)))
        .drop("_hot", "_ways")
    )


def join_back(
    rows: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    salt_on: Sequence[str] | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join rows to a table with few rows per key, salting the hot keys of rows."""
    keys = list(keys)
    hot = hot_keys(rows, keys, hot_rows)
    left, right = salted(rows, hot, keys, salt_on), copied(per_key, hot, keys)
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def maybe_among(rows: DataFrame, key: Column, keys: DataFrame, stays: Column | None = None) -> DataFrame:
    """Rows whose key may be among ``keys`` (one column), and those that ``stays`` names, before a join shuffles them.

    A broadcast bitmap of hashes: no row of a key that is there gets lost, of the others few remain.
    """
    def bit(of: Column) -> Column:
        return F.pmod(F.xxhash64(of), F.lit(KEY_BITS)) + 1

    given = keys.columns[0]
    held = keys.filter(F.col(given).isNotNull()).select(bit(F.col(given)).alias("_bit"))
    # dealt first, so that a piece is built by one task
    held = held.withColumn("_piece", F.bitmap_bucket_number("_bit")).repartition("_piece")
    bits = held.groupBy("_piece").agg(F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias("_bits"))
    at = F.bitmap_bit_position("_bit")
    byte = F.ascii(F.decode(F.substring("_bits", (F.col("_at") / 8).cast("int") + 1, F.lit(1)), "ISO-8859-1"))
    is_set = F.getbit(byte, F.pmod("_at", F.lit(8)).cast("int")) == 1
    is_set = F.coalesce(is_set, F.lit(False)) & F.col("_key").isNotNull()
    placed = rows.withColumn("_key", key).withColumn("_bit", bit(F.col("_key")))
    placed = placed.withColumn("_piece", F.bitmap_bucket_number("_bit")).withColumn("_at", at)
    met = placed.join(F.broadcast(bits), "_piece", "left")
    return met.filter(is_set if stays is None else is_set | stays).select(*rows.columns)


def _place(position: Column, cuts: Column) -> Column:
    """How many of the sorted cuts are not above a position, by halving."""
    jumps = F.array(*[F.lit(1 << bit) for bit in reversed(range(MAX_CUTS.bit_length()))])

    def step(at: Column, jump: Column) -> Column:
        return F.when(F.get(cuts, at + jump - 1) <= position, at + jump).otherwise(at)

    return F.aggregate(jumps, F.lit(0), step)


def sliced(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    hot_rows: int = HOT_ROWS,
    slices: int | None = None,
) -> DataFrame:
    """Cut hot keys into consecutive runs of rows, numbered in ``_slice``.

    Without a hot key the rows come back as they are. Otherwise each hot key gets cuts from a sample
    of its positions taken by their hash, about one per ``hot_rows`` rows (``slices``: at least so many
    a key). The slice follows from a row's own position and the stored cuts, wherever and however often
    it is computed. Beyond ``MAX_CUTS`` cuts in all, which are broadcast, slices grow instead.
    """
    hot = checkpoint(hot_keys(rows, keys, hot_rows))
    ways = hot.agg(F.sum(F.greatest("_ways", F.lit(slices or 1)))).first()[0]
    if ways is None:
        return rows
    position = F.struct(*order)
    wanted = F.greatest("_ways", F.lit(slices or 1)) / F.lit(max(ways / MAX_CUTS, 1.0))
    share = F.lit(float(SAMPLED)) * wanted / (F.col("_ways") * F.lit(hot_rows))
    sampled = (
        rows.withColumn("_hot", F.xxhash64(*keys))
        .join(F.broadcast(hot), "_hot")
        .filter(F.pmod(F.xxhash64(*keys, *order), F.lit(1 << 40)) < share * F.lit(float(1 << 40)))
    )
    # bounded: SAMPLED positions per cut
    cuts = checkpoint(
        sampled.groupBy("_hot").agg(F.sort_array(F.collect_set(position)).alias("_cuts"))
        .withColumn("_cuts", F.filter("_cuts", lambda _, i: i % SAMPLED == SAMPLED - 1))
    )
    return (
        rows.withColumn("_hot", F.xxhash64(*keys))
        .join(F.broadcast(cuts), "_hot", "left")
        .withColumn("_slice", F.when(F.col("_cuts").isNull(), 0).otherwise(_place(position, F.col("_cuts"))))
        .drop("_hot", "_cuts")
    )


def ordered_shift(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    out: str,
    ahead: bool = False,
) -> DataFrame:
    """``lag`` (or ``lead``) of a column over rows prepared by ``sliced``.

    Inside a slice it is a window; across slices the edge values travel through
    a small table with one row per key and slice.
    """
    keys = list(keys)
    shift = F.lead if ahead else F.lag
    if "_slice" not in rows.columns:
        return rows.withColumn(out, shift(value).over(W.partitionBy(*keys).orderBy(*order)))
    shifted = F.struct(F.col(value).alias("v"))
    window = W.partitionBy(*keys, "_slice").orderBy(*order)
    position = F.struct(*[F.col(c) for c in order])
    edge = (F.min_by if ahead else F.max_by)(shifted, position)
    edges = rows.groupBy(*keys, "_slice").agg(edge.alias("_edge"))
    # bounded: one row per slice of the key
    across = W.partitionBy(*keys).orderBy("_slice")
    edges = edges.select(*keys, "_slice", shift("_edge").over(across).alias("_next_edge"))
    inside = rows.withColumn("_inside", shift(shifted).over(window))
    return (
        inside.join(edges, [*keys, "_slice"], "left")
        .withColumn(out, F.coalesce("_inside", "_next_edge")["v"])
        .drop("_inside", "_next_edge")
    )


def joined_lines(rows: DataFrame, keys: Sequence[str], order: Sequence[str], line: str, out: str) -> DataFrame:
    """The lines of each key in order as one text.

    By the same rule at every size; what such a text is made for (a prompt, a
    summary) needs it whole. Operators keep lines as rows until here.
    """
    packed = F.sort_array(F.collect_list(F.struct(*order, F.col(line).alias("_line"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(packed, lambda s: s["_line"]), "").alias(out))
