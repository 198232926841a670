"""Mixing sources to target weights by cube-method balanced sampling.

A source that should give ``target`` of its ``source_size`` words repeats each document
``floor(target / source_size)`` times and draws the rest with a fractional probability. The draw
is balanced: the flight phase moves the probabilities of three documents at a time along the null
space of their word and document counts until one of them is 0 or 1. Flights run in bounded
blocks of a source; what each block leaves open (two documents at most) flies again in the next
round, until a source fits one block and its last documents are landed as close to the words due
as they can be.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from engram.session import checkpoint

BLOCK_ROWS = 4096
REPEATS = 3


def word_count(text: str) -> Column:
    """Number of runs of characters other than space and 0x09-0x0D (null: 0)."""
    body, blank = F.coalesce(F.col(text), F.lit("")), [" ", "\t", "\n", "\x0b", "\x0c", "\r"]
    edges = F.substring(body, 1, 1).isin(blank).cast("int") + F.right(body, F.lit(1)).isin(blank).cast("int")
    return F.when(body == "", 0).otherwise(F.size(F.split(body, "[\\x20\\x09-\\x0D]+")) - edges).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Weights are 1, 2, 3, repeating, over the sources by code point with null last. Targets share
    all words by weight, none above three times its source's size; excess is shared again. Each
    round is one small aggregate, the table of sources stays distributed.
    """
    spread = checkpoint(sizes.select(
        "source", "source_size",
        (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(3)) + 1).alias("weight"),
        F.lit(False).alias("full"),
    ))
    total = spread.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        full = F.lit(REPEATS) * F.col("source_size") < F.lit(level) * F.col("weight")
        full = full | (F.col("source_size") == 0)
        row = spread.agg(
            F.sum(F.when(full, F.col("source_size")).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight"))),
            F.count(F.when(full, 1)),
        ).first()
        if row[2] == capped or not row[1]:
            break
        capped, level = row[2], (total - REPEATS * row[0]) / row[1]
    return spread.select(
        "source", "source_size", F.when(full, F.col("source_size") * F.lit(float(REPEATS))).otherwise(F.lit(level) * F.col("weight")).alias("target")
    )


def flight(sizes: list[int], chances: list[float], seed: int) -> list[float]:
    """Moves the chances to 0 or 1, keeping their sum and the sum of ``size * chance``; two stay open at most."""
    dice, chances, open_ = random.Random(seed), list(chances), []
    for i, chance in enumerate(chances):
        if not 0.0 < chance < 1.0:
            continue
        open_.append(i)
        while len(open_) == 3 or len(open_) == 2 and sizes[open_[0]] == sizes[open_[1]]:
            x = [float(sizes[j]) for j in open_]
            # null space of the rows (1, 1, 1) and (x1, x2, x3); of two equal sizes, (1, -1)
            u = [x[1] - x[2], x[2] - x[0], x[0] - x[1]] if len(x) == 3 else [1.0, -1.0]
            if not any(u):
                u = [1.0, -1.0, 0.0]
            rise = min((1 - chances[j]) / d if d > 0 else chances[j] / -d for j, d in zip(open_, u) if d)
            fall = min(chances[j] / d if d > 0 else (1 - chances[j]) / -d for j, d in zip(open_, u) if d)
            step = rise if dice.random() * (rise + fall) < fall else -fall
            for j, d in zip(open_, u):
                moved = chances[j] + step * d
                chances[j] = 0.0 if moved < 1e-9 else 1.0 if moved > 1 - 1e-9 else moved
            open_ = [j for j in open_ if 0.0 < chances[j] < 1.0]
    return chances


def landing(sizes: list[int], chances: list[float]) -> list[float]:
    """Rounds the last open chances so that the words taken come nearest to those due."""
    open_ = [i for i, c in enumerate(chances) if 0.0 < c < 1.0]
    due = sum(sizes[i] * chances[i] for i in open_)
    best = min(range(1 << len(open_)), key=lambda m: (abs(sum(sizes[i] for k, i in enumerate(open_) if m >> k & 1) - due), m))
    return [float(best >> open_.index(i) & 1) if i in open_ else c for i, c in enumerate(chances)]


def _fly(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["id", "size", "copy"], na_position="last").reset_index(drop=True)
    sizes = pdf["size"].tolist()
    chances = flight(sizes, pdf["chance"].tolist(), int(pdf["seed"].iloc[0]))
    pdf["chance"] = landing(sizes, chances) if bool(pdf["alone"].iloc[0]) else chances
    return pdf[["source", "id", "size", "copy", "chance"]]


def mixed(docs: DataFrame, seed: int = 0, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``id, source, size, copies, source_size, target, whole, drawn`` per distinct (id, source, size).

    Each of the ``copies`` rows is taken ``whole`` times, and ``drawn`` of them once more. Null
    texts count no words, null sources are one source (last), null ids are allowed. Rows that
    repeat id, source and size are drawn one by one. Reruns agree; an empty table gives none.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(source).cast("string").alias("source"), word_count(text).alias("size"))
    rows = checkpoint(rows.groupBy("id", "source", "size").agg(F.count("*").alias("copies")))
    totals = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    plan = targets(totals).withColumnRenamed("source", "s")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("whole", F.floor(ratio + 1e-9).cast("long"))
    rows = checkpoint(rows.withColumn("chance", F.greatest(ratio - F.col("whole"), F.lit(0.0))))
    open_ = rows.where("chance > 0").select("source", "id", "size", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"), "chance")
    settled, number = [], 0
    while True:
        sizes = open_.groupBy(F.col("source").alias("s")).agg(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).alias("blocks"))
        dealt = open_.join(sizes, F.col("source").eqNullSafe(F.col("s"))).select(
            "source", "id", "size", "copy", "chance", (F.col("blocks") == 1).alias("alone"),
            F.pmod(F.xxhash64("id", "size", "copy", F.lit(seed), F.lit(number)), F.col("blocks")).alias("block"),
        ).withColumn("seed", F.xxhash64("source", "block", F.lit(seed), F.lit(number)))
        flown = checkpoint(dealt.groupBy("source", "block").applyInPandas(
            _fly, "source string, id bigint, size bigint, copy bigint, chance double"))
        settled.append(flown.where("chance = 1").select(
            F.col("source").alias("s"), F.col("id").alias("i"), F.col("size").alias("z")))
        open_ = flown.where("chance > 0 AND chance < 1")
        number += 1
        if open_.isEmpty():
            break
    drawn = settled[0]
    for more in settled[1:]:
        drawn = drawn.unionByName(more)
    drawn = drawn.groupBy("s", "i", "z").agg(F.count("*").alias("drawn"))
    same = F.col("id").eqNullSafe(F.col("i")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))
    return rows.join(drawn, same, "left").select(
        "id", "source", "size", "copies", "source_size", "target", "whole", F.coalesce("drawn", F.lit(0).cast("long")).alias("drawn"))


def taken_rows(docs: DataFrame, seed: int = 0, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs``, with their columns, each as often as the mix takes it."""
    safe = [f"c{i}" for i in range(len(docs.columns))]
    plan = checkpoint(mixed(docs, seed, doc_id, text, source)).select("id", "source", "size", "copies", "whole", "drawn")
    rows = docs.select(
        *(F.col(f"`{c}`").alias(s) for c, s in zip(docs.columns, safe)), F.col(doc_id).cast("long").alias("_id"),
        F.col(source).cast("string").alias("_source"), word_count(text).alias("_size"), F.xxhash64(text).alias("_mark"))
    same = F.col("_id").eqNullSafe(F.col("id")) & F.col("_source").eqNullSafe(F.col("source")) & (F.col("_size") == F.col("size"))
    found = rows.join(plan, same)
    copy = F.lit(1)
    if not plan.where("copies > 1").isEmpty():  # rows that repeat an id are numbered
        copy = F.row_number().over(Window.partitionBy("_id", "_source", "_size").orderBy("_mark"))
    times = F.col("whole") + (F.col("_copy") <= F.col("drawn")).cast("long")
    return found.withColumn("_copy", copy).withColumn("_times", times).where("_times > 0").withColumn(
        "_take", F.explode(F.sequence(F.lit(1).cast("long"), "_times"))).select(*(F.col(s).alias(c) for c, s in zip(docs.columns, safe)))
