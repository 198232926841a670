"""Entity resolution: hybrid name and vector matching, then greedy merging."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.config import DEFAULTS
from engram.functions.text import trim_space
from engram.functions.vectors import norm
from engram.operators.search import rows_by_size
from engram.operators.skew import HOT_ROWS, copied, hot_keys, salted
from engram.session import checkpoint

CELL_FORMS = 2000
MAX_PIVOTS = 4096
#: Blocks that distinct vectors are cut into, the least rows of a block and the most components in it.
BLOCKS, LEAST_BLOCK, BLOCK_COMPONENTS = 24, 1024, 1 << 22
_STEP = 2048  # rows and columns of one product
_SLACK = 1e-6


def jaro_winkler(a: str, b: str) -> float:
    """Jaro-Winkler over UTF-8 bytes; the prefix boost always applies."""
    if a == b:
        return 1.0
    x, y = a.encode(), b.encode()
    if not x or not y:
        return 0.0
    reach = max(max(len(x), len(y)) // 2 - 1, 0)
    taken = bytearray(len(y))
    left = []
    for i, byte in enumerate(x):
        low, high = max(0, i - reach), min(len(y), i + reach + 1)
        j = y.find(byte, low, high)
        while j >= 0 and taken[j]:
            j = y.find(byte, j + 1, high)
        if j >= 0:
            taken[j] = 1
            left.append(byte)
    if not left:
        return 0.0
    right = [byte for byte, used in zip(y, taken) if used]
    m = len(left)
    t = sum(p != q for p, q in zip(left, right)) / 2
    jaro = (m / len(x) + m / len(y) + (m - t) / m) / 3
    prefix = 0
    for p, q in zip(x[:4], y[:4]):
        if p != q:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


@F.pandas_udf(T.DoubleType())
def jaro_winkler_column(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler(p, q) for p, q in zip(a, b)], dtype="float64")


def name_forms(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Collapse equal (name, vector) rows.

    Returns membership (entity_id, form) and the distinct forms (form, name,
    vector, length). Copies of one name meet through their form, so a name
    shared by a third of all entities never turns into pairs.
    """
    keyed = nodes.select(
        "entity_id", F.lower(trim_space(F.col("name"))).alias("name"), "embedding"
    ).withColumn(
        "form", F.md5(F.concat_ws("\u0001", "name", F.col("embedding").cast("string")))
    )
    membership = keyed.select("entity_id", "form").distinct()
    forms = (
        keyed.groupBy("form")
        .agg(F.first("name").alias("name"), F.first("embedding").alias("embedding"))
        .withColumn("length", norm(F.col("embedding")))
    )
    return membership, forms


def candidate_pairs(
    forms: DataFrame,
    threshold: float = DEFAULTS.resolution_threshold,
    vector_weight: float = DEFAULTS.resolution_vector_weight,
    name_weight: float = DEFAULTS.resolution_name_weight,
    cell_forms: int = CELL_FORMS,
) -> DataFrame:
    """Pairs of forms that score at least the threshold: form_a, form_b, score.

    A pair can reach the threshold only if its cosine is at least
    ``(threshold - name_weight) / vector_weight``, i.e. the unit vectors lie
    within a fixed radius. Distinct vectors are assigned to the nearest of a
    bounded set of pivots, and these cells are packed into blocks of bounded
    size. Each pair of blocks is one group; a vector is copied to those pairs
    that a cell within the radius of its own lies in (a partition-based metric
    similarity join, after Das Sarma et al., VLDB 2014), and the vectors of a
    group meet in blocked matrix products. The forms of near vectors
    meet then; those that their name lengths still allow get the string score.
    """
    least_cosine = (threshold - name_weight) / vector_weight
    if least_cosine <= 0:
        raise ValueError("threshold must exceed the weight of the name score")
    radius = float(np.sqrt(max(0.0, 2 - 2 * least_cosine))) + _SLACK
    usable = forms.filter((F.size("embedding") > 0) & (F.col("length") > 0))
    usable = checkpoint(usable.withColumn("vec", F.md5(F.col("embedding").cast("string"))))
    near = _near_vectors(
        usable.groupBy("vec").agg(F.first("embedding").alias("embedding"), F.first("length").alias("length")),
        least_cosine, radius, cell_forms,
    )
    named = usable.select("form", "name", "vec", F.octet_length("name").alias("bytes"))
    a = named.select(*[F.col(c).alias(f"{c}_a") for c in named.columns])
    b = named.select(*[F.col(c).alias(f"{c}_b") for c in named.columns])
    shorter = F.least("bytes_a", "bytes_b") / F.greatest("bytes_a", "bytes_b", F.lit(1))
    # equal names, blank ones too, score 1
    shorter = F.when(F.col("name_a") == F.col("name_b"), 1.0).otherwise(shorter)
    jaro_most = (F.lit(2.0) + shorter) / 3
    name_most = jaro_most + F.lit(0.4) * (1 - jaro_most)
    most = F.lit(vector_weight) * F.col("cos") + F.lit(name_weight) * name_most
    once = (F.col("vec_a") != F.col("vec_b")) | (F.col("form_a") < F.col("form_b"))
    # the joins are on written rows, so that skewed vectors are split at run time
    pairs = checkpoint(near.join(a, "vec_a")).join(b, "vec_b").filter(once & (most >= threshold - _SLACK))
    scored = pairs.withColumn(
        "score",
        F.lit(vector_weight) * F.col("cos")
        + F.lit(name_weight) * jaro_winkler_column(F.col("name_a"), F.col("name_b")),
    )
    return scored.filter(F.col("score") >= threshold).select("form_a", "form_b", "score")


def _near_vectors(vectors: DataFrame, least_cosine: float, radius: float, cell_rows: int) -> DataFrame:
    """Unordered pairs of distinct vectors, each with itself too: vec_a, vec_b, cos."""
    vectors = checkpoint(vectors)
    count = vectors.count()
    wanted = int(min(max(-(-count // cell_rows), 1), MAX_PIVOTS))
    given: dict[int, list] = {}
    for row in vectors.orderBy("vec").select("embedding").limit(wanted).collect():
        given.setdefault(len(row[0]), []).append(row[0])
    pivots = {d: _unit(np.asarray(v, dtype=np.float64)) for d, v in given.items()}
    rows = checkpoint(vectors.select("vec", "length", "embedding").mapInArrow(
        _homes(pivots), "vec string, length double, embedding array<float>, dims int, cell int, dist double"))
    # bounded: one row per cell
    cells = rows.groupBy("dims", "cell").agg(F.count("*").alias("n"), F.max("dist").alias("reach")).collect()
    placement = vectors.sparkSession.createDataFrame(
        _placement(cells, pivots, radius, count), "dims int, cell int, first int, parts int, others array<int>")
    placed = rows.drop("dist").join(F.broadcast(placement), ["dims", "cell"]).select(
        "vec", "length", "embedding", (F.col("first") + F.pmod(F.xxhash64("vec"), "parts")).cast("int").alias("block"),
        F.explode("others").alias("other"),
    )
    pairs = placed.select(
        "vec", "length", "embedding", (F.col("block") <= F.col("other")).alias("left"),
        F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
    )
    return pairs.groupBy("low", "high").applyInArrow(
        _products(least_cosine - _SLACK), "vec_a string, vec_b string, cos double")


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _homes(pivots: dict[int, np.ndarray], step: int = 512):
    """Add the nearest pivot of each vector and its distance; vectors without a finite one are near to none."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, (places, matrix) in rows_by_size(pa.chunked_array([batch.column(2)])).items():
                u = pivots.get(size, np.eye(1, size))
                matrix = _unit(matrix)
                for start in range(0, len(places), step):
                    away = np.sqrt(np.maximum(2 - 2 * (matrix[start:start + step] @ u.T), 0))
                    home = np.argmin(away, axis=1)
                    nearest = away[np.arange(len(away)), home]
                    kept = np.flatnonzero(np.isfinite(nearest))
                    source = batch.take(pa.array(places[start + kept]))
                    columns = [
                        *source.columns, pa.array(np.full(len(kept), size, np.int32)),
                        pa.array(home[kept].astype(np.int32)), pa.array(nearest[kept]),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, [*source.schema.names, "dims", "cell", "dist"])

    return place


def _placement(cells: list, pivots: dict[int, np.ndarray], radius: float, count: int) -> list[tuple]:
    """The blocks of each cell, and the blocks that hold a cell within reach of it.

    Neighbouring cells share blocks; a cell larger than a block is dealt to several.
    """
    out, block = [], -1
    for size in sorted({c.dims for c in cells}):
        most = max(min(max(-(-count // BLOCKS), LEAST_BLOCK), BLOCK_COMPONENTS // size), 1)
        u = pivots.get(size, np.eye(1, size))
        along = u @ np.linalg.svd(u, full_matrices=False)[2][0]
        own = sorted((c for c in cells if c.dims == size), key=lambda c: (along[c.cell], c.cell))
        held, spans = most + 1, []
        for c in own:
            parts = -(-c.n // most)
            if parts > 1 or held + c.n > most:
                block, held = block + 1, 0
            spans.append((block, parts))
            block, held = block + parts - 1, held + c.n
        at, reach = u[[c.cell for c in own]], np.array([c.reach for c in own])
        for i, c in enumerate(own):
            gaps = np.sqrt(np.maximum(2 - 2 * (at @ at[i]), 0))
            near = np.flatnonzero(gaps <= reach + c.reach + radius + _SLACK)
            # the root of a rounded zero is no zero, so a cell reaches itself in any case
            others = {first + k for first, parts in [spans[j] for j in near] + [spans[i]] for k in range(parts)}
            out.append((c.dims, c.cell, *spans[i], sorted(others)))
    return out


def _products(least: float):
    """Pairs of a group's two blocks whose cosine is at least ``least``."""

    def join(group: pa.Table) -> pa.Table:
        left = np.asarray(group.column("left").combine_chunks().to_numpy(zero_copy_only=False), dtype=bool)
        both = group.column("low")[0].as_py() == group.column("high")[0].as_py()
        (_, matrix), = rows_by_size(group.column("embedding")).values()
        length = group.column("length").to_numpy()
        first = np.flatnonzero(left)
        second = first if both else np.flatnonzero(~left)
        # single precision finds candidates, with slack for its rounding
        unit = _unit(matrix).astype(np.float32)
        rough, found = np.float32(least - 1e-4), [np.zeros((2, 0), np.int64)]
        cosines = [np.zeros(0)]
        for i in range(0, len(first), _STEP):
            a = first[i:i + _STEP]
            for j in range(i if both else 0, len(second), _STEP):
                b = second[j:j + _STEP]
                x, y = np.nonzero(unit[a] @ unit[b].T >= rough)
                if both:
                    x, y = x[i + x <= j + y], y[i + x <= j + y]
                for k in range(0, len(x), 1 << 16):
                    p, q = a[x[k:k + (1 << 16)]], b[y[k:k + (1 << 16)]]
                    dot = np.zeros(len(p))
                    for d in range(matrix.shape[1]):  # in the order of functions.vectors.cosine
                        dot += matrix[p, d] * matrix[q, d]
                    cos = dot / (length[p] * length[q])
                    near = cos >= least
                    found.append(np.stack([p[near], q[near]]))
                    cosines.append(cos[near])
        p, q = np.concatenate(found, axis=1)
        vec = group.column("vec")
        return pa.table({"vec_a": vec.take(pa.array(p)), "vec_b": vec.take(pa.array(q)), "cos": np.concatenate(cosines)})

    return join


def greedy_merges(membership: DataFrame, pairs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Who merges into whom when entities are taken in id order.

    An entity that is not merged yet absorbs every later matching one. That is
    the first-in-order maximal independent set of the match graph; it is found
    in rounds (Blelloch, Fineman and Shun, 2012): an entity with a smaller
    settled match is a duplicate, one without a smaller undecided match is
    settled. Matches are followed through forms, never as entity pairs.
    """
    both = pairs.select("form_a", "form_b").unionAll(
        pairs.select(F.col("form_b").alias("form_a"), F.col("form_a").alias("form_b"))
    )
    loops = membership.select(F.col("form").alias("form_a"), F.col("form").alias("form_b"))
    reach = checkpoint(both.unionAll(loops).distinct())
    # who is hot does not change over the rounds
    hot_reach = checkpoint(hot_keys(reach, ["form_b"], hot_rows))
    hot_forms = checkpoint(hot_keys(membership, ["form"], hot_rows))
    spread = salted(reach, hot_reach, ["form_b"], ["form_a"])
    state = checkpoint(membership.withColumn("status", F.lit("undecided")))

    def seen_by_form(rows: DataFrame) -> DataFrame:
        lowest = rows.groupBy(F.col("form").alias("form_b")).agg(
            F.min(F.when(F.col("status") == "settled", F.col("entity_id"))).alias("settled"),
            F.min(F.when(F.col("status") == "undecided", F.col("entity_id"))).alias("open"),
        )
        return (
            spread.join(copied(lowest, hot_reach, ["form_b"]), ["form_b", "_salt"])
            .groupBy(F.col("form_a").alias("form"))
            .agg(F.min("settled").alias("settled"), F.min("open").alias("open"))
        )

    def seen_by_entity(rows: DataFrame) -> DataFrame:
        around = salted(rows, hot_forms, ["form"], ["entity_id"]).join(
            copied(seen_by_form(rows), hot_forms, ["form"]), ["form", "_salt"]
        )
        return around.groupBy("entity_id").agg(
            F.first("status").alias("status"), F.min("settled").alias("settled"),
            F.min("open").alias("open"),
        )

    while True:
        duplicate = F.col("settled") < F.col("entity_id")
        blocked = F.coalesce(F.col("open") < F.col("entity_id"), F.lit(False))
        verdict = (
            F.when(F.col("status") != "undecided", F.col("status"))
            .when(duplicate, "duplicate")
            .when(~blocked, "settled")
            .otherwise("undecided")
        )
        decided = seen_by_entity(state).select("entity_id", verdict.alias("status"))
        state = checkpoint(membership.join(decided, "entity_id"))
        if state.filter(F.col("status") == "undecided").isEmpty():
            break
    return (
        seen_by_entity(state)
        .filter(F.col("status") == "duplicate")
        .select(F.col("entity_id").alias("duplicate_id"), F.col("settled").alias("canonical_id"))
    )


def resolve_entities(
    nodes: DataFrame, threshold: float = DEFAULTS.resolution_threshold, hot_rows: int = HOT_ROWS, **kw
) -> DataFrame:
    """Merges among named entities: duplicate_id, canonical_id.

    ``nodes``: entity_id, name, embedding. Copies of a form with a usable
    vector score 1; without one the vector part is 0 and they stay apart.
    """
    membership, forms = name_forms(nodes)
    usable = forms.filter((F.size("embedding") > 0) & (F.col("length") > 0)).select("form")
    membership = checkpoint(membership.join(usable, "form", "left_semi"))
    pairs = checkpoint(candidate_pairs(forms, threshold, **kw))
    return greedy_merges(membership, pairs, hot_rows)

