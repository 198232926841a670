"""Quality by nearest-neighbour voting in a latent-semantic space.

A text is a bag of terms: trigrams of character classes, words that repeat their predecessor and
words seen before in the text. Counts are damped, scaled to length one and projected on the
leading singular vectors of a bounded labelled sample. The sample's latent vectors are broadcast;
every document is compared with all of them by blocked cosine products, and its nearest
neighbours vote with their labels, weighted by similarity.

The sample is the only thing that is bounded (``SAMPLE`` labelled rows, half of each label where
there are enough): it fits the classifier. Every document is scored, by its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from engram.llm import kernels
from engram.llm.sampling import least_hashed

SAMPLE, DIMENSIONS, NEIGHBOURS, SHARPNESS = 4096, 32, 15, 8
_KINDS, _TERMS = 16, 16**3 + 2


def _classes() -> np.ndarray:
    """The class of each byte: bytes that continue a character, others beyond ASCII, letters, digits, signs."""
    out = np.full(256, _KINDS - 1, np.int64)
    out[0x80:0xC0], out[0xC0:] = 0, 1
    groups = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".", ",", "!?", "|", "&%$#*", "()[]{}<>", "\"'`", "-_/:;@+=")
    for value, group in enumerate(groups, 2):
        out[[ord(c) for c in group]] = value
    return out


_CLASS = _classes()


def terms(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Damped term counts of documents, rows of length one (zero for an empty text)."""
    begin = int(offsets[0])
    kind = _CLASS[data[begin : int(offsets[-1])]]
    trigram = kind[:-2] * _KINDS**2 + kind[1:-1] * _KINDS + kind[2:] if len(kind) > 2 else kind[:0]
    hashes, at = kernels.words(data, offsets)
    out = np.zeros((len(offsets) - 1, _TERMS), np.float32)
    for i, (a, b) in enumerate(zip(offsets[:-1] - begin, offsets[1:] - begin)):
        if b - a > 2:
            out[i, : _KINDS**3] = np.bincount(trigram[a : b - 2], minlength=_KINDS**3)
        own = hashes[at[i] : at[i + 1]]
        if len(own) > 1:
            out[i, _KINDS**3] = 4 * np.count_nonzero(own[1:] == own[:-1])
            out[i, _KINDS**3 + 1] = len(own) - len(np.unique(own))
    np.log1p(out, out=out)
    return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-9)


@dataclass
class Model:
    """Projection, unit latent vectors of the sample, and their labels; a few megabytes at most."""

    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Votes for label 1, between 0 and 1; 0.5 without any similar neighbour."""
        if not len(self.labels):
            return np.full(len(rows), 0.5)
        cosine = _unit(rows @ self.projection) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0.0).astype(np.float64) ** SHARPNESS
        # votes count as if the sample had as many rows of either label
        share = self.labels.mean()
        if 0 < share < 1:
            weight = weight * np.where(self.labels[near] > 0.5, 0.5 / share, 0.5 / (1 - share))
        total = weight.sum(axis=1)
        votes = (weight * self.labels[near]).sum(axis=1)
        return np.clip(np.where(total > 0, votes / np.where(total > 0, total, 1), 0.5 if 0 < share < 1 else share), 0.0, 1.0)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-9)


def fit(rows: np.ndarray, labels: list[int], seed: int = 0) -> Model:
    """Latent-semantic analysis of the sample's term rows, by randomised subspace iteration."""
    if not len(rows):
        return Model(np.zeros((_TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    width = min(DIMENSIONS, len(rows))
    start = np.random.default_rng(seed).standard_normal((len(rows), width + 8)).astype(np.float32)
    basis = np.linalg.qr(rows.T @ start)[0]
    for _ in range(4):
        basis = np.linalg.qr(rows.T @ (rows @ basis))[0]
    _, _, right = np.linalg.svd(rows @ basis, full_matrices=False)
    projection = np.ascontiguousarray((basis @ right.T)[:, :width], np.float32)
    return Model(projection, _unit(rows @ projection), np.array(labels, np.float64))


def held_out(doc_id: str) -> Column:
    """Whether a document's labels are kept from learning: crc32 of its id as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """A model from at most ``SAMPLE`` labelled documents that are not held out.

    Labels other than 0 and 1 and null ids are ignored; a document labelled both ways counts as
    what most of its rows say (1 on a tie). A label with too few rows leaves its places to the other.
    """
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & ~held_out(doc_id))
        .groupBy(F.col(doc_id).cast("long").alias("id")).agg((F.avg(label) >= 0.5).cast("int").alias("label"))
    )
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}  # two rows
    part = [least_hashed(known.where(F.col("label") == v), SAMPLE, counts.get(v, 0), "id").collect() for v in (0, 1)]  # bounded
    half = SAMPLE // 2
    take = [max(half, SAMPLE - len(part[1])), max(half, SAMPLE - len(part[0]))]
    chosen = {r.id: r.label for p, n in zip(part, take) for r in p[:n]}
    own = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    ids = docs.sparkSession.createDataFrame(sorted(chosen.items()), "id bigint, label int")
    found = own.join(F.broadcast(ids), "id").select("id", "text", "label").mapInArrow(_term_rows, "all int, id bigint, label int, terms binary")
    # the sample is bounded, so one task fits it; only the model, a megabyte, comes to the driver
    fitted = found.groupBy("all").applyInArrow(_fitted, "projection binary, vectors binary, labels binary").collect()
    if not fitted:
        return fit(np.zeros((0, _TERMS), np.float32), [])
    kinds = zip(fitted[0], (np.float32, np.float32, np.float64))
    projection, vectors, own_labels = (np.frombuffer(bytes(packed), kind) for packed, kind in kinds)
    return Model(projection.reshape(_TERMS, -1), vectors.reshape(len(own_labels), -1), own_labels)


def _fitted(sample: pa.Table) -> pa.Table:
    _, first = np.unique(sample.column("id").to_numpy(), return_index=True)  # of repeated ids one
    packed, rows = sample.column("terms"), np.empty((len(first), _TERMS), np.float32)
    for i, at in enumerate(first.tolist()):
        rows[i] = np.frombuffer(packed[at].as_buffer(), np.float16)
    model = fit(rows, sample.column("label").to_numpy()[first].tolist())
    parts = (model.projection.astype(np.float32), model.vectors.astype(np.float32), model.labels)
    return pa.table({n: pa.array([v.tobytes()], pa.binary()) for n, v in zip(("projection", "vectors", "labels"), parts)})


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = kernels.texts(batch.column(1))
        for a, b in kernels.pieces(offsets):
            rows = terms(data, offsets[a : b + 1])
            packed = [r.astype(np.float16).tobytes() for r in rows]
            columns = [pa.array(np.zeros(b - a, np.int32)), batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["all", "id", "label", "terms"])


def _append(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = kernels.texts(batch.column(0))
            scores = np.concatenate([
                model.scores(terms(data, offsets[i : j + 1]))
                for a, b in kernels.pieces(offsets) for i, j in ((k, min(k + 512, b)) for k in range(a, b, 512))])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores)], names=[*batch.schema.names[1:], "_score"])

    return run


def scored(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with its columns and ``score`` (0 to 1, higher for label 1), replacing one of that name.

    Null and empty texts have no similar neighbour and score 0.5, as does every text without a
    sample; a sample of one label gives that label.
    Repeated rows score alike; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = [c for c in docs.columns if c.lower() != score.lower()]
    safe = [f"c{i}" for i in range(len(columns))]
    body = docs.select(F.col(text).alias("_text"), *(F.col(f"`{c}`").alias(s) for c, s in zip(columns, safe)))
    schema = StructType([*body.schema.fields[1:], StructField("_score", DoubleType())])
    out = body.mapInArrow(_append(shared), schema)
    return out.select(*(F.col(s).alias(c) for c, s in zip(columns, safe)), F.col("_score").alias(score))
