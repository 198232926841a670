"""A training corpus from ``documents``: filter, deduplicate, decontaminate, mix, shard.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``docs``. ``run`` writes each stage's rows to the shared folder and rereads them for the next.
Other columns pass through, but for those that the last stage adds. A stage joins its decisions to the documents by ``doc_id``,
so rows without an id pass the filters unchanged.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from engram.llm import decontam, mixing, near_dedup, quality, shards
from engram.session import checkpoint, tune

#: Scores below are rejected.
KEEP_SCORE = 0.3
SIMILARITY = 0.8
SHARDS = 24


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    return docs.join(gone, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject.

    Null and empty texts have no similar neighbour, score 0.5 and stay; repeated rows score alike. Columns
    of any name pass through. An empty table gives none; without usable labels every row stays.
    """
    model = quality.train(docs, tune(spark).read.parquet(f"{sf_dir}/labels.parquet"))
    score, taken = "_quality", {c.lower() for c in docs.columns}
    while score in taken:
        score += "_"
    return quality.scored(docs, model, score=score).where(F.col(score) >= KEEP_SCORE).drop(score)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates.

    Texts that are null, empty or without words link with nothing and stay, as do rows without an id.
    Rows repeating an id stay or go together. Columns of any name pass through; an empty table gives none.
    """
    tune(spark)
    groups = near_dedup.near_duplicates(docs, threshold=SIMILARITY)
    gone = groups.where(~F.col("kept")).select("doc_id").distinct()
    return _without(docs, gone)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item.

    Null and empty texts contain none, and rows without an id stay. Rows repeating an id go together.
    Columns of any name pass through; an empty table, of documents or of items, takes nothing away.
    """
    items = tune(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    gone = decontam.contaminated(docs, items).select("doc_id")
    return _without(docs, gone)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to three times or not at all.

    Null sources are one source; null and empty texts have no words, so that taking them changes no
    total. Rows repeating an id are documents of their own. Columns of any name pass through; an empty
    table gives none.
    """
    tune(spark)
    return mixing.taken_rows(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with size, text_crc32, shard and slot, which replace columns of these names.

    Null ids, sources and texts are values of their own; repeated rows have places of their own. Other
    columns pass through; an empty table gives none.
    """
    tune(spark)
    return shards.interleaved(docs, SHARDS)


STAGES = [
    ("quality", quality_filter),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    tune(spark)
    checkpoint(spark.range(1))  # names a folder where the session has set none
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
