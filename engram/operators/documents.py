"""Documents: status log, parsing, chunks, metadata links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.config import DEFAULTS
from engram.functions.chunking import chunk_column
from engram.functions.parsing import parse_column
from engram.functions.text import split_tags, uuid3


def latest_status(log: DataFrame, *ties: str) -> DataFrame:
    """Current status of each document out of the append-only status log."""
    position = F.struct("updated_at", *ties)
    return log.groupBy("document_id").agg(
        F.max_by(F.struct("status", "error_message", "updated_at"), position).alias("_last")
    ).select("document_id", "_last.*")


def parse_documents(sources: DataFrame) -> DataFrame:
    """Add text, metadata and error. ``sources``: source_type, content (bytes) and more."""
    parsed = sources.withColumn("_p", parse_column(F.col("source_type"), F.col("content")))
    return parsed.select(
        *[c for c in sources.columns if c not in ("content", "metadata")],
        F.col("_p.text").alias("text"), F.col("_p.metadata").alias("metadata"),
        F.col("_p.error").alias("error"),
    )


def chunk_documents(
    parsed: DataFrame, size: int = DEFAULTS.chunk_size, overlap: int = DEFAULTS.chunk_overlap
) -> DataFrame:
    """One row per chunk. ``parsed``: document_id, text, metadata."""
    return parsed.select(
        "document_id", "metadata",
        F.posexplode(chunk_column(F.col("text"), size, overlap)).alias("chunk_index", "content"),
    ).select(
        uuid3(F.concat_ws("#", "document_id", F.col("chunk_index").cast("string"))).alias("id"),
        "document_id", "chunk_index", "content", "metadata",
    )


def author_links(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """AUTHORED links (entity to document) and the author entities."""
    author = F.col("metadata")["author"]
    rows = parsed.filter(author.isNotNull() & (author != "")).select(
        F.lit("AUTHORED").alias("kind"),
        uuid3(F.concat(F.lit("author-"), author)).alias("src"), F.col("document_id").alias("dst"),
    ).distinct()
    return rows, rows.select(F.col("src").alias("id")).distinct()


def topic_links(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """DISCUSSES links (document to topic) and the topic entities."""
    tags = parsed.select("document_id", F.explode(split_tags(F.col("metadata")["tags"])).alias("tag"))
    rows = tags.distinct().withColumn("topic_id", uuid3(F.concat(F.lit("topic-"), "tag")))
    links = rows.select(
        F.lit("DISCUSSES").alias("kind"), F.col("document_id").alias("src"), F.col("topic_id").alias("dst")
    )
    topics = rows.select(
        F.col("topic_id").alias("id"), F.lit("topic").alias("attribute"), F.col("tag").alias("val")
    ).distinct()
    return links, topics
