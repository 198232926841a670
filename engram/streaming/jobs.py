"""Streaming jobs that feed the memory.

A micro-batch reads the memory as it was before its own first try and writes
under its own name, so a repeated batch gives the same memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from engram.config import DEFAULTS, Settings
from engram.models.provider import Provider
from engram.plans import chat as chat_plan
from engram.plans import consolidate as consolidate_plan
from engram.plans import maintain
from engram.plans.ingest import ingest
from engram.session import checkpoint
from engram.sources.files import stream_files
from engram.sources.store import MemoryStore


def _start(rows: DataFrame, run, name: str, checkpoint_dir: str, once: bool, interval: str) -> StreamingQuery:
    writer = (
        rows.writeStream.foreachBatch(run).queryName(name)
        .option("checkpointLocation", f"{checkpoint_dir.rstrip('/')}/{name}")
    )
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)
    return writer.start()


def consolidate_interactions(
    store: MemoryStore, interactions: DataFrame, provider: Provider, checkpoint_dir: str,
    settings: Settings = DEFAULTS, once: bool = False, interval: str = "10 seconds",
) -> StreamingQuery:
    """Turn a stream of interactions into facts and relations."""

    def run(batch: DataFrame, batch_id: int) -> None:
        rows = checkpoint(batch)
        if rows.isEmpty():
            return
        now = F.lit(rows.agg(F.max("timestamp")).first()[0])
        name = f"consolidate-{batch_id}"
        memory = store.before(name)
        result = consolidate_plan.consolidate(memory, rows, provider, now, settings)
        consolidate_plan.commit(memory, result, now, name)

    return _start(interactions, run, "consolidate", checkpoint_dir, once, interval)


def ingest_landing(
    store: MemoryStore, path: str, provider: Provider, checkpoint_dir: str,
    settings: Settings = DEFAULTS, once: bool = False, interval: str = "10 seconds",
) -> StreamingQuery:
    """Take in the documents that arrive in a folder."""

    def run(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        try:
            if not rows.isEmpty():
                now = F.lit(rows.agg(F.max("created_at")).first()[0])
                name = f"ingest-{batch_id}"
                ingest(store.before(name), rows, provider, now, settings, name)
        finally:
            rows.unpersist()

    files = stream_files(store.spark, path, settings.files_per_trigger)
    return _start(files, run, "ingest", checkpoint_dir, once, interval)


def answer_requests(
    store: MemoryStore, requests: DataFrame, provider: Provider, checkpoint_dir: str, replies_path: str,
    settings: Settings = DEFAULTS, once: bool = False, interval: str = "1 second",
) -> StreamingQuery:
    """Answer a stream of chat requests; replies and interactions are written as parquet."""

    def run(batch: DataFrame, batch_id: int) -> None:
        rows = checkpoint(batch)
        if rows.isEmpty():
            return
        now = F.lit(rows.agg(F.max("timestamp")).first()[0])
        name = f"chat-{batch_id}"
        memory = store.before(name)
        outcome = chat_plan.chat(memory, rows, provider, now, settings)
        for table, part in (("replies", outcome.replies), ("interactions", outcome.interactions)):
            part.write.mode("overwrite").parquet(f"{replies_path}/{table}/batch={batch_id}")
        chat_plan.commit(memory, outcome, name)

    return _start(requests, run, "chat", checkpoint_dir, once, interval)


def upkeep(
    store: MemoryStore, provider: Provider, checkpoint_dir: str, settings: Settings = DEFAULTS
) -> list[StreamingQuery]:
    """The three periodic jobs, each on the trigger of a one-row-per-second clock."""
    spark = store.spark
    now = F.current_timestamp()
    jobs = (
        ("resolve", settings.resolution_interval, lambda: maintain.resolve(store, now, settings)),
        ("communities", settings.community_interval,
         lambda: maintain.summarise_communities(store, provider, now, settings)),
        ("reflect", settings.reflection_interval, lambda: maintain.reflect(store, provider, now, settings)),
    )
    queries = []
    for name, interval, job in jobs:
        clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        queries.append(
            _start(clock, lambda batch, _, job=job: job(), name, checkpoint_dir, False, interval)
        )
    return queries
