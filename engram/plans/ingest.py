"""Document ingestion: parse, chunk, embed, link, extract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.config import DEFAULTS, Settings
from engram.functions.text import blank_to_null, decode_reply, fact_text, is_uuid, uuid3
from engram.models.provider import Provider
from engram.operators.documents import author_links, chunk_documents, parse_documents, topic_links
from engram.operators.facts import contradicted, version_history
from engram.schemas import EXTRACTED_FACTS, EXTRACTED_RELATIONS, SHARED_ENTITY_ID
from engram.session import checkpoint
from engram.sources.files import fetch_links, link_sources
from engram.sources.store import MemoryStore


def _status(rows: DataFrame, status: str, now: Column, message: Column | None = None) -> DataFrame:
    return rows.select(
        "document_id", F.lit(status).alias("status"),
        (F.lit("") if message is None else message).alias("error_message"), now.alias("updated_at"),
    )


def ingest(
    store: MemoryStore,
    sources: DataFrame,
    provider: Provider,
    now: Column,
    settings: Settings = DEFAULTS,
    batch: str | None = None,
) -> None:
    """Take documents in and mark each completed or failed.

    ``sources``: document_id, title, source_type, source_url, file_path,
    entity_id, created_at, content (bytes); an ``error`` says why content is missing.
    """
    sources = checkpoint(sources)  # what was fetched is fetched once
    lost = F.col("error") if "error" in sources.columns else F.lit(None).cast("string")
    missing = sources.filter(F.col("content").isNull()).select("document_id", lost.alias("_missing"))
    jobs = sources.select(
        "document_id", "title", "source_type", "source_url", "file_path", "entity_id", "created_at"
    )
    known = jobs.withColumnRenamed("document_id", "id").withColumn(
        "metadata", F.lit(None).cast("map<string,string>")
    )
    store.update_status(
        _status(jobs, "pending", now).unionByName(_status(jobs, "processing", now)),
        batch and f"{batch}-queued",
    )
    parsed = checkpoint(parse_documents(sources.drop("error").filter(F.col("content").isNotNull())))
    chunks = chunk_documents(
        parsed.filter(F.col("error").isNull()), settings.chunk_size, settings.chunk_overlap
    )
    tried = checkpoint(chunks.withColumn("embedding", provider.embed(F.col("content"))))
    # a chunk without a vector could never be found: its document fails as a whole
    unembedded = checkpoint(tried.filter(F.col("embedding").isNull()).select("document_id").distinct())
    embedded = tried.join(unembedded, "document_id", "left_anti")
    done = embedded.select("document_id").distinct()

    # documents carry their parsed metadata
    store.insert_documents(
        known.drop("metadata").join(
            parsed.select(F.col("document_id").alias("id"), "metadata"), "id", "left"
        ),
        batch,
    )
    store.insert_chunks(embedded, batch)
    completed = parsed.join(done, "document_id", "left_semi")
    authored, authors = author_links(completed)
    discussed, topics = topic_links(completed)
    asked = jobs.filter(is_uuid(F.col("entity_id"))).select(
        F.lit("AUTHORED").alias("kind"), F.col("entity_id").alias("src"), F.col("document_id").alias("dst")
    )
    store.link(authored.unionByName(asked).unionByName(discussed), batch)
    entities = authors.unionByName(asked.select(F.col("src").alias("id")))
    store.append(
        "entities", entities.unionByName(topics, allowMissingColumns=True).distinct(),
        batch and f"{batch}-documents",
    )
    failed = jobs.join(done, "document_id", "left_anti").join(
        parsed.select("document_id", "error"), "document_id", "left"
    ).join(unembedded.withColumn("_lost", F.lit("embedding failed")), "document_id", "left").join(missing, "document_id", "left")
    reason = F.coalesce("error", "_missing", "_lost", F.lit("no text to cut into chunks"))
    store.update_status(
        _status(done, "completed", now).unionByName(_status(failed, "failed", now, reason)), batch
    )
    extract_knowledge(store, embedded, provider, now, batch)


def ingest_links(
    store: MemoryStore,
    links: DataFrame,
    provider: Provider,
    now: Column,
    settings: Settings = DEFAULTS,
    batch: str | None = None,
    token: str | None = None,
    max_bytes: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Validate links, fetch them inside the tasks and take them in.

    ``links``: url, and if wanted title, source_type, entity_id. Returns what was accepted
    (document_id, url, title, source_type) and what was refused (url, reason). A blank title is the
    address; a kind that isn't one of a link's is read off the address. A link that cannot be fetched is
    accepted, and its document fails with the reason.
    """
    asked = links.select(*(
        (F.col(c) if c in links.columns else F.lit("")).cast("string").alias(c) for c in ("url", "title", "source_type", "entity_id")))
    blank = F.coalesce(F.col("url"), F.lit("")) == ""
    refused = asked.filter(blank).select("url", F.lit("URL is required").alias("reason"))
    valid = asked.filter(~blank).select(
        "url", F.coalesce(blank_to_null(F.col("title")), "url").alias("title"),
        F.col("source_type").alias("declared"), F.coalesce("entity_id", F.lit("")).alias("entity_id"),
    ).dropDuplicates(["url"])
    sources = checkpoint(fetch_links(link_sources(valid, now), token, max_bytes))
    ingest(store, sources.drop("fetch_url"), provider, now, settings, batch)
    return sources.select("document_id", F.col("source_url").alias("url"), "title", "source_type"), refused


def extract_knowledge(
    store: MemoryStore,
    chunks: DataFrame,
    provider: Provider,
    now: Column,
    batch: str | None = None,
    normalise_names: bool = True,
) -> None:
    """Shared facts and relations out of chunks, with their provenance."""
    text = F.col("content")
    rows = chunks.withColumn("_f", decode_reply(provider.extract_facts(text), EXTRACTED_FACTS))
    found = rows.select(
        "document_id", F.col("id").alias("chunk_id"), "chunk_index", F.posexplode("_f").alias("pos", "f")
    ).filter(F.col("f.attribute").isNotNull() & F.col("f.value").isNotNull())
    order = F.col("chunk_index") * 1000 + F.col("pos")
    facts = checkpoint(found.select(
        uuid3(F.concat_ws("#", "chunk_id", F.col("pos").cast("string"))).alias("id"),
        F.lit(SHARED_ENTITY_ID).alias("entity_id"), F.col("f.attribute").alias("attribute"),
        F.col("f.value").alias("val"), F.col("f.confidence_score").alias("confidence_score"),
        (now + F.make_dt_interval(secs=order / 1e6)).alias("valid_from"),
        F.concat(F.lit("document:"), "document_id").alias("source_agent"),
        F.lit("").alias("agent_owner"), "document_id", "chunk_id",
    ))
    stale = contradicted(store.facts(facts.select("entity_id")), facts, now=now)
    store.deactivate_facts(stale, now, batch and f"{batch}-stale")
    # within the batch a later value of a singular attribute closes the earlier one
    history = version_history(facts.select("id", "entity_id", "attribute", "val", "valid_from"))
    dated = facts.join(history.select("id", "valid_until"), "id")
    embedded = dated.withColumn(
        "embedding", provider.embed(fact_text(F.col("attribute"), F.col("val")))
    )
    store.insert_facts_with_provenance(embedded, now, batch)

    name = (lambda c: F.lower(F.trim(c))) if normalise_names else (lambda c: c)
    edges = chunks.withColumn(
        "_r", decode_reply(provider.extract_relations(text), EXTRACTED_RELATIONS)
    ).select("id", F.posexplode("_r").alias("pos", "r")).filter(
        F.col("r.source_entity").isNotNull() & F.col("r.target_entity").isNotNull()
    )
    store.insert_relations(
        edges.select(
            uuid3(F.concat_ws("#", "id", F.lit("relation"), F.col("pos").cast("string"))).alias("id"),
            uuid3(name(F.col("r.source_entity"))).alias("source_id"),
            uuid3(name(F.col("r.target_entity"))).alias("target_id"),
            F.col("r.relation_type").alias("rel_type"), now.alias("valid_from"),
        ),
        now, batch=batch,
    )
