"""Answering chat requests in batches: retrieval, context, prompt, reply, effects."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram.config import DEFAULTS, Settings
from engram.functions.text import chunk_text, is_uuid, scrub, summary_text
from engram.models.provider import Provider
from engram.operators.chat import context_prompts, last_messages
from engram.operators.facts import nearest_facts, search_hybrid_batch
from engram.operators.graph import graph_context
from engram.operators.scope import from_document, may_read, with_valid_ids
from engram.operators.search import cache_lookup
from engram.schemas import DEFAULT_USER_ID, SHARED_ENTITY_ID
from engram.session import checkpoint
from engram.sources.store import MemoryStore


#: Places in the order of a session that one microsecond holds.
SEQ_STEP = 1000


@dataclass(frozen=True)
class ChatOutcome:
    """Result tables of one batch of requests."""

    replies: DataFrame  # request_id, session_id, entity_id, reply, from_cache
    facts: DataFrame  # request_id, attribute, val, ..., from_document; where asked for
    messages: DataFrame  # chat turns to append
    cache_entries: DataFrame  # new cached answers
    interactions: DataFrame  # turns to consolidate
    effects: DataFrame  # reinforcements and deactivations


def with_request_defaults(requests: DataFrame) -> DataFrame:
    """Valid requests: a message is required, ids are filled in.

    ``requests``: request_id, session_id, entity_id, agent_role, message, include_facts.
    """
    return (
        requests.filter(F.coalesce(F.col("message"), F.lit("")) != "")
        .withColumn(
            "entity_id",
            F.when(is_uuid(F.col("entity_id")), F.lower("entity_id")).otherwise(F.lit(DEFAULT_USER_ID)),
        )
        .withColumn(
            "session_id",
            F.when(F.coalesce("session_id", F.lit("")) != "", F.col("session_id"))
            .otherwise(F.concat(F.lit("session-"), "request_id")),
        )
        .withColumn("include_facts", F.coalesce("include_facts", F.lit(False)))
    )


def as_chunk_facts(chunks: DataFrame, *keys: str) -> DataFrame:
    text = chunk_text(F.col("metadata")["title"], F.col("metadata")["source_url"], F.col("content"))
    return _pseudo(chunks, keys, F.col("id"), "document_chunk", text, "document")


def as_summary_facts(summaries: DataFrame, *keys: str) -> DataFrame:
    text = summary_text(F.col("name"), F.col("summary"))
    return _pseudo(summaries, keys, F.col("id"), "macro_narrative", text, "community_graphrag")


def as_relation_facts(statements: DataFrame, *keys: str) -> DataFrame:
    return _pseudo(statements, keys, F.lit(None), "graph_relation", F.col("statement"), None, False)


def _pseudo(
    rows: DataFrame, keys: tuple[str, ...], row_id: Column, attribute: str, text: Column,
    source_agent: str | None, shared: bool = True,
) -> DataFrame:
    """Retrieved context in the shape of facts."""
    return rows.select(
        *keys, row_id.cast("string").alias("id"),
        F.lit(SHARED_ENTITY_ID if shared else None).cast("string").alias("entity_id"),
        F.lit(attribute).alias("attribute"), text.alias("val"),
        F.lit(1.0).alias("confidence_score"), F.lit(source_agent).cast("string").alias("source_agent"),
    )


def retrieve(
    store: MemoryStore, asked: DataFrame, now: Column, settings: Settings = DEFAULTS
) -> tuple[DataFrame, DataFrame]:
    """Context facts of each request, and the effects of reading stored facts.

    ``asked``: request_id, entity_id, agent_role, embedding.
    """
    own = asked.select("request_id", "entity_id", F.col("entity_id").alias("viewer"), "embedding")
    shared = own.withColumn("entity_id", F.lit(SHARED_ENTITY_ID))
    # the facts of the entities asked about; neighbours come from the rows as written
    facts = checkpoint(store.facts(own.select("entity_id").unionByName(shared.select("entity_id"))))
    near = checkpoint(nearest_facts(store.read("facts"), own, settings.ann_pool))
    found = [
        search_hybrid_batch(facts, wanted, now, limit, near)
        for wanted, limit in ((own, settings.own_facts), (shared, settings.shared_facts))
    ]
    fields = ["request_id", "id", "entity_id", "attribute", "val", "confidence_score", "source_agent", "rn"]
    ranked = [
        result.facts.select(*fields).withColumn("part", F.lit(part)) for part, result in enumerate(found)
    ]
    readable = (
        ranked[0].unionByName(ranked[1])
        .join(asked.select("request_id", "agent_role"), "request_id")
        .filter(may_read(F.col("agent_role"), F.col("source_agent")))
        .drop("agent_role")
    )
    queries = asked.filter(F.col("embedding").isNotNull()).select(
        F.col("request_id").alias("query_id"), "embedding"
    )

    def nearest(table: str, k: int) -> DataFrame:
        rows = store.read(table)
        hits = store.nearest(table, queries, k, settings.probes).withColumnRenamed("query_id", "request_id")
        return rows.drop("embedding").join(hits, "id")

    chunks = as_chunk_facts(nearest("chunks", settings.context_chunks), "request_id", "rn")
    summaries = as_summary_facts(
        nearest("community_summaries", settings.context_summaries), "request_id", "rn"
    )
    graph = graph_context(store.relations(), store.facts, own)
    edges = as_relation_facts(
        graph.withColumn("rn", F.col("hop")), "request_id", "rn"
    )
    context = (
        readable.unionByName(chunks.withColumn("part", F.lit(2)))
        .unionByName(summaries.withColumn("part", F.lit(3)))
        .unionByName(edges.withColumn("part", F.lit(4)))
    )
    return context, found[0].effects.unionByName(found[1].effects).distinct()


def chat(
    store: MemoryStore,
    requests: DataFrame,
    provider: Provider,
    now: Column,
    settings: Settings = DEFAULTS,
) -> ChatOutcome:
    """Answer a batch of requests from cache or model. Nothing is written; see ``commit``."""
    valid = with_request_defaults(requests).withColumn("message", scrub(F.col("message")))
    asked = checkpoint(
        valid.withColumn("embedding", provider.embed(F.col("message"))).withColumn(
            "embedding", F.when(F.size("embedding") > 0, F.col("embedding"))
        )
    )
    queries = asked.filter(F.col("embedding").isNotNull()).select(
        F.col("request_id").alias("query_id"), F.col("entity_id").alias("owner"), "embedding"
    )
    hits = checkpoint(
        cache_lookup(store.cache(), queries, settings.cache_threshold, settings.cache_size)
        .select(F.col("query_id").alias("request_id"), F.col("response").alias("reply"))
    )
    missed = asked.join(hits, "request_id", "left_anti")
    context, effects = retrieve(store, missed, now, settings)
    context = checkpoint(context)
    history = last_messages(store.messages(now), settings.chat_history)
    prompts = context_prompts(missed, context, history)
    fields = ["request_id", "session_id", "entity_id", "reply", "from_cache"]
    answered = prompts.withColumn("reply", provider.answer(F.col("prompt"))).withColumn(
        "from_cache", F.lit(False)
    )
    cached = asked.join(hits, "request_id").withColumn("from_cache", F.lit(True))
    replies = checkpoint(cached.select(*fields).unionByName(answered.select(*fields)))

    shown = context.join(missed.filter("include_facts").select("request_id"), "request_id", "left_semi")
    shown = shown.drop("part", "rn").withColumn(
        "from_document", from_document(F.col("source_agent"), F.col("attribute"))
    )
    # turns of one batch follow each other by request id, each reply right after its message
    turns = checkpoint(asked.select("request_id", F.row_number().over(
        W.partitionBy("session_id").orderBy("request_id")).cast("long").alias("_turn")))
    seq = F.unix_micros(now) * SEQ_STEP + 2 * F.col("_turn")
    said = asked.join(turns, "request_id").select(
        "session_id", seq.alias("seq"), F.col("agent_role").alias("role"),
        F.col("message").alias("content"), now.alias("timestamp"),
    )
    told = replies.filter(F.col("reply").isNotNull()).join(turns, "request_id").select(
        "session_id", (seq + 1).alias("seq"), F.lit("assistant").alias("role"),
        F.col("reply").alias("content"), now.alias("timestamp"),
    )
    # a failed answer (null) is neither remembered nor cached
    fresh = replies.filter(~F.col("from_cache") & F.col("reply").isNotNull()).select("request_id", "reply")
    order = F.row_number().over(W.partitionBy("entity_id").orderBy("request_id")).cast("long")
    entries = asked.filter(F.col("embedding").isNotNull()).join(fresh, "request_id").withColumn("_order", order).select(
        F.col("entity_id").alias("owner"), (F.unix_micros(now) * SEQ_STEP + F.col("_order")).alias("seq"), F.col("message").alias("query"),
        F.col("reply").alias("response"), now.alias("created_at"), "embedding",
    )
    interactions = missed.select(
        "session_id", "entity_id", F.col("agent_role").alias("sender"), "message",
        now.alias("timestamp"),
    )
    return ChatOutcome(replies, shown, said.unionByName(told), entries, interactions, effects)


def commit(store: MemoryStore, outcome: ChatOutcome, batch: str | None = None) -> None:
    """Write what a batch of requests leaves behind."""
    store.append_messages(outcome.messages, batch)
    store.cache_set(outcome.cache_entries, batch)
    store.apply(outcome.effects, batch)


def register_relations(store: MemoryStore, edges: DataFrame, now: Column, batch: str | None = None) -> None:
    """Store given relations; the owner is the stated one, else the source.

    ``edges``: id, source_id, target_id, rel_type, agent_owner. Edges whose ends
    are not ids, or whose type is blank, are refused.
    """
    edges = with_valid_ids(edges, "source_id", "target_id").filter(F.trim(F.coalesce("rel_type", F.lit(""))) != "")
    stated = F.when(is_uuid(F.col("agent_owner")), F.col("agent_owner"))
    owned = edges.withColumn("agent_owner", F.coalesce(stated, "source_id")).withColumn("valid_from", now)
    store.insert_relations(owned, now, batch=batch)
    store.cache_invalidate(owned.select(F.col("agent_owner").alias("owner")), now, batch)


def search_documents(
    store: MemoryStore, queries: DataFrame, provider: Provider, limit: int = 5, settings: Settings = DEFAULTS
) -> DataFrame:
    """Chunks nearest to each query text, with their true cosine.

    ``queries``: query_id, query.
    """
    limit = limit if limit > 0 else 5
    asked = queries.filter(F.coalesce(F.col("query"), F.lit("")) != "").select(
        "query_id", provider.embed(F.col("query")).alias("embedding")
    )
    chunks = store.read("chunks")
    hits = store.nearest("chunks", asked, limit, settings.probes)
    return chunks.join(hits, "id").select(
        "query_id", "rn", "document_id", "chunk_index", "content", "score"
    )
