"""Turning interactions into facts and relations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.config import DEFAULTS, Settings
from engram.functions.text import SELF_ALIASES, decode_reply, fact_text, is_self_alias, trim_space, uuid3
from engram.models.provider import Provider
from engram.operators.chat import last_messages, transcript
from engram.operators.facts import (
    match_conflicts, newest_per_entity, oldest_active, own_and_shared, remembered, version_history,
)
from engram.operators.graph import new_relations
from engram.operators.scope import active
from engram.operators.skew import join_back
from engram.schemas import CONFLICT, EXTRACTED_FACTS, EXTRACTED_RELATIONS
from engram.session import checkpoint
from engram.sources.store import MemoryStore


@dataclass(frozen=True)
class Consolidation:
    facts: DataFrame
    relations: DataFrame
    effects: DataFrame
    owners: DataFrame


def extraction_texts(interactions: DataFrame, messages: DataFrame, n: int = DEFAULTS.worker_history) -> DataFrame:
    """Text each interaction is read from: earlier turns, then the message.

    ``interactions``: session_id, entity_id, sender, message, timestamp. History
    ends before each interaction's own message (the latest such one that is not
    newer), so what an interaction is read with does not depend on its batch.
    """
    keyed = checkpoint(interactions.withColumn(
        "_key", F.xxhash64("session_id", "sender", "message", F.unix_micros("timestamp"))))
    asked = keyed.select("session_id", "_key", "sender", "message", F.col("timestamp").alias("_at")).distinct()
    # the retained messages of a session are few, so each interaction takes its own copy
    turns = messages.join(asked, "session_id")
    own = (F.col("role") == F.col("sender")) & (F.col("content") == F.col("message"))
    own = own & F.coalesce(F.col("timestamp") <= F.col("_at"), F.lit(True))
    ends = turns.filter(own).groupBy("_key").agg(F.max("seq").alias("_cut"))
    turns = turns.join(ends, "_key", "left").filter(F.col("_cut").isNull() | (F.col("seq") <= F.col("_cut")))
    turns = turns.drop("session_id").withColumnRenamed("_key", "session_id")
    near = last_messages(turns, n).filter(F.col("_cut").isNull() | (F.col("seq") < F.col("_cut")))
    talk = transcript(near.withColumnRenamed("session_id", "_key"), "_key")
    said = F.concat("sender", F.lit(": "), "message")
    context = F.concat(
        F.lit("Earlier turns:\n"), "history", F.lit("\nMessage at hand:\n"), said
    )
    return keyed.join(talk, "_key", "left").withColumn(
        "text", F.coalesce(context, said)
    ).drop("history", "_key")


def _candidates(texts: DataFrame, replies: Column) -> DataFrame:
    found = texts.withColumn("_facts", decode_reply(replies, EXTRACTED_FACTS))
    rows = found.select(
        "entity_id", "sender", "timestamp", F.posexplode("_facts").alias("pos", "f")
    ).select(
        "entity_id", F.col("f.attribute").alias("attribute"), F.col("f.value").alias("val"),
        F.col("f.confidence_score").alias("confidence_score"), F.col("sender").alias("source_agent"),
        (F.col("timestamp") + F.make_dt_interval(secs=F.col("pos") / 1e6)).alias("valid_from"),
    )
    rows = rows.filter(F.col("attribute").isNotNull() & F.col("val").isNotNull())
    key = F.concat_ws("#", "entity_id", "attribute", "val", F.unix_micros("valid_from").cast("string"))
    return rows.withColumn("id", uuid3(key)).withColumn("agent_owner", F.col("entity_id"))


def consolidate_facts(
    facts: DataFrame, candidates: DataFrame, provider: Provider, now: Column, settings: Settings = DEFAULTS
) -> tuple[DataFrame, DataFrame]:
    """Facts to insert, and effects on stored ones.

    A candidate equal to what is stored (or to the candidate before it) is
    skipped; a new value of a singular attribute closes the old one; a logical
    conflict closes the fact it names.
    """
    touched = candidates.select("entity_id", "attribute").distinct()
    # what is compared: facts of the touched entities that they may see and still remember
    facts = own_and_shared(facts.join(touched.select("entity_id").distinct(), "entity_id", "left_semi"))
    stored = (
        oldest_active(facts, now)
        .join(touched, ["entity_id", "attribute"], "left_semi")
        .select(
            F.col("old_id").alias("id"), "entity_id", "attribute", F.col("old_val").alias("val"),
            # stored values come before every candidate
            F.lit("0001-01-01 00:00:00").cast("timestamp").alias("valid_from"),
        )
    )
    line = ["id", "entity_id", "attribute", "val", "valid_from"]
    history = checkpoint(version_history(stored.unionByName(candidates.select(*line))))
    dated = history.select("id", "valid_until")
    fresh = candidates.join(dated, "id").dropDuplicates(["id"])
    closed = dated.filter(F.col("valid_until").isNotNull()).join(stored.select("id"), "id", "left_semi")

    listed = (
        remembered(newest_per_entity(facts.filter(active()), settings.active_facts), now)
        .groupBy("entity_id")
        .agg(F.sort_array(F.collect_list(fact_text(F.col("attribute"), F.col("val")))).alias("_existing"))
    )
    asked = join_back(
        fresh.select(F.col("id").alias("verdict_id"), "entity_id", "attribute", "val"),
        listed, ["entity_id"], salt_on=["verdict_id"],
    )
    reply = provider.validate_conflict(fact_text(F.col("attribute"), F.col("val")), F.col("_existing"))
    verdicts = checkpoint(
        asked.withColumn("_c", decode_reply(reply, CONFLICT))
        .filter(F.col("_c.has_conflict"))
        .select("verdict_id", "entity_id", "_c.conflicting_fact", "_c.reason")
    )
    named = match_conflicts(verdicts, facts, settings.active_facts, now=now).filter(
        F.col("matched_id").isNotNull()
    )
    ids = closed.select(F.col("id").alias("fact_id")).unionByName(
        named.select(F.col("matched_id").alias("fact_id"))
    ).distinct()
    effects = ids.withColumn("kind", F.lit("deactivate")).withColumn("at", now)
    embedded = fresh.withColumn("embedding", provider.embed(fact_text(F.col("attribute"), F.col("val"))))
    return embedded, effects


def resolve_relations(
    texts: DataFrame, replies: Column, aliases: tuple[str, ...] = SELF_ALIASES
) -> DataFrame:
    """Extracted relations with the ids of their ends; the speaker's names mean the entity."""
    found = texts.withColumn("_rels", decode_reply(replies, EXTRACTED_RELATIONS)).select(
        "entity_id", "sender", "timestamp", F.explode("_rels").alias("r")
    ).select("entity_id", "sender", "timestamp", "r.*")
    found = found.filter(F.lower(trim_space(F.col("target_entity"))) != "")
    source = F.coalesce("source_entity", F.lit(""))
    target = F.col("target_entity")
    self_source = is_self_alias(source, F.col("sender"), aliases, blank=True)
    self_target = is_self_alias(target, F.col("sender"), aliases)

    def end(is_self: Column, name: Column) -> Column:
        return F.when(is_self, F.col("entity_id")).otherwise(uuid3(F.lower(trim_space(name))))

    return found.select(
        end(self_source, source).alias("source_id"), end(self_target, target).alias("target_id"),
        F.upper(trim_space(F.col("relation_type"))).alias("rel_type"),
        F.when(~self_source, source).alias("source_name"), F.when(~self_target, target).alias("target_name"),
        F.col("entity_id").alias("agent_owner"), "sender", F.col("timestamp").alias("valid_from"),
    )


def name_facts(ends: DataFrame, provider: Provider) -> DataFrame:
    """Name facts for the ends that were named."""
    named = ends.select(
        F.explode(F.array(
            F.struct(F.col("source_id").alias("entity_id"), F.col("source_name").alias("val")),
            F.struct(F.col("target_id").alias("entity_id"), F.col("target_name").alias("val")),
        )).alias("n"), "agent_owner", F.col("sender").alias("source_agent"), "valid_from",
    ).select("n.*", "agent_owner", "source_agent", "valid_from").filter(F.col("val").isNotNull())
    once = named.groupBy("entity_id", "val", "agent_owner", "source_agent").agg(
        F.max("valid_from").alias("valid_from")
    )
    key = F.concat_ws("#", "entity_id", F.lit("name"), "val", "agent_owner", F.unix_micros("valid_from").cast("string"))
    return once.select(
        uuid3(key).alias("id"), "entity_id", F.lit("name").alias("attribute"), "val",
        F.lit(1.0).alias("confidence_score"), "source_agent", "agent_owner", "valid_from",
        provider.embed(fact_text(F.lit("name"), F.col("val"))).alias("embedding"),
    )


def consolidate(
    store: MemoryStore, interactions: DataFrame, provider: Provider, now: Column, settings: Settings = DEFAULTS
) -> Consolidation:
    """What a batch of interactions adds to the memory; see ``commit``."""
    texts = checkpoint(extraction_texts(interactions, store.messages(), settings.worker_history))
    facts = checkpoint(store.facts(texts.select("entity_id")))
    candidates = checkpoint(_candidates(texts, provider.extract_facts(F.col("text"))))
    fresh, effects = consolidate_facts(facts, candidates, provider, now, settings)
    ends = checkpoint(resolve_relations(texts, provider.extract_relations(F.col("text"))))
    edges = new_relations(ends, store.relations())
    key = F.concat_ws("#", "source_id", "target_id", "rel_type", F.unix_micros("valid_from").cast("string"))
    edges = edges.select(
        uuid3(key).alias("id"), "source_id", "target_id", "rel_type", "valid_from", "agent_owner"
    )
    return Consolidation(
        fresh.unionByName(name_facts(ends, provider), allowMissingColumns=True), edges, effects,
        interactions.select(F.col("entity_id").alias("owner")).distinct(),
    )


def commit(store: MemoryStore, result: Consolidation, now: Column, batch: str | None = None) -> None:
    store.insert_facts(result.facts, now, batch=batch)
    store.insert_relations(result.relations, now, batch=batch)
    store.apply(result.effects, batch)
    store.cache_invalidate(result.owners, now, batch)
