"""Periodic upkeep: entity resolution, communities, reflection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from engram.config import DEFAULTS, Settings
from engram.functions.text import decode_reply, fact_text, trim_space, uuid3
from engram.models.prompts import COMMUNITY_HEAD, REFLECTION_HEAD, REFLECTION_TAIL
from engram.models.provider import Provider
from engram.operators import communities as C
from engram.operators.graph import entity_names, entity_nodes
from engram.operators.reflection import reflection_facts, reflection_relations
from engram.operators.resolution import resolve_entities
from engram.operators.scope import good_insight
from engram.schemas import INSIGHTS
from engram.session import checkpoint
from engram.sources.store import MemoryStore


def _counted(rows: DataFrame, counts: Observation | None, name: str) -> DataFrame:
    """The rows stored, and counted while they are."""
    return checkpoint(rows if counts is None else rows.observe(counts, F.count(F.lit(1)).alias(name)))


def upkeep(store: MemoryStore, provider: Provider, now: Column, settings: Settings = DEFAULTS) -> dict[str, int]:
    """Resolution, communities and reflection in turn; how many merges, communities and insights came of it."""
    made = [Observation() for _ in range(3)]
    resolve(store, now, settings, made[0])
    summarise_communities(store, provider, now, settings, counts=made[1])
    reflect(store, provider, now, settings, counts=made[2])
    return {name: count for seen in made for name, count in seen.get.items()}


def resolve(
    store: MemoryStore, now: Column, settings: Settings = DEFAULTS, counts: Observation | None = None
) -> DataFrame:
    """Merge entities that denote the same thing; returns the merges made."""
    found = resolve_entities(entity_nodes(store.facts()), settings.resolution_threshold)
    merges = _counted(found, counts, "merges")
    if not merges.isEmpty():
        store.merge(merges, now)
    return merges


def summarise_communities(
    store: MemoryStore, provider: Provider, now: Column, settings: Settings = DEFAULTS, sequential: bool = True,
    counts: Observation | None = None,
) -> DataFrame:
    """Find communities and write a summary for each; replaces the earlier ones."""
    facts = checkpoint(store.facts())
    relations = store.relations()
    names = checkpoint(entity_names(facts))
    nodes = names.select(F.col("entity_id").alias("id"))
    find = C.label_propagation if sequential else C.label_propagation_sync
    labels = checkpoint(find(nodes, relations, settings.lpa_sweeps))
    lines = checkpoint(C.community_lines(labels, names, facts, relations, settings.community_facts, now=now))
    sizes = C.community_sizes(labels, settings.community_min_size)
    prompt = F.concat(F.lit(COMMUNITY_HEAD), "context")
    told = (
        C.community_contexts(lines)
        .withColumn("summary", trim_space(provider.answer(prompt)))
        .filter(F.coalesce("summary", F.lit("")) != "")
    )
    rows = _counted(
        told.join(C.community_names(labels, names), "community_id").join(sizes, "community_id").select(
            F.col("community_id").alias("id"),
            F.col("community_name").alias("name"), "summary", F.col("size").alias("members"),
            now.alias("created_at"), provider.embed(F.col("summary")).alias("embedding"),
        ),
        counts, "communities",
    )
    members = labels.join(sizes.select(F.col("community_id").alias("label")), "label", "left_semi").select(
        F.col("label").alias("community_id"), F.col("id").alias("entity_id")
    )
    store.replace_communities(rows, members)
    return rows


def reflect(
    store: MemoryStore, provider: Provider, now: Column, settings: Settings = DEFAULTS, batch: str | None = None,
    counts: Observation | None = None,
) -> DataFrame:
    """Deduce new facts from what each owner knows about each entity; returns them."""
    facts = checkpoint(store.facts())
    names = checkpoint(entity_names(facts))
    groups = checkpoint(
        reflection_facts(facts, settings.active_facts, now).join(names, "entity_id").drop("facts")
    )
    edges = reflection_relations(groups, store.relations(), names)
    prompt = F.concat(
        F.lit(REFLECTION_HEAD), "name", F.lit(REFLECTION_TAIL), F.lit("Active Facts:\n"), "fact_lines",
        F.lit("\nRelationships:\n"), F.coalesce("relation_lines", F.lit("")),
    )
    asked = groups.join(edges, ["entity_id", "owner"], "left").withColumn(
        "_i", decode_reply(provider.answer(prompt), INSIGHTS)
    )
    found = asked.select("entity_id", "owner", F.explode("_i").alias("i")).select(
        "entity_id", "owner", F.col("i.attribute").alias("attribute"), F.col("i.value").alias("val"),
        F.col("i.confidence").alias("confidence_score"),
    )
    good = found.filter(
        good_insight(
            F.col("attribute"), F.col("val"), F.col("confidence_score"), settings.reflection_min_confidence
        )
    )
    key = ["entity_id", "agent_owner", "attribute", "val"]
    fresh = (
        good.groupBy("entity_id", F.col("owner").alias("agent_owner"), "attribute", "val")
        .agg(F.max("confidence_score").alias("confidence_score"))
        # an insight that is stored already is not stored again
        .join(
            facts.filter(F.col("source_agent") == "reflection_engine").select(*key).distinct(),
            key, "left_anti",
        )
    )
    rows = _counted(
        fresh.withColumn("id", uuid3(F.concat_ws("#", *key)))
        .withColumn("valid_from", now)
        .withColumn("source_agent", F.lit("reflection_engine"))
        .withColumn("stability", F.lit(settings.reflection_stability_days))
        .withColumn("embedding", provider.embed(fact_text(F.col("attribute"), F.col("val")))),
        counts, "insights",
    )
    store.insert_facts(rows, now, batch=batch)
    return rows
