"""Groups of facts and relations an owner reflects on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.config import DEFAULTS
from engram.operators.facts import newest_per_entity, remembered
from engram.operators.scope import active, owner_key
from engram.operators.skew import HOT_ROWS, join_back, joined_lines
from engram.schemas import NIL_UUID


def reflection_facts(facts: DataFrame, n: int = DEFAULTS.active_facts, now: Column | None = None) -> DataFrame:
    """Facts per entity and owner: the owner's own, then the shared ones.

    Of each entity the n newest facts are held in one bounded array; owners are
    unfolded from it, so shared facts reach every owner without a join. Facts
    forgotten by ``now`` drop out after the limit. Entities and groups with
    fewer than two facts are left out.
    """
    near = remembered(newest_per_entity(facts.filter(active()), n), now).withColumn(
        "_owner", owner_key(F.col("agent_owner"))
    )
    packed = near.groupBy("entity_id").agg(
        F.sort_array(
            F.collect_list(F.struct("rn", "_owner", "attribute", "val"))
        ).alias("_facts")
    )
    owners = packed.filter(F.size("_facts") >= 2).withColumn(
        "owner", F.explode(F.array_distinct(F.transform("_facts", lambda f: f["_owner"])))
    )
    own = F.filter("_facts", lambda f: f["_owner"] == F.col("owner"))
    shared = F.filter(
        "_facts", lambda f: (f["_owner"] == NIL_UUID) & (F.col("owner") != NIL_UUID)
    )
    grouped = owners.withColumn("facts", F.concat(own, shared)).filter(F.size("facts") >= 2)
    line = F.transform(
        "facts",
        lambda f: F.concat(F.lit("- Attribute '"), f["attribute"], F.lit("': "), f["val"], F.lit("\n")),
    )
    return grouped.select(
        "entity_id", "owner", F.size("facts").cast("long").alias("n_facts"),
        F.transform(
            "facts", lambda f: F.struct(f["attribute"].alias("attribute"), f["val"].alias("val"))
        ).alias("facts"),
        F.array_join(line, "").alias("fact_lines"),
    )


def reflection_relations(
    groups: DataFrame, relations: DataFrame, names: DataFrame, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Relation lines per entity and owner, in order, as one text.

    ``groups``: entity_id, owner. Names missing from ``names`` show as ids.
    """
    edges = relations.filter(active()).select(
        "id", "source_id", "target_id", "rel_type", owner_key(F.col("agent_owner")).alias("_owner")
    )
    source = names.select(F.col("entity_id").alias("source_id"), F.col("name").alias("_sn"))
    target = names.select(F.col("entity_id").alias("target_id"), F.col("name").alias("_tn"))
    edges = join_back(edges, source, ["source_id"], "left", ["id"], hot_rows)
    edges = join_back(edges, target, ["target_id"], "left", ["id"], hot_rows)
    shown = edges.select(
        "id", "_owner",
        F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("entity_id"),
        F.concat(
            F.lit("- "), F.coalesce("_sn", "source_id"), F.lit(" -> "),
            F.coalesce("_tn", "target_id"), F.lit(" ("), "rel_type", F.lit(")\n"),
        ).alias("line"),
    )
    # a group sees its owner's edges and the shared ones, its own first
    wanted = groups.select(
        "entity_id", "owner",
        F.explode(F.array_distinct(F.array(F.col("owner"), F.lit(NIL_UUID)))).alias("_owner"),
    )
    seen = join_back(
        shown, wanted, ["entity_id", "_owner"], salt_on=["id"], hot_rows=hot_rows
    ).withColumn("shared", F.col("_owner") != F.col("owner"))
    return joined_lines(seen, ["entity_id", "owner"], ["shared", "id"], "line", "relation_lines")
