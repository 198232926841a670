"""Row predicates: validity, ownership, access, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions.text import blank_to_null, is_uuid
from engram.schemas import NIL_UUID

# Trust registry of source agents, and its fallback.
AGENTS = (
    ("agent:admin", "admin", 1.0),
    ("agent:logistics", "writer", 0.90),
    ("agent:chemistry", "writer", 0.95),
    ("reflection_engine", "writer", 0.80),
    ("document", "writer", 0.85),
)
UNKNOWN_TRUST = 0.5
GUARDED_ATTRIBUTES = ("system_formula", "proprietary_value")
NAME_RELATIONS = ("HAS_NAME", "NAME")


def active(valid_until: Column | str = "valid_until") -> Column:
    col = F.col(valid_until) if isinstance(valid_until, str) else valid_until
    return col.isNull()


def owner_key(owner: Column) -> Column:
    """Null, blank and the nil UUID all mean shared."""
    return F.coalesce(blank_to_null(owner), F.lit(NIL_UUID))


def owner_visible(owner: Column, viewer: Column | str | None) -> Column:
    """Own and shared rows; without a viewer every row."""
    if viewer is None:
        return F.lit(True)
    viewer = F.lit(viewer) if isinstance(viewer, str) else viewer
    key = owner_key(owner)
    return (key == viewer) | (key == NIL_UUID)


def may_read(role: Column, source_agent: Column) -> Column:
    """Rows written by an admin stay hidden from roles that are not one."""
    role, source = F.lower(role), F.lower(F.coalesce(source_agent, F.lit("")))
    return role.isin("admin", "admin_agent") | ~(source.contains("admin") & ~role.contains("admin"))


def agents(spark) -> DataFrame:
    return spark.createDataFrame(
        list(AGENTS), "agent_id string, agent_role string, trust_score double"
    )


def with_trust(facts: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Add the trust score of the source agent and whether it may write the attribute."""
    registry = agents(facts.sparkSession) if registry is None else registry
    joined = facts.join(registry, facts.source_agent == registry.agent_id, "left")
    guarded = F.col("attribute").isin(list(GUARDED_ATTRIBUTES))
    denied = F.coalesce(F.col("agent_role") == "guest", F.lit(False)) & guarded
    return joined.select(
        facts["*"],
        F.coalesce("trust_score", F.lit(UNKNOWN_TRUST)).alias("trust"),
        (~denied).alias("authorised"),
    )


def is_name_relation(rel_type: Column) -> Column:
    return F.upper(rel_type).isin(list(NAME_RELATIONS))


def good_insight(attribute: Column, value: Column, confidence: Column, least: float = 0.7) -> Column:
    return (attribute != "") & (value != "") & (confidence >= least)


def from_document(source_agent: Column, attribute: Column) -> Column:
    """Side of the answer a fact goes to: documents or entities."""
    return (F.coalesce(source_agent, F.lit("")) == "document") | (attribute == "document_chunk")


def with_valid_ids(rows: DataFrame, *columns: str) -> DataFrame:
    for column in columns or ("id",):
        rows = rows.filter(is_uuid(F.col(column)))
    return rows
