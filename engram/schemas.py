"""Table schemas and fixed identifiers of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the data model.
NIL_UUID = "00000000-0000-0000-0000-000000000000"
SHARED_ENTITY_SEED = "shared-general-knowledge"
SHARED_ENTITY_ID = "e4131b56-a6b2-306c-8858-ce2f38b29930"
DEFAULT_USER_SEED = "default-user"
DEFAULT_USER_ID = "fc343360-10ba-3a59-99df-b99e1b6b77c1"
SOURCE_TYPES = ("pdf", "markdown", "google_docs", "web_page")
DOCUMENT_STATUSES = ("pending", "processing", "completed", "failed")
PINNED = -1.0

_VECTOR = T.ArrayType(T.FloatType())


def _struct(spec: str) -> T.StructType:
    kinds = {
        "s": T.StringType(), "i": T.IntegerType(), "l": T.LongType(), "d": T.DoubleType(),
        "t": T.TimestampType(), "b": T.BooleanType(), "v": _VECTOR,
        "m": T.MapType(T.StringType(), T.StringType()),
    }
    fields = [part.split(":") for part in spec.split()]
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in fields])


ENTITIES = _struct("id:s attribute:s val:s")
FACTS = _struct(
    "id:s entity_id:s attribute:s val:s confidence_score:d valid_from:t valid_until:t "
    "source_agent:s memory_strength:d stability:d last_accessed:t agent_owner:s embedding:v"
)
RELATIONS = _struct(
    "id:s source_id:s target_id:s rel_type:s valid_from:t valid_until:t "
    "memory_strength:d stability:d last_accessed:t agent_owner:s"
)
DOCUMENTS = _struct(
    "id:s title:s source_type:s source_url:s file_path:s metadata:m created_at:t"
)
DOCUMENT_STATUS = _struct("document_id:s status:s error_message:s updated_at:t")
CHUNKS = _struct("id:s document_id:s chunk_index:i content:s metadata:m embedding:v")
COMMUNITY_SUMMARIES = _struct("id:s name:s summary:s members:l created_at:t embedding:v")
COMMUNITY_MEMBERS = _struct("community_id:s entity_id:s")
CHAT_MESSAGES = _struct("session_id:s seq:l role:s content:s timestamp:t")
SEMANTIC_CACHE = _struct("owner:s seq:l query:s response:s created_at:t embedding:v")
CACHE_INVALIDATIONS = _struct("owner:s at:t")
LINKS = _struct("kind:s src:s dst:s")
# Append-only effects on facts: kind is 'deactivate' or 'reinforce'.
FACT_EFFECTS = _struct("fact_id:s kind:s at:t")
# Append-only log of merges; of several rows for a duplicate the latest holds.
MERGES = _struct("duplicate_id:s canonical_id:s at:t")

TABLES = {
    "entities": ENTITIES,
    "facts": FACTS,
    "fact_effects": FACT_EFFECTS,
    "merges": MERGES,
    "relations": RELATIONS,
    "documents": DOCUMENTS,
    "document_status": DOCUMENT_STATUS,
    "chunks": CHUNKS,
    "community_summaries": COMMUNITY_SUMMARIES,
    "community_members": COMMUNITY_MEMBERS,
    "chat_messages": CHAT_MESSAGES,
    "semantic_cache": SEMANTIC_CACHE,
    "cache_invalidations": CACHE_INVALIDATIONS,
    "links": LINKS,
}

EXTRACTED_FACTS = "array<struct<attribute:string,value:string,confidence_score:double>>"
EXTRACTED_RELATIONS = (
    "array<struct<source_entity:string,target_entity:string,relation_type:string,confidence:double>>"
)
INSIGHTS = "array<struct<attribute:string,value:string,explanation:string,confidence:double>>"
CONFLICT = "struct<has_conflict:boolean,conflicting_fact:string,reason:string>"
