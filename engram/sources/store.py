"""Memory tables as parquet folders: append-only batches, views on top.

Rows are never changed in place. Deactivation, reinforcement, merges, document
status and cache invalidation are logs that views reduce; only community
snapshots and clearing a session write a table anew, as its next version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram.config import DEFAULTS
from engram.functions.text import blank_to_null
from engram.operators import chat, documents, facts as facts_ops, graph, search
from engram.operators.scope import with_valid_ids
from engram.schemas import TABLES
from engram.sources import buckets
from engram.sources.buckets import FactBuckets
from engram.sources.vector_index import VectorIndex
from engram.session import checkpoint


class MemoryStore:
    """The memory of all owners under one root folder."""

    def __init__(self, spark: SparkSession, root: str, without: str | None = None) -> None:
        self.spark, self.root, self.without = spark, root.rstrip("/"), without

    def before(self, batch: str) -> "MemoryStore":
        """The memory as it was before a batch, whose earlier try may have been written."""
        return MemoryStore(self.spark, self.root, batch)

    # -- tables --------------------------------------------------------------

    def _fs(self, path: str):
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _versions(self, table: str) -> list[int]:
        fs, path = self._fs(f"{self.root}/{table}")
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        found = [int(n[2:]) for n in names if n.startswith("v=")]
        return sorted(
            v for v in found
            if v == 0 or fs.exists(self._fs(f"{self.root}/{table}/v={v}/_COMPLETE")[1])
        )

    def _current(self, table: str) -> str:
        versions = self._versions(table)
        return f"{self.root}/{table}/v={versions[-1] if versions else 0}"

    def _batches(self, table: str) -> dict[str, str]:
        """Names and folders of the batches that count."""
        fs, path = self._fs(self._current(table))
        found = fs.listStatus(path) if fs.exists(path) else []
        return {
            s.getPath().getName().removeprefix("batch="): s.getPath().toString()
            for s in found if self._counts(s.getPath().getName())
        }

    def read(self, table: str, without: frozenset[str] = frozenset()) -> DataFrame:
        """All rows of a table as written, but for the batches named in ``without``."""
        schema = TABLES[table]
        paths = [path for name, path in self._batches(table).items() if name not in without]
        if not paths:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*paths)
        return with_valid_ids(rows) if "id" in rows.columns else rows

    def _counts(self, name: str) -> bool:
        if not name.startswith("batch="):
            return False
        batch = name.removeprefix("batch=")
        return self.without is None or not (
            batch == self.without or batch.startswith(f"{self.without}-")
        )

    def append(self, table: str, rows: DataFrame, batch: str | None = None) -> None:
        """Add rows as one batch. Writing a batch of the same name again replaces it,
        so a repeated micro-batch leaves the table as it was."""
        schema = TABLES[table]
        filled = rows.select(*[
            (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ])
        name = batch or uuid.uuid4().hex
        filled.write.mode("overwrite").parquet(f"{self._current(table)}/batch={name}")

    def replace(self, table: str, rows: DataFrame) -> None:
        """Write a table anew as its next version; readers keep the old one meanwhile."""
        versions = self._versions(table)
        path = f"{self.root}/{table}/v={(versions[-1] if versions else 0) + 1}"
        names = [f.name for f in TABLES[table].fields]
        rows.select(*names).write.mode("overwrite").parquet(f"{path}/batch=base")
        fs, mark = self._fs(f"{path}/_COMPLETE")
        fs.create(mark, True).close()

    # -- facts ---------------------------------------------------------------

    def facts(self, ids: DataFrame | None = None) -> DataFrame:
        """Facts with all effects and merges applied.

        ``ids`` (column entity_id) limits facts and effects to those entities
        before anything else, so that a micro-batch touches its own rows only. Where facts were
        compacted, only their buckets are read, and of the logs what is newer.
        """
        base, merges = self.compacted(), self.merges()
        folded = frozenset() if base is None else base.folded
        rows = self.read("facts", frozenset(b for t, b in folded if t == "facts"))
        effects = self.read("fact_effects", frozenset(b for t, b in folded if t == "fact_effects"))
        if ids is not None:
            wanted = ids.select("entity_id").distinct()
            absorbed = merges.join(wanted.withColumnRenamed("entity_id", "canonical_id"), "canonical_id", "left_semi")
            wanted = wanted.unionByName(absorbed.select(F.col("duplicate_id").alias("entity_id"))).distinct()
            rows = rows.join(wanted, "entity_id", "left_semi")
            if base is not None:
                rows = base.of(wanted).unionByName(rows)
            effects = effects.join(rows.select(F.col("id").alias("fact_id")), "fact_id", "left_semi")
        elif base is not None:
            rows = base.rows().unionByName(rows)
        rows = facts_ops.apply_effects(rows, effects)
        if merges.isEmpty():
            return rows
        return graph.merge_facts(rows, merges)

    def compact_facts(self, buckets: int = buckets.BUCKETS) -> None:
        """Fold facts and their effects so far into a table bucketed by entity.

        The logs stay, so that replays of a batch that was folded still see the memory before it.
        """
        folded = [(table, batch) for table in ("facts", "fact_effects") for batch in self._batches(table)]
        rows = facts_ops.apply_effects(self.read("facts"), self.read("fact_effects"))
        FactBuckets.write(self.spark, f"{self.root}/_buckets/facts", rows, folded, buckets)

    def compacted(self) -> FactBuckets | None:
        """The latest bucketed facts, unless they hold a batch that does not count here."""
        found = FactBuckets.latest(self.spark, f"{self.root}/_buckets/facts")
        if found is None or not all(self._counts(f"batch={batch}") for _, batch in found.folded):
            return None
        return found

    def merges(self) -> DataFrame:
        """Who was merged into whom by now: duplicate_id, canonical_id, at."""
        newest = F.max(F.struct("at", "canonical_id")).alias("m")
        return self.read("merges").groupBy("duplicate_id").agg(newest).select("duplicate_id", "m.canonical_id", "m.at")

    def insert_facts(self, rows: DataFrame, now: Column, owner: Column | None = None, batch: str | None = None) -> None:
        filled = facts_ops.with_insert_defaults(_with_columns(rows, "facts"), now, owner)
        self.append("facts", filled, batch)
        self.append("entities", filled.select(F.col("entity_id").alias("id")).distinct(), batch and f"{batch}-facts")

    def insert_facts_with_provenance(self, rows: DataFrame, now: Column, batch: str | None = None) -> None:
        """Facts that carry document_id and chunk_id."""
        self.insert_facts(rows.drop("document_id", "chunk_id"), now, batch=batch)
        self.link_facts_to_sources(rows, batch)

    def link_facts_to_sources(self, rows: DataFrame, batch: str | None = None) -> None:
        document = rows.select(
            F.lit("EXTRACTED_FROM").alias("kind"), F.col("id").alias("src"), F.col("document_id").alias("dst")
        )
        chunk = rows.filter(F.col("chunk_id").isNotNull()).select(
            F.lit("MENTIONED_IN").alias("kind"), F.col("id").alias("src"), F.col("chunk_id").alias("dst")
        )
        self.append("links", document.unionByName(chunk).distinct(), batch and f"{batch}-sources")

    def apply(self, effects: DataFrame, batch: str | None = None) -> None:
        self.append("fact_effects", effects, batch)

    def deactivate_facts(self, ids: DataFrame, now: Column, batch: str | None = None) -> None:
        rows = ids.select(F.col("id").alias("fact_id"), F.lit("deactivate").alias("kind"), now.alias("at"))
        self.apply(rows, batch)

    def reinforce_facts(self, ids: DataFrame, now: Column, batch: str | None = None) -> None:
        rows = ids.select(F.col("id").alias("fact_id"), F.lit("reinforce").alias("kind"), now.alias("at"))
        self.apply(rows, batch)

    def search_hybrid(self, now: Column, record: bool = False, **asked) -> DataFrame:
        found = facts_ops.search_hybrid(self.facts(), now, **asked)
        if record:
            self.apply(found.effects)
        return found.facts

    # -- entities and relations ----------------------------------------------

    def entities(self) -> DataFrame:
        """One row per entity that was not merged away, with its topic where it has one."""
        gone = self.merges().select(F.col("duplicate_id").alias("id"))
        return self.read("entities").join(gone, "id", "left_anti").groupBy("id").agg(
            F.max("attribute").alias("attribute"), F.max("val").alias("val")
        )

    def entity_nodes(self) -> DataFrame:
        return graph.entity_nodes(self.facts())

    def entity_names(self, ids: DataFrame | None = None) -> DataFrame:
        rows = self.facts()
        return graph.entity_names(rows if ids is None else rows.join(ids, "entity_id", "left_semi"))

    def relations(self) -> DataFrame:
        """Relations between the entities that remain after merges."""
        return graph.remap_ids(self.read("relations"), self.merges().drop("at"), "source_id", "target_id")

    def insert_relations(self, rows: DataFrame, now: Column, owner: Column | None = None, batch: str | None = None) -> None:
        filled = graph.with_relation_defaults(_with_columns(rows, "relations"), now, owner)
        self.append("relations", filled, batch)
        self.append("entities", graph.relation_entities(filled), batch and f"{batch}-relations")

    def active_relations(self, entity_id: str, viewer: str | None = None) -> DataFrame:
        return graph.incident(self.relations(), entity_id, viewer)

    def active_relations_batch(self, ids: DataFrame, viewer: str | None = None) -> DataFrame:
        """Active edges at any of the listed entities (column id), each once."""
        frontier = ids.select(
            F.lit("batch").alias("request_id"), F.col("id").alias("seed_id"),
            F.col("id").alias("entity_id"), F.lit(viewer).cast("string").alias("viewer"),
        )
        found = graph.incident_to(self.relations(), frontier).select("id").distinct()
        return self.relations().join(found, "id", "left_semi")

    def merge(self, merges: DataFrame, now: Column, batch: str | None = None) -> None:
        """Log merges (duplicate_id, canonical_id); reading applies them, no table is rewritten.

        What was merged into an entity that is now a duplicate itself follows it.
        """
        fresh = merges.select("duplicate_id", "canonical_id", now.alias("at"))
        onward = fresh.select(F.col("duplicate_id").alias("_old"), F.col("canonical_id").alias("_new"), F.col("at").alias("_at"))
        moved = self.merges().join(onward, F.col("canonical_id") == F.col("_old")).select(
            "duplicate_id", F.col("_new").alias("canonical_id"), F.col("_at").alias("at"))
        self.append("merges", checkpoint(fresh.unionByName(moved)), batch)

    # -- documents -----------------------------------------------------------

    def insert_documents(self, rows: DataFrame, batch: str | None = None) -> None:
        self.append("documents", rows, batch)

    def update_status(self, rows: DataFrame, batch: str | None = None) -> None:
        self.append("document_status", rows, batch)

    def documents(self) -> DataFrame:
        """Documents with their current status."""
        rank = F.array_position(
            F.array(*[F.lit(s) for s in ("pending", "processing", "completed", "failed")]), F.col("status")
        )
        log = self.read("document_status").withColumn("_rank", rank)
        status = documents.latest_status(log, "_rank").withColumnRenamed("document_id", "id")
        newest = W.partitionBy("id").orderBy(F.col("created_at").desc())
        rows = self.read("documents").withColumn("_rn", F.row_number().over(newest)).filter("_rn = 1")
        return rows.drop("_rn").join(status, "id", "left")

    def document(self, document_id: str) -> DataFrame:
        return self.documents().filter(F.col("id") == document_id)

    def insert_chunks(self, rows: DataFrame, batch: str | None = None) -> None:
        name = batch or uuid.uuid4().hex
        self.append("chunks", rows, name)
        index = self.index("chunks")
        if index is not None:
            written = self.spark.read.schema(TABLES["chunks"]).parquet(f"{self._current('chunks')}/batch={name}")
            index.append(written.select("id", "embedding"), name)

    def search_chunks(self, vector: list[float], k: int) -> DataFrame:
        return search.search_chunks(self.read("chunks"), vector, k)

    # -- vector index --------------------------------------------------------

    def _index_root(self, table: str) -> str:
        # a table written anew has no index until one is built for its new version
        return f"{self.root}/_index/{table}/{self._current(table).rsplit('/', 1)[-1]}"

    def build_index(self, table: str, cells: int | None = None) -> VectorIndex:
        """Index the vectors that a table holds now; chunks inserted later are added to it."""
        return VectorIndex.create(self.spark, self._index_root(table), self.read(table), cells)

    def index(self, table: str) -> VectorIndex | None:
        fs, path = self._fs(f"{self._index_root(table)}/rows")
        return VectorIndex(self.spark, self._index_root(table)) if fs.exists(path) else None

    def nearest(self, table: str, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """``query_id, id, score, rn`` of the k nearest rows: from the index where there is one and ``probes`` is set,
        else by comparing with every row."""
        index = self.index(table) if probes is not None else None
        if index is None:
            return search.top_k_per_query(self.read(table), queries, k)
        return index.top_k_per_query(queries, k, probes)

    def link(self, rows: DataFrame, batch: str | None = None) -> None:
        """Add AUTHORED, DISCUSSES or provenance links (kind, src, dst)."""
        self.append("links", rows.distinct(), batch)

    def links(self) -> DataFrame:
        return self.read("links").distinct()

    def lineage(self) -> DataFrame:
        return graph.lineage(self.facts(), self.links(), self.read("chunks"))

    # -- communities ---------------------------------------------------------

    def replace_communities(self, summaries: DataFrame, members: DataFrame) -> None:
        self.replace("community_members", members)
        self.replace("community_summaries", summaries)

    def search_summaries(self, vector: list[float], k: int) -> DataFrame:
        return search.search_chunks(self.read("community_summaries"), vector, k)

    # -- chat and cache ------------------------------------------------------

    def append_messages(self, rows: DataFrame, batch: str | None = None) -> None:
        self.append("chat_messages", rows, batch)

    def messages(self, now: Column | None = None) -> DataFrame:
        """The retained messages; with ``now``, sessions idle past their time are gone."""
        rows = self.read("chat_messages")
        if now is not None:
            live = rows.groupBy("session_id").agg(F.max("timestamp").alias("_last")).filter(
                F.unix_micros(now) - F.unix_micros("_last") <= DEFAULTS.session_ttl_seconds * 1_000_000
            )
            rows = rows.join(live.select("session_id"), "session_id", "left_semi")
        return chat.retained(rows)

    def history(self, session_id: str, n: int) -> DataFrame:
        rows = self.read("chat_messages").filter(F.col("session_id") == session_id)
        return chat.last_messages(rows, n).orderBy("seq")

    def clear_session(self, session_id: str) -> None:
        self.replace("chat_messages", self.read("chat_messages").filter(F.col("session_id") != session_id))

    def cache(self) -> DataFrame:
        """Entries newer than their owner's last invalidation, the newest per owner."""
        dropped = self.read("cache_invalidations").groupBy("owner").agg(F.max("at").alias("_at"))
        rows = self.read("semantic_cache").join(dropped, "owner", "left")
        live = rows.filter(F.col("_at").isNull() | (F.col("created_at") > F.col("_at"))).drop("_at")
        return search.newest_entries(live)

    def cache_set(self, rows: DataFrame, batch: str | None = None) -> None:
        self.append("semantic_cache", rows, batch)

    def cache_invalidate(self, owners: DataFrame, now: Column, batch: str | None = None) -> None:
        """Drop the entries the listed owners (column owner) have by now."""
        rows = owners.select("owner").distinct().withColumn("at", now)
        self.append("cache_invalidations", rows, batch)

    # -- set-up --------------------------------------------------------------

    def create(self) -> None:
        """Create every table that is missing, empty."""
        for table, schema in TABLES.items():
            if not self._versions(table):
                self.append(table, self.spark.createDataFrame([], schema), "created")


def _with_columns(rows: DataFrame, table: str) -> DataFrame:
    for field in TABLES[table].fields:
        if field.name not in rows.columns:
            rows = rows.withColumn(field.name, F.lit(None).cast(field.dataType))
    if "valid_until" in rows.columns and dict(rows.dtypes)["valid_until"] == "string":
        rows = rows.withColumn("valid_until", blank_to_null(F.col("valid_until")).cast("timestamp"))
    return rows


