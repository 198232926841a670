"""Compacted facts: same memory, selected buckets, no shuffle of the table, replays unharmed."""

import re

from pyspark.sql import functions as F

from engram.functions.text import uuid3
from engram.sources.buckets import FactBuckets
from engram.sources.store import MemoryStore

NOW = "2024-05-01 00:00:00"


def facts(spark, low, high):
    ids = spark.range(low, high)
    return ids.select(
        uuid3(F.concat(F.lit("f"), "id")).alias("id"), uuid3(F.concat(F.lit("e"), (F.col("id") % 40).cast("string"))).alias("entity_id"),
        F.lit("city").alias("attribute"), F.concat(F.lit("v"), "id").alias("val"), F.lit(0.9).alias("confidence_score"),
        F.lit(NOW).cast("timestamp").alias("valid_from"), F.lit(1.0).alias("memory_strength"), F.lit(20.0).alias("stability"),
        F.lit(NOW).cast("timestamp").alias("last_accessed"))


def effects(spark, low, high, kind):
    return facts(spark, low, high).select(F.col("id").alias("fact_id"), F.lit(kind).alias("kind"), F.lit("2024-05-02 00:00:00").cast("timestamp").alias("at"))


def state(rows):
    return sorted((r.id, r.entity_id, r.val, r.stability, str(r.valid_until), str(r.last_accessed)) for r in rows.collect())


def test_compaction_changes_nothing_but_the_plan(spark, tmp_path):
    store = MemoryStore(spark, str(tmp_path))
    store.create()
    store.append("facts", facts(spark, 0, 200), "b1")
    store.append("fact_effects", effects(spark, 0, 50, "reinforce"), "b1")
    store.append("fact_effects", effects(spark, 40, 60, "deactivate"), "b2")
    some = spark.createDataFrame([("e1",), ("e7",), ("nobody",)], "k string").select(uuid3(F.col("k")).alias("entity_id"))
    before, few = state(store.facts()), state(store.facts(some))
    store.compact_facts(16)
    assert {f for f in store.compacted().folded if f[1] != "created"} == {("facts", "b1"), ("fact_effects", "b1"), ("fact_effects", "b2")}
    assert state(store.facts()) == before and state(store.facts(some)) == few and len(few) == 10
    # what comes later is added to what was folded
    store.append("facts", facts(spark, 200, 240), "b3")
    store.append("fact_effects", effects(spark, 0, 10, "reinforce"), "b3")
    both = state(store.facts())
    assert len(both) == 240 and both != before
    store.compact_facts(16)
    assert state(store.facts()) == both
    # a replay of a folded batch sees the memory before it
    assert state(store.before("b3").facts()) == before


def test_selected_buckets_and_joins(spark, tmp_path, monkeypatch):
    store = MemoryStore(spark, str(tmp_path))
    store.create()
    assert store.compacted() is None
    store.append("facts", facts(spark, 0, 200), "b1")
    store.compact_facts(16)
    base = store.compacted()
    # as another session would: the table is declared over the files
    spark.sql(f"DROP TABLE {base._name(base.path)}") if spark.catalog.tableExists(base._name(base.path)) else None
    ids = spark.createDataFrame([("e3",)], "k string").select(uuid3(F.col("k")).alias("entity_id"))
    # the plan names the buckets where the scan stays bucketed; they are pruned in either case
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    found = base.of(ids)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SelectedBucketsCount: 1 out of 16", plan) and found.count() == 5
    monkeypatch.setattr("engram.sources.buckets.LOOKED_UP", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = base.of(ids)
        assert joined.count() == 5
        scan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in scan and scan.count("Exchange hashpartitioning") <= 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


def test_unfinished_versions_do_not_count(spark, tmp_path):
    store = MemoryStore(spark, str(tmp_path))
    store.create()
    store.append("facts", facts(spark, 0, 5), "b1")
    store.compact_facts(4)
    whole = store.compacted().path
    (tmp_path / "_buckets" / "facts" / "v=99999999999999999999-x" / "rows").mkdir(parents=True)
    assert store.compacted().path == whole and store.facts().count() == 5
    assert FactBuckets.latest(spark, str(tmp_path / "none")) is None
