"""Every catalogue query against its SQL, and those without one against a model."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check import compare, oracle

from test_operators import model_resolution


@pytest.fixture(scope="module")
def duck(sf_dir):
    return oracle(sf_dir)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, sf_dir, name):
    assert compare(spark, duck, name, sf_dir).startswith("ok")


def test_entry(spark):
    assert entry.entry(spark).columns == [
        "request_id", "source_name", "rel_type", "target_name", "hop", "statement"]


def test_entity_resolution(spark, sf_dir):
    from engram.catalog.tables import node_id
    from engram.models.offline import embed

    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        node_id("part", "p_partkey"), "p_name", embed(F.concat(F.lit("name: "), "p_name"))
    )
    nodes = sorted((tuple(r) for r in parts.collect()), key=lambda n: n[0])
    rows = entry.queries()["entity_resolution"](spark, sf_dir).collect()
    assert {r.duplicate_id: r.canonical_id for r in rows} == model_resolution(nodes, 0.93)
    assert rows


def test_context_of_many_without_broadcasts(spark, duck, sf_dir, monkeypatch):
    monkeypatch.setattr("engram.operators.graph.FEW_ROWS", 0)
    assert compare(spark, duck, "graph_two_hop_batch", sf_dir).startswith("ok")
