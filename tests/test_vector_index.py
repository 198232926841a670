"""The vector index: exact mode, recall, pruned files, batches, awkward vectors; and the store that uses it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.config import Settings
from engram.operators import search
from engram.sources.store import MemoryStore
from engram.sources.vector_index import OUTSIDE, VectorIndex


def clustered(n, dims=16, seed=3):
    dice = np.random.default_rng(seed)
    centres = dice.normal(0, 1, (20, dims))
    return [(f"v{i:05d}", (centres[i % 20] + dice.normal(0, 0.25, dims)).tolist()) for i in range(n)]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = spark.createDataFrame(clustered(2000), "id string, embedding array<double>").repartition(4)
    return VectorIndex.create(spark, str(tmp_path_factory.mktemp("index")), rows, cells=24)


@pytest.fixture(scope="module")
def queries(index):
    return index.rows().where("id LIKE '%0'").select(F.col("id").alias("query_id"), "embedding").limit(60)


def answers(found):
    return sorted((r.query_id, r.rn, r.id, round(r.score, 9)) for r in found.collect())


def test_exact_mode_and_all_cells_equal_the_full_scan(index, queries):
    want = answers(search.top_k_per_query(index.rows(), queries, 7))
    assert answers(index.top_k_per_query(queries, 7)) == want
    assert answers(index.top_k_per_query(queries, 7, probes=24, block=25)) == want


def test_recall_and_files_read(index, queries):
    probes = index.tuned_probes(queries, 100)
    assert index.recall(queries, 100, probes) >= 0.9 and probes < 24
    query = queries.first()

    def files(rows):
        return rows.select(F.input_file_name()).distinct().count()

    probed = index.rows(index.probed(query.embedding, probes))
    assert files(probed) <= files(index.rows()) / 2
    plan = probed._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
    nearest = index.top_k(query.embedding, 5, probes).collect()
    assert [r.id for r in nearest][0] == query.query_id and nearest[0].score == pytest.approx(1.0)
    assert [r.id for r in index.top_k(query.embedding, 5).collect()] == [r.id for r in nearest]
    assert index.top_k([], 5).count() == 0


def test_batches_replace_themselves(spark, tmp_path):
    rows = spark.createDataFrame(clustered(300), "id string, embedding array<float>")
    index = VectorIndex.create(spark, str(tmp_path), rows)
    assert len(index.centres) == round(300**0.5)
    more = spark.createDataFrame([("new", clustered(1)[0][1])], "id string, embedding array<float>")
    for _ in range(2):
        index.append(more, "b1")
    again = VectorIndex(spark, str(tmp_path))  # another session opens it
    assert again.rows().count() == 301
    assert [r.id for r in again.top_k(clustered(1)[0][1], 2, probes=1).collect()] == ["new", "v00000"]


def test_awkward_vectors(spark, tmp_path):
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", None), ("d", [1.0, 2.0, 3.0]), ("a", [0.0, 1.0]), (None, [1.0, 1.0]), ("e", [])]
    frame = spark.createDataFrame(rows, "id string, embedding array<double>")
    index = VectorIndex.create(spark, f"{tmp_path}/x", frame)
    assert {r.id for r in index.rows([OUTSIDE]).collect()} == {"b", "d", "e"} and index.rows().count() == 6
    asked = spark.createDataFrame([("q", [1.0, 0.1]), ("r", [1.0, 2.0, 3.1]), ("s", [])], "query_id string, embedding array<double>")
    assert answers(index.top_k_per_query(asked, 2, probes=9)) == answers(search.top_k_per_query(index.rows(), asked, 2))
    none = VectorIndex.create(spark, f"{tmp_path}/none", frame.where("id = 'c'"))
    assert none.rows().count() == 0 and none.top_k_per_query(asked, 2, probes=1).count() == 0 and none.tuned_probes(asked, 2) == 1
    none.append(frame, "later")
    assert none.rows().count() == 6 and none.top_k([1.0, 0.0], 1, probes=1).first().id == "a"


def test_store_searches_its_index(spark, tmp_path):
    store = MemoryStore(spark, str(tmp_path))
    store.create()
    chunks = spark.createDataFrame(clustered(400), "id string, embedding array<float>").select(
        F.expr("uuid()").alias("id"), F.lit("d").alias("document_id"), F.lit(0).alias("chunk_index"), F.col("id").alias("content"), "embedding")
    store.insert_chunks(chunks.where("content < 'v00300'"), "one")
    assert store.index("chunks") is None
    built = store.build_index("chunks", cells=10)
    store.insert_chunks(chunks.where("content >= 'v00300'"), "two")
    assert built.rows().count() == 400
    asked = store.read("chunks").where("content IN ('v00007', 'v00390')").select(F.col("content").alias("query_id"), "embedding")
    exact = answers(store.nearest("chunks", asked, 3))
    assert answers(store.nearest("chunks", asked, 3, probes=10)) == exact and len(exact) == 6
    assert Settings.from_env({"VECTOR_INDEX_PROBES": "8"}).probes == 8
