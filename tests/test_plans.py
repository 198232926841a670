"""The plans end to end on a small memory, with the offline provider."""

import uuid

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from engram.models.provider import HttpProvider, OfflineProvider, provider_for
from engram.config import Settings
from engram.plans import chat as chat_plan
from engram.plans import consolidate as consolidate_plan
from engram.plans import maintain
from engram.plans.ingest import ingest
from engram.schemas import DEFAULT_USER_ID, SHARED_ENTITY_ID
from engram.sources.files import read_files
from engram.sources.store import MemoryStore

ALICE = str(uuid.uuid5(uuid.NAMESPACE_URL, "alice"))
REQUEST = "request_id string, session_id string, entity_id string, agent_role string, message string, include_facts boolean"


def at(text):
    return F.lit(text).cast("timestamp")


NOW = "2024-05-01 12:00:00"


@pytest.fixture()
def store(spark, tmp_path):
    made = MemoryStore(spark, str(tmp_path / "memory"))
    made.create()
    return made


def fact(spark, rows):
    return spark.createDataFrame(
        rows, "id string, entity_id string, attribute string, val string, source_agent string, agent_owner string"
    ).withColumn("valid_from", at("2024-04-30 00:00:00")).withColumn("confidence_score", F.lit(0.9))


def new_id(name):
    return str(uuid.uuid5(uuid.NAMESPACE_URL, name))


def test_store_insert_effects_and_views(spark, store):
    provider = OfflineProvider()
    rows = fact(spark, [
        (new_id("f1"), ALICE, "name", "Alice", "user", ALICE),
        (new_id("f2"), ALICE, "city", "Oslo", "user", ALICE),
        ("not-a-uuid", ALICE, "x", "y", "user", ALICE),
    ]).withColumn("embedding", provider.embed(F.concat("attribute", F.lit(": "), "val")))
    store.insert_facts(rows, at(NOW), batch="b1")
    store.insert_facts(rows, at(NOW), batch="b1")  # the same batch again
    assert store.facts().count() == 2
    assert {r.id for r in store.entities().collect()} == {ALICE}
    store.deactivate_facts(rows.filter("attribute = 'city'"), at("2024-05-02 00:00:00"))
    store.deactivate_facts(rows.filter("attribute = 'city'"), at("2024-05-03 00:00:00"))
    store.reinforce_facts(rows.filter("attribute = 'name'"), at("2024-05-04 00:00:00"))
    got = {r.attribute: r for r in store.facts().collect()}
    assert str(got["city"].valid_until) == "2024-05-02 00:00:00"
    assert got["name"].stability == 45.0 and str(got["name"].last_accessed) == "2024-05-04 00:00:00"
    found = store.search_hybrid(at(NOW), record=True, entity_id=ALICE, viewer=ALICE)
    assert [r.attribute for r in found.collect()] == ["name"]
    assert [r.name for r in store.entity_names().collect()] == ["Alice"]


def test_chat_miss_then_hit(spark, store):
    provider = OfflineProvider()
    store.insert_facts(
        fact(spark, [
            (new_id("f1"), ALICE, "name", "Alice", "user", ALICE),
            (new_id("f2"), ALICE, "secret", "42", "agent:admin", ALICE),
            (new_id("f3"), SHARED_ENTITY_ID, "tea", "hot", "document:x", ""),
        ]).withColumn("embedding", provider.embed(F.concat("attribute", F.lit(": "), "val"))), at(NOW),
    )
    store.insert_relations(spark.createDataFrame(
        [(new_id("r1"), ALICE, new_id("bob"), "KNOWS")], "id string, source_id string, target_id string, rel_type string"
    ), at(NOW))
    requests = spark.createDataFrame([("q1", "s1", ALICE, "user", "who am I? mail a@b.io", True)], REQUEST)
    miss = chat_plan.chat(store, requests, provider, at(NOW))
    reply = miss.replies.collect()
    assert [(r.reply, r.from_cache) for r in reply] == [("Noted: who am I? mail [EMAIL_REDACTED]", False)]
    shown = {(r.attribute, r.val, r.from_document) for r in miss.facts.collect()}
    assert ("name", "Alice", False) in shown and ("tea", "hot", False) in shown
    assert not any(a == "secret" for a, _, _ in shown)
    bob = new_id("bob")[:8]
    assert ("graph_relation", f"Graph Relation: user is linked to {bob} via KNOWS", False) in shown
    chat_plan.commit(store, miss)
    assert [(m.role) for m in store.history("s1", 10).collect()] == ["user", "assistant"]
    # reading reinforced the facts that were found
    stability = {r.attribute: r.stability for r in store.facts().collect()}
    assert stability["name"] == 45.0

    hit = chat_plan.chat(store, requests, provider, at("2024-05-01 12:01:00"))
    assert [(r.reply, r.from_cache) for r in hit.replies.collect()] == [(reply[0].reply, True)]
    assert hit.interactions.isEmpty() and hit.cache_entries.isEmpty()

    owners = spark.createDataFrame([(ALICE,)], "owner string")
    store.cache_invalidate(owners, at("2024-05-01 12:02:00"))
    assert store.cache().isEmpty() and store.read("semantic_cache").count() == 1


def test_chat_defaults(spark):
    requests = spark.createDataFrame(
        [("q1", "", "nobody", "user", "hello", None), ("q2", "s", ALICE.upper(), "user", "", True)], REQUEST
    )
    rows = chat_plan.with_request_defaults(requests).collect()
    assert [(r.entity_id, r.session_id, r.include_facts) for r in rows] == [(DEFAULT_USER_ID, "session-q1", False)]


def interactions(spark, rows):
    return spark.createDataFrame(
        rows, "session_id string, entity_id string, sender string, message string, ts string"
    ).select("session_id", "entity_id", "sender", "message", F.col("ts").cast("timestamp").alias("timestamp"))


def test_consolidate_supersedes_skips_and_links(spark, store):
    provider = OfflineProvider()
    first = interactions(spark, [
        ("s1", ALICE, "user", "Hello. My city is Oslo. My hobbies are chess. I know Bob", "2024-05-01 00:00:00"),
    ])
    consolidate_plan.commit(store, consolidate_plan.consolidate(store, first, provider, at(NOW)), at(NOW), "b1")
    second = interactions(spark, [
        ("s1", ALICE, "user", "My city is Oslo. My hobbies are golf. I know Bob", "2024-05-02 00:00:00"),
        ("s1", ALICE, "user", "My city is Bergen.", "2024-05-02 00:00:10"),
        ("s1", ALICE, "user", "My city is Rome.", "2024-05-02 00:00:20"),
        ("s1", ALICE, "user", "My hobbies are not chess.", "2024-05-02 00:00:30"),
    ])
    later = at("2024-05-02 01:00:00")
    consolidate_plan.commit(store, consolidate_plan.consolidate(store, second, provider, later), later, "b2")
    facts = [(r.attribute, r.val, r.valid_until is None) for r in store.facts().collect() if r.entity_id == ALICE]
    assert sorted(facts) == [
        ("city", "Bergen", False), ("city", "Oslo", False), ("city", "Rome", True),
        ("hobbies", "chess", False), ("hobbies", "golf", True), ("hobbies", "not chess", True),
    ]
    bob = str(uuid.uuid3(uuid.NAMESPACE_DNS, "bob"))
    edges = [(r.source_id, r.target_id, r.rel_type, r.agent_owner) for r in store.relations().collect()]
    assert edges == [(ALICE, bob, "KNOW", ALICE)]
    assert {(r.entity_id, r.name) for r in store.entity_names().collect()} == {(bob, "Bob")}


def test_ingest_files(spark, store, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.md").write_text(
        "---\ntitle: River Notes\nauthor: Mia Berg\ntags: otter, stone, water\n---\n# Main\nMy colour is blue. Anna knows Bob"
    )
    (folder / "b.markdown").write_text("---\ntitle: x\n---\n")
    (folder / "c.pdf").write_bytes(b"not a pdf")
    (folder / "d.txt").write_text("ignored")
    ingest(store, read_files(spark, str(folder)), OfflineProvider(), at(NOW), batch="d1")
    docs = {r.title: r for r in store.documents().collect()}
    assert {t: r.status for t, r in docs.items()} == {"a.md": "completed", "b.markdown": "failed", "c.pdf": "failed"}
    assert docs["a.md"].metadata["author"] == "Mia Berg"
    assert docs["b.markdown"].error_message == "no text to cut into chunks"
    assert docs["c.pdf"].error_message
    chunks = store.read("chunks").collect()
    assert len(chunks) == 1 and chunks[0].metadata["title"] == "River Notes"
    kinds = sorted(r.kind for r in store.links().collect())
    assert kinds == ["AUTHORED", "DISCUSSES", "DISCUSSES", "DISCUSSES", "EXTRACTED_FROM", "MENTIONED_IN"]
    line = store.lineage().collect()[0]
    assert (line.entity_id, line.attribute, line.document_id, line.chunk_index) == (
        SHARED_ENTITY_ID, "colour", docs["a.md"].id, 0)
    assert store.relations().count() == 1
    assert {r.val for r in store.entities().filter("attribute = 'topic'").collect()} == {"otter", "stone", "water"}
    queries = spark.createDataFrame([("q", "blue colour")], "query_id string, query string")
    hit = chat_plan.search_documents(store, queries, OfflineProvider()).collect()
    assert len(hit) == 1 and 0 < hit[0].score < 1


class Reflective(OfflineProvider):
    def answer(self, prompt):
        reply = '```json\n[{"attribute": "mood", "value": "good", "explanation": "", "confidence": 0.8},' \
                ' {"attribute": "weak", "value": "x", "explanation": "", "confidence": 0.6}]\n```'
        return F.when(prompt.contains("Deduce"), reply).otherwise(super().answer(prompt))


def test_resolve_summarise_reflect(spark, store):
    provider = Reflective()
    people = [("p1", "Anna Smith"), ("p2", "anna smith "), ("p3", "Bob"), ("p4", "Carl")]
    store.insert_facts(
        fact(spark, [(new_id("n" + p), new_id(p), "name", n, "user", "") for p, n in people]
             + [(new_id("c1"), new_id("p3"), "city", "Oslo", "user", "")])
        .withColumn("embedding", provider.embed(F.lower(F.trim("val")))), at(NOW),
    )
    store.insert_relations(spark.createDataFrame(
        [(new_id("r1"), new_id("p1"), new_id("p3"), "KNOWS"), (new_id("r2"), new_id("p2"), new_id("p4"), "KNOWS")],
        "id string, source_id string, target_id string, rel_type string",
    ), at(NOW))
    counts = Observation()
    merges = maintain.resolve(store, at(NOW), counts=counts).collect()
    assert counts.get == {"merges": len(merges)}
    low, high = sorted([new_id("p1"), new_id("p2")])
    assert [(m.duplicate_id, m.canonical_id) for m in merges] == [(high, low)]
    assert high not in {r.entity_id for r in store.facts().collect()}
    assert {r.source_id for r in store.relations().collect()} == {low}
    assert store.facts().filter("attribute = 'name' and valid_until is null").count() == 3

    rows = maintain.summarise_communities(store, provider, at(NOW)).collect()
    assert len(rows) == 1 and rows[0].name.startswith("Community of ")
    assert store.read("community_members").count() == rows[0].members
    maintain.summarise_communities(store, provider, at(NOW))
    assert store.read("community_summaries").count() == 1

    made = maintain.reflect(store, provider, at(NOW)).collect()
    assert {(r.attribute, r.val) for r in made} == {("mood", "good")}
    assert maintain.reflect(store, provider, at(NOW)).count() == 0
    # nothing is left to merge or to deduce
    assert maintain.upkeep(store, provider, at(NOW)) == {"merges": 0, "communities": 1, "insights": 0}


def test_register_relations_owner_and_stability(spark, store):
    owner = new_id("owner")
    edges = spark.createDataFrame(
        [(new_id("r1"), ALICE, new_id("b"), "LIKES", None), (new_id("r2"), ALICE, new_id("c"), "LIKES", owner)],
        "id string, source_id string, target_id string, rel_type string, agent_owner string",
    ).withColumn("stability", F.lit(-1.0))
    chat_plan.register_relations(store, edges, at(NOW))
    got = {r.id: (r.agent_owner, r.stability) for r in store.relations().collect()}
    assert got == {new_id("r1"): (ALICE, 30.0), new_id("r2"): (owner, 30.0)}
    ids = spark.createDataFrame([(ALICE,)], "id string")
    assert store.active_relations_batch(ids).count() == 2
    assert store.active_relations(ALICE, viewer=owner).count() == 1


def test_provider_factory():
    made = provider_for(Settings(provider="unknown"), {"LLM_API_KEY": "k"})
    assert isinstance(made, HttpProvider) and made.kind == "gemini"
    assert provider_for(Settings(provider="openai"), {"OPENAI_API_KEY": "k", "OPENAI_GENERATION_MODEL": "m"}).generation == "m"
    assert isinstance(provider_for(Settings(provider="offline")), OfflineProvider)
    with pytest.raises(ValueError):
        provider_for(Settings(), {})
    assert Settings.from_env({"SEMANTIC_CACHE_THRESHOLD": "0.9", "EMBEDDING_BATCH_SIZE": "x"}).cache_threshold == 0.9


def test_merges_are_a_log(spark, store):
    a, b, c, d = (str(uuid.uuid5(uuid.NAMESPACE_URL, x)) for x in "abcd")
    ids = [str(uuid.uuid5(uuid.NAMESPACE_URL, f"fact{i}")) for i in range(6)]
    store.insert_facts(fact(spark, [(ids[0], a, "name", "A", "x", ""), (ids[1], b, "name", "B", "x", ""), (ids[2], c, "city", "Rome", "x", "")]), at(NOW), batch="one")
    pairs = "duplicate_id string, canonical_id string"
    store.merge(spark.createDataFrame([(b, c)], pairs), at("2024-05-01 13:00:00"))
    # written after the merge, and again by a replay of the same batch
    for _ in range(2):
        memory = store.before("two")
        memory.insert_facts(fact(spark, [(ids[3], b, "job", "cook", "x", ""), (ids[4], d, "pet", "cat", "x", "")]), at(NOW), batch="two")
        memory.deactivate_facts(spark.createDataFrame([(ids[2],)], "id string"), at(NOW), batch="two")
    store.merge(spark.createDataFrame([(c, a)], pairs), at("2024-05-01 14:00:00"))
    rows = {r.id: r for r in store.facts().collect()}
    assert {i: r.entity_id for i, r in rows.items()} == {ids[0]: a, ids[1]: a, ids[2]: a, ids[3]: a, ids[4]: d}
    names = [r for r in rows.values() if r.attribute == "name"]
    assert sum(r.valid_until is None for r in names) == 1 and rows[ids[2]].valid_until is not None
    part = {r.id: tuple(r) for r in store.facts(spark.createDataFrame([(a,)], "entity_id string")).collect()}
    assert part == {i: tuple(r) for i, r in rows.items() if i != ids[4]}
    assert {r.id for r in store.entities().collect()} == {a, d}


class Unembedding(OfflineProvider):
    def embed(self, text):
        return F.when(~text.contains("lost"), OfflineProvider.embed(self, text))


def test_failed_vectors_fail_the_document(spark, store, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "good.md").write_text("# One\nOtters swim.")
    (folder / "bad.md").write_text("# Two\nThis one is lost.")
    ingest(store, read_files(spark, str(folder)), Unembedding(), at(NOW), batch="d1")
    status = {r.title: (r.status, r.error_message) for r in store.documents().collect()}
    assert status == {"good.md": ("completed", ""), "bad.md": ("failed", "embedding failed")}
    assert {"lost" in r.content for r in store.read("chunks").collect()} == {False}


def test_history_ends_before_each_interaction(spark):
    times = [f"2024-05-01 10:0{i}:00" for i in range(5)]
    told = [("s", i, "user" if i % 2 == 0 else "assistant", m, t) for i, (m, t) in enumerate(zip(["yes", "a", "more", "b", "yes"], times))]
    messages = spark.createDataFrame(told, "session_id string, seq long, role string, content string, timestamp string").withColumn(
        "timestamp", F.col("timestamp").cast("timestamp"))
    asked = spark.createDataFrame(
        [("s", ALICE, "user", m, t) for m, t in (("yes", times[0]), ("more", times[2]), ("yes", times[4]))],
        "session_id string, entity_id string, sender string, message string, timestamp string").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    text = {str(r.timestamp): r.text for r in consolidate_plan.extraction_texts(asked, messages, 3).collect()}
    head, tail = "Earlier turns:\n", "\nMessage at hand:\n"
    assert text == {
        times[0]: "user: yes", times[2]: f"{head}user: yes\nassistant: a\n{tail}user: more",
        times[4]: f"{head}user: more\nassistant: b\n{tail}user: yes"}
    alone = consolidate_plan.extraction_texts(asked.limit(2), messages, 3).collect()
    assert {str(r.timestamp): r.text for r in alone} == {t: text[t] for t in (times[0], times[2])}


def test_failed_model_calls_are_null(spark, tmp_path):
    """A reply without its fields, no JSON, or no reply at all: the row goes on without a value."""
    for name, reply in (("good", '{"data": [{"index": 0, "embedding": [1.0, 2.0]}]}'), ("short", '{"data": []}'),
                        ("odd", '{"error": "quota"}'), ("broken", "<html>"), ("none", None)):
        folder = tmp_path / name
        folder.mkdir()
        if reply is not None:
            (folder / "embeddings").write_text(reply)
        model = HttpProvider("openai", "k", "g", "e", base_url=folder.as_uri())
        rows = spark.createDataFrame([("text",)], "t string").select(model.embed(F.col("t")).alias("v"), model.answer(F.col("t")).alias("a"))
        assert rows.first() == ([1.0, 2.0] if name == "good" else None, None)
