"""Streaming jobs run to completion and may be replayed."""

from pyspark.sql import functions as F

from engram.catalog import streams
from engram.models.provider import OfflineProvider
from engram.sources.store import MemoryStore
from engram.streaming import answers, jobs, ledger
from engram.streaming.sessions import session_log
from test_plans import ALICE


def run(query):
    query.awaitTermination(120)
    assert query.exception() is None and not query.isActive


def test_session_log_keeps_the_newest_over_batches(spark, tmp_path):
    schema = "session_id string, seq long, role string, content string"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def add(low, high):
        rows = [("hot" if i % 3 else f"s{i}", i, "user", f"m{i}") for i in range(low, high)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def keep(batch, batch_id):
        batch.withColumn("b", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    for low, high in ((0, 60), (60, 90)):
        add(low, high)
        stream = spark.readStream.schema(schema).parquet(source)
        run(
            session_log(stream, 5).writeStream.foreachBatch(keep).outputMode("update")
            .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        )
    rows = spark.read.parquet(out).filter("session_id = 'hot'").collect()
    last = max(r.b for r in rows)
    assert sorted(r.seq for r in rows if r.b == last) == [83, 85, 86, 88, 89]
    assert len(rows) == 10


def test_consolidation_stream(spark, tmp_path):
    store = MemoryStore(spark, str(tmp_path / "memory"))
    schema = "session_id string, entity_id string, sender string, message string, timestamp timestamp"
    source = str(tmp_path / "in")
    spark.createDataFrame([("s", ALICE, "user", "My city is Oslo.")], "session_id string, entity_id string, sender string, message string").withColumn(
        "timestamp", F.lit("2024-05-01 00:00:00").cast("timestamp")
    ).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    for check in ("one", "two"):  # the second run replays the same batch
        run(jobs.consolidate_interactions(store, stream, OfflineProvider(), str(tmp_path / check), once=True))
    assert [(r.attribute, r.val) for r in store.facts().collect()] == [("city", "Oslo")]


def test_chat_stream_replayed(spark, tmp_path):
    store = MemoryStore(spark, str(tmp_path / "memory"))
    schema = (
        "request_id string, session_id string, entity_id string, agent_role string, message string, "
        "include_facts boolean, timestamp timestamp"
    )
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(
        [("q1", "s", ALICE, "user", "hello", True)],
        "request_id string, session_id string, entity_id string, agent_role string, message string, include_facts boolean",
    ).withColumn("timestamp", F.lit("2024-05-01 00:00:00").cast("timestamp")).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    for check in ("one", "two"):
        run(jobs.answer_requests(store, stream, OfflineProvider(), str(tmp_path / check), out, once=True))
        replies = spark.read.parquet(f"{out}/replies").collect()
        assert [(r.reply, r.from_cache) for r in replies] == [("Noted: hello", False)]
    assert store.read("chat_messages").count() == 2 and store.read("semantic_cache").count() == 1
    # the interaction stream feeds consolidation
    assert spark.read.parquet(f"{out}/interactions").count() == 1


def test_landing_folder(spark, tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    (folder / "a.md").write_text("# A\nMy colour is blue.")
    store = MemoryStore(spark, str(tmp_path / "memory"))
    run(jobs.ingest_landing(store, str(folder), OfflineProvider(), str(tmp_path / "check"), once=True))
    assert [(r.title, r.status) for r in store.documents().collect()] == [("a.md", "completed")]
    assert store.facts().count() == 1


def decided(spark, build, schema, batches, time, out):
    """The rows that a stateful stream gives for batches that arrive one after the other."""
    source = f"{out}/in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).withColumn(time, F.col(time).cast("timestamp")).coalesce(1).write.mode("append").parquet(source)

        def keep(batch, batch_id):
            batch.write.mode("overwrite").parquet(f"{out}/rows/batch={batch_id}")

        stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
        run(build(stream).writeStream.foreachBatch(keep).outputMode("append").option("checkpointLocation", f"{out}/check")
            .trigger(availableNow=True).start())
    return spark.read.parquet(f"{out}/rows").drop("batch").collect()


def test_fact_ledger_in_any_batch_split(spark, tmp_path):
    schema = "id string, entity_id string, attribute string, val string, valid_from string, stability double"
    day = "2024-01-{:02d} 00:00:00".format
    rows = [
        ("f1", "e", "city", "Oslo", day(1), 1.0), ("f2", "e", "city", "Oslo", day(2), 1.0),  # still remembered: skipped
        ("f3", "e", "city", "Oslo", day(5), 1.0),  # forgotten after 2.3 days: inserted anew
        ("f4", "e", "city", "Rome", day(6), -1.0), ("f5", "e", "city", "Bern", day(20), None), ("f6", "e", "city", None, day(21), 1.0),
        ("g1", "e", "visited_places", "A", day(1), -1.0), ("g2", "e", "visited_places", "B", day(2), 1.0), ("g3", "e", "visited_places", "A", day(9), 1.0),
        ("h1", "other", "city", "Oslo", day(3), 1.0),
    ]
    want = {"f1": ("insert", None), "f2": ("skip", None), "f3": ("insert", None), "f4": ("supersede", "f3"), "f5": ("supersede", "f4"),
            "f6": ("supersede", "f5"), "g1": ("insert", None), "g2": ("coexist", None), "g3": ("skip", None), "h1": ("insert", None)}
    ordered = sorted(rows, key=lambda r: r[4])
    for name, batches in (("one", [rows]), ("three", [ordered[:3], ordered[3:7], ordered[7:]])):
        found = decided(spark, lambda s: ledger.fact_ledger(s, "20 days"), schema, batches, "valid_from", str(tmp_path / name))
        assert {r.id: (r.action, r.closed_id) for r in found if r.action != "forget"} == want
        assert {"f1"} <= {r.id for r in found if r.action == "forget"}  # by the row that came later


def test_fact_ledger_forgets_by_timer(spark, tmp_path):
    schema = "id string, entity_id string, attribute string, val string, valid_from string, stability double"
    first = [("a", "e", "city", "Oslo", "2024-01-01 00:00:00", 1.0), ("p", "e", "name", "Ann", "2024-01-01 00:00:00", -1.0)]
    later = [("b", "x", "city", "Rome", "2024-02-01 00:00:00", 1.0)]
    found = decided(spark, lambda s: ledger.fact_ledger(s, "1 hour"), schema, [first, later], "valid_from", str(tmp_path))
    gone = [r for r in found if r.action == "forget"]
    assert [(r.id, str(r.at)[:10]) for r in gone] == [("a", "2024-01-03")]


def test_status_machine(spark, tmp_path):
    schema = "document_id string, id string, status string, error_message string, updated_at string"
    at = "2024-01-01 {:02d}:00:00".format
    first = [("d", "1", "pending", "", at(1)), ("d", "2", "completed", "", at(2)), ("d", "3", "processing", "", at(3)), ("d", "4", "completed", "", at(4)),
             ("d", "5", "failed", "", at(5)), ("s", "6", "pending", "", at(1)), ("s", "7", "processing", "", at(2)), ("n", "8", None, "", at(2))]
    later = [("z", "9", "pending", "", "2024-01-03 00:00:00")]
    found = decided(spark, lambda s: ledger.status_machine(s, 7200, "1 hour"), schema, [first, later], "updated_at", str(tmp_path))
    verdicts = {r.id: (r.action, r.held) for r in found if r.id}
    assert verdicts == {"1": ("accept", None), "2": ("refuse", "pending"), "3": ("accept", "pending"), "4": ("accept", "processing"),
                        "5": ("refuse", "completed"), "6": ("accept", None), "7": ("accept", "pending"), "8": ("refuse", None), "9": ("accept", None)}
    stuck = [r for r in found if r.action == "stuck"]
    assert [(r.document_id, r.status, str(r.at)) for r in stuck] == [("s", "failed", "2024-01-01 04:00:00")]


def test_status_machine_sees_what_was_stuck_before_a_late_row(spark, tmp_path):
    schema = "document_id string, id string, status string, error_message string, updated_at string"
    rows = [("d", "1", "pending", "", "2024-01-01 00:00:00"), ("d", "2", "processing", "", "2024-01-01 01:00:00"), ("d", "3", "completed", "", "2024-01-01 09:00:00")]
    found = decided(spark, lambda s: ledger.status_machine(s, 7200), schema, [rows], "updated_at", str(tmp_path))
    assert [(r.action, r.status, r.held) for r in sorted(found, key=lambda r: (r.at, r.action))] == [
        ("accept", "pending", None), ("accept", "processing", "pending"), ("stuck", "failed", "processing"), ("refuse", "completed", "failed")]


def test_answer_cache_over_batches(spark, tmp_path):
    """However the events are cut and ordered, the cache holds the newest since the last invalidation."""
    rows = [("hot" if i % 3 else f"o{i % 4}", i, i in (40, 63), f"r{i}", [float(i)]) for i in range(100)]
    rows += [(None, 5, False, "x", None), ("hot", None, False, "x", None), ("late", 7, None, None, None)]
    cleared = {}
    for owner, seq, clear, *_ in rows:
        if clear:
            cleared[owner] = max(seq, cleared.get(owner, -1))
    want = {}
    for owner, seq, clear, response, _ in rows:
        if owner is not None and seq is not None and not clear and seq > cleared.get(owner, -1):
            want.setdefault(owner, []).append((seq, response))
    want = {(owner, *entry) for owner, held in want.items() for entry in sorted(held)[-8:]}

    for name, cuts in (("one", [rows]), ("many", [rows[60:], rows[:60], rows[30:70]])):
        source, out = str(tmp_path / name / "in"), str(tmp_path / name / "out")

        def keep(batch, batch_id):
            batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

        for part in cuts:
            spark.createDataFrame(part, answers.EVENTS).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(answers.EVENTS).parquet(source)
            run(
                answers.answer_cache(stream, 8).writeStream.foreachBatch(keep).outputMode("append")
                .option("checkpointLocation", str(tmp_path / name / "check")).trigger(availableNow=True).start()
            )
        held = answers.held_answers(spark.read.parquet(out)).collect()
        assert {(r.owner, r.seq, r.response) for r in held} == want and len(held) == len(want)
        assert all(r.embedding == [r.seq] for r in held if r.owner != "late")


def test_streams_read_a_table_kept_as_a_folder(spark, sf_dir, tmp_path):
    queries = [streams.stream_sessions, streams.stream_cache, streams.stream_status_machine]
    for name in ("conversations", "events"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    for read in queries:
        assert sorted(read(spark, str(tmp_path)).collect()) == sorted(read(spark, sf_dir).collect())


def test_a_stream_of_an_empty_table_gives_no_rows(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/conversations.parquet").limit(0).write.parquet(str(tmp_path / "conversations.parquet"))
    assert streams.stream_sessions(spark, str(tmp_path)).collect() == []


def test_keys_of_one_shard_are_decided_apart(spark, tmp_path, monkeypatch):
    """A shard keeps the state of several keys over micro-batches and timers; no key sees another's."""
    monkeypatch.setattr(ledger, "SHARDS", 2)
    at = "2024-01-{:02d} 00:00:00".format
    schema = "id string, entity_id string, attribute string, val string, valid_from string, stability double"
    first = [(f"a{i}", f"e{i}", "city", "Oslo", at(1), 1.0 if i % 2 else -1.0) for i in range(12)]
    second = [(f"b{i}", f"e{i}", "city", "Oslo" if i % 3 else "Rome", at(2), 1.0) for i in range(12)]
    third = [("c0", "e1", "city", "Oslo", at(20), 1.0)]
    found = decided(spark, lambda s: ledger.fact_ledger(s, "1 hour"), schema, [first, second, third], "valid_from", str(tmp_path / "facts"))
    want = {f"a{i}": ("insert", None) for i in range(12)} | {"c0": ("insert", None)}
    want |= {f"b{i}": ("skip", None) if i % 3 else ("supersede", f"a{i}") for i in range(12)}
    assert {r.id: (r.action, r.closed_id) for r in found if r.action != "forget"} == want
    # by timer or by the next row: what is not pinned, once each
    assert sorted(r.id for r in found if r.action == "forget") == sorted([f"a{i}" for i in (1, 5, 7, 11)] + [f"b{i}" for i in (0, 3, 6, 9)])

    schema = "document_id string, id string, status string, error_message string, updated_at string"
    first = [(f"d{i}", f"p{i}", "pending", "", at(1)) for i in range(8)]
    second = [(f"d{i}", f"q{i}", "processing" if i % 2 else "pending", "", at(2)) for i in range(8)]
    found = decided(spark, lambda s: ledger.status_machine(s, 7200), schema, [first, second, [("z", "z", "pending", "", at(9))]], "updated_at", str(tmp_path / "statuses"))
    assert {r.id: (r.action, r.held) for r in found if r.id and r.id[0] == "q"} == {f"q{i}": ("accept" if i % 2 else "refuse", "pending") for i in range(8)}
    assert sorted(r.document_id for r in found if r.action == "stuck") == ["d1", "d3", "d5", "d7"]
