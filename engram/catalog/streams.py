"""Catalogue: streams over the supplied tables, run to completion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.catalog.registry import query
from engram.catalog.tables import table
from engram.session import work_dir
from engram.streaming.answers import answer_cache, held_answers
from engram.streaming.ledger import fact_ledger, status_machine
from engram.streaming.sessions import session_log

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _finish(spark, stream: DataFrame, out: str, check: str, mode: str) -> DataFrame:
    """Run a stateful stream over what there is; the rows of its micro-batches, which are folders of ``out``."""
    written = T.StructType([*stream.schema.fields, T.StructField("batch_id", T.IntegerType())])
    spark.createDataFrame([], written).write.parquet(f"{out}/batch=-1")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        run = (
            stream.writeStream.foreachBatch(keep).outputMode(mode)
            .option("checkpointLocation", check).trigger(availableNow=True).start()
        )
        run.awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before)
    return spark.read.schema(written).parquet(out)


def _stream(spark, sf_dir: str, name: str) -> DataFrame:
    """A table, be it one file or a folder of them, as a stream."""
    rows, file = table(spark, sf_dir, name), f"{name}.parquet"
    stream = spark.readStream.schema(rows.schema)
    if any(read.endswith(f"/{file}") for read in rows.inputFiles()):
        return stream.option("pathGlobFilter", file).parquet(sf_dir)
    return stream.parquet(f"{sf_dir}/{file}")


@query("stream_sessions", """
SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS seq, role FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 3
""")
def stream_sessions(spark, sf_dir):
    """The last three messages of each session, kept as streaming state."""
    work = work_dir(spark)
    messages = _stream(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("seq"), "role",
        F.col("text").alias("content"),
    )

    written = _finish(spark, session_log(messages, 3), f"{work}/sessions", f"{work}/checkpoint", "update")
    written = written.select("session_id", "seq", "role", "batch_id")
    # a session's newest batch is its current state
    newest = written.groupBy("session_id").agg(F.max("batch_id").alias("batch_id"))
    return written.join(newest, ["session_id", "batch_id"]).select("session_id", "seq", "role")


_EXPIRY = "(CASE WHEN stability = -1 THEN 1e18 ELSE epoch_us(ts) + ceil(stability * 24 * 3.6e9 * ln(10)) END)"


@query("stream_fact_ledger", f"""
WITH RECURSIVE f AS (SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS id, user_id, event_type, CAST(CAST(floor(value / 50) AS BIGINT) AS VARCHAR) AS val, ts,
        CASE WHEN event_id % 50 = 0 THEN -1.0 ELSE CAST(1 + event_id % 15 AS DOUBLE) / 8 END AS stability FROM events),
n AS (SELECT *, {_EXPIRY} AS expiry, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, id) AS k FROM f),
walk AS (SELECT user_id, event_type, k, id, 'insert' AS action, NULL::VARCHAR AS closed_id, id AS held, val AS held_val, expiry AS until FROM n WHERE k = 1
    UNION ALL SELECT n.user_id, n.event_type, n.k, n.id,
        CASE WHEN until < epoch_us(n.ts) THEN 'insert' WHEN held_val = val THEN 'skip' ELSE 'supersede' END,
        CASE WHEN until >= epoch_us(n.ts) AND held_val <> val THEN held END,
        CASE WHEN until >= epoch_us(n.ts) AND held_val = val THEN held ELSE n.id END, val,
        CASE WHEN until >= epoch_us(n.ts) AND held_val = val THEN until ELSE expiry END
    FROM walk w JOIN n ON n.user_id = w.user_id AND n.event_type = w.event_type AND n.k = w.k + 1)
SELECT CAST(user_id AS VARCHAR) AS entity_id, event_type AS attribute, id, action, closed_id FROM walk
""")
def stream_fact_ledger(spark, sf_dir):
    """What each fact does to the open value of its entity and attribute, with forgetting, as keyed state."""
    step = F.pmod(F.col("event_id"), F.lit(50))
    facts = _stream(spark, sf_dir, "events").select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"), F.col("user_id").cast("string").alias("entity_id"),
        F.col("event_type").alias("attribute"), F.floor(F.col("value") / 50).cast("string").alias("val"),
        F.col("ts").cast("timestamp").alias("valid_from"),
        F.when(step == 0, -1.0).otherwise((1 + F.pmod(F.col("event_id"), F.lit(15))).cast("double") / 8).alias("stability"),
    )
    work = work_dir(spark)
    done = _finish(spark, fact_ledger(facts), f"{work}/ledger", f"{work}/checkpoint", "append")
    return done.where("action <> 'forget'").select("entity_id", "attribute", "id", "action", "closed_id")


_BECOMES = "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'pending' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'completed' ELSE 'failed' END"


@query("stream_status_machine", f"""
WITH RECURSIVE n AS (SELECT user_id, event_id, ts, {_BECOMES} AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
walk AS (SELECT user_id, 0::BIGINT AS k, NULL::BIGINT AS event_id, NULL::VARCHAR AS status, NULL::VARCHAR AS action, NULL::VARCHAR AS held, NULL::VARCHAR AS next FROM n WHERE k = 1
    UNION ALL SELECT n.user_id, n.k, n.event_id, n.status, CASE WHEN ok THEN 'accept' ELSE 'refuse' END, w.next, CASE WHEN ok THEN n.status ELSE w.next END
    FROM walk w JOIN n ON n.user_id = w.user_id AND n.k = w.k + 1,
    LATERAL (SELECT coalesce(w.next, '') || '>' || n.status IN ('>pending', 'pending>processing', 'pending>failed', 'processing>completed', 'processing>failed', 'failed>pending') AS ok))
SELECT CAST(user_id AS VARCHAR) AS document_id, event_id, status, action, held FROM walk WHERE k > 0
""")
def stream_status_machine(spark, sf_dir):
    """Which status changes each document accepts and which it refuses, as keyed state."""
    log = _stream(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("document_id"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"),
        F.expr(_BECOMES).alias("status"), F.lit("").alias("error_message"), F.col("ts").cast("timestamp").alias("updated_at"),
    )
    work = work_dir(spark)
    # far longer than the events span, so that nothing is stuck
    done = _finish(spark, status_machine(log, stuck_after=10**9), f"{work}/status", f"{work}/checkpoint", "append")
    return done.select("document_id", F.col("id").cast("long").alias("event_id"), "status", "action", "held")


@query("stream_cache", """
WITH cleared AS (SELECT user_id, max(event_id) FILTER (WHERE event_type = 'signup') AS last_clear FROM events GROUP BY user_id)
SELECT CAST(user_id AS VARCHAR) AS owner, event_id AS seq, event_type AS response FROM (
  SELECT e.*, row_number() OVER (PARTITION BY e.user_id ORDER BY event_id DESC) AS rn
  FROM events e JOIN cleared c USING (user_id) WHERE event_type <> 'signup' AND event_id > coalesce(last_clear, -1)) WHERE rn <= 30
""")
def stream_cache(spark, sf_dir):
    """The newest 30 answers of each owner since its last invalidation, kept as streaming state."""
    events = _stream(spark, sf_dir, "events").select(
        F.col("user_id").alias("owner"), F.col("event_id").alias("seq"), (F.col("event_type") == "signup").alias("clear"),
        F.col("event_type").alias("response"), F.array(F.col("value")).alias("embedding"),
    )
    work = work_dir(spark)
    done = _finish(spark, answer_cache(events, 30), f"{work}/cache", f"{work}/checkpoint", "append")
    return held_answers(done).select("owner", "seq", "response")
