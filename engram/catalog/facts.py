"""Catalogue: fact search, decay, effects, supersession, candidates, access."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.catalog.registry import query
from engram.catalog.tables import SQL_FACTS, event_facts, now, sql_cosine, table
from engram.config import DEFAULTS
from engram.functions.text import fact_text
from engram.operators import facts as O
from engram.operators import reflection as X
from engram.operators import scope as S

NOW_SQL = "TIMESTAMP '2024-03-15'"
SINGULAR_SQL = r"""NOT regexp_matches(lower({0}), '^(former_|past_|visited_)|(_history|_list|_hobbies|_interests)$|hobb|interest|injury|hospital|allergy|medication')"""
RETENTION_SQL = (
    "CASE WHEN stability = -1 THEN 1.0 ELSE "
    f"exp(-(epoch_us({NOW_SQL}) - epoch_us(last_accessed)) / 3.6e9 / (24.0 * stability)) END"
)

# what an entity still remembers, and may see itself
REMEMBERED_SQL = f"{RETENTION_SQL} >= 0.1"
VISIBLE_SQL = f"coalesce(nullif(agent_owner, ''), '{S.NIL_UUID}') IN (entity_id, '{S.NIL_UUID}')"


def _ntz(*columns):
    return [F.col(c).cast("timestamp_ntz").alias(c) for c in columns]


@query("active_facts_topn", f"""
WITH {SQL_FACTS}
SELECT entity_id, id, attribute, val, rn FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY valid_from DESC, id) AS rn FROM facts WHERE CAST(id AS BIGINT) % 4 <> 3)
WHERE rn <= 20
""")
def active_facts_topn(spark, sf_dir):
    """The 20 newest active facts of every entity; every fourth fact is closed."""
    closed = F.when(F.col("id").cast("long") % 4 == 3, F.col("valid_from"))
    facts = event_facts(spark, sf_dir).withColumn("valid_until", closed).filter(S.active())
    return O.newest_per_entity(facts, 20).select("entity_id", "id", "attribute", "val", "rn")


@query("retention_decay", f"""
WITH {SQL_FACTS}
SELECT id, round({RETENTION_SQL}, 6) AS memory_strength, {RETENTION_SQL} < 0.1 AS expired FROM facts
""")
def retention_decay(spark, sf_dir):
    """Forgetting curve over all facts."""
    decayed = O.apply_decay(event_facts(spark, sf_dir), now())
    return decayed.select("id", F.round("memory_strength", 6).alias("memory_strength"), "expired")


@query("search_by_time", f"""
WITH {SQL_FACTS},
who AS (SELECT CAST(min(user_id) AS VARCHAR) AS id FROM events),
found AS (SELECT * FROM facts WHERE entity_id = (SELECT id FROM who)
          AND coalesce(nullif(agent_owner, ''), 'shared') IN ((SELECT id FROM who), 'shared')
          ORDER BY valid_from DESC, id LIMIT 25)
SELECT id, attribute, val, round({RETENTION_SQL}, 6) AS memory_strength FROM found WHERE {RETENTION_SQL} >= 0.1
""")
def search_by_time(spark, sf_dir):
    """Newest facts of one entity as it sees them, decayed."""
    who = str(table(spark, sf_dir, "events").agg(F.min("user_id")).first()[0])
    found = O.search_hybrid(event_facts(spark, sf_dir), now(), who, viewer=who, limit=25).facts
    return found.select("id", "attribute", "val", F.round("memory_strength", 6).alias("memory_strength"))


@query("search_batch", f"""
WITH {SQL_FACTS},
seen AS (SELECT * FROM facts WHERE coalesce(nullif(agent_owner, ''), entity_id) = entity_id),
found AS (SELECT * FROM seen QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY valid_from DESC, id) <= 5)
SELECT entity_id AS request_id, id, round({RETENTION_SQL}, 6) AS memory_strength FROM found WHERE {RETENTION_SQL} >= 0.1
""")
def search_batch(spark, sf_dir):
    """The five newest facts every entity sees of itself, decayed, in one plan."""
    facts = event_facts(spark, sf_dir).withColumn("embedding", F.lit(None).cast("array<float>"))
    requests = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("request_id")).distinct()
    requests = requests.select(
        "request_id", F.col("request_id").alias("entity_id"), F.col("request_id").alias("viewer"),
        F.lit(None).cast("array<float>").alias("embedding"),
    )
    found = O.search_hybrid_batch(facts, requests, now(), 5).facts
    return found.select("request_id", "id", F.round("memory_strength", 6).alias("memory_strength"))


@query("search_batch_vectors", f"""
WITH {SQL_FACTS},
placed AS (SELECT f.*, v.embedding FROM facts f JOIN embeddings v ON v.vec_id = (CAST(f.entity_id AS BIGINT) + CAST(f.id AS BIGINT)) % (SELECT count(*) FROM embeddings)),
asked AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS request_id, embedding AS wanted FROM events JOIN embeddings ON vec_id = user_id % (SELECT count(*) FROM embeddings)),
pool AS (SELECT *, {sql_cosine('embedding', 'wanted')} AS score FROM placed, asked
         QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY score DESC, id) <= {DEFAULTS.ann_pool}),
found AS (SELECT * FROM pool WHERE entity_id = request_id AND {VISIBLE_SQL}
          QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY score DESC, id) <= 5)
SELECT request_id, id, round({RETENTION_SQL}, 6) AS memory_strength FROM found WHERE {REMEMBERED_SQL}
""")
def search_batch_vectors(spark, sf_dir):
    """The five nearest facts every entity sees of itself, among the nearest of all facts, decayed."""
    held = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = held.count()
    spot = F.pmod(F.col("entity_id").cast("long") + F.col("id").cast("long"), F.lit(n))
    facts = event_facts(spark, sf_dir).drop("embedding").withColumn("vec_id", spot).join(held, "vec_id").drop("vec_id")
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    requests = users.join(held, F.pmod("user_id", F.lit(n)) == F.col("vec_id")).select(
        *(F.col("user_id").cast("string").alias(c) for c in ("request_id", "entity_id", "viewer")), "embedding")
    found = O.search_hybrid_batch(facts, requests, now(), 5).facts
    return found.select("request_id", "id", F.round("memory_strength", 6).alias("memory_strength"))


@query("access_effects", f"""
WITH {SQL_FACTS}
SELECT id AS fact_id, CASE WHEN {RETENTION_SQL} < 0.1 THEN 'deactivate' ELSE 'reinforce' END AS kind FROM facts
""")
def access_effects(spark, sf_dir):
    """What reading every fact does to it."""
    decayed = O.apply_decay(event_facts(spark, sf_dir), now())
    return O.access_effects(decayed, now()).select("fact_id", "kind")


@query("apply_effects", f"""
WITH {SQL_FACTS},
log AS (SELECT id, {RETENTION_SQL} < 0.1 AS closes FROM facts
        UNION ALL SELECT id, false FROM facts WHERE attribute = 'click'),
sums AS (SELECT id, bool_or(closes) AS closed, count(*) FILTER (NOT closes) AS reads FROM log GROUP BY id)
SELECT id, CASE WHEN closed THEN {NOW_SQL} END AS valid_until,
       CASE WHEN reads > 0 THEN {NOW_SQL} ELSE last_accessed END AS last_accessed,
       round(CASE WHEN stability = -1 OR reads = 0 THEN stability ELSE least(stability * pow(1.5, reads), 365) END, 6) AS stability
FROM facts JOIN sums USING (id)
""")
def apply_effects(spark, sf_dir):
    """Facts after replaying a log of closings and accesses."""
    facts = event_facts(spark, sf_dir)
    read = O.access_effects(O.apply_decay(facts, now()), now())
    again = facts.filter(F.col("attribute") == "click").select(
        F.col("id").alias("fact_id"), F.lit("reinforce").alias("kind"), now().alias("at")
    )
    after = O.apply_effects(facts, read.unionByName(again))
    return after.select(
        "id", *_ntz("valid_until", "last_accessed"), F.round("stability", 6).alias("stability")
    )


@query("reinforce", f"""
WITH {SQL_FACTS}, hit AS (SELECT id FROM facts WHERE attribute = 'click')
SELECT id, CASE WHEN id IN (SELECT id FROM hit) THEN {NOW_SQL} ELSE last_accessed END AS last_accessed,
  round(CASE WHEN id IN (SELECT id FROM hit) AND stability <> -1 THEN least(stability * 1.5, 365) ELSE stability END, 6) AS stability
FROM facts
""")
def reinforce(spark, sf_dir):
    """Facts after reading those of one attribute."""
    facts = event_facts(spark, sf_dir)
    after = O.reinforce(facts, facts.filter(F.col("attribute") == "click"), now())
    return after.select("id", *_ntz("last_accessed"), F.round("stability", 6).alias("stability"))


@query("deactivate", f"""
WITH {SQL_FACTS}
SELECT id, CASE WHEN attribute = 'click' THEN {NOW_SQL} END AS valid_until FROM facts
""")
def deactivate(spark, sf_dir):
    """Facts after closing those of one attribute, twice."""
    facts = event_facts(spark, sf_dir)
    listed = facts.filter(F.col("attribute") == "click")
    once = O.deactivate(facts, listed, now())
    twice = O.deactivate(once, listed, now() + F.expr("interval 1 day"))
    return twice.select("id", *_ntz("valid_until"))


@query("insert_defaults", f"""
SELECT event_id, CASE WHEN value > 50 THEN value ELSE 1.0 END AS memory_strength,
       CASE event_id % 4 WHEN 0 THEN -1.0 WHEN 1 THEN 30.0 WHEN 2 THEN 30.0 ELSE 12.0 END AS stability,
       CASE WHEN event_id % 2 = 0 THEN ts ELSE {NOW_SQL} END AS last_accessed,
       CASE WHEN event_id % 2 = 0 THEN 'own' ELSE 'ctx' END AS agent_owner
FROM events
""")
def insert_defaults(spark, sf_dir):
    """What an inserted fact gets where it leaves a field open."""
    events = table(spark, sf_dir, "events")
    even = F.pmod(F.col("event_id"), F.lit(2)) == 0
    step = F.pmod(F.col("event_id"), F.lit(4))
    rows = events.select(
        "event_id", F.when(F.col("value") > 50, F.col("value")).alias("memory_strength"),
        F.when(step == 0, -1.0).when(step == 1, 0.0).when(step == 3, 12.0).alias("stability"),
        F.when(even, F.col("ts").cast("timestamp")).alias("last_accessed"),
        F.when(even, "own").alias("agent_owner"),
    )
    filled = O.with_insert_defaults(rows, now(), F.lit("ctx"))
    return filled.select(
        "event_id", "memory_strength", "stability", *_ntz("last_accessed"), "agent_owner"
    )


@query("owner_scope", """
SELECT o_orderkey, o_custkey FROM orders
WHERE (CASE o_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE CAST(o_custkey AS VARCHAR) END) IS NULL
   OR (CASE o_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE CAST(o_custkey AS VARCHAR) END) = ''
   OR o_custkey = (SELECT max(o_custkey) FROM orders WHERE o_custkey % 3 = 2)
""")
def owner_scope(spark, sf_dir):
    """Rows one owner sees: its own and the shared ones."""
    orders = table(spark, sf_dir, "orders")
    part = F.pmod(F.col("o_custkey"), F.lit(3))
    viewer = orders.filter(part == 2).agg(F.max("o_custkey")).first()[0]
    owner = (
        F.when(part == 0, F.lit(None).cast("string")).when(part == 1, "")
        .otherwise(F.col("o_custkey").cast("string"))
    )
    return orders.filter(S.owner_visible(owner, str(viewer))).select("o_orderkey", "o_custkey")


@query("rbac_filter", """
WITH said AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 'Admin_Agent' ELSE role END AS source_agent FROM conversations),
roles AS (SELECT unnest(['admin', 'user', 'Admin_Agent', 'site_administrator']) AS role)
SELECT role, conv_id, turn FROM said, roles
WHERE lower(role) IN ('admin', 'admin_agent')
   OR NOT (contains(lower(source_agent), 'admin') AND NOT contains(lower(role), 'admin'))
""")
def rbac_filter(spark, sf_dir):
    """Messages each role may read."""
    said = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn",
        F.when(F.col("role") == "system", "Admin_Agent").otherwise(F.col("role")).alias("source_agent"),
        F.explode(F.array(*[F.lit(r) for r in ("admin", "user", "Admin_Agent", "site_administrator")])).alias("role"),
    )
    return said.filter(S.may_read(F.col("role"), F.col("source_agent"))).select("role", "conv_id", "turn")


@query("consensus_trust", """
WITH agents(agent_id, agent_role, trust) AS (VALUES ('agent:admin','admin',1.0),('agent:logistics','writer',0.9),
  ('agent:chemistry','writer',0.95),('reflection_engine','writer',0.8),('document','writer',0.85),('visitor','guest',0.3)),
said AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 'agent:admin' WHEN 'user' THEN 'visitor' ELSE
           CASE turn % 3 WHEN 0 THEN 'document' WHEN 1 THEN 'nobody' ELSE 'reflection_engine' END END AS source_agent,
         CASE WHEN turn % 2 = 0 THEN 'system_formula' ELSE 'hobby' END AS attribute FROM conversations)
SELECT conv_id, turn, CAST(coalesce(trust, 0.5) AS DOUBLE) AS trust,
       NOT (coalesce(agent_role = 'guest', false) AND attribute IN ('system_formula', 'proprietary_value')) AS authorised
FROM said LEFT JOIN agents ON source_agent = agent_id
""")
def consensus_trust(spark, sf_dir):
    """Trust and write permission of the author of each message."""
    turn = F.pmod(F.col("turn"), F.lit(3))
    said = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn",
        F.when(F.col("role") == "system", "agent:admin").when(F.col("role") == "user", "visitor")
        .when(turn == 0, "document").when(turn == 1, "nobody").otherwise("reflection_engine").alias("source_agent"),
        F.when(F.pmod(F.col("turn"), F.lit(2)) == 0, "system_formula").otherwise("hobby").alias("attribute"),
    )
    registry = S.agents(spark).unionByName(
        spark.createDataFrame([("visitor", "guest", 0.3)], "agent_id string, agent_role string, trust_score double")
    )
    return S.with_trust(said, registry).select("conv_id", "turn", "trust", "authorised")


@query("fact_scd2", f"""
WITH {SQL_FACTS},
marked AS (SELECT *, lag(val) OVER w AS before FROM facts WINDOW w AS (PARTITION BY entity_id, attribute ORDER BY valid_from, id)),
kept AS (SELECT * FROM marked WHERE before IS NULL OR before <> val)
SELECT id, entity_id, attribute, val, valid_from,
       lead(valid_from) OVER (PARTITION BY entity_id, attribute ORDER BY valid_from, id) AS valid_until
FROM kept
""")
def fact_scd2(spark, sf_dir):
    """Validity intervals of all attribute values: repeats skipped, old ones closed."""
    history = O.version_history(event_facts(spark, sf_dir))
    return history.select("id", "entity_id", "attribute", "val", *_ntz("valid_from", "valid_until"))


@query("supersede_join", f"""
WITH {SQL_FACTS},
old AS (SELECT entity_id, attribute, arg_min(id, (valid_from, id)) AS old_id, arg_min(val, (valid_from, id)) AS old_val
        FROM facts WHERE {REMEMBERED_SQL} AND {VISIBLE_SQL} GROUP BY ALL),
cand AS (SELECT event_id, CAST(user_id AS VARCHAR) AS entity_id, event_type AS attribute,
                CAST(CAST(floor(value / 100) AS BIGINT) AS VARCHAR) AS val FROM events)
SELECT event_id, old_id, CASE WHEN old_id IS NULL THEN 'insert' WHEN old_val = val THEN 'skip'
       WHEN {SINGULAR_SQL.format('attribute')} THEN 'supersede' ELSE 'coexist' END AS action
FROM cand LEFT JOIN old USING (entity_id, attribute)
""")
def supersede_join(spark, sf_dir):
    """What happens to each candidate fact given the stored ones."""
    facts = event_facts(spark, sf_dir)
    candidates = table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").cast("string").alias("entity_id"),
        F.col("event_type").alias("attribute"), F.floor(F.col("value") / 100).cast("string").alias("val"),
    )
    return O.classify_candidates(candidates, facts, now=now()).select("event_id", "old_id", "action")


@query("contradicted_facts", f"""
WITH {SQL_FACTS},
cand AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS entity_id, event_type AS attribute,
                CAST(CAST(floor(value / 100) AS BIGINT) AS VARCHAR) AS val FROM events)
SELECT id FROM facts f WHERE {SINGULAR_SQL.format('f.attribute')} AND {REMEMBERED_SQL} AND EXISTS (
  SELECT 1 FROM cand c WHERE c.entity_id = f.entity_id AND c.attribute = f.attribute AND c.val <> f.val)
""")
def contradicted_facts(spark, sf_dir):
    """Stored facts that some document fact gives another value for."""
    candidates = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("entity_id"), F.col("event_type").alias("attribute"),
        F.floor(F.col("value") / 100).cast("string").alias("val"),
    )
    return O.contradicted(event_facts(spark, sf_dir), candidates, now=now()).select("id")


@query("conflict_match", f"""
WITH {SQL_FACTS},
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY valid_from DESC, id) AS rn FROM facts WHERE {VISIBLE_SQL})
         WHERE rn <= 100 AND {REMEMBERED_SQL}),
verdicts AS (SELECT event_id AS verdict_id, CAST(user_id AS VARCHAR) AS entity_id,
    CASE event_id % 4 WHEN 0 THEN upper(event_type) || ': ' || CAST(CAST(floor(value / 50) AS BIGINT) AS VARCHAR)
      WHEN 1 THEN ' ' || CAST(CAST(floor(value / 50) AS BIGINT) AS VARCHAR) || ' '
      WHEN 2 THEN '' ELSE 'the ' || event_type || ' entry is stale' END AS said,
    CASE WHEN event_id % 8 = 2 THEN 'about ' || event_type ELSE '' END AS reason FROM events),
pairs AS (SELECT verdict_id, f.id, lower(trim(said)) AS said, lower(reason) AS reason,
    lower(f.attribute || ': ' || f.val) AS text, lower(f.val) AS val, lower(f.attribute) AS attribute
    FROM verdicts v JOIN near f USING (entity_id)),
levels AS (SELECT verdict_id, id, CASE
    WHEN said <> '' AND text = said THEN 1 WHEN said <> '' AND val = said THEN 2
    WHEN said <> '' AND (contains(text, said) OR contains(said, text)) THEN 3
    WHEN said <> '' AND contains(said, val) THEN 4
    WHEN contains(said, attribute) OR contains(reason, attribute) THEN 5 END AS level FROM pairs),
best AS (SELECT verdict_id, min((level, id)) AS b FROM levels WHERE level IS NOT NULL GROUP BY verdict_id)
SELECT v.verdict_id, struct_extract(b, 2) AS matched_id, struct_extract(b, 1) AS matched_level
FROM verdicts v LEFT JOIN best USING (verdict_id)
""")
def conflict_match(spark, sf_dir):
    """The stored fact each conflict verdict speaks of."""
    band = F.floor(F.col("value") / 50).cast("string")
    step = F.pmod(F.col("event_id"), F.lit(4))
    verdicts = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("verdict_id"), F.col("user_id").cast("string").alias("entity_id"),
        F.when(step == 0, fact_text(F.upper("event_type"), band))
        .when(step == 1, F.concat(F.lit(" "), band, F.lit(" "))).when(step == 2, "")
        .otherwise(F.concat(F.lit("the "), "event_type", F.lit(" entry is stale"))).alias("conflicting_fact"),
        F.when(F.pmod(F.col("event_id"), F.lit(8)) == 2, F.concat(F.lit("about "), "event_type"))
        .otherwise("").alias("reason"),
    )
    matched = O.match_conflicts(verdicts, event_facts(spark, sf_dir), now=now())
    return matched.select("verdict_id", "matched_id", "matched_level")


@query("reflection_groups", f"""
WITH {SQL_FACTS},
near AS (SELECT *, coalesce(nullif(agent_owner, ''), '{S.NIL_UUID}') AS owner FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY valid_from DESC, id) AS rn FROM facts) WHERE rn <= 100 AND {REMEMBERED_SQL}),
enough AS (SELECT entity_id FROM near GROUP BY 1 HAVING count(*) >= 2),
owners AS (SELECT DISTINCT entity_id, owner FROM near JOIN enough USING (entity_id)),
lines AS (SELECT o.entity_id, o.owner, n.rn, n.owner <> o.owner AS shared, '- Attribute ''' || attribute || ''': ' || val || chr(10) AS line
          FROM owners o JOIN near n ON n.entity_id = o.entity_id AND (n.owner = o.owner OR n.owner = '{S.NIL_UUID}'))
SELECT entity_id, owner, count(*) AS n_facts, string_agg(line, '' ORDER BY shared, rn) AS fact_lines
FROM lines GROUP BY ALL HAVING count(*) >= 2
""")
def reflection_groups(spark, sf_dir):
    """Facts each owner may reflect on, per entity: its own, then the shared ones."""
    return X.reflection_facts(event_facts(spark, sf_dir), now=now()).drop("facts")


@query("insight_filter", """
SELECT event_id FROM events WHERE value / 100 >= 0.7 AND event_type <> ''
""")
def insight_filter(spark, sf_dir):
    """Insights that are good enough to keep."""
    events = table(spark, sf_dir, "events")
    good = S.good_insight(F.col("event_type"), F.col("event_type"), F.col("value") / 100)
    return events.filter(good).select("event_id")


@query("doc_status_latest", """
SELECT user_id AS document_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS updated_at FROM events GROUP BY user_id
""")
def doc_status_latest(spark, sf_dir):
    """Latest status of each document out of a log of status changes."""
    from engram.operators.documents import latest_status

    log = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("document_id"), F.col("event_type").alias("status"),
        F.lit(None).cast("string").alias("error_message"), F.col("ts").alias("updated_at"),
        F.col("event_id").alias("tie"),
    )
    return latest_status(log, "tie").select("document_id", "status", "updated_at")


@query("last_n_messages", """
SELECT conv_id, turn, role FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 3
""")
def last_n_messages(spark, sf_dir):
    """The last three messages of every session."""
    from engram.operators.chat import last_messages

    return last_messages(_messages(spark, sf_dir), 3).select(
        F.col("session_id").alias("conv_id"), F.col("seq").alias("turn"), "role"
    )


@query("clear_sessions", """
SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')
""")
def clear_sessions(spark, sf_dir):
    """Messages left after clearing every session with a system message."""
    from engram.operators.chat import clear_sessions as cleared

    messages = _messages(spark, sf_dir)
    left = cleared(messages, messages.filter(F.col("role") == "system"))
    return left.select(F.col("session_id").alias("conv_id"), F.col("seq").alias("turn"))


@query("history_cut", """
WITH cur AS (SELECT conv_id, arg_max(role, turn) AS role, arg_max(text, turn) AS text FROM conversations GROUP BY 1),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 10),
cut AS (SELECT n.conv_id, max(n.turn) AS cut_at FROM near n JOIN cur c ON n.conv_id = c.conv_id AND n.role = c.role AND n.text = c.text GROUP BY 1)
SELECT near.conv_id, near.turn FROM near LEFT JOIN cut USING (conv_id) WHERE cut_at IS NULL OR near.turn < cut_at
""")
def history_cut(spark, sf_dir):
    """History before the message at hand."""
    from engram.operators.chat import history_before

    messages = _messages(spark, sf_dir)
    current = messages.groupBy("session_id").agg(
        F.max_by("role", "seq").alias("sender"), F.max_by("content", "seq").alias("message")
    )
    cut = history_before(messages, current, 10)
    return cut.select(F.col("session_id").alias("conv_id"), F.col("seq").alias("turn"))


def _messages(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role",
        F.col("text").alias("content"),
    )


@query("prompt_assembly", f"""
WITH {SQL_FACTS},
asked AS (SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS message FROM conversations GROUP BY 1),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY valid_from DESC, id) AS rn FROM facts) WHERE rn <= 5),
known AS (SELECT conv_id, string_agg('- ' || attribute || ': ' || val || ' (Confidence: ' || printf('%.2f', confidence_score) || ')' || chr(10), '' ORDER BY rn) AS lines
          FROM asked JOIN near ON entity_id = CAST(conv_id AS VARCHAR) GROUP BY 1),
hist AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 15),
talk AS (SELECT conv_id, string_agg(role || ': ' || text || chr(10), '' ORDER BY turn) AS lines FROM hist GROUP BY 1)
SELECT a.conv_id, CASE WHEN k.lines IS NOT NULL THEN 'Known facts about the user and the context:' || chr(10) || k.lines || chr(10)
         || 'Use these facts where they help; do not list them unless asked.' || chr(10) || chr(10) ELSE '' END
       || CASE WHEN t.lines IS NOT NULL THEN 'Earlier messages:' || chr(10) || t.lines || chr(10) ELSE '' END
       || 'New message: ' || message || chr(10) || 'Answer:' AS prompt
FROM asked a LEFT JOIN known k USING (conv_id) LEFT JOIN talk t USING (conv_id)
""")
def prompt_assembly(spark, sf_dir):
    """Prompt of the last message of every session, with facts and history."""
    from engram.operators.chat import assemble_prompts

    messages = _messages(spark, sf_dir)
    asked = messages.groupBy(F.col("session_id").alias("request_id")).agg(
        F.max_by("content", "seq").alias("message")
    ).withColumn("session_id", F.col("request_id"))
    near = O.newest_per_entity(event_facts(spark, sf_dir), 5)
    who = asked.withColumn("entity_id", F.col("session_id").cast("string"))
    facts = who.join(near, "entity_id").select(
        "request_id", F.lit(0).alias("part"), F.col("rn").alias("ord"), "attribute", "val", "confidence_score"
    )
    prompts = assemble_prompts(asked, facts, messages, 15)
    return prompts.select(F.col("request_id").alias("conv_id"), "prompt")
