"""Catalogue: graph expansion, names, merging, communities, resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.catalog.iterative import sql_resolution, sql_sequential_labels
from engram.catalog.registry import query
from engram.catalog.tables import (
    SQL_CONTAINS, SQL_NAMES, SQL_PLACED, SQL_SUPPLIES, contains, name_facts, node_id, now, placed,
    sql_node_id, supplies, table,
)
from engram.models.offline import embed
from engram.operators import communities as C
from engram.operators import graph as G
from engram.operators import resolution as R
from engram.operators.scope import owner_key
from engram.schemas import NIL_UUID
from engram.session import checkpoint

SEED_SQL = (
    "SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY count(*) DESC, o_custkey LIMIT 1"
)


def _busiest(spark, sf_dir):
    """The customer with most orders, as a one-row seed table."""
    top = (
        table(spark, sf_dir, "orders").groupBy("o_custkey").count()
        .orderBy(F.desc("count"), "o_custkey").limit(1)
    )
    return top.select(
        F.col("o_custkey").alias("request_id"), node_id("customer", "o_custkey").alias("entity_id"),
        F.lit(None).cast("string").alias("viewer"),
    )


_TWO_HOP_SQL = f"""
WITH {SQL_PLACED}, {SQL_CONTAINS}, {SQL_NAMES},
seed AS (SELECT o_custkey, {sql_node_id('customer', 'o_custkey')} AS id FROM ({SEED_SQL})),
rels AS (SELECT id, source_id, target_id, rel_type FROM placed
         UNION ALL SELECT id, source_id, target_id, rel_type FROM contains_part),
hop1 AS (SELECT * FROM rels WHERE source_id IN (SELECT id FROM seed) OR target_id IN (SELECT id FROM seed)),
frontier AS (SELECT DISTINCT target_id AS id FROM hop1 WHERE target_id NOT IN (SELECT id FROM seed)),
hop2 AS (SELECT * FROM rels WHERE source_id IN (SELECT id FROM frontier) OR target_id IN (SELECT id FROM frontier)),
found AS (SELECT *, 1 AS hop FROM hop1 UNION ALL SELECT *, 2 AS hop FROM hop2),
shown AS (
  SELECT hop, rel_type,
    CASE WHEN source_id IN (SELECT id FROM seed) THEN 'user' ELSE coalesce(s.name, substr(source_id, 1, 8)) END AS source_name,
    CASE WHEN target_id IN (SELECT id FROM seed) THEN 'user' ELSE coalesce(t.name, substr(target_id, 1, 8)) END AS target_name
  FROM found LEFT JOIN names s ON s.entity_id = source_id LEFT JOIN names t ON t.entity_id = target_id)
SELECT (SELECT o_custkey FROM seed) AS request_id, source_name, rel_type, target_name, min(hop) AS hop,
       'Graph Relation: ' || source_name || ' is linked to ' || target_name || ' via ' || rel_type AS statement
FROM shown WHERE source_name <> target_name AND upper(rel_type) NOT IN ('HAS_NAME', 'NAME')
GROUP BY source_name, rel_type, target_name
"""


@query("graph_two_hop", _TWO_HOP_SQL)
def graph_two_hop(spark, sf_dir):
    """Statements within two hops of the busiest customer."""
    relations = placed(spark, sf_dir).unionByName(contains(spark, sf_dir))
    return G.graph_context(relations, name_facts(spark, sf_dir), _busiest(spark, sf_dir))


_OWNER_SQL = "CASE WHEN right(id, 1) < '4' THEN '' WHEN right(id, 1) < '7' THEN source_id ELSE 'someone' END"


@query("graph_two_hop_batch", f"""
WITH {SQL_PLACED}, {SQL_CONTAINS}, {SQL_NAMES},
given AS (SELECT id, source_id, target_id, rel_type FROM placed UNION ALL SELECT id, source_id, target_id, rel_type FROM contains_part
  UNION ALL SELECT 'NAMED:' || c_custkey, {sql_node_id('customer', 'c_custkey')}, c_name, 'has_name' FROM customer),
rels AS (SELECT *, {_OWNER_SQL} AS owner FROM given),
ends AS (SELECT *, source_id AS e FROM rels UNION SELECT *, target_id FROM rels),
hop1 AS (SELECT c_custkey, r.*, {sql_node_id('customer', 'c_custkey')} AS seed FROM customer JOIN ends r ON e = {sql_node_id('customer', 'c_custkey')} WHERE owner IN ('', e)),
frontier AS (SELECT DISTINCT c_custkey, seed, target_id FROM hop1 WHERE target_id <> seed),
hop2 AS (SELECT c_custkey, r.*, seed FROM frontier f JOIN ends r ON r.e = f.target_id WHERE owner IN ('', seed)),
found AS (SELECT *, 1 AS hop FROM hop1 UNION ALL SELECT *, 2 AS hop FROM hop2),
shown AS (
  SELECT c_custkey AS request_id, hop, rel_type, CASE WHEN source_id = seed THEN 'user' ELSE coalesce(s.name, substr(source_id, 1, 8)) END AS source_name,
    CASE WHEN target_id = seed THEN 'user' ELSE coalesce(t.name, substr(target_id, 1, 8)) END AS target_name
  FROM found LEFT JOIN names s ON s.entity_id = source_id LEFT JOIN names t ON t.entity_id = target_id)
SELECT request_id, source_name, rel_type, target_name, min(hop) AS hop,
       'Graph Relation: ' || source_name || ' is linked to ' || target_name || ' via ' || rel_type AS statement
FROM shown WHERE source_name <> target_name AND upper(rel_type) NOT IN ('HAS_NAME', 'NAME')
GROUP BY request_id, source_name, rel_type, target_name
""")
def graph_two_hop_batch(spark, sf_dir):
    """What every customer sees within two hops, among private, shared and foreign edges."""
    customers = table(spark, sf_dir, "customer")
    named = customers.select(
        F.concat(F.lit("NAMED:"), "c_custkey").alias("id"), node_id("customer", "c_custkey").alias("source_id"),
        F.col("c_name").alias("target_id"), F.lit("has_name").alias("rel_type"),
    )
    edges = placed(spark, sf_dir).unionByName(contains(spark, sf_dir)).unionByName(named, allowMissingColumns=True)
    last = F.substring("id", -1, 1)
    edges = edges.withColumn(
        "agent_owner", F.when(last < "4", "").when(last < "7", F.col("source_id")).otherwise("someone"))
    seeds = customers.select(
        F.col("c_custkey").alias("request_id"), node_id("customer", "c_custkey").alias("entity_id"),
        node_id("customer", "c_custkey").alias("viewer"),
    )
    return G.graph_context(edges, name_facts(spark, sf_dir), seeds)


@query("graph_two_hop_both", f"""
WITH {SQL_PLACED}, {SQL_CONTAINS},
seed AS (SELECT {sql_node_id('part', 'min(p_partkey)')} AS id FROM part),
rels AS (SELECT id, source_id, target_id FROM placed UNION ALL SELECT id, source_id, target_id FROM contains_part),
hop1 AS (SELECT * FROM rels WHERE source_id IN (SELECT id FROM seed) OR target_id IN (SELECT id FROM seed)),
frontier AS (SELECT source_id AS id FROM hop1 UNION SELECT target_id FROM hop1 EXCEPT SELECT id FROM seed),
hop2 AS (SELECT * FROM rels WHERE source_id IN (SELECT id FROM frontier) OR target_id IN (SELECT id FROM frontier))
SELECT id, source_id, target_id, min(hop) AS hop
FROM (SELECT *, 1 AS hop FROM hop1 UNION ALL SELECT *, 2 AS hop FROM hop2) GROUP BY ALL
""")
def graph_two_hop_both(spark, sf_dir):
    """Edges within two hops of a part, following both directions."""
    relations = placed(spark, sf_dir).unionByName(contains(spark, sf_dir))
    seed = table(spark, sf_dir, "part").agg(F.min("p_partkey").alias("k")).select(
        F.col("k").alias("request_id"), node_id("part", "k").alias("entity_id"),
        F.lit(None).cast("string").alias("viewer"),
    )
    found = G.expand_hops(relations, seed, 2, "both")
    return found.select("id", "source_id", "target_id", "hop")


@query("incident_relations", f"""
WITH {SQL_PLACED}, {SQL_CONTAINS},
seed AS (SELECT {sql_node_id('order', 'min(o_orderkey)')} AS id FROM orders),
rels AS (SELECT * FROM placed UNION ALL SELECT * FROM contains_part)
SELECT id, source_id, target_id, rel_type FROM rels
WHERE source_id IN (SELECT id FROM seed) OR target_id IN (SELECT id FROM seed)
""")
def incident_relations(spark, sf_dir):
    """Active edges at one order, in either direction."""
    relations = placed(spark, sf_dir).unionByName(contains(spark, sf_dir))
    first = table(spark, sf_dir, "orders").agg(F.min("o_orderkey").alias("k"))
    seed = first.select(node_id("order", "k").alias("s")).first()[0]
    return G.incident(relations, seed).select("id", "source_id", "target_id", "rel_type")


@query("entity_names_latest", """
SELECT CAST(user_id AS VARCHAR) AS entity_id, arg_max('user ' || CAST(value AS VARCHAR), (ts, event_id)) AS name
FROM (SELECT user_id, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS value, ts, event_id FROM events) GROUP BY user_id
""")
def entity_names_latest(spark, sf_dir):
    """Latest of the names each user went by."""
    facts = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("entity_id"),
        F.lit("name").alias("attribute"),
        F.concat(F.lit("user "), F.floor("value").cast("string")).alias("val"),
        F.col("ts").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_until"),
    )
    return G.entity_names(facts)


@query("entity_nodes", f"""
WITH {SQL_NAMES} SELECT entity_id, name FROM names
""")
def entity_nodes(spark, sf_dir):
    """Entities that carry an active name."""
    facts = name_facts(spark, sf_dir).withColumn("embedding", F.lit(None).cast("array<float>"))
    return G.entity_nodes(facts).select("entity_id", "name")


@query("relation_dedup", f"""
WITH lines AS (
  SELECT 'supplier-' || l_suppkey AS source_id, 'part-' || l_partkey AS target_id, l_linestatus,
         upper(trim(CASE l_returnflag WHEN 'R' THEN ' returned ' WHEN 'A' THEN 'Returned' ELSE 'supplies' END)) AS rel_type,
         CASE l_linenumber % 3 WHEN 0 THEN '{NIL_UUID}' WHEN 1 THEN 'owner-a' ELSE 'owner-b' END AS owner
  FROM lineitem),
cand AS (SELECT DISTINCT source_id, target_id, rel_type, owner FROM lines),
known AS (SELECT DISTINCT source_id, target_id, rel_type, owner FROM lines WHERE l_linestatus = 'F' AND rel_type = 'SUPPLIES')
SELECT * FROM cand c WHERE NOT EXISTS (
  SELECT 1 FROM known k WHERE k.source_id = c.source_id AND k.target_id = c.target_id AND k.rel_type = c.rel_type
    AND k.owner IN (c.owner, '{NIL_UUID}'))
""")
def relation_dedup(spark, sf_dir):
    """Extracted relations that their owner doesn't know yet."""
    kind = (
        F.when(F.col("l_returnflag") == "R", " returned ")
        .when(F.col("l_returnflag") == "A", "Returned").otherwise("supplies ")
    )
    third = F.pmod(F.col("l_linenumber"), F.lit(3))
    lines = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("supplier-"), "l_suppkey").alias("source_id"), F.concat(F.lit("part-"), "l_partkey").alias("target_id"),
        kind.alias("rel_type"), F.when(third == 0, "").when(third == 1, "owner-a").otherwise("owner-b").alias("agent_owner"),
        "l_linestatus", F.lit(None).cast("timestamp").alias("valid_until"),
    )
    known = lines.filter((F.col("l_linestatus") == "F") & (F.col("rel_type") == "supplies "))
    fresh = G.new_relations(lines.drop("l_linestatus", "valid_until"), known)
    return fresh.select("source_id", "target_id", "rel_type", owner_key(F.col("agent_owner")).alias("owner"))


_MERGE_SQL = f"""
merges AS (
  SELECT {sql_node_id('supplier', 's_suppkey')} AS duplicate_id, {sql_node_id('supplier', 's_suppkey % 10')} AS canonical_id
  FROM supplier WHERE s_suppkey >= 10),
old_names AS (
  SELECT {sql_node_id('name-supplier', 's_suppkey')} AS id, {sql_node_id('supplier', 's_suppkey')} AS entity_id,
         s_name AS val, TIMESTAMP '2024-01-01' + to_days(CAST(s_suppkey % 100 AS INTEGER)) AS valid_from FROM supplier)"""


def _supplier_merges(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier")
    return suppliers.filter(F.col("s_suppkey") >= 10).select(
        node_id("supplier", "s_suppkey").alias("duplicate_id"),
        node_id("supplier", F.col("s_suppkey") % 10).alias("canonical_id"),
    )


def _merged(spark, sf_dir):
    names = table(spark, sf_dir, "supplier").select(
        node_id("name-supplier", "s_suppkey").alias("id"),
        node_id("supplier", "s_suppkey").alias("entity_id"), F.lit("name").alias("attribute"),
        F.col("s_name").alias("val"),
        F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(cast(s_suppkey % 100 as int))").alias("valid_from"),
        F.lit(None).cast("timestamp").alias("valid_until"),
    )
    return G.merge_entities(names, supplies(spark, sf_dir), _supplier_merges(spark, sf_dir), now())


@query("merge_facts", f"""
WITH {_MERGE_SQL},
moved AS (SELECT id, coalesce(canonical_id, entity_id) AS entity_id, val, valid_from
          FROM old_names LEFT JOIN merges ON duplicate_id = entity_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY valid_from DESC, id) AS rn FROM moved)
SELECT id, entity_id, val, valid_from,
       CASE WHEN rn > 1 AND entity_id IN (SELECT canonical_id FROM merges) THEN TIMESTAMP '2024-03-15' END AS valid_until
FROM ranked
""")
def merge_facts(spark, sf_dir):
    """Name facts after merging suppliers: remapped, newest name open."""
    facts, _ = _merged(spark, sf_dir)
    return facts.select(
        "id", "entity_id", "val", F.col("valid_from").cast("timestamp_ntz").alias("valid_from"),
        F.col("valid_until").cast("timestamp_ntz").alias("valid_until"),
    )


@query("merge_remap", f"""
WITH {_MERGE_SQL}, {SQL_SUPPLIES}
SELECT id, coalesce(s.canonical_id, source_id) AS source_id, coalesce(t.canonical_id, target_id) AS target_id, rel_type
FROM supplies LEFT JOIN merges s ON s.duplicate_id = source_id LEFT JOIN merges t ON t.duplicate_id = target_id
""")
def merge_remap(spark, sf_dir):
    """Relations after merging suppliers; edge ids stay."""
    _, relations = _merged(spark, sf_dir)
    return relations.select("id", "source_id", "target_id", "rel_type")


def _lpa_sql(sweeps: int = 5) -> str:
    parts = [SQL_SUPPLIES, """
links AS (SELECT source_id AS node, target_id AS nbr FROM supplies
          UNION ALL SELECT target_id, source_id FROM supplies),
weights AS (SELECT node, nbr, count(*) AS weight FROM links GROUP BY ALL),
l0 AS (SELECT DISTINCT node AS id, node AS label FROM weights)"""]
    for i in range(sweeps):
        parts.append(f"""
v{i} AS (SELECT node, label, sum(weight) AS votes FROM weights JOIN l{i} ON id = nbr GROUP BY node, label),
l{i + 1} AS (SELECT node AS id, label FROM v{i}
             QUALIFY row_number() OVER (PARTITION BY node ORDER BY votes DESC, label) = 1)""")
    parts.append(f"""
nodes AS (SELECT {sql_node_id('supplier', 's_suppkey')} AS id FROM supplier
          UNION ALL SELECT {sql_node_id('part', 'p_partkey')} FROM part),
labels AS (SELECT * FROM l{sweeps} UNION ALL
           SELECT id, id FROM nodes WHERE id NOT IN (SELECT node FROM weights))""")
    return ",".join(parts)


def _labels(spark, sf_dir):
    nodes = table(spark, sf_dir, "supplier").select(node_id("supplier", "s_suppkey").alias("id")).unionByName(
        table(spark, sf_dir, "part").select(node_id("part", "p_partkey").alias("id"))
    )
    return checkpoint(C.label_propagation_sync(nodes, supplies(spark, sf_dir)))


@query("lpa_sync", f"WITH {_lpa_sql()} SELECT id, label FROM labels")
def lpa_sync(spark, sf_dir):
    """Label propagation over suppliers and parts, all nodes at once."""
    return _labels(spark, sf_dir)


@query("communities", f"""
WITH {_lpa_sql()}, {SQL_NAMES},
sizes AS (SELECT label AS community_id, count(*) AS size FROM labels GROUP BY label HAVING count(*) >= 2),
ranked AS (SELECT label, name, row_number() OVER (PARTITION BY label ORDER BY id) AS rn
           FROM labels LEFT JOIN names ON entity_id = id),
named AS (SELECT label, 'Community of ' || coalesce(max(name) FILTER (rn = 1), '')
                 || coalesce(' and ' || max(name) FILTER (rn = 2), '') AS community_name
          FROM ranked WHERE rn <= 2 GROUP BY label)
SELECT community_id, size, community_name FROM sizes JOIN named ON label = community_id
""")
def communities(spark, sf_dir):
    """Communities of two or more, named after their first members."""
    labels = _labels(spark, sf_dir)
    names = G.entity_names(name_facts(spark, sf_dir))
    return C.community_sizes(labels).join(C.community_names(labels, names), "community_id")


_LINES_SQL = f"""
WITH {_lpa_sql()}, {SQL_NAMES},
big AS (SELECT label FROM labels GROUP BY label HAVING count(*) >= 2),
members AS (SELECT label, id, name FROM labels LEFT JOIN names ON entity_id = id WHERE label IN (SELECT label FROM big)),
ends AS (SELECT s.name AS sn, t.name AS tn, t.label AS label, e.id, rel_type, source_id, target_id, s.label AS sl
         FROM supplies e JOIN members t ON t.id = target_id LEFT JOIN members s ON s.id = source_id)
SELECT label AS community_id, 1 AS section, id AS k1, '' AS k2, name AS line FROM members WHERE name IS NOT NULL
UNION ALL
SELECT label, 2, id, '001', '- Entity ''' || name || ''': name: ' || name FROM members WHERE name IS NOT NULL
UNION ALL
SELECT label, 3, target_id, id, '- ' || coalesce(sn, '') || ' -> ' || coalesce(tn, '') || ' (' || rel_type || ')' FROM ends
UNION ALL
SELECT label, 3, source_id, id, '- ' || coalesce(sn, '') || ' -> ' || coalesce(tn, '') || ' (' || rel_type || ')' FROM ends
WHERE sl = label AND source_id <> target_id
"""


@query("community_lines", _LINES_SQL)
def community_lines(spark, sf_dir):
    """Members, facts and inner relations of every community, line by line."""
    facts = name_facts(spark, sf_dir)
    return C.community_lines(
        _labels(spark, sf_dir), G.entity_names(facts), facts, supplies(spark, sf_dir)
    )


_JOINED_SQL = "coalesce(string_agg(line, {0} ORDER BY k1, k2, line) FILTER (section = {1}), '')"


@query("community_contexts", f"""
SELECT community_id, 'Members: ' || {_JOINED_SQL.format("', '", 1)} || chr(10) || chr(10) || 'Facts:' || chr(10)
  || {_JOINED_SQL.format("chr(10)", 2)} || chr(10) || chr(10) || 'Relations:' || chr(10) || {_JOINED_SQL.format("chr(10)", 3)} AS context
FROM ({_LINES_SQL}) GROUP BY community_id
""")
def community_contexts(spark, sf_dir):
    """Text of every community."""
    facts = name_facts(spark, sf_dir)
    lines = C.community_lines(
        _labels(spark, sf_dir), G.entity_names(facts), facts, supplies(spark, sf_dir)
    )
    return C.community_contexts(checkpoint(lines))


@query("reflection_relations", f"""
WITH {SQL_SUPPLIES}, {SQL_NAMES}
SELECT source_id AS entity_id, '00000000-0000-0000-0000-000000000000' AS owner,
  string_agg('- ' || coalesce(s.name, source_id) || ' -> ' || coalesce(t.name, target_id) || ' (' || rel_type || ')' || chr(10), '' ORDER BY e.id) AS relation_lines
FROM supplies e LEFT JOIN names s ON s.entity_id = source_id LEFT JOIN names t ON t.entity_id = target_id
WHERE source_id IN (SELECT {sql_node_id('supplier', 's_suppkey')} FROM supplier) GROUP BY source_id
""")
def reflection_relations(spark, sf_dir):
    """Relation lines each supplier reflects on."""
    from engram.operators.reflection import reflection_relations as lines_of
    from engram.schemas import NIL_UUID

    groups = table(spark, sf_dir, "supplier").select(
        node_id("supplier", "s_suppkey").alias("entity_id"), F.lit(NIL_UUID).alias("owner")
    )
    return lines_of(groups, supplies(spark, sf_dir), G.entity_names(name_facts(spark, sf_dir)))


@query("relation_entities", f"""
WITH {SQL_SUPPLIES} SELECT source_id AS id FROM supplies UNION SELECT target_id FROM supplies
""")
def relation_entities(spark, sf_dir):
    """Entities that storing relations brings into being, once each."""
    return G.relation_entities(supplies(spark, sf_dir))


# a customer and its orders are a part of the graph that no edge leaves
@query("lpa_exact", f"""
WITH RECURSIVE {SQL_PLACED}, {sql_sequential_labels(
    f"SELECT c_custkey AS part, {sql_node_id('customer', 'c_custkey')} AS id FROM customer "
    f"UNION ALL SELECT o_custkey, {sql_node_id('order', 'o_orderkey')} FROM orders",
    f"SELECT o_custkey AS part, id, source_id, target_id FROM placed JOIN orders ON target_id = {sql_node_id('order', 'o_orderkey')}")}
SELECT id, label FROM labels
""")
def lpa_exact(spark, sf_dir):
    """Sequential label propagation over customers and their orders."""
    nodes = table(spark, sf_dir, "customer").select(node_id("customer", "c_custkey").alias("id")).unionByName(
        table(spark, sf_dir, "orders").select(node_id("order", "o_orderkey").alias("id"))
    )
    return C.label_propagation(nodes, placed(spark, sf_dir))


@query("entity_resolution")
def entity_resolution(spark, sf_dir):
    """Merges among parts whose names match, by the embedded name."""
    nodes = table(spark, sf_dir, "part").select(
        node_id("part", "p_partkey").alias("entity_id"), F.col("p_name").alias("name"),
        embed(F.concat(F.lit("name: "), F.col("p_name"))).alias("embedding"),
    )
    # model output is written once
    return R.resolve_entities(checkpoint(nodes))


@query("entity_resolution_vectors", f"""
WITH RECURSIVE {sql_resolution(
    f"SELECT {sql_node_id('part', 'p_partkey')} AS id, p_name AS name, embedding AS v FROM part "
    "JOIN embeddings ON vec_id = p_partkey % (SELECT count(*) FROM embeddings)")}
SELECT duplicate_id, canonical_id FROM merges
""")
def entity_resolution_vectors(spark, sf_dir):
    """Merges among all parts by stored vectors, which are dealt to the parts in turn."""
    vectors = table(spark, sf_dir, "embeddings")
    total = vectors.count()
    nodes = table(spark, sf_dir, "part").withColumn("vec_id", F.col("p_partkey") % total)
    return R.resolve_entities(nodes.join(vectors, "vec_id").select(
        node_id("part", "p_partkey").alias("entity_id"), F.col("p_name").alias("name"), "embedding"))
