"""Memory tables derived from the supplied tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions.text import DNS_NAMESPACE_HEX, uuid3

NIL = "00000000-0000-0000-0000-000000000000"
EPOCH = "2024-03-15 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now() -> Column:
    """The fixed instant the catalogue queries are asked at."""
    return F.lit(EPOCH).cast("timestamp")


def key_id(prefix: str, key: str) -> Column:
    return uuid3(F.concat(F.lit(prefix), F.col(key).cast("string")))


def node_id(kind: str, key: str | Column) -> Column:
    """Id of a graph node: the key first, so that the short form tells nodes apart."""
    key = F.col(key) if isinstance(key, str) else key
    return F.concat(key.cast("string"), F.lit(f"-{kind}"))


def sql_node_id(kind: str, key: str) -> str:
    return f"(CAST({key} AS VARCHAR) || '-{kind}')"


def sql_uuid3(text: str) -> str:
    digest = f"md5(from_hex('{DNS_NAMESPACE_HEX}') || encode({text}))"
    return (
        f"(substr({digest},1,8)||'-'||substr({digest},9,4)||'-3'||substr({digest},14,3)||'-'"
        f"||translate(substr({digest},17,1),'0123456789abcdef','89ab89ab89ab89ab')"
        f"||substr({digest},18,3)||'-'||substr({digest},21,12))"
    )


def sql_key_id(prefix: str, key: str) -> str:
    return sql_uuid3(f"('{prefix}' || CAST({key} AS VARCHAR))")


def sql_trim(text: str) -> str:
    space = r"[\x09-\x0D\x20\x{85}\x{A0}\p{Z}]"
    return f"regexp_replace(regexp_replace({text}, '^{space}+', ''), '{space}+$', '')"


# -- facts out of events ------------------------------------------------------

def event_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fact per event: the user is the entity, the type the attribute.

    Values are banded so that they repeat; owners are null, blank or the user;
    every 50th stability step is pinned. All facts are open.
    """
    events = table(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    stamp = F.col("ts").cast("timestamp")
    return events.select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"),
        user.alias("entity_id"),
        F.col("event_type").alias("attribute"),
        F.floor(F.col("value") / 50).cast("string").alias("val"),
        (F.lit(0.5) + F.pmod(F.col("event_id"), F.lit(50)) / 100).alias("confidence_score"),
        stamp.alias("valid_from"),
        F.lit(None).cast("timestamp").alias("valid_until"),
        F.when(F.pmod(F.col("event_id"), F.lit(7)) == 0, "agent:admin")
        .otherwise("agent:logistics").alias("source_agent"),
        F.lit(1.0).alias("memory_strength"),
        F.when(F.pmod(F.col("event_id"), F.lit(50)) == 0, F.lit(-1.0))
        .otherwise((F.lit(20) + F.pmod(F.col("event_id"), F.lit(15))).cast("double"))
        .alias("stability"),
        stamp.alias("last_accessed"),
        F.when(F.pmod(F.col("event_id"), F.lit(3)) == 0, F.lit(None).cast("string"))
        .when(F.pmod(F.col("event_id"), F.lit(3)) == 1, "")
        .otherwise(user).alias("agent_owner"),
    )


SQL_FACTS = f"""
facts AS (
  SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS id,
         CAST(user_id AS VARCHAR) AS entity_id, event_type AS attribute,
         CAST(CAST(floor(value / 50) AS BIGINT) AS VARCHAR) AS val,
         0.5 + CAST(event_id % 50 AS DOUBLE) / 100 AS confidence_score,
         ts AS valid_from, CAST(NULL AS TIMESTAMP) AS valid_until,
         CASE WHEN event_id % 7 = 0 THEN 'agent:admin' ELSE 'agent:logistics' END AS source_agent,
         1.0 AS memory_strength,
         CASE WHEN event_id % 50 = 0 THEN -1.0 ELSE CAST(20 + event_id % 15 AS DOUBLE) END AS stability,
         ts AS last_accessed,
         CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE CAST(user_id AS VARCHAR) END AS agent_owner
  FROM events)"""


# -- relations out of orders and line items -----------------------------------

def _edges(rows: DataFrame, kind: str, source: Column, target: Column, keys: list[str]) -> DataFrame:
    return rows.select(
        F.concat_ws(":", F.lit(kind), *[F.col(k).cast("string") for k in keys]).alias("id"),
        source.alias("source_id"), target.alias("target_id"), F.lit(kind).alias("rel_type"),
        F.col("since").cast("timestamp").alias("valid_from"),
        F.lit(None).cast("timestamp").alias("valid_until"), F.lit("").alias("agent_owner"),
    )


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer -PLACED-> order"""
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderdate", "since")
    return _edges(
        orders, "PLACED", node_id("customer", "o_custkey"), node_id("order", "o_orderkey"),
        ["o_orderkey"],
    )


def _pairs(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(*keys).agg(F.min("l_shipdate").alias("since"))


def contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order -CONTAINS-> part, one edge per pair"""
    return _edges(
        _pairs(spark, sf_dir, "l_orderkey", "l_partkey"), "CONTAINS",
        node_id("order", "l_orderkey"), node_id("part", "l_partkey"), ["l_orderkey", "l_partkey"],
    )


def supplies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier -SUPPLIES-> part, one edge per pair"""
    return _edges(
        _pairs(spark, sf_dir, "l_suppkey", "l_partkey"), "SUPPLIES",
        node_id("supplier", "l_suppkey"), node_id("part", "l_partkey"), ["l_suppkey", "l_partkey"],
    )


def _sql_edges(name: str, kind: str, source: str, target: str, keys: list[str], rows: str) -> str:
    edge_id = " || ':' || ".join([f"'{kind}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"""
{name} AS (
  SELECT {edge_id} AS id, {source} AS source_id, {target} AS target_id, '{kind}' AS rel_type, since AS valid_from
  FROM ({rows}))"""


SQL_PLACED = _sql_edges(
    "placed", "PLACED", sql_node_id("customer", "o_custkey"), sql_node_id("order", "o_orderkey"),
    ["o_orderkey"], "SELECT *, o_orderdate AS since FROM orders",
)
SQL_CONTAINS = _sql_edges(
    "contains_part", "CONTAINS", sql_node_id("order", "l_orderkey"), sql_node_id("part", "l_partkey"),
    ["l_orderkey", "l_partkey"],
    "SELECT l_orderkey, l_partkey, min(l_shipdate) AS since FROM lineitem GROUP BY ALL",
)
SQL_SUPPLIES = _sql_edges(
    "supplies", "SUPPLIES", sql_node_id("supplier", "l_suppkey"), sql_node_id("part", "l_partkey"),
    ["l_suppkey", "l_partkey"],
    "SELECT l_suppkey, l_partkey, min(l_shipdate) AS since FROM lineitem GROUP BY ALL",
)


# -- names -------------------------------------------------------------------

def name_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name facts of customers, suppliers and parts; orders stay unnamed."""
    out = None
    for name, key, text in (
        ("customer", "c_custkey", "c_name"),
        ("supplier", "s_suppkey", "s_name"),
        ("part", "p_partkey", "p_name"),
    ):
        rows = table(spark, sf_dir, name).select(
            node_id(f"name-{name}", key).alias("id"), node_id(f"{name}", key).alias("entity_id"),
            F.lit("name").alias("attribute"), F.col(text).alias("val"),
            F.lit("2024-01-01 00:00:00").cast("timestamp").alias("valid_from"),
            F.lit(None).cast("timestamp").alias("valid_until"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


SQL_NAMES = "names AS (" + " UNION ALL ".join(
    f"SELECT {sql_node_id(f'{name}', key)} AS entity_id, {text} AS name FROM {name}"
    for name, key, text in (
        ("customer", "c_custkey", "c_name"),
        ("supplier", "s_suppkey", "s_name"),
        ("part", "p_partkey", "p_name"),
    )
) + ")"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"), "vec_id", "label", "embedding"
    )


def sql_cosine(a: str, b: str) -> str:
    return f"list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
