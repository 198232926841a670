"""Facts: search with decay, access effects, supersession, candidate checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram.config import DEFAULTS
from engram.functions.decay import reinforced_stability, retention, stability_or_default
from engram.functions.text import fact_text, is_singular, trim_space
from engram.operators.scope import active, owner_key, owner_visible
from engram.operators.search import post_filtered_top_k, top_k_per_query, top_k_per_vector
from engram.operators.skew import HOT_ROWS, join_back, maybe_among, ordered_shift, sliced
from engram.schemas import NIL_UUID
from engram.session import checkpoint

def newest_first() -> list[Column]:
    return [F.col("valid_from").desc(), F.col("id").asc()]


def newest_per_entity(facts: DataFrame, n: int, *more_keys: str) -> DataFrame:
    """The n newest facts per entity (and further keys), ranked 1..n in ``rn``."""
    window = W.partitionBy("entity_id", *more_keys).orderBy(*newest_first())
    return facts.withColumn("rn", F.row_number().over(window)).filter(F.col("rn") <= n)


def newest(facts: DataFrame, entity_id: str, n: int = 5, viewer: str | None = None) -> DataFrame:
    """Newest active facts of one entity."""
    return (
        facts.filter(
            (F.col("entity_id") == entity_id)
            & active()
            & owner_visible(F.col("agent_owner"), viewer)
        )
        .orderBy(*newest_first())
        .limit(n)
    )


def apply_decay(facts: DataFrame, now: Column, cutoff: float = DEFAULTS.retention_cutoff) -> DataFrame:
    """Set the strength of each fact to its retention and flag the forgotten ones."""
    stable = stability_or_default(F.coalesce("stability", F.lit(DEFAULTS.default_stability_days)))
    return facts.withColumn(
        "memory_strength", retention(stable, F.col("last_accessed"), now)
    ).withColumn("expired", F.col("memory_strength") < cutoff)


def remembered(facts: DataFrame, now: Column | None) -> DataFrame:
    """Facts not forgotten by ``now``; all of them without a time."""
    if now is None:
        return facts
    return apply_decay(facts, now).filter(~F.col("expired")).drop("expired")


def own_and_shared(facts: DataFrame) -> DataFrame:
    """Facts of an entity that it may see itself: its own and the shared ones."""
    return facts.filter(owner_visible(F.col("agent_owner"), F.col("entity_id")))


@dataclass(frozen=True)
class SearchResult:
    """Facts found, and the effects that reading them has."""

    facts: DataFrame
    effects: DataFrame


def access_effects(decayed: DataFrame, now: Column) -> DataFrame:
    """Survivors are reinforced, forgotten facts are deactivated."""
    return decayed.select(
        F.col("id").alias("fact_id"),
        F.when(F.col("expired"), "deactivate").otherwise("reinforce").alias("kind"),
        now.alias("at"),
    )


def search_hybrid(
    facts: DataFrame,
    now: Column,
    entity_id: str | None = None,
    viewer: str | None = None,
    vector: list[float] | None = None,
    limit: int = 5,
    pool: int = DEFAULTS.ann_pool,
) -> SearchResult:
    """Find active facts by recency, or by vector among the nearest ``pool``.

    The limit comes before decay, so a forgotten fact takes a place without
    being returned. With a vector the pool is drawn before any filter.
    """
    if vector is None:
        found = newest(facts, entity_id, limit, viewer)
    else:
        keep = active() & owner_visible(F.col("agent_owner"), viewer)
        if entity_id is not None:
            keep = keep & (F.col("entity_id") == entity_id)
        found = post_filtered_top_k(facts, vector, keep, limit, pool)
    decayed = apply_decay(found, now)
    return SearchResult(decayed.filter(~F.col("expired")).drop("expired"), access_effects(decayed, now))


def _vector_queries(requests: DataFrame) -> DataFrame:
    return requests.filter(F.col("embedding").isNotNull()).select(F.col("request_id").alias("query_id"), "embedding")


def nearest_facts(facts: DataFrame, requests: DataFrame, pool: int = DEFAULTS.ann_pool) -> DataFrame:
    """The ``pool`` nearest facts of each request that has a vector: request_id, id, score."""
    found = top_k_per_query(facts, _vector_queries(requests), pool)
    return found.select(F.col("query_id").alias("request_id"), "id", "score")


def search_hybrid_batch(
    facts: DataFrame,
    requests: DataFrame,
    now: Column,
    limit: int = 5,
    nearest: DataFrame | None = None,
) -> SearchResult:
    """``search_hybrid`` for many requests.

    ``requests``: request_id, entity_id, viewer, embedding (null without one);
    ``nearest``: the pools of ``nearest_facts`` where already drawn. The result
    carries request_id and a rank ``rn``.
    """
    plain = requests.filter(F.col("embedding").isNull())
    by_time = _newest_per_request(facts, plain, limit).withColumn(
        "_score", F.lit(None).cast("double")
    )
    wanted = requests.select("request_id", F.col("entity_id").alias("_entity"), "viewer")
    visible = active() & (
        F.col("viewer").isNull() | owner_visible(F.col("agent_owner"), F.col("viewer"))
    )
    if nearest is None:
        met = _pools_of_entities(facts, requests, wanted)
    else:
        met = facts.join(nearest.withColumnRenamed("score", "_score"), "id").join(wanted, "request_id")
    by_vector = met.filter(visible & (F.col("entity_id") == F.col("_entity"))).drop("_entity", "viewer")
    order = W.partitionBy("request_id").orderBy(
        F.col("_score").desc_nulls_last(),
        F.when(F.col("_score").isNull(), F.col("valid_from")).desc_nulls_last(),
        F.col("id").asc(),
    )
    ranked = (
        by_time.unionByName(by_vector)
        .withColumn("rn", F.row_number().over(order))
        .filter(F.col("rn") <= limit)
    )
    decayed = apply_decay(ranked, now)
    return SearchResult(
        decayed.filter(~F.col("expired")).drop("expired", "_score"), access_effects(decayed, now)
    )


def _pools_of_entities(facts: DataFrame, requests: DataFrame, wanted: DataFrame) -> DataFrame:
    """The facts of the asked entities in the pools of ``nearest_facts``.

    Requests of equal vectors share a pool, which meets its facts once; requests come to it by their entity.
    """
    asked, pools = top_k_per_vector(facts, _vector_queries(requests), DEFAULTS.ann_pool)
    pools = checkpoint(pools.select("_want", F.col("id").alias("_id"), F.col("score").alias("_score")))
    inside = maybe_among(facts, F.col("id").cast("string"), pools.select("_id")).join(pools, F.col("id") == F.col("_id")).drop("_id")
    whose = asked.select(F.col("query_id").alias("request_id"), F.col("_want").alias("_of")).join(wanted, "request_id")
    same = (F.col("_want") == F.col("_of")) & (F.col("entity_id") == F.col("_entity"))
    return inside.join(whose, same).drop("_want", "_of")


def _newest_per_request(facts: DataFrame, requests: DataFrame, limit: int) -> DataFrame:
    """Newest visible facts of the asked entity.

    Facts are cut to ``limit`` per entity and owner before they meet a request,
    so a request joins at most two such groups however many facts there are.
    """
    owned = facts.filter(active()).withColumn("_owner", owner_key(F.col("agent_owner")))
    scoped = requests.filter(F.col("viewer").isNotNull()).select(
        "request_id",
        "entity_id",
        F.explode(F.array_distinct(F.array(F.col("viewer"), F.lit(NIL_UUID)))).alias("_owner"),
    )
    own = newest_per_entity(owned, limit, "_owner").drop("rn")
    seen = join_back(scoped, own, ["entity_id", "_owner"], salt_on=["request_id"])
    unscoped = requests.filter(F.col("viewer").isNull()).select("request_id", "entity_id")
    newest_any = newest_per_entity(owned, limit).drop("rn")
    everything = join_back(unscoped, newest_any, ["entity_id"], salt_on=["request_id"])
    return seen.unionByName(everything).drop("_owner")


def with_insert_defaults(facts: DataFrame, now: Column, owner: Column | None = None) -> DataFrame:
    """Fill in what an inserted fact may leave open."""
    out = facts.withColumn(
        "memory_strength",
        F.when(F.col("memory_strength") > 0, F.col("memory_strength")).otherwise(F.lit(1.0)),
    )
    out = out.withColumn("stability", stability_or_default(F.col("stability")))
    out = out.withColumn("last_accessed", F.coalesce("last_accessed", now))
    context = F.lit(None).cast("string") if owner is None else owner
    return out.withColumn("agent_owner", F.coalesce(F.col("agent_owner"), context, F.lit("")))


def deactivate(facts: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Close the listed facts that are still active. ``ids``: column id."""
    marked = ids.select("id").distinct().withColumn("_close", F.lit(True))
    return (
        facts.join(marked, "id", "left")
        .withColumn(
            "valid_until",
            F.when(F.col("_close") & active(), now).otherwise(F.col("valid_until")),
        )
        .drop("_close")
    )


def reinforce(facts: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Strengthen the listed facts once. ``ids``: column id."""
    marked = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    hit = F.coalesce("_hit", F.lit(False))
    return (
        facts.join(marked, "id", "left")
        .withColumn("last_accessed", F.when(hit, now).otherwise(F.col("last_accessed")))
        .withColumn("memory_strength", F.when(hit, 1.0).otherwise(F.col("memory_strength")))
        .withColumn(
            "stability",
            F.when(hit, reinforced_stability(F.col("stability"))).otherwise(F.col("stability")),
        )
        .drop("_hit")
    )


def apply_effects(facts: DataFrame, effects: DataFrame) -> DataFrame:
    """Current facts from the base rows and the append-only effect log.

    All effects commute (earliest close, latest access, number of accesses), so
    the log reduces with map-side aggregation before it meets the facts.
    """
    closing = F.col("kind") == "deactivate"
    reduced = effects.groupBy(F.col("fact_id").alias("id")).agg(
        F.min(F.when(closing, F.col("at"))).alias("_closed"),
        F.max(F.when(~closing, F.col("at"))).alias("_read"),
        F.count(F.when(~closing, 1)).alias("_reads"),
    )
    reads = F.coalesce("_reads", F.lit(0))
    return (
        facts.join(reduced, "id", "left")
        .withColumn("valid_until", F.coalesce("valid_until", "_closed"))
        .withColumn("last_accessed", F.coalesce("_read", "last_accessed"))
        .withColumn("memory_strength", F.when(reads > 0, 1.0).otherwise(F.col("memory_strength")))
        .withColumn("stability", reinforced_stability(F.col("stability"), reads))
        .drop("_closed", "_read", "_reads")
    )


def version_history(facts: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Supersession over the whole history of each entity and attribute.

    A value equal to the one before it is skipped. For a singular attribute a
    new value closes the previous one; other attributes keep all values open.
    ``facts``: id, entity_id, attribute, val, valid_from.
    """
    keys, order = ["entity_id", "attribute"], ["valid_from", "id"]
    rows = sliced(facts.select("id", *keys, "val", "valid_from"), keys, order, hot_rows)
    rows = ordered_shift(rows, keys, order, "val", "_before")
    kept = rows.filter(~F.col("val").eqNullSafe(F.col("_before")) | F.col("_before").isNull())
    kept = ordered_shift(kept, keys, order, "valid_from", "_after", ahead=True)
    closes = F.when(is_singular(F.col("attribute")), F.col("_after"))
    return kept.withColumn("valid_until", closes).drop("_before", "_after", "_slice")


def oldest_active(facts: DataFrame, now: Column | None = None) -> DataFrame:
    """The active value a new candidate is compared with: the oldest one not forgotten.

    With ``now``, only facts count that the entity may see itself.
    """
    position = F.struct("valid_from", "id")
    facts = facts if now is None else own_and_shared(facts)
    return (
        remembered(facts.filter(active()), now)
        .groupBy("entity_id", "attribute")
        .agg(F.min_by(F.struct("id", "val"), position).alias("_old"))
        .select("entity_id", "attribute", F.col("_old.id").alias("old_id"), F.col("_old.val").alias("old_val"))
    )


def classify_candidates(
    candidates: DataFrame, facts: DataFrame, hot_rows: int = HOT_ROWS, now: Column | None = None
) -> DataFrame:
    """Mark each candidate skip, supersede, coexist or insert.

    ``candidates``: entity_id, attribute, val and whatever else they carry.
    """
    joined = join_back(
        candidates, oldest_active(facts, now), ["entity_id", "attribute"], "left", hot_rows=hot_rows
    )
    action = (
        F.when(F.col("old_id").isNull(), "insert")
        .when(F.col("old_val") == F.col("val"), "skip")
        .when(is_singular(F.col("attribute")), "supersede")
        .otherwise("coexist")
    )
    return joined.withColumn("action", action)


def contradicted(
    facts: DataFrame, candidates: DataFrame, hot_rows: int = HOT_ROWS, now: Column | None = None
) -> DataFrame:
    """Active facts some candidate gives another value for (singular attributes).

    Facts forgotten by ``now`` are left as they are.

    Per entity and attribute only the least and the greatest candidate value
    are needed: a fact differs from some candidate iff it differs from one of
    these two. No fact-candidate pairs are formed.
    """
    bounds = (
        candidates.filter(is_singular(F.col("attribute")))
        .groupBy("entity_id", "attribute")
        .agg(F.min("val").alias("_lo"), F.max("val").alias("_hi"))
    )
    return (
        join_back(
            remembered(facts.filter(active()), now), bounds, ["entity_id", "attribute"], salt_on=["id"], hot_rows=hot_rows
        )
        .filter((F.col("val") != F.col("_lo")) | (F.col("val") != F.col("_hi")))
        .drop("_lo", "_hi")
    )


def match_conflicts(
    verdicts: DataFrame, facts: DataFrame, n: int = DEFAULTS.active_facts, hot_rows: int = HOT_ROWS,
    now: Column | None = None,
) -> DataFrame:
    """Find the active fact a conflict verdict speaks of.

    With ``now``, facts the entity may not see itself are left out before the
    limit, and forgotten ones after it.

    ``verdicts``: verdict_id, entity_id, conflicting_fact, reason. The facts of
    an entity are its ``n`` newest, held in one bounded array; the best match is
    taken inside the row. Order of preference: same text, same value, one text
    inside the other, value inside the verdict, attribute named by the verdict;
    then the smaller fact id. A blank verdict matches only through the reason.
    """
    value = F.lower(trim_space(F.col("val")))
    text = F.lower(trim_space(fact_text(F.col("attribute"), F.col("val"))))
    listed = (
        remembered(newest_per_entity((facts if now is None else own_and_shared(facts)).filter(active()), n), now)
        .select("entity_id", "id", text.alias("text"), value.alias("value"), F.lower("attribute").alias("name"))
        .groupBy("entity_id")
        .agg(F.collect_list(F.struct("id", "text", "value", "name")).alias("_facts"))
    )
    asked = verdicts.withColumn(
        "_said", F.lower(trim_space(F.coalesce("conflicting_fact", F.lit(""))))
    ).withColumn("_reason", F.lower(F.coalesce("reason", F.lit(""))))
    joined = join_back(
        asked, listed, ["entity_id"], how="left", salt_on=["verdict_id"], hot_rows=hot_rows
    )
    said, reason = F.col("_said"), F.col("_reason")

    def scored(fact: Column) -> Column:
        level = (
            F.when((said != "") & (fact["text"] == said), 1)
            .when((said != "") & (fact["value"] == said), 2)
            .when((said != "") & (fact["text"].contains(said) | said.contains(fact["text"])), 3)
            .when((said != "") & said.contains(fact["value"]), 4)
            .when(said.contains(fact["name"]) | reason.contains(fact["name"]), 5)
        )
        return F.struct(level.alias("level"), fact["id"].alias("id"))

    best = F.array_min(F.filter(F.transform("_facts", scored), lambda s: s["level"].isNotNull()))
    return joined.withColumn("_best", best).select(
        *verdicts.columns,
        F.col("_best.id").alias("matched_id"),
        F.col("_best.level").alias("matched_level"),
    )


def close_extra_names(facts: DataFrame, entity_ids: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keep only the newest active name of the listed entities open; the others close at ``at``.

    ``entity_ids``: entity_id, at, one row per entity.
    """
    is_name = (F.col("attribute") == "name") & active()
    newest_name = (
        facts.filter(is_name)
        .join(entity_ids.select("entity_id", F.col("at").alias("_at")), "entity_id")
        .groupBy("entity_id")
        .agg(F.min(F.struct(-F.unix_micros("valid_from"), F.col("id"))).alias("_top"), F.max("_at").alias("_at"))
        .select("entity_id", F.col("_top.id").alias("_keep"), "_at")
    )
    joined = join_back(
        facts, newest_name, ["entity_id"], how="left", salt_on=["id"], hot_rows=hot_rows
    )
    closes = is_name & F.col("_keep").isNotNull() & (F.col("id") != F.col("_keep"))
    return joined.withColumn(
        "valid_until", F.when(closes, F.col("_at")).otherwise(F.col("valid_until"))
    ).drop("_keep", "_at")
