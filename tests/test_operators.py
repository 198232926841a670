"""Operators against brute force, including their paths for hot keys."""

import math
import random
import uuid
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from engram.functions import vectors as V
from engram.operators import communities as C
from engram.operators import facts as O
from engram.operators import graph as G
from engram.operators import resolution as R
from engram.operators import search as S
from engram.operators.graph import expand_hops, merge_entities
from engram.operators.reflection import reflection_facts
from engram.operators.components import connected_components
from engram.operators.skew import hot_keys, join_back, joined_lines, ordered_shift, sliced
from engram.schemas import NIL_UUID


def at(text):
    return F.lit(text).cast("timestamp")


# -- skew --------------------------------------------------------------------

def skewed(spark, n=3000, hot=1000):
    rows = [("hot" if i < hot else f"k{i % 400}", i, i * 7 % 11) for i in range(n)]
    return spark.createDataFrame(rows, "k string, i int, v int")


def test_hot_keys_and_join_back(spark):
    rows = skewed(spark)
    assert hot_keys(rows, ["k"], 500).count() == 1
    sums = rows.groupBy("k").agg(F.sum("v").alias("s"))
    plain = {(r.k, r.i, r.s) for r in rows.join(sums, "k").collect()}
    salted = join_back(rows, sums, ["k"], hot_rows=500)
    assert {(r.k, r.i, r.s) for r in salted.collect()} == plain
    assert salted.count() == rows.count()
    assert join_back(rows.limit(0), sums, ["k"]).count() == 0
    some = sums.filter("k != 'hot' and k != 'k7'")
    left = join_back(rows, some, ["k"], "left", ["i"], 500)
    assert left.filter("s is null").count() == rows.filter("k in ('hot', 'k7')").count()


@pytest.mark.parametrize("ahead", [False, True])
def test_ordered_shift_over_slices(spark, ahead):
    rows = skewed(spark).withColumn("t", F.col("i") % 3)  # heavy ties on the first order column
    plain = ordered_shift(rows, ["k"], ["t", "i"], "v", "x", ahead)
    cut = sliced(rows, ["k"], ["t", "i"], hot_rows=500, slices=16)
    assert cut.filter("k = 'hot'").select("_slice").distinct().count() > 3
    split = ordered_shift(cut, ["k"], ["t", "i"], "v", "x", ahead).drop("_slice")
    assert sorted(map(str, split.select("k", "i", "x").collect())) == sorted(
        map(str, plain.select("k", "i", "x").collect())
    )


def test_slices_follow_from_the_row(spark):
    """A task that runs again over rows dealt otherwise gives each row its slice again."""
    rows = skewed(spark).withColumn("t", F.when(F.col("i") % 7 > 0, F.col("i") % 3))
    cuts = [
        {(r.k, r.i): r._slice for r in sliced(rows.repartition(n), ["k"], ["t", "i"], hot_rows=500, slices=16).collect()}
        for n in (3, 11)
    ]
    assert cuts[0] == cuts[1] and len(cuts[0]) == rows.count()
    hot = sorted(((r.t is not None, r.t or 0, r.i), cuts[0][r.k, r.i]) for r in rows.filter("k = 'hot'").collect())
    assert [s for _, s in hot] == sorted(s for _, s in hot)


def test_joined_lines(spark):
    rows = spark.range(1200).select(
        F.when(F.col("id") < 1100, "hot").otherwise("cold").alias("k"), F.col("id").alias("i"),
        F.concat(F.lit("l"), F.col("id").cast("string"), F.lit(";")).alias("line")).repartition(5)
    texts = {r.k: r.t for r in joined_lines(rows, ["k"], ["i"], "line", "t").collect()}
    assert texts == {"hot": "".join(f"l{i};" for i in range(1100)), "cold": "".join(f"l{i};" for i in range(1100, 1200))}


# -- facts -------------------------------------------------------------------

def model_history(rows):
    out = {}
    groups = {}
    for row in sorted(rows, key=lambda r: (r[1], r[2], r[4], r[0])):
        groups.setdefault((row[1], row[2]), []).append(row)
    for group in groups.values():
        kept = [r for i, r in enumerate(group) if i == 0 or group[i - 1][3] != r[3]]
        for now, after in zip(kept, [*kept[1:], None]):
            closes = after is not None and not now[2].startswith("hobb")
            out[now[0]] = after[4] if closes else None
    return out


@pytest.mark.parametrize("hot_rows", [10**9, 50])
def test_version_history(spark, hot_rows):
    rng = random.Random(5)
    rows = [
        (f"f{i:04d}", rng.choice(["e1", "e1", "e2", "e3"]), rng.choice(["city", "hobby"]),
         rng.choice("ab"), rng.randrange(40)) for i in range(600)
    ]
    frame = spark.createDataFrame(rows, "id string, entity_id string, attribute string, val string, t int")
    frame = frame.withColumn("valid_from", F.timestamp_seconds("t"))
    got = O.version_history(frame, hot_rows).select("id", F.unix_seconds("valid_until").alias("u")).collect()
    assert {r.id: r.u for r in got} == model_history(rows)


def test_decay_and_pins(spark):
    facts = spark.createDataFrame(
        [("a", 30.0), ("b", -1.0), ("c", 0.0), ("d", None)], "id string, stability double"
    ).withColumn("last_accessed", at("2024-01-01 00:00:00"))
    got = {r.id: (round(r.memory_strength, 6), r.expired) for r in O.apply_decay(facts, at("2024-01-31 00:00:00")).collect()}
    e = round(math.exp(-1), 6)
    assert got == {"a": (e, False), "b": (1.0, False), "c": (e, False), "d": (e, False)}
    late = {r.id: r.expired for r in O.apply_decay(facts, at("2024-03-12 00:00:00")).collect()}
    assert late == {"a": True, "b": False, "c": True, "d": True}


def test_limit_comes_before_decay(spark):
    rows = [(f"f{i}", i) for i in range(6)]
    facts = spark.createDataFrame(rows, "id string, i int").select(
        "id", F.lit("e").alias("entity_id"), F.timestamp_seconds("i").alias("valid_from"),
        F.lit(None).cast("timestamp").alias("valid_until"), F.lit("").alias("agent_owner"),
        F.lit(30.0).alias("stability"),
        F.when(F.col("i") >= 4, at("2000-01-01 00:00:00")).otherwise(at("2024-01-01 00:00:00")).alias("last_accessed"),
    )
    found = O.search_hybrid(facts, at("2024-01-02 00:00:00"), "e", limit=3)
    assert [r.id for r in found.facts.collect()] == ["f3"]
    assert {(r.fact_id, r.kind) for r in found.effects.collect()} == {
        ("f5", "deactivate"), ("f4", "deactivate"), ("f3", "reinforce")}


def test_search_batch_equals_single(spark):
    rng = np.random.default_rng(3)
    rows = [
        (f"f{i:03d}", f"e{i % 4}", [float(x) for x in rng.normal(size=5)], ["", "v1", "v2"][i % 3], int(i * 37 % 90))
        for i in range(240)
    ]
    facts = spark.createDataFrame(rows, "id string, entity_id string, embedding array<float>, agent_owner string, d int").select(
        "id", "entity_id", "embedding", "agent_owner", F.timestamp_seconds(F.col("d") * 86400).alias("valid_from"),
        F.lit(None).cast("timestamp").alias("valid_until"), F.lit(30.0).alias("stability"),
        F.timestamp_seconds(F.col("d") * 86400).alias("last_accessed"),
    ).cache()
    now = F.timestamp_seconds(F.lit(100 * 86400))
    asked = [("r1", "e1", "v1", None), ("r2", "e2", None, None),
             ("r3", "e1", "v2", [1.0, 0.0, 0.0, 0.0, 0.0]), ("r4", "e0", "v1", [0.0, 1.0, 1.0, 0.0, 0.0])]
    requests = spark.createDataFrame(asked, "request_id string, entity_id string, viewer string, embedding array<float>")
    batch = O.search_hybrid_batch(facts, requests, now, 5)
    got = {}
    for r in batch.facts.collect():
        got.setdefault(r.request_id, set()).add(r.id)
    effects = {(r.fact_id, r.kind) for r in batch.effects.collect()}
    want_effects = set()
    for request_id, entity, viewer, vector in asked:
        one = O.search_hybrid(facts, now, entity, viewer, vector, 5)
        assert got.get(request_id, set()) == {r.id for r in one.facts.collect()}
        want_effects |= {(r.fact_id, r.kind) for r in one.effects.collect()}
    assert effects == want_effects


def test_contradicted_and_conflict_priority(spark):
    facts = spark.createDataFrame(
        [("f1", "e", "city", "Oslo"), ("f2", "e", "city", "Rome"), ("f3", "e", "hobby", "chess"), ("f4", "e", "job", "cook in Rome")],
        "id string, entity_id string, attribute string, val string",
    ).withColumn("valid_from", at("2024-01-01 00:00:00")).withColumn("valid_until", F.lit(None).cast("timestamp"))
    cand = spark.createDataFrame([("e", "city", "Oslo"), ("e", "hobby", "golf")], "entity_id string, attribute string, val string")
    assert [r.id for r in O.contradicted(facts, cand).collect()] == ["f2"]
    verdicts = spark.createDataFrame(
        [(1, "e", " CITY: Rome ", ""), (2, "e", "rome", ""), (3, "e", "in rome", ""), (4, "e", "", "the job"), (5, "e", "", ""), (6, "x", "city", "")],
        "verdict_id int, entity_id string, conflicting_fact string, reason string",
    )
    got = {r.verdict_id: r.matched_id for r in O.match_conflicts(verdicts, facts).collect()}
    assert got == {1: "f2", 2: "f2", 3: "f4", 4: "f4", 5: None, 6: None}


# -- vectors -----------------------------------------------------------------

def test_cosine_rules(spark):
    rows = [([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0]), ([], []), (None, [1.0])]
    frame = spark.createDataFrame(rows, "a array<float>, b array<float>")
    got = [r.c for r in frame.select(V.cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert abs(got[0] - 2 ** -0.5) < 1e-12 and got[1:] == [0.0, None, None, None]


def test_top_k_per_query_blocks_ties_and_sizes(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 6)).astype("float32")
    base[50:150] = base[0]  # a third of all rows are copies
    rows = [(f"v{i:03d}", [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [("odd", [1.0, 2.0]), ("none", None), ("empty", [])]
    vectors = spark.createDataFrame(rows, "id string, embedding array<float>").repartition(7)
    asked = [(f"q{i}", [float(x) for x in base[i * 40]]) for i in range(6)] + [("q9", [2.0, 1.0])]
    queries = spark.createDataFrame(asked, "query_id string, embedding array<float>")
    got = {}
    for r in S.top_k_per_query(vectors, queries, 7, block=2).collect():
        got.setdefault(r.query_id, {})[r.rn] = r.id
    for query_id, vector in asked:
        one = [r.id for r in S.top_k(vectors, vector, 7).collect()]
        assert [got[query_id][k] for k in sorted(got[query_id])] == one


def test_cache_lookup_with_hot_owner(spark):
    rng = np.random.default_rng(2)
    make = lambda: [float(x) for x in rng.normal(size=3)]
    cache_rows = [("a" if i % 3 else "b", i, f"r{i}", make()) for i in range(90)] + [("a", 200, "short", [1.0])]
    query_rows = [(i, "a" if i % 4 else "b", make()) for i in range(80)] + [(99, "zz", make())]
    cache = spark.createDataFrame(cache_rows, "owner string, seq long, response string, embedding array<float>")
    queries = spark.createDataFrame(query_rows, "query_id int, owner string, embedding array<float>")
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    want = {}
    for q, owner, vector in query_rows:
        held = sorted((e for e in cache_rows if e[0] == owner), key=lambda e: -e[1])[:20]
        scored = [(round(cos(e[3], vector), 9), -e[1], e[2]) for e in held if len(e[3]) == 3]
        if scored and max(scored)[0] >= 0.9:
            want[q] = max(scored)[2]
    got = S.cache_lookup(cache, queries, 0.9, 20, hot_rows=30).collect()
    assert {r.query_id: r.response for r in got} == want


# -- graph -------------------------------------------------------------------

def random_graph(seed, n=40, m=70, unnamed=6):
    rng = random.Random(seed)
    ids = [str(uuid.UUID(int=rng.getrandbits(128))) for _ in range(n)]
    named = sorted(ids[unnamed:])
    edges = [(f"r{i:03d}", rng.choice(ids), rng.choice(ids)) for i in range(m)]
    return ids, named, edges


def relation_frame(spark, edges):
    return spark.createDataFrame(edges, "id string, source_id string, target_id string").select(
        "*", F.lit("T").alias("rel_type"), F.lit(None).cast("timestamp").alias("valid_until"), F.lit("").alias("agent_owner")
    )


def model_lpa(named, edges, sweeps=5):
    adjacent = {}
    for node in named:
        for _, s, t in sorted(e for e in edges if node in e[1:]):
            adjacent.setdefault(s, []).append(t)
            adjacent.setdefault(t, []).append(s)
    labels = {n: n for n in named}
    for _ in range(sweeps):
        changed = False
        for node in named:
            counts, best, most = Counter(), None, 0
            for other in adjacent.get(node, []):
                label = labels.get(other, NIL_UUID)
                counts[label] += 1
                if counts[label] > most:
                    most, best = counts[label], label
            if best is not None and labels[node] != best:
                labels[node], changed = best, True
        if not changed:
            break
    return labels


@pytest.mark.parametrize("seed,hot_rows,whole", [
    (1, 10**9, C.WHOLE_LINKS), (2, 10**9, 5), (3, 5, 5), (3, 5, C.WHOLE_LINKS)])
def test_sequential_label_propagation(spark, seed, hot_rows, whole):
    _, named, edges = random_graph(seed, n=24, m=30 + 4 * seed)
    nodes = spark.createDataFrame([(n,) for n in named], "id string")
    got = C.label_propagation(nodes, relation_frame(spark, edges), hot_rows=hot_rows, whole=whole)
    assert {r.id: r.label for r in got.collect()} == model_lpa(named, edges)


def test_sequential_labels_of_a_long_path(spark):
    named = [f"n{i:04d}" for i in range(400)]
    edges = [(f"r{i:04d}", named[i], named[i + 1]) for i in range(len(named) - 1) if i % 150 != 149]
    nodes = spark.createDataFrame([(n,) for n in named], "id string")
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    got = C.label_propagation(nodes, relation_frame(spark, edges)).collect()
    assert {r.id: r.label for r in got} == model_lpa(named, edges)
    # one wave per node of the path would take several hundred
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - len(before) < 250


@pytest.mark.parametrize("hot_rows", [10**9, 1500])
def test_connected_components(spark, hot_rows):
    rng = random.Random(hot_rows)
    edges = [(i, i + 1) for i in range(0, 300) if i % 70] + [(1000, 1001 + i) for i in range(2000)]
    edges += [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)] + [(5, 5), (7, None), (8, 7), (8, 7)]
    least = {n: n for e in edges if None not in e and e[0] != e[1] for n in e}
    while True:
        old = dict(least)
        for a, b in edges:
            if a in least and b in least:
                least[a] = least[b] = min(least[a], least[b])
        if old == least:
            break
    frame = spark.createDataFrame(edges, "x long, y long")
    got = connected_components(frame, "x", "y", hot_rows)
    assert {(r.id, r.component) for r in got.collect()} == set(least.items()) and got.count() == len(least)
    assert connected_components(frame.limit(0), "x", "y").count() == 0


def test_sync_label_propagation(spark):
    ids, named, edges = random_graph(7)
    adjacent = {}
    for _, s, t in edges:
        if s != t and s in named and t in named:
            adjacent.setdefault(s, []).append(t)
            adjacent.setdefault(t, []).append(s)
    labels = {n: n for n in named}
    for _ in range(5):
        def vote(node):
            counts = Counter(labels[o] for o in adjacent.get(node, [])) or Counter([labels[node]])
            return min(counts, key=lambda label: (-counts[label], label))
        labels = {n: vote(n) for n in named}
    nodes = spark.createDataFrame([(n,) for n in named], "id string")
    for hot_rows in (10**9, 3):
        got = C.label_propagation_sync(nodes, relation_frame(spark, edges), hot_rows=hot_rows)
        assert {r.id: r.label for r in got.collect()} == labels


def test_expand_hops_scope_and_loops(spark):
    edges = [("e1", "s", "a"), ("e2", "b", "s"), ("e3", "a", "c"), ("e4", "b", "d"), ("e5", "s", "s"), ("e6", "c", "x")]
    relations = relation_frame(spark, edges).withColumn(
        "agent_owner", F.when(F.col("id") == "e3", "other").otherwise("")
    )
    seeds = spark.createDataFrame([("q1", "s", None), ("q2", "s", "me")], "request_id string, entity_id string, viewer string")
    got = {}
    for r in expand_hops(relations, seeds).collect():
        got.setdefault(r.request_id, {})[r.id] = r.hop
    assert got == {"q1": {"e1": 1, "e2": 1, "e5": 1, "e3": 2}, "q2": {"e1": 1, "e2": 1, "e5": 1}}
    wide = expand_hops(relations, seeds.filter("request_id = 'q1'"), 3, "both").collect()
    assert {r.id for r in wide} == {"e1", "e2", "e3", "e4", "e5", "e6"}


def test_merge_leaves_no_duplicate_ids(spark):
    facts = spark.createDataFrame(
        [("n1", "a", "name", "A", 1), ("n2", "b", "name", "B", 2), ("n3", "c", "name", "C", 3), ("x", "b", "city", "Y", 1)],
        "id string, entity_id string, attribute string, val string, t int",
    ).select("id", "entity_id", "attribute", "val", F.timestamp_seconds("t").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_until"))
    merges = spark.createDataFrame([("b", "a")], "duplicate_id string, canonical_id string")
    for hot_rows in (10**9, 1):
        moved, edges = merge_entities(
            facts, relation_frame(spark, [("r1", "b", "c"), ("r2", "a", "b")]), merges, at("2024-01-01 00:00:00"), hot_rows
        )
        got = {r.id: (r.entity_id, r.valid_until is None) for r in moved.collect()}
        assert got == {"n1": ("a", False), "n2": ("a", True), "n3": ("c", True), "x": ("a", True)}
        assert {(r.id, r.source_id, r.target_id) for r in edges.collect()} == {("r1", "a", "c"), ("r2", "a", "a")}


def test_community_contexts(spark):
    ids = [f"m{i:03d}" for i in range(600)]
    labels = spark.createDataFrame([(i, "m000") for i in ids] + [("z", "z")], "id string, label string")
    names = spark.createDataFrame([(i, "N" + i) for i in ids + ["z"]], "entity_id string, name string")
    facts = names.select(
        F.concat(F.lit("f"), "entity_id").alias("id"), "entity_id", F.lit("name").alias("attribute"), F.col("name").alias("val"),
        at("2024-01-01 00:00:00").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_until"),
    )
    edges = relation_frame(spark, [("r1", "m000", "m001"), ("r2", "m001", "z"), ("r3", "z", "m002")])
    lines = C.community_lines(labels, names, facts, edges)
    assert Counter(r.section for r in lines.collect()) == {1: 600, 2: 600, 3: 3}
    whole = C.community_contexts(lines).collect()
    assert len(whole) == 1 and whole[0].context.startswith("Members: " + ", ".join("N" + i for i in ids) + "\n\nFacts:\n")
    assert "- Nm000 -> Nm001 (T)\n- Nm000 -> Nm001 (T)" in whole[0].context and "-> Nz" not in whole[0].context
    assert whole[0].context.count("- Entity") == 600


def test_names_alike_in_time_and_id_do_not_depend_on_row_order(spark):
    rows = [("n", "e", "name", name, 0, None) for name in ("oak", "ash", "yew", "elm")]
    schema = "id string, entity_id string, attribute string, val string, valid_from int, valid_until int"
    given = [spark.createDataFrame(r, schema).coalesce(1) for r in (rows, rows[::-1], rows[2:] + rows[:2])]
    assert [[tuple(r) for r in G.entity_names(f).collect()] for f in given] == [[("e", "yew")]] * 3


# -- entity resolution -------------------------------------------------------

def model_jaro_winkler(a, b):
    x, y = a.encode(), b.encode()
    if x == y:
        return 1.0
    if not x or not y:
        return 0.0
    reach = max(max(len(x), len(y)) // 2 - 1, 0)
    used_x, used_y = [False] * len(x), [False] * len(y)
    for i in range(len(x)):
        for j in range(len(y)):
            if abs(i - j) <= reach and not used_y[j] and x[i] == y[j]:
                used_x[i] = used_y[j] = True
                break
    p = [c for c, u in zip(x, used_x) if u]
    q = [c for c, u in zip(y, used_y) if u]
    if not p:
        return 0.0
    t = sum(c != d for c, d in zip(p, q)) / 2
    jaro = (len(p) / len(x) + len(p) / len(y) + (len(p) - t) / len(p)) / 3
    prefix = next((i for i, (c, d) in enumerate(zip(x[:4], y[:4])) if c != d), min(4, len(x), len(y)))
    return jaro + prefix * 0.1 * (1 - jaro)


@settings(max_examples=500, deadline=None)
@given(st.text("abcé", max_size=12), st.text("abcé", max_size=12))
def test_jaro_winkler(a, b):
    score = R.jaro_winkler(a, b)
    assert abs(score - model_jaro_winkler(a, b)) < 1e-12
    assert 0 <= score <= 1 + 1e-12 and (a != b or score == 1)


def model_resolution(nodes, threshold):
    merged = {}
    for i, (a, name_a, va) in enumerate(nodes):
        if a in merged:
            continue
        for b, name_b, vb in nodes[i + 1:]:
            if b in merged or a == b:
                continue
            cos = 0.0
            if va and vb and len(va) == len(vb):
                na, nb = np.linalg.norm(va), np.linalg.norm(vb)
                cos = float(np.dot(va, vb) / na / nb) if na and nb else 0.0
            if 0.6 * cos + 0.4 * model_jaro_winkler(name_a.strip().lower(), name_b.strip().lower()) >= threshold:
                merged[b] = a
    return merged


@pytest.mark.parametrize("seed,cell,hot_rows", [(1, 2000, 10**9), (2, 5, 10**9), (3, 5, 8)])
def test_resolution_equals_sequential_scan(spark, seed, cell, hot_rows):
    rng = np.random.default_rng(seed)
    pick = random.Random(seed)
    centres = rng.normal(size=(6, 8))
    bases = ["anna smith", "anna smyth", "ana smith", "bob stone", "bob stones", "carl"]
    nodes = []
    for i in range(70):
        c = pick.randrange(6)
        vector = centres[c if pick.random() < 0.8 else pick.randrange(6)] + rng.normal(size=8) * pick.choice([0.0, 0.25, 0.5])
        if i % 17 == 3:
            vector = vector[:5]
        nodes.append((str(uuid.UUID(int=pick.getrandbits(128))), pick.choice([str.upper, str, str.title])(bases[c]),
                      [float(np.float32(x)) for x in vector] if i % 19 else []))
    nodes += [(nodes[4][0], "carl", nodes[9][2]), (nodes[8][0], "bob stone", [0.0] * 8)]
    nodes.sort(key=lambda n: n[0])
    frame = spark.createDataFrame(nodes, "entity_id string, name string, embedding array<float>").repartition(3)
    for threshold in (0.93, 0.8):
        got = R.resolve_entities(frame, threshold, hot_rows, cell_forms=cell).collect()
        assert {r.duplicate_id: r.canonical_id for r in got} == model_resolution(nodes, threshold)


def test_resolution_needs_a_vector_bound(spark):
    frame = spark.createDataFrame([("a", "x", [1.0])], "entity_id string, name string, embedding array<float>")
    with pytest.raises(ValueError):
        R.resolve_entities(frame, 0.3)


def remembered_facts(spark):
    """(id, entity, attribute, val, owner, last read): open facts, of which those read in 2010 are forgotten."""
    rows = [
        ("f1", "e", "city", "Rome", "e", "2010-01-01"), ("f2", "e", "job", "cook", "", "2024-03-10"),
        ("f3", "e", "food", "rice", "other", "2024-03-10"), ("f4", "e", "pet", "cat", "e", "2024-03-10"),
    ]
    frame = spark.createDataFrame(rows, "id string, entity_id string, attribute string, val string, agent_owner string, read string")
    return frame.select(
        "id", "entity_id", "attribute", "val", "agent_owner", F.col("read").cast("timestamp").alias("last_accessed"),
        at("2010-01-01 00:00:00").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_until"),
        F.lit(30.0).alias("stability"), F.lit(1.0).alias("memory_strength"), F.lit("x").alias("source_agent"))


def test_forgotten_and_foreign_facts_decide_nothing(spark):
    facts, now = remembered_facts(spark), at("2024-03-15 00:00:00")
    candidates = spark.createDataFrame(
        [("e", "city", "Rome"), ("e", "job", "cook"), ("e", "food", "rice"), ("e", "pet", "dog")], "entity_id string, attribute string, val string")
    actions = {r.attribute: r.action for r in O.classify_candidates(candidates, facts, now=now).collect()}
    assert actions == {"city": "insert", "job": "skip", "food": "insert", "pet": "supersede"}
    other = candidates.withColumn("val", F.lit("z"))
    assert {r.id for r in O.contradicted(facts, other, now=now).collect()} == {"f2", "f3", "f4"}
    verdicts = spark.createDataFrame(
        [(1, "e", "city: Rome", ""), (2, "e", "job: cook", ""), (3, "e", "food: rice", "")],
        "verdict_id int, entity_id string, conflicting_fact string, reason string")
    assert {r.verdict_id: r.matched_id for r in O.match_conflicts(verdicts, facts, now=now).collect()} == {1: None, 2: "f2", 3: None}
    groups = {r.owner: r.fact_lines for r in reflection_facts(facts, now=now).collect()}
    assert set(groups) == {"e", "other"} and "city" not in "".join(groups.values())


def test_new_relations_per_owner(spark):
    schema = "source_id string, target_id string, rel_type string, agent_owner string"
    known = spark.createDataFrame([("a", "b", "knows", "x"), ("a", "c", "KNOWS", "")], schema).withColumn(
        "valid_until", F.lit(None).cast("timestamp"))
    asked = [("a", "b", " Knows", "x"), ("a", "b", "knows", "y"), ("a", "b", "knows", "y"), ("a", "c", "knows", "y"), ("a", "d", "knows", "x"), ("a", "d", "knows", "y")]
    got = sorted((r.target_id, r.agent_owner) for r in G.new_relations(spark.createDataFrame(asked, schema), known).collect())
    assert got == [("b", "y"), ("d", "x"), ("d", "y")]


def test_equal_blank_names_merge(spark):
    nodes = spark.createDataFrame(
        [("n1", "  ", [1.0, 0.1]), ("n2", " ", [1.0, 0.12]), ("n3", "abc", [1.0, 0.1])], "entity_id string, name string, embedding array<float>")
    rows = R.resolve_entities(nodes, 0.93).collect()
    assert [(r.duplicate_id, r.canonical_id) for r in rows] == [("n2", "n1")]


def test_top_k_per_query_compares_equal_vectors_once(spark, monkeypatch):
    from engram.operators import search

    compared, scan = [], search.nearest_in_partition
    monkeypatch.setattr(search, "nearest_in_partition", lambda held, k: compared.append(len(held.value)) or scan(held, k))
    # 2 * v and v score alike, so their rows are ranked together by id
    rows = [(f"{i:03d}", [[1.0, 0.0], [2.0, 0.0], [1.0, 1.0], [0.0, 1.0]][i % 4]) for i in range(80)] + [("n", None), ("e", [])]
    vectors = spark.createDataFrame(rows, "id string, embedding array<float>")
    queries = spark.createDataFrame([(q, [3.0, 0.5] if q % 2 else [0.0, 1.0]) for q in range(30)], "query_id long, embedding array<float>")
    found = search.top_k_per_query(vectors, queries, 50).collect()
    assert compared == [2]
    want = {}
    for q in range(2):
        x, y = (3.0, 0.5) if q else (0.0, 1.0)
        score = {i: (x * v[0] + y * v[1]) / (x * x + y * y) ** 0.5 / (v[0] ** 2 + v[1] ** 2) ** 0.5 for i, v in rows if v}
        want[q] = [i for i in sorted(score, key=lambda i: (-round(score[i], 9), i))[:50]]
    got = {}
    for r in sorted(found, key=lambda r: r.rn):
        got.setdefault(r.query_id, []).append(r.id)
    assert got == {str(q): want[q % 2] for q in range(30)}


def test_requests_of_equal_vectors_share_a_pool(spark, monkeypatch):
    """40 requests with two vectors draw two pools; what each finds is what it finds alone."""
    drawn, draw = [], S.top_k_per_vector
    monkeypatch.setattr(O, "top_k_per_vector", lambda *a: drawn.append(draw(*a)) or drawn[-1])
    vectors = [[1.0, 0.0], [0.5, 0.5], [0.0, 1.0], [-0.0, 1.0], [3.0, 1.0]]
    rows = [(f"f{i:03d}", f"e{i % 9}", vectors[i % 5], "", None) for i in range(300)]
    rows.append(("f000", "e1", [0.9, 0.1], "", None))  # an id of two vectors
    facts = spark.createDataFrame(rows, "id string, entity_id string, embedding array<float>, agent_owner string, valid_until timestamp")
    facts = facts.withColumns({"valid_from": at("2024-01-01 00:00:00"), "last_accessed": at("2024-01-02 00:00:00"), "stability": F.lit(30.0)})
    asked = [(f"r{i}", f"e{i % 9}", None, [1.0, 0.2] if i % 2 else [0.0, 2.0]) for i in range(40)]
    requests = spark.createDataFrame(asked, "request_id string, entity_id string, viewer string, embedding array<float>")
    found = O.search_hybrid_batch(facts, requests, at("2024-01-03 00:00:00"), 5).facts.collect()
    assert drawn[0][1].count() == 2 * O.DEFAULTS.ann_pool and drawn[0][0].count() == 40

    def score(v, q):
        return round(float(np.dot(v, q) / np.linalg.norm(v) / np.linalg.norm(q)), 9)

    got = {}
    for r in sorted(found, key=lambda r: (r.request_id, r.rn)):
        got.setdefault(r.request_id, []).append((r.id, score(r.embedding, dict((a[0], a[3]) for a in asked)[r.request_id])))
    for request, entity, _, vector in asked[:6]:
        pool = sorted(rows, key=lambda f: (-score(f[2], vector), f[0]))[:O.DEFAULTS.ann_pool]
        # an id in the pool brings all facts of that id
        mine = [f for p in pool for f in rows if f[0] == p[0] and f[1] == entity][:5]
        assert [i for i, _ in got.get(request, [])] == [f[0] for f in mine]
    odd = spark.createDataFrame([([None, 1.0],), ([1.0, None],), ([1.0],), ([1.0, float("nan")],), ([1.0, 2.0],), ([2.0, 1.0],), ([1.0, 2.0],)], "embedding array<double>")
    assert odd.select(S._same_vector(odd)).distinct().count() == 6


def test_community_contexts_of_many_pieces(spark):
    """Pieces cut anywhere give the text of all lines in order."""
    import random

    rows = [(c, s, f"{i:05d}", k, f"{c}{s}{i}{k}") for c in ("a", "b") for s in (1, 2, 3) for i in range(50) for k in ("1", "2")]
    rows += [("a", 2, "00000", "3", None), ("z", 2, "0", "", None)]
    random.Random(1).shuffle(rows)
    lines = spark.createDataFrame(rows, "community_id string, section int, k1 string, k2 string, line string").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        plan = C.community_contexts(lines)
        found = dict(plan.collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)

    def text(c):
        one, two, three = ([r[4] for r in sorted(r for r in rows if r[0] == c and r[1] == s and r[4])] for s in (1, 2, 3))
        return "Members: " + ", ".join(one) + "\n\nFacts:\n" + "\n".join(two) + "\n\nRelations:\n" + "\n".join(three)

    assert found == {c: text(c) for c in "abz"}
    # no aggregate holds the lines of a community
    assert "collect_list" not in plan._jdf.queryExecution().executedPlan().toString()


def test_long_contexts_have_tasks_of_their_own(spark, monkeypatch):
    """Two long texts never meet in a task, and their pieces are small, so that no batch of pieces is large."""
    import pyarrow as pa

    monkeypatch.setattr(C, "TASK_TEXT", 1000, raising=False)
    rows = [(f"c{c}", s, f"{i:03d}", "", f"line {c} {s} {i}") for c in range(40) for s in (1, 3) for i in range(60 if c < 12 else 2)]
    rows += [(None, 2, "0", "", "x"), ("c3", 2, "0", "", None)]
    lines = spark.createDataFrame(rows, "community_id string, section int, k1 string, k2 string, line string")
    found = C.community_contexts(lines).select("*", F.spark_partition_id().alias("task")).collect()
    assert len(found) == 41 and len({r.community_id for r in found}) == 41
    long = [r.task for r in found if len(r.context) > 1000]
    assert len(long) == len(set(long)) == 12 and not {r.task for r in found if len(r.context) < 1000} & set(long)
    held = next(r.context for r in found if r.community_id == "c3")
    one, three = (sep.join(f"line 3 {s} {i}" for i in range(60)) for s, sep in ((1, ", "), (3, "\n")))
    assert held == f"Members: {one}\n\nFacts:\n\n\nRelations:\n{three}"
    batch = pa.RecordBatch.from_pylist([{"community_id": "a", "section": 3, "k1": f"{i:04d}", "k2": "", "line": "y" * 99} for i in range(2000)])
    pieces = [p for b in C._pieces(iter([batch])) for p in b.column("piece").to_pylist()]
    assert "\n".join(pieces) == "\n".join(["y" * 99] * 2000) and max(map(len, pieces)) < 5000


def test_sequential_labels_travel_as_numbers(spark, monkeypatch):
    """Also with the nil id among the nodes, relations alike in id, ends that are null, and nodes without links."""
    seen, connect = [], C.connected_components
    monkeypatch.setattr(C, "connected_components", lambda rows, *a: seen.append(dict(rows.dtypes)) or connect(rows, *a))
    rng = random.Random(7)
    ids = [NIL_UUID, *(f"{i}-n" for i in range(30)), *(f"-{i}" for i in range(4))]
    named = sorted(ids[:28])
    edges = [(f"r{i:02d}", rng.choice(ids), rng.choice(ids)) for i in range(50)]
    nodes = spark.createDataFrame([(n,) for n in [*named, *named[:3], "alone", None]], "id string")
    relations = relation_frame(spark, [*edges, ("null", None, "1-n"), (None, None, None)])
    for whole in (C.WHOLE_LINKS, 5):
        got = C.label_propagation(nodes, relations, whole=whole).collect()
        assert len(got) == 30 and {r.id: r.label for r in got} == {**model_lpa(named, edges), "alone": "alone", None: None}
    assert {k: v for k, v in seen[0].items() if k != "seen"} == {"node": "bigint", "nbr": "bigint", "weight": "bigint", "nbr_named": "boolean"}
    # two relations of one id: the greater visitor decides, then the smaller label
    twice = spark.createDataFrame([(n,) for n in "abc"], "id string")
    again = relation_frame(spark, [("r", "c", "a"), ("r", "c", "b")])
    assert {r.id: r.label for r in C.label_propagation(twice, again, 1).collect()} == {"a": "c", "b": "c", "c": "c"}


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_stars_are_contracted_in_few_rounds(spark, monkeypatch, few):
    from engram.operators import components

    written, cut = [], components.checkpoint
    monkeypatch.setattr(components, "FEW_EDGES", few, raising=False)
    monkeypatch.setattr(components, "checkpoint", lambda rows: written.append(1) or cut(rows))
    ends = [(f"h{i}", f"l{i}-{j}") for i in range(150) for j in range(2 + i % 20)] + [("p", "q"), ("x", "y"), ("y", "z"), ("z", "x")]
    found = {r.id: r.component for r in connected_components(spark.createDataFrame(ends, "x string, y string"), "x", "y").collect()}
    assert found == {n: min(e) if e[0][0] != "h" else e[0] for e in ends for n in e} | dict.fromkeys("xyz", "x")
    assert len(written) <= 14


def test_synchronous_labels_travel_as_numbers_and_tie_by_id(spark, monkeypatch):
    seen, sketch = [], C.hot_keys
    monkeypatch.setattr(C, "hot_keys", lambda rows, *a: seen.append(dict(rows.dtypes)) or sketch(rows, *a))
    ids = [f"{i}-n" for i in range(30)]
    ends = [(ids[i], ids[j]) for i in range(27) for j in range(27) if i != j and (i * j + i + j) % 5 == 0]
    relations = spark.createDataFrame([(*e, None) for e in [*ends, ("10-n", "gone"), ("3-n", "3-n")]], "source_id string, target_id string, valid_until timestamp")
    nodes = spark.createDataFrame([(i,) for i in ids], "id string")
    found = dict(C.label_propagation_sync(nodes, relations, 3).collect())
    assert seen == [{"node": "bigint", "id": "bigint", "weight": "bigint"}]
    want = {i: i for i in ids}
    for _ in range(3):
        votes = {}
        for s, t in ends:
            for node, nbr in ((s, t), (t, s)):
                tally = votes.setdefault(node, {})
                tally[want[nbr]] = tally.get(want[nbr], 0) + 1
        want |= {node: min((-n, label) for label, n in tally.items())[1] for node, tally in votes.items()}
    assert found == want


def test_sweeps_leave_no_shuffle_files(spark):
    def files():
        kept = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for f in (kept.apply(i) for i in range(kept.size())) if (name := f.getName()).startswith("shuffle_") and name.endswith(".data")}

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, held = files(), spark.conf.get(key)
    ends = [(f"e{i}", f"{i % 7}", f"{i % 11}") for i in range(77)]
    nodes, relations = spark.range(12).selectExpr("string(id) AS id"), relation_frame(spark, ends)
    labels = C.label_propagation_sync(nodes, relations)
    assert not files() - before and spark.conf.get(key) == held
    found = {r.id: r.label for r in labels.collect()}
    # opposite relations count together, and loops not
    votes = Counter((n, o) for _, s, t in ends if s != t for n, o in ((s, t), (t, s)))
    want = {n: n for n in map(str, range(12))}
    for _ in range(5):
        tally = {}
        for (n, o), c in votes.items():
            tally.setdefault(n, Counter())[want[o]] += c
        want |= {n: min((-c, label) for label, c in t.items())[1] for n, t in tally.items()}
    assert found == want


def test_nodes_of_label_propagation_are_not_broadcast(spark):
    nodes, relations = spark.range(9).selectExpr("string(id) AS id"), relation_frame(spark, [("e", "1", "2")])
    plan = C._visits(nodes, relations)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    # hot keys are few and may be broadcast
    plan = C.label_propagation_sync(nodes, relations, 1)._jdf.queryExecution().executedPlan().toString()
    assert [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "_hot#" not in line] == []


def test_near_vectors_meet_over_bounded_blocks(spark, monkeypatch):
    """Every near pair is found once, however many blocks the cells are cut into; no block exceeds its bound by much."""
    import numpy as np

    monkeypatch.setattr(R, "LEAST_BLOCK", 16)
    rng = np.random.default_rng(3)
    # one dense cell of many blocks, scattered vectors, and vectors of another length
    rows = [v.tolist() for v in np.concatenate([rng.normal(0, 0.05, (150, 6)) + np.eye(6)[0], rng.normal(0, 1, (150, 6))])]
    rows += [v.tolist() for v in rng.normal(0, 1, (40, 2))] + [[float("nan"), 1.0], [float("inf"), 1.0]]
    rows = [np.float32(r).tolist() for r in rows]
    frame = spark.createDataFrame([(f"{i:03d}", r, float(np.linalg.norm(r))) for i, r in enumerate(rows)], "vec string, embedding array<float>, length double")
    blocks, products = [], R._placement
    monkeypatch.setattr(R, "_placement", lambda *a: blocks.extend(products(*a)) or blocks)
    least = 0.9
    found = R._near_vectors(frame, least, float(np.sqrt(2 - 2 * least)) + 1e-6, 60).collect()
    want = {}
    for i, a in enumerate(rows):
        for j, b in enumerate(rows[i:], i):
            cos = np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) if len(a) == len(b) else 0
            if cos >= least:
                want[f"{i:03d}", f"{j:03d}"] = cos
    got = {tuple(sorted((r.vec_a, r.vec_b))): r.cos for r in found}
    assert len(found) == len(got) and set(got) == set(want)
    assert all(abs(got[p] - want[p]) < 1e-9 for p in want)
    assert max(parts for _, _, _, parts, _ in blocks) > 5


def test_ends_outside_a_large_frontier_are_left_out_before_the_join(spark, monkeypatch):
    """Without a broadcast the hops find the same edges, and few others reach the join."""
    from engram.operators import graph, skew

    rng = random.Random(5)
    edges = [(f"e{i}", f"n{rng.randrange(400)}", f"n{rng.randrange(400)}") for i in range(3000)]
    relations = relation_frame(spark, edges + [("null", None, "n1"), ("loop", "n1", "n1")]).withColumn(
        "agent_owner", F.when(F.crc32("id") % 3 == 0, "").when(F.crc32("id") % 3 == 1, F.col("source_id")).otherwise("someone"))
    facts = spark.createDataFrame([(f"f{i}", f"n{i}", "name", f"Name {i % 90}" if i % 5 else "") for i in range(400)], "id string, entity_id string, attribute string, val string")
    facts = facts.withColumn("valid_from", at("2024-01-01 00:00:00")).withColumn("valid_until", F.lit(None).cast("timestamp"))
    seeds = spark.createDataFrame([(f"q{i}", f"n{i}", f"n{i}") for i in range(12)], "request_id string, entity_id string, viewer string")
    open_seeds = seeds.withColumn("viewer", F.when(F.col("request_id") != "q3", F.col("viewer")))

    def found():
        return [sorted(map(tuple, f.collect())) for given in (seeds, open_seeds) for f in (expand_hops(relations, given), graph.graph_context(relations, facts, given))]

    want = found()
    monkeypatch.setattr(graph, "FEW_ROWS", 0)
    assert found() == want and len(want[0]) > 12
    # a key that is there always passes, null never does, and most others don't
    keys = spark.range(0, 3000, 3).select(F.col("id").cast("string").alias("k"))
    rows = spark.range(3000).select(F.when(F.col("id") > 0, F.col("id").cast("string")).alias("key"))
    kept = {r.key for r in skew.maybe_among(rows, F.col("key"), keys).collect()}
    assert {str(i) for i in range(3, 3000, 3)} <= kept and len(kept) < 1010 and None not in kept
    assert skew.maybe_among(rows, F.col("key"), keys.limit(0), F.col("key") == "7").collect() == [("7",)]
