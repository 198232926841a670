"""SQL of the catalogue's sequential rules, written apart from the operators.

Each follows its rule step by step: a chunk grows by one piece, entities are merged one by one in
id order, labels are updated node by node.
"""

from __future__ import annotations

from engram.catalog.tables import sql_trim
from engram.config import DEFAULTS


def _parts(level: int, cut: str, size: int) -> str:
    """Splits of the texts still too long; those that fit leave with the separator put back."""
    split = f"string_split(t, {cut})" if cut else "regexp_extract_all(t, '(?s).')"
    return f"""
    cut{level} AS (SELECT k, p || [i] AS p, w AS t FROM (
        SELECT k, p, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT k, p, {split} AS ws FROM long{level}))),
    fit{level} AS (SELECT k, p, t || {cut or "''"} AS t FROM cut{level} WHERE strlen(t) <= {size}),
    long{level + 1} AS (SELECT k, p, t FROM cut{level} WHERE strlen(t) > {size})"""


def sql_chunks(rows: str, size: int = DEFAULTS.chunk_size, overlap: int = DEFAULTS.chunk_overlap) -> str:
    """``chunks (k, chunk_index, content)`` of ``rows``, a query of ``k, t``."""
    cuts = ["chr(10) || chr(10)", "chr(10)", "'. '", "'? '", "'! '", "' '", ""]
    levels = ",".join(_parts(i, cut, size) for i, cut in enumerate(cuts))
    pieces = " UNION ALL ".join(f"SELECT * FROM fit{i}" for i in range(len(cuts)))
    full = f"acc.held <> '' AND acc.bytes + strlen(x.piece) > {size}"
    kept = f"CASE WHEN {full} THEN right(acc.held, {overlap}) ELSE acc.held END"
    kept_bytes = f"CASE WHEN {full} THEN strlen(right(acc.held, {overlap})) ELSE acc.bytes END"
    gap = f"({kept}) <> '' AND right({kept}, 1) <> ' '"
    return f"""
    given AS (SELECT k, t FROM ({rows})),
    long0 AS (SELECT k, []::BIGINT[] AS p, t FROM given WHERE strlen(t) > {size}),{levels},
    pieces AS (SELECT k, p, {sql_trim("t")} AS t FROM (
        SELECT k, []::BIGINT[] AS p, t FROM given WHERE strlen(t) <= {size} UNION ALL {pieces})),
    folded AS (SELECT k, list_reduce(
        list_prepend({{'done': []::VARCHAR[], 'held': '', 'bytes': 0::BIGINT, 'piece': ''}},
            list({{'done': []::VARCHAR[], 'held': '', 'bytes': 0::BIGINT, 'piece': t}} ORDER BY p)),
        lambda acc, x: {{
            'done': CASE WHEN {full} THEN list_append(acc.done, {sql_trim("acc.held")}) ELSE acc.done END,
            'held': ({kept}) || CASE WHEN {gap} THEN ' ' ELSE '' END || x.piece,
            'bytes': ({kept_bytes}) + CASE WHEN {gap} THEN 1 ELSE 0 END + strlen(x.piece),
            'piece': ''}}) AS f FROM pieces WHERE t <> '' GROUP BY k),
    listed AS (SELECT k, list_append(f.done, {sql_trim("f.held")}) AS cs FROM folded),
    chunks AS (SELECT k, unnest(range(len(cs)))::INT AS chunk_index, unnest(cs) AS content FROM listed)"""


def _sql_names() -> str:
    """``names (x, y, score)``: Jaro-Winkler of all pairs of different names, with halves of transpositions."""
    reach = "greatest(greatest(len(x), len(y)) // 2 - 1, 0)"
    first = f"""list_filter(range(greatest(e.i - {reach}, 1), least(e.i + {reach}, len(y)) + 1),
            lambda j: y[j] = x[e.i] AND NOT list_contains(acc.taken, j))[1]"""
    same = "CASE WHEN x[1] <> y[1] THEN 0 WHEN x[2] <> y[2] THEN 1 WHEN x[3] <> y[3] THEN 2 WHEN x[4] <> y[4] THEN 3 ELSE least(4, len(x), len(y)) END"
    return f"""
    matched AS (SELECT x, y, list_reduce(
        list_transform(range(0, len(x) + 1), lambda i: {{'i': i, 'taken': []::BIGINT[]}}),
        lambda acc, e: {{'i': e.i, 'taken': CASE WHEN {first} IS NULL THEN acc.taken ELSE list_append(acc.taken, {first}) END}}).taken AS taken
        FROM (SELECT DISTINCT a.name AS x, b.name AS y FROM given a JOIN given b ON a.name <> b.name)),
    counted AS (SELECT x, y, len(taken) AS m, len(list_filter(range(1, len(taken) + 1), lambda k: y[taken[k]] <> y[list_sort(taken)[k]])) / 2 AS t FROM matched),
    jaro AS (SELECT x, y, CASE WHEN m = 0 THEN 0 ELSE (m / len(x) + m / len(y) + (m - t) / m) / 3 END AS j FROM counted),
    names AS MATERIALIZED (SELECT x, y, j + {same} * 0.1 * (1 - j) AS score FROM jaro
        UNION ALL SELECT DISTINCT name, name, 1 FROM given)"""


def sql_resolution(nodes: str) -> str:
    """``merges (duplicate_id, canonical_id)`` of ``nodes``, a query of ``id, name, v``.

    Entities are taken in id order; one that matches an earlier one still standing goes to the
    first such. Meant for few different names, of one byte per character.
    """
    return f"""
    given AS (SELECT id, lower({sql_trim("name")}) AS name, v::DOUBLE[] AS v, row_number() OVER (ORDER BY id) AS i
        FROM ({nodes}) WHERE len(list_filter(v, lambda x: x <> 0)) > 0),{_sql_names()},
    alike AS MATERIALIZED (SELECT b.i AS i, list(a.i ORDER BY a.i) AS before
        FROM given a JOIN names ON x = a.name JOIN given b ON y = b.name AND a.i < b.i
        WHERE score >= {(DEFAULTS.resolution_threshold - DEFAULTS.resolution_vector_weight) / DEFAULTS.resolution_name_weight - 1e-6}
            AND {DEFAULTS.resolution_vector_weight} * list_cosine_similarity(a.v, b.v) + {DEFAULTS.resolution_name_weight} * score >= {DEFAULTS.resolution_threshold}
        GROUP BY b.i),
    steps AS MATERIALIZED (SELECT row_number() OVER (ORDER BY i) AS n, i, before FROM alike),
    standing AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS gone, NULL::BIGINT AS i, NULL::BIGINT AS into_i
        UNION ALL
        SELECT s.n, CASE WHEN len(list_filter(before, lambda x: NOT list_contains(gone, x))) > 0 THEN list_append(gone, s.i) ELSE gone END,
            s.i, list_filter(before, lambda x: NOT list_contains(gone, x))[1]
        FROM standing t JOIN steps s ON s.n = t.n + 1),
    merges AS (SELECT d.id AS duplicate_id, c.id AS canonical_id FROM standing s JOIN given d ON d.i = s.i JOIN given c ON c.i = s.into_i)"""


def sql_sequential_labels(nodes: str, edges: str, sweeps: int = DEFAULTS.lpa_sweeps) -> str:
    """``labels (id, label)`` after sweeps in id order, all parts of the graph side by side.

    ``nodes`` gives ``part, id`` and ``edges`` ``part, id, source_id, target_id``; no edge leaves its
    part. Each end of an edge writes it down when it is visited, so it counts twice; of equally
    frequent labels the one that got there first wins.
    """
    return f"""
    placed_at AS (SELECT part, id, row_number() OVER (PARTITION BY part ORDER BY id) AS pos FROM ({nodes})),
    written AS (SELECT part, unnest([source_id, target_id]) AS visitor, id AS edge, source_id, target_id FROM ({edges})),
    seen AS (SELECT part, visitor, edge, source_id AS node, target_id AS nbr FROM written
        UNION ALL SELECT part, visitor, edge, target_id, source_id FROM written),
    nbrs AS (SELECT s.part, s.node, list(p.pos ORDER BY s.visitor, s.edge) AS ns
        FROM seen s JOIN placed_at p ON p.part = s.part AND p.id = s.nbr GROUP BY s.part, s.node),
    plan AS MATERIALIZED (SELECT p.part, p.pos, p.id, coalesce(ns, []) AS ns, count(*) OVER (PARTITION BY p.part) AS n
        FROM placed_at p LEFT JOIN nbrs ON nbrs.part = p.part AND nbrs.node = p.id),
    swept AS (SELECT part, 0::BIGINT AS step, list(id ORDER BY pos) AS ls FROM plan GROUP BY part
        UNION ALL
        SELECT part, step + 1, CASE WHEN len(votes) = 0 THEN ls ELSE list_concat(ls[:pos - 1], list_concat([list_min(list_transform(list_distinct(votes),
            lambda v: {{'a': -len(list_filter(votes, lambda w: w = v)), 'b': -list_position(list_reverse(votes), v), 'c': v}})).c], ls[pos + 1:])) END
        FROM (SELECT s.part, s.step, s.ls, p.pos, list_transform(p.ns, lambda i: s.ls[i]) AS votes
            FROM swept s JOIN plan p ON p.part = s.part AND p.pos = s.step % p.n + 1 WHERE s.step < {sweeps} * p.n)),
    labels AS (SELECT id, ls[pos] AS label FROM swept s JOIN plan p ON p.part = s.part WHERE s.step = {sweeps} * p.n)"""
