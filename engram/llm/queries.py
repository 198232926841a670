"""Queries of the operators over the supplied tables, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from engram.catalog.registry import Query
from engram.llm import bpe, codes, decontam, lines, mixing, near_dedup, pii, quality, repeats, shards, tries, vectors, warc
from engram.session import checkpoint, tune

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

SHARDS = 24
SITES = 10


def query(name: str, sql: str | None = None):
    def register(run: Query) -> Query:
        def tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run(tune(spark), sf_dir)

        tuned.__name__, tuned.__doc__ = name, run.__doc__
        QUERIES[name] = tuned
        if sql is not None:
            SQL[name] = sql
        return tuned

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql_shingles(source: str, key: str) -> str:
    """Common table expressions ``{source}_s (key, s)``: distinct five-word shingles."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    {source}_w AS (SELECT {key}, regexp_extract_all({lower}, '[^\\x20\\x09-\\x0D]+') AS w FROM {source}),
    {source}_s AS (SELECT DISTINCT {key}, unnest(CASE
        WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS s FROM {source}_w)"""


def _sql_components(nodes: str, edges: str) -> str:
    """``reach (id, component_id)``: the smallest node reachable over ``edges (a, b)`` (both ways)."""
    return f"""
    walk AS (SELECT id, id AS r FROM {nodes} UNION SELECT w.id, e.b FROM walk w JOIN {edges} e ON e.a = w.r),
    reach AS (SELECT id, min(r) AS component_id FROM walk GROUP BY id)"""


@query("op1_minhash_near_dedup", f"""
WITH RECURSIVE {_sql_shingles("documents", "doc_id")},
    sizes AS (SELECT doc_id, count(*) AS n FROM documents_s GROUP BY doc_id),
    shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM documents_s x JOIN documents_s y USING (s) WHERE x.doc_id < y.doc_id GROUP BY 1, 2),
    half AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
    links AS (SELECT a, b FROM half UNION SELECT b, a FROM half),
    nodes AS (SELECT doc_id AS id FROM documents), {_sql_components("nodes", "links")}
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN sizes USING (doc_id) JOIN reach ON reach.id = doc_id""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents, similarity 0.85 on five-word shingles."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op2_benchmark_decontamination", f"""
WITH {_sql_shingles("documents", "doc_id")}, {_sql_shingles("benchmark", "item_id")},
    sizes AS (SELECT item_id, count(*) AS n_item FROM benchmark_s GROUP BY item_id),
    shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM documents_s JOIN benchmark_s USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment
FROM shared JOIN sizes USING (item_id) WHERE 100 * n_shared >= 80 * n_item""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item, to 0.8 of its five-word shingles."""
    return decontam.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_quality_neighbours")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by its labelled neighbours; a fifth of the ids is held out."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs.select("doc_id", "text"), model).select(
        "doc_id", quality.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op4_embedding_near_dedup", f"""
WITH RECURSIVE good AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings
        WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS (SELECT x.id AS a, y.id AS b FROM good x JOIN good y ON x.id <> y.id AND list_cosine_similarity(x.v, y.v) >= 0.95),
    nodes AS (SELECT vec_id AS id FROM embeddings), {_sql_components("nodes", "links")},
    counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN reach ON reach.id = vec_id LEFT JOIN counts ON a = vec_id""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all embeddings, cosine 0.95."""
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(t))), lambda i: ('0x' || substr(hex(encode(t)), 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, crcs[xor(c, b) % 256 + 1]))"""


@query("op5_stratified_shards", f"""
WITH RECURSIVE steps AS (SELECT k, k AS v, 0 AS n FROM range(256) t(k)
        UNION ALL SELECT k, CASE WHEN v % 2 = 1 THEN xor(3988292384, v // 2) ELSE v // 2 END, n + 1 FROM steps WHERE n < 8),
    crc AS (SELECT list(v ORDER BY k) AS crcs FROM steps WHERE n = 8),
    sized AS (SELECT doc_id, source, coalesce(text, '') AS t, octet_length(encode(coalesce(text, ''))) + 8 AS size,
        md5('0:' || coalesce(doc_id::VARCHAR, '')) AS mark, crcs FROM documents, crc),
    summed AS (SELECT doc_id, source, size, mark, xor(4294967295, {_CRC}) AS text_crc32 FROM sized),
    ranked AS (SELECT *, (2 * row_number() OVER (PARTITION BY source ORDER BY mark, text_crc32, size) - 1)
        / (2 * count(*) OVER (PARTITION BY source)) AS share FROM summed),
    placed AS (SELECT *, row_number() OVER (ORDER BY share, mark, text_crc32, size) - 1 AS p, count(*) OVER () AS n FROM ranked),
    cut AS (SELECT *, p * {SHARDS} // n AS k FROM placed)
SELECT doc_id, size, text_crc32, 'rows' AS law, k::INT AS shard, p - (k * n + {SHARDS - 1}) // {SHARDS} AS slot, NULL::INT AS grown_shard FROM cut""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of equal counts that match the mixture of sources."""
    out = shards.interleaved(table(spark, sf_dir, "documents"), SHARDS, carry=["doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op6_repeated_strings", """
WITH body AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    strings AS (SELECT doc_id, s, md5(substr(h, 2 * s + 1, 200)) AS x FROM (SELECT doc_id, h, unnest(range(len(h) // 2 - 99)) AS s FROM body)),
    again AS (SELECT doc_id, s FROM strings QUALIFY row_number() OVER (PARTITION BY x ORDER BY doc_id, s) > 1),
    runs AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS r FROM (
        SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS fresh FROM again)),
    spans AS (SELECT doc_id, min(s) AS lo, max(s) + 100 AS hi FROM runs GROUP BY doc_id, r),
    cut AS (SELECT doc_id, list(lo ORDER BY lo) AS lows, list(hi ORDER BY lo) AS highs FROM spans GROUP BY doc_id),
    joined AS (SELECT doc_id, h, len(h) // 2 AS n, coalesce(lows, []) AS lows, coalesce(highs, []) AS highs FROM body LEFT JOIN cut USING (doc_id))
SELECT doc_id, n AS n_bytes, (list_sum(highs) - list_sum(lows))::BIGINT AS n_removed_, len(lows) AS n_spans,
    sha256(unhex(array_to_string(list_transform(range(1, len(lows) + 2), lambda i: substr(h, 2 * list_prepend(0, highs)[i] + 1,
        2 * (list_append(lows, n)[i] - list_prepend(0, highs)[i]))), ''))) AS kept_sha256 FROM joined""".replace(
    "(list_sum(highs) - list_sum(lows))::BIGINT AS n_removed_", "coalesce(list_sum(highs) - list_sum(lows), 0)::BIGINT AS n_removed"))
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes that 100-byte strings repeat."""
    out = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op7_cube_mixing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the weights of their sources; words taken of each."""
    units = mixing.mixed(table(spark, sf_dir, "documents")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    times = F.col("whole") + (F.col("copy") <= F.col("drawn")).cast("long")
    return units.select(F.col("id").alias("doc_id"), "size", "source", "source_size", "target", (F.col("size") * times).alias("taken"))


_LINES = "CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END"
_BARE = "trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12))"


@query("op8_line_dedup", f"""
WITH all_lines AS (SELECT source, unnest(list_transform({_LINES}, lambda x: {_BARE})) AS line FROM documents WHERE source IS NOT NULL),
    common AS (SELECT list(line) AS bad FROM (SELECT line FROM all_lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= {SITES})),
    kept AS (SELECT doc_id, text, {_LINES} AS own, (SELECT coalesce(bad, []) FROM common) AS bad FROM documents),
    cut AS (SELECT doc_id, text, own, list_filter(own, lambda x: NOT list_contains(bad, {_BARE})) AS rest FROM kept)
SELECT doc_id, len(own) AS n_lines, len(own) - len(rest) AS n_removed,
    md5(CASE WHEN len(own) = len(rest) THEN text ELSE array_to_string(rest, chr(10)) END) AS clean_md5 FROM cut""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that ten or more sources share."""
    out = lines.without_boilerplate(table(spark, sf_dir, "documents"), sites=SITES)
    return out.select("doc_id", "n_lines", "n_removed", F.md5(F.encode("clean", "UTF-8")).alias("clean_md5"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


@query("op9_personal_data")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base spans, and those that the trees add."""
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        "doc_id", *(F.size(_of_kind(base, k)).cast("long").alias(f"n_{k}") for k in pii.KINDS),
        F.sha2(F.encode(_joined(base), "UTF-8"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


@query("op10_warc_archives", """
WITH hashed AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
    marked AS (SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        (((('0x' || substr(h, 10 * (i // 8) + 1, 10))::BIGINT >> (35 - 5 * (i % 8))::BIGINT) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
        max(page_id) OVER (PARTITION BY h) AS kept FROM hashed)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> kept THEN kept END AS refers_to FROM marked""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    return warc.archived_pages(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _digests(ids: Column) -> tuple[Column, Column]:
    return F.size(ids).cast("long"), F.sha2(F.encode(F.array_join(ids.cast("array<string>"), ","), "UTF-8"), 256)


@query("op12_byte_bpe")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the bytes that they decode to."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    out = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    n, digest = _digests(F.col("ids"))
    return out.select("doc_id", n.alias("n_tokens"), digest.alias("ids_sha256"),
                      F.sha2(bpe.decode(F.col("ids"), ranks), 256).alias("decoded_sha256"))


def _sql_rounds() -> str:
    """Tables b0 to b4 of codebook entries (p, e, j, c) and a1 to a5 of nearest entries (id, p, e, d)."""
    out = []
    for k in range(1, codes.ROUNDS + 2):
        out.append(f"""d{k} AS (SELECT x.id, x.p, b.e, sum((x.x - b.c) * (x.x - b.c))::BIGINT AS d FROM parts x JOIN b{k - 1} b USING (p, j) GROUP BY ALL),
    a{k} AS (SELECT id, p, min(d * 256 + e) % 256 AS e, min(d) AS d FROM d{k} GROUP BY id, p)""")
        if k <= codes.ROUNDS:
            out.append(f"""s{k} AS (SELECT p, e, j, floor(sum(x)::DOUBLE / count(*))::BIGINT AS c FROM parts JOIN a{k} USING (id, p) GROUP BY p, e, j),
    b{k} AS (SELECT p, e, j, coalesce(s.c, b.c) AS c FROM b{k - 1} b LEFT JOIN s{k} s USING (p, e, j))""")
    return ",\n    ".join(out)


@query("op11_vector_codes", f"""
WITH kept AS (SELECT vec_id AS id, label, embedding AS v FROM embeddings WHERE embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    flat AS (SELECT id, unnest(v) AS x, unnest(range(len(v))) AS i, len(v) // {codes.PARTS} AS w FROM kept),
    parts AS (SELECT id, i // w AS p, i % w AS j, floor({codes.SCALE} * x::DOUBLE)::BIGINT AS x FROM flat),
    first AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS e FROM kept ORDER BY id LIMIT {codes.ENTRIES}),
    b0 AS (SELECT p, e, j, x AS c FROM parts JOIN first USING (id)), {_sql_rounds()},
    coded AS (SELECT id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{codes.ROUNDS + 1} GROUP BY id),
    books AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM b{codes.ROUNDS})
SELECT id AS vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (id), books""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors by product codebooks, their errors, and the error of each label."""
    rows, books = codes.compressed(table(spark, sf_dir, "embeddings"))
    rows = checkpoint(rows)
    totals = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    code = F.lower(F.array_join(F.transform("codes", lambda c: F.lpad(F.hex(c), 2, "0")), ""))
    return rows.join(totals, F.col("label").eqNullSafe(F.col("of")), "left").select(
        "vec_id", code.alias("code"), "error", "label_error", F.lit(codes.digest(books)).alias("codebooks_sha256"))


@query("op13_conversation_trie", f"""
WITH RECURSIVE steps AS (SELECT k, k AS v, 0 AS n FROM range(256) t(k)
        UNION ALL SELECT k, CASE WHEN v % 2 = 1 THEN xor(3988292384, v // 2) ELSE v // 2 END, n + 1 FROM steps WHERE n < 8),
    crc AS (SELECT list(v ORDER BY k) AS crcs FROM steps WHERE n = 8),
    said AS (SELECT conv_id AS c, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
    own AS (SELECT c, list(key ORDER BY turn NULLS FIRST, key) AS keys, list(words ORDER BY turn NULLS FIRST, key) AS words FROM said GROUP BY c),
    borrow AS (SELECT c, keys, words, (xor(4294967295, {_CRC}) % 4)::BIGINT AS h FROM (SELECT *, c::VARCHAR AS t FROM own), crc),
    built AS (SELECT x.c, list_concat(coalesce(f.keys[1:x.h], []), x.keys[x.h + 1:]) AS keys, list_concat(coalesce(f.words[1:x.h], []), x.words[x.h + 1:]) AS words
        FROM borrow x LEFT JOIN own f ON f.c = x.c - x.c % 20),
    prefixes AS (SELECT c, d, array_to_string(keys[1:d], '') AS path, CASE WHEN d = 0 THEN 0 ELSE words[d] END AS words, d = len(keys) AS at_end
        FROM (SELECT *, unnest(range(len(keys) + 1)) AS d FROM built)),
    nodes AS (SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
        sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE at_end), '')) AS ends_sha256 FROM prefixes GROUP BY path, d),
    kids AS (SELECT substr(path, 1, 32 * d - 32) AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
    own_sums AS (SELECT path, d, n_children IS NULL AS leaf, (n_convs - 1) * words AS saved FROM nodes LEFT JOIN kids USING (path)),
    sums AS (SELECT substr(path, 1, 32 * k) AS path, sum(leaf::INT)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens
        FROM (SELECT *, unnest(range(d + 1)) AS k FROM own_sums) GROUP BY 1)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes p ON n.d > 0 AND p.path = substr(n.path, 1, 32 * n.d - 32) LEFT JOIN kids k ON k.path = n.path JOIN sums s ON s.path = n.path""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefixes of the rebuilt conversations, with members, children, leaves and tokens saved."""
    return tries.prefix_trie(table(spark, sf_dir, "conversations"))
