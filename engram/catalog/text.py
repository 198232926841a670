"""Catalogue: privacy, identity, model replies, sources, documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.catalog.facts import SINGULAR_SQL
from engram.catalog.iterative import sql_chunks
from engram.catalog.registry import query
from engram.catalog.tables import key_id, now, sql_cosine, sql_key_id, sql_trim, sql_uuid3, table, vectors
from engram.functions import text as X
from engram.operators import documents as D
from engram.operators import graph as G
from engram.operators import scope as S
from engram.operators import search as V
from engram.plans.consolidate import resolve_relations
from engram.schemas import EXTRACTED_FACTS
from engram.session import checkpoint, work_dir
from engram.sources.vector_index import VectorIndex

# fixed values: the patterns of personal data
_PHONE = r"\+?\d{1,4}?[-.\s]?\(?\d{1,3}?\)?[-.\s]?\d{1,4}[-.\s]?\d{1,4}[-.\s]?\d{1,9}"
_EMAIL = r"(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"
_IP = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"


def _scrub_sql(table_name: str, key: str, column: str) -> str:
    return f"""
WITH a AS (SELECT {key}, regexp_replace(regexp_replace({column}, '{_EMAIL}', '[EMAIL_REDACTED]', 'g'), '{_IP}', '[IP_REDACTED]', 'g') AS t FROM {table_name}),
b AS (SELECT {key}, string_split_regex(t, '{_PHONE}') AS pieces, regexp_extract_all(t, '{_PHONE}') AS found FROM a)
SELECT {key}, array_to_string([pieces[i] || CASE WHEN i > len(found) THEN ''
    WHEN length(regexp_replace(found[i], '[^0-9]', '', 'g')) >= 7 THEN '[PHONE_REDACTED]' ELSE found[i] END
    FOR i IN range(1, len(pieces) + 1)], '') AS clean FROM b
"""


@query("scrub_documents", _scrub_sql("documents", "doc_id", "text"))
def scrub_documents(spark, sf_dir):
    """Document texts without e-mail addresses, IP addresses and phone numbers."""
    return table(spark, sf_dir, "documents").select("doc_id", X.scrub(F.col("text")).alias("clean"))


@query("scrub_pages", _scrub_sql("pages", "page_id", "html"))
def scrub_pages(spark, sf_dir):
    """Pages without personal data."""
    return table(spark, sf_dir, "pages").select("page_id", X.scrub(F.col("html")).alias("clean"))


@query("scrub_messages", _scrub_sql(
    "(SELECT conv_id * 100 + turn AS k, text || ' call +1-555-0199 or (555) 123-4567 at 10.0.0.' || turn "
    "|| ', mail a.b' || turn || '@Ex-ample.ORG_x@y.io' AS text FROM conversations)", "k", "text"))
def scrub_messages(spark, sf_dir):
    """Messages, each with personal data added, after scrubbing."""
    turn = F.col("turn").cast("string")
    rows = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("k"),
        F.concat(
            "text", F.lit(" call +1-555-0199 or (555) 123-4567 at 10.0.0."), turn,
            F.lit(", mail a.b"), turn, F.lit("@Ex-ample.ORG_x@y.io"),
        ).alias("text"),
    )
    return rows.select("k", X.scrub(F.col("text")).alias("clean"))


_ATTRIBUTE_SQL = """CASE p_partkey % 10 WHEN 0 THEN 'former_job' WHEN 1 THEN 'Wish_List' WHEN 2 THEN 'hobby'
  WHEN 3 THEN 'allergy_nuts' WHEN 4 THEN 'user_name' WHEN 5 THEN 'visited_city' WHEN 6 THEN 'x_history'
  WHEN 7 THEN 'preferred_language' WHEN 8 THEN 'histories' ELSE p_name END"""


@query("is_singular", f"SELECT p_partkey, {SINGULAR_SQL.format(_ATTRIBUTE_SQL)} AS singular FROM part")
def is_singular(spark, sf_dir):
    """Which attributes hold one value at a time."""
    names = (
        "former_job", "Wish_List", "hobby", "allergy_nuts", "user_name", "visited_city",
        "x_history", "preferred_language", "histories",
    )
    step = F.pmod(F.col("p_partkey"), F.lit(10))
    attribute = F.col("p_name")
    for number, name in enumerate(names):
        attribute = F.when(step == number, name).otherwise(attribute)
    return table(spark, sf_dir, "part").select("p_partkey", X.is_singular(attribute).alias("singular"))


@query("self_alias", f"""
SELECT conv_id, turn, lower({sql_trim("'  ' || upper(role) || chr(9)")}) IN ('user', 'subject', 'speaker', 'assistant') AS is_self FROM conversations
""")
def self_alias(spark, sf_dir):
    """Names that mean the speaker (here also the sender, assistant)."""
    name = F.concat(F.lit("  "), F.upper("role"), F.lit("\t"))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", X.is_self_alias(name, F.lit(" Assistant")).alias("is_self")
    )


@query("uuid3_ids", f"SELECT p_partkey, {sql_uuid3('lower(trim(p_name))')} AS id FROM part")
def uuid3_ids(spark, sf_dir):
    """Entity ids out of names."""
    return table(spark, sf_dir, "part").select("p_partkey", X.uuid3(F.lower(F.trim("p_name"))).alias("id"))


@query("valid_ids", f"""
SELECT o_orderkey FROM orders WHERE regexp_matches(
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE {sql_key_id('order-', 'o_orderkey')} END,
  '^[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}$')
""")
def valid_ids(spark, sf_dir):
    """Rows whose id is a UUID."""
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.pmod("o_orderkey", F.lit(3)) == 0, F.col("o_orderkey").cast("string"))
        .otherwise(key_id("order-", "o_orderkey")).alias("id"),
    )
    return S.with_valid_ids(rows, "id").select("o_orderkey")


@query("json_extract", """
SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events
""")
def json_extract(spark, sf_dir):
    """A field of the JSON properties, fenced as a model reply."""
    reply = F.concat(F.lit(" ```json\n"), "props", F.lit("\n``` "))
    decoded = X.decode_reply(reply, "struct<k:bigint>")
    return table(spark, sf_dir, "events").select("event_id", decoded["k"].alias("k"))


@query("fact_replies", """
SELECT event_id, event_type AS attribute, CAST(value AS VARCHAR) AS val, 0.5 AS confidence_score FROM events WHERE event_id % 6 IN (0, 1)
""")
def fact_replies(spark, sf_dir):
    """Facts in model replies; blank, empty and broken replies give none, nor do those with one field of a wrong type."""
    item = [F.lit('{"attribute": "'), "event_type", F.lit('", "value": "'), F.col("value").cast("string"), F.lit('", "confidence_score": 0.5}')]
    body = F.concat(F.lit("["), *item, F.lit("]"))
    step = F.pmod(F.col("event_id"), F.lit(6))
    reply = (
        F.when(step == 0, body).when(step == 1, F.concat(F.lit("```\n"), body, F.lit("```")))
        .when(step == 2, " [] ").when(step == 3, F.concat(F.lit("["), *item, F.lit(', {"attribute": "age", "value": 5}]')))
        .when(step == 4, F.replace(body, F.lit("0.5}"), F.lit('"high"}'))).otherwise(F.concat(F.lit("I cannot say: "), "event_type"))
    )
    facts = table(spark, sf_dir, "events").select(
        "event_id", F.explode(X.decode_reply(reply, EXTRACTED_FACTS)).alias("f")
    ).filter(F.col("f.attribute").isNotNull())
    return facts.select(
        "event_id", F.col("f.attribute").alias("attribute"), F.col("f.value").alias("val"),
        F.col("f.confidence_score").alias("confidence_score"),
    )


_ENDS_SQL = f"""
said AS (
  SELECT CAST(conv_id AS VARCHAR) AS entity_id, role AS sender, upper({sql_trim("' is near' || turn % 3 || ' '")}) AS rel_type,
    CASE turn % 4 WHEN 0 THEN 'User ' WHEN 1 THEN '' WHEN 2 THEN ' Alice' ELSE 'Bob' END AS source,
    CASE turn % 5 WHEN 4 THEN upper(role) ELSE regexp_extract(text, '[A-Za-z]+') END AS target FROM conversations),
keyed AS (SELECT *, lower({sql_trim('source')}) AS s, lower({sql_trim('target')}) AS t, lower({sql_trim('sender')}) AS me FROM said),
ends AS (SELECT *, s IN ('', 'user', 'subject', 'speaker', me) AS own_s, t IN ('user', 'subject', 'speaker', me) AS own_t FROM keyed WHERE t <> '')"""


@query("relation_replies", f"""
WITH {_ENDS_SQL}
SELECT CASE WHEN own_s THEN entity_id ELSE {sql_uuid3('s')} END AS source_id, CASE WHEN own_t THEN entity_id ELSE {sql_uuid3('t')} END AS target_id,
  rel_type, CASE WHEN NOT own_s THEN source END AS source_name, CASE WHEN NOT own_t THEN target END AS target_name, entity_id AS agent_owner, sender
FROM ends
""")
def relation_replies(spark, sf_dir):
    """Edges out of model replies: aliases mean the speaker, other names become ids, blank targets go."""
    turn = F.col("turn")
    source = F.when(turn % 4 == 0, "User ").when(turn % 4 == 1, "").when(turn % 4 == 2, " Alice").otherwise("Bob")
    target = F.when(turn % 5 == 4, F.upper("role")).otherwise(F.regexp_extract("text", "[A-Za-z]+", 0))
    reply = F.concat(F.lit("```json"), F.to_json(F.array(F.struct(
        source.alias("source_entity"), target.alias("target_entity"),
        F.concat(F.lit(" is near"), turn % 3, F.lit(" ")).alias("relation_type"), F.lit(0.9).alias("confidence"),
    ))), F.lit("```"))
    texts = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("entity_id"), F.col("role").alias("sender"), now().alias("timestamp"), reply.alias("reply"))
    return resolve_relations(texts, F.col("reply")).drop("valid_from")


_URL_SQL = "CASE page_id % 3 WHEN 0 THEN url || '.PDF?x=1' WHEN 1 THEN 'https://docs.google.com/document/d/a-B_' || page_id || '/edit?u=' || url ELSE url END"


def _urls(spark, sf_dir):
    step = F.pmod(F.col("page_id"), F.lit(3))
    url = (
        F.when(step == 0, F.concat("url", F.lit(".PDF?x=1")))
        .when(step == 1, F.concat(
            F.lit("https://docs.google.com/document/d/a-B_"), F.col("page_id").cast("string"),
            F.lit("/edit?u="), "url"))
        .otherwise(F.col("url"))
    )
    return table(spark, sf_dir, "pages").select("page_id", url.alias("link"))


@query("source_type", f"""
SELECT page_id, CASE WHEN contains(link, 'docs.google.com') THEN 'google_docs'
  WHEN lower(string_split(link, '?')[1]) LIKE '%.pdf' THEN 'pdf' ELSE 'web_page' END AS source_type,
  nullif(regexp_extract(link, '/document/d/([a-zA-Z0-9-_]+)', 1), '') AS google_doc
FROM (SELECT page_id, {_URL_SQL} AS link FROM pages)
""")
def source_type(spark, sf_dir):
    """Kind of each link, and the document id of a shared document."""
    return _urls(spark, sf_dir).select(
        "page_id", X.source_type(F.col("link")).alias("source_type"),
        X.google_doc_id(F.col("link")).alias("google_doc"),
    )


@query("file_type", """
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'markdown' WHEN 2 THEN 'markdown' END AS file_type FROM documents
""")
def file_type(spark, sf_dir):
    """Kind of each uploaded file by its name."""
    step = F.pmod(F.col("doc_id"), F.lit(5))
    suffix = (
        F.when(step == 0, ".PDF").when(step == 1, ".md").when(step == 2, ".x.Markdown")
        .when(step == 3, ".txt").otherwise("")
    )
    name = F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), suffix)
    return table(spark, sf_dir, "documents").select("doc_id", X.file_type(name).alias("file_type"))


@query("document_lookup", """
SELECT doc_id, lang, n_chars FROM documents WHERE doc_id = (SELECT max(doc_id) FROM documents)
""")
def document_lookup(spark, sf_dir):
    """One document by its id."""
    documents = table(spark, sf_dir, "documents")
    wanted = documents.agg(F.max("doc_id")).first()[0]
    return documents.filter(F.col("doc_id") == wanted).select("doc_id", "lang", "n_chars")


@query("page_counts", """
WITH t AS (SELECT doc_id, replace(text, '. ', chr(12)) AS t FROM documents)
SELECT doc_id, CASE WHEN n = 0 AND t <> '' THEN 1 ELSE n END AS pages FROM (SELECT *, length(t) - length(replace(t, chr(12), '')) AS n FROM t)
""")
def page_counts(spark, sf_dir):
    """Pages of texts with form feeds, here put in for sentence ends."""
    feeds = F.replace(F.col("text"), F.lit(". "), F.lit("\f"))
    return table(spark, sf_dir, "documents").select("doc_id", X.page_count(feeds).alias("pages"))


@query("trim_texts", f"SELECT doc_id, {sql_trim('text')} AS t FROM documents")
def trim_texts(spark, sf_dir):
    """Texts without surrounding white space."""
    return table(spark, sf_dir, "documents").select("doc_id", X.trim_space(F.col("text")).alias("t"))


@query("topic_links", f"""
WITH tags AS (SELECT doc_id, {sql_trim('unnest(string_split(text, chr(44)))')} AS tag FROM documents)
SELECT DISTINCT {sql_key_id('document-', 'doc_id')} AS src, {sql_uuid3("('topic-' || tag)")} AS dst FROM tags WHERE tag <> ''
""")
def topic_links(spark, sf_dir):
    """Links from documents to topics, the comma-separated parts of the texts."""
    parsed = table(spark, sf_dir, "documents").select(
        key_id("document-", "doc_id").alias("document_id"),
        F.create_map(F.lit("tags"), F.col("text")).alias("metadata"),
    )
    return D.topic_links(parsed)[0].select("src", "dst")


@query("author_links", f"""
SELECT DISTINCT {sql_uuid3("('author-' || source)")} AS src, {sql_key_id('document-', 'doc_id')} AS dst FROM documents WHERE source <> ''
""")
def author_links(spark, sf_dir):
    """Links from authors, here the sources, to documents."""
    parsed = table(spark, sf_dir, "documents").select(
        key_id("document-", "doc_id").alias("document_id"),
        F.create_map(F.lit("author"), F.col("source")).alias("metadata"),
    )
    return D.author_links(parsed)[0].select("src", "dst")


def _chunks(spark, sf_dir):
    parsed = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("document_id"), "text",
        F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"),
    )
    return D.chunk_documents(parsed)


_CHUNKS_SQL = f"""
WITH {sql_chunks("SELECT doc_id AS k, text AS t FROM documents")},
named AS (SELECT *, {sql_uuid3("(k::VARCHAR || '#' || chunk_index::VARCHAR)")} AS id FROM chunks)"""


@query("chunk_documents", f"""{_CHUNKS_SQL}
SELECT id, k::VARCHAR AS document_id, chunk_index, content, lang FROM named JOIN documents ON doc_id = k
""")
def chunk_documents(spark, sf_dir):
    """Overlapping chunks of all documents."""
    return _chunks(spark, sf_dir).select(
        "id", "document_id", "chunk_index", "content", F.col("metadata")["lang"].alias("lang")
    )


@query("provenance_lineage", f"""{_CHUNKS_SQL}
SELECT {sql_uuid3("('fact-' || id)")} AS id, id AS chunk_id, k::VARCHAR AS document_id, chunk_index FROM named
""")
def provenance_lineage(spark, sf_dir):
    """Facts read off chunks, with the document and chunk they come from."""
    chunks = checkpoint(_chunks(spark, sf_dir).select("id", "document_id", "chunk_index"))
    facts = chunks.select(
        X.uuid3(F.concat(F.lit("fact-"), "id")).alias("id"), F.col("id").alias("chunk_id"), "document_id"
    )
    links = facts.select(
        F.lit("EXTRACTED_FROM").alias("kind"), F.col("id").alias("src"), F.col("document_id").alias("dst")
    ).unionByName(facts.select(
        F.lit("MENTIONED_IN").alias("kind"), F.col("id").alias("src"), F.col("chunk_id").alias("dst")
    ))
    return G.lineage(facts.select("id"), links, chunks)


def _sql_plain(html: str) -> str:
    bare = f"regexp_replace({html}, '<[^>]*>', '', 'g')"
    for entity, sign in (("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&amp;?", "&")):
        bare = f"regexp_replace({bare}, '{entity}', '{sign}', 'g')"
    return sql_trim(bare)


# pages here hold one article, a heading and paragraphs whose ends may be missing
@query("parse_pages", f"""
WITH cut AS (
  SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS head, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS h1,
         string_split(regexp_extract(html, '(?s)</h1>(.*)</article>', 1), '<p>') AS ps FROM pages),
bare AS (SELECT page_id, {_sql_plain('head')} AS title, {_sql_plain('h1')} AS h1,
                list_filter(list_transform(ps, lambda x: {_sql_plain('x')}), lambda x: x <> '') AS ps FROM cut)
SELECT page_id, array_to_string(list_prepend('# ' || h1, ps), chr(10) || chr(10)) AS text, title, CAST(NULL AS VARCHAR) AS error FROM bare
""")
def parse_pages(spark, sf_dir):
    """Readable text and title of all pages."""
    sources = table(spark, sf_dir, "pages").select(
        "page_id", "url", F.lit("web_page").alias("source_type"), F.encode("html", "UTF-8").alias("content")
    )
    parsed = D.parse_documents(sources)
    return parsed.select("page_id", "text", F.col("metadata")["title"].alias("title"), "error")


@query("parse_markdown", f"""
SELECT doc_id, {sql_trim('text')} AS text, lang, source FROM documents
""")
def parse_markdown(spark, sf_dir):
    """Documents given front matter, parsed back as Markdown."""
    front = F.concat(
        F.lit("---\nlang: "), "lang", F.lit("\nsource: \""), "source", F.lit("\"\n---\n"), "text"
    )
    sources = table(spark, sf_dir, "documents").select(
        "doc_id", F.lit("markdown").alias("source_type"), F.encode(front, "UTF-8").alias("content")
    )
    return D.parse_documents(sources).select(
        "doc_id", "text", F.col("metadata")["lang"].alias("lang"), F.col("metadata")["source"].alias("source")
    )


# -- vectors -----------------------------------------------------------------

_SCORE = sql_cosine("e.embedding", "q.embedding")


def _first_vector(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()[0]


@query("vector_topk", f"""
WITH q AS (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)
SELECT vec_id, round({_SCORE}, 6) AS score FROM embeddings e, q ORDER BY {_SCORE} DESC, CAST(vec_id AS VARCHAR) LIMIT 10
""")
def vector_topk(spark, sf_dir):
    """The ten vectors nearest to the first one."""
    found = V.top_k(vectors(spark, sf_dir), _first_vector(spark, sf_dir), 10)
    return found.select("vec_id", F.round("score", 6).alias("score"))


@query("vector_topk_batch", f"""
WITH q AS (SELECT label AS query_id, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label),
scored AS (SELECT query_id, vec_id, {_SCORE} AS score FROM embeddings e, q)
SELECT CAST(query_id AS VARCHAR) AS query_id, CAST(vec_id AS VARCHAR) AS id, round(score, 6) AS score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(vec_id AS VARCHAR)) <= 10
""")
def vector_topk_batch(spark, sf_dir):
    """The ten nearest vectors of one query per label."""
    queries = table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("query_id")).agg(
        F.min_by("embedding", "vec_id").alias("embedding")
    )
    found = V.top_k_per_query(vectors(spark, sf_dir), queries, 10)
    return found.select("query_id", "id", F.round("score", 6).alias("score"))


@query("vector_index_topk", f"""
WITH q AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 20 = 0),
scored AS (SELECT query_id, vec_id, {_SCORE} AS score FROM embeddings e, q)
SELECT CAST(query_id AS VARCHAR) AS query_id, CAST(vec_id AS VARCHAR) AS id, round(score, 6) AS score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(vec_id AS VARCHAR)) <= 10
""")
def vector_index_topk(spark, sf_dir):
    """The ten nearest vectors to every twentieth one, by an index of all vectors with every cell probed."""
    index = VectorIndex.create(spark, f"{work_dir(spark)}/index", vectors(spark, sf_dir))
    queries = table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = index.top_k_per_query(queries, 10)
    return found.select("query_id", "id", F.round("score", 6).alias("score"))


@query("chunk_search", f"""
WITH q AS (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1),
placed AS (SELECT doc_id, left(text, 40) AS content, e.embedding FROM documents
           JOIN embeddings e ON vec_id = doc_id % (SELECT count(*) FROM embeddings)),
scored AS (SELECT doc_id, content, {_SCORE} AS score FROM placed e, q)
SELECT CAST(doc_id AS VARCHAR) AS id, content, round(score, 6) AS score FROM scored
ORDER BY scored.score DESC, CAST(doc_id AS VARCHAR) LIMIT 20
""")
def chunk_search(spark, sf_dir):
    """The 20 chunks nearest to a question, one chunk per document, with their true cosine, through the store."""
    held = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = held.count()
    chunks = table(spark, sf_dir, "documents").join(held, F.pmod("doc_id", F.lit(n)) == F.col("vec_id")).select(
        F.col("doc_id").cast("string").alias("id"), F.col("doc_id").cast("string").alias("document_id"),
        F.lit(0).alias("chunk_index"), F.left("text", F.lit(40)).alias("content"), "embedding")
    found = V.search_chunks(chunks, _first_vector(spark, sf_dir), 20)
    return found.select("id", "content", F.round("score", 6).alias("score"))


@query("vector_postfilter", f"""
WITH q AS (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1),
pool AS (SELECT vec_id, label, {_SCORE} AS score FROM embeddings e, q ORDER BY score DESC, CAST(vec_id AS VARCHAR) LIMIT 100)
SELECT vec_id, round(score, 6) AS score FROM pool WHERE label = 3 ORDER BY pool.score DESC, CAST(vec_id AS VARCHAR) LIMIT 5
""")
def vector_postfilter(spark, sf_dir):
    """Of the hundred nearest vectors the first five with one label."""
    found = V.post_filtered_top_k(
        vectors(spark, sf_dir), _first_vector(spark, sf_dir), F.col("label") == 3, 5
    )
    return found.select("vec_id", F.round("score", 6).alias("score"))


@query("search_hybrid_vector", f"""
WITH q AS (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1),
pool AS (SELECT e.*, {_SCORE} AS score FROM embeddings e, q ORDER BY score DESC, CAST(vec_id AS VARCHAR) LIMIT 100),
kept AS (SELECT * FROM pool WHERE vec_id % 3 = 0 OR label = 2 ORDER BY score DESC, CAST(vec_id AS VARCHAR) LIMIT 20),
aged AS (SELECT vec_id, exp(-(label * 20.0) / (30.0)) AS strength FROM kept)
SELECT CAST(vec_id AS VARCHAR) AS id, round(strength, 6) AS memory_strength FROM aged WHERE strength >= 0.1
""")
def search_hybrid_vector(spark, sf_dir):
    """Nearest active facts one owner sees, decayed by the age of their label."""
    from engram.operators.facts import search_hybrid

    label = F.col("label")
    facts = vectors(spark, sf_dir).select(
        "id", "embedding", F.lit(30.0).alias("stability"),
        (now() - F.make_dt_interval(label * 20)).alias("last_accessed"),
        F.lit(None).cast("timestamp").alias("valid_until"), F.lit(1.0).alias("memory_strength"),
        F.when(F.pmod("vec_id", F.lit(3)) == 0, F.lit(None).cast("string"))
        .otherwise(label.cast("string")).alias("agent_owner"),
    )
    found = search_hybrid(facts, now(), viewer="2", vector=_first_vector(spark, sf_dir), limit=20).facts
    return found.select("id", F.round("memory_strength", 6).alias("memory_strength"))


@query("quantise", """
SELECT vec_id, array_to_string([CAST(CAST(round(CAST(x AS DOUBLE), 6) * 1000000 AS BIGINT) AS VARCHAR) FOR x IN embedding], ',') AS q FROM embeddings
""")
def quantise(spark, sf_dir):
    """Vectors as written out, in millionths."""
    from engram.functions.vectors import quantise as rounded

    written = F.transform(
        rounded(F.col("embedding")),
        lambda x: F.round(x.cast("double") * 1000000).cast("long").cast("string"),
    )
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(written, ",").alias("q"))


@query("semantic_cache", f"""
WITH asked AS (SELECT vec_id, label, [CASE WHEN i = 1 THEN CAST(x AS DOUBLE) + 0.33 ELSE CAST(x AS DOUBLE) END FOR x, i IN embedding] AS embedding FROM embeddings),
held AS (SELECT * FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) <= 1000),
pairs AS (SELECT q.vec_id AS query_id, e.vec_id AS entry, q.label, {_SCORE} AS score FROM asked q JOIN held e ON q.label = e.label),
best AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry) = 1)
SELECT query_id, CAST(label AS VARCHAR) AS owner, round(score, 6) AS score, entry AS entry_seq, 'answer ' || entry AS response
FROM best WHERE score >= 0.95
""")
def semantic_cache(spark, sf_dir):
    """Cached answers for every vector, asked again slightly moved, within its owner."""
    rows = table(spark, sf_dir, "embeddings").withColumn("owner", F.col("label").cast("string"))
    cache = rows.select(
        "owner", F.col("vec_id").alias("seq"), F.concat(F.lit("answer "), "vec_id").alias("response"), "embedding"
    )
    moved = F.transform(
        "embedding", lambda x, i: F.when(i == 0, x.cast("double") + 0.33).otherwise(x.cast("double"))
    )
    queries = rows.select(F.col("vec_id").alias("query_id"), "owner", moved.alias("embedding"))
    return V.cache_lookup(cache, queries).withColumn("score", F.round("score", 6))


@query("cache_newest", """
SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn <= 30
""")
def cache_newest(spark, sf_dir):
    """What a cache bounded to 30 entries per owner holds."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("owner"), F.col("event_id").alias("seq"))
    return V.newest_entries(rows, 30).select(F.col("owner").alias("user_id"), F.col("seq").alias("event_id"))


@query("context_union", f"""
WITH q AS (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1),
near AS (SELECT vec_id FROM embeddings e, q ORDER BY {_SCORE} DESC, CAST(vec_id AS VARCHAR) LIMIT 100)
SELECT 'document_chunk' AS attribute, '[Source: ' || coalesce(nullif(lang, ''), 'Document') || '] ' || text AS val, 'document' AS source_agent, true AS from_document
FROM documents WHERE doc_id IN (SELECT vec_id FROM near)
UNION ALL
SELECT 'macro_narrative', '[Macro Narrative Summary: ' || n_name || '] ' || r_name, 'community_graphrag', false FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL
SELECT 'graph_relation', 'Graph Relation: ' || o_custkey || ' is linked to ' || o_orderkey || ' via ' || o_orderpriority, NULL, false FROM orders
""")
def context_union(spark, sf_dir):
    """Chunks, summaries and relations as one list of context facts."""
    from engram.plans.chat import as_chunk_facts, as_relation_facts, as_summary_facts

    near = V.top_k(vectors(spark, sf_dir), _first_vector(spark, sf_dir), 100).select(F.col("vec_id").alias("doc_id"))
    chunks = table(spark, sf_dir, "documents").join(near, "doc_id").select(
        F.col("doc_id").cast("string").alias("id"), F.create_map(F.lit("title"), F.col("lang")).alias("metadata"),
        F.col("text").alias("content"),
    )
    summaries = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), F.col("r_name").alias("summary"))
    edges = table(spark, sf_dir, "orders").select(
        X.relation_text(
            F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"), F.col("o_orderpriority")
        ).alias("statement")
    )
    both = as_chunk_facts(chunks).unionByName(as_summary_facts(summaries)).unionByName(as_relation_facts(edges))
    return both.select(
        "attribute", "val", "source_agent",
        S.from_document(F.col("source_agent"), F.col("attribute")).alias("from_document"),
    )
