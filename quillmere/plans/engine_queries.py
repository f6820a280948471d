"""Queries for jobs, conversations, logs, concept tables, vectors, ingestion phases, and the steps of a query."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmere.config import DEFAULT
from quillmere.functions import prompts as P
from quillmere.functions import text as X
from quillmere.operators import concepts, hierarchy, jobs, search, store, vector_index
from quillmere.plans import ingest, retrieval
from quillmere.plans.registry import TABLES_SQL, query
from quillmere.plans.search_queries import pool
from quillmere.plans.text_queries import CHAIN
from quillmere.session import exists, scratch_path, stamp, table
from quillmere.session import store as store_rows
from quillmere.sources import fixtures as fx
from quillmere.sources import readers

L = F.lit


# ---- scans and rows


@query("scan_by_source_node", "SELECT id, source_order FROM u WHERE source_node_id = 'src0'", units=True)
def scan_by_source_node(spark, d):
    return fx.units(spark, d).where("source_node_id = 'src0'").select("id", "source_order")


@query("scan_status_limit", "SELECT id, page, source_order FROM u WHERE status = 'metadata_done' ORDER BY page, source_order, id LIMIT 20", units=True)
def scan_status_limit(spark, d):
    return fx.units(spark, d).where("status = 'metadata_done'").orderBy("page", "source_order", "id").limit(20).select("id", "page", "source_order")


@query("parent_first_fallback", """WITH c AS (SELECT u.*, p.status IS NULL OR p.status <> 'summary_done' AS ready FROM u LEFT JOIN u p ON p.id = u.parent_unit_id WHERE u.status = 'summary_done'),
e AS (SELECT *, bool_or(ready) OVER (PARTITION BY page) AS any_ready FROM c) SELECT page, id, ready FROM e WHERE ready OR NOT any_ready QUALIFY row_number() OVER (PARTITION BY page ORDER BY source_order, id) <= 1""", units=True)  # fmt: skip
def parent_first_fallback(spark, d):
    return jobs.parent_first(fx.units(spark, d), "summary_done", 1).select("page", "id", "ready")


@query("row_decode", "SELECT id, array_to_string(section, '/') AS section, array_to_string(defines, '/') AS defines, CASE WHEN page % 7 = 0 THEN '' ELSE name END AS name FROM u", units=True)
def row_decode(spark, d):
    u = fx.units(spark, d)
    stored = u.select("id", F.to_json("section").alias("section_json"), F.to_json("metadata").alias("metadata_json"), F.when(F.col("page") % 7 != 0, F.col("name")).alias("name"))
    row = readers.decode_units(stored)
    return row.select("id", F.array_join("section", "/").alias("section"), F.array_join("metadata.defines", "/").alias("defines"), "name")


@query("strict_strings", "SELECT doc_id, 'a,' || lang AS kept, CAST(0 AS INTEGER) AS from_object FROM documents")
def strict_strings(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.concat(L('["a", 1, null, {"x": "y"}, "'), "lang", L('", true]')).alias("j"))
    return t.select("doc_id", F.array_join(X.only_strings(F.col("j")), ",").alias("kept"), F.size(X.only_strings(L('{"a": "b"}'))).alias("from_object"))


@query("object_round_trip", "SELECT page_id, octet_length(encode(coalesce(html, ''))) AS bytes, sha256(coalesce(html, '')) AS content_hash, length(to_base64(encode(coalesce(html, '')))) AS b64 FROM pages WHERE page_id % 5 <> 0")
def object_round_trip(spark, d):
    at = scratch_path(spark, "objects")
    pages = table(spark, d, "pages").select(F.concat(L("book/"), F.col("page_id").cast("string"), L(".png")).alias("key"), F.encode(F.coalesce("html", L("")), "UTF-8").alias("content"), "page_id")
    readers.put_objects(pages.select("key", "content"), at)
    readers.delete_objects(pages.where("page_id % 5 = 0").select("key").unionByName(spark.createDataFrame([("book/none.png",)], "key string")), at)
    return readers.page_images(spark, at).select(F.col("page").cast("long").alias("page_id"), "bytes", "content_hash", F.length("image").cast("long").alias("b64"))


@query("log_append_truncate", "SELECT event_type, 2 * count(*) AS n, cast(0 AS BIGINT) AS after FROM events GROUP BY 1")
def log_append_truncate(spark, d):
    at = scratch_path(spark, "log")
    e = table(spark, d, "events")
    for _ in range(2):
        jobs.append_log(e, f"{at}/log")
    kept = spark.read.parquet(f"{at}/log").groupBy("event_type").agg(F.count("*").alias("n")).join(e.select("event_type").distinct(), "event_type")
    jobs.append_log(e, f"{at}/other")
    jobs.truncate_log(e, f"{at}/other")
    left = spark.read.parquet(f"{at}/other").agg(F.count("*").alias("after"))
    return kept.crossJoin(F.broadcast(left))  # one row


@query("log_rollup", "SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds, count(*) FILTER (WHERE event_type = 'click') AS clicks FROM events GROUP BY 1")
def log_rollup(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds"), F.count_if(F.col("event_type") == "click").alias("clicks"))


@query("candidate_log_read", "SELECT event_id, user_id % 3 AS iteration, event_type AS stage FROM events WHERE user_id % 10 = 3 ORDER BY user_id % 3, event_type, ts, event_id LIMIT 60")
def candidate_log_read(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("user_id") % 10).alias("query_text"), (F.col("user_id") % 3).alias("iteration"), F.col("event_type").alias("stage"), "ts")
    return readers.candidate_log(e, 3, 60).select("event_id", "iteration", "stage")


# ---- writes


@query("structure_nodes", "SELECT source_node_id AS id, max(page) AS last_page, count(*) AS n FROM u GROUP BY 1", units=True)
def structure_nodes(spark, d):
    u = fx.units(spark, d)
    log = u.select(F.col("source_node_id").alias("id"), F.col("page").alias("last_page"), (F.col("page") * 10 + F.col("source_order")).alias("seq"))
    nodes = store.keep_latest(log, ["id"], "seq").select("id", "last_page")
    return nodes.join(u.select(F.col("source_node_id").alias("id")), "id").groupBy("id").agg(F.max("last_page").alias("last_page"), F.count("*").alias("n"))


@query("upsert_units", "SELECT id, CASE WHEN type = 'Image' THEN 'second' ELSE name END AS name, CASE WHEN type = 'Image' THEN 'pending' ELSE status END AS status, content_hash, array_to_string(section, '/') AS section FROM u", units=True)
def upsert_units(spark, d):
    u = fx.units(spark, d)
    again = u.where("type = 'Image'").withColumn("name", L("second")).withColumn("status", L("pending"))
    log = u.withColumn("seq", L(0)).unionByName(again.withColumn("seq", L(1)))
    return store.keep_latest(log, ["id"], "seq").select("id", "name", "status", "content_hash", F.array_join("section", "/").alias("section"))


@query("edit_refresh", "SELECT id, sha256(CASE WHEN type = 'Rule' THEN 'edited ' || content ELSE content END) AS content_hash, array_to_string(list_concat(defines, mentions), ' ') AS metadata_terms_text, CASE WHEN type = 'Rule' THEN '' ELSE id END AS subject_embedding_id FROM u", units=True)
def edit_refresh(spark, d):
    u = fx.units(spark, d).withColumn("subject_embedding_id", F.col("id")).withColumn("content_embedding_id", F.col("id"))
    changes = u.where("type = 'Rule'").select("id", F.concat(L("edited "), "content").alias("content"))
    return ingest.edit_units(u, changes, ["content"]).select("id", "content_hash", "metadata_terms_text", F.coalesce("subject_embedding_id", L("")).alias("subject_embedding_id"))


@query("job_states", """WITH t AS (SELECT source_node_id AS document_id, count(DISTINCT page) AS pages, count(*) AS units, count(DISTINCT page) + CASE WHEN source_node_id = 'src0' THEN 1 ELSE 0 END AS total_pages, list(DISTINCT status) AS have FROM u GROUP BY 1),
p AS (SELECT *, CASE WHEN pages < total_pages THEN 'vision' WHEN list_contains(have, 'pending') THEN 'summary' WHEN list_contains(have, 'summary_done') THEN 'metadata' WHEN list_contains(have, 'metadata_done') THEN 'embedding' WHEN list_contains(have, 'embedding_done') THEN 'concepts' ELSE 'done' END AS phase FROM t)
SELECT document_id, phase, CASE WHEN phase = 'done' THEN 'done' ELSE 'running' END AS status, pages AS pages_processed, units AS units_processed, total_pages FROM p""", units=True)  # fmt: skip
def job_states(spark, d):
    u = fx.units(spark, d).withColumn("document_id", F.col("source_node_id"))
    docs = u.groupBy("document_id").agg((F.count_distinct("page") + F.when(F.first("document_id") == "src0", 1).otherwise(0)).alias("total_pages"))
    first = jobs.started(docs)
    return jobs.latest(first.unionByName(jobs.advanced(first, u))).select("document_id", "phase", "status", "pages_processed", "units_processed", "total_pages")


@query("queued_pages", "SELECT document_id, cast(unnest(range(1, n + 1)) AS INTEGER) AS page FROM (SELECT source_node_id AS document_id, count(DISTINCT page) AS n FROM u GROUP BY 1)", units=True)
def queued_pages(spark, d):
    u = fx.units(spark, d)
    return jobs.queued_pages(u.groupBy(F.col("source_node_id").alias("document_id")).agg(F.count_distinct("page").alias("total_pages")))


@query("conversation_append", "SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT conv_id, max(turn) + 1, 'user', 'next' FROM conversations WHERE conv_id % 2 = 0 GROUP BY conv_id")
def conversation_append(spark, d):
    c = table(spark, d, "conversations")
    new = c.where("conv_id % 2 = 0").select("conv_id", L("user").alias("role"), L("next").alias("text")).distinct()
    return jobs.turns_of(jobs.appended(jobs.nested(c), new))


@query("cursor_pages", "SELECT id, cast(60 AS BIGINT) AS next_cursor, (SELECT count(*) FROM u) <= 60 AS done FROM u ORDER BY id LIMIT 20 OFFSET 40", units=True)
def cursor_pages(spark, d):
    return jobs.cursor_page(fx.units(spark, d).select("id"), 40, 20)


@query("preview_names", "SELECT source_node_id, string_agg(name, '; ' ORDER BY page, source_order) FILTER (WHERE n <= 10) || CASE WHEN max(n) > 10 THEN ' and ' || (max(n) - 10) || ' more' ELSE '' END AS preview FROM (SELECT *, row_number() OVER (PARTITION BY source_node_id ORDER BY page, source_order) AS n FROM u) GROUP BY 1", units=True)
def preview_names(spark, d):
    from pyspark.sql.window import Window

    u = fx.units(spark, d).select("source_node_id", "name", F.row_number().over(Window.partitionBy("source_node_id").orderBy("page", "source_order")).alias("n"), F.count("*").over(Window.partitionBy("source_node_id")).alias("all"))
    best = u.where("n <= 10").groupBy("source_node_id").agg(F.array_sort(F.collect_list(F.struct("n", "name"))).alias("x"), F.first("all").alias("all"))
    names = F.array_join(F.transform("x", lambda r: r["name"]), "; ")
    return best.select("source_node_id", F.concat(names, F.when(F.col("all") > 10, F.concat(L(" and "), (F.col("all") - 10).cast("string"), L(" more"))).otherwise("")).alias("preview"))


# ---- concept tables

CONCEPT = "'CONCEPT-' || substr(sha256(term), 1, 32)"


@query("concept_by_id", f"SELECT {CONCEPT} AS id, term AS canonical_name, count(*) AS n_mentions, count(DISTINCT unit_id) FILTER (WHERE mention_type = 'defines') AS n_defining FROM m WHERE term IN ('tion', 'ble') GROUP BY term", units=True)
def concept_by_id(spark, d):
    c, _, m = concepts.tables(fx.mentions(fx.units(spark, d)))
    wanted = spark.createDataFrame([("tion",), ("ble",), ("none",)], "term string").select(concepts.concept_id(F.col("term")).alias("id"))
    found = c.join(F.broadcast(wanted), "id", "left_semi")  # three rows
    return found.join(m.withColumnRenamed("concept_id", "id").drop("confidence"), "id").groupBy("id", "canonical_name").agg(F.count("*").alias("n_mentions"), F.count_distinct(F.when(F.col("mention_type") == "defines", F.col("unit_id"))).alias("n_defining"))


@query("concept_batches", f"SELECT {CONCEPT} AS concept_id, term AS normalized_alias, count(*) AS n_mentions, min(unit_id) AS first_unit, 0.8::DOUBLE AS confidence FROM m GROUP BY term", units=True)
def concept_batches(spark, d):
    m = fx.mentions(fx.units(spark, d))
    state = concepts.tables(m.where("doc_id % 2 = 0"))
    c, a, x = concepts.stored_batch(state, concepts.tables(m.where("doc_id % 2 = 1")))
    n = x.groupBy("concept_id").agg(F.count("*").alias("n_mentions"), F.min("unit_id").alias("first_unit"))
    return a.join(c.select(F.col("id").alias("concept_id")), "concept_id").join(n, "concept_id").select("concept_id", "normalized_alias", "n_mentions", "first_unit", "confidence")


@query("concept_by_alias", f"SELECT unit_id, term, {CONCEPT} AS concept_id FROM m WHERE mention_type = 'defines'", units=True)
def concept_by_alias(spark, d):
    m = fx.mentions(fx.units(spark, d))
    c, a, _ = concepts.tables(m)
    asked = m.where("mention_type = 'defines'").select("unit_id", "term", F.concat(L("  "), F.upper("term"), L(" ")).alias("raw"))
    return concepts.by_alias(asked, "raw", a).select("unit_id", "term", "concept_id")


@query("concept_overview", f"SELECT {CONCEPT} AS id, cast(1 AS BIGINT) AS alias_count, count(*) AS mention_count FROM m GROUP BY term", units=True)
def concept_overview(spark, d):
    return concepts.overview(*concepts.tables(fx.mentions(fx.units(spark, d)))).select("id", "alias_count", "mention_count")


DESCRIBED = """WITH k AS (SELECT m.*, u.page, u.source_order, u.content, CASE mention_type WHEN 'defines' THEN 0 ELSE 1 END AS kind FROM m JOIN u ON u.id = m.unit_id {where}), l AS (SELECT *, min(kind) OVER (PARTITION BY term) AS least FROM k),
n AS (SELECT term, unit_id, substr(content, 1, 500) AS part, row_number() OVER (PARTITION BY term ORDER BY page, source_order) AS n FROM l WHERE kind = least)
SELECT term, substr(substr(string_agg(part, chr(10) || '---' || chr(10) ORDER BY n), 1, 2000), 1, 240) AS description, string_agg(unit_id, ',' ORDER BY n) AS source_unit_ids FROM n WHERE n <= 3"""


@query("concept_described", DESCRIBED.format(where="") + " GROUP BY term", units=True)
def concept_described(spark, d):
    u = fx.units(spark, d)
    return concepts.described(fx.mentions(u), u).select("term", "description", F.array_join("source_unit_ids", ",").alias("source_unit_ids"))


@query("affected_descriptions", DESCRIBED.format(where="WHERE u.page NOT IN (1, 2)") + " AND term IN (SELECT term FROM m JOIN u ON u.id = m.unit_id WHERE page IN (1, 2)) GROUP BY term", units=True)
def affected_descriptions(spark, d):
    u = fx.units(spark, d)
    return concepts.affected(fx.mentions(u), u, [1, 2]).select("term", "description", F.array_join("source_unit_ids", ",").alias("source_unit_ids"))


@query("concept_resolution_corpus", """WITH v AS (SELECT term, min(doc_id) AS first FROM m GROUP BY term), e AS (SELECT v.term, v.first, x.embedding::DOUBLE[] AS vec FROM v JOIN (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM embeddings) x ON x.k = v.first % 500),
p AS (SELECT a.term, b.term AS up, round(list_cosine_similarity(a.vec, b.vec), 9) AS s FROM e a JOIN e b ON b.first < a.first), n AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY s DESC, up) AS r FROM p WHERE s > 0.55),
g AS (SELECT term, arg_min(up, r) AS up FROM n WHERE r <= 5 AND 1 - levenshtein(term, up) / greatest(length(term), length(up))::DOUBLE >= 0.8 GROUP BY term)
SELECT v.term, coalesce(g3.up, g2.up, g.up, v.term) AS concept_term, CASE WHEN g.up IS NULL THEN 'manual' ELSE 'embedding' END AS method FROM v LEFT JOIN g ON g.term = v.term LEFT JOIN g g2 ON g2.term = g.up LEFT JOIN g g3 ON g3.term = g2.up""", units=True)  # fmt: skip
def concept_resolution_corpus(spark, d):
    m = fx.mentions(fx.units(spark, d))
    first = store_rows(m.groupBy("term").agg(F.min("doc_id").alias("first")), "first")  # texts are read once
    v = fx.vectors(spark, d).select(F.col("doc_id").alias("k"), "vec")  # vectors are numbered from 0 on without gaps
    none = spark.createDataFrame([], "normalized_alias string, concept_term string")
    vectors = first.join(v, F.col("first") % 500 == v["k"]).select("term", "vec")
    return concepts.resolve(first, none, vectors).select("term", "concept_term", "method")


# ---- vectors

VEC = "{x}d AS (SELECT id, list_filter(regexp_split_to_array(lower({doc}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS words FROM {table}), {x}s AS (SELECT id, (unicode(w[1]) * 31 + unicode(w[-1]) * 7 + length(w)) % 64 AS slot, count(*)::DOUBLE AS n FROM (SELECT id, unnest(words) AS w FROM {x}d) GROUP BY 1, 2), {x}v AS (SELECT id, count(*) AS n_slots, round(sum(n * slot) / sqrt(sum(n * n)), 6) AS moment FROM {x}s GROUP BY id)"


@query("embed_units", f"WITH {CHAIN}, cd AS (SELECT id, subject || chr(10) || chr(10) || 'Content:' || chr(10) || content AS whole FROM sd), "
       + VEC.format(x="sj", doc="subject", table="sd") + ", " + VEC.format(x="ct", doc="whole", table="cd") + " SELECT 'subjects' AS index, id, n_slots, moment FROM sjv UNION ALL SELECT 'content', id, n_slots, moment FROM ctv", units=True)
def embed_units(spark, d):
    v = ingest.unit_vectors(fx.units(spark, d), "book")
    n = F.size(F.filter("vec", lambda x: x > 0)).cast("long").alias("n_slots")
    moment = F.aggregate(F.zip_with("vec", F.sequence(L(0), L(63)), lambda a, b: a * b), L(0.0), lambda s, x: s + x)
    return v.select("index", "id", n, F.round(moment, 6).alias("moment"))


@query("vector_metadata_full", "SELECT id, 'doc' AS document_id, type, name, page, array_to_string(section, ' > ') AS section, coalesce(parent_unit_id, '') AS parent, source_order, substr(summary, 1, 200) AS summary FROM u", units=True)
def vector_metadata_full(spark, d):
    meta = ingest.vector_metadata(fx.units(spark, d))
    m = F.from_json("meta", "id string, document_id string, type string, name string, page int, section string, parent_unit_id string, source_order int, summary string")
    return meta.select(m.alias("m")).select("m.id", "m.document_id", "m.type", "m.name", "m.page", "m.section", F.coalesce("m.parent_unit_id", L("")).alias("parent"), "m.source_order", "m.summary")


@query("vector_upsert_delete", "SELECT 'content' AS index, vec_id AS id, CASE WHEN label = 3 THEN 0.0 ELSE embedding[1]::DOUBLE END AS first FROM embeddings WHERE label <> 5")
def vector_upsert_delete(spark, d):
    v = table(spark, d, "embeddings")
    now = v.select(L("content").alias("index"), F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vec"), L(0).alias("seq"))
    again = v.where("label = 3").select(L("content").alias("index"), F.col("vec_id").cast("string").alias("id"), F.transform("embedding", lambda x: x * 0).alias("vec"), L(1).alias("seq"))
    kept = store.keep_latest(now.unionByName(again), ["index", "id"], "seq")
    long_id = spark.createDataFrame([("x" * 65,)], "id string")
    left = store.delete_vectors(kept, v.where("label = 5").select(F.col("vec_id").cast("string").alias("id")).unionByName(long_id))
    return left.select("index", F.col("id").cast("long").alias("id"), F.element_at("vec", 1).cast("double").alias("first"))


@query("concept_vectors", "WITH c AS (SELECT DISTINCT term AS id, 'Name: ' || term || chr(10) || 'Aliases: ' || term AS doc FROM m), " + VEC.format(x="cn", doc="doc", table="c") + " SELECT id, n_slots, moment FROM cnv", units=True)
def concept_vectors(spark, d):
    c = fx.mentions(fx.units(spark, d)).select("term").distinct()
    v = c.select(F.col("term").alias("id"), X.hashed_vector(X.concept_document(F.col("term"), F.array("term"), L(""))).alias("vec"))
    n = F.size(F.filter("vec", lambda x: x > 0)).cast("long").alias("n_slots")
    moment = F.aggregate(F.zip_with("vec", F.sequence(L(0), L(63)), lambda a, b: a * b), L(0.0), lambda s, x: s + x)
    return v.select("id", n, F.round(moment, 6).alias("moment"))


@query("library_ingest", "SELECT (SELECT count(*) FROM u) AS n_units, (SELECT count(*) FROM po) AS n_postings, (SELECT cast(sum(len) AS BIGINT) FROM dl) AS n_tokens, (SELECT count(*) FROM m) AS n_mentions", search=True)
def library_ingest(spark, d):
    lib = fx.library(spark, d)
    one = lambda df, c: df.agg(c)
    u = one(lib.units, F.count("*").alias("n_units"))
    for x in (one(lib.index.postings, F.count("*").alias("n_postings")), one(lib.index.lengths, F.sum("len").alias("n_tokens")), one(lib.mentions, F.count("*").alias("n_mentions"))):
        u = u.crossJoin(F.broadcast(x))  # one row each
    return u


# ---- extraction and phases

BLOCK = r"<(?:h1|p|li)(?:\s[^>]*)?>[^<]*(?:</?(?:b|i|em|strong|a|br)(?:\s[^>]*)?>[^<]*)*"
EXTRACTED = rf"""e AS (SELECT page_id, unnest(g) AS raw, unnest(range(1, len(g) + 1)) AS k FROM (SELECT page_id, regexp_extract_all(coalesce(html, ''), '{BLOCK}') AS g FROM pages)),
f AS (SELECT page_id, k, regexp_extract(raw, '^<([a-z0-9]+)', 1) AS tag, trim(regexp_replace(regexp_replace(raw, '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS content FROM e),
x AS (SELECT page_id, cast(row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS INTEGER) AS source_order, CASE tag WHEN 'li' THEN 'ColumnListItem' ELSE 'Rule' END AS type, array_to_string(string_split(content, ' ')[1:5], ' ') AS name, content FROM f WHERE content <> '')"""


@query("extract_page_units", f"WITH {EXTRACTED} SELECT * FROM x")
def extract_page_units(spark, d):
    return ingest.extract_pages(table(spark, d, "pages").select(F.col("page_id").alias("page"), "html")).select(F.col("page").alias("page_id"), "source_order", "type", "name", "content")


@query("ingest_pages", f"""WITH {EXTRACTED}, y AS (SELECT *, CASE WHEN type = 'Rule' THEN 'RULE' ELSE 'TABLE' END || '-' || substr(sha256('site:' || page_id || ':' || source_order), 1, 32) AS id FROM x WHERE page_id % 2 = 0)
SELECT id, 'pending' AS status, sha256(content) AS content_hash, page_id AS page FROM y UNION ALL SELECT 'old' || page_id, 'done', '', page_id FROM pages WHERE page_id % 2 = 1""")  # fmt: skip
def ingest_pages(spark, d):
    p = table(spark, d, "pages")
    old = p.select(F.concat(L("old"), F.col("page_id").cast("string")).alias("id"), L("site").alias("document_id"), F.col("page_id").cast("int").alias("page"), L("done").alias("status"), L("").alias("content_hash"))
    new = ingest.processed_pages(p.where("page_id % 2 = 0").select(L("site").alias("document_id"), F.col("page_id").cast("int").alias("page"), "html"))
    return ingest.replaced_pages(old, new).select("id", "status", "content_hash", F.col("page").cast("long").alias("page"))


TERMS = r"""w AS (SELECT id, status, name, summary, content, list_filter(regexp_extract_all(substr(content, 1, 240), '[A-Z][a-z]+'), lambda t: length(t) >= 3) AS caps, list_filter(regexp_extract_all(lower(content), '[a-z]+'), lambda t: length(t) >= 9) AS long FROM u),
t AS (SELECT id, status, (SELECT list(v ORDER BY k) FROM (SELECT v, min(k) AS k FROM (SELECT unnest(caps) AS v, generate_subscripts(caps, 1) AS k) GROUP BY v)) AS caps, (SELECT list(v ORDER BY k) FROM (SELECT v, min(k) AS k FROM (SELECT unnest(long) AS v, generate_subscripts(long, 1) AS k) GROUP BY v)) AS long FROM w)"""


@query("phase_metadata", f"WITH {TERMS} SELECT id, 'metadata_done' AS status, array_to_string(list_concat(coalesce(caps[1:5], []), coalesce(long[1:10], [])), ' ') AS terms FROM t WHERE status = 'summary_done' UNION ALL SELECT id, status, array_to_string(list_concat(defines, mentions), ' ') FROM u WHERE status <> 'summary_done'", units=True)
def phase_metadata(spark, d):
    u = ingest.run_phase(fx.units(spark, d), "metadata")
    return u.select("id", "status", X.metadata_terms(F.col("metadata.defines"), F.col("metadata.mentions")).alias("terms"))


@query("phase_embedding_concepts", "SELECT id, CASE status WHEN 'metadata_done' THEN 'done' WHEN 'embedding_done' THEN 'done' ELSE status END AS status, CASE WHEN status = 'metadata_done' THEN id ELSE '' END AS subject_embedding_id FROM u", units=True)
def phase_embedding_concepts(spark, d):
    u = ingest.run_phase(ingest.run_phase(fx.units(spark, d), "embedding"), "concepts")
    return u.select("id", "status", F.coalesce("subject_embedding_id", L("")).alias("subject_embedding_id"))


@query("phase_remaining", "SELECT source_node_id AS document_id, count(*) AS total, count(*) FILTER (WHERE status = 'pending') AS summary, count(*) FILTER (WHERE status = 'summary_done') AS metadata, count(*) FILTER (WHERE status = 'metadata_done') AS embedding, count(*) FILTER (WHERE status = 'embedding_done') AS concepts, count(*) FILTER (WHERE status = 'done') = count(*) AS done FROM u GROUP BY 1", units=True)
def phase_remaining(spark, d):
    return ingest.remaining(fx.units(spark, d).withColumn("document_id", F.col("source_node_id")))


@query("container_units", "SELECT page, name, count(*) AS n_children FROM (SELECT p.page, p.name, c.id FROM (SELECT DISTINCT page, 'n' || (source_order % 3) AS name FROM u) p JOIN (SELECT id, page, CASE WHEN source_order % 4 <> 0 THEN 'n' || ((doc_id * 7) % 4) END AS parent_name FROM u) c ON c.page = p.page AND c.parent_name = p.name) GROUP BY 1, 2", units=True)
def container_units(spark, d):
    from quillmere.plans.text_queries import _named

    return hierarchy.containers(_named(fx.units(spark, d)), "page").select("page", "name", "n_children")


@query("tree_view", f"WITH {CHAIN} SELECT u.id, cast(len(ch.parents) AS INTEGER) AS depth, coalesce(k.children, '') AS children, coalesce(k.n, 0) AS n_below FROM u JOIN ch ON ch.id = u.id LEFT JOIN (SELECT parent_unit_id AS id, string_agg(id, ',' ORDER BY source_order) AS children, count(*) AS n FROM u GROUP BY 1) k ON k.id = u.id", units=True)
def tree_view(spark, d):
    u = fx.units(spark, d).withColumn("parent_unit_id", F.when((F.col("source_order") == 0) & (F.col("page") % 2 == 0), F.col("id")).otherwise(F.col("parent_unit_id")))  # some roots name themselves
    return hierarchy.tree(u).select("id", "depth", F.array_join("children", ",").alias("children"), "n_below")


# ---- steps of a query


@query("decompose_questions", r"""SELECT conv_id, turn, coalesce(array_to_string(list_filter(list_transform(regexp_split_to_array(text, '[?;]|\band\b|\bor\b'), lambda p: trim(p)), lambda p: p <> '')[1:5], '|'), '') AS parts,
len(list_filter(list_transform(regexp_split_to_array(text, '[?;]|\band\b|\bor\b'), lambda p: trim(p)), lambda p: p <> '')[1:5]) > 2 AS is_complex FROM conversations WHERE role = 'user'""")  # fmt: skip
def decompose_questions(spark, d):
    c = table(spark, d, "conversations").where("role = 'user'").withColumn("parts", X.sub_queries(F.col("text")))
    return c.select("conv_id", "turn", F.array_join("parts", "|").alias("parts"), (F.size("parts") > 2).alias("is_complex"))


@query("route_questions", r"SELECT conv_id, turn, NOT regexp_matches(lower(text), '^\s*(hi|hello|thanks|thank you)[.!\s]*$') AS rag, array_to_string(regexp_extract_all(text, '\b[A-Z][A-Za-z0-9_]+')[1:5], ',') AS entities FROM conversations")
def route_questions(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", X.needs_documents(F.col("text")).alias("rag"), F.array_join(X.entities(F.col("text")), ",").alias("entities"))


@query("sufficiency", "SELECT qs.question_id, count(*) FILTER (WHERE p.id IS NULL) = 0 AS sufficient, coalesce(string_agg(DISTINCT q.query, '; ' ORDER BY q.query) FILTER (WHERE p.id IS NULL), '') AS follow_ups FROM qs JOIN q ON q.sub_query_index = qs.sub_query_index LEFT JOIN ps p ON p.question_id = qs.question_id AND list_contains(p.sq, qs.sub_query_index) GROUP BY 1", pool=True)
def sufficiency(spark, d):
    return retrieval.sufficiency(retrieval.passing(pool(spark, d)), fx.sub_queries(spark)).select("question_id", "sufficient", F.array_join("follow_ups", "; ").alias("follow_ups"))


@query("answer_with_citations", "SELECT question_id, sha256('Based on ' || string_agg(ps.id, ', ' ORDER BY round(final, 9) DESC, ps.id) || ': ' || string_agg(substr(summary, 1, 80), ' ' ORDER BY round(final, 9) DESC, ps.id)) AS answer, string_agg(ps.id, ',' ORDER BY round(final, 9) DESC, ps.id) AS citations FROM ps JOIN u ON u.id = ps.id GROUP BY 1", pool=True)
def answer_with_citations(spark, d):
    a = retrieval.answers(retrieval.passing(pool(spark, d)))
    return a.select("question_id", F.sha2("answer", 256).alias("answer"), F.array_join("citations", ",").alias("citations"))


@query("streamed_answers", "WITH a AS (SELECT question_id, 'Based on ' || string_agg(ps.id, ', ' ORDER BY round(final, 9) DESC, ps.id) || ': ' || string_agg(substr(summary, 1, 80), ' ' ORDER BY round(final, 9) DESC, ps.id) AS t FROM ps JOIN u ON u.id = ps.id GROUP BY 1) SELECT question_id, cast(i AS INTEGER) AS i, substr(t, i * 50 + 1, 50) AS chunk FROM (SELECT question_id, t, unnest(range(0, cast(ceil(length(t) / 50.0) AS BIGINT))) AS i FROM a)", pool=True)
def streamed_answers(spark, d):
    return retrieval.answers(retrieval.passing(pool(spark, d))).select("question_id", F.posexplode(X.chunks(F.col("answer"))).alias("i", "chunk"))


@query("result_projection", "SELECT ps.question_id, ps.id, u.type, coalesce(u.name, '') AS name, u.page, array_to_string(u.section, ' > ') AS section, round(rerank, 6) AS score, len(sq) AS n_sub_queries, role FROM ps JOIN u ON u.id = ps.id", pool=True)
def result_projection(spark, d):
    best = retrieval.passing(pool(spark, d))
    return retrieval.projected(best, fx.library(spark, d).units).select("question_id", "id", "type", "name", "page", "section", F.round("score", 6).alias("score"), "n_sub_queries", "role")


@query("iteration_merge", "SELECT id, max(score) AS rerank_score, string_agg(DISTINCT k, ',' ORDER BY k) AS sources FROM (SELECT id, (doc_id % 7) / 7.0::DOUBLE AS score, 'a' AS k FROM u WHERE type <> 'Rule' UNION ALL SELECT id, (doc_id % 5) / 5.0::DOUBLE, 'b' FROM u WHERE status = 'done') GROUP BY id", units=True)
def iteration_merge(spark, d):
    u = fx.units(spark, d)
    one = lambda cond, n, k: u.where(cond).select(L(0).alias("question_id"), "id", ((F.col("doc_id") % n) / float(n)).alias("rerank_score"), F.array(L(k)).alias("sources"))
    merged = retrieval.merged_rounds([one("type <> 'Rule'", 7, "a"), one("status = 'done'", 5, "b")])
    return merged.select("id", "rerank_score", F.array_join("sources", ",").alias("sources"))


EVIDENCE = f"""WITH {CHAIN}, ev AS (SELECT page // 5 AS query_id, id, row_number() OVER (PARTITION BY page // 5 ORDER BY doc_id % 89 DESC, id) AS n FROM u QUALIFY n <= 8),
en AS (SELECT ev.query_id, ev.n, u.*, array_to_string(ch.parents, ' > ') AS chain, CASE WHEN pe.id IS NULL THEN '' ELSE p.name END AS near FROM ev JOIN u ON u.id = ev.id JOIN ch ON ch.id = u.id LEFT JOIN u p ON p.id = u.parent_unit_id LEFT JOIN ev pe ON pe.id = u.parent_unit_id AND pe.query_id = ev.query_id)"""


def chosen_with_jumps(spark, d, best):
    """The arguments of ``enriched`` for a few chosen units over the stored library."""
    lib, best = fx.library(spark, d), store_rows(best, "best")
    return best, lib.units, lib.jumps, best.count()


@query("evidence_enriched", EVIDENCE + " SELECT query_id, id, chain, near FROM en", units=True)
def evidence_enriched(spark, d):
    from quillmere.plans.search_queries import _pool

    best = search.top_k(_pool(spark, d).withColumn("score", (F.col("doc_id") % 89).cast("double")), 8, key="query_id").select("query_id", "id", "rank")
    e = retrieval.enriched(*chosen_with_jumps(spark, d, best))
    return e.select("query_id", "id", F.array_join("parent_chain", " > ").alias("chain"), F.coalesce(F.try_element_at("known_chain", L(-1)), L("")).alias("near"))


@query("evidence_context", EVIDENCE + " SELECT query_id, sha256(string_agg('[' || type || '] ' || array_to_string(section, ' > ') || CASE WHEN chain <> '' THEN ' > ' || chain ELSE '' END || ' > ' || name || chr(10) || summary || chr(10) || content, chr(10) || chr(10) ORDER BY n)) AS context FROM en GROUP BY 1", units=True)
def evidence_context(spark, d):
    from quillmere.plans.search_queries import _pool

    best = search.top_k(_pool(spark, d).withColumn("score", (F.col("doc_id") % 89).cast("double")), 8, key="query_id").select("query_id", "id", "rank")
    return retrieval.evidence_context(retrieval.enriched(*chosen_with_jumps(spark, d, best))).select("query_id", F.sha2("context", 256).alias("context"))


# ---- functions


@query("accumulated_gaps", "SELECT conv_id, string_agg(text, '|' ORDER BY turn) AS gaps, count(*) AS n FROM conversations WHERE trim(text) <> '' GROUP BY 1")
def accumulated_gaps(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.filter(F.array("text"), lambda t: F.trim(t) != "").alias("gaps")))).alias("x"))
    gaps = F.flatten(F.transform("x", lambda r: r["gaps"]))
    return c.select("conv_id", F.array_join(gaps, "|").alias("gaps"), F.size(gaps).cast("long").alias("n"))


@query("strict_flags", "SELECT event_id, event_type = 'click' AS is_list, CASE WHEN event_type IN ('view', 'complex') THEN event_type ELSE 'simple' END AS complexity FROM events")
def strict_flags(spark, d):
    e = table(spark, d, "events")
    flag = F.when(F.col("event_type") == "click", "true").when(F.col("event_type") == "view", "1").when(F.col("event_type") == "error", "TRUE")
    return e.select("event_id", X.strict_true(flag).alias("is_list"), X.one_of(F.col("event_type"), ["view", "complex"], "simple").alias("complexity"))


@query("json_repair", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_repair(spark, d):
    e = table(spark, d, "events")
    broken = F.when(F.col("event_id") % 3 == 0, F.concat(L("Here: "), F.regexp_replace("props", r"\}\s*$", ",}"))).when(F.col("event_id") % 3 == 1, F.concat(L("```json\n"), "props", L("\n```"))).otherwise(F.col("props"))
    return e.select("event_id", F.get_json_object(X.json_repaired(broken), "$.k").alias("k"))


@query("iso_times", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) // 1000, 0) AS elapsed_ms FROM events")
def iso_times(spark, d):
    from pyspark.sql.window import Window

    e = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    gone = F.unix_micros("at") - F.lag(F.unix_micros("at")).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select("event_id", X.iso_time(F.col("at")).alias("iso"), F.coalesce(F.floor(gone / 1000), L(0)).alias("elapsed_ms"))


@query("retry_delays", "SELECT i AS attempt, cast(1000 * pow(2, i) AS BIGINT) AS task_ms, cast(least(30000, 500 * pow(2, i)) AS BIGINT) AS client_ms FROM (SELECT DISTINCT cast(n_regionkey AS BIGINT) AS i FROM nation)")
def retry_delays(spark, d):
    return table(spark, d, "nation").select(F.col("n_regionkey").cast("long").alias("attempt")).distinct().select("attempt", X.retry_delay_ms(F.col("attempt")).alias("task_ms"), X.backoff_ms(F.col("attempt")).alias("client_ms"))


@query("prompts", "SELECT id, sha256('Answer in ' || lang || '. Summarise this ' || type || ' named ' || name || ':' || chr(10) || content) AS prompt FROM (SELECT u.*, section[2] AS lang FROM u)", units=True)
def prompts(spark, d):
    u = fx.units(spark, d)
    text = X.filled_template("Answer in ${language}. Summarise this ${type} named ${name}:\n${content}", {"language": F.element_at("section", 2), "type": F.col("type"), "name": F.col("name"), "content": F.col("content")})
    return u.select("id", F.sha2(text, 256).alias("prompt"))


#: What each kind of prompt is filled with, for units and for turns of conversations.
UNIT_PROMPTS = {
    "summary": {"document": "document_id", "parent": "parent_unit_id", "children": "source_order", "type": "type", "name": "name", "content": "content"},
    "metadata": {"type": "type", "name": "name", "content": "content"},
    "describe": {"name": "name", "context": "summary"},
    "same": {"term": "source_node_id", "name": "name", "description": "summary"},
    "extract": {"page": "page", "section": "source_node_id", "containers": "parent_unit_id", "last": "name"},
}
TURN_PROMPTS = {
    "route": {"history": "role", "question": "text"},
    "decompose": {"most": "turn", "question": "text"},
    "sufficiency": {"question": "text", "gaps": "role", "evidence": "turn"},
    "answer": {"language": "role", "evidence": "turn", "question": "text"},
}
PROMPTS_SQL = " UNION ALL ".join(
    [f"SELECT '{k}' AS kind, id AS key, sha256({P.prompt_sql(k, **v)}) AS prompt FROM u" for k, v in UNIT_PROMPTS.items()]
    + [f"SELECT '{k}' AS kind, conv_id || ':' || turn AS key, sha256({P.prompt_sql(k, **v)}) AS prompt FROM conversations" for k, v in TURN_PROMPTS.items()]
)


@query("prompt_builders", PROMPTS_SQL, units=True)
def prompt_builders(spark, d):
    u, c = fx.units(spark, d), table(spark, d, "conversations")
    each = [u.select(L(k).alias("kind"), F.col("id").alias("key"), F.sha2(P.prompt(k, **{n: F.col(x) for n, x in v.items()}), 256).alias("prompt")) for k, v in UNIT_PROMPTS.items()]
    each += [c.select(L(k).alias("kind"), F.concat_ws(":", "conv_id", "turn").alias("key"), F.sha2(P.prompt(k, **{n: F.col(x) for n, x in v.items()}), 256).alias("prompt")) for k, v in TURN_PROMPTS.items()]
    out = each[0]
    for x in each[1:]:
        out = out.unionByName(x)
    return out


@query("evidence_by_sub_query", """WITH g AS (SELECT ps.question_id, qs.sub_query_index AS k, any_value(q.query) AS query, string_agg('[' || u.id || '] (' || u.type || ', ' || array_to_string(u.section, ' > ') || ', page ' || u.page || ')' || chr(10) || u.content, chr(10) || chr(10) ORDER BY round(final, 9) DESC, ps.id) AS t
FROM ps JOIN qs ON qs.question_id = ps.question_id AND list_contains(ps.sq, qs.sub_query_index) JOIN q ON q.sub_query_index = qs.sub_query_index JOIN u ON u.id = ps.id GROUP BY 1, 2)
SELECT question_id, sha256(string_agg('--- Search ' || (k + 1) || ': ' || query || ' ---' || chr(10) || t, chr(10) || chr(10) ORDER BY k)) AS evidence FROM g GROUP BY 1""", pool=True)  # fmt: skip
def evidence_by_sub_query(spark, d):
    grouped = retrieval.grouped_evidence(retrieval.passing(pool(spark, d)), fx.sub_queries(spark), fx.library(spark, d).units)
    return grouped.select("question_id", F.sha2("evidence", 256).alias("evidence"))


@query("map_lookup", "SELECT page, max(CASE WHEN source_order = 3 THEN id END) AS third, count(*) AS n FROM u GROUP BY page", units=True)
def map_lookup(spark, d):
    by_place = fx.units(spark, d).groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct("source_order", "id"))).alias("m"))
    return by_place.select("page", F.try_element_at("m", L(3)).alias("third"), F.size("m").cast("long").alias("n"))


@query("parsed_numbers", r"SELECT p_partkey, coalesce(try_cast(nullif(regexp_extract(p_brand, '([0-9]+)$', 1), '') AS INTEGER), 200) AS n, CASE WHEN p_size > 0 THEN printf('%.1f%%', 100.0 * least(p_size, 25) / p_size) ELSE '0.0%' END AS share FROM part")
def parsed_numbers(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", X.integer_or(F.regexp_extract("p_brand", "([0-9]+)$", 1), 200).alias("n"), X.percent(F.least(F.col("p_size"), L(25)), F.col("p_size")).alias("share"))


@query("html_escape", """SELECT page_id, sha256(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS h FROM pages""")
def html_escape(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(X.html_escaped(F.col("html")), 256).alias("h"))


@query("random_ids", "SELECT count(*) AS n, count(*) AS ids, true AS well_formed FROM documents")
def random_ids(spark, d):
    ids = table(spark, d, "documents").select(X.random_id("LOG").alias("id"))
    return ids.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.bool_and(F.col("id").rlike("^LOG-[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")).alias("well_formed"))


# ---- the engine over a folder

ELEMENT = BLOCK.replace("h1|p|li", "h1|p|li|ul")
#: Units of the pages by structure: lists with their items, headings with what stands below them, sections carried from page to page.
PLACED = rf"""e AS (SELECT page_id, unnest(g) AS raw, unnest(range(1, len(g) + 1)) AS k FROM (SELECT page_id, regexp_extract_all(coalesce(html, ''), '{ELEMENT}') AS g FROM pages)),
f AS (SELECT page_id, k, regexp_extract(raw, '^<([a-z0-9]+)', 1) AS tag, trim(regexp_replace(replace(replace(regexp_replace(regexp_replace(raw, '<br[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM e),
l AS (SELECT *, count(*) FILTER (WHERE tag = 'ul') OVER w AS ul_n, count(*) FILTER (WHERE tag = 'h1') OVER w AS h_n FROM f WINDOW w AS (PARTITION BY page_id ORDER BY k)),
t AS (SELECT page_id, ul_n, string_agg(text, chr(10) ORDER BY k) AS items FROM l WHERE tag = 'li' AND text <> '' GROUP BY 1, 2),
y AS (SELECT *, cast(row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS INTEGER) AS so FROM (SELECT l.page_id, k, tag, l.ul_n, h_n, CASE tag WHEN 'ul' THEN coalesce(items, '') ELSE text END AS content FROM l LEFT JOIN t ON t.page_id = l.page_id AND t.ul_n = l.ul_n) WHERE content <> ''),
z AS (SELECT y.*, 'd' || (y.page_id % 3) AS document_id, cast(y.page_id // 3 AS INTEGER) AS page, h.content AS heading, CASE y.tag WHEN 'ul' THEN 'ColumnListTable' WHEN 'li' THEN 'ColumnListItem' ELSE 'Rule' END AS type,
      CASE WHEN y.tag = 'h1' THEN y.content ELSE array_to_string(string_split(replace(y.content, chr(10), ' '), ' ')[1:5], ' ') END AS name FROM y LEFT JOIN y h ON h.page_id = y.page_id AND h.h_n = y.h_n AND h.tag = 'h1'),
i AS (SELECT *, CASE WHEN type = 'Rule' THEN 'RULE' ELSE 'TABLE' END || '-' || substr(sha256(document_id || ':' || page || ':' || so), 1, 32) AS id FROM z),
ls AS (SELECT document_id, page, arg_max(coalesce(heading, ''), so) AS sec FROM i GROUP BY 1, 2),
pp AS (SELECT DISTINCT 'd' || (page_id % 3) AS document_id, cast(page_id // 3 AS INTEGER) AS page FROM pages),
ca AS (SELECT pp.document_id, pp.page, last_value(nullif(sec, '') IGNORE NULLS) OVER (PARTITION BY pp.document_id ORDER BY pp.page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carried FROM pp LEFT JOIN ls ON ls.document_id = pp.document_id AND ls.page = pp.page),
pl AS (SELECT i.*, coalesce(i.heading, ca.carried, '') AS section,
      CASE WHEN tag = 'li' THEN (SELECT arg_max(b.id, b.so) FROM i b WHERE b.page_id = i.page_id AND b.tag = 'ul' AND b.so < i.so)
           WHEN tag <> 'h1' AND heading <> name THEN (SELECT arg_max(b.id, b.so) FROM i b WHERE b.page_id = i.page_id AND b.name = i.heading AND b.so < i.so) END AS parent
      FROM i JOIN ca ON ca.document_id = i.document_id AND ca.page = i.page)"""


def site_pages(spark, d):
    """The pages as those of three documents, without gaps in their numbers."""
    return table(spark, d, "pages").select(F.concat(L("d"), (F.col("page_id") % 3).cast("string")).alias("document_id"), F.floor(F.col("page_id") / 3).cast("int").alias("page"), "html")


def _ingested(spark, d):
    from quillmere.api import Engine

    engine = Engine(spark, scratch_path(spark, "engine"))
    engine.start(site_pages(spark, d))
    return engine


@query("page_structure", f"WITH {PLACED} SELECT document_id, page, so AS source_order, type, name, content, CASE WHEN tag IN ('p', 'ul') THEN coalesce(heading, '') ELSE '' END AS parent_name, coalesce(heading, '') AS own_section FROM pl")
def page_structure(spark, d):
    from quillmere.sources import page_tree

    u = page_tree.extracted(site_pages(spark, d)).select("document_id", "page", F.inline("units"))
    return u.select("document_id", "page", "source_order", "type", "name", "content", F.coalesce("parent_name", L("")).alias("parent_name"), F.array_join("section", " > ").alias("own_section"))


@query("engine_ingest", f"""WITH {PLACED}, tm AS (SELECT id, count(DISTINCT lower(v)) AS n FROM (SELECT id, unnest(list_concat((SELECT coalesce(list(v ORDER BY k), []) FROM (SELECT v, min(k) AS k FROM (SELECT unnest(caps) AS v, generate_subscripts(caps, 1) AS k) GROUP BY v))[1:5],
  (SELECT coalesce(list(v ORDER BY k), []) FROM (SELECT v, min(k) AS k FROM (SELECT unnest(long) AS v, generate_subscripts(long, 1) AS k) GROUP BY v))[1:10])) AS v
  FROM (SELECT id, list_filter(regexp_extract_all(substr(content, 1, 240), '[A-Z][a-z]+'), lambda t: length(t) >= 3) AS caps, list_filter(regexp_extract_all(lower(content), '[a-z]+'), lambda t: length(t) >= 9) AS long FROM pl)) GROUP BY id)
SELECT pl.id, document_id, page, so AS source_order, type, name, coalesce(parent, '') AS parent, section, 'done' AS status, coalesce(tm.n, 0) AS n_terms FROM pl LEFT JOIN tm ON tm.id = pl.id""")  # fmt: skip
def engine_ingest(spark, d):
    engine = whole_engine(spark, d)
    m = engine.read("concept_mentions").groupBy(F.col("unit_id").alias("id")).agg(F.count_distinct(X.normalize_term(F.col("raw_term"), False)).alias("n_terms"))
    u = engine.read("units").join(m, "id", "left")
    return u.select("id", "document_id", "page", "source_order", "type", "name", F.coalesce("parent_unit_id", L("")).alias("parent"), F.array_join("section", " > ").alias("section"), "status", F.coalesce("n_terms", L(0)).alias("n_terms"))


_engines: dict[tuple, object] = {}


def whole_engine(spark, d):
    """The engine over all pages, with all phases done: once for a session, as long as its tables are there and the pages are the same."""
    key = (spark.sparkContext.applicationId, d, stamp(spark, f"{d}/pages.parquet"))
    if key not in _engines or not exists(spark, _engines[key].root):
        engine = _ingested(spark, d)
        engine.run()
        _engines[key] = engine
    return _engines[key]


@query("engine_status", f"WITH {PLACED} SELECT document_id, 'done' AS phase, count(DISTINCT page) AS pages_processed, count(*) AS units_processed, true AS all_done FROM pl GROUP BY 1")
def engine_status(spark, d):
    return whole_engine(spark, d).status().select("document_id", "phase", "pages_processed", "units_processed", "all_done")


@query("engine_tree", f"WITH RECURSIVE {PLACED}, up AS (SELECT id, parent, 0 AS depth FROM pl WHERE document_id = 'd0' UNION ALL SELECT up.id, p.parent, depth + 1 FROM up JOIN pl p ON p.id = up.parent) SELECT id, cast(max(depth) AS INTEGER) AS depth, coalesce(any_value(k.children), '') AS children FROM up LEFT JOIN (SELECT parent, string_agg(id, ',' ORDER BY so) AS children FROM pl WHERE parent IS NOT NULL GROUP BY 1) k ON k.parent = up.id GROUP BY id")
def engine_tree(spark, d):
    return whole_engine(spark, d).tree("d0").select("id", "depth", F.array_join("children", ",").alias("children"))


@query("engine_vectors", f"WITH {PLACED} SELECT 'content' AS index, count(*) AS n, 64 AS dimensions FROM pl UNION ALL SELECT 'subjects', count(*), 64 FROM pl")
def engine_vectors(spark, d):
    v = whole_engine(spark, d).read("vectors").where("index <> 'concepts'")
    return v.groupBy("index").agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dimensions"))


@query("engine_redelivery", f"WITH {PLACED} SELECT document_id, count(*) AS n_units, count(parent) AS n_parents, sum(length(section)) AS section_chars FROM pl GROUP BY 1")
def engine_redelivery(spark, d):
    """Half of the pages first, then all of them, then some again: as if all had come at once."""
    from quillmere.api import Engine

    engine, p = Engine(spark, scratch_path(spark, "engine")), site_pages(spark, d)
    half = p.agg(F.floor(F.max("page") / 2)).first()[0]
    for some in (p.where(F.col("page") <= half), p, p.where(F.col("page") % 7 == 0)):
        engine.start(some)
    u = engine.read("units")
    return u.groupBy("document_id").agg(F.count("*").alias("n_units"), F.count("parent_unit_id").alias("n_parents"), F.sum(F.length(F.array_join("section", " > "))).alias("section_chars"))


@query("engine_cleanup", f"WITH {PLACED} SELECT document_id, count(*) AS n_units, count(DISTINCT page) AS n_pages FROM pl WHERE document_id <> 'd1' GROUP BY 1")
def engine_cleanup(spark, d):
    engine = _ingested(spark, d)
    engine.cleanup("d1")
    return engine.sources()


@query("place_stream", f"WITH {PLACED} SELECT id, document_id, page, so AS source_order, type, coalesce(parent, '') AS parent, section FROM pl")
def place_stream(spark, d):
    from quillmere.streaming import pages as pg

    at = scratch_path(spark, "pages")
    pages = site_pages(spark, d)
    last = pages.groupBy("document_id").agg(F.min("page").alias("least"), F.max("page").alias("most"))  # pages have numbers without gaps, so thirds need no order of them
    third = F.floor(3 * (F.col("page") - F.col("least")) / (F.col("most") - F.col("least") + 1))
    parted = pages.join(last, "document_id").select("document_id", "page", "html", third.alias("third"))
    parted.write.partitionBy("third").parquet(f"{at}/in")
    for k in range(3):  # three deliveries of any number of files, each read from where the last one ended
        spark.read.schema(pg.HTML).parquet(f"{at}/in/third={k}").write.mode("append").parquet(f"{at}/queue")
        pg.run_stream(spark, f"{at}/queue", f"{at}/checkpoint", f"{at}/out", files_per_trigger=pg.ALL_FILES, schema=pg.HTML, plan=pg.unit_stream)
    u = spark.read.schema(pg.PLACED).parquet(f"{at}/out")
    return u.select("id", "document_id", "page", "source_order", "type", F.coalesce("parent_unit_id", L("")).alias("parent"), F.array_join("section", " > ").alias("section"))


TERMS_OF = r"SELECT min(doc_id) AS id, w AS term FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) WHERE length(w) >= 12 GROUP BY w"


@query("concept_candidates", f"""WITH t AS ({TERMS_OF}) SELECT count(DISTINCT term) AS n_queries, true AS enough FROM t WHERE id % 20 = 0""")
def concept_candidates(spark, d):
    """Of the terms with id divisible by 20, how many there are and whether inverted lists find nine tenths of their five nearest earlier terms."""
    words = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), L("[a-z]+"), L(0))).alias("term")).where("length(term) >= 12")
    t = store_rows(words.groupBy("term").agg(F.min("doc_id").alias("first")).select("term", "first", X.term_vector(F.col("term")).alias("vec")), "terms")
    near, exact = (best_earlier(t, probes) for probes in (0, None))
    met = exact.join(near.withColumn("found", L(1)), ["term", "id"], "left").agg((F.count("found") >= 0.9 * F.count("*")).alias("enough"))
    return t.where("first % 20 = 0").agg(F.count("*").alias("n_queries")).crossJoin(met)  # one row each


def best_earlier(terms, probes: int | None):
    """(term, id, rank, score): the five nearest earlier terms of those with an id divisible by 20, above the threshold."""
    base = terms.select(F.col("term").alias("id"), F.col("first").alias("first2"), F.col("vec").alias("vec2"))
    met = vector_index.nearest_earlier(terms.where("first % 20 = 0"), base, probes, DEFAULT.concept_threshold, DEFAULT.concept_top_k)
    return search.top_k(met, DEFAULT.concept_top_k, key="term")


@query("keyset_pages", "SELECT id FROM u ORDER BY id LIMIT 20 OFFSET 40", units=True)
def keyset_pages(spark, d):
    u, last = fx.units(spark, d).select("id"), None
    for _ in range(2):
        last = jobs.page_after(u, last, 20).agg(F.max("id")).first()[0]
    return jobs.page_after(u, last, 20)


@query("topk_vector_lists", "SELECT count(DISTINCT question_id || ':' || sub_query_index) AS n_queries, true AS enough FROM qs", search=True)
def topk_vector_lists(spark, d):
    """Whether the inverted lists of the stored vectors give nine tenths of the exact fifteen nearest for the fixed questions."""
    lib, asked = fx.library(spark, d), fx.questions(spark, d)
    index = vector_index.built(lib.subjects)
    exact, near = search.vector_top_k(lib.subjects, asked, fx.N_QUERIES, 15), index.search(asked, fx.N_QUERIES, 15)
    met = exact.join(near.select(*search.KEY, "id", L(1).alias("found")), [*search.KEY, "id"], "left").agg((F.count("found") >= 0.9 * F.count("*")).alias("enough"))
    return asked.agg(F.count("*").alias("n_queries")).crossJoin(met)  # one row each
