"""Queries for scans, writes, joins, aggregates, windows and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmere.functions import text as X
from quillmere.operators import store, windows
from quillmere.plans.registry import TABLES_SQL, VOCAB_SQL, query
from quillmere.schemas import STATUSES, TABLE_TYPES
from quillmere.session import table
from quillmere.sources import fixtures as fx
from quillmere.sources import readers

L = F.lit


@query("scan_by_keys", "SELECT id, page, type FROM u WHERE id IN (SELECT parent_unit_id FROM u WHERE status = 'done')", units=True)
def scan_by_keys(spark, d):
    u = fx.units(spark, d)
    ids = u.where("status = 'done' AND parent_unit_id IS NOT NULL").select(F.col("parent_unit_id").alias("id"))
    return u.join(ids, "id", "left_semi").select("id", "page", "type")


@query("scan_status_pages", "SELECT id, page, source_order FROM u WHERE status = 'pending' AND page IN (1, 3, 5, 7) ORDER BY page, source_order LIMIT 9", units=True)
def scan_status_pages(spark, d):
    return fx.units(spark, d).where((F.col("status") == "pending") & F.col("page").isin(1, 3, 5, 7)).orderBy("page", "source_order").limit(9).select("id", "page", "source_order")


@query("children_of", "SELECT p.id AS parent_id, c.id AS child_id, c.source_order FROM u p JOIN u c ON c.parent_unit_id = p.id", units=True)
def children_of(spark, d):
    u = fx.units(spark, d)
    return u.select(F.col("id").alias("parent_id")).join(u.select(F.col("id").alias("child_id"), F.col("parent_unit_id").alias("parent_id"), "source_order"), "parent_id")


@query("orphans_by_section", "SELECT id, page FROM u WHERE parent_unit_id IS NULL AND section = ['src0', 'en']", units=True)
def orphans_by_section(spark, d):
    return fx.units(spark, d).where(F.col("parent_unit_id").isNull() & (F.col("section") == F.array(L("src0"), L("en")))).select("id", "page")


@query("parent_first_batch", "SELECT c.id, c.page FROM u c LEFT JOIN u p ON c.parent_unit_id = p.id WHERE c.status = 'summary_done' AND (p.id IS NULL OR p.status <> 'summary_done')", units=True)
def parent_first_batch(spark, d):
    u = fx.units(spark, d)
    p = u.select(F.col("id").alias("parent_unit_id"), F.col("status").alias("p_status"))
    return u.where("status = 'summary_done'").join(p, "parent_unit_id", "left").where("p_status IS NULL OR p_status <> 'summary_done'").select("id", "page")


@query("log_tail_since", "SELECT event_id, ts, event_type FROM events WHERE ts > TIMESTAMP '2024-01-10 00:00:00' ORDER BY ts, event_id LIMIT 200")
def log_tail_since(spark, d):
    return readers.log_tail(table(spark, d, "events"), "2024-01-10 00:00:00", 200).select("event_id", "ts", "event_type")


@query("log_tail_newest", "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def log_tail_newest(spark, d):
    return readers.log_tail(table(spark, d, "events"), None, 50).select("event_id", "ts", "event_type")


@query("candidate_log_order", "SELECT event_id, cast(row_number() OVER (ORDER BY cast(user_id % 3 AS INTEGER), event_type, ts, event_id) AS BIGINT) AS place FROM events QUALIFY place <= 100")
def candidate_log_order(spark, d):
    e = table(spark, d, "events").orderBy((F.col("user_id") % 3).cast("int"), "event_type", "ts", "event_id").limit(100)
    rows = e.select("event_id", F.struct((F.col("user_id") % 3).cast("int"), "event_type", "ts", "event_id").alias("o"))
    from pyspark.sql.window import Window

    return rows.select("event_id", F.row_number().over(Window.orderBy("o")).cast("long").alias("place"))  # a hundred rows


@query("page_range_parse", """SELECT o_orderkey, coalesce(array_to_string(list_sort(list_distinct(list_concat([c], CASE WHEN hi >= lo THEN range(lo, hi + 1) ELSE [] END))), ','), '') AS pages
FROM (SELECT o_orderkey, o_custkey % 9 + 1 AS c, o_orderkey % 5 + 1 AS lo, o_orderkey % 11 + 1 AS hi FROM orders)""")
def page_range_parse(spark, d):
    o = table(spark, d, "orders").selectExpr("o_orderkey", "concat(o_custkey % 9 + 1, ', ', o_orderkey % 5 + 1, ' - ', o_orderkey % 11 + 1, ',x,0,', o_custkey % 9 + 1) AS spec")
    return o.select("o_orderkey", F.array_join(X.page_range(F.col("spec")), ",").alias("pages"))


@query("skip_unchanged_upload", "SELECT 'pages/doc/' || page_id || '.png' AS path FROM pages WHERE url NOT LIKE 'https%'")
def skip_unchanged_upload(spark, d):
    files = table(spark, d, "pages").select(F.concat(L("pages/doc/"), F.col("page_id").cast("string"), L(".png")).alias("path"), F.sha2("html", 256).alias("content_hash"), "url")
    stored = files.withColumn("content_hash", F.when(F.col("url").startswith("https"), F.col("content_hash")).otherwise("old"))
    return readers.changed_only(files, stored).select("path")


@query("display_names", "SELECT page_id, regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '([^/]+?)(\\.[^./]*)?$', 1) AS name FROM pages")
def display_names(spark, d):
    from quillmere.functions import text as X

    return table(spark, d, "pages").select("page_id", X.display_name(F.split(F.split("url", "[?]")[0], "#")[0]).alias("name"))


# ---- writes


@query("upsert_keep_latest", "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY user_id")
def upsert_keep_latest(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    return store.keep_latest(e.withColumn("seq", F.col("event_id")), ["user_id"], "seq").select("user_id", "event_type", "value", "event_id")


@query("upsert_document", "SELECT doc_id, CASE WHEN lang = 'en' THEN 'new' ELSE source END AS source, lang FROM documents UNION ALL SELECT doc_id + 1000000, 'new', 'xx' FROM documents WHERE lang = 'es'")
def upsert_document(spark, d):
    cur = table(spark, d, "documents").select("doc_id", "source", "lang")
    new = cur.where("lang = 'en'").select("doc_id", L("new").alias("source"), L("zz").alias("lang"))
    more = cur.where("lang = 'es'").select((F.col("doc_id") + 1000000).alias("doc_id"), L("new").alias("source"), L("xx").alias("lang"))
    return store.upsert(cur, new.unionByName(more), ["doc_id"], keep=("lang",))


@query("insert_ignore", "SELECT term, unit_id FROM m WHERE mention_type = 'defines' UNION SELECT term, unit_id FROM m", units=True)
def insert_ignore(spark, d):
    m = fx.mentions(fx.units(spark, d))
    return store.insert_ignore(m.where("mention_type = 'defines'").select("term", "unit_id"), m.select("term", "unit_id"), ["term", "unit_id"])


@query("partial_update", "SELECT id, CASE WHEN type = 'Image' THEN 'edited' ELSE name END AS name, status FROM u", units=True)
def partial_update(spark, d):
    u = fx.units(spark, d)
    return store.partial_update(u.select("id", "name", "status"), u.where("type = 'Image'").select("id", L("edited").alias("name"), L(None).cast("string").alias("status")), "id", ["name", "status"])


@query("cascade_delete", "SELECT 'units' AS name, count(*) AS n FROM u WHERE section[2] = 'en' UNION ALL SELECT 'concept_mentions', count(*) FROM m JOIN u ON u.id = m.unit_id WHERE section[2] = 'en' AND term NOT IN ('tion', 'thre')"
       f" UNION ALL SELECT unnest(['concepts', 'concept_aliases']), n FROM (SELECT count(*) AS n FROM (SELECT unnest({VOCAB_SQL}) AS term) WHERE term NOT IN ('tion', 'thre'))", units=True)  # fmt: skip
def cascade_delete(spark, d):
    u = fx.units(spark, d).withColumn("document_id", F.when(F.element_at("section", 2) == "en", "a").otherwise("b"))
    names = spark.createDataFrame([(v, "b" if v in ("tion", "thre") else "a") for v in fx.VOCABULARY], "id string, document_id string")
    out = store.cascade_delete({"units": u, "concepts": names, "concept_aliases": names.select(F.col("id").alias("concept_id")), "concept_mentions": fx.mentions(u).select(F.col("term").alias("concept_id"), "unit_id")}, "b")
    parts = [t.agg(F.count("*").alias("n")).select(L(k).alias("name"), "n") for k, t in out.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _reset(stage: str, pages: list[int] | None, guard: str, after: str, summary: str, terms: str) -> None:
    scope = f"page IN ({', '.join(map(str, pages))})" if pages else "true"
    hit = f"({scope} AND {guard})"
    sql = f"SELECT id, CASE WHEN {hit} THEN '{after}' ELSE status END AS status, CASE WHEN {hit} AND {summary} THEN NULL ELSE summary END AS summary, CASE WHEN {hit} AND {terms} THEN NULL ELSE array_to_string(aliases, ', ') END AS aliases_text FROM u"

    @query(f"reset_stage_{stage}" + ("_pages" if pages else ""), sql, units=True)
    def run(spark, d):
        u = fx.units(spark, d).withColumn("aliases_text", F.array_join("metadata.aliases", ", "))
        return store.reset_stage(u, stage, pages).select("id", "status", "summary", "aliases_text")


for _pages in (None, [1, 2, 3]):
    _reset("summary", _pages, "true", "pending", "true", "true")
    _reset("metadata", _pages, "status IN ('metadata_done', 'embedding_done', 'done')", "summary_done", "false", "true")
    _reset("embedding", _pages, "status IN ('embedding_done', 'done')", "metadata_done", "false", "false")
    _reset("concepts", _pages, "status = 'done'", "embedding_done", "false", "false")


@query("reset_vision_pages", "SELECT id, page FROM u WHERE page NOT IN (1, 2, 3)", units=True)
def reset_vision_pages(spark, d):
    return store.reset_stage(fx.units(spark, d), "vision", [1, 2, 3]).select("id", "page")


@query("reset_concept_tables", "SELECT term AS concept_id, unit_id FROM m JOIN u ON u.id = m.unit_id WHERE page > 2", units=True)
def reset_concept_tables(spark, d):
    u = fx.units(spark, d)
    m = fx.mentions(u).select(F.col("term").alias("concept_id"), "unit_id")
    c = m.select(F.col("concept_id").alias("id")).distinct()
    return store.reset_concepts(c, c.select(F.col("id").alias("concept_id")), m, u, [1, 2])[2].select("concept_id", "unit_id")


# ---- joins and aggregates


@query("join_inner_mentions", "SELECT unit_id, term, mention_type, name FROM m JOIN u ON u.id = m.unit_id", units=True)
def join_inner_mentions(spark, d):
    u = fx.units(spark, d)
    return fx.mentions(u).join(u.select(F.col("id").alias("unit_id"), "name"), "unit_id").select("unit_id", "term", "mention_type", "name")


@query("join_node_counts", "SELECT source_node_id, count(*) AS n_units, max(page) AS last_page FROM u GROUP BY 1", units=True)
def join_node_counts(spark, d):
    return fx.units(spark, d).groupBy("source_node_id").agg(F.count("*").alias("n_units"), F.max("page").alias("last_page"))


@query("alias_lookup", "SELECT aliases[1] AS alias, min(id) AS unit_id FROM u GROUP BY 1", units=True)
def alias_lookup(spark, d):
    return fx.units(spark, d).groupBy(F.element_at("metadata.aliases", 1).alias("alias")).agg(F.min("id").alias("unit_id"))


@query("concept_counts", "SELECT c.term, count(m.unit_id) AS mention_count, count(*) FILTER (WHERE mention_type = 'defines') AS define_count FROM (SELECT unnest(['tion', 'thre', 'ble', 'zzz']) AS term) c LEFT JOIN m ON m.term = c.term GROUP BY 1", units=True)
def concept_counts(spark, d):
    c = spark.createDataFrame([("tion",), ("thre",), ("ble",), ("zzz",)], "term string")
    n = fx.mentions(fx.units(spark, d)).groupBy("term").agg(F.count("*").alias("mention_count"), F.count_if(F.col("mention_type") == "defines").alias("define_count"))
    return c.join(n, "term", "left").fillna(0)


@query("concept_mention_units", "SELECT term, unit_id, u.type, page FROM m JOIN u ON u.id = m.unit_id WHERE term = 'tion' AND mention_type = 'defines'", units=True)
def concept_mention_units(spark, d):
    u = fx.units(spark, d)
    return fx.mentions(u).where("term = 'tion' AND mention_type = 'defines'").join(u.select(F.col("id").alias("unit_id"), "type", "page"), "unit_id").select("term", "unit_id", "type", "page")


@query("orphan_concepts_anti", "SELECT DISTINCT term FROM m JOIN u ON u.id = m.unit_id WHERE section[2] = 'en' AND term NOT IN (SELECT term FROM m JOIN u ON u.id = m.unit_id WHERE section[2] = 'fr')", units=True)
def orphan_concepts_anti(spark, d):
    u = fx.units(spark, d)
    m = fx.mentions(u).join(u.select(F.col("id").alias("unit_id"), F.element_at("section", 2).alias("lang")), "unit_id")
    return m.where("lang = 'en'").select("term").distinct().join(m.where("lang = 'fr'"), "term", "left_anti")


@query("delete_semi", "SELECT unit_id, term FROM m WHERE unit_id NOT IN (SELECT id FROM u WHERE type = 'Image')", units=True)
def delete_semi(spark, d):
    u = fx.units(spark, d)
    return store.delete(fx.mentions(u).select("unit_id", "term"), u.where("type = 'Image'").select(F.col("id").alias("unit_id")), ["unit_id"])


@query("distinct_defined_concepts", "SELECT DISTINCT page, term FROM m JOIN u ON u.id = m.unit_id WHERE mention_type = 'defines'", units=True)
def distinct_defined_concepts(spark, d):
    u = fx.units(spark, d)
    return fx.mentions(u).where("mention_type = 'defines'").join(u.select(F.col("id").alias("unit_id"), "page"), "unit_id").select("page", "term").distinct()


@query("status_counts", "SELECT status, count(*) AS n FROM u GROUP BY 1", units=True)
def status_counts(spark, d):
    return fx.units(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@query("term_group_defines", "SELECT doc_id // 10 AS k, term, CASE WHEN bool_or(mention_type = 'defines') THEN 'defines' ELSE 'mentions' END AS mention_type, count(*) AS n FROM m GROUP BY 1, 2", units=True)
def term_group_defines(spark, d):
    m = fx.mentions(fx.units(spark, d)).withColumn("k", F.floor(F.col("doc_id") / 10))
    return m.groupBy("k", "term").agg(F.when(F.bool_or(F.col("mention_type") == "defines"), "defines").otherwise("mentions").alias("mention_type"), F.count("*").alias("n"))


@query("string_agg_context", "SELECT page, string_agg(content, chr(10) || '---' || chr(10) ORDER BY source_order) AS context FROM u GROUP BY page", units=True)
def string_agg_context(spark, d):
    u = fx.units(spark, d).select("page", F.struct("source_order", F.col("content").alias("part")).alias("x"))
    return u.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["part"]), "\n---\n").alias("context"))


@query("multiway_unit_view", "SELECT u.id, p.name AS parent_name, coalesce(k.n, 0) AS n_children, coalesce(t.terms, '') AS terms FROM u LEFT JOIN u p ON p.id = u.parent_unit_id LEFT JOIN (SELECT parent_unit_id AS id, count(*) AS n FROM u GROUP BY 1) k ON k.id = u.id LEFT JOIN (SELECT unit_id, string_agg(term, ',' ORDER BY term) AS terms FROM m GROUP BY 1) t ON t.unit_id = u.id", units=True)
def multiway_unit_view(spark, d):
    u = fx.units(spark, d)
    p = u.select(F.col("id").alias("parent_unit_id"), F.col("name").alias("parent_name"))
    k = u.groupBy(F.col("parent_unit_id").alias("id")).agg(F.count("*").alias("n_children"))
    t = fx.mentions(u).groupBy(F.col("unit_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("term")), ",").alias("terms"))
    return u.select("id", "parent_unit_id").join(p, "parent_unit_id", "left").join(k, "id", "left").join(t, "id", "left").select("id", "parent_name", F.coalesce("n_children", L(0)).alias("n_children"), F.coalesce("terms", L("")).alias("terms"))


@query("substring_theta_join", "SELECT p.p_partkey, t.term FROM part p JOIN (SELECT unnest(['ring', 'small', 'bolt small ring', 'steel']) AS term) t ON p.p_name <> '' AND (contains(t.term, lower(p.p_name)) OR contains(lower(p.p_name), t.term))")
def substring_theta_join(spark, d):
    t = spark.createDataFrame([("ring",), ("small",), ("bolt small ring",), ("steel",)], "term string")
    name = F.lower("p_name")
    return table(spark, d, "part").join(F.broadcast(t), (F.col("p_name") != "") & (F.contains(F.col("term"), name) | F.contains(name, F.col("term")))).select("p_partkey", "term")


# ---- windows and sets


@query("first_occurrence_dedupe", "SELECT doc_id, content_hash FROM u QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY doc_id) = 1", units=True)
def first_occurrence_dedupe(spark, d):
    return windows.first_occurrence(fx.units(spark, d).select("doc_id", "content_hash"), ["content_hash"], ["doc_id"])


@query("lag_consecutive_pages", "SELECT user_id, ts, event_id, coalesce(event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) = 1, false) AS carried FROM events")
def lag_consecutive_pages(spark, d):
    return windows.consecutive(table(spark, d, "events"), "user_id", "event_id").select("user_id", "ts", "event_id", "carried")


@query("last_n_containers", "SELECT page, name, cast(row_number() OVER (PARTITION BY page ORDER BY last_at DESC, name) AS INTEGER) AS position FROM (SELECT page, name, max(source_order) AS last_at FROM u WHERE name IS NOT NULL GROUP BY 1, 2) QUALIFY position <= 4", units=True)
def last_n_containers(spark, d):
    return windows.last_containers(fx.units(spark, d), "page", ["source_order"], "name", 4).select("page", "name", "position")


@query("last_turns", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4")
def last_turns(spark, d):
    return windows.last_turns(table(spark, d, "conversations"), "conv_id", "turn", 2).select("conv_id", "turn", "role")


@query("conversation_nest", "SELECT conv_id, count(*) AS n, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY 1")
def conversation_nest(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))
    return c.select("conv_id", F.size("messages").cast("long").alias("n"), F.array_join(F.transform("messages", lambda m: m["role"]), ">").alias("roles"))


@query("chunk_batches", "SELECT page, id, cast((row_number() OVER (PARTITION BY page ORDER BY source_order) - 1) // 3 AS BIGINT) AS batch FROM u", units=True)
def chunk_batches(spark, d):
    return windows.batches(fx.units(spark, d), ["page"], ["source_order"], 3).select("page", "id", "batch")


@query("cursor_page", "SELECT id FROM u ORDER BY id LIMIT 25 OFFSET 50", units=True)
def cursor_page(spark, d):
    return fx.units(spark, d).select("id").orderBy("id").offset(50).limit(25)


@query("union_ranked", "SELECT source, doc_id FROM (SELECT 'a' AS source, doc_id FROM documents WHERE lang = 'en' UNION ALL SELECT 'b', doc_id FROM documents WHERE n_chars > 1000)")
def union_ranked(spark, d):
    t = table(spark, d, "documents")
    return t.where("lang = 'en'").select(L("a").alias("source"), "doc_id").unionByName(t.where("n_chars > 1000").select(L("b").alias("source"), "doc_id"))


@query("except_seen", "SELECT id FROM u WHERE type <> 'Image' EXCEPT SELECT id FROM u WHERE status = 'done'", units=True)
def except_seen(spark, d):
    u = fx.units(spark, d)
    return u.where("type <> 'Image'").select("id").join(u.where("status = 'done'").select("id"), "id", "left_anti")


@query("intersect_citations", "SELECT id FROM u WHERE type <> 'Image' INTERSECT SELECT id FROM u WHERE status = 'done'", units=True)
def intersect_citations(spark, d):
    u = fx.units(spark, d)
    return u.where("type <> 'Image'").select("id").intersect(u.where("status = 'done'").select("id"))


@query("ordered_union", "SELECT id, min(p) AS priority FROM (SELECT id, cast(0 AS INTEGER) AS p FROM u WHERE type = 'Image' UNION ALL SELECT id, 1 FROM u) GROUP BY id", units=True)
def ordered_union(spark, d):
    u = fx.units(spark, d)
    both = u.where("type = 'Image'").select("id", L(0).alias("priority")).unionByName(u.select("id", L(1).alias("priority")))
    return both.groupBy("id").agg(F.min("priority").alias("priority"))


@query("type_filter_projection", f"SELECT id, coalesce(name, '') AS name, type FROM u WHERE type IN {TABLES_SQL} AND length(id) <= 64", units=True)
def type_filter_projection(spark, d):
    return fx.units(spark, d).where(F.col("type").isin(TABLE_TYPES) & (F.length("id") <= 64)).select("id", F.coalesce("name", L("")).alias("name"), "type")


@query("page_counters", "SELECT document_id, count(DISTINCT page) AS pages_processed, count(*) AS units_processed, count(*) FILTER (WHERE status = 'done') AS done FROM u GROUP BY 1", units=True)
def page_counters(spark, d):
    return fx.units(spark, d).groupBy("document_id").agg(F.count_distinct("page").alias("pages_processed"), F.count("*").alias("units_processed"), F.count_if(F.col("status") == STATUSES[-1]).alias("done"))
