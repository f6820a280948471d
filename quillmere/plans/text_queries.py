"""Queries for scalar functions, hierarchies and event windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmere.functions import text as X
from quillmere.operators import hierarchy
from quillmere.plans import ingest
from quillmere.plans.registry import query
from quillmere.session import prepare, table
from quillmere.sources import fixtures as fx
from quillmere.streaming import events as ev

L = F.lit


@query("normalize_terms", r"SELECT conv_id, turn, regexp_replace(lower(nfc_normalize(regexp_replace(trim(text), '^\s+|\s+$', '', 'g'))), '\s+', ' ', 'g') AS term FROM conversations")
def normalize_terms(spark, d):
    prepare(spark)
    return table(spark, d, "conversations").select("conv_id", "turn", X.normalize_term(F.col("text")).alias("term"))


@query("lexical_sanitise", """SELECT conv_id, turn, trim(regexp_replace(text, '["''*:]', ' ', 'g')) AS q FROM conversations""")
def lexical_sanitise(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.lexical_query(F.col("text")).alias("q"))


@query("text_columns", "SELECT id, array_to_string(list_concat(defines, mentions), ' ') AS metadata_terms_text, array_to_string(section, ' > ') AS section_path_text, array_to_string(aliases, ', ') AS aliases_text FROM u", units=True)
def text_columns(spark, d):
    return ingest.text_columns(fx.units(spark, d))


@query("deterministic_ids", "SELECT doc_id, id, coalesce(parent_unit_id, '') AS parent, content_hash FROM u", units=True)
def deterministic_ids(spark, d):
    return fx.units(spark, d).select("doc_id", "id", F.coalesce("parent_unit_id", L("")).alias("parent"), "content_hash")


CHAIN = """ch AS (SELECT a.id, CASE WHEN a.parent_unit_id IS NULL THEN [] WHEN p.parent_unit_id IS NULL THEN [p.name] ELSE [g.name, p.name] END AS parents
  FROM u a LEFT JOIN u p ON p.id = a.parent_unit_id LEFT JOIN u g ON g.id = p.parent_unit_id),
pa AS (SELECT u.*, array_to_string(list_filter([array_to_string(section, ' > '), array_to_string(list_filter(list_concat(parents, [name]), lambda x: x <> ''), ' > ')], lambda x: x <> ''), ' > ') AS path FROM u JOIN ch ON ch.id = u.id),
sd AS (SELECT *, concat_ws(chr(10), 'Document: book', 'Path: ' || path, CASE WHEN name <> '' THEN 'Name: ' || name END, CASE WHEN summary <> '' THEN 'Summary: ' || summary END, CASE WHEN array_to_string(aliases, ', ') <> '' THEN 'Aliases: ' || array_to_string(aliases, ', ') END) AS subject FROM pa)"""


@query("parent_chain", f"WITH {CHAIN} SELECT id, cast(len(parents) AS INTEGER) AS depth, array_to_string(parents, ' > ') AS chain FROM ch", units=True)
def parent_chain(spark, d):
    return hierarchy.parent_chains(fx.units(spark, d)).select("id", "depth", F.array_join("parents", " > ").alias("chain"))


@query("parent_chain_recursive", f"WITH {CHAIN} SELECT id, cast(len(parents) AS INTEGER) AS depth, array_to_string(parents, ' > ') AS chain FROM ch", units=True)
def parent_chain_recursive(spark, d):
    return hierarchy.recursive_chains(fx.units(spark, d)).select("id", F.col("depth").cast("int").alias("depth"), F.array_join("path", " > ").alias("chain"))


@query("unit_path", f"WITH {CHAIN} SELECT id, path FROM pa", units=True)
def unit_path(spark, d):
    u = fx.units(spark, d)
    return u.join(hierarchy.parent_chains(u), "id").select("id", X.unit_path(F.col("section"), F.col("parents"), F.col("name")).alias("path"))


@query("subject_doc", f"WITH {CHAIN} SELECT id, sha256(subject) AS subject_hash FROM sd", units=True)
def subject_doc(spark, d):
    return ingest.embedding_documents(fx.units(spark, d), "book").select("id", F.sha2("subject", 256).alias("subject_hash"))


@query("content_doc_budget", f"""WITH {CHAIN}, fd AS (SELECT id, content, subject, subject || chr(10) || chr(10) || 'Content:' || chr(10) || content AS whole FROM sd),
b AS (SELECT *, 2000 - cast(ceil(octet_length(encode(subject)) / 2.5::DOUBLE) AS BIGINT) - 10 AS rest FROM fd)
SELECT id, length(CASE WHEN ceil(octet_length(encode(whole)) / 2.5::DOUBLE) <= 2000 THEN whole WHEN rest <= 0 THEN subject ELSE subject || chr(10) || chr(10) || 'Content:' || chr(10) || substr(content, 1, cast(floor(rest * 2.5::DOUBLE) AS BIGINT)) END) AS n_chars FROM b""", units=True)  # fmt: skip
def content_doc_budget(spark, d):
    import dataclasses

    from quillmere.config import DEFAULT

    return ingest.embedding_documents(fx.units(spark, d), "book", dataclasses.replace(DEFAULT, embed_budget_tokens=2000)).select("id", F.length("content").cast("long").alias("n_chars"))


@query("rerank_doc", "SELECT id, sha256('Section: ' || array_to_string(section, ' > ') || CASE WHEN name <> '' THEN chr(10) || 'Name: ' || name ELSE '' END || chr(10) || 'Summary: ' || summary || CASE WHEN aliases[1] <> '' THEN chr(10) || 'Aliases: ' || aliases[1] ELSE '' END || chr(10) || chr(10) || 'Content:' || chr(10) || content) AS h FROM u", units=True)
def rerank_doc(spark, d):
    u = fx.units(spark, d)
    doc = X.rerank_document(F.col("section"), F.col("name"), F.col("summary"), X.aliases_text(F.col("metadata.aliases")), F.col("content"))
    return u.select("id", F.sha2(doc, 256).alias("h"))


@query("token_estimate", "SELECT doc_id, cast(ceil(octet_length(encode(text)) / 2.5::DOUBLE) AS BIGINT) AS n FROM documents")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("n"))


@query("citation_extract", "SELECT a.page, string_agg(DISTINCT b.id, ',' ORDER BY b.id) AS cited FROM u a JOIN u b ON a.page = b.page WHERE b.type <> 'Image' GROUP BY 1", units=True)
def citation_extract(spark, d):
    u = fx.units(spark, d)
    answer = u.where("type <> 'Image'").groupBy("page").agg(F.array_join(F.collect_list(F.concat(L("see "), "id", L(" and RULE-00042"))), "; ").alias("answer"))
    return answer.select("page", F.array_join(F.array_sort(X.citations(F.col("answer"))), ",").alias("cited"))


@query("json_block", "SELECT event_id, CASE event_id % 4 WHEN 3 THEN event_type WHEN 2 THEN '[' || event_id || ', 2]' ELSE props END AS v FROM events")
def json_block(spark, d):
    e, k = table(spark, d, "events"), F.col("event_id") % 4
    said = F.when(k == 0, F.concat(F.lit("x ```json\n"), "props", F.lit("\n``` y"))).when(k == 1, F.concat(F.lit("well "), "props", F.lit(" ok"))).when(k == 2, F.concat(F.lit("so: ["), F.col("event_id").cast("string"), F.lit(", 2] done"))).otherwise(F.concat(F.lit("  "), "event_type", F.lit(" ")))
    return e.select("event_id", X.json_block(said).alias("v"))


@query("clamp_threshold", "SELECT event_id, least(1.0::DOUBLE, greatest(0.0::DOUBLE, CASE WHEN event_id % 4 = 0 THEN 0.3::DOUBLE ELSE value / 50 END)) AS threshold FROM events")
def clamp_threshold(spark, d):
    return table(spark, d, "events").select("event_id", X.clamp(F.when(F.col("event_id") % 4 != 0, F.col("value") / 50)).alias("threshold"))


@query("answer_chunks", "SELECT conv_id, turn, cast(i AS INTEGER) AS i, substr(text, cast(i * 50 + 1 AS BIGINT), 50) AS chunk FROM (SELECT conv_id, turn, text, unnest(range(0, cast(ceil(length(text) / 50.0) AS BIGINT))) AS i FROM conversations WHERE text <> '')")
def answer_chunks(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(X.chunks(F.col("text"))).alias("i", "chunk"))


@query("backoff_table", "SELECT event_id, cast(least(30000, 500 * pow(2, user_id % 10)) AS BIGINT) AS ms FROM events")
def backoff_table(spark, d):
    return table(spark, d, "events").select("event_id", X.backoff_ms(F.col("user_id") % 10).alias("ms"))


@query("vector_metadata_json", "SELECT doc_id, type, page, 'pages/doc/' || page || '.png' AS key FROM u", units=True)
def vector_metadata_json(spark, d):
    u = fx.units(spark, d).select("doc_id", F.to_json(F.struct("id", "type", "page", "name")).alias("meta"), "document_id")
    parsed = u.withColumn("m", F.from_json("meta", "id string, type string, page int, name string"))
    return parsed.select("doc_id", "m.type", "m.page", X.page_key(F.col("document_id"), F.col("m.page")).alias("key"))


@query("event_props_json", "SELECT event_id, json_extract_string(props, '$.k') AS k, cast(length(props) AS BIGINT) AS n FROM events")
def event_props_json(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.length("props").cast("long").alias("n"))


# ---- hierarchies


@query("tree_levels", f"WITH {CHAIN} SELECT cast(len(parents) AS INTEGER) AS depth, count(*) AS n FROM ch GROUP BY 1", units=True)
def tree_levels(spark, d):
    return hierarchy.parent_chains(fx.units(spark, d)).groupBy("depth").agg(F.count("*").alias("n"))


@query("section_inherit", "WITH s AS (SELECT id, parent_unit_id, CASE WHEN source_order % 3 = 0 AND source_order > 0 THEN [] ELSE section END AS section FROM u) SELECT a.id, array_to_string(CASE WHEN len(a.section) > 0 THEN a.section WHEN len(p.section) > 0 THEN p.section ELSE g.section END, ' > ') AS path FROM s a LEFT JOIN s p ON p.id = a.parent_unit_id LEFT JOIN s g ON g.id = p.parent_unit_id", units=True)
def section_inherit(spark, d):
    u = fx.units(spark, d).withColumn("section", F.when((F.col("source_order") % 3 == 0) & (F.col("source_order") > 0), F.array().cast("array<string>")).otherwise(F.col("section")))
    return hierarchy.inherit_sections(u).select("id", F.array_join("section", " > ").alias("path"))


@query("table_type_repair", """WITH a AS (SELECT u.*, CASE WHEN p.type = 'DataTableHeader' THEN 'DataTableRow' WHEN p.type = 'ColumnListTable' THEN 'ColumnListItem' ELSE u.type END AS t1 FROM u LEFT JOIN u p ON p.id = u.parent_unit_id),
b AS (SELECT a.*, CASE WHEN a.source_order < 7 THEN a.t1 WHEN p.t1 = 'DataTableHeader' THEN 'DataTableRow' WHEN p.t1 = 'ColumnListTable' THEN 'ColumnListItem' ELSE a.type END AS t2 FROM a LEFT JOIN (SELECT id, t1 FROM a) p ON p.id = a.parent_unit_id),
c AS (SELECT parent_unit_id AS id, arg_min(t2, source_order) FILTER (WHERE t2 IN ('DataTableRow', 'ColumnListItem')) AS first FROM b WHERE parent_unit_id IS NOT NULL GROUP BY 1)
SELECT b.id, CASE WHEN t2 IN ('Rule', 'Image') AND first = 'DataTableRow' THEN 'DataTableHeader' WHEN t2 IN ('Rule', 'Image') AND first = 'ColumnListItem' THEN 'ColumnListTable' ELSE t2 END AS type FROM b LEFT JOIN c ON c.id = b.id""", units=True)  # fmt: skip
def table_type_repair(spark, d):
    prepare(spark)
    return ingest.repair_table_types(fx.units(spark, d))


@query("siblings", "SELECT a.id, b.id AS sibling FROM u a JOIN u b ON a.parent_unit_id = b.parent_unit_id AND a.id <> b.id WHERE a.type = 'DataTableRow'", units=True)
def siblings(spark, d):
    u = fx.units(spark, d)
    b = u.select(F.col("id").alias("sibling"), "parent_unit_id")
    return u.where("type = 'DataTableRow'").select("id", "parent_unit_id").join(b, "parent_unit_id").where("id <> sibling").select("id", "sibling")


@query("children_parent_expand", """WITH s AS (SELECT * FROM u WHERE status = 'done' AND type NOT IN ('Rule', 'Image')), sd AS (SELECT id FROM u WHERE status = 'done'),
x AS (SELECT u.id, 0 AS o, 'parent' AS role FROM s JOIN u ON u.id = s.parent_unit_id UNION ALL SELECT u.id, 1, 'sibling' FROM s JOIN u ON u.parent_unit_id = s.parent_unit_id AND u.id <> s.id WHERE s.type = 'DataTableRow'
  UNION ALL SELECT u.id, 2, 'child' FROM s JOIN u ON u.parent_unit_id = s.id WHERE s.type <> 'DataTableRow')
SELECT id, arg_min(role, o) AS role FROM x WHERE id NOT IN (SELECT id FROM sd) GROUP BY id""", units=True)  # fmt: skip
def children_parent_expand(spark, d):
    u = fx.units(spark, d)
    return hierarchy.expand(u.where("status = 'done'"), u).select("id", "role")


def _named(u):
    # a page's units share a few names, so that names repeat and resolve to the latest
    return u.select("id", "document_id", "page", "source_order", F.concat(L("n"), (F.col("source_order") % 3).cast("string")).alias("name"), F.when(F.col("source_order") % 4 != 0, F.concat(L("n"), ((F.col("doc_id") * 7) % 4).cast("string"))).alias("parent_name"))


NAMED = "v AS (SELECT id, page, source_order, doc_id, 'n' || (source_order % 3) AS name, CASE WHEN source_order % 4 <> 0 THEN 'n' || ((doc_id * 7) % 4) END AS parent_name FROM u)"


@query("asof_parent_name", f"WITH {NAMED} SELECT a.id, coalesce((SELECT b.id FROM v b WHERE b.page = a.page AND b.source_order < a.source_order AND b.name = a.parent_name AND a.parent_name <> a.name ORDER BY b.source_order DESC LIMIT 1), '') AS parent_id FROM v a", units=True)
def asof_parent_name(spark, d):
    return hierarchy.asof_parent(_named(fx.units(spark, d)), ["page"], "source_order").select("id", F.coalesce("parent_id", L("")).alias("parent_id"))


@query("asof_cross_page", f"WITH {NAMED} SELECT a.id, coalesce(max(b.doc_id), -1) AS parent_doc FROM v a LEFT JOIN v b ON b.doc_id < a.doc_id AND b.name = a.parent_name AND a.parent_name <> a.name GROUP BY a.id", units=True)
def asof_cross_page(spark, d):
    u = fx.units(spark, d)
    named = _named(u).withColumn("at", (F.col("page") - 1).cast("long") * 10 + F.col("source_order"))
    by_doc = named.withColumn("unit", F.col("id")).withColumn("id", F.col("at"))
    return hierarchy.asof_parent(by_doc, ["document_id"], "at").select(F.col("unit").alias("id"), F.coalesce("parent_id", L(-1)).cast("long").alias("parent_doc"))


@query("summary_context", """WITH k AS (SELECT parent_unit_id AS id, sum(length(content)) AS chars, string_agg(name, ', ' ORDER BY source_order) AS children FROM u WHERE parent_unit_id IS NOT NULL GROUP BY 1)
SELECT u.id, coalesce(p.name, '') AS parent_name, CASE WHEN chars <= 3000 THEN children ELSE '' END AS children FROM u LEFT JOIN u p ON p.id = u.parent_unit_id LEFT JOIN k ON k.id = u.id""", units=True)  # fmt: skip
def summary_context(spark, d):
    return ingest.summary_inputs(fx.units(spark, d))


@query("phase_summary", "SELECT id, CASE WHEN status = 'pending' THEN 'summary_done' ELSE status END AS status, length(summary) AS n FROM u", units=True)
def phase_summary(spark, d):
    return ingest.run_phase(fx.units(spark, d), "summary").select("id", "status", F.length("summary").cast("long").alias("n"))


@query("geography_depth", "SELECT r_name, n_name, count(*) AS customers, count(o_orderkey) AS orders FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) o ON o_custkey = c_custkey GROUP BY 1, 2")
def geography_depth(spark, d):
    t = lambda n: table(spark, d, n)
    o = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("o_orderkey"))
    n = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 nations, 5 regions, fixed
    return t("customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(o, "c_custkey", "left").groupBy("r_name", "n_name").agg(F.count("*").alias("customers"), F.count("o_orderkey").alias("orders"))


# ---- event time


@query("window_tumbling", "SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def window_tumbling(spark, d):
    return ev.tumbling(table(spark, d, "events")).withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("total", F.round("total", 4))


@query("window_sliding", "SELECT b - INTERVAL '1 day' * k AS start, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT time_bucket(INTERVAL '1 day', ts) AS b, value, unnest([0, 1]) AS k FROM events) GROUP BY 1")
def window_sliding(spark, d):
    return ev.sliding(table(spark, d, "events")).withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("total", F.round("total", 4))


@query("window_session", """WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""")
def window_session(spark, d):
    return ev.sessions(table(spark, d, "events")).withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("total", F.round("total", 4))
