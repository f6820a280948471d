"""Queries for search, retrieval, evidence, concepts and the page stream."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.config import DEFAULT
from quillmere.operators import concepts, evidence, search, windows
from quillmere.plans import retrieval
from quillmere.plans.registry import query
from quillmere.session import prepare, scratch_path, store, table
from quillmere.sources import fixtures as fx
from quillmere.streaming import events as ev
from quillmere.streaming import pages as pg

L = F.lit


@query("topk_bm25", "SELECT question_id, lex.sub_query_index, id, cast(rank AS INTEGER) AS rank, round(score, 6) AS score FROM lex JOIN qs ON qs.sub_query_index = lex.sub_query_index", search=True)
def topk_bm25(spark, d):
    return search.bm25(fx.library(spark, d).index, fx.sub_queries(spark), fx.N_QUERIES).select("question_id", "sub_query_index", "id", "rank", F.round("score", 6).alias("score"))


@query("postings_stats", "SELECT term, count(*) AS df, cast(sum(tf) AS BIGINT) AS cf FROM po GROUP BY term", search=True)
def postings_stats(spark, d):
    return fx.library(spark, d).index.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query("index_update", """SELECT term, count(*) AS df, cast(sum(tf) AS BIGINT) AS cf FROM (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(words) AS term FROM sx WHERE id NOT IN (SELECT id FROM u WHERE type = 'Image' OR type = 'Rule')
UNION ALL SELECT id, unnest(string_split('new words words', ' ')) FROM u WHERE type = 'Rule') GROUP BY 1, 2) GROUP BY term""", search=True)  # fmt: skip
def index_update(spark, d):
    lib = fx.library(spark, d)
    rules = lib.units.where("type = 'Rule'").select("id", *(L(x).alias(c) for c, x in (("name", "new"), ("summary", "words"), ("content", "words"))), F.array().cast("array<string>").alias("section"), L(None).cast(lib.units.schema["metadata"].dataType).alias("metadata"))
    after = search.update_index(search.fork(lib.index), lib.units.where("type = 'Image'"), rules)
    return after.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query("topk_vector", "SELECT question_id, subj.sub_query_index, id, cast(rank AS INTEGER) AS rank, round(score, 6) AS score FROM subj JOIN qs ON qs.sub_query_index = subj.sub_query_index", search=True)
def topk_vector(spark, d):
    return search.vector_top_k(fx.library(spark, d).subjects, fx.questions(spark, d), fx.N_QUERIES, 15).select("question_id", "sub_query_index", "id", "rank", F.round("score", 6).alias("score"))


def lists(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.ranked_lists(fx.library(spark, d), fx.questions(spark, d), fx.N_QUERIES)


@query("rrf_fusion", "SELECT question_id, fu.sub_query_index, id, round(fused, 9) AS fused, array_to_string(sources, ',') AS sources FROM fu JOIN qs ON qs.sub_query_index = fu.sub_query_index", search=True)
def rrf_fusion(spark, d):
    return search.rrf(lists(spark, d)).select("question_id", "sub_query_index", "id", F.round("fused", 9).alias("fused"), F.array_join("sources", ",").alias("sources"))


@query("candidate_merge", """SELECT se.question_id, id, round(vector_score, 9) AS vector_score, array_to_string(sq, ',') AS subs, provenance FROM se JOIN (
  SELECT question_id, id, string_agg(source || '@' || rl.sub_query_index || '#' || rank, ' ' ORDER BY source, rank, rl.sub_query_index) AS provenance FROM rl JOIN qs ON qs.sub_query_index = rl.sub_query_index GROUP BY 1, 2) p USING (question_id, id)""", search=True)  # fmt: skip
def candidate_merge(spark, d):
    text = F.transform(F.array_sort(F.transform("provenance", lambda p: F.struct(p["type"].alias("type"), p["rank"].alias("rank"), p["sub_query_index"].alias("s")))), lambda p: F.concat(p["type"], L("@"), p["s"].cast("string"), L("#"), p["rank"].cast("string")))
    subs = F.array_join(F.transform("source_sub_queries", lambda s: s.cast("string")), ",")
    return retrieval.merge_sub_queries(search.rrf(lists(spark, d))).select("question_id", "id", F.round("vector_score", 9).alias("vector_score"), subs.alias("subs"), F.array_join(text, " ").alias("provenance"))


@query("rank_before_after_exclusion", """SELECT id, label, cast(row_number() OVER (PARTITION BY label ORDER BY first DESC, id) AS INTEGER) AS after, cast(before AS INTEGER) AS before FROM (
SELECT vec_id AS id, label, embedding[1]::DOUBLE AS first, row_number() OVER (PARTITION BY label ORDER BY embedding[1]::DOUBLE DESC, vec_id) AS before, embedding[2] AS second FROM embeddings) WHERE second <= 0""")  # fmt: skip
def rank_before_after_exclusion(spark, d):
    rows = fx.vectors(spark, d).select(F.col("doc_id").alias("id"), "label", F.element_at("vec", 1).cast("double").alias("score"), F.element_at("vec", 2).alias("second"))
    seen = rows.where("second > 0").select("id")
    before = windows.rank_before_exclusion(rows, seen, "label").select("id", F.col("rank").alias("before"))
    return windows.rank_after_exclusion(rows, seen, "label").join(before, "id").select("id", "label", F.col("rank").alias("after"), "before")


def pool(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.retrieve(fx.library(spark, d), fx.questions(spark, d), fx.N_QUERIES)


@query("max_over_subqueries", "SELECT question_id, id, round(rerank, 6) AS rerank FROM fs", pool=True)
def max_over_subqueries(spark, d):
    return pool(spark, d).select("question_id", "id", F.round(F.coalesce("rerank_score", L(0.0)), 6).alias("rerank"))


@query("final_score", "SELECT question_id, id, role, via, round(final, 6) AS final FROM fs", pool=True)
def final_score(spark, d):
    return pool(spark, d).select("question_id", "id", "role", F.coalesce("via", L("")).alias("via"), F.round("final_score", 6).alias("final"))


@query("diversity_coverage", "SELECT question_id, id, round(coverage, 6) AS coverage, round(diversity, 6) AS diversity FROM fs", pool=True)
def diversity_coverage(spark, d):
    return pool(spark, d).select("question_id", "id", F.round("coverage", 6).alias("coverage"), F.round("diversity", 6).alias("diversity"))


@query("threshold_or_fallback", """WITH x AS (SELECT *, count(*) FILTER (WHERE rerank >= 0.4 AND question_id <> 2) OVER (PARTITION BY question_id) AS k, row_number() OVER (PARTITION BY question_id ORDER BY round(CASE WHEN question_id = 2 THEN rerank * 0.3 ELSE rerank END, 9) DESC, id) AS by_rerank FROM fs)
SELECT question_id, id, round(final, 6) AS final FROM x WHERE (k > 0 AND rerank >= 0.4) OR (k = 0 AND by_rerank <= 3) QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY round(final, 9) DESC, id) <= 12""", pool=True)  # fmt: skip
def threshold_or_fallback(spark, d):
    weak = pool(spark, d).withColumn("rerank_score", F.when(F.col("question_id") == 2, F.col("rerank_score") * 0.3).otherwise(F.col("rerank_score")))  # one question that nothing answers well
    return retrieval.passing(weak).select("question_id", "id", F.round("final_score", 6).alias("final"))


@query("fallback_only", "SELECT page AS question_id, id, score AS rerank_score FROM (SELECT page, id, (doc_id * 7 % 39) / 100.0::DOUBLE AS score FROM u) QUALIFY row_number() OVER (PARTITION BY page ORDER BY round(score, 9) DESC, id) <= 3", units=True)
def fallback_only(spark, d):
    score = (F.col("doc_id") * 7 % 39) / 100.0  # all below the threshold
    rows = fx.units(spark, d).select(F.col("page").cast("long").alias("question_id"), "id", score.alias("rerank_score"), score.alias("final_score"))
    return retrieval.passing(rows).select("question_id", "id", "rerank_score")


@query("cap_seed_first", "SELECT page AS question_id, id FROM (SELECT page, id, row_number() OVER (PARTITION BY page ORDER BY parent_unit_id IS NULL DESC, length(content) / 7.0::DOUBLE DESC, id) AS n FROM u) WHERE n <= 5", units=True)
def cap_seed_first(spark, d):
    u = fx.units(spark, d)
    rows = u.select(F.col("page").alias("question_id"), "id", F.when(F.col("parent_unit_id").isNull(), "seed").otherwise("child").alias("role"), (F.length("content") / 7.0).alias("vector_score"))
    return retrieval.capped(rows, dataclasses.replace(DEFAULT, pool_cap=5)).select("question_id", "id")


@query("concept_cooccurrence", """WITH s AS (SELECT page AS q, id, source_order + 1 AS rank FROM u),
c AS (SELECT q, term FROM (SELECT q, term, row_number() OVER (PARTITION BY q ORDER BY min(rank), term) AS n FROM m JOIN s ON s.id = m.unit_id GROUP BY 1, 2) WHERE n <= 5)
SELECT q AS question_id, term, unit_id FROM (SELECT c.q, c.term, x.unit_id, row_number() OVER (PARTITION BY c.q, c.term ORDER BY x.unit_id) AS n FROM c JOIN (SELECT DISTINCT term, unit_id FROM m) x ON x.term = c.term
  JOIN u ON u.id = x.unit_id WHERE u.page <> c.q) WHERE n <= 3""", units=True)  # fmt: skip
def concept_cooccurrence(spark, d):
    lib = fx.library(spark, d)
    seeds = lib.units.select(F.col("page").alias("question_id"), "id", (F.col("source_order") + 1).alias("rank"))  # each page's units as the seeds of a question
    return concepts.cooccurring(seeds, seeds.count(), lib.mentions)[1]


@query("hybrid_retrieve", "SELECT question_id, rl.sub_query_index, source, id, cast(rank AS INTEGER) AS rank, round(score, 6) AS score FROM rl JOIN qs ON qs.sub_query_index = rl.sub_query_index", search=True)
def hybrid_retrieve(spark, d):
    return lists(spark, d).withColumn("score", F.round("score", 6))


@query("retrieve_end_to_end", "SELECT question_id, id, role, round(final, 6) AS final_score FROM ps", pool=True)
def retrieve_end_to_end(spark, d):
    return retrieval.passing(pool(spark, d)).select("question_id", "id", "role", F.round("final_score", 6).alias("final_score"))


def _pool(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of a question for every five pages: fifty each, the most that a question has."""
    u = fx.units(spark, d)
    return u.select(
        F.floor(F.col("page") / 5).cast("int").alias("query_id"), "id", "parent_unit_id", "content_hash", "name", (F.col("doc_id") % 89 / 89.0).alias("final_score"), (F.col("doc_id") % 3 != 0).alias("direct"),
        F.array((F.col("doc_id") % 3).cast("int")).alias("source_sub_queries"), F.col("metadata.mentions").alias("mentions"), F.col("metadata.aliases").alias("aliases"), "doc_id",
    )


#: The rules one after another: greedy removal and the swap pass as recursions along the ranks of a question's candidates.
EVIDENCE_SQL = """WITH RECURSIVE p AS (SELECT page // 5 AS q, id, parent_unit_id AS parent, content_hash AS h, name, doc_id % 89 / 89.0::DOUBLE AS s, doc_id % 3 <> 0 AS direct, doc_id % 3 AS sub, mentions, aliases,
    row_number() OVER (PARTITION BY page // 5 ORDER BY doc_id % 89 DESC, id) AS n FROM u),
d(q, n, ids, hs, ps) AS (SELECT DISTINCT q, 0::BIGINT, []::VARCHAR[], []::VARCHAR[], []::VARCHAR[] FROM p UNION ALL
  SELECT q, n, CASE WHEN gone THEN ids ELSE list_append(ids, id) END, CASE WHEN gone THEN hs ELSE list_append(hs, h) END, CASE WHEN gone OR parent IS NULL THEN ps ELSE list_append(ps, parent) END
  FROM (SELECT d.q, p.n, ids, hs, ps, p.id, p.h, p.parent, list_contains(ids, p.id) OR list_contains(hs, p.h) OR list_contains(ps, p.id) OR coalesce(list_contains(ids, p.parent), false) AS gone FROM d JOIN p ON p.q = d.q AND p.n = d.n + 1)),
k AS (SELECT q, unnest(ids) AS id, generate_subscripts(ids, 1) AS k FROM (SELECT q, arg_max(ids, n) AS ids FROM d GROUP BY q)),
c AS (SELECT k.q, k.id, k.k, p.sub, p.s, p.direct, row_number() OVER (PARTITION BY k.q, p.sub ORDER BY k.k) = 1 AS pick FROM k JOIN p ON p.q = k.q AND p.id = k.id),
o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY pick DESC, CASE WHEN pick THEN sub ELSE k END) AS m FROM c),
w(q, m, id, s, direct, done) AS (SELECT q, m, id, s, direct, []::VARCHAR[] FROM o WHERE m = 1 UNION ALL
  SELECT q, m, CASE WHEN swap THEN id ELSE b_id END, CASE WHEN swap THEN s ELSE b_s END, CASE WHEN swap THEN direct ELSE b_direct END, list_append(done, CASE WHEN swap THEN b_id ELSE id END)
  FROM (SELECT w.q, o.m, w.id, w.s, w.direct, w.done, o.id AS b_id, o.s AS b_s, o.direct AS b_direct, o.direct AND NOT w.direct AND abs(w.s - o.s) <= 0.05 AS swap FROM w JOIN o ON o.q = w.q AND o.m = w.m + 1)),
sel AS (SELECT q, unnest(x) AS id, generate_subscripts(x, 1) AS pos FROM (SELECT q, list_append(arg_max(done, m), arg_max(id, m)) AS x FROM w GROUP BY q)),
t AS (SELECT sel.q, sel.pos, lower(trim(unnest(p.mentions))) AS term FROM sel JOIN p ON p.q = sel.q AND p.id = sel.id),
nm AS (SELECT q, id, n, lower(trim(unnest(list_concat([coalesce(name, '')], aliases)))) AS nm FROM p),
cm AS (SELECT nm.q, nm.id, min(t.pos * 1000000 + nm.n) AS place FROM t JOIN nm ON nm.q = t.q AND nm.nm <> '' AND (contains(t.term, nm.nm) OR contains(nm.nm, t.term)) LEFT JOIN sel ON sel.q = nm.q AND sel.id = nm.id WHERE sel.id IS NULL GROUP BY 1, 2),
al AS (SELECT q, id, pos AS place FROM sel UNION ALL SELECT q, id, 1000000000 + place FROM cm),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY place) AS position FROM al)
SELECT r.q AS query_id, cast(position AS INTEGER) AS position, r.id, p.s AS score, p.direct FROM r JOIN p ON p.q = r.q AND p.id = r.id WHERE position <= 8"""


@query("evidence_select", EVIDENCE_SQL, units=True)
def evidence_select(spark, d):
    prepare(spark)
    return evidence.select_all(_pool(spark, d).drop("doc_id"), 3)


@query("evidence_hash_dedupe", "SELECT page // 5 AS query_id, id FROM u QUALIFY row_number() OVER (PARTITION BY page // 5, content_hash ORDER BY doc_id % 89 DESC, id) = 1", units=True)
def evidence_hash_dedupe(spark, d):
    p = _pool(spark, d)
    return windows.first_occurrence(p, ["query_id", "content_hash"], [F.desc(F.col("doc_id") % 89), "id"]).select("query_id", "id")


@query("evidence_budget", "SELECT page // 5 AS query_id, id, cast(row_number() OVER (PARTITION BY page // 5 ORDER BY doc_id % 89 DESC, id) AS INTEGER) AS rank FROM u QUALIFY rank <= 8", units=True)
def evidence_budget(spark, d):
    p = _pool(spark, d).withColumn("score", (F.col("doc_id") % 89).cast("double"))
    return search.top_k(p, 8, key="query_id").select("query_id", "id", "rank")


@query("evidence_complementary", "SELECT DISTINCT a.page, a.id, b.id AS other FROM u a JOIN u b ON a.page = b.page AND a.id <> b.id AND b.name <> '' WHERE len(list_filter(a.mentions, lambda t: contains(lower(trim(b.name)), t) OR contains(t, lower(trim(b.name))))) > 0", units=True)
def evidence_complementary(spark, d):
    u = fx.units(spark, d)
    b = u.select("page", F.col("id").alias("other"), F.lower(F.trim("name")).alias("b_name")).where("b_name <> ''")
    a = u.select("page", "id", F.explode("metadata.mentions").alias("term"))
    return a.join(b, "page").where("id <> other").where(F.contains(F.col("b_name"), F.col("term")) | F.contains(F.col("term"), F.col("b_name"))).select("page", "id", "other").distinct()


# ---- concepts


@query("udtf_mentions", "SELECT unit_id, term, mention_type FROM m", units=True)
def udtf_mentions(spark, d):
    return concepts.raw_mentions(fx.units(spark, d)).select("unit_id", F.col("raw_term").alias("term"), "mention_type")


@query("concept_grouping", "SELECT unit_id, term, mention_type FROM m", units=True)
def concept_grouping(spark, d):
    return concepts.group_terms(concepts.raw_mentions(fx.units(spark, d)), unicode=False).select("unit_id", "term", "mention_type")


CENTRES = [("tion", "tions", 1), ("thre", "three", 2), ("anea", "aneas", 3)]


@query("concept_resolution", """WITH v AS (SELECT term, min(doc_id) AS first FROM m GROUP BY term), e AS (SELECT v.term, v.first, x.embedding::DOUBLE[] AS vec FROM v JOIN (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM embeddings) x ON x.k = v.first % 500 WHERE v.term NOT IN ('tion', 'ble', 'ing')),
p AS (SELECT a.term, b.term AS up, round(list_cosine_similarity(a.vec, b.vec), 9) AS s FROM e a JOIN e b ON b.first < a.first), n AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY s DESC, up) AS r FROM p WHERE s > 0.55),
g AS (SELECT term, arg_min(up, r) AS up FROM n WHERE r <= 5 AND 1 - levenshtein(term, up) / greatest(length(term), length(up))::DOUBLE >= 0.8 GROUP BY term)
SELECT v.term, CASE WHEN v.term IN ('tion', 'ble', 'ing') THEN 'known ' || v.term ELSE coalesce(g2.up, g.up, v.term) END AS concept_term, CASE WHEN v.term IN ('tion', 'ble', 'ing') THEN 'exact_alias' WHEN g.up IS NULL THEN 'manual' ELSE 'embedding' END AS method FROM v LEFT JOIN g ON g.term = v.term LEFT JOIN g g2 ON g2.term = g.up""", units=True)  # fmt: skip
def concept_resolution(spark, d):
    first = store(fx.mentions(fx.units(spark, d)).groupBy("term").agg(F.min("doc_id").alias("first")), "first")  # texts are read once
    known = first.where(F.col("term").isin("tion", "ble", "ing")).select(F.col("term").alias("normalized_alias"), F.concat(L("known "), "term").alias("concept_term"))
    v = fx.vectors(spark, d).select(F.col("doc_id").alias("k"), "vec")
    return concepts.resolve(first, known, first.join(v, F.col("first") % 500 == v["k"]).select("term", "vec")).select("term", "concept_term", "method")


@query("concept_descriptions", """WITH k AS (SELECT *, CASE mention_type WHEN 'defines' THEN 0 ELSE 1 END AS kind FROM m), l AS (SELECT *, min(kind) OVER (PARTITION BY term) AS least FROM k),
n AS (SELECT l.term, substr(u.content, 1, 500) AS part, row_number() OVER (PARTITION BY l.term ORDER BY page, source_order) AS n FROM l JOIN u ON u.id = l.unit_id WHERE kind = least)
SELECT term, substr(string_agg(part, chr(10) || '---' || chr(10) ORDER BY n), 1, 2000) AS context FROM n WHERE n <= 3 GROUP BY term""", units=True)  # fmt: skip
def concept_descriptions(spark, d):
    u = fx.units(spark, d)
    return concepts.contexts(fx.mentions(u), u)


@query("affected_concepts", "SELECT DISTINCT term FROM m JOIN u ON u.id = m.unit_id WHERE page IN (1, 2) AND term IN (SELECT term FROM m JOIN u ON u.id = m.unit_id WHERE page > 2)", units=True)
def affected_concepts(spark, d):
    u = fx.units(spark, d)
    m = fx.mentions(u).join(u.select(F.col("id").alias("unit_id"), "page"), "unit_id")
    return m.where("page IN (1, 2)").select("term").distinct().join(m.where("page > 2").select("term"), "term", "left_semi")


# ---- stream and loop


def page_results(spark: SparkSession, d: str) -> DataFrame:
    u = fx.units(spark, d)
    unit = F.struct("source_order", "type", "name", "content", F.when(F.col("source_order") > 0, F.concat(L("n"), (F.col("source_order") % 3).cast("string"))).alias("parent_name"), "section")
    rows = u.withColumn("name", F.concat(L("n"), (F.col("source_order") % 3).cast("string"))).select("source_node_id", "page", unit.alias("x"))
    nested = rows.groupBy("page").agg(F.array_sort(F.collect_list("x")).alias("units"))
    fields = ["type", "name", "content", "parent_name", "section"]
    return nested.select(F.concat(L("doc"), (F.col("page") % 3).cast("string")).alias("document_id"), (F.floor(F.col("page") / 3)).cast("int").alias("page"), L(1000).alias("total_pages"), F.transform("units", lambda x: F.struct(*(x[f].alias(f) for f in fields))).alias("units"))


@query("stream_vs_batch_units", "SELECT 'doc' || (page % 3) AS document_id, page // 3 AS page, count(*) AS n_units FROM u GROUP BY 1, 2", units=True)
def stream_vs_batch_units(spark, d):
    prepare(spark)
    return pg.page_batch(page_results(spark, d)).select("document_id", F.col("page").cast("int").alias("page"), F.col("n_units").cast("long").alias("n_units"))


@query("stream_page_state", """WITH r AS (SELECT 'doc' || (page % 3) AS document_id, page // 3 AS page, source_order, 'n' || (source_order % 3) AS name, CASE WHEN source_order > 0 THEN 'n' || (source_order % 3) END AS parent_name, array_to_string(section, ' > ') AS section FROM u),
pg AS (SELECT document_id, page, count(*) AS n_units, arg_max(section, source_order) AS last_section FROM r GROUP BY 1, 2),
oc AS (SELECT a.document_id, a.page, a.name, max(a.source_order) AS so FROM r a JOIN (SELECT DISTINCT document_id, page, parent_name FROM r) b ON b.document_id = a.document_id AND b.page = a.page AND b.parent_name = a.name GROUP BY 1, 2, 3),
la AS (SELECT pg.document_id, pg.page, oc.name, max(oc.page * 100 + oc.so) AS last_at FROM pg JOIN oc ON oc.document_id = pg.document_id AND oc.page < pg.page GROUP BY 1, 2, 3),
co AS (SELECT document_id, page, string_agg(name, '|' ORDER BY last_at DESC) AS c FROM la GROUP BY 1, 2)
SELECT pg.document_id, cast(pg.page AS INTEGER) AS page, coalesce(lag(pg.page) OVER w = pg.page - 1, false) AS carried, coalesce(lag(last_section) OVER w, '') AS section_before, coalesce(c, '') AS containers_before, cast(n_units AS INTEGER) AS n_units,
  cast(row_number() OVER w AS INTEGER) AS pages_processed, cast(sum(n_units) OVER w AS INTEGER) AS units_processed, CASE WHEN row_number() OVER w >= 1000 THEN 'summary' ELSE 'vision' END AS phase
FROM pg LEFT JOIN co ON co.document_id = pg.document_id AND co.page = pg.page WINDOW w AS (PARTITION BY pg.document_id ORDER BY pg.page)""", units=True)  # fmt: skip
def stream_page_state(spark, d):
    prepare(spark)
    at = scratch_path(spark, "pages")
    page_results(spark, d).write.parquet(f"{at}/in")
    pages = spark.read.parquet(f"{at}/in")
    last = pages.agg(F.max("page")).first()[0] or 0
    for k in range(3):  # three deliveries in order of page, each of as many files as it has and read from where the last one ended
        pages.where(F.floor(F.col("page") * 3 / (last + 1)) == k).write.mode("append").parquet(f"{at}/queue")
        pg.run_stream(spark, f"{at}/queue", f"{at}/checkpoint", f"{at}/out", files_per_trigger=pg.ALL_FILES)
    return spark.read.schema(pg.OUT).parquet(f"{at}/out")


@query("redelivery_idempotent", "SELECT count(*) AS n, count(DISTINCT id) AS ids FROM u", units=True)
def redelivery_idempotent(spark, d):
    from quillmere.operators import store

    p = page_results(spark, d)
    twice = p.withColumn("seq", L(0)).unionByName(p.withColumn("seq", L(1)))
    units = store.keep_latest(twice, ["document_id", "page"], "seq")
    out = pg.page_units(units)
    return out.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


@query("late_data", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2 HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def late_data(spark, d):
    at = scratch_path(spark, "events")
    e = table(spark, d, "events")
    late = e.where("ts < '2024-01-02'")  # comes again when its windows are closed
    for part in (*(e.where(F.floor((F.dayofmonth("ts") - 1) / 8) == k) for k in range(4)), late):
        part.coalesce(1).write.mode("append").parquet(f"{at}/in")
    ev.stream_tumbling(spark, f"{at}/in", f"{at}/checkpoint", f"{at}/out")
    return spark.read.schema("start timestamp, event_type string, n long, total double").parquet(f"{at}/out")


ASKED = ["that and this; with from are; zzzz qqqq", "tion thre", "hello", "list ther thin", "zzzz"]


def answered(spark: SparkSession, d: str) -> list[dict]:
    some = {r.query: list(r.query_vec) for r in fx.questions(spark, d).collect()}  # the fixed sub-queries
    first = next(iter(dict(sorted(some.items())).values()))
    return retrieval.run_queries(spark, ASKED, fx.library(spark, d), lambda qs: [some.get(q, first) for q in qs])


@query("loop_iterations")
def loop_iterations(spark, d):
    rows = [(i, t["iteration"], " | ".join(t["sub_queries"]), t["found"], len(t["follow_ups"])) for i, x in enumerate(answered(spark, d)) for t in x["trail"]]
    return spark.createDataFrame(rows, "question_id int, iteration int, sub_queries string, found int, n_follow_ups int")
