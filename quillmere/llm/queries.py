"""Queries over the test tables that apply the operators of this subpackage, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm import collocations, decontamination, hard_negatives, html_wrappers, licenses, mixing, pii, quality_model, quality_rules, simhash, substring_dedup, token_counts, warc
from quillmere.session import scratch_path, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("w0"), 16, "0")).alias("fingerprint"), "component_id")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_scores(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id").drop("mark")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_warc(warc.plan_records(table(spark, sf_dir, "pages")), scratch_path(spark, "warc"))
    records = warc.read_warc(archives, payloads=False)
    return records.select(warc.page_id_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_id_of("refers_to").alias("refers_to"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda n, d: n + d.words)
    return mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrappers.extract_main_text(table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumnRenamed("id", "doc_id").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), VOCABULARY, ship=True)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("pii_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("pii_spans", lambda s: s["kind"] != "term")
    return found.select("doc_id", *(count(k) for k in pii.KINDS), F.sha2(pii.span_text(base), 256).alias("base_sha256"), pii.span_text(F.col("pii_spans")).alias("spans"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.drop_repeats(table(spark, sf_dir, "documents"), texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.withColumn("label", moved), F.col("id") % 100 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_simhash, op2_quality_classifier, op3_warc, op4_licenses, op5_mixing, op6_html_text, op7_quality_rules, op8_token_counts, op9_decontamination, op10_pii, op11_collocations, op12_substring_dedup, op13_hard_negatives, pipeline]
    return {f.__name__: f for f in own}


OP3_SQL = """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS dg, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
m AS (SELECT dg, max(page_id) AS first_id FROM p WHERE n >= 1000 GROUP BY dg)
SELECT p.page_id, cast(n AS BIGINT) AS payload_bytes, p.dg AS payload_digest,
       CASE WHEN p.page_id < m.first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id < m.first_id THEN m.first_id END AS refers_to
FROM p LEFT JOIN m ON p.dg = m.dg
"""

OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(cast(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, ''))) || ':42') AS mark FROM documents),
s AS (SELECT source, cast(sum(size) AS BIGINT) AS ss,
             1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 AS w FROM d GROUP BY source),
k AS (SELECT *, 3.0 * ss / w AS ratio, sum(ss) OVER () AS total FROM s),
c AS (SELECT *, coalesce(sum(3 * ss) OVER (ORDER BY ratio, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
             sum(w) OVER (ORDER BY ratio, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w FROM k),
l AS (SELECT *, (total - capped) / rest_w::DOUBLE AS level FROM c),
z AS (SELECT arg_min(level, ratio) FILTER (WHERE level <= ratio) AS level FROM l),
t AS (SELECT l.source, l.ss, CASE WHEN l.w * z.level > 3 * l.ss THEN 3.0::DOUBLE * l.ss ELSE l.w * z.level END AS target FROM l, z),
q AS (SELECT *, cast(round_even(target, 0) AS BIGINT) AS words FROM t),
r AS (SELECT d.doc_id, d.size, q.ss AS source_size, q.target, q.words,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.mark, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target,
       cast(CASE WHEN source_size = 0 THEN 0 ELSE (words // source_size) * size + least(size, greatest(0, words % source_size - before)) END AS BIGINT) AS taken
FROM r
"""

OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(cast(item_id AS VARCHAR), '') AS item_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT item_id, w, least(10, len(w)) AS l FROM b WHERE len(w) > 0),
v AS (SELECT DISTINCT item_id, l, array_to_string(w[i : i + l - 1], ' ') AS gram FROM (SELECT item_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM g)),
n AS (SELECT r, i, l, array_to_string(w[i : i + l - 1], ' ') AS gram
      FROM (SELECT d.r, d.w, x.l, unnest(range(1, len(d.w) - x.l + 2)) AS i FROM d, (SELECT DISTINCT l FROM v) x WHERE len(d.w) >= x.l)),
h AS (SELECT n.r, n.i, n.l, v.item_id FROM n JOIN v ON n.gram = v.gram AND n.l = v.l),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + l)) AS p FROM h) GROUP BY r),
it AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM h GROUP BY r)
SELECT d.doc_id, cast(len(d.w) AS BIGINT) AS n_words, cast(coalesce(n_hit, 0) AS BIGINT) AS n_hit, cast(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.r = hit.r LEFT JOIN it ON d.r = it.r
"""


OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
f AS (SELECT r, 'email' AS kind, 1 AS o, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+' AS p, text FROM d WHERE contains(text, '@')
  UNION ALL SELECT r, 'ip', 2, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)', text FROM d UNION ALL SELECT r, 'card', 3, '[0-9](?:[\x20-]?[0-9])+', text FROM d
  UNION ALL SELECT r, 'phone', 4, '\+[0-9][\x20().0-9-]+[0-9]', text FROM d WHERE contains(text, '+')),
x AS (SELECT r, kind, o, regexp_extract_all(text, p) AS m, string_split_regex(text, p) AS g FROM f),
e AS (SELECT r, kind, o, m, g, unnest(m) AS v, unnest(range(1, len(m) + 1)) AS i FROM x WHERE len(m) > 0),
s AS (SELECT r, kind, o, v, g[i] AS g0, g[i + 1] AS g1, regexp_replace(v, '[^0-9]', '', 'g') AS dg,
        cast(list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda y: length(y))), 0) AS BIGINT) AS a FROM e),
b AS (SELECT r, kind, o, v, g0, g1, dg, a, a + length(v) AS z FROM s WHERE kind = 'email'
  OR kind = 'ip' AND list_bool_and(list_transform(string_split(v, '.'), lambda y: length(ltrim(y, '0')) <= 3 AND coalesce(try_cast(y AS HUGEINT), 999) <= 255))
  OR kind = 'phone' AND length(dg) BETWEEN 8 AND 15
  OR kind = 'card' AND length(dg) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, cast(length(dg) AS BIGINT) + 1), lambda y:
       CASE WHEN y % 2 = 1 THEN cast(dg[length(dg) - y + 1] AS INTEGER) ELSE cast(dg[length(dg) - y + 1] AS INTEGER) * 2 - CASE WHEN dg[length(dg) - y + 1] > '4' THEN 9 ELSE 0 END END)) % 10 = 0),
c AS (SELECT d.text, kind || ':' || CASE WHEN kind IN ('card', 'phone') THEN dg ELSE lower(v) END AS entity,
        list_filter(string_split_regex(lower(g0), '[^\p{L}]+'), lambda y: length(y) >= 2) AS lft,
        list_filter(string_split_regex(lower(g1), '[^\p{L}]+'), lambda y: length(y) >= 2) AS rgt FROM b JOIN d ON d.r = b.r),
ce AS (SELECT entity, count(DISTINCT text) AS c_e FROM c GROUP BY entity),
cn AS (SELECT entity, term FROM (SELECT entity, text, unnest(list_concat(lft[greatest(1, len(lft) - 2) :], rgt[1:3])) AS term FROM c) GROUP BY 1, 2 HAVING count(DISTINCT text) >= 3),
w AS (SELECT text, unnest(list_distinct(string_split_regex(lower(text), '[^\p{L}]+'))) AS term FROM (SELECT DISTINCT text FROM d)),
tt AS (SELECT term, count(*) AS c_t FROM w WHERE term IN (SELECT term FROM cn) GROUP BY term),
ct AS (SELECT cn.entity, cn.term, count(*) AS c_te FROM cn JOIN (SELECT DISTINCT entity, text FROM c) h ON h.entity = cn.entity JOIN w ON w.text = h.text AND w.term = cn.term GROUP BY 1, 2),
t AS (SELECT DISTINCT ct.term FROM ct JOIN ce ON ce.entity = ct.entity JOIN tt ON tt.term = ct.term, (SELECT count(DISTINCT text) AS n FROM d)
      WHERE c_te >= 0.8 * c_t AND log2(c_te * n / (c_t * c_e)::DOUBLE) >= 5),
lx AS (SELECT r, regexp_extract_all(text, '\p{L}+') AS m, string_split_regex(text, '\p{L}+') AS g FROM d WHERE text IN (SELECT text FROM w WHERE term IN (SELECT term FROM t))),
le AS (SELECT r, m, g, unnest(m) AS v, unnest(range(1, len(m) + 1)) AS i FROM lx),
ls AS (SELECT r, v, cast(list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda y: length(y))), 0) AS BIGINT) AS a FROM le WHERE lower(v) IN (SELECT term FROM t)),
lo AS (SELECT r, 'term' AS kind, 5 AS o, a, a + length(v) AS z FROM ls WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.r = ls.r AND b.a < ls.a + length(ls.v) AND ls.a < b.z)),
al AS (SELECT r, kind, o, a, z FROM b UNION ALL SELECT r, kind, o, a, z FROM lo),
n AS (SELECT r, count(*) FILTER (WHERE o = 1) AS e, count(*) FILTER (WHERE o = 2) AS i, count(*) FILTER (WHERE o = 3) AS c, count(*) FILTER (WHERE o = 4) AS p,
        string_agg(kind || ':' || a || ':' || z, ',' ORDER BY o, a) FILTER (WHERE o < 5) AS base, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY o, a) AS spans FROM al GROUP BY r)
SELECT doc_id, coalesce(e, 0) AS n_email, coalesce(i, 0) AS n_ip, coalesce(c, 0) AS n_card, coalesce(p, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN n ON n.r = d.r
"""


OP11_SQL = r"""
WITH p AS (SELECT row_number() OVER () AS i, lang, piece FROM (
       SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, cast(sum(len(w)) AS HUGEINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, w, i FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM f WHERE k >= 2),
s AS (SELECT c.lang, c.phrase, c.k, c.a, cut, l.f AS l, r.f AS r, n.n, cast(1000 * cast(c.a AS HUGEINT) * n.n // (cast(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
      FROM c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:cut], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[cut + 1 : c.k], ' ') JOIN n ON n.lang = c.lang),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
x AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.lang = m.lang AND f.k > m.k AND contains(' ' || f.phrase || ' ', ' ' || m.phrase || ' ') AND 100 * f.f >= 100 * m.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, cast(n AS BIGINT) AS n, score, cast(cut AS INTEGER) AS cut FROM x
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""

OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, doc_id, i, array_to_string(w[i : i + 12], ' ') AS gram FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
e AS (SELECT gram, min(doc_id) AS first_id FROM g GROUP BY gram HAVING count(*) > 1),
h AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS p FROM g JOIN e ON g.gram = e.gram WHERE e.first_id < coalesce(g.doc_id, 9223372036854775807)),
o AS (SELECT r, list(p) AS ps, count(*) AS n FROM h GROUP BY r)
SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, cast(coalesce(o.n, 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN o.n IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_filter(w, lambda x, i: NOT list_contains(o.ps, i)), ' ') END) AS kept_sha256
FROM d LEFT JOIN o ON o.r = d.r
"""

OP13_SQL = r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: cast(floor(256 * cast(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, cast(coalesce(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])), 0) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, cast(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 10
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express; the others have brute-force tests in tests/llm."""
    return {"op3_warc": OP3_SQL, "op5_mixing": OP5_SQL, "op9_decontamination": OP9_SQL, "op10_pii": OP10_SQL, "op11_collocations": OP11_SQL, "op12_substring_dedup": OP12_SQL, "op13_hard_negatives": OP13_SQL}
