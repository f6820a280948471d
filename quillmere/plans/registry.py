"""Registry of queries, and the SQL text that the test tables' adapters become."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

TYPES_SQL = "['Rule', 'Image', 'DataTableHeader', 'DataTableRow', 'ColumnListTable', 'ColumnListItem']"
TABLES_SQL = "('DataTableHeader', 'DataTableRow', 'ColumnListTable', 'ColumnListItem')"
VOCAB_SQL = "['tion', 'thre', 'thth', 'anea', 'ther', 'thin', 'thor', 'thed', 'ble', 'ing']"
#: Units, mentions and questions over the raw tables.
UNITS_SQL = rf"""
u0 AS (SELECT doc_id, cast(doc_id // 10 + 1 AS INTEGER) AS page, cast(doc_id % 10 AS INTEGER) AS source_order, text AS content, lang, source,
              list_extract({TYPES_SQL}, cast(doc_id % 6 AS INTEGER) + 1) AS type FROM documents),
u1 AS (SELECT *, CASE WHEN type = 'Image' THEN 'IMG' WHEN type = 'Rule' THEN 'RULE' ELSE 'TABLE' END || '-' || substr(sha256('doc:' || page || ':' || source_order), 1, 32) AS id FROM u0),
u2 AS (SELECT a.doc_id, a.id, 'doc' AS document_id, a.source AS source_node_id, p.id AS parent_unit_id, a.source_order, a.type,
              array_to_string(string_split(a.content, ' ')[1:3], ' ') AS name, a.page, [a.source, a.lang] AS section, a.content, sha256(a.content) AS content_hash,
              substr(a.content, 1, 240) AS summary,
              list_extract(['pending', 'summary_done', 'metadata_done', 'embedding_done', 'done'], cast(a.doc_id % 5 AS INTEGER) + 1) AS status
       FROM u1 a LEFT JOIN u1 p ON p.page = a.page AND p.source_order = CASE WHEN a.source_order = 0 THEN -1 WHEN a.source_order >= 7 THEN 6 ELSE 0 END),
u AS (SELECT *, list_filter({VOCAB_SQL}, lambda v: list_contains(regexp_split_to_array(lower(name), '[^\p{{L}}\p{{N}}]+'), v)) AS defines,
             list_filter({VOCAB_SQL}, lambda v: list_contains(regexp_split_to_array(lower(content), '[^\p{{L}}\p{{N}}]+'), v)
                                      AND NOT list_contains(regexp_split_to_array(lower(name), '[^\p{{L}}\p{{N}}]+'), v)) AS mentions,
             [string_split(name, ' ')[1] || '-x'] AS aliases FROM u2),
m AS (SELECT id AS unit_id, doc_id, unnest(defines) AS term, 'defines' AS mention_type FROM u UNION ALL SELECT id, doc_id, unnest(mentions), 'mentions' FROM u)
"""
QUESTIONS_SQL = """
qs AS (SELECT cast(question_id AS BIGINT) AS question_id, sub_query_index FROM (VALUES (0, 0), (0, 1), (0, 2), (0, 3), (0, 4), (1, 0), (2, 2), (3, 4), (4, 1), (4, 3)) t(question_id, sub_query_index)),
q AS (SELECT * FROM (VALUES (0, 'that and this'), (1, 'with from are'), (2, 'tion thre'), (3, 'ther thin'), (4, 'ble anea')) v(sub_query_index, query)),
qv AS (SELECT q.sub_query_index, q.query, e.embedding::DOUBLE[] AS query_vec FROM q JOIN embeddings e ON e.vec_id = 7 * q.sub_query_index + 3)
"""
SEARCH_SQL = r"""
sx AS (SELECT id, list_filter(regexp_split_to_array(lower(concat_ws(' ', name, summary, content, array_to_string(section, ' > '),
          array_to_string(list_concat(defines, mentions), ' '), array_to_string(aliases, ', '))), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS words FROM u),
dl AS (SELECT id, len(words) AS len FROM sx),
po AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(words) AS term FROM sx) GROUP BY id, term),
asked AS (SELECT DISTINCT sub_query_index, unnest(string_split(query, ' ')) AS term FROM q),
st AS (SELECT count(*)::DOUBLE AS n, avg(len) AS avgdl FROM dl),
df AS (SELECT term, count(*)::DOUBLE AS df FROM po WHERE term IN (SELECT term FROM asked) GROUP BY term),
bs AS (SELECT a.sub_query_index, p.id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * len / avgdl))) AS score, count(*) AS matched
       FROM asked a JOIN po p ON a.term = p.term JOIN df ON df.term = p.term JOIN dl ON dl.id = p.id, st GROUP BY a.sub_query_index, p.id),
bm AS (SELECT sub_query_index, id, score, row_number() OVER (PARTITION BY sub_query_index ORDER BY round(score, 9) DESC, id) AS rank FROM bs
       JOIN (SELECT sub_query_index AS k, count(*) AS wanted FROM asked GROUP BY 1) w ON w.k = bs.sub_query_index AND matched = wanted),
lex AS (SELECT * FROM bm WHERE rank <= 15),
vs AS (SELECT qv.sub_query_index, u.id, list_cosine_similarity(e.embedding::DOUBLE[], qv.query_vec) AS score FROM u JOIN embeddings e ON e.vec_id = u.doc_id, qv),
subj AS (SELECT *, row_number() OVER (PARTITION BY sub_query_index ORDER BY round(score, 9) DESC, id) AS rank FROM vs QUALIFY rank <= 15),
nv AS (SELECT count(*) AS n FROM embeddings),
vc AS (SELECT qv.sub_query_index, u.id, list_cosine_similarity(e.embedding::DOUBLE[], qv.query_vec) AS score FROM nv, u JOIN embeddings e ON e.vec_id = (u.doc_id + 1) % (SELECT count(*) FROM embeddings), qv WHERE u.doc_id < n),
cont AS (SELECT *, row_number() OVER (PARTITION BY sub_query_index ORDER BY round(score, 9) DESC, id) AS rank FROM vc QUALIFY rank <= 15),
rl AS (SELECT sub_query_index, 'vector_subject' AS source, id, rank, score FROM subj UNION ALL SELECT sub_query_index, 'vector_content', id, rank, score FROM cont
       UNION ALL SELECT sub_query_index, 'lexical', id, rank, score FROM lex),
fu AS (SELECT sub_query_index, id, sum(1.0::DOUBLE / (60 + rank)) AS fused, list_sort(list(DISTINCT source)) AS sources FROM rl GROUP BY 1, 2),
se AS (SELECT question_id, fu.id, arg_min(fused, fu.sub_query_index) AS vector_score, list_sort(list(DISTINCT fu.sub_query_index)) AS sq FROM fu JOIN qs ON qs.sub_query_index = fu.sub_query_index GROUP BY 1, 2)
"""
#: The pool of each question: seeds, what concepts and hierarchy add, the cap, and scores.
POOL_SQL = r"""
nq AS (SELECT question_id, count(*) AS n FROM qs GROUP BY 1),
rk AS (SELECT question_id, id, row_number() OVER (PARTITION BY question_id ORDER BY round(vector_score, 9) DESC, id) AS rank FROM se),
cc AS (SELECT question_id, term FROM (SELECT question_id, term, row_number() OVER (PARTITION BY question_id ORDER BY min(rank), term) AS n FROM rk JOIN m ON m.unit_id = rk.id GROUP BY 1, 2) WHERE n <= 5),
ot AS (SELECT cc.question_id, cc.term, x.unit_id AS id FROM cc JOIN (SELECT DISTINCT term, unit_id FROM m) x ON x.term = cc.term LEFT JOIN se ON se.question_id = cc.question_id AND se.id = x.unit_id WHERE se.id IS NULL),
nw AS (SELECT DISTINCT question_id, id FROM (SELECT *, row_number() OVER (PARTITION BY question_id, term ORDER BY id) AS n FROM ot) WHERE n <= 3),
tl AS (SELECT DISTINCT c.question_id, c.id FROM (SELECT question_id, id FROM se UNION ALL SELECT question_id, id FROM nw) c JOIN m ON m.unit_id = c.id JOIN cc ON cc.question_id = c.question_id AND cc.term = m.term WHERE c.question_id IN (SELECT question_id FROM nw)),
sx2 AS (SELECT se.question_id, u.id, u.parent_unit_id, u.type FROM se JOIN u ON u.id = se.id WHERE u.type NOT IN ('Rule', 'Image')),
hx AS (SELECT question_id, id, arg_min(role, o) AS role FROM (
    SELECT s.question_id, u.id, 0 AS o, 'parent' AS role FROM sx2 s JOIN u ON u.id = s.parent_unit_id
    UNION ALL SELECT s.question_id, u.id, 1, 'sibling' FROM sx2 s JOIN u ON u.parent_unit_id = s.parent_unit_id AND u.id <> s.id WHERE s.type = 'DataTableRow'
    UNION ALL SELECT s.question_id, u.id, 2, 'child' FROM sx2 s JOIN u ON u.parent_unit_id = s.id WHERE s.type <> 'DataTableRow') x
  WHERE NOT EXISTS (SELECT 1 FROM se WHERE se.question_id = x.question_id AND se.id = x.id) AND NOT EXISTS (SELECT 1 FROM nw WHERE nw.question_id = x.question_id AND nw.id = x.id) GROUP BY 1, 2),
pl AS (SELECT question_id, id, vector_score, sq, 'seed' AS role, '' AS via FROM se UNION ALL SELECT question_id, id, NULL, cast([] AS INTEGER[]), 'seed', 'concept_expansion' FROM nw
  UNION ALL SELECT question_id, id, NULL, cast([] AS INTEGER[]), role, 'hierarchy_expansion' FROM hx),
cap AS (SELECT * FROM pl QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY role = 'seed' DESC, round(coalesce(vector_score, 0), 9) DESC, id) <= 50),
dt AS (SELECT id, list_distinct(regexp_split_to_array(lower('Section: ' || array_to_string(section, ' > ') || ' Name: ' || name || ' Summary: ' || summary || ' Aliases: ' || aliases[1] || ' Content: ' || content), '[^\p{L}\p{N}]+')) AS toks FROM u WHERE id IN (SELECT id FROM cap)),
rr AS (SELECT question_id, s.id, max(len(list_filter(string_split(q.query, ' '), lambda t: list_contains(toks, t))) / len(string_split(q.query, ' '))::DOUBLE) AS rerank
  FROM (SELECT question_id, id, unnest(sq) AS k FROM cap) s JOIN q ON q.sub_query_index = s.k JOIN dt ON dt.id = s.id GROUP BY 1, 2),
pv AS (SELECT question_id, rl.id, count(DISTINCT source) AS kinds FROM rl JOIN qs ON qs.sub_query_index = rl.sub_query_index GROUP BY 1, 2),
fs AS (SELECT cap.*, coalesce(rerank, 0) AS rerank, len(sq) / nq.n::DOUBLE AS coverage, (coalesce(kinds, 0) + (tl.id IS NOT NULL)::INTEGER + (via = 'hierarchy_expansion')::INTEGER) / 6.0::DOUBLE AS diversity,
    0.7::DOUBLE * coalesce(rerank, 0) + 0.15::DOUBLE * (len(sq) / nq.n::DOUBLE) + 0.1::DOUBLE * (kinds IS NOT NULL)::INTEGER + 0.05::DOUBLE * ((coalesce(kinds, 0) + (tl.id IS NOT NULL)::INTEGER + (via = 'hierarchy_expansion')::INTEGER) / 6.0::DOUBLE) AS final
  FROM cap JOIN nq ON nq.question_id = cap.question_id LEFT JOIN rr ON rr.question_id = cap.question_id AND rr.id = cap.id LEFT JOIN pv ON pv.question_id = cap.question_id AND pv.id = cap.id LEFT JOIN tl ON tl.question_id = cap.question_id AND tl.id = cap.id),
ps AS (SELECT * FROM (SELECT *, count(*) FILTER (WHERE rerank >= 0.4) OVER (PARTITION BY question_id) AS n_pass, row_number() OVER (PARTITION BY question_id ORDER BY round(rerank, 9) DESC, id) AS r FROM fs)
  WHERE rerank >= 0.4 OR (n_pass = 0 AND r <= 3) QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY round(final, 9) DESC, id) <= 12)
"""


def query(name: str, sql: str | None = None, units: bool = False, search: bool = False, pool: bool = False):
    """Register a query under ``name`` with its oracle; ``units``, ``search`` and ``pool`` put the adapters' tables before ``sql``."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
            parts = [UNITS_SQL] * (units or search or pool) + [QUESTIONS_SQL, SEARCH_SQL] * (search or pool) + [POOL_SQL] * pool
            text = sql.strip()
            if parts:
                head = ",".join(p.strip() for p in parts)
                if text.startswith("WITH RECURSIVE "):
                    text = f"WITH RECURSIVE {head}, {text[15:]}"
                else:
                    text = f"WITH {head}, {text[5:]}" if text.startswith("WITH ") else f"WITH {head} {text}"
            SQL[name] = text
        return f

    return add
