"""Adapters from the supplied tables to the engine's own: units, mentions, vectors and questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.functions import text as X
from quillmere.operators import hierarchy, search
from quillmere.plans.retrieval import Library
from quillmere.schemas import STATUSES, UNIT_TYPES
from quillmere.session import exists, scratch_path, stamp, table

VOCABULARY = ["tion", "thre", "thth", "anea", "ther", "thin", "thor", "thed", "ble", "ing"]
SUB_QUERIES = ["that and this", "with from are", "tion thre", "ther thin", "ble anea"]


def pick(values: list[str], n: F.Column) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One unit per document: ten to a page, a forest three deep, types and statuses in turn."""
    d = table(spark, sf_dir, "documents")
    base = d.select(
        "doc_id",
        (F.floor(F.col("doc_id") / 10) + 1).cast("int").alias("page"),
        (F.col("doc_id") % 10).cast("int").alias("source_order"),
        pick(UNIT_TYPES, F.col("doc_id") % 6).alias("type"),
        "lang",
        "source",
        F.col("text").alias("content"),
    ).withColumn("id", X.unit_id(F.col("type"), F.lit("doc"), F.col("page"), F.col("source_order")))
    above = F.when(F.col("source_order") == 0, -1).when(F.col("source_order") >= 7, 6).otherwise(0)
    # the parent's type follows from its doc_id, so its id needs no join
    parent_doc = (F.col("page") - 1) * 10 + above
    parent = F.when(above >= 0, X.unit_id(pick(UNIT_TYPES, parent_doc % 6), F.lit("doc"), F.col("page"), above))
    name = F.array_join(F.slice(F.split("content", " "), 1, 3), " ")
    has = lambda t: F.array_intersect(F.array(*map(F.lit, VOCABULARY)), t)
    in_name, in_text = has(X.tokens(name)), has(X.tokens(F.col("content")))
    return base.select(
        "doc_id",
        "id",
        F.lit("doc").alias("document_id"),
        F.col("source").alias("source_node_id"),
        parent.alias("parent_unit_id"),
        "source_order",
        "type",
        name.alias("name"),
        "page",
        F.array("source", "lang").alias("section"),
        "content",
        F.sha2("content", 256).alias("content_hash"),
        F.substring("content", 1, 240).alias("summary"),
        F.struct(in_name.alias("defines"), F.array_except(in_text, in_name).alias("mentions"), F.array(F.concat(F.element_at(F.split(name, " "), 1), F.lit("-x"))).alias("aliases")).alias("metadata"),
        pick(STATUSES, F.col("doc_id") % 5).alias("status"),
    )


def mentions(units_: DataFrame) -> DataFrame:
    """(unit_id, term, mention_type) from unit metadata; a term's concept is the term itself."""
    m = F.col("metadata")
    tag = lambda a, kind: F.transform(a, lambda t: F.struct(t.alias("term"), F.lit(kind).alias("mention_type")))
    return units_.select(F.col("id").alias("unit_id"), F.col("doc_id"), F.explode(F.concat(tag(m["defines"], "defines"), tag(m["mentions"], "mentions"))).alias("m")).select("unit_id", "doc_id", "m.*")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, vec, label): embeddings by document."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"), "label")


#: question: its sub-queries, as places in SUB_QUERIES
QUESTIONS = {0: [0, 1, 2, 3, 4], 1: [0], 2: [2], 3: [4], 4: [1, 3]}


def sub_queries(spark: SparkSession) -> DataFrame:
    """(question_id, sub_query_index, query, query_doc): the sub-queries of all questions, and the document whose vector stands for each."""
    rows = [(i, k, SUB_QUERIES[k], 7 * k + 3) for i, asked in QUESTIONS.items() for k in asked]
    return spark.createDataFrame(rows, "question_id long, sub_query_index int, query string, query_doc long")


N_QUERIES = sum(map(len, QUESTIONS.values()))
_libraries: dict[tuple, tuple[str, Library]] = {}


def ingest(spark: SparkSession, sf_dir: str) -> tuple[str, Library]:
    """Ingest the documents of ``sf_dir`` below a folder of their own: units, text index, vectors, mentions."""
    at = scratch_path(spark, "library")
    units(spark, sf_dir).write.parquet(f"{at}/units")
    u = spark.read.parquet(f"{at}/units")
    v = vectors(spark, sf_dir)
    ids = u.select("id", "doc_id")
    n = v.agg(F.count("*").alias("n"))
    shifted = v.crossJoin(F.broadcast(n)).select(((F.col("doc_id") + F.col("n") - 1) % F.col("n")).alias("doc_id"), "vec")  # one row of n
    ids.join(v, "doc_id").select("id", "vec").write.parquet(f"{at}/subjects")
    ids.join(shifted, "doc_id").select("id", "vec").write.parquet(f"{at}/contents")
    mentions(u).write.parquet(f"{at}/mentions")
    index = search.build_index(u, f"{at}/index")
    read = lambda name: spark.read.parquet(f"{at}/{name}")
    return at, Library(u, index, read("subjects"), read("contents"), read("mentions"), hierarchy.build_jumps(u, f"{at}/jumps"))


def library(spark: SparkSession, sf_dir: str) -> Library:
    """The ingested documents of ``sf_dir``: ingested once for a session, as long as what was written is there and the files are the same."""
    key = (spark.sparkContext.applicationId, sf_dir, *(stamp(spark, f"{sf_dir}/{t}.parquet") for t in ("documents", "embeddings")))
    if key not in _libraries or not exists(spark, _libraries[key][0]):
        _libraries[key] = ingest(spark, sf_dir)
    return _libraries[key][1]


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question_id, sub_query_index, query, query_vec)."""
    q = sub_queries(spark)
    return vectors(spark, sf_dir).select(F.col("doc_id").alias("query_doc"), F.col("vec").alias("query_vec")).join(F.broadcast(q), "query_doc").select("question_id", "sub_query_index", "query", "query_vec")  # a fixed number of rows
