"""A corpus pipeline: documents to a mixed, decontaminated and sanitised training set.

Each stage takes (spark, docs, sf_dir) and works on all rows it is given, whole texts, however long. All but the last
return the columns of ``docs``; the last returns one row for each time that the mix takes a document. In every stage a
null text counts as an empty one but stays null, rows with a null id take part like others, rows that repeat share their
result, further columns of any name (also names that the operators use) come through as they are, and an empty table
gives an empty table. What ties give is stated stage by stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmere.llm import decontamination, mixing, pii, quality_model, simhash
from quillmere.session import store, table

ID, TEXT, KEY, KEY2 = "doc_id", "text", "key", "key2"


def _plain(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns named by place (c0, c1 ...), so that no name clashes, and doc_id, text, and a key (key, key2) that rows share only if they agree in both."""
    named = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    at = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    return named.withColumns({ID: F.col(at[ID]), TEXT: F.col(at[TEXT])}).withColumns({KEY: F.xxhash64(ID, TEXT), KEY2: F.hash(TEXT, ID)})


def _back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)))


def _without(docs: DataFrame, gone: DataFrame, bound: int = 1_000_000) -> DataFrame:
    """``docs`` less the rows whose key is in ``gone`` (key, key2): broadcast if there are at most ``bound`` keys, else shuffled."""
    few = gone.count() <= bound
    return _back(_plain(docs).join(F.broadcast(gone) if few else gone, [KEY, KEY2], "left_anti"), docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier rejects go.

    A text without enough words for any labeller gets no bad vote, and the scorer alone decides. Rows that repeat go or
    stay together. The threshold is exclusive: a score of just 0.5 goes.
    """
    scored = quality_model.quality_scores(_plain(docs).select(F.struct(KEY, KEY2).alias("id"), TEXT), id_col="id")
    return _without(docs, store(scored.where("NOT kept").select(f"id.{KEY}", f"id.{KEY2}").distinct(), "rejected"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 or more of five-word shingle sets, the smallest doc_id stays.

    Candidates are 256-bit SimHash fingerprints with at most 72 bits that differ, and shingle counts in a ratio of
    0.8 or more, which that similarity implies; the sets themselves decide. Rows without any word form one group. Rows
    with a null id come before others, and among rows of one id the smallest hash of the text. Of rows that repeat, id
    and text alike, the one whose other columns have the smallest hash stays.
    """
    rows = _plain(docs).select(F.struct(ID, KEY, KEY2).alias("id"), TEXT)
    groups = simhash.simhash_groups(rows, id_col="id", words=5, bits=256, radius=72, distinct=True, ratio=0.8, link_empty=False, jaccard=0.8)
    gone = store(groups.where("id <> component_id").select(f"id.{KEY}", f"id.{KEY2}").distinct(), "copies")
    left = _without(docs, gone)
    repeated = store(_plain(left).groupBy(KEY, KEY2).agg(F.count("*").alias("n")).where("n > 1").select(KEY, KEY2), "repeated")
    if not repeated.count():
        return left
    again = _plain(left).join(repeated, [KEY, KEY2], "left_semi")
    cols = [f"c{k}" for k in range(len(docs.columns))]
    hashed = [c for c, f in zip(cols, docs.schema.fields, strict=True) if isinstance(f.dataType, (T.StringType, T.NumericType, T.BooleanType, T.DatetimeType, T.TimestampNTZType))]
    one = again.groupBy(KEY, KEY2).agg(F.min_by(F.struct(*cols), F.struct(F.xxhash64(*hashed), F.hash(*hashed))).alias("row")).select("row.*")
    return _without(left, repeated).unionByName(_back(one, docs))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of ten words of a benchmark item occurs go; an item of fewer words is one window.

    A text without words, and a benchmark item without words, has no windows and touches nothing.
    """
    found = decontamination.decontaminate(_plain(docs).select(ID, TEXT), table(spark, sf_dir, "benchmark"))
    return _without(docs, store(found.where("n_hit > 0").select(F.col("k").alias(KEY), F.col("k2").alias(KEY2)).distinct(), "contaminated"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, and terms that reveal it, give way to their kinds in brackets; n_chars, if there, follows the text.

    Spans that overlap give way together, under the kind of the first. No row goes; a text without spans stays as it is.
    """
    plain = _plain(docs)
    text = f"c{docs.columns.index(TEXT)}"
    found = pii.find_pii(plain, text_col=TEXT).withColumn(text, pii.sanitised(TEXT, "pii_spans"))
    if "n_chars" in docs.columns:
        n = f"c{docs.columns.index('n_chars')}"
        found = found.withColumn(n, F.when(F.size("pii_spans") > 0, F.length(text)).otherwise(F.col(n)).cast(docs.schema["n_chars"].dataType))
    return _back(found, docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time that a document is taken, with its text, its shard and its place in the shard.

    Where the rest of a source ends inside a document, the text is cut after its first ``words`` words. Draws are made on
    rows without texts; each document's text then joins them once. Documents without words are never taken. Where
    ``docs`` has no source or no lang, they are null.
    """
    plain = _plain(docs)
    given = lambda c: F.col(f"c{docs.columns.index(c)}").cast("string") if c in docs.columns else F.lit(None).cast("string")
    rows = plain.select(ID, TEXT, KEY, KEY2, given("source").alias("source"), given("lang").alias("lang"))
    mixed = mixing.mix_sources(rows, keep=("lang", KEY, KEY2)).where("size(draws) > 0")
    texts = rows.groupBy(KEY, KEY2).agg(F.first(TEXT).alias(TEXT))
    taken = mixing.mixture(mixed.join(texts, [KEY, KEY2]))
    text = F.when(F.col("words") < F.col("size"), mixing.first_words(TEXT, "words")).otherwise(F.col(TEXT))
    return taken.select(ID, "source", "lang", "size", "target", "epoch", "shard", "words", "place", text.alias(TEXT))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data),
    ("mixing", mixing_stage),
]

#: SQL expresses neither the trained classifier nor SimHash; tests/llm holds brute-force versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's rows are stored before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = store(docs, name)
    return docs
