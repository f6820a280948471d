"""Exact length histogram of encoded documents; suffix sums answer every context limit."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillmere.session import prepare, store

#: Fixed value: the published split pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 128

_encoders: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer in a .tiktoken file, kept for the life of the worker."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encoders[path] = tiktoken.Encoding("quillmere", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def encoded_lengths(docs: DataFrame, vocabulary: str, text_col: str = "text", ship: bool = False) -> DataFrame:
    """(n_tokens) of each row; null is an empty text. Whole texts are encoded, however long. ``vocabulary``: a file that executors can open too, or ``ship`` it."""
    spark = prepare(docs.sparkSession)
    name = vocabulary.rsplit("/", 1)[-1]
    if ship:
        spark.sparkContext.addFile(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(SparkFiles.get(name) if ship else vocabulary).encode_ordinary
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(encode(t)) if t else 0 for t in b.column(0).to_pylist()], pa.int64())], ["n_tokens"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, T.StructType([T.StructField("n_tokens", T.LongType())]))


def length_report(lengths: DataFrame) -> DataFrame:
    """For each length L that occurs: what a context limit of L means for the corpus.

    n_docs (of just that length), docs_longer (above L), tokens_kept (each document truncated to L), tokens_lost,
    and share_within (documents of at most L tokens, as a share: the quantile that L is). The histogram has one row
    per distinct length and is stored, so that texts are encoded once. Suffix sums run within blocks of lengths and then
    over the blocks, so no task holds them all.
    """
    block = F.floor(F.col("n_tokens") / BLOCK)
    hist = store(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")).withColumn("block", block), "lengths")
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    after = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(after), F.lit(0)).alias("later_docs"),
        F.sum("d").over(every).alias("all_docs"),
        F.sum("t").over(every).alias("all_tokens"),
        F.coalesce(F.sum("t").over(after), F.lit(0)).alias("later_tokens"),
    )
    inner = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        hist.withColumn("d", F.coalesce(F.sum("n_docs").over(inner), F.lit(0)))
        .withColumn("t", F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")).over(inner), F.lit(0)))
        .join(blocks, "block")
    )
    longer = F.col("d") + F.col("later_docs")
    lost = F.col("t") + F.col("later_tokens") - longer * F.col("n_tokens")
    return rows.select(
        F.col("n_tokens").alias("context_limit"),
        "n_docs",
        longer.alias("docs_longer"),
        (F.col("all_tokens") - lost).alias("tokens_kept"),
        lost.alias("tokens_lost"),
        ((F.col("all_docs") - longer) / F.col("all_docs")).alias("share_within"),
    )


def token_counts(docs: DataFrame, vocabulary: str, text_col: str = "text", ship: bool = False) -> DataFrame:
    """The report of :func:`length_report` over whole texts, each row counted, repeats included.

    A null text counts as one of no tokens. An empty table gives an empty report. Other columns are not read.
    """
    return length_report(encoded_lengths(docs, vocabulary, text_col, ship))
