"""Sources and sinks of the engine: tables in several formats, page images, page lists, logs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.functions import text as X
from quillmere.schemas import METADATA

FORMATS = ["parquet", "orc", "json", "csv"]


def read_table(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """A table with a fixed schema; nothing is inferred, and columns that are not selected are not read."""
    if kind not in FORMATS:
        raise ValueError(f"{kind} is none of {FORMATS}")
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if kind == "csv" else reader.format(kind).load(path)


def write_table(df: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "append") -> None:
    writer = df.write.mode(mode).partitionBy(*partition_by) if partition_by else df.write.mode(mode)
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)


def page_images(spark: SparkSession, folder: str) -> DataFrame:
    """(document_id, page, path, bytes, content_hash, image) of page images named <folder>/<document>/<page>.png."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", True).load(folder)
    return files.select(
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("document_id"),
        F.regexp_extract("path", r"(\d+)\.png$", 1).cast("int").alias("page"),
        "path",
        F.col("length").alias("bytes"),
        F.sha2("content", 256).alias("content_hash"),
        F.regexp_replace(F.base64("content"), r"\s", "").alias("image"),
    )


def changed_only(files: DataFrame, stored: DataFrame, key: str = "path") -> DataFrame:
    """Files whose content is not stored under their key yet."""
    return files.join(stored.select(key, "content_hash"), [key, "content_hash"], "left_anti")


def log_tail(logs: DataFrame, since: str | None, n: int, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Rows after ``since`` in order, else the newest ``n`` first."""
    if since is None:
        return logs.orderBy(F.desc(ts), F.desc(tie)).limit(n)
    return logs.where(F.col(ts) > F.lit(since).cast("timestamp_ntz")).orderBy(ts, tie).limit(n)


def pages_wanted(spark: SparkSession, spec: str) -> DataFrame:
    return spark.range(1).select(F.explode(X.page_range(F.lit(spec))).alias("page"))


def decode_units(rows: DataFrame) -> DataFrame:
    """Stored rows with their JSON columns decoded; a missing name is empty, missing lists are empty."""
    none = F.array().cast("array<string>")
    m = F.from_json("metadata_json", METADATA)
    lists = F.struct(*(F.coalesce(m[k], none).alias(k) for k in ("defines", "mentions", "aliases")))
    return rows.withColumns({"section": F.coalesce(F.from_json("section_json", "array<string>"), none), "metadata": lists, "name": F.coalesce("name", F.lit(""))}).drop("section_json", "metadata_json")


def put_objects(objects: DataFrame, folder: str) -> None:
    """Write ``content`` of each row below ``folder`` under its ``key``; a task that runs again writes the same bytes."""
    uri = folder if "://" in folder or folder.startswith("/") else folder.removeprefix("file:")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, base = fs.FileSystem.from_uri(uri)
            for key, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at.create_dir(f"{base}/{key}".rpartition("/")[0], recursive=True)
                with at.open_output_stream(f"{base}/{key}") as out:
                    out.write(content or b"")
            yield pa.RecordBatch.from_arrays([b.column(0)], ["key"])

    objects.select("key", "content").mapInArrow(run, "key string").write.format("noop").mode("overwrite").save()


def delete_objects(keys: DataFrame, folder: str) -> None:
    """Delete the objects under ``key``; one that is not there is no error."""
    uri = folder if "://" in folder or folder.startswith("/") else folder.removeprefix("file:")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, base = fs.FileSystem.from_uri(uri)
            for key in b.column(0).to_pylist():
                try:
                    at.delete_file(f"{base}/{key}")
                except FileNotFoundError:
                    continue
            yield b

    keys.select("key").mapInArrow(run, "key string").write.format("noop").mode("overwrite").save()


def candidate_log(logs: DataFrame, query_text, n: int) -> DataFrame:
    """The first ``n`` candidate rows of a question by iteration, stage and time."""
    return logs.where(F.col("query_text") == query_text).orderBy("iteration", "stage", "ts", "event_id").limit(n)
