"""What every operator needs from the running session: shared scratch space and worker settings."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)

#: Rows of one Arrow batch sent to a Python worker; with texts of 100 kB a batch then stays below 64 MB.
ARROW_ROWS = 512


def prepare(spark: SparkSession, arrow_rows: int = ARROW_ROWS) -> SparkSession:
    """Let Python workers import this package and keep Arrow batches small enough for long texts."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= arrow_rows:
        spark.conf.set(key, str(arrow_rows))
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        made = tempfile.mkdtemp(prefix="quillmere-")
    else:  # no shared folder is named, but the warehouse is shared by definition
        made = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_quillmere"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_root(spark)}/quillmere-{tag}-{uuid.uuid4().hex}"


def store(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back; lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillmere_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`store` once nothing reads it any more."""
    path = getattr(df, "_quillmere_path", None)
    if path:
        delete_path(df.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def stamp(spark: SparkSession, path: str) -> tuple[int, int]:
    """Bytes and time of last change of a file or folder: what tells whether it is the same as before."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getContentSummary(at).getLength(), fs.getFileStatus(at).getModificationTime()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
