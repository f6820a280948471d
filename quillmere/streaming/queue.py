"""A queue of pages as a stream source: offsets, acknowledgement by commit, three tries, then a table of dead letters.

Messages (document_id, page, attempts) are Parquet files that a manifest publishes, one version for each sending, so a
sending is there whole or not at all and offsets are version numbers. What the stream has committed is acknowledged: its
files go. A batch that is run again after a crash changes nothing, as its pages, tries and dead letters are all merged by key.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from quillmere.operators.keyed import KeyedTable
from quillmere.operators.versions import Conflict, Versions
from quillmere.session import prepare, store

MESSAGE = "document_id string, page int, attempts int"
LETTERS = "document_id string, page int, attempts int, error string"
MOST_TRIES = 3
#: Messages of one file, and so of one task.
FILE_ROWS = 1000


def send(messages: DataFrame, path: str, tries: int = 10) -> int:
    """Put ``messages`` (document_id, page, and attempts if they have any) at the end of the queue; gives the version, or -1 if there are none."""
    spark = messages.sparkSession
    at = f"sent/{uuid.uuid4().hex}"
    rows = messages.withColumn("attempts", F.col("attempts") if "attempts" in messages.columns else F.lit(0)).selectExpr("cast(document_id AS string) AS document_id", "cast(page AS int) AS page", "cast(attempts AS int) AS attempts")
    rows.write.option("maxRecordsPerFile", FILE_ROWS).parquet(f"{path}/{at}")
    versions = Versions(spark, path)
    files = [f for f in versions.folders(f"{at}/*.parquet")]
    if not spark.read.schema(MESSAGE).parquet(f"{path}/{at}").limit(1).count():
        return -1
    for attempt in range(tries):
        try:
            return versions.commit({"dir": at, "files": files}, versions.last())
        except Conflict:
            if attempt == tries - 1:
                raise
    return -1


def _opened(path: str):
    """pyarrow's file system for a path or URI, and the path in it; for the reader, which has no session."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class _File(InputPartition):
    def __init__(self, name: str) -> None:
        self.name = name


class _Reader(DataSourceStreamReader):
    """Offsets: {"version": the last one that was read}. A commit deletes the files of what was read, and keeps the manifests as a record."""

    def __init__(self, path: str) -> None:
        self.path = path

    def _versions(self) -> list[int]:
        from pyarrow import fs

        where, at = _opened(self.path)
        found = where.get_file_info(fs.FileSelector(f"{at}/_versions", allow_not_found=True))
        return sorted(int(f.base_name.removesuffix(".json")) for f in found if f.base_name.endswith(".json") and not f.base_name.startswith("."))

    def _manifest(self, version: int) -> dict:
        where, at = _opened(self.path)
        with where.open_input_stream(f"{at}/_versions/{version:08d}.json") as f:
            return json.loads(f.read())

    def initialOffset(self) -> dict:  # noqa: N802
        return {"version": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"version": max(self._versions(), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[_File]:
        found = []
        for v in range(start["version"] + 1, end["version"] + 1):
            m = self._manifest(v)
            found += [_File(f"{m['dir']}/{f}") for f in m["files"]]
        return found

    def read(self, partition: _File) -> Iterator:
        import pyarrow.parquet as pq

        where, at = _opened(self.path)
        yield from pq.read_table(f"{at}/{partition.name}", filesystem=where).select(["document_id", "page", "attempts"]).to_batches()

    def commit(self, end: dict) -> None:
        where, at = _opened(self.path)
        for v in self._versions():
            if v <= end["version"]:
                m = self._manifest(v)
                if m["files"]:
                    from pyarrow import fs

                    if where.get_file_info(f"{at}/{m['dir']}").type != fs.FileType.NotFound:
                        where.delete_dir(f"{at}/{m['dir']}")


class QueueSource(DataSource):
    """``spark.readStream.format("page_queue").option("path", ...)``."""

    @classmethod
    def name(cls) -> str:
        return "page_queue"

    def schema(self) -> str:
        return MESSAGE

    def streamReader(self, schema) -> _Reader:  # noqa: N802
        return _Reader(self.options["path"])


def tried(pages: DataFrame, attempt: Callable[[str, int, int, str | None], None]) -> DataFrame:
    """``pages`` (document_id, page, attempts, html) with error: what ``attempt`` raised for a page, null if nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            errors = []
            for r in b.itertuples(index=False):
                try:
                    attempt(r.document_id, int(r.page), int(r.attempts), r.html)
                    errors.append(None)
                except Exception as e:  # any failure of a page is that page's alone
                    errors.append(f"{type(e).__name__}: {e}"[:500])
            b["error"] = pd.Series(errors, dtype=object, index=b.index)
            yield b

    return pages.mapInPandas(run, "document_id string, page int, attempts int, html string, error string")


def read_page(document: str, page: int, attempts: int, html: str | None) -> None:
    """The default attempt: read the page; a page that its store does not have fails."""
    from quillmere.sources.page_tree import page_units

    if html is None:
        raise LookupError(f"no page {page} of {document}")
    page_units(html)


def letters(spark: SparkSession, path: str) -> KeyedTable:
    """The dead letters of a queue."""
    return KeyedTable(spark, f"{path}/dead", LETTERS, ("document_id", "page"), buckets=2)


def consume(spark: SparkSession, path: str, pages: DataFrame, take: Callable[[DataFrame], object], checkpoint: str, attempt=read_page, most: int = MOST_TRIES, rounds: int = 20) -> None:
    """Read the queue of ``path`` until it is empty; ``take`` gets the ``pages`` (document_id, page, html) that were asked for and read.

    A page that fails is sent again until it has been tried ``most`` times, then it is a dead letter. ``take`` may get a page again after
    a crash and must not mind (:meth:`quillmere.api.Engine.start` does not). A page that is asked for several times in a batch
    counts once, with the most attempts. Restarting with the same ``checkpoint`` goes on where it was.
    """
    prepare(spark).dataSource.register(QueueSource)

    def batch(messages: DataFrame, number: int) -> None:
        own = messages.sparkSession
        asked = messages.groupBy("document_id", "page").agg(F.max("attempts").alias("attempts"))
        found = asked.join(pages.selectExpr("cast(document_id AS string) AS document_id", "cast(page AS int) AS page", "html").dropDuplicates(["document_id", "page"]), ["document_id", "page"], "left")
        done = store(tried(found.select("document_id", "page", "attempts", "html"), attempt), "tried")
        take(done.where("error IS NULL").select("document_id", "page", "html"))
        bad = done.where("error IS NOT NULL").withColumn("attempts", F.col("attempts") + 1)
        dead = bad.where(F.col("attempts") >= most)
        if dead.limit(1).count():
            letters(own, path).merge(dead)
        again = bad.where(F.col("attempts") < most)
        if again.limit(1).count():
            send(again.select("document_id", "page", "attempts"), path)

    for _ in range(rounds):
        last = Versions(spark, path).last()
        stream = spark.readStream.format("page_queue").option("path", path).load()
        stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        if Versions(spark, path).last() == last:
            return
