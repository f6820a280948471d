"""WARC archives: a writer with identical-payload revisits, and a reader that splits compressed archives.

Every record is one gzip member. A reading task owns the members that start in its range of bytes: it looks for
gzip's magic bytes, takes a candidate for a member only if it decodes to a WARC header, and reads the last member
it owns beyond the end of its range. Ranges of a file need no index and do not depend on each other.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.session import prepare, store

MAGIC = b"\x1f\x8b\x08"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = 1 << 18
#: Digests that repeat, of some 100 bytes each, are broadcast up to this number.
BROADCAST_ROWS = 500_000
RECORD_FIELDS = "path string, offset long, record_type string, record_id string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, leader: int | None, date: str) -> bytes:
    """A response record, or with ``leader`` a revisit of that page's record, as one gzip member."""
    b32 = base64.b32encode(bytes.fromhex(digest)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if leader is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if leader is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {re.sub(r'\s', '%20', url)}"] if url is not None else []),
        *([f"WARC-Refers-To: <urn:page:{leader}>", f"WARC-Profile: {REVISIT_PROFILE}"] if leader is not None else []),
        f"WARC-Payload-Digest: sha1:{b32}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000) -> DataFrame:
    """(page_id, url, payload, digest, leader): leader is the page that a revisit refers to, null for a response.

    Payloads of at least ``least`` bytes that are equal: the largest page_id is the response (each of its rows, if
    rows repeat), the others, and rows without an id, revisit it. Null html is an empty payload, a null url stays null;
    a page without an id is never referred to. Payloads are shuffled only where more digests repeat than a broadcast
    holds, and then only those of at least ``least`` bytes. Other columns are not read; an empty table gives no records.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(html_col, F.lit("")), "UTF-8").alias("payload")
    ).withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= least
    found = rows.where(large).groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 AND first_id IS NOT NULL")
    leaders = store(found.drop("n"), "leaders")
    leader = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("first_id")), F.col("first_id")).alias("leader")
    cols = ["page_id", "url", "payload", "digest"]
    if leaders.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(leaders), large & (rows["digest"] == leaders["digest"]), "left").select(*(rows[c] for c in cols), leader)
    return rows.where(large).join(leaders, "digest", "left").select(*cols, leader).unionByName(rows.where(~large).select(*cols, F.lit(None).cast("long").alias("leader")))


def write_warc(records: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", roll: int = 256 << 20) -> DataFrame:
    """Write the rows of :func:`plan_records` below ``folder``; (path, bytes, records) of each archive.

    Each task writes archives named after its partition, under a temporary name until they are whole, so that a
    task that runs again replaces its files by equal ones. An archive is closed once it exceeds ``roll`` bytes.
    """
    prepare(records.sparkSession)
    uri = folder if "://" in folder or folder.startswith("/") else re.sub("^file:/*", "/", folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store_, base = fs.FileSystem.from_uri(uri)
        store_.create_dir(base, recursive=True)
        task = TaskContext.get()
        part, attempt = (task.partitionId(), task.taskAttemptId()) if task else (0, 0)
        done: list[tuple[str, int, int]] = []
        out, size, count = None, 0, 0

        def close() -> None:
            name = f"{base}/part-{part:06d}-{len(done):04d}.warc.gz"
            out.close()
            store_.move(temporary, name)
            done.append((f"{uri.rstrip('/')}/{name.rsplit('/', 1)[-1]}", size, count))

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    temporary, size, count = f"{base}/.part-{part:06d}-{len(done):04d}-{attempt}", 0, 0
                    out = store_.open_output_stream(temporary)
                member = record(*row, date)
                out.write(member)
                size, count = size + len(member), count + 1
                if size > roll:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "bytes", "records"])

    return store(records.mapInArrow(run, "path string, bytes long, records long"), "archives")


def parse(data: bytes) -> dict | None:
    """A record's header fields and block, from an uncompressed member; None if it is no WARC record."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not mark or not lines[0].startswith("WARC/1."):
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = fields.get("content-length", "")
    if not length.isdigit() or int(length) > len(rest):
        return None
    return {"fields": fields, "block": rest[: int(length)]}


def members(source, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the gzip members of WARC records that start at ``start`` or later and before ``end``.

    ``source`` has seek and read. A member that the end of the file cuts off is left out.
    """
    held, at, ended = b"", start, False  # bytes from ``at`` on

    def more() -> bool:
        nonlocal held, ended
        if not ended:
            source.seek(at + len(held))
            got = source.read(READ)
            held += got
            ended = not got
        return not ended

    while at < end:
        k = held.find(MAGIC)
        if k < 0:
            skip = max(0, len(held) - 2)
            held, at = held[skip:], at + skip
            if not more():
                return
            continue
        held, at = held[k:], at + k
        if at >= end:
            return
        tool, parts, fed, good, checked = zlib.decompressobj(31), [], 0, True, False
        while good and not tool.eof:
            if fed == len(held) and not more():
                good = False
                break
            try:
                parts.append(tool.decompress(held[fed:]))
            except zlib.error:
                good = False
            fed = len(held)
            if not checked and sum(map(len, parts)) >= 8:
                checked, good = True, good and b"".join(parts).startswith(b"WARC/1.")
        if good and checked:
            yield at, b"".join(parts)
            used = len(held) - len(tool.unused_data)
        else:
            used = 1
        held, at = held[used:], at + used


def read_warc(archives: DataFrame, range_bytes: int = 8 << 20, payloads: bool = True) -> DataFrame:
    """The records of ``archives`` (path, bytes), RECORD_FIELDS each; payload is null for revisits and without ``payloads``.

    payload_bytes and payload_digest (bare lower-case hex SHA-1) are of the full payload: measured for a response,
    taken from the headers for a revisit. A response whose digest differs from its header's fails the job. Archives
    without records and an empty table of archives give no rows.
    """
    prepare(archives.sparkSession)
    ranges = archives.where("bytes > 0").select(
        "path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start")
    )
    names = [x.split()[0] for x in RECORD_FIELDS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

        for b in batches:
            for path, size, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                store_, name = fs.FileSystem.from_uri(path)
                with store_.open_input_file(name) as source:
                    for offset, data in members(source, start, min(size, start + range_bytes)):
                        if (found := parse(data)) is None:
                            continue
                        f, block = found["fields"], found["block"]
                        head, _, payload = block.partition(b"\r\n\r\n")
                        digest = base64.b32decode(f["warc-payload-digest"].partition(":")[2]).hex() if f.get("warc-payload-digest", "").startswith("sha1:") else None
                        kind, length = f.get("warc-type"), len(payload)
                        if kind == "revisit":
                            told = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", head)
                            length, payload = int(told[1]) if told else None, None
                        elif digest != (measured := hashlib.sha1(payload).hexdigest()):
                            if digest and kind == "response":
                                raise ValueError(f"{path} at {offset}: the payload's digest is {measured}, its header says {digest}")
                            digest = measured
                        strip = lambda x: x.strip("<>") if x else x
                        rows.append((path, offset, kind, strip(f.get("warc-record-id")), f.get("warc-target-uri"), strip(f.get("warc-refers-to")), length, digest, payload if payloads else None))
                        held += len(payload or b"") * payloads
                        if len(rows) >= 512 or held > READ * 16:
                            yield batch()
                            rows, held = [], 0
        yield batch()

    ranges = store(ranges.select("path", "bytes", "start"), "ranges")
    # a number of our own, lest the few bytes that name the ranges be merged into one task, which would read them all
    tasks = min(max(1, ranges.count()), max(64, 4 * archives.sparkSession.sparkContext.defaultParallelism))
    return ranges.repartition(tasks).mapInArrow(run, RECORD_FIELDS)


def page_id_of(column: str):
    """The page id in a record id that :func:`record` wrote; null if it has none."""
    return F.nullif(F.regexp_extract(column, r"^urn:page:(-?[0-9]+)$", 1), F.lit("")).cast("long")
