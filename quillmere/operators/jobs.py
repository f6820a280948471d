"""Jobs, conversations, logs and structure nodes: append-only logs whose latest rows are the state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.operators import store
from quillmere.schemas import PHASES, STATUSES

MESSAGES = "array<struct<turn:bigint,role:string,text:string>>"


def started(documents: DataFrame) -> DataFrame:
    """A first row of its job for each of ``documents`` (document_id, total_pages)."""
    return documents.select(
        F.concat(F.lit("JOB-"), F.substring(F.sha2("document_id", 256), 1, 16)).alias("id"), "document_id", F.lit(PHASES[0]).alias("phase"), F.lit("running").alias("status"),
        F.lit(0).cast("long").alias("pages_processed"), F.lit(0).cast("long").alias("units_processed"), F.col("total_pages").cast("long").alias("total_pages"), F.lit(0).alias("seq"),
    )


def advanced(jobs: DataFrame, units: DataFrame) -> DataFrame:
    """The next rows of ``jobs``: what has been processed, and the first phase that still has work, judged by distinct pages and unit statuses."""
    due = [F.count_if(F.col("status") == s).alias(f"due{k}") for k, s in enumerate(STATUSES[:-1])]
    seen = units.groupBy("document_id").agg(F.count_distinct("page").alias("pages"), F.count("*").alias("units"), *due)
    phase: Column = F.when(F.coalesce("pages", F.lit(0)) < F.col("total_pages"), PHASES[0])
    for k, name in enumerate(PHASES[1:-1]):
        phase = phase.when(F.col(f"due{k}") > 0, name)
    phase = phase.otherwise(PHASES[-1])
    joined = jobs.join(seen, "document_id", "left")
    return joined.select(
        "id", "document_id", phase.alias("phase"), F.when(phase == PHASES[-1], "done").otherwise("running").alias("status"),
        F.coalesce("pages", F.lit(0)).alias("pages_processed"), F.coalesce("units", F.lit(0)).alias("units_processed"), "total_pages", (F.col("seq") + 1).alias("seq"),
    )


def latest(log: DataFrame) -> DataFrame:
    return store.keep_latest(log, ["id"], "seq")


def queued_pages(documents: DataFrame) -> DataFrame:
    """(document_id, page): a message for each page of ``documents`` (document_id, total_pages)."""
    return documents.where("total_pages > 0").select("document_id", F.explode(F.sequence(F.lit(1), F.col("total_pages").cast("int"))).alias("page"))


def nested(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, messages): a conversation's messages as one JSON text, by turn."""
    return turns.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("turn").cast("long").alias("turn"), "role", "text")))).alias("messages"))


def appended(conversations: DataFrame, new: DataFrame, key: str = "conv_id") -> DataFrame:
    """``conversations`` with the messages of ``new`` (key, role, text), one at most for each, put at their ends."""
    old = F.coalesce(F.from_json("messages", MESSAGES), F.array().cast(MESSAGES))
    last = F.coalesce(F.array_max(F.transform(old, lambda m: m["turn"])), F.lit(-1))
    fresh = F.array(F.struct((last + 1).alias("turn"), F.col("role"), F.col("text")))
    joined = conversations.join(new, key, "full_outer")
    return joined.select(key, F.to_json(F.when(F.col("role").isNull(), old).otherwise(F.concat(old, fresh))).alias("messages"))


def appended_all(conversations: DataFrame, new: DataFrame, key: str = "conv_id") -> DataFrame:
    """``conversations`` with all messages of ``new`` (key, n, role, text) put at their ends in order of n: one join, however many."""
    old = F.coalesce(F.from_json("messages", MESSAGES), F.array().cast(MESSAGES))
    last = F.coalesce(F.array_max(F.transform(old, lambda m: m["turn"])), F.lit(-1))
    rows = new.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "role", "text"))).alias("fresh"))
    joined = conversations.join(rows, key, "full_outer").withColumn("last", last)
    fresh = F.transform("fresh", lambda m, i: F.struct((F.col("last") + 1 + i).cast("long").alias("turn"), m["role"].alias("role"), m["text"].alias("text")))
    return joined.select(key, F.to_json(F.concat(old, F.coalesce(fresh, F.array().cast(MESSAGES)))).alias("messages"))


def turns_of(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    return conversations.select(key, F.explode(F.from_json("messages", MESSAGES)).alias("m")).select(key, "m.turn", "m.role", "m.text")


def append_log(rows: DataFrame, path: str, ts: str = "ts") -> None:
    """Rows put at the end of a log that is kept by date."""
    rows.withColumn("date", F.to_date(ts)).write.mode("append").partitionBy("date").parquet(path)


def truncate_log(rows: DataFrame, path: str) -> None:
    """The log of ``path`` emptied; ``rows`` only gives its columns."""
    rows.limit(0).withColumn("date", F.lit(None).cast("date")).write.mode("overwrite").parquet(path)


def cursor_page(rows: DataFrame, cursor: int, batch: int, order: str = "id") -> DataFrame:
    """``batch`` rows from place ``cursor`` on, each with next_cursor and whether the end is reached."""
    total = rows.count()
    after = min(total, cursor + batch)
    return rows.orderBy(order).offset(cursor).limit(batch).withColumn("next_cursor", F.lit(after).cast("long")).withColumn("done", F.lit(after >= total))


def page_after(rows: DataFrame, last: str | None, n: int, key: str = "id") -> DataFrame:
    """The next ``n`` rows by a unique ``key`` after ``last`` (None: from the start): a top-n of what is left, no offset and no global sort, so any page costs the same."""
    left = rows if last is None else rows.where(F.col(key) > last)
    return left.orderBy(key).limit(n)


def parent_first(units: DataFrame, status: str, n: int, scope: str = "page") -> DataFrame:
    """Of each scope up to ``n`` units of ``status`` whose parent is missing or past it; where there are none, any units of the status."""
    from pyspark.sql.window import Window

    p = units.select(F.col("id").alias("parent_unit_id"), F.col("status").alias("p_status"))
    due = units.where(F.col("status") == status).join(p, "parent_unit_id", "left").withColumn("ready", F.col("p_status").isNull() | (F.col("p_status") != status))
    due = due.withColumn("any_ready", F.bool_or("ready").over(Window.partitionBy(scope))).where(F.col("ready") | ~F.col("any_ready"))
    place = F.row_number().over(Window.partitionBy(scope).orderBy("source_order", "id"))
    return due.withColumn("place", place).where(F.col("place") <= n).drop("p_status", "any_ready")
