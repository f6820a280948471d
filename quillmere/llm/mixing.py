"""Mixing sources to target weights, by a splitting tree.

A source's documents are permuted by a hash and cut into blocks. A target in words is a number of whole passes over
the source and a rest, hence an exact number of blocks. A tree of multivariate hypergeometric draws deals these
block quotas out among the output shards; each shard then takes the next disjoint stretch of every source's
permuted blocks, and rows are shuffled within the shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmere.session import prepare, store

BLOCK_DOCS = 1024
WORD = r"[^\x20\x09-\x0D]+"
#: Blocks of all sources together stay below this, as blocks grow with the corpus; so a draw never exceeds what numpy draws exactly.
MOST_BLOCKS = 100_000_000
#: Sources that one task, or the driver, splits at once.
GROUP = 4096
SUPER = 10


def split_quotas(quotas: list[int], shards: int, seed: int | list[int], totals: list[int] | None = None) -> np.ndarray:
    """(shards, sources): how many blocks of each source a shard gets. Columns add up to the quotas exactly.

    Each node of the tree halves its shards and draws, without replacement, which of its blocks go left. ``totals``
    says how many each shard gets, for a group of sources whose totals were drawn before; else shares are even.
    """
    out = np.zeros((shards, len(quotas)), np.int64)
    key = seed if isinstance(seed, list) else [seed]
    sums = None if totals is None else np.concatenate([[0], np.cumsum(np.array(totals, np.int64))])

    def split(have: np.ndarray, low: int, high: int) -> None:
        if high - low == 1:
            out[low] = have
            return
        middle = (low + high) // 2
        rng = np.random.default_rng([*key, low, high])
        share = int(have.sum()) * (middle - low) // (high - low) if sums is None else int(sums[middle] - sums[low])
        left = rng.multivariate_hypergeometric(have, share, method="marginals") if len(have) else have
        split(left, low, middle)
        split(have - left, middle, high)

    split(np.array(quotas, np.int64), 0, shards)
    return out


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column], tag: str) -> DataFrame:
    """``rows``, stored, with for each of ``sums`` the total over all rows that come before in ``order``, over any number of rows.

    Rows are cut into ranges of the order; totals of the ranges are added up on the driver, one row per range.
    """
    names = [f"__o{k}" for k in range(len(order))]
    keyed = rows.select("*", *(c.alias(n) for c, n in zip(order, names, strict=True)), *(c.alias(f"__v_{k}") for k, c in sums.items()))
    cut = store(keyed.repartitionByRange(*names).withColumn("__part", F.spark_partition_id()), tag)
    parts = cut.groupBy("__part").agg(*(F.sum(f"__v_{k}").alias(k) for k in sums)).orderBy("__part").collect()
    before, now = {}, dict.fromkeys(sums, 0)
    for p in parts:
        before[p["__part"]] = dict(now)
        now = {k: now[k] + (p[k] or 0) for k in sums}
    w = Window.partitionBy("__part").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    pairs = [x for p, v in before.items() for x in (F.lit(p), F.array(*(F.lit(v[k]) for k in sums)))]
    offset = F.create_map(*pairs)[F.col("__part")] if pairs else F.array(*(F.lit(0) for _ in sums))
    return cut.select(*rows.columns, *((offset[k] + F.coalesce(F.sum(f"__v_{c}").over(w), F.lit(0))).alias(c) for k, c in enumerate(sums)))


def source_targets(sources: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """``sources`` (source, n, size) with place, weight and target, by sorted running sums: any number of sources.

    Sources come by code point, null last. Below some level per weight a source's target is ``cap`` times its size, and
    above it the level times its weight; the level is the first at which all targets add up to all sizes.
    """
    placed = running(sources, [F.col("source").isNull(), F.col("source")], {"place": F.lit(1)}, "sources")
    weighed = placed.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int")))
    by_ratio = running(weighed.withColumn("ratio", cap * F.col("size") / F.col("weight")), [F.col("ratio"), F.col("source").isNull(), F.col("source")], {"sizes": F.col("size"), "shares": F.col("weight")}, "ratios")
    whole = by_ratio.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight")).first()
    level = (F.lit(float(whole.all_size or 0)) - cap * F.col("sizes")) / (F.lit(float(whole.all_weight or 1)) - F.col("shares"))
    least = by_ratio.withColumn("level", level).where("level <= ratio").agg(F.min_by("level", F.struct("ratio", "shares"))).first()[0]  # the first of equal ratios
    full, due = cap * F.col("size"), F.col("weight") * F.lit(least)
    target = full if least is None else F.when(due > full, full).otherwise(due)
    return by_ratio.select("source", "n", "size", "place", target.cast("double").alias("target"))


def shard_shares(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(key, shard_ends) from (key, place, quota): up to which of its blocks in the mix a source's shards reach.

    The tree first deals the totals of groups of sources, then each group's among its sources, a task a group; together
    that is one multivariate hypergeometric draw for each node.
    """
    grouped = quotas.withColumn("part", F.floor(F.col("place") / GROUP).cast("long"))
    sums = grouped.groupBy("part").agg(F.sum("quota").alias("n")).orderBy("part").collect()  # one row per GROUP sources
    if not sums:
        return quotas.select("key", F.array().cast("array<bigint>").alias("shard_ends"))
    dealt = split_quotas([r["n"] for r in sums], shards, seed)
    of = {r["part"]: dealt[:, k].tolist() for k, r in enumerate(sums)}

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        ends = np.cumsum(split_quotas(list(rows["quota"]), shards, [seed, 1 + int(key[0])], of[int(key[0])]), axis=0)
        return pd.DataFrame({"key": list(rows["key"]), "shard_ends": [ends[:, k].tolist() for k in range(len(rows))]})

    return grouped.groupBy("part").applyInPandas(run, "key string, shard_ends array<long>")


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (1, 2, 3),
    cap: float = 3.0,
    shards: int = 16,
    seed: int = 42,
    keep: tuple[str, ...] = (),
    block_docs: int = BLOCK_DOCS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, draws, and the columns in ``keep``.

    ``draws`` is an array of (epoch, shard, words): each time that the mix takes the document, or its first words
    where the rest of a source ends inside it. Sources by code point, null last, have the ``weights`` in turn.
    Every source's words add up to its target, rounded; no document exceeds ``cap`` times its size, rounded up.
    A null text has no words. Rows are ordered by a hash of id and seed (of the text where the id is null), so reruns
    agree; rows that tie there by size. Words are counted once, by whole texts. Repeated rows all come back, and an empty
    table gives an empty table. A kept column with the name of one of these comes back as ``kept_`` and its name. There may
    be any number of sources; blocks have ``block_docs`` documents, or more where that makes over MOST_BLOCKS blocks.
    """
    prepare(docs.sparkSession)
    named = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))))
    rows = store(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n")).alias("key"),  # a null source joins too
            F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.md5(F.concat(named, F.lit(f":{seed}")).cast("binary")).alias("mark"),
            *(F.col(c).alias(f"kept_{c}") for c in keep),
        ),
        "sizes",
    )
    sources = source_targets(rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("size")), weights, cap)
    all_docs = rows.count()
    while all_docs / block_docs > MOST_BLOCKS:
        block_docs *= 2
    words = F.bround("target").cast("long")
    epochs = F.when(F.col("size") > 0, F.floor(words / F.col("size"))).otherwise(F.lit(0)).cast("long")
    plan = store(
        sources.select(
            F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("key"), "place", F.col("size").alias("source_size"), "target",
            epochs.alias("epochs"), F.when(F.col("size") > 0, words - epochs * F.col("size")).otherwise(F.lit(0)).alias("rest"), F.ceil(F.col("n") / block_docs).alias("blocks"),
        ),
        "plan",
    )
    n_sources = plan.count()

    at = F.conv(F.substring("mark", 1, 8), 16, 10).cast("long")
    dealt = rows.join(_small(plan, n_sources), "key").withColumn("block", F.shiftright(at * F.col("blocks"), 32))
    sums = dealt.groupBy("key", "block").agg(F.sum("size").alias("s"), F.max("rest").alias("rest")).withColumn("over", F.shiftright("block", SUPER))
    supers = sums.groupBy("key", "over").agg(F.sum("s").alias("t"))
    earlier = Window.partitionBy("key").orderBy("over").rowsBetween(Window.unboundedPreceding, -1)
    supers = supers.select("key", "over", F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("base"))
    ahead = Window.partitionBy("key", "over").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = store(sums.join(supers, ["key", "over"]).select("key", "block", "rest", (F.col("base") + F.coalesce(F.sum("s").over(ahead), F.lit(0))).alias("ahead")), "blocks")
    partial = starts.where("ahead < rest").groupBy("key").agg((F.max("block") + 1).alias("partial"))
    quotas = plan.join(partial, "key", "left").select("key", "place", (F.col("epochs") * F.col("blocks") + F.coalesce("partial", F.lit(0))).cast("long").alias("quota"))
    shares = store(shard_shares(quotas, shards, seed), "shares")

    within = Window.partitionBy("key", "block").orderBy("mark", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("ahead") + F.coalesce(F.sum("size").over(within), F.lit(0))
    extra = F.least("size", F.greatest(F.lit(0), F.col("rest") - before))
    shard = lambda epoch: F.size(F.filter("shard_ends", lambda x: x <= epoch * F.col("blocks") + F.col("block")))

    def draw(epoch: Column, n: Column) -> Column:
        return F.struct(epoch.cast("long").alias("epoch"), shard(epoch).cast("int").alias("shard"), n.cast("long").alias("words"))

    whole = F.when(F.col("epochs") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1), lambda e: draw(e, F.col("size"))))
    rest = F.when(F.col("extra") > 0, F.array(draw(F.col("epochs"), F.col("extra"))))
    none = F.array().cast("array<struct<epoch:bigint,shard:int,words:bigint>>")
    taken = F.when(F.col("size") > 0, F.concat(F.coalesce(whole, none), F.coalesce(rest, none))).otherwise(none)
    out = ["doc_id", "source", "size", "source_size", "target", "draws"]
    return (
        dealt.join(starts.select("key", "block", "ahead"), ["key", "block"])
        .withColumn("extra", extra)
        .join(_small(shares, n_sources), "key")
        .select("doc_id", "source", "size", "source_size", "target", taken.alias("draws"), *(F.col(f"kept_{c}").alias(f"kept_{c}" if c in out else c) for c in keep))
    )


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table of one row per source where it has at most ten thousand rows; else it is joined by shuffling."""
    return F.broadcast(df) if rows <= 10_000 else df


def mixture(mixed: DataFrame, seed: int = 42) -> DataFrame:
    """The rows of the mix: a row for each draw, with its shard and a place to sort by within the shard."""
    draw = F.explode("draws").alias("draw")
    rows = mixed.select("*", draw)
    place = F.xxhash64(F.col("doc_id"), F.col("draw.epoch"), F.lit(seed))
    return rows.select(*(c for c in mixed.columns if c != "draws"), "draw.epoch", "draw.shard", "draw.words", place.alias("place"))


def write_shards(mixed: DataFrame, folder: str) -> None:
    """Write the rows of :func:`mixture` below ``folder``, a folder a shard, shuffled by place within it; a shard may span many files and tasks."""
    mixed.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place").write.partitionBy("shard").parquet(folder)


def first_words(text: str, n: str) -> Column:
    """A text up to the end of its first ``n`` words, white space between them and in front included."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*+{WORD}+"), F.lit(0)), F.lit(1), F.col(n).cast("int")), "")
