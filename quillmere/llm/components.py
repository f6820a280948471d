"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.session import discard, store

#: Least neighbours, of 16 bytes each, are broadcast for up to this number of edges.
BROADCAST_EDGES = 500_000


def _joined(rows: DataFrame, least: DataFrame, n: int, tag: str) -> DataFrame:
    """``rows`` with the least neighbour of their u: broadcast, or joined as a stored table, so that adaptive execution can split a large star."""
    return rows.join(F.broadcast(least) if n <= BROADCAST_EDGES else store(least, tag), "u")


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v: long) to (node, root), root being the smallest node reachable; nodes without edges are absent.

    Each round does a large star (every neighbour above a node is hung on the smallest neighbour) and a small
    star (every neighbour below, likewise), both as a group-by and an equi-join that adaptive execution can
    split where a star is large. Rounds go on until nothing changes; they grow with the logarithm of a component's
    diameter. Null ends and self loops are ignored; an empty table gives an empty table.
    """
    both_ends = F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))
    ordered = [F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")]
    now = store(edges.where(both_ends).select(*ordered).distinct(), "cc")
    last = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (mark.n, mark.x) == last:
            break
        last = (mark.n, mark.x)
        if not mark.n:
            break
        around = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            _joined(around, least, mark.n, "least")
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .distinct()
        )
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            _joined(large, below, mark.n, "below")
            .where(F.col("v") != F.col("m"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(below.select("u", F.col("m").alias("v")))
            .select(*ordered)
            .distinct()
        )
        after = store(small, "cc")
        discard(now)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
