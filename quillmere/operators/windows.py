"""Positional operators: ranks around exclusions, carried containers, tails, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rank_after_exclusion(ranked: DataFrame, seen: DataFrame, key: str, by: str = "score") -> DataFrame:
    """Vector hits are ranked once known ids are gone, so ranks have no gaps."""
    return ranked.join(seen, "id", "left_anti").withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(by), "id")))


def rank_before_exclusion(ranked: DataFrame, seen: DataFrame, key: str, by: str = "score") -> DataFrame:
    """Lexical hits are ranked first, so known ids leave gaps."""
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(by), "id"))).join(seen, "id", "left_anti")


def consecutive(pages: DataFrame, key: str, page: str) -> DataFrame:
    """Whether state is carried into a page: the page processed before it is the one before."""
    last = F.lag(page).over(Window.partitionBy(key).orderBy(page))
    return pages.withColumn("carried", F.coalesce(last == F.col(page) - 1, F.lit(False)))


def last_containers(units: DataFrame, key: str, order: list[str], name: str, n: int) -> DataFrame:
    """The last ``n`` distinct names of each key by last occurrence, newest first (position 1)."""
    last = units.where(F.col(name).isNotNull()).groupBy(key, name).agg(F.max(F.struct(*order)).alias("at"))
    return last.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("at"), name))).where(F.col("position") <= n)


def first_occurrence(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def last_turns(turns: DataFrame, conversation: str, turn: str, n: int) -> DataFrame:
    """The last 2n messages of each conversation."""
    return turns.withColumn("__n", F.row_number().over(Window.partitionBy(conversation).orderBy(F.desc(turn)))).where(F.col("__n") <= 2 * n).drop("__n")


def batches(rows: DataFrame, key: list[str], order: list, size: int) -> DataFrame:
    """Consecutive batches of ``size`` rows within each key."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("batch", F.floor((n - 1) / size).cast("long"))
