"""Hard negatives by inner product: vectors turned to their principal axes, partial products with bounds, exact integers last."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmere.session import prepare, store

#: Anchors that are broadcast at once (at 64 dimensions 16 MB); more are taken block by block.
BLOCK_ANCHORS = 8192
#: Rows and anchors of one matrix product.
TILE = 1024
#: Shares of the axes after which bounds are looked at.
STEPS = (0.125, 0.25, 0.5, 0.75)


def usable(rows: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, label, vec as doubles) of the rows that take part: an id, a label, and a vector of finite components."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), v.alias("vec"))


def integers(vectors, scale: int, dims: int) -> np.ndarray:
    """floor(scale * x) of each component, shorter vectors filled up with zeros."""
    out = np.zeros((len(vectors), dims))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = np.floor(np.asarray(v, np.float64) * scale)
    if out.size and np.abs(out).max() >= 2.0**62 / max(1, dims) / max(1.0, np.abs(out).max()):
        raise OverflowError("products of these components need not fit into 64 bits")
    return out


def principal_axes(vectors: DataFrame, scale: int, dims: int) -> np.ndarray:
    """An orthogonal matrix whose columns are the axes of the second moments of all vectors, the longest first.

    Every task adds up its own rows; sums of equal places then meet, so the driver gets dims * dims numbers.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dims, dims))
        for b in batches:
            x = integers(b["vec"], scale, dims)
            total += x.T @ x
        yield pd.DataFrame({"i": np.repeat(np.arange(dims), dims), "j": np.tile(np.arange(dims), dims), "v": total.ravel()})

    sums = vectors.select("vec").mapInPandas(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    moments = np.zeros((dims, dims))
    moments[sums["i"], sums["j"]] = sums["v"]
    _, axes = np.linalg.eigh((moments + moments.T) / 2)
    return np.ascontiguousarray(axes[:, ::-1])


class Side:
    """Vectors as integers, turned to the axes, with the norms of what is left after each step."""

    def __init__(self, whole: np.ndarray, axes: np.ndarray, cuts: list[int]) -> None:
        self.whole, self.turned = whole, whole @ axes
        squares = np.concatenate([np.zeros((len(whole), 1)), np.cumsum(self.turned[:, ::-1] ** 2, 1)], 1)[:, ::-1]
        self.rest = [np.sqrt(squares[:, c]) for c in cuts]
        self.norm = np.sqrt(squares[:, 0])


def survivors(rows: Side, anchors: Side, cuts: list[int], at_least: np.ndarray, at_most: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, anchor) of ``open_`` whose product may lie between an anchor's two limits.

    Products over leading axes grow step by step. What is missing is at most the product of the two remaining norms
    (Cauchy and Schwarz); the slack covers the rounding of turning, squaring and adding, of dims operations each.
    """
    slack = 64 * 2.0**-52 * rows.turned.shape[1] ** 1.5 * np.outer(rows.norm, anchors.norm) + 1e-6
    part, before = np.zeros(open_.shape), 0
    for k, cut in enumerate(cuts):
        if not open_.any():
            break
        part += rows.turned[:, before:cut] @ anchors.turned[:, before:cut].T
        off = np.outer(rows.rest[k], anchors.rest[k]) + slack
        open_ = open_ & (part + off >= at_least) & (part - off <= at_most)
        before = cut
    return np.nonzero(open_)


def products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact integer products of pairs of rows."""
    out = np.empty(len(i), np.int64)
    for s in range(0, len(i), 65536):
        out[s : s + 65536] = np.einsum("kd,kd->k", a[i[s : s + 65536]].astype(np.int64), b[j[s : s + 65536]].astype(np.int64))
    return out


def merged_best(best_s: np.ndarray, best_i: np.ndarray, who: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
    """Each row of the two tables keeps its best of what it has and the new (who, score, ids): larger scores, then smaller ids."""
    touched, k = np.unique(who), best_s.shape[1]
    w = np.concatenate([np.repeat(touched, k), who])
    s, i = np.concatenate([best_s[touched].ravel(), score]), np.concatenate([best_i[touched].ravel(), ids])
    order = np.lexsort((i, -s, w))
    w, s, i = w[order], s[order], i[order]
    place = np.arange(len(w)) - np.searchsorted(w, w)
    top = place < k
    best_s[w[top], place[top]], best_i[w[top], place[top]] = s[top], i[top]


NONE_S, NONE_I = -(2**62), 2**63 - 1


def nearest(vectors: DataFrame, anchors: pd.DataFrame, axes: np.ndarray, scale: int, k: int, same: bool, bands: pd.DataFrame | None = None) -> DataFrame:
    """(anchor, slot, id, score): each task's ``k`` best rows for each slot of each anchor, of its own label or (not ``same``) of another.

    A slot is a band of scores (anchor, slot, low, high); without ``bands`` each anchor has one without limits, and its own id is left out.
    """
    dims = axes.shape[0]
    cuts = sorted({max(1, round(dims * s)) for s in STEPS} | {dims}) if dims else [0]
    if bands is None:
        bands = pd.DataFrame({"anchor": anchors["anchor"], "slot": 0, "low": float("-inf"), "high": float("inf")})
    place = {a: n for n, a in enumerate(anchors["anchor"])}
    of = np.array([place[a] for a in bands["anchor"]], np.int64)
    held = anchors.sparkSession if hasattr(anchors, "sparkSession") else vectors.sparkSession
    shared = held.sparkContext.broadcast((anchors["id"].to_numpy(np.int64), anchors["label"].to_numpy(np.int64), integers(anchors["vec"], scale, dims), axes, of, bands["low"].to_numpy(np.float64), bands["high"].to_numpy(np.float64), bands["anchor"].to_numpy(), bands["slot"].to_numpy()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a_id, a_label, a_whole, axes, of, low, high, anchor, slot = shared.value
        best_s, best_i = np.full((len(of), k), NONE_S, np.int64), np.full((len(of), k), NONE_I, np.int64)
        sides = [(a, Side(a_whole[a : a + TILE], axes, cuts)) for a in range(0, len(a_id), TILE)]
        order = np.argsort(of, kind="stable")
        first = np.searchsorted(of[order], np.arange(len(a_id) + 1))
        for b in batches:
            for r in range(0, len(b), TILE):
                some = b.iloc[r : r + TILE]
                ids, labels = some["id"].to_numpy(np.int64), some["label"].to_numpy(np.int64)
                rows = Side(integers(some["vec"], scale, dims), axes, cuts)
                for a, side in sides:
                    n = len(side.whole)
                    # an anchor's limits: the loosest of its slots', each no lower than what the slot holds already
                    floor = np.maximum(low, best_s[:, -1].astype(np.float64))
                    least, most = np.full(n, np.inf), np.full(n, -np.inf)
                    mine = order[first[a] : first[a + n]]
                    np.minimum.at(least, of[mine] - a, floor[mine])
                    np.maximum.at(most, of[mine] - a, high[mine])
                    equal = labels[:, None] == a_label[None, a : a + n]
                    open_ = equal & (ids[:, None] != a_id[None, a : a + n]) if same else ~equal
                    i, j = survivors(rows, side, cuts, least, most, open_)
                    if not len(i):
                        continue
                    score = products(rows.whole, side.whole, i, j)
                    n_slots = first[j + a + 1] - first[j + a]
                    pick = np.repeat(np.arange(len(i)), n_slots)
                    s = order[np.repeat(first[j + a], n_slots) + np.arange(len(pick)) - np.repeat(np.cumsum(n_slots) - n_slots, n_slots)]
                    fits = (score[pick] >= low[s]) & (score[pick] <= high[s]) & (score[pick] >= best_s[s, -1])
                    if fits.any():
                        merged_best(best_s, best_i, s[fits], score[pick][fits], ids[i[pick]][fits])
        at, col = np.nonzero(best_s > NONE_S)
        yield pd.DataFrame({"anchor": anchor[at], "slot": slot[at], "id": best_i[at, col], "score": best_s[at, col]})

    return vectors.mapInPandas(run, "anchor long, slot int, id long, score long")


def top(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of all tasks' rows for each slot, with their rank from 1."""
    rank = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low_percent: int = 30, high_percent: int = 90, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", block: int = BLOCK_ANCHORS
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows for which ``is_anchor`` (over id, label) holds.

    Components become floor(scale * x) and a score is the integer inner product with the anchor. An anchor's positives
    are its best ``positives`` other rows of its label; a positive's negatives the best ``negatives`` rows of other labels
    with low * positive_score <= 100 * score <= high * positive_score. The anchors are a stated query set: they are
    broadcast in blocks of at most ``block`` rows and meet all rows, a task's best of which are all it passes on.

    Rows without id or label, or whose vector is null or has a null or non-finite component, take no part. Ties go to the smaller
    id; rows that share an anchor's id are not its positives; other repeated rows count each. An empty vector scores 0,
    a shorter one counts as filled up with zeros. An anchor without positives, or whose positives score below 0, has no
    rows; neither has an empty table. Scores that need not fit into 64 bits raise an error. Other columns are not read.
    """
    spark = prepare(rows.sparkSession, arrow_rows=4096)
    v = store(usable(rows, id_col, vec_col, label_col), "vectors")
    dims = v.agg(F.max(F.size("vec"))).first()[0] or 0
    chosen = store(v.where(is_anchor).withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    n_anchors = chosen.count()
    if not n_anchors:
        return out
    axes = principal_axes(v, scale, dims)
    n_blocks = -(-n_anchors // block)
    for b in range(n_blocks):
        some = chosen.where(F.pmod(F.xxhash64("anchor"), F.lit(n_blocks)) == b).toPandas()
        if not len(some):
            continue
        near = store(top(nearest(v, some, axes, scale, positives, True), positives), "positives")
        p = near.toPandas()  # at most ``positives`` rows for each anchor of the block
        p["slot"] = p["rank"].astype("int32")
        bands = pd.DataFrame({"anchor": p["anchor"], "slot": p["slot"], "low": [-((-low_percent * x) // 100) for x in p["score"].tolist()], "high": [high_percent * x // 100 for x in p["score"].tolist()]})
        bands = bands[bands["low"] <= bands["high"]]
        if not len(bands):
            continue
        far = top(nearest(v, some, axes, scale, negatives, False, bands), negatives).select("anchor", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        both = far.join(near.select("anchor", F.col("rank").cast("int").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), ["anchor", "slot"])
        named = both.join(chosen.select("anchor", F.col("id").alias("anchor_id")), "anchor")
        out = out.unionByName(store(named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"), "negatives"))
    return out
