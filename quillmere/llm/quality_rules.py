"""Quality rules: an isolation forest over rule statistics.

Rule statistics of every whole text are written once. Trees of random splits are grown on samples of 128 rows, as
the method prescribes; a document's path lengths over all trees give its anomaly score. The threshold is taken
from the score histograms of all labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.session import prepare, store

SYMBOLS = "#*$%&|<>"
WHITE = bytes([32, 9, 10, 11, 12, 13])
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
BINS = 2000


def numbered(words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Words as indexes into the list of distinct words."""
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    return ids, list(seen)


def repeat_words(ids: np.ndarray, distinct: int, run: int = 5) -> int:
    """Words that lie in a window of ``run`` words that occurs twice or more."""
    n = len(ids) - run + 1
    if n < 2 or distinct == len(ids):
        return 0
    at, key = np.arange(n), ids[:n]
    for k in range(1, run):  # only places whose shorter window repeats can have a longer one that does
        _, key, counts = np.unique(key * distinct + ids[at + k], return_inverse=True, return_counts=True)  # below n * n, so it never overflows
        again = counts[key] > 1
        at, key = at[again], key[again]
        if not len(at):
            return 0
    edge = np.bincount(at, minlength=len(ids) + 1) - np.bincount(at + run, minlength=len(ids) + 1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics(text: str) -> tuple[int, ...]:
    """The values of STATS for one text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    ids, distinct = numbered(words)
    letters = raw.translate(None, WHITE)
    chars = len(letters) if raw.isascii() else len(letters.decode("utf-8", "surrogatepass"))
    lines = [x for x in raw.split(b"\n") if x.strip(WHITE)]
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(ids, len(distinct)), len(lines)


def rule_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, STATS ..., mark) of each row of ``docs``; null is an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([statistics(t or "") for t in b.column(1).to_pylist()], np.int64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(rows[:, k].copy()) for k in range(len(STATS))), b.column(2)], ["id", *STATS, "mark"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("mark")).mapInArrow(
        run, ", ".join([f"id {kind}", *(f"{x} long" for x in STATS), "mark long"])
    )


def ratios(rows: np.ndarray) -> np.ndarray:
    """What the trees split on: word length, and the shares of symbols and of repeated lines; repeated words have a base rule.

    Each is drawn towards an ordinary value as if the text had some more ordinary words or lines, since a short
    text says little of its shares.
    """
    n, chars, symbols, dups, _, lines = (rows[:, k].astype(np.float64) for k in range(len(STATS)))
    return np.stack([(chars + 100) / (n + 20), np.minimum(symbols / (n + 20), 3), dups / (lines + 10)], axis=1)


def _average(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, np.float64)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow(rows: np.ndarray, rng: np.random.Generator, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A tree as arrays: feature (-1 at a leaf), split value, and the depth a row ends at; node k has children 2k + 1 and 2k + 2."""
    size = 2 ** (most + 1) - 1
    feature, value, length = np.full(size, -1), np.zeros(size), np.zeros(size)
    todo = [(0, rows, 0)]
    while todo:
        k, x, depth = todo.pop()
        low, high = (x.min(axis=0), x.max(axis=0)) if len(x) else (np.zeros(rows.shape[1]), np.zeros(rows.shape[1]))
        open_ = np.nonzero(high > low)[0]
        if depth >= most or len(x) <= 1 or not len(open_):
            length[k] = depth + _average(len(x))
            continue
        f = rng.choice(open_)
        s = rng.uniform(low[f], high[f])
        feature[k], value[k] = f, s
        left = x[:, f] <= s
        todo += [(2 * k + 1, x[left], depth + 1), (2 * k + 2, x[~left], depth + 1)]
    return feature, value, length


def forest_scores(forest: list, psi: int, x: np.ndarray) -> np.ndarray:
    """Anomaly scores between 0 and 1; 0.5 is ordinary."""
    total = np.zeros(len(x))
    for feature, value, length in forest:
        at = np.zeros(len(x), np.int64)
        for _ in range(int(np.log2(len(feature) + 1))):
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                break
            go = x[np.arange(len(x)), np.maximum(f, 0)] > value[at]
            at = np.where(inner, 2 * at + 1 + go, at)
        total += length[at]
    return 2 ** (-total / max(1, len(forest)) / max(1e-9, float(_average(psi))))


def threshold_from(histogram: dict[tuple[int, int], int], keep: float) -> float:
    """The score up to which rows are kept.

    Of the thresholds that keep at least ``keep`` of the good rows, the one with the most bad rows rejected; on
    a tie the highest. Without labels of both kinds nothing is rejected.
    """
    good, bad = np.zeros(BINS + 1), np.zeros(BINS + 1)
    for (b, quality), n in histogram.items():
        (good if quality else bad)[b] += n
    if not good.sum() or not bad.sum():
        return 1.0
    below = np.cumsum(good) / good.sum()
    rejected = bad.sum() - np.cumsum(bad)
    allowed = np.nonzero(below >= keep)[0]
    best = allowed[rejected[allowed] == rejected[allowed].max()].max()
    return float(best + 1) / BINS


def quality_rules(
    docs: DataFrame,
    labels: DataFrame | None,
    id_col: str = "doc_id",
    text_col: str = "text",
    trees: int = 100,
    psi: int = 128,
    keep: float = 0.995,
    seed: int = 7,
    label_col: str = "quality",
) -> DataFrame:
    """One row per row of ``docs``: id, STATS, base_failed, score, kept.

    ``base_failed``: fewer than 10 words, or over 20 of 100 words lie in repeated windows. ``kept`` is false for
    those, else it says whether the score is at most the threshold. ``trees * psi`` bounds the rows that trees are
    grown on; they are drawn by a hash of the row, alike at every size. The threshold looks at all labelled rows
    that pass the base rules. A null text counts as empty. An empty table gives an empty table.
    """
    spark = prepare(docs.sparkSession)
    stats = store(rule_statistics(docs, id_col, text_col), "stats").withColumn(
        "base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    )
    usable = stats.where(F.col("n_words") >= 10)
    n = usable.count()
    share = min(1.0, 1.2 * trees * psi / max(1, n))
    low = usable.where(F.col("mark") < F.lit(int((share - 0.5) * 2**64) if share < 1 else 2**63 - 1).cast("long"))
    drawn = low.select(*STATS, "mark").orderBy("mark", *STATS).limit(trees * psi).collect()
    x = ratios(np.array([r[: len(STATS)] for r in map(tuple, drawn)], np.int64).reshape(-1, len(STATS)))
    rng = np.random.default_rng(seed)
    size = min(psi, len(x))
    forest = [grow(x[rng.choice(len(x), size, replace=False)], rng, max(1, int(np.ceil(np.log2(max(2, size)))))) for _ in range(trees if size else 0)]
    shared = spark.sparkContext.broadcast((forest, size))  # trees of 2 * psi nodes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees_, size_ = shared.value
        for b in batches:
            rows = np.stack([b.column(1 + k).to_numpy(zero_copy_only=False) for k in range(len(STATS))], axis=1)
            found = forest_scores(trees_, size_, ratios(rows)) if trees_ and b.num_rows else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found)], [*b.schema.names, "score"])

    cols = ["id", *STATS, "base_failed"]
    kind = stats.schema["id"].dataType.simpleString()
    scored = stats.select(*cols).mapInArrow(run, ", ".join([f"id {kind}", *(f"{s} long" for s in STATS), "base_failed boolean", "score double"]))
    limit = 1.0
    if labels is not None:
        marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
        bins = (
            scored.where("NOT base_failed").join(marks, "id").groupBy(F.floor(F.col("score") * BINS).cast("int").alias("bin"), (F.col("label") > 0).cast("int").alias("label")).count().collect()
        )  # at most 2 * BINS rows
        limit = threshold_from({(r["bin"], r["label"]): r["count"] for r in bins}, keep)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") < limit))
