"""Quality classifier from weak labels.

Ten overlapping heuristic labellers each call a document good, bad or abstain. The counts of their vote patterns
over the whole corpus (at most 3**10 patterns) feed an expectation-maximisation that estimates how often each
labeller says what for good and for bad documents. The posterior of a document's pattern is its soft label. A
linear scorer over hashed word shapes, words and binned statistics is trained on the soft labels of a sample of
documents, whose size is bounded by ``train_rows``, and scores every document.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm.quality_rules import numbered, repeat_words
from quillmere.session import prepare, store

ABSTAIN, BAD, GOOD = 0, 1, 2

#: Per labeller: name, a value above which a document is bad, a value below which it is good, fewest words to vote.
LABELLERS = [
    ("symbols per word", 0.5, 0.1, 5),
    ("words in upper case", 0.3, 0.1, 5),
    ("words in repeated runs", 0.2, 0.05, 10),
    ("lines that repeat", 0.5, 0.4, 20),
    ("bars between words", 0.1, 0.02, 5),
    ("exclamation marks per word", 0.1, 0.02, 5),
    ("words equal to the one before", 0.2, 0.05, 5),
    ("share of the most frequent word", 0.3, 0.2, 20),
    ("words without a letter", 0.3, 0.1, 5),
    ("lines without a sentence end", 0.8, 0.4, 5),
]

SYMBOLS = b"#*$%&|<>"
SENTENCE_ENDS = tuple(x.encode() for x in (".", "!", "?", ":", ";", "…", '"', "'", "»", ")"))
DIMENSIONS = 1 << 14
MOST_FALSE_ALARMS = 0.005


def hashed(kind: bytes, value: bytes) -> int:
    return zlib.crc32(value, zlib.crc32(kind)) % DIMENSIONS


LOWER_SHAPE, TITLE_SHAPE = hashed(b"s", b"a"), hashed(b"s", b"Aa")


def word_facts(raw: bytes) -> tuple[int, int, int, int, int]:
    """Of a distinct word: hashed word, hashed shape, and whether it is in upper case, a bar, and without a letter."""
    if raw.isalpha():  # letters of ASCII, the common case
        if raw.islower():
            return hashed(b"w", raw), LOWER_SHAPE, 0, 0, 0
        if raw[1:].islower():
            return hashed(b"w", raw.lower()), TITLE_SHAPE, 0, 0, 0
    w = raw.decode("utf-8", "replace")
    return hashed(b"w", w.lower().encode()), hashed(b"s", shape(w).encode()), w.isupper() and len(w) > 1, w == "|", w.isascii() and not any(map(str.isalpha, w))


def parsed(text: str) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The text in UTF-8, its words as indexes, facts of the distinct words, and how often each occurs; words hold no ASCII white space."""
    raw = text.encode("utf-8", "surrogatepass")
    ids, distinct = numbered(raw.split())
    facts = np.array([word_facts(w) for w in distinct], np.int64).reshape(-1, 5)
    return raw, ids, facts, np.bincount(ids, minlength=len(distinct))


def measures(raw: bytes, ids: np.ndarray, facts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The value that each labeller looks at."""
    n = max(1, len(ids))
    lines = [x.rstrip() for x in raw.split(b"\n") if x.strip()]
    upper, bars, bare = (counts @ facts[:, 2:] / n).tolist()
    return np.array([
        sum(raw.count(bytes([c])) for c in SYMBOLS) / n,
        upper,
        repeat_words(ids, len(facts)) / n,
        (len(lines) - len(set(lines))) / max(1, len(lines)),
        bars,
        raw.count(b"!") / n,
        float((ids[1:] == ids[:-1]).sum()) / n,
        float(counts.max(initial=0)) / n,
        bare,
        sum(not x.endswith(SENTENCE_ENDS) for x in lines) / max(1, len(lines)),
    ])


def votes(values: np.ndarray, n_words: int) -> np.ndarray:
    out = np.zeros(len(LABELLERS), np.int64)
    for k, (_, bad, good, least) in enumerate(LABELLERS):
        if n_words >= least:
            out[k] = BAD if values[k] > bad else GOOD if values[k] < good else ABSTAIN
    return out


POWERS = 3 ** np.arange(len(LABELLERS))


LETTERS, CAPITALS, DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"\d+")


def shape(word: str) -> str:
    """Runs of letters become a, Aa or A and runs of digits 0; other characters stay."""
    kind = lambda m: "a" if not CAPITALS.search(m[0]) else "Aa" if m[0][1:].islower() else "A"
    return DIGITS.sub("0", LETTERS.sub(kind, word))


@lru_cache(1 << 12)
def named(name: str) -> int:
    return zlib.crc32(name.encode()) % DIMENSIONS


def facts_of(text: str) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of words, votes, hashed words and shapes with how often each occurs, and the measures. Whole texts count, however long."""
    raw, ids, facts, counts = parsed(text)
    values = measures(raw, ids, facts, counts)
    both = np.concatenate([facts[:, 0], facts[:, 1] + DIMENSIONS])  # shapes after words
    index, place = np.unique(both, return_inverse=True)
    return len(ids), votes(values, len(ids)), index.astype(np.uint16), np.bincount(place, np.concatenate([counts, counts]), len(index)).astype(np.int32), values


def features(n: int, index: np.ndarray, counts: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features from :func:`facts_of`: index (repeats add up) and weight."""
    share = counts / max(1, n)
    word = index < DIMENSIONS
    extra = [named(f"m{k}:{int(min(x, 4) * 20)}") for k, x in enumerate(values)] + [named(f"t{k}") for k in range(len(values))] + [named(f"n{n.bit_length()}")]
    at = np.concatenate([np.where(word, index, index - DIMENSIONS), extra]).astype(np.int32)
    return at, np.concatenate([np.where(word, 0.3, 1.0) * share, np.full(len(values), 0.5), np.minimum(values, 1.0), [0.3]])


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> dict:
    """From (n, labellers) votes and how many documents cast them: class shares, vote odds, posteriors of bad.

    Latent classes: good, and bad for the reason that labeller k looks for, as defects seldom come together and
    a model with one bad class would take a lone bad vote for an error. ``odds[c, k]`` holds how often labeller k
    calls bad and calls good in class c where it votes (abstaining says nothing): its accuracy. The start gives a
    document to the classes of its bad votes in equal parts, or to the good one. Counts are smoothed by one. A
    labeller's false alarms among good documents are held below MOST_FALSE_ALARMS, as thresholds are set for that;
    else a small class of bad documents may end in the good one.
    """
    m = len(LABELLERS)
    fired = (patterns.reshape(-1, m) == BAD).astype(np.float64)
    post = np.hstack([(fired.sum(axis=1) == 0)[:, None], fired / np.maximum(1, fired.sum(axis=1))[:, None]])
    share, odds = np.full(m + 1, 1 / (m + 1)), np.ones((m + 1, m, 3))
    for _ in range(rounds):
        for k in range(m):
            for v in (BAD, GOOD):
                odds[:, k, v] = 1 + (counts[:, None] * post * (patterns[:, k] == v)[:, None]).sum(axis=0)
        odds[:, :, BAD:] /= odds[:, :, BAD:].sum(axis=2, keepdims=True)
        odds[0, :, BAD] = np.minimum(odds[0, :, BAD], MOST_FALSE_ALARMS)
        odds[0, :, GOOD] = 1 - odds[0, :, BAD]
        share = 1 + (counts[:, None] * post).sum(axis=0)
        share /= share.sum()
        logs = np.log(share)[None, :] + sum(np.log(odds[:, k, :])[:, patterns[:, k]].T for k in range(m))
        post = np.exp(logs - logs.max(axis=1, keepdims=True)) if len(logs) else logs
        post /= np.maximum(1e-300, post.sum(axis=1, keepdims=True))
    return {"share": share, "odds": odds, "posterior": 1 - post[:, 0] if len(post) else np.zeros(0)}


def train_scorer(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rounds: int = 300, l2: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer for the probability of bad, by full-batch Adam; the same rows give the same weights."""
    w, bias = np.zeros(DIMENSIONS), 0.0
    if not len(rows):
        return w, -1.0
    index = np.concatenate([i for i, _ in rows])
    value = np.concatenate([v for _, v in rows])
    row = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
    m, v = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(row, value * w[index], len(rows)) + bias
        off = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels) / len(rows)
        g = np.append(np.bincount(index, value * off[row], DIMENSIONS) + l2 * w, off.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, bias = w - step[:-1], bias - step[-1]
    return w, float(bias)


def document_facts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, mark, n_words, pattern, n_bad_votes, i, c, v) of each row: a hash for sampling, votes as one number in base three, and :func:`facts_of` as bytes."""
    names = ["id", "mark", "n_words", "pattern", "n_bad_votes", "i", "c", "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in names[2:]]
            for t in b.column(1).to_pylist():
                n, cast, index, counts, values = facts_of(t or "")
                for x, y in zip(out, (n, int(cast @ POWERS), int((cast == BAD).sum()), index.tobytes(), counts.tobytes(), values.tobytes()), strict=True):
                    x.append(y)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("mark")).mapInArrow(
        run, f"id {kind}, mark long, n_words long, pattern long, n_bad_votes long, i binary, c binary, v binary"
    )


def unpacked(n: int, i: bytes, c: bytes, v: bytes) -> tuple[np.ndarray, np.ndarray]:
    return features(n, np.frombuffer(i, np.uint16).astype(np.int64), np.frombuffer(c, np.int32), np.frombuffer(v, np.float64))


def quality_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = 6000, threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_bad_votes, posterior and score (both: probability of bad), kept, mark.

    Texts are parsed once and what the labellers and the scorer look at is stored. ``train_rows`` bounds the training
    sample in expectation: documents whose hash of id and text is below a threshold, drawn alike at every size. The
    labellers, their accuracies and the scores cover all rows and whole texts. A null text counts as empty: all labellers
    abstain. Equal rows get equal results; an empty table gives an empty table. Other columns are not read.
    """
    spark = prepare(docs.sparkSession)
    facts = store(document_facts(docs, id_col, text_col), "facts")
    found = facts.groupBy("pattern").count().orderBy("pattern").collect()  # at most 3 ** len(LABELLERS) rows
    codes = np.array([r["pattern"] for r in found], np.int64)
    counts = np.array([r["count"] for r in found], np.float64)
    patterns = codes[:, None] // POWERS[None, :] % 3
    posterior = dict(zip(codes.tolist(), expectation_maximisation(patterns, counts)["posterior"].tolist(), strict=True))

    share = min(1.0, train_rows / max(1.0, counts.sum()))
    rows = facts.where(F.col("mark") < F.lit(int((share - 0.5) * 2**64) if share < 1 else 2**63 - 1).cast("long")).select("mark", "pattern", "n_words", "i", "c", "v").collect()
    rows.sort(key=lambda r: (r.mark, r.pattern, bytes(r.i), bytes(r.c)))
    weights, bias = train_scorer([unpacked(r.n_words, r.i, r.c, r.v) for r in rows], np.array([posterior.get(r.pattern, 0.5) for r in rows]))
    shared = spark.sparkContext.broadcast((weights, bias, posterior))  # DIMENSIONS weights, and one number per vote pattern

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b0, beliefs = shared.value
        for b in batches:
            known, scores = [], []
            for code, n, i, c, v in zip(*(b.column(k).to_pylist() for k in ("pattern", "n_words", "i", "c", "v")), strict=True):
                index, value = unpacked(n, i, c, v)
                known.append(beliefs.get(code, 0.5))
                scores.append(1 / (1 + np.exp(-max(-40.0, min(40.0, float(w[index] @ value) + b0)))))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("id", "mark", "n_words", "n_bad_votes")), pa.array(known, pa.float64()), pa.array(scores, pa.float64())], ["id", "mark", "n_words", "n_bad_votes", "posterior", "score"])

    kind = facts.schema["id"].dataType.simpleString()
    scored = facts.mapInArrow(score, f"id {kind}, mark long, n_words long, n_bad_votes long, posterior double, score double")
    return scored.withColumn("kept", F.col("score") < threshold)
