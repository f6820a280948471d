"""Phrase collocations: counts of phrases' cells find what may be frequent, a second pass counts just that exactly."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmere.llm.wordnames import MIX, Words, in_parts, mixed, rolled
from quillmere.session import prepare, store

#: A phrase's cell is one of 2**WIDE_BITS, so many that cells do not fill up as a corpus grows: with 10**11 phrases a cell has 1.5 on average.
WIDE_BITS = 36
#: Phrases whose cells a task adds up before it passes them on, and slices of cells at least: a task adds up one slice of all tasks at a time.
HELD_CELLS, SLICES = 8_000_000, 256
#: Of the cells that are frequent two bits each are kept, in rows of 2**CELL_BITS bits, more if there are many.
CELL_BITS, DEPTH = 24, 2
LONGEST = 5
#: Characters whose words are counted together in one pass, and words after which a task forgets its numbering.
PART_CHARS, FORGET_WORDS = 8_000_000, 1_000_000
#: Phrases that a task adds up before it passes them on.
HELD_PHRASES = 400_000
#: Bytes that end a piece become a full stop, the only bytes that may stand for one afterwards.
PIECES = bytes.maketrans(b",;:!?\n\x0b\x0c\r", b".........")
#: Languages whose sizes are broadcast; more are joined by shuffling.
BROADCAST_LANGS = 100_000


def _pieces(rows: list[tuple[str, str]], words: Words, langs: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of ``rows`` (lang, text): number, piece, language number."""
    ids, piece, lang, at = [], [], [], 0
    for some in in_parts(rows, lambda r: len(r[1] or ""), 2_000_000):
        flat, sizes = [], []
        for _, text in some:
            own = (text or "").encode().lower().translate(PIECES).replace(b".", b" . ").split()
            own.append(b".")
            flat += own
            sizes.append(len(own))
        n = words.numbers(flat)
        stop = n == words[b"."]
        p = np.cumsum(stop) + at
        at = int(p[-1]) + 1
        of = np.repeat(np.array([langs.setdefault(g, len(langs)) for g, _ in some], np.int64), sizes)
        ids.append(n[~stop]), piece.append(p[~stop]), lang.append(of[~stop])
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in (ids, piece, lang))


def _lang_names(langs: dict[str, int]) -> np.ndarray:
    w = Words()
    w.numbers([g.encode() for g in langs])
    return w.names()[:, 0]


def _wide(names: np.ndarray, of_lang: np.ndarray, k: int) -> np.ndarray:
    """The cell of each phrase of ``k`` words."""
    return mixed(names ^ of_lang * np.uint64(2 * k + 1)) >> np.uint64(64 - WIDE_BITS)


def _bits(cells: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The bit of each cell in each row of what is kept of the frequent cells."""
    x = mixed(cells + MIX)
    for _ in range(DEPTH):
        yield (x >> np.uint64(64 - bits)).astype(np.int64)
        x = mixed(x + MIX)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, str]]]:
    rows = ((g, t) for b in batches for g, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
    return in_parts(rows, lambda r: len(r[1] or ""), PART_CHARS)


def in_large_tasks(texts: DataFrame, splits: int = 4) -> DataFrame:
    """``texts`` in tasks of several input splits each, where that leaves two tasks for every core.

    Each task passes on a row for every frequent phrase, however little it has read: so fewer and larger tasks pass on less.
    """
    n = texts.rdd.getNumPartitions()
    return texts.coalesce(max(1, min(n, max(2 * texts.sparkSession.sparkContext.defaultParallelism, -(-n // splits)))))


def cell_counts(texts: DataFrame, slices: int) -> DataFrame:
    """(slice, cells): how often each cell of the phrases of 1 to 5 words in ``texts`` (lang, text) occurs, packed, for each slice and some 8 million phrases of a task.

    What is written grows with the text, however many tasks there are: about two bytes for each different phrase of those that are added up together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, langs, held, n = Words(), {}, [], 0
        for rows in _parts(batches):
            ids, piece, lang = _pieces(rows, words, langs)
            names, of_lang = words.names()[:, 0][ids], _lang_names(langs)[lang]
            for k, x in enumerate(rolled(names, LONGEST), 1):
                if not len(x):
                    break
                whole = piece[: len(x)] == piece[k - 1 :]
                held.append(_wide(x[whole], of_lang[: len(x)][whole], k))
                n += len(held[-1])
            if n >= HELD_CELLS:
                yield _packed(held, slices)
                held, n = [], 0
            if len(words) > FORGET_WORDS:
                words = Words()
        if n:
            yield _packed(held, slices)

    return texts.mapInArrow(run, "slice int, cells binary")


def _packed(held: list[np.ndarray], slices: int) -> pa.RecordBatch:
    """Cells added up, by slice: distances and counts (at most 255), byte by byte, compressed."""
    cells = np.concatenate(held)
    cells.sort()
    first = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
    counts, cells = np.minimum(np.diff(np.r_[first, len(cells)]), 255).astype(np.uint8), cells[first]
    width = np.uint64(WIDE_BITS - (slices.bit_length() - 1))
    of = (cells >> width).astype(np.int64)
    ends, numbers, packed = np.searchsorted(of, np.arange(slices + 1)), [], []
    for k in range(slices):
        a, b = ends[k], ends[k + 1]
        if a < b:
            far = np.diff(cells[a:b] & ((np.uint64(1) << width) - np.uint64(1)), prepend=np.uint64(0)).astype("<u4")
            numbers.append(k)
            packed.append(np.int32(b - a).tobytes() + pa.compress(far.view(np.uint8).reshape(-1, 4).T.tobytes() + counts[a:b].tobytes(), "zstd", asbytes=True))
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(packed, pa.binary())], ["slice", "cells"])


def _unpacked(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(packed, np.int32, 1)[0])
    raw = np.frombuffer(pa.decompress(packed[4:], 5 * n, "zstd", asbytes=True), np.uint8)
    far = np.ascontiguousarray(raw[: 4 * n].reshape(4, n).T).view("<u4").ravel()
    return np.cumsum(far, dtype=np.uint64), raw[4 * n :]


def frequent_cells(texts: DataFrame, least: int, bits: int | None = None, slices: int = SLICES) -> tuple[bytes, int]:
    """Two bits for each cell that occurs ``least`` times or more (at most 255), in rows of 2**bits; and ``bits``.

    Cells are added up slice by slice where the counts of a slice meet, and only the frequent ones go to the driver, eight bytes each.
    By default rows have 16 bits or more for each, so that of all other phrases few in a thousand get through.
    """
    import pandas as pd

    cut, width = min(least, 255), np.uint64(WIDE_BITS - (slices.bit_length() - 1))

    def add_up(rows: pd.DataFrame) -> pd.DataFrame:
        each = [_unpacked(x) for x in rows["cells"]]
        cells, counts = np.concatenate([x[0] for x in each]), np.concatenate([x[1] for x in each])
        order = np.argsort(cells, kind="stable")
        cells, counts = cells[order], counts[order]
        first = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
        found = cells[first][np.add.reduceat(counts, first, dtype=np.int64) >= cut]
        return pd.DataFrame({"cells": [(found + (np.uint64(rows["slice"].iloc[0]) << width)).astype("<u8").tobytes()]})

    rows = cell_counts(texts, slices).groupBy("slice").applyInPandas(add_up, "cells binary").toArrow()
    found = np.frombuffer(b"".join(rows.column("cells").to_pylist()), "<u8")
    bits = bits or max(CELL_BITS, (16 * len(found)).bit_length())
    full = np.zeros((DEPTH, (1 << bits) // 8 or 1), np.uint8)
    for row, at in enumerate(_bits(found, bits)):
        np.bitwise_or.at(full[row], at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
    return full.tobytes(), bits


def phrase_counts(docs: DataFrame, least: int = 100, lang_col: str = "lang", text_col: str = "text", bits: int | None = None) -> DataFrame:
    """(lang, k, phrase, f) of all phrases of 1 to 5 words that occur ``least`` times or more in a language, counted exactly; k 0 holds all its words.

    The first pass adds up cells of phrases, which never count too little: a phrase whose cell stays below ``least`` is
    not frequent. The second pass counts what is left, where its parts are left too. Phrases that share a cell or its
    bits (``bits``: fixed rows of 2**bits for these) let more through and change no result.
    """
    spark = prepare(docs.sparkSession)
    read = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    texts, slices = in_large_tasks(read), max(SLICES, 1 << (4 * read.rdd.getNumPartitions()).bit_length())
    kept, bits = frequent_cells(texts, least, bits, min(slices, 1 << (WIDE_BITS - 8)))
    shared = spark.sparkContext.broadcast(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        full = np.frombuffer(shared.value, np.uint8).reshape(DEPTH, -1)
        for rows in _parts(batches):
            words, langs = Words(), {}
            ids, piece, lang = _pieces(rows, words, langs)
            named, of_lang, vocabulary = words.names()[:, 0][ids], _lang_names(langs)[lang], list(words)
            spoken, n_words = list(langs), np.bincount(lang, minlength=len(langs))
            held.update({(spoken[g], 0, b""): int(n) for g, n in enumerate(n_words)})
            group, left = lang * len(vocabulary) + ids, None
            for k, x in enumerate(rolled(named, LONGEST), 1):
                if not len(x):
                    break
                at = np.arange(len(x)) if k == 1 else left[:-1][(left[1:] == left[:-1] + 1) & (piece[left[:-1]] == piece[np.minimum(left[:-1] + k - 1, len(piece) - 1)])]
                at = at[at < len(x)]
                kept = np.ones(len(at), bool)
                for row, place in enumerate(_bits(_wide(x[at], of_lang[at], k), bits)):
                    kept &= full[row][place >> 3] >> (place & 7).astype(np.uint8) & 1 > 0
                left = at[kept]
                if not len(left):
                    break
                key = group[left] if k == 1 else group[left] * len(vocabulary) + ids[left + k - 1]
                _, first, number, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                group = np.zeros(len(x), np.int64)
                group[left] = number
                start = left[first]
                for i, c in zip(start.tolist(), n.tolist(), strict=True):
                    held[(spoken[lang[i]], k, b" ".join([vocabulary[w] for w in ids[i : i + k]]))] += c
                if len(held) > HELD_PHRASES:
                    yield from _counted(held)
                    held.clear()
        yield from _counted(held)

    counted = texts.mapInArrow(run, "lang string, k int, phrase string, f long")
    return store(counted.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("k") == 0)), "phrases")


def _counted(held: Counter) -> Iterator[pa.RecordBatch]:
    rows = list(held.items())
    for a in range(0, len(rows), 16_384):
        some = rows[a : a + 16_384]
        cols = [[x[0][0] for x in some], [x[0][1] for x in some], [x[0][2].decode() for x in some], [x[1] for x in some]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], ["lang", "k", "phrase", "f"])


def part(phrase: Column, start: Column, n: Column) -> Column:
    """``n`` words of a phrase from word ``start``, counted from 1."""
    return F.array_join(F.slice(F.split(phrase, " "), start, n), " ")


def collocations(docs: DataFrame, least: int = 100, best: int | None = 2000, subsume: int = 100, lang_col: str = "lang", text_col: str = "text", bits: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, cut): phrases of 2 to 5 words that hold together, of each language the ``best`` (None: all).

    Words are what stands between spaces and tabs, A-Z in lower case, within pieces that end at ``.,;:!?`` and line
    ends. A phrase that occurs a >= ``least`` times is scored at its weakest cut, floor(1000 * a * n / (l * r)), the
    smallest cut first; it gives way to a phrase that is longer by some words and holds it in ``subsume`` percent of its
    occurrences or more (then one that is longer by a single word does so too, so only these are looked at).

    Null texts are empty, a null language is ``und``, empty texts and tables have no phrases, repeated rows count each
    time, ties go to the larger a and then the smaller phrase, other columns are not read. Long texts are whole, but no
    phrase goes across a piece. Products are decimals of 38 digits: exact for corpora of up to 10**16 words.
    """
    f = phrase_counts(docs, least, lang_col, text_col, bits)
    found = f.where("k >= 2")
    cuts = found.select("lang", "phrase", F.col("f").alias("a"), "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumns({"left": part(F.col("phrase"), F.lit(1), F.col("cut")), "right": part(F.col("phrase"), F.col("cut") + 1, F.col("k") - F.col("cut"))})
    known = f.where("k > 0")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    sizes = f.where("k = 0").select("lang", F.col("f").alias("n"))
    cuts = cuts.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_LANGS else sizes, "lang")
    exact = {c: F.col(c).cast("decimal(16,0)") for c in ("a", "l", "r", "n")}
    score = F.expr("cast(1000 as decimal(4,0)) * xa * xn div (xl * xr)")
    scored = cuts.withColumns({f"x{c}": x for c, x in exact.items()}).withColumn("score", score)
    weakest = scored.groupBy("lang", "phrase", "a", "n", "k").agg(F.min(F.struct("score", "cut", "l", "r")).alias("w"))

    longer = found.where("k >= 3").select("lang", F.col("f").alias("b"), F.explode(F.array(part(F.col("phrase"), F.lit(1), F.col("k") - 1), part(F.col("phrase"), F.lit(2), F.col("k") - 1))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("b").alias("b"))
    free = weakest.join(longer, ["lang", "phrase"], "left").where(F.col("b").isNull() | (F.col("b") * 100 < F.col("a") * subsume))
    rows = free.select("lang", "phrase", "a", "w.l", "w.r", "n", "w.score", "w.cut")
    if best is None:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("n_salt", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return first.where(F.col("n_salt") <= best).drop("salt", "n_salt").withColumn("rank", rank).where(F.col("rank") <= best).select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut")
