"""Repeated passages by recompression: rounds that name pairs of symbols alike wherever equal words stand.

A round gives every symbol a side by its name alone. A left symbol followed by a right one becomes a pair with a name of
its own; neighbours that are equal have the same side, so a run keeps the name of its symbol however long it is. Which
symbols a round makes of some words depends only on these words and at most one symbol on either side. So with each
symbol goes the range of words that fixes it: wherever the same words stand, the same symbol stands.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm.wordnames import MIX, ROLL, Words, in_parts, mixed, rolled
from quillmere.session import prepare, store

ROUNDS = 6
#: log2 of the bits that say which symbols are shared: 16 MB for each task, whatever the corpus.
FILTER_BITS = 27
PART_CHARS = 4_000_000
#: A passage is cut before one window in so many.
CUT = 8
#: A null id is larger than any other.
NO_ID = 2**63 - 1


def rounds(names: np.ndarray, doc: np.ndarray, least: int, most: int, n_rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """All rounds' symbols that ``least`` to ``most`` words fix, as the ranges [start, end) of these words, each once, in order.

    ``names``: of words, ``doc``: the number of each word's document, not decreasing.
    """
    n = len(names)
    sym, start = names, np.arange(n)
    low, high = np.arange(n), np.arange(n) + 1
    outside = np.int64(4) * max(n, 1)
    found: list[np.ndarray] = []
    for r in range(n_rounds):
        if not len(sym):
            break
        side = (mixed(sym + np.uint64(int(MIX) * (r + 1) % 2**64)) >> np.uint64(63)).astype(bool)
        joined = doc[start[:-1]] == doc[start[1:]]
        pair = joined & ~side[:-1] & side[1:]
        head = np.concatenate([[True], ~pair])
        at = np.nonzero(head)[0]
        paired = np.concatenate([pair, [False]])[at]
        # a single left symbol is fixed with the symbol after it, a single right one with that before
        after_high = np.concatenate([np.where(joined, high[1:], outside), [outside]])
        after_low = np.concatenate([np.where(joined, low[1:], 0), [0]])
        before_low = np.concatenate([[-outside], np.where(joined, low[:-1], -outside)])
        before_high = np.concatenate([[0], np.where(joined, high[:-1], 0)])
        left = ~side[at]
        needs_after = paired | left
        new_low = np.where(needs_after, np.where(after_high[at] < outside, np.minimum(low[at], after_low[at]), low[at]), np.minimum(low[at], before_low[at]))
        new_high = np.where(needs_after, np.maximum(high[at], after_high[at]), np.maximum(high[at], before_high[at]))
        few = (high - low >= least) & (high - low <= most)
        found.append(low[few] * np.int64(most + 1) + (high - low)[few])
        nxt = np.minimum(at + 1, len(sym) - 1)
        sym = np.where(paired, mixed(sym[at] * ROLL + sym[nxt]), sym[at])
        start, low, high = start[at], new_low, new_high
    few = (high - low >= least) & (high - low <= most)
    every = np.sort(np.concatenate([*found, low[few] * np.int64(most + 1) + (high - low)[few]]))
    every = every[np.concatenate([[True], every[1:] != every[:-1]])] if len(every) else every
    low = every // (most + 1)
    return low, low + every % (most + 1)


class _Part:
    """Some documents as one array of words: names, the document of each word, where documents begin."""

    def __init__(self, texts: list[str | None]) -> None:
        words, flat, self.sizes = Words(), [], []
        for t in texts:
            own = (t or "").encode().split()
            flat += own
            self.sizes.append(len(own))
        self.flat = flat
        numbers = words.numbers(flat)
        self.names = words.names()[numbers]
        self.begins = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)


def symbols(part: _Part, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, name) of the symbols that lie within windows of ``words`` words, about half a window each, named by the words that fix them.

    48 bits are enough, as equal names of different words only leave more windows open.
    """
    names, most = part.names[:, 0], words // 2 + 1
    low, high = rounds(names, part.doc, max(1, most - 2), most)
    name = np.empty(len(low), np.uint64)
    for k, x in enumerate(rolled(names, most), 1):
        own = high - low == k
        name[own] = mixed(x[low[own]] + np.uint64(k)) >> np.uint64(16)
    return low, high, name


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], _Part]]:
    """Rows (id, text, ...) and their words, a bounded number of characters at a time."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for some in in_parts(rows, lambda r: len(r[1] or ""), PART_CHARS):
        yield some, _Part([r[1] for r in some])


def _probes(names: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple((x >> np.uint64(64 - bits)).astype(np.int64) for x in (mixed(names), mixed(names + MIX)))


def shared_symbols(docs: DataFrame, words: int, bits: int = FILTER_BITS) -> bytes:
    """The symbols that stand in more than one document (id, text), as a filter of 2**bits bits with two bits for each.

    How many documents hold a symbol is added up over the whole corpus (rows that share an id count each); the filter can
    only let too many through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in _parts(batches):
            low, _, name = symbols(part, words)
            doc = part.doc[low]
            order = np.argsort(name)
            name, doc = name[order], doc[order]
            first = np.nonzero(np.concatenate([[True], name[1:] != name[:-1]]))[0] if len(name) else np.empty(0, np.int64)
            if len(first):
                more = np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first)
                yield pa.RecordBatch.from_arrays([pa.array(name[first].view(np.int64)), pa.array(1 + more.astype(np.int64))], ["name", "n"])

    each = docs.mapInArrow(run, "name long, n long")
    names = each.groupBy("name").agg(F.sum("n").alias("n")).where("n > 1").select("name")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.concatenate(_probes(b.column(0).to_numpy().view(np.uint64), bits))
            word, place = np.unique(at >> 6, return_inverse=True)
            value = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(value, place, np.uint64(1) << (at & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(value.view(np.int64))], ["word", "value"])

    rows = names.mapInArrow(probe, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
    out = np.zeros(max(1, (1 << bits) >> 6), np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("value").to_numpy().view(np.uint64)
    return out.tobytes()


def window_names(part: _Part, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Two names of each window that starts at ``at``: 128 bits of its words."""
    out = []
    for n in (part.names[:, 0], part.names[:, 1]):
        x = np.zeros(len(at), np.uint64)
        for k in range(words):
            x = x * ROLL + n[at + k]
        out.append(mixed(x))
    return tuple(out)


def open_windows(part: _Part, words: int, has) -> np.ndarray:
    """Where the windows start that may stand in another document: all symbols that they fix are shared."""
    n = len(part.names)
    low, high, name = symbols(part, words)
    alone = ~has(name)
    low, high = low[alone], high[alone]
    gone = np.zeros(n + 1, np.int64)  # a symbol of one document rules out the windows from high - words to low
    np.add.at(gone, np.maximum(high - words, part.begins[part.doc[low]]), 1)
    np.add.at(gone, low + 1, -1)
    return np.nonzero((np.cumsum(gone[:-1]) == 0) & (np.arange(n) + words <= part.begins[part.doc + 1]))[0]


def passages(part: _Part, at: np.ndarray, words: int) -> tuple[np.ndarray, ...]:
    """(start, windows, name, name): windows in a row as the symbols of the last round, cut where a window's own name says so."""
    x1, x2 = window_names(part, at, words)
    new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (part.doc[at[1:]] != part.doc[at[:-1]]) | (x1[1:] % np.uint64(CUT) == 0)]) if len(at) else np.empty(0, bool)
    first = np.nonzero(new)[0]
    if not len(first):
        return at, at, x1, x2
    n = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, n)
    power = np.multiply.accumulate(np.full(int(n.max()), ROLL, np.uint64))[place]
    return at[first], n, *(mixed(np.add.reduceat(x * power, first) + n.astype(np.uint64)) for x in (x1, x2))


FACTS = "id long, mark long, doc_id long, n_words long, whole string, packed binary, p1 array<long>, p2 array<long>, at array<int>, n array<int>"


def passage_facts(docs: DataFrame, words: int, filter_: bytes, texts: bool, bits: int = FILTER_BITS) -> DataFrame:
    """A row for each of ``docs`` (id, text, doc_id) with its passages of open windows, by two names, start and number of windows.

    ``whole``: the text's words joined by spaces, or their SHA-256; ``mark``: 64 bits of it; ``packed``: the words, compressed, as
    they are shuffled twice. Texts without open windows are not carried on.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filter_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        pack = zstandard.ZstdCompressor(3).compress
        held = np.frombuffer(shared.value, np.uint64)
        bit = lambda at: (held[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        has = lambda names: np.logical_and(*(bit(at) for at in _probes(names, bits)))
        for rows, part in _parts(batches):
            ids, _, doc_ids = zip(*rows, strict=True)
            start, n, p1, p2 = passages(part, open_windows(part, words, has), words)
            cut = np.searchsorted(start, part.begins)
            lists = lambda v, kind: pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(v, kind))
            joined = [b" ".join(part.flat[part.begins[d] : part.begins[d + 1]]) for d in range(len(ids))]
            sums = [sha256(x) for x in joined]
            whole = [x.decode() if texts else h.hexdigest() for x, h in zip(joined, sums, strict=True)]
            mark = np.array([int.from_bytes(h.digest()[:8], "big", signed=True) for h in sums], np.int64)
            kept = [pack(x) if some else None for x, some in zip(joined, np.diff(cut) > 0, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(mark), pa.array(doc_ids, pa.int64()), pa.array(part.sizes, pa.int64()), pa.array(whole, pa.string()), pa.array(kept, pa.binary()),
                    lists(p1.view(np.int64), pa.int64()), lists(p2.view(np.int64), pa.int64()), lists(start - part.begins[part.doc[start]], pa.int32()), lists(n, pa.int32()),
                ],
                ["id", "mark", "doc_id", "n_words", "whole", "packed", "p1", "p2", "at", "n"],
            )

    return docs.mapInArrow(run, FACTS)


def windows_of(docs: DataFrame, words: int) -> DataFrame:
    """(id, mark, h1, h2, at) of the windows within the ``parts`` (at, n) of ``docs`` (id, packed, mark, parts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        every = ((i, unpack(t).decode(), mark, parts) for b in batches for i, t, mark, parts in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for rows in in_parts(every, lambda r: len(r[1]), PART_CHARS):
            part = _Part([r[1] for r in rows])
            spans = [(d, p["at"], p["n"]) for d, r in enumerate(rows) for p in r[3]]
            doc, first, n = np.array(spans, np.int64).reshape(-1, 3).T
            at = np.repeat(part.begins[doc] + first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            h1, h2 = window_names(part, at, words)
            of = np.repeat(doc, n)
            ids, marks = (np.array([r[k] for r in rows], np.int64)[of] for k in (0, 2))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(marks), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array((at - part.begins[of]).astype(np.int32))], ["id", "mark", "h1", "h2", "at"])

    return docs.mapInArrow(run, "id long, mark long, h1 long, h2 long, at int")


def earlier(rows: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` (id, names) with ``least``, the smallest id that has the same names."""
    return rows.join(rows.groupBy(*names).agg(F.min("id").alias("least"), F.max("id").alias("last")).where("least < last").drop("last"), names, "left")


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now: its cleaner waits for the driver to collect its garbage, which may be long."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_repeats(docs: DataFrame, words: int = 13, id_col: str = "doc_id", text_col: str = "text", texts: bool = True, bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, n_words, n_removed, removed, kept_text or kept_sha256): each document without the passages that an earlier one holds.

    A word goes if a window of ``words`` consecutive words covers it that also starts in a document with a smaller id,
    both judged on the input. ``removed``: ranges [start, end) of word numbers. ``texts``: the kept words joined by single spaces,
    else their SHA-256 as hex.

    1. Rounds name symbols; one aggregation finds those that two documents hold. 2. Windows all of whose symbols are
    shared stay open, and open windows in a row form passages. A passage that a smaller id holds too is settled whole.
    3. The windows of the others (each passage where it first stands) are compared one by one; a window that stands in a
    settled passage also stands where that passage stands first, so none is missed. Names have 128 bits: equal
    names are equal words but for a chance below 10**-12 with 10**13 windows.

    A null text is empty; texts of fewer than ``words`` words keep all; a null id counts as larger than all others, rows of one id
    take nothing from each other and repeated rows share their result. Texts are whole, however long: what is held for one
    document at a time is its own words. An empty table gives an empty table; other columns are not read.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("doc_id"))
    shared = shared_symbols(rows.select("id", "text"), words, bits)
    release(spark)
    facts = store(passage_facts(rows, words, shared, texts, bits), "passages")
    each = facts.where(F.size("at") > 0).select("id", "mark", F.explode(F.arrays_zip("p1", "p2", "at", "n")).alias("p")).select("id", "mark", "p.*")
    judged = store(earlier(each, ["p1", "p2"]).select("id", "mark", "at", "n", F.coalesce(F.col("least") < F.col("id"), F.lit(False)).alias("settled")), "judged")
    release(spark)
    span = F.struct("at", "n")
    parts = judged.where("NOT settled").groupBy("id", "mark").agg(F.collect_set(span).alias("parts"))  # sets, as rows may repeat
    single = store(windows_of(facts.where("packed IS NOT NULL").join(parts, ["id", "mark"]).select("id", "packed", "mark", "parts"), words), "windows")
    release(spark)
    late = earlier(single, ["h1", "h2"]).where("least < id").select("id", "mark", "at", F.lit(1).alias("n"))
    hits = judged.where("settled").select("id", "mark", "at", "n").unionByName(late)
    places = store(hits.groupBy("id", "mark").agg(F.array_sort(F.collect_set(span)).alias("hits")), "repeats")
    release(spark)
    out_schema = f"doc_id long, n_words long, n_removed long, removed array<struct<start:int,end:int>>, {'kept_text' if texts else 'kept_sha256'} string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            rows = []
            for doc_id, n, whole, packed, hits in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if not hits:
                    rows.append((doc_id, n, 0, [], whole))
                    continue
                gone: list[dict] = []
                for h in hits:
                    end = h["at"] + h["n"] - 1 + words
                    if gone and h["at"] <= gone[-1]["end"]:
                        gone[-1]["end"] = max(gone[-1]["end"], end)
                    else:
                        gone.append({"start": h["at"], "end": end})
                own, left, at = unpack(packed).split(), [], 0
                for g in gone:
                    left += own[at : g["start"]]
                    at = g["end"]
                left += own[at:]
                joined = b" ".join(left)
                rows.append((doc_id, n, n - len(left), gone, joined.decode() if texts else sha256(joined).hexdigest()))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "n_words", "n_removed", "removed", "kept_text" if texts else "kept_sha256"])

    met = facts.select("id", "mark", "doc_id", "n_words", "whole", "packed").join(places, ["id", "mark"], "left").select("doc_id", "n_words", "whole", "packed", "hits")
    return met.mapInArrow(run, out_schema)
