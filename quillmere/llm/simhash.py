"""Near-duplicate groups by SimHash, compared exactly in tiles.

Fingerprints are gathered into tiles whose members have the same population counts (in each of a few lanes, and,
if asked, about the same number of shingles). Two tiles meet only if their counts leave room for a pair within
the radius; a pair of tiles that meets is compared in full with numpy exclusive-or and bit counts. Of the links
found in a pair of tiles only a spanning forest is kept, as components need no more.

Where a Jaccard similarity is asked for, these components are candidates only: within each, all pairs of shingle
sets are compared exactly, in pairs of chunks, and only pairs that reach it link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.llm.components import connected_components
from quillmere.session import prepare, store

LOWER_AZ = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SHINGLES_AT_ONCE = 1 << 16
TILE = 1024
#: Shingle sets, and shingles, of about this number go into a chunk of the exact comparison.
CHUNK_SETS, CHUNK_SHINGLES = 256, 1 << 20
BROADCAST_ROWS = 1_000_000


def shingles(text: str | None, words: int) -> list[bytes]:
    """Runs of ``words`` words, repeats included, joined by one space, in UTF-8; words hold no ASCII white space."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_AZ).split()
    if not found:
        return []
    joined = b" ".join(found)
    if len(found) <= words:
        return [joined]
    ends, at = [], -1
    for w in found:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[: len(found) - words])]
    return [joined[s:e] for s, e in zip(starts, ends[words - 1 :], strict=True)]


def _digests(parts: list[bytes], bits: int) -> np.ndarray:
    if bits == 64:
        h = xxhash.xxh64_digest
        return np.frombuffer(b"".join([h(x, 42) for x in parts]), np.uint8).reshape(-1, 8)
    h = xxhash.xxh3_128_digest
    return np.hstack([np.frombuffer(b"".join([h(x, 42 + k) for x in parts]), np.uint8).reshape(-1, 16) for k in range(bits // 128)])


def bit_counts(parts: list[bytes], bits: int) -> np.ndarray:
    """In how many of the shingle hashes each bit is set."""
    ones = np.zeros(bits, np.int64)
    for k in range(0, len(parts), SHINGLES_AT_ONCE):
        ones += np.unpackbits(_digests(parts[k : k + SHINGLES_AT_ONCE], bits), axis=1).sum(axis=0, dtype=np.uint32)
    return ones


def fingerprint(ones: np.ndarray, n: int) -> np.ndarray:
    """The big-endian 64-bit words of a fingerprint; a bit is 1 if it is set in over half of the ``n`` shingle hashes."""
    return np.packbits(ones * 2 > n).view(">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int = 3, bits: int = 64, distinct: bool = False) -> DataFrame:
    """(id, t, t2, n_shingles, s, w0 ... w[bits/64 - 1]) for each row. A text without words, or null, has no shingles and zeros.

    t and t2 are hashes of the text, s is one of the shingles, whatever their order.
    """
    n = bits // 64
    names = ["id", "t", "t2", "n_shingles", "s", *(f"w{k}" for k in range(n))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, sums, made = [], np.zeros(b.num_rows, np.uint64), np.zeros((b.num_rows, n), np.uint64)
            for k, t in enumerate(b.column(3).to_pylist()):
                parts = shingles(t, words)
                parts = list(dict.fromkeys(parts)) if distinct else parts
                counts.append(len(parts))
                if parts:
                    ones = bit_counts(parts, bits)
                    made[k], sums[k] = fingerprint(ones, len(parts)), xxhash.xxh64_intdigest(ones.tobytes(), 7)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(counts, pa.int64()), pa.array(sums.view(np.int64)), *(pa.array(made[:, k].view(np.int64)) for k in range(n))], names)

    kind = docs.schema[id_col].dataType.simpleString()
    marked = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), F.hash(text_col).alias("t2"), F.col(text_col).alias("text"))
    return marked.mapInArrow(run, ", ".join([f"id {kind}", "t long", "t2 int", *(f"{x} long" for x in names[3:])]))


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """``texts`` (node, text) to (node, hashes): the hashes of a text's different shingles, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 32):  # so that the hashes of many long texts are not held at once
                part = b.slice(k, 32)
                sets = [np.unique(_digests(shingles(t, words), 64).view(np.int64).ravel()) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], ["node", "hashes"])

    return texts.mapInArrow(run, "node long, hashes array<long>")


def similar(sets: list[np.ndarray], jaccard: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j of sets whose Jaccard similarity is ``jaccard`` or more."""
    sizes = np.array([len(x) for x in sets], np.int64)
    if not sizes.sum():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    _, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)[np.argsort(place, kind="stable")]
    ends = np.cumsum(np.bincount(place))
    starts = np.concatenate([[0], ends[:-1]])
    left, right, at = [], [], 0
    for i, n in enumerate(sizes):
        mine = place[at : at + n]
        at += n
        shared = np.zeros(len(sets), np.int64)
        long = ends[mine] - starts[mine]
        for k in range(0, n, 4096):
            some, count = starts[mine[k : k + 4096]], long[k : k + 4096]
            held = np.repeat(some - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            shared += np.bincount(owner[held], minlength=len(sets))
        j = np.nonzero(shared[i + 1 :] / np.maximum(1, n + sizes[i + 1 :] - shared[i + 1 :]) >= jaccard)[0] + i + 1
        left.append(np.full(len(j), i))
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def confirmed(candidates: DataFrame, texts: DataFrame, words: int, jaccard: float) -> DataFrame:
    """(u, v): links that connect what pairs of similar shingle sets connect, among nodes with the same root.

    ``candidates``: node, n, t, t2, root; ``texts``: t, t2, text. The nodes of a root are dealt to chunks, and each
    pair of chunks is compared in full, so that a task holds two chunks at once however many nodes a root has.
    """
    few = candidates.count() <= BROADCAST_ROWS
    wanted = candidates.select("t", "t2", "node")
    one = texts.join(F.broadcast(wanted) if few else wanted, ["t", "t2"]).groupBy("node").agg(F.first("text").alias("text"))
    sets = store(shingle_sets(one.select("node", "text"), words), "sets")
    chunks = F.greatest(F.ceil(F.count("*") / CHUNK_SETS), F.ceil(F.sum("n") / CHUNK_SHINGLES)).cast("int")
    sizes = candidates.groupBy("root").agg(chunks.alias("chunks"))
    dealt = candidates.join(sizes, "root").select("node", "root", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk"), "chunks")
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    pairs = met.select("node", "root", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"))

    def compare(found: pa.Table) -> pa.Table:
        nodes = found["node"].to_numpy()
        i, j = similar([x.values.to_numpy() for x in found["hashes"]], jaccard)
        label = _forest(i, j, len(nodes))
        hung = np.nonzero(label != np.arange(len(nodes)))[0]
        return pa.table({"u": pa.array(nodes[hung], pa.int64()), "v": pa.array(nodes[label[hung]], pa.int64())})

    return pairs.join(sets, "node").groupBy("root", "a", "b").applyInArrow(compare, "u long, v long")


def _steps(lanes: int, quantum: int, radius: int, by_size: bool) -> list[tuple[int, ...]]:
    """Differences between the cells of two tiles that may hold a pair within the radius: half of them, and zero."""
    gap = lambda d: max(0, (abs(d) - 1) * quantum + 1) if d else 0
    most = radius // quantum + 1
    axes = [range(-1, 2)] * by_size + [range(-most, most + 1)] * lanes
    return [d for d in product(*axes) if sum(map(gap, d[by_size:])) <= radius and d >= (0,) * len(d)]


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    label = np.arange(n)
    while True:
        a, b = label[i], label[j]
        if (a == b).all():
            return label
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label != (up := label[label])).any():
            label = up


def _links(radius: int, ratio: float, n_words: int):
    """A function for mapInArrow: pairs of tiles to the spanning forests (u, v) of their links."""

    def members(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
        flat, ends = column.values, column.offsets.to_numpy()
        fields = [flat.field(x).to_numpy(zero_copy_only=False) for x in ("node", "n", *(f"w{k}" for k in range(n_words)))]
        for s, e in zip(ends[:-1], ends[1:], strict=True):
            yield fields[0][s:e], fields[1][s:e], [x[s:e].view(np.uint64) for x in fields[2:]]

    def compare(same: bool, x: tuple, y: tuple) -> tuple[np.ndarray, np.ndarray]:
        # a tile met with itself comes twice, maybe in another order, as the two lists are collected separately
        (node, size, words), (node2, size2, words2) = x, x if same else y
        apart = np.bitwise_count(words[0][:, None] ^ words2[0][None, :])
        for a, b in zip(words[1:], words2[1:], strict=True):
            apart = apart + np.bitwise_count(a[:, None] ^ b[None, :]).astype(np.uint16)
        i, j = np.nonzero(apart <= radius)
        keep = i < j if same else np.ones(len(i), bool)
        if ratio:
            keep &= np.minimum(size[i], size2[j]) >= ratio * np.maximum(size[i], size2[j])
        i, j = i[keep], j[keep]
        nodes = node if same else np.concatenate([node, node2])
        label = _forest(i, j if same else j + len(node), len(nodes))
        hung = np.nonzero(label != np.arange(len(nodes)))[0]
        return nodes[hung], nodes[label[hung]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for same, x, y in zip(b.column(0).to_pylist(), members(b.column(1)), members(b.column(2)), strict=True):
                u, v = compare(same, x, y)
                us.append(u)
                vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    return run


def link_forest(nodes: DataFrame, n_words: int, radius: int, ratio: float = 0.0, tile: int = TILE) -> DataFrame:
    """(u, v): links that connect what links within ``radius`` connect. ``nodes``: node, n, w0 ... with no fingerprint twice.

    ``nodes`` should be a stored table, as it is read three times. A tile holds about ``tile`` fingerprints, so
    that a task never sees more than two tiles at once, however many fingerprints share their counts.
    """
    bits = 64 * n_words
    lanes, quantum = (4, 1) if radius <= 3 and n_words == 1 else (1, max(1, radius))
    width = bits // lanes
    parts: list[Column] = []
    if lanes == 1:
        parts.append(sum((F.bit_count(f"w{k}").cast("long") for k in range(n_words)), F.lit(0)))
    else:
        for k in range(lanes):
            mask = ((1 << width) - 1) << (k * width)
            parts.append(F.bit_count(F.col("w0").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))).cast("long"))
    axes = [F.floor(x / quantum).cast("long") for x in parts]
    steps = _steps(lanes, quantum, radius, bool(ratio))
    if ratio:  # two sizes whose ratio is allowed lie in the same or in adjoining steps of this scale
        axes.insert(0, F.floor(F.log(F.greatest("n", F.lit(1))) / (-1.0001 * math.log(ratio))).cast("long"))
    base = 4 * bits
    code = lambda xs: sum(x * base ** (len(xs) - 1 - k) for k, x in enumerate(xs))

    members = nodes.withColumn("cell", code(axes))
    cells = members.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("chunks"))
    tiles = (
        members.join(F.broadcast(cells), "cell")  # at most 17 ** 4 cells with four lanes, a few hundred with one
        .withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
        .groupBy("cell", "chunk")
        .agg(F.collect_list(F.struct("node", "n", *(f"w{k}" for k in range(n_words)))).alias("members"))
    )
    met = cells.select(F.col("cell").alias("cell2"), F.col("chunks").alias("chunks2"))
    pairs = (
        cells.withColumn("step", F.explode(F.array(*(F.lit(code(d)).cast("long") for d in steps))))
        .withColumn("cell2", F.col("cell") + F.col("step"))
        .join(met, "cell2")
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .withColumn("chunk2", F.explode(F.sequence(F.lit(0), F.col("chunks2") - 1)))
        .where((F.col("step") != 0) | (F.col("chunk") <= F.col("chunk2")))
        .select("cell", "chunk", "cell2", "chunk2")
    )
    other = tiles.select(F.col("cell").alias("cell2"), F.col("chunk").alias("chunk2"), F.col("members").alias("members2"))
    same = (F.col("cell") == F.col("cell2")) & (F.col("chunk") == F.col("chunk2"))
    return (
        pairs.join(tiles, ["cell", "chunk"])
        .join(other, ["cell2", "chunk2"])
        .select(same.alias("same"), "members", "members2")
        .mapInArrow(_links(radius, ratio, n_words), "u long, v long")
    )


def simhash_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 3,
    bits: int = 64,
    radius: int = 2,
    distinct: bool = False,
    ratio: float = 0.0,
    tile: int = TILE,
    link_empty: bool = True,
    jaccard: float = 0.0,
) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, w0 ..., component_id (the smallest id reachable over links).

    Links join fingerprints at ``radius`` or fewer differing bits and, if ``ratio`` is given, with shingle counts
    in that proportion or closer. With ``jaccard``, such pairs are candidates: only sets of shingles of that Jaccard
    similarity or more link, compared exactly. Null and empty texts have fingerprint zero; with ``link_empty`` false,
    or with ``jaccard``, they link with each other only. Rows with a null id take part; a group of only such rows has a null component_id.
    Repeated rows all come back. An empty table gives an empty table. Only ``id_col`` and ``text_col`` are read.
    """
    prepare(docs.sparkSession)
    n = bits // 64
    ws = [f"w{k}" for k in range(n)]
    keys = ws + (["n_shingles"] if ratio or jaccard or not link_empty else []) + (["s"] if jaccard else [])
    prints = store(fingerprints(docs, id_col, text_col, words, bits, distinct or jaccard > 0), "prints")
    node = F.col("w0") if keys == ["w0"] else F.xxhash64(*keys)
    size = F.col("n_shingles") if "n_shingles" in keys else F.lit(0).cast("long")
    nodes = store(prints.groupBy(*keys).agg(F.min("id").alias("least_id"), F.min(F.struct("t", "t2")).alias("one")).select(node.alias("node"), size.alias("n"), *keys, "least_id", "one"), "nodes")
    compared = nodes
    if jaccard:  # unlike sets reach it only from this size on
        compared = nodes.where(F.col("n") / (F.col("n") + 1) >= jaccard)
    elif not link_empty:
        compared = nodes.where("n > 0")
    linked = connected_components(link_forest(compared.select("node", "n", *ws), n, radius, ratio, tile))
    if jaccard:
        rooted = compared.select("node", "n", "one.t", "one.t2").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
        several = linked.select("root").distinct()
        candidates = store(rooted.join(several, "root", "left_semi"), "candidates")
        texts = docs.select(F.xxhash64(text_col).alias("t"), F.hash(text_col).alias("t2"), F.col(text_col).alias("text"))
        linked = connected_components(confirmed(candidates, texts, words, jaccard))
    # stored one after another, so that the joins are between plain tables and adaptive execution can split a large group
    linked = store(linked.unionByName(linked.select(F.col("root").alias("node"), "root").distinct()), "linked")  # roots hang on themselves
    least = store(nodes.select("node", "least_id").join(linked, "node").groupBy("root").agg(F.min("least_id").alias("component_id")), "least")
    component = store(linked.join(least, "root").select("node", "component_id"), "components")
    named = store(nodes.join(component, "node", "left").select(*keys, F.coalesce("component_id", "least_id").alias("component_id")), "named")
    return prints.join(named, keys, "left").select("id", "n_shingles", *ws, "component_id")
