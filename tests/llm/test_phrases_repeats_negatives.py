"""Collocations, repeated passages and hard negatives against plain versions, with awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmere.llm import collocations, hard_negatives, substring_dedup
from quillmere.session import table

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, small):
    d = table(spark, small, "documents").select("doc_id", "text", "lang")
    rng = random.Random(5)
    made = [" ".join(rng.choice("a b A c. d, e") for _ in range(300)) for _ in range(6)]
    odd = [
        (None, None, None), (9001, None, "en"), (9002, "", None), (9003, " \n\t\x0b ", "de"), (9004, "x " * 400, None), (9005, "x " * 30 + "y", "und"), (9006, made[0] * 40, "en"),
        (9007, "É é ÀB ßx y " * 20, "fr"), (9007, "twelve words are too few for a window of thirteen so stay", "fr"), (None, "x " * 30 + "y", "en"),
    ]
    rows = odd + [(9100 + k, t, "en") for k, t in enumerate(made)]
    out = d.unionByName(spark.createDataFrame(rows, d.schema)).unionByName(d.where("doc_id < 6"))
    return out.withColumns({"id": F.lit(1), "k": F.lit(2), "phrase": F.lit("p"), "rank": F.lit("r"), "n": F.lit(0), "hits": F.lit(None).cast("int")}).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text, r.lang) for r in docs.select("doc_id", "text", "lang").collect()]


def brute_collocations(rows, least, best):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(AZ)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 6):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, counts in f.items():
        kept = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        hidden = {p for q, b in kept.items() for i in range(len(q)) for j in range(i + 2, len(q) + 1) if (p := q[i:j]) != q and 100 * b >= 100 * counts[p]}
        scored = []
        for p, a in kept.items():
            s, cut = min((1000 * a * n[lang] // (counts[p[:c]] * counts[p[c:]]), c) for c in range(1, len(p)))
            scored.append((-s, -a, " ".join(p).encode(), cut, counts[p[:cut]], counts[p[cut:]], p))
        order = [x for x in sorted(scored) if x[6] not in hidden][:best]
        out |= {(lang, i, p.decode(), -a, l, r, n[lang], -s, cut) for i, (s, a, p, cut, l, r, _) in enumerate(order, 1)}
    return out


@pytest.mark.parametrize(("least", "best", "bits"), [(100, 2000, 24), (7, 50, 12), (2, 30, 4), (300, 5, 10)])
def test_collocations_equal_plain_counts_whatever_the_sketch(docs, rows, least, best, bits):
    got = collocations.collocations(docs, least, best, bits=bits).collect()
    assert {tuple(r) for r in got} == brute_collocations(rows, least, best)
    assert len(got) == len({tuple(r) for r in got})


def test_collocations_of_nothing(docs):
    assert collocations.collocations(docs.limit(0)).count() == 0
    assert collocations.collocations(docs.where("text IS NULL")).count() == 0


def test_a_count_beyond_a_sketch_byte_and_products_beyond_64_bits(spark):
    d = spark.createDataFrame([("new york " * 100_000, "en"), ("new york city. " * 400, None)], "text string, lang string")
    got = {(r.lang, r.phrase): (r.a, r.l, r.r, r.n, r.score) for r in collocations.collocations(d).collect()}
    assert got[("en", "new york")][:4] == (100_000, 100_000, 100_000, 200_000)
    assert got[("und", "new york city")] == (400, 400, 400, 1200, 3000) and ("und", "new york") not in got
    big = spark.createDataFrame([("t", 2, "x y", 3 * 10**15), ("t", 1, "x", 4 * 10**15), ("t", 1, "y", 5 * 10**15), ("t", 0, "", 9 * 10**15)], "lang string, k int, phrase string, f long")
    before, collocations.phrase_counts = collocations.phrase_counts, lambda *_: big
    try:
        row = collocations.collocations(d).first()
    finally:
        collocations.phrase_counts = before
    assert row.score == 1000 * 3 * 9 * 10**30 // (4 * 5 * 10**30)


def brute_repeats(rows, words):
    first = {}
    for i, text, _ in rows:
        w = WORD.findall(text or "")
        for k in range(len(w) - words + 1):
            g = tuple(w[k : k + words])
            first[g] = min(first.get(g, substring_dedup.NO_ID), substring_dedup.NO_ID if i is None else i)
    out = Counter()
    for i, text, _ in rows:
        w = WORD.findall(text or "")
        gone = {p for k in range(len(w) - words + 1) if first[tuple(w[k : k + words])] < (substring_dedup.NO_ID if i is None else i) for p in range(k, k + words)}
        out[(i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))] += 1
    return out


@pytest.mark.parametrize(("words", "bits"), [(13, 27), (13, 8), (5, 20), (2, 16), (1, 16)])
def test_repeats_equal_a_plain_version_whatever_the_filter(docs, rows, words, bits, monkeypatch):
    monkeypatch.setattr(substring_dedup, "PART_CHARS", 50_000)
    got = substring_dedup.drop_repeats(docs, words, bits=bits).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == brute_repeats(rows, words)
    for r in got:
        assert r.n_removed == sum(x.end - x.start for x in r.removed)
    sums = {(r.doc_id, r.n_removed, r.kept_sha256) for r in substring_dedup.drop_repeats(docs, words, texts=False, bits=bits).collect()}
    assert sums == {(r.doc_id, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got}


def test_repeats_of_nothing(docs):
    assert substring_dedup.drop_repeats(docs.limit(0)).count() == 0


def test_symbols_stand_wherever_the_words_that_fix_them_stand():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("a b c d e f".split()) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    part = substring_dedup._Part(texts)
    low, high = substring_dedup.rounds(part.names[:, 0], part.doc, 2, 7)
    found = set(zip(low.tolist(), high.tolist(), strict=True))
    places = defaultdict(list)
    for d, t in enumerate(texts):
        w = t.split()
        for k in range(2, 8):
            for i in range(len(w) - k + 1):
                places[tuple(w[i : i + k])].append(int(part.begins[d]) + i)
    for words, at in places.items():
        assert len({(a, a + len(words)) in found for a in at}) == 1


def brute_negatives(rows, modulus):
    fine = [(i, g, [int(np.floor(256 * float(x))) for x in v]) for i, v, g in rows if i is not None and g is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = Counter()
    for a, g, q in fine:
        if a % modulus:
            continue
        score = [(-sum(x * y for x, y in zip(q, w)), i, h) for i, h, w in fine]
        near = sorted((s, i) for s, i, h in score if h == g and i != a)[:5]
        for s, p in near:
            far = sorted((t, i) for t, i, h in score if h != g and 30 * -s <= 100 * -t <= 90 * -s)[:10]
            out.update((a, p, k, i, -s, -t) for k, (t, i) in enumerate(far, 1))
    return out


@pytest.mark.parametrize("block", [8192, 3])
def test_negatives_equal_all_products(spark, small, block, monkeypatch):
    monkeypatch.setattr(hard_negatives, "TILE", 64)
    e = table(spark, small, "embeddings").select("vec_id", "embedding", "label")
    odd = [
        (None, [0.5] * 64, 1), (7000, None, 1), (7001, [0.1, None], 2), (7002, [float("nan")] * 64, 2), (7003, [float("inf")] * 64, 3), (7004, [0.1] * 64, None), (7100, [], 4), (7200, [0.5], 5), (7005, [0.5] * 3, 5),
        (7300, [-0.5] * 64, 6), (7400, [30.0] * 64, 11), (7401, [40.0] * 64, 11), (7402, [35.5] * 64, 12), (7500, [1.0] * 64, 13),
    ]
    again = e.where("vec_id BETWEEN 1 AND 40")
    every = e.unionByName(spark.createDataFrame(odd, e.schema)).unionByName(again.withColumn("vec_id", F.col("vec_id") + 8000)).unionByName(again.withColumn("label", F.lit(9)))
    rows = [tuple(r) for r in every.collect()]
    got = hard_negatives.hard_negatives(every.withColumns({"anchor": F.lit("x"), "id": F.lit(1), "vec": F.lit(2)}), F.col("id") % 20 == 0, block=block)
    assert Counter(tuple(r) for r in got.collect()) == brute_negatives(rows, 20)


def test_negatives_of_nothing_and_of_no_anchor(spark, small):
    e = table(spark, small, "embeddings")
    assert hard_negatives.hard_negatives(e.limit(0), F.col("id") % 100 == 0).count() == 0
    assert hard_negatives.hard_negatives(e, F.col("id") < 0).count() == 0


def test_bounds_lose_no_pair_and_discard_most_of_a_skewed_table():
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(600, 48)) * 200 * 0.8 ** np.arange(48))
    _, axes = np.linalg.eigh(x.T @ x)
    axes, cuts = axes[:, ::-1], [6, 12, 24, 36, 48]
    a, b = hard_negatives.Side(x[:500], axes, cuts), hard_negatives.Side(x[500:], axes, cuts)
    true = x[:500] @ x[500:].T
    low, high = np.quantile(true, 0.95, 0), np.quantile(true, 0.97, 0)
    i, j = hard_negatives.survivors(a, b, cuts, low, high, np.ones(true.shape, bool))
    assert set(zip(*np.nonzero((true >= low) & (true <= high)), strict=True)) <= set(zip(i, j, strict=True))
    assert len(i) < 0.03 * true.size


def test_cells_do_not_fill_up_as_a_corpus_grows(spark, monkeypatch):
    monkeypatch.setattr(collocations, "HELD_CELLS", 5_000)
    rng = np.random.default_rng(3)
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(0, 2000, 300)) + ". often said" * 2, "en") for k in range(80)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    kept, bits = collocations.frequent_cells(d.select("lang", "text"), 100)
    assert np.unpackbits(np.frombuffer(kept, np.uint8)).sum() == 2 * 3 and bits == collocations.CELL_BITS  # some 100,000 different phrases, few of them frequent
    got = {r.phrase for r in collocations.collocations(d).collect()}
    assert got == {r[2] for r in brute_collocations(rows, 100, 2000)} and "often said" in got


def test_packed_cells_come_back():
    cells = np.random.default_rng(4).integers(0, 1 << collocations.WIDE_BITS, 5000).astype(np.uint64)
    b = collocations._packed([cells, cells[:100]], 512)
    back = [(int(c) + (int(k) << (collocations.WIDE_BITS - 9)), int(n)) for k, x in zip(*(c.to_pylist() for c in b.columns)) for c, n in zip(*collocations._unpacked(x))]
    want, n = np.unique(np.concatenate([cells, cells[:100]]), return_counts=True)
    assert back == list(zip(want.tolist(), n.tolist()))
