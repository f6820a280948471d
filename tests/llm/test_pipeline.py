"""The pipeline's stages against what they promise."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillmere.llm import pii, quality_model
from quillmere.session import store, table

STAGES = dict(corpus_pipeline.STAGES)
#: Columns with names that stages and operators use themselves.
CLASHING = {c: k for k, c in enumerate(["size", "id", "key", "key2", "c0", "c1", "k", "k2", "__k", "__k2", "__id", "pii_spans", "__pii_k", "__pii_terms", "draws", "mark", "n_hit", "words", "target", "component_id"])}


@pytest.fixture(scope="module")
def docs(spark, small):
    d = table(spark, small, "documents")
    odd = [(9001, None, None, None, None), (None, None, None, None, None), (9002, "", "", "", 0), (None, "a b c", "en", "src1", 5), (9003, "w " * 50_000, "en", "src0", 100_000)]
    return store(d.unionByName(spark.createDataFrame(odd, d.schema)).unionByName(d.where("doc_id < 6")).withColumns({c: F.lit(k) for c, k in CLASHING.items()}), "docs")


def test_stages_are_in_order():
    assert list(STAGES) == ["quality", "near_duplicates", "decontamination", "personal_data", "mixing"]


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_take_empty_tables(spark, small, docs, name):
    out = STAGES[name](spark, docs.limit(0), small)
    assert out.count() == 0 and (name == "mixing" or out.columns == docs.columns)


@pytest.mark.parametrize("name", list(STAGES))
def test_other_columns_come_through_and_reruns_agree(spark, small, docs, name):
    out = STAGES[name](spark, docs, small)
    if name != "mixing":
        assert out.columns == docs.columns and {tuple(r) for r in out.select(*CLASHING).distinct().collect()} == {tuple(range(len(CLASHING)))}
    assert rows(out) == rows(STAGES[name](spark, docs.repartition(5), small))


def test_of_rows_that_repeat_the_same_one_stays(spark, small):
    made = [(1, "one two three four five six", s, x) for s in ("a", "b", None) for x in (1, 2)] + [(2, None, "c", 3), (2, None, "d", 3), (None, "other words are here too", "e", 1)]
    d = spark.createDataFrame(made, "doc_id long, text string, source string, x int")
    left = [rows(STAGES["near_duplicates"](spark, d.repartition(k), small)) for k in (1, 2, 5)]
    assert left[0] == left[1] == left[2] and sum(left[0].values()) == 3
    assert sum(rows(STAGES["mixing"](spark, d.select("doc_id", "text"), small)).values()) > 0


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_quality_removes_just_what_the_classifier_rejects(spark, small, docs):
    out = rows(STAGES["quality"](spark, docs, small))
    marked = docs.select("text", F.struct(F.xxhash64("doc_id", "text").alias("key"), F.hash("text", "doc_id").alias("key2")).alias("id"))
    kept = quality_model.quality_scores(marked, id_col="id").where("kept").count()
    assert sum(out.values()) == kept > 0.7 * docs.count() and not set(out) - set(rows(docs))


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return frozenset(" ".join(w[k : k + 5]) for k in range(len(w) - 4)) or frozenset([" ".join(w)] if w else [])


def test_near_duplicates_leave_one_of_each_group(spark, small, docs):
    left = STAGES["near_duplicates"](spark, docs, small)
    out = rows(left)
    assert max(out.values()) == 1 and not set(out) - set(rows(docs))
    sets = [shingle_set(r.text) for r in left.collect()]
    full = [s for s in sets if s]
    assert sum(not s for s in sets) == 1
    alike = sum(len(a & b) >= 0.85 * len(a | b) for k, a in enumerate(full) for b in full[:k])
    assert alike == 0
    # whatever went has something alike that was there too
    every = [shingle_set(r.text) for r in docs.collect()]
    kept = set(full)
    for s in every:
        if s and s not in kept:
            assert max(len(s & t) / len(s | t) for t in every if t != s and t) >= 0.5


def test_near_duplicates_link_at_a_jaccard_of_just_0_8(spark, small):
    made, want, k = [], set(), 0
    for n, shared in [(4, 4), (60, 54), (200, 178), (200, 182), (203, 176), (300, 264), (300, 270)] * 12:  # pairs of n shingles with so many in common
        words = [f"w{k}x{i}" for i in range(n + 4)]
        tail = words[: shared + 4] + [f"v{k}x{i}" for i in range(n - shared or 1)]
        a, b = shingle_set(" ".join(words)), shingle_set(" ".join(tail))
        made += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(tail))]
        want |= {2 * k} if len(a & b) >= 0.8 * len(a | b) else {2 * k, 2 * k + 1}
        k += 1
    left = STAGES["near_duplicates"](spark, spark.createDataFrame(made, "doc_id long, text string"), small)
    assert {r.doc_id for r in left.collect()} == want and k < len(want) < 2 * k


def test_decontamination_and_personal_data(spark, small, docs):
    clean = STAGES["decontamination"](spark, docs, small)
    gone = docs.count() - clean.count()
    assert gone > 0 and clean.columns == docs.columns
    out = STAGES["personal_data"](spark, clean, small)
    assert out.columns == docs.columns and out.count() == clean.count()
    assert all(not r.pii_spans for r in pii.find_pii(out).collect())


def test_the_mix_holds_the_texts_it_takes(spark, small, docs):
    texts = {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
    out = STAGES["mixing"](spark, docs, small).collect()
    cut = [r for r in out if r.words < r["size"]]
    for r in out:
        assert r.words == len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert any(i == r.doc_id and t is not None and (t.startswith(r.text) if r.words < r["size"] else t == r.text) for i, t in texts)
    assert cut and sum(r.words for r in out) == pytest.approx(sum(len((t or "").split()) for t in (r.text for r in docs.collect())), rel=0.05)


def test_run_gives_the_mix_twice(spark, small):
    a, b = corpus_pipeline.run(spark, small), corpus_pipeline.run(spark, small)
    assert rows(a) == rows(b) and a.count() > 50
    per_source = a.groupBy("source").agg(F.sum("words").alias("w"), F.max("target").alias("t")).collect()
    assert all(abs(r.w - r.t) <= 0.5 for r in per_source)
