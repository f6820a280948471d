"""Hand-made cases for rules whose order matters, and properties of the store."""

from __future__ import annotations

import dataclasses
import re

import pytest
from pyspark.sql import functions as F

from quillmere.config import DEFAULT, load_config
from quillmere.functions import text as X
from quillmere.operators import concepts, evidence, hierarchy, search, store, vector_index
from quillmere.plans import catalogue, ingest, retrieval
from quillmere.sources import fixtures as fx
from quillmere.streaming import pages
from tests.conftest import rows_of


def candidate(name, score, direct=False, parent=None, subs=(0,), h=None, mentions=(), aliases=()):
    return evidence.Candidate(name, parent, h or name, name, score, direct, frozenset(subs), list(mentions), list(aliases))


def ids(found):
    return [c.id for c in found]


def test_near_duplicates_keep_the_first():
    pool = [candidate("a", 0.9, h="x"), candidate("b", 0.8, h="x"), candidate("c", 0.7, parent="a"), candidate("d", 0.6, parent="z"), candidate("z", 0.5)]
    assert ids(evidence.without_near_duplicates(pool)) == ["a", "d"]


def test_coverage_moves_the_only_candidate_of_a_sub_query_up():
    pool = [candidate("a", 0.9), candidate("b", 0.8), candidate("c", 0.7, subs=(1,)), candidate("d", 0.1, subs=(2,))]
    assert ids(evidence.cover_sub_queries(pool, 3)) == ["a", "c", "d", "b"]
    assert ids(evidence.cover_sub_queries(pool, 1)) == ["a", "b", "c", "d"]


def test_swap_pass_goes_once_from_the_left():
    pool = [candidate("n", 0.90), candidate("d1", 0.88, True), candidate("d2", 0.86, True)]
    assert ids(evidence.direct_first(pool, 0.05)) == ["d1", "d2", "n"]
    assert ids(evidence.direct_first([candidate("n", 0.9), candidate("d", 0.8, True)], 0.05)) == ["n", "d"]


def test_complements_need_a_name():
    a = candidate("a", 0.9, mentions=["Stun"])
    pool = [a, candidate("stunned", 0.2), candidate("", 0.1), candidate("q", 0.1, aliases=["STUN"])]
    assert ids(evidence.with_complements([a], pool)) == ["a", "stunned", "q"]


def test_list_questions_keep_everything_and_others_the_budget():
    pool = [candidate(f"u{k:02d}", 1 - k / 100) for k in range(20)]
    assert len(evidence.select_evidence(pool, 1, True)) == 20
    assert len(evidence.select_evidence(pool, 1, False)) == 8


def test_asof_parent_takes_the_latest_earlier_unit(spark):
    rows = [("1", 0, "A", None), ("2", 1, "B", None), ("3", 2, "A", None), ("4", 3, "child", "A"), ("5", 4, "self", "self"), ("6", 5, "orphan", "Z"), ("7", 6, "A", "B")]
    u = spark.createDataFrame([("d", 1, *r) for r in rows], "document_id string, page int, id string, source_order int, name string, parent_name string")
    found = {r.id: r.parent_id for r in hierarchy.asof_parent(u, ["document_id", "page"], "source_order").collect()}
    assert found == {"1": None, "2": None, "3": None, "4": "3", "5": None, "6": None, "7": "2"}


def test_table_types_are_repaired_in_unit_order(spark):
    rows = [("h", None, 0, "DataTableHeader"), ("r", "h", 1, "Rule"), ("p", None, 2, "Rule"), ("c", "p", 3, "DataTableRow"), ("t", "h", 4, "ColumnListTable"), ("x", "t", 5, "Rule"), ("z", None, 6, "Odd")]
    u = spark.createDataFrame([("d", 1, *r) for r in rows], "document_id string, page int, id string, parent_unit_id string, source_order int, type string")
    found = {r.id: r.type for r in ingest.repair_table_types(u).collect()}
    # the list in a header turns into a row before its own child is visited, so the child keeps its type
    assert found == {"h": "DataTableHeader", "r": "DataTableRow", "p": "DataTableHeader", "c": "DataTableRow", "t": "DataTableRow", "x": "Rule", "z": "Rule"}


def test_parent_chain_survives_a_cycle_and_any_depth(spark):
    deep = [(f"n{k}", f"n{k - 1}" if k else None, f"N{k}") for k in range(12)]
    u = spark.createDataFrame([("a", "b", "A"), ("b", "a", "B"), ("c", None, "C"), ("d", "missing", "D"), *deep], "id string, parent_unit_id string, name string")
    found = {r.id: r.parents for r in hierarchy.parent_chains(u).collect()}
    assert found["n11"] == [f"N{k}" for k in range(11)]
    u.createOrReplaceTempView("cycles")
    assert {r.id: r.path for r in spark.sql(hierarchy.parent_chains_sql("cycles")).collect()} == found
    assert found["c"] == [] and found["d"] == [] and found["a"] == ["B"] and found["b"] == ["A"]


def test_rrf_adds_reciprocal_ranks(spark):
    lists = [("s", "a", 1), ("s", "b", 2), ("c", "b", 1), ("c", "c", 2), ("l", "b", 1)]
    df = spark.createDataFrame([(0, 0, s, i, r, 1.0) for s, i, r in lists], "question_id long, sub_query_index int, source string, id string, rank int, score double")
    found = {r.id: r.fused for r in search.rrf(df).collect()}
    assert found["b"] == pytest.approx(1 / 62 + 2 / 61) and found["a"] == pytest.approx(1 / 61) and found["c"] == pytest.approx(1 / 62)
    again = {r.id: r.fused for r in search.rrf(df.orderBy(F.desc("rank"))).collect()}
    assert again == pytest.approx(found)


def test_threshold_is_inclusive_and_falls_back(spark):
    def best(*scores):
        rows = [(q, chr(97 + k), s, s) for q in (0, 1) for k, s in enumerate(scores)]
        found = retrieval.passing(spark.createDataFrame(rows, "question_id long, id string, rerank_score double, final_score double")).orderBy("question_id", "position").collect()
        assert [r.id for r in found if r.question_id == 0] == [r.id for r in found if r.question_id == 1]
        return [r.id for r in found if r.question_id == 0]

    assert best(0.4, 0.39, 0.1) == ["a"]
    assert best(0.1, 0.3, 0.2, 0.05) == ["b", "c", "a"]


def test_citations_and_truncation(spark):
    long_id = "RULE-" + "0a" * 16
    row = spark.range(1).select(
        X.citations(F.lit(f"see {long_id}, {long_id} and RULE-00042")).alias("new"),
        X.citations(F.lit("RULE-00042 RULE-00042"), r"[A-Z]+-\d{5}").alias("old"),
        F.length(X.content_document(F.lit("p"), F.lit("ж" * 9000), 100)).alias("cut"),
        X.content_document(F.lit("ж" * 200), F.lit("x"), 100).alias("prefix"),
        X.normalize_term(F.lit("  A\tÉ  b ")).alias("term"),
        X.chunks(F.lit("")).alias("none"),
    ).first()
    assert row.new == [long_id] and row.old == ["RULE-00042"] and row.prefix == "ж" * 200
    assert row.cut == 1 + len("\n\nContent:\n") + int((100 - 1 - 10) * 2.5) and row.term == "a é b" and row.none == []


def test_upserting_twice_changes_nothing(spark):
    now = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    change = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    once = store.upsert(now, change, ["id"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, store.upsert(once, change, ["id"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_reset_then_run_gives_the_same_units(spark, small):
    u = fx.units(spark, small).withColumn("status", F.lit("pending"))
    done = ingest.run_phase(u, "summary")
    again = ingest.run_phase(store.reset_stage(done, "summary"), "summary")
    cols = ["id", "summary", "status"]
    assert sorted(map(tuple, done.select(*cols).collect())) == sorted(map(tuple, again.select(*cols).collect()))


def page(n, units, total=9):
    return ("d", n, total, [dict(zip(("type", "name", "content", "parent_name", "section"), u, strict=True)) for u in units])


PAGES = [
    page(1, [("Rule", "A", "a" * 150, None, ["s", "t"]), ("Rule", "B", "b", "A", [])]),
    page(2, [("Rule", "C", "c", None, []), ("Rule", "x", "c", "C", [])]),
    page(4, [("Rule", "D", "d", None, ["q"])]),
]


def test_state_is_carried_to_the_next_page_only(spark):
    found = {r.page: r for r in pages.page_batch(spark.createDataFrame(PAGES, pages.PAGE)).collect()}
    assert [found[k].carried for k in (1, 2, 4)] == [False, True, False]
    assert found[2].containers_before == "A" and found[4].containers_before == "" and found[4].pages_processed == 3


def test_only_the_last_containers_stay():
    units = [dict(name=n, parent_name=None, content="", section=[]) for n in "abcdef"] + [dict(name="z", parent_name=n, content="", section=[]) for n in "abcdef"]
    state: dict = {}
    done: dict = {}
    pages.advance(state, 1, 2, units, done)
    assert state["containers"] == "f|e|d|c"
    pages.advance(state, 1, 2, units, done)
    assert state["units"] == 12 and state["pages"] == 1


def test_stream_equals_batch_over_restarts_and_repeats(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k, p in enumerate(PAGES):
        spark.createDataFrame([p], pages.PAGE).coalesce(1).write.mode("append").parquet(source)
        pages.run_stream(spark, source, str(tmp_path / "checkpoint"), out)
        assert spark.read.schema(pages.OUT).parquet(out).count() == k + 1
    want = pages.page_batch(spark.createDataFrame(PAGES, pages.PAGE))
    got = spark.read.schema(pages.OUT).parquet(out)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_concepts_group_resolve_and_chain(spark):
    m = spark.createDataFrame([("u", 1, 0, 0, "Fire  ball", "mentions"), ("u", 1, 0, 1, "fire ball", "defines")], "unit_id string, page int, source_order int, pos int, raw_term string, mention_type string")
    r = concepts.group_terms(m).collect()
    assert [(x.term, x.mention_type, x.raw_term) for x in r] == [("fire ball", "defines", "Fire  ball")]
    t = spark.createDataFrame([("stone", 0, [1.0, 0.0]), ("stones", 1, [1.0, 0.1]), ("stoness", 2, [1.0, 0.2])], "term string, first int, vec array<double>")
    none = spark.createDataFrame([], "normalized_alias string, concept_term string")
    found = {x.term: x.concept_term for x in concepts.resolve(t.select("term", "first"), none, t.select("term", "vec")).collect()}
    assert found == {"stone": "stone", "stones": "stone", "stoness": "stone"}


def test_config_files(tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text("# settings\nrrf_k:\n  value: 30\n  description: fusion\nrerank_threshold: 0.5\nunknown: 1\n")
    assert load_config(str(p)) == dataclasses.replace(DEFAULT, rrf_k=30, rerank_threshold=0.5)


def test_top_k_is_limited_before_the_shuffle_and_questions_are_broadcast(spark, small):
    lib, queries = fx.library(spark, small), fx.questions(spark, small)
    plan = search.vector_top_k(lib.subjects, queries, fx.N_QUERIES, 15)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "BroadcastNestedLoopJoin" in plan and "CartesianProduct" not in plan


def test_vector_search_in_blocks_gives_the_same(spark, small, monkeypatch):
    lib, queries = fx.library(spark, small), fx.questions(spark, small)
    found = lambda: sorted(map(tuple, search.vector_top_k(lib.subjects, queries, fx.N_QUERIES, 5).select("question_id", "sub_query_index", "id", "rank").collect()))
    whole = found()
    monkeypatch.setattr(search, "BROADCAST_QUERIES", 3)
    assert found() == whole and len(whole) == 5 * fx.N_QUERIES


def test_only_buckets_of_asked_terms_are_read_and_texts_are_not(spark, small):
    lib = fx.library(spark, small)
    plan = search.bm25(lib.index, fx.sub_queries(spark), fx.N_QUERIES)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and "documents.parquet" not in plan


def test_terms_are_resolved_alike_in_parts_of_any_size(spark, monkeypatch):
    import random

    random.seed(4)
    rows = [(f"term{k % 40}" + "s" * (k // 40), k, [random.random() + 0.1 for _ in range(4)]) for k in range(120)]
    t = spark.createDataFrame(rows, "term string, first int, vec array<double>")
    none = spark.createDataFrame([], "normalized_alias string, concept_term string")
    found = []
    for b in (7, 1024):
        monkeypatch.setattr(vector_index, "LIST_ROWS", b)
        found.append({x.term: x.concept_term for x in concepts.resolve(t.select("term", "first"), none, t.select("term", "vec"), probes=None).collect()})
    assert found[0] == found[1] and len(set(found[0].values())) < 120
    assert "CartesianProduct" not in concepts.earlier_neighbours(t)._jdf.queryExecution().executedPlan().toString()


def test_parts_pass_on_only_what_a_top_k_needs(spark, monkeypatch):
    import random

    from quillmere.operators import search

    random.seed(5)
    rows = [(f"t{k:03d}", (k * 7) % 50, [float(random.choice([0, 0, 1, 2])) for _ in range(24)]) for k in range(300)]  # many equal vectors and places
    t = spark.createDataFrame([r for r in rows if any(r[2])], "term string, first int, vec array<double>")
    monkeypatch.setattr(vector_index, "LIST_ROWS", 64)
    best = lambda met: sorted(map(tuple, search.top_k(met, 5, key="term").select("term", "id", "rank").collect()))
    every, few = concepts.earlier_neighbours(t, probes=None), concepts.earlier_neighbours(t, probes=None, most=5)
    place = dict((r[0], r[1]) for r in rows)
    assert all(place[r.id] < place[r.term] for r in few.collect()) and few.count() < every.count() / 2
    assert best(few) == best(every)


def test_recursive_chains_have_no_limit_of_rows(spark):
    rows = spark.createDataFrame([(str(k), str(k - 1) if k else None, f"n{k}") for k in range(130)], "id string, parent_unit_id string, name string")
    key = "spark.sql.cteRecursionRowLimit"
    spark.conf.set(key, "200")
    try:
        found = {r.id: r.depth for r in hierarchy.recursive_chains(rows).collect()}
        assert found == {str(k): k for k in range(130)} and spark.conf.get(key) == "200"
    finally:
        spark.conf.unset(key)


def test_digests_of_pages_are_short_and_say_what_pages_do(spark):
    unit = lambda name, content, up, section: {"name": name, "type": "Rule", "content": content, "parent_name": up, "section": section}
    made = [[], [unit("a", "x" * 5000, None, ["s"]), unit("b", "y" * 9000, "a", [])], [unit("c", None, "c", [""]), unit("a", "short", "", ["t", "u"])], [unit("d", "z", None, [""])]]
    rows = [("d", k, 9, [{f: u[f] for f in ("type", "name", "content", "parent_name", "section")} for u in units]) for k, units in enumerate(made)]
    frame = spark.createDataFrame(rows, pages.PAGE)
    state, done = {}, {}
    want = [pages.advance(state, k, 9, units, done) for k, units in enumerate(made)]
    assert [r.asDict() for r in pages.page_batch(frame).drop("document_id").orderBy("page").collect()] == want
    assert max(len(str(r)) for r in pages.page_digests(frame).collect()) < 400


def test_vectors_are_packed_without_loss(spark):
    import numpy as np

    rows = [[0.0] * 9 + [0.1], [0.5, -1.5] * 5, [0.0] * 10]
    sent = spark.createDataFrame([(v,) for v in rows], "vec array<double>").select(vector_index.packed("vec").alias("b")).collect()
    assert [list(v) for v in vector_index.unpacked([bytes(r.b) for r in sent])] == rows
    assert len(set(vector_index.list_groups(np.eye(6), np.array([5.0, 5, 5, 5, 5, 50]), 10))) == 4


def test_expanded_units_may_inherit_the_sub_queries_of_their_seeds(spark, small):
    lib, queries = fx.library(spark, small), fx.questions(spark, small).where("question_id = 1")
    plain = {r.id: r for r in retrieval.retrieve(lib, queries, 1).collect()}
    inherited = {r.id: r for r in retrieval.retrieve(lib, queries, 1, cfg=dataclasses.replace(DEFAULT, expansion_inherits_subquery=True)).collect()}
    more = [i for i, r in plain.items() if r.via]
    assert set(plain) == set(inherited) and more
    assert all(list(plain[i].source_sub_queries) == [] and plain[i].rerank_score is None for i in more)
    assert all(list(inherited[i].source_sub_queries) == [0] and inherited[i].rerank_score is not None for i in more)


def test_a_question_gets_the_same_answer_alone_and_among_others(spark, small):
    lib = fx.library(spark, small)
    vec = [list(fx.questions(spark, small).first().query_vec)]
    asked = ["that and this; zzzz", "hello", "list tion thre"]
    together = retrieval.run_queries(spark, asked, lib, lambda qs: vec * len(qs))
    for q, x in zip(asked, together, strict=True):
        alone = retrieval.run_query(spark, q, lib, lambda qs: vec * len(qs))
        assert (alone["answer"], alone["evidence"], alone["trail"]) == (x["answer"], x["evidence"], x["trail"])
    assert together[1]["iterations"] == 0 and len(together[2]["evidence"]) > 0


def test_scans_read_only_what_they_need(spark, small):
    from quillmere.plans import store_queries

    plan = store_queries.union_ranked(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in plan and "ReadSchema: struct<doc_id:bigint,n_chars:bigint>" in plan and "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan


def test_cascade_delete_leaves_nothing_behind(spark):
    t = {
        "units": spark.createDataFrame([("u1", "a"), ("u2", "b")], "id string, document_id string"),
        "concepts": spark.createDataFrame([("c1", "a"), ("c2", "b")], "id string, document_id string"),
        "concept_aliases": spark.createDataFrame([("c1",), ("c2",)], "concept_id string"),
        "concept_mentions": spark.createDataFrame([("c1", "u1"), ("c2", "u1"), ("c2", "u2")], "concept_id string, unit_id string"),
        "vectors": spark.createDataFrame([("u1",), ("c1",), ("u2",), ("c2",)], "id string"),
    }
    out = store.cascade_delete(t, "b")
    assert {k: sorted(map(tuple, v.collect())) for k, v in out.items()} == {
        "units": [("u1", "a")], "concepts": [("c1", "a")], "concept_aliases": [("c1",)], "concept_mentions": [("c1", "u1")], "vectors": [("c1",), ("u1",)],
    }


def test_units_of_any_length_are_embedded_whole(spark, duck, tmp_path):
    texts = ["short words", "a " * 9000 + "first", "a " * 9000 + "seventeen", "ж" * 5001, "?! " * 3000]
    spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    found = catalogue.queries()["embed_units"](spark, str(tmp_path)).toPandas()
    own = duck.cursor()
    own.execute(f"CREATE TEMP VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert rows_of(found) == rows_of(own.execute(catalogue.oracle_sql()["embed_units"]).df())
    v = {r.id: list(r.vec) for r in ingest.unit_vectors(fx.units(spark, str(tmp_path)), "book").where("index = 'content'").collect()}
    assert len(v) == 5 and len({tuple(x) for x in v.values()}) == 5  # also two texts that differ in their last word only
