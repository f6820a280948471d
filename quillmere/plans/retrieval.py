"""Retrieval: hybrid search, fusion, expansion, re-ranking, scoring, evidence, and the loop around them.

Many questions are answered at once: every table is keyed by question_id, and a round of the loop is one plan for all
questions that are still open.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmere.config import DEFAULT, Config
from quillmere.functions import text as X
from quillmere.operators import concepts, evidence, hierarchy, search
from quillmere.operators.search import few
from quillmere.plans.provider import Offline as Models
from quillmere.session import store

Q = "question_id"
QUERIES = "question_id long, sub_query_index int, query string, query_vec array<float>"


@dataclass
class Library:
    """What ingestion leaves behind, as stored tables: units, their text index, two vector indexes, concept mentions, and jumps to ancestors if they are kept."""

    units: DataFrame
    index: search.TextIndex
    subjects: DataFrame
    contents: DataFrame
    mentions: DataFrame
    jumps: hierarchy.Jumps | None = None


def ranked_lists(lib: Library, queries: DataFrame, n_queries: int, seen: DataFrame | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """(question_id, sub_query_index, source, id, rank, score): the three ranked lists of all sub-queries in one table.

    ``seen`` (question_id, id): vector hits among known ids go before they are ranked, lexical ones after.
    ``queries``: question_id, sub_query_index, query, query_vec.
    """
    lists = []
    for name, vectors, k in (("vector_subject", lib.subjects, cfg.subject_top_k), ("vector_content", lib.contents, cfg.content_top_k)):
        hits = search.vector_top_k(vectors, queries, n_queries, k)
        if seen is not None:
            rank = F.row_number().over(Window.partitionBy(*search.KEY).orderBy(F.desc(F.round("score", 9)), "id"))
            hits = hits.join(seen, [Q, "id"], "left_anti").drop("rank").withColumn("rank", rank)
        lists.append(hits.select(*search.KEY, F.lit(name).alias("source"), "id", F.col("rank").cast("int").alias("rank"), "score"))
    words = search.bm25(lib.index, queries, n_queries, cfg.lexical_top_k, cfg)
    if seen is not None:
        words = words.join(seen, [Q, "id"], "left_anti")
    lists.append(words.select(*search.KEY, F.lit("lexical").alias("source"), "id", F.col("rank").cast("int").alias("rank"), "score"))
    return lists[0].unionByName(lists[1]).unionByName(lists[2])


def merge_sub_queries(fused: DataFrame) -> DataFrame:
    """(question_id, id, vector_score, source_sub_queries, provenance): one row per unit; the first sub-query's fused score stays."""
    return fused.groupBy(Q, "id").agg(
        F.min_by("fused", "sub_query_index").alias("vector_score"),
        F.array_sort(F.collect_set("sub_query_index")).alias("source_sub_queries"),
        F.array_sort(F.flatten(F.collect_list("provenance"))).alias("provenance"),
    )


def final_score(pool: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """``pool`` (rerank_score, source_sub_queries, provenance, n_sub_queries) with coverage, direct, diversity and final_score."""
    kinds = F.array_distinct(F.transform("provenance", lambda p: p["type"]))
    coverage = F.when(F.col("n_sub_queries") > 0, F.size("source_sub_queries") / F.col("n_sub_queries")).otherwise(0.0)
    direct = F.exists("provenance", lambda p: p["type"].isin(sorted(evidence.DIRECT)))
    scored = pool.withColumn("coverage", coverage).withColumn("direct", direct).withColumn("diversity", F.size(kinds) / cfg.source_types)
    total = cfg.weight_rerank * F.coalesce("rerank_score", F.lit(0.0)) + cfg.weight_coverage * F.col("coverage") + cfg.weight_direct * F.col("direct").cast("double") + cfg.weight_diversity * F.col("diversity")
    return scored.withColumn("final_score", total)


def passing(scored: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Of each question at most ``max_results`` rows at or above the threshold by final score; if none, the best few by rerank score."""
    rerank = F.coalesce("rerank_score", F.lit(0.0))
    every, by_rerank = Window.partitionBy(Q), Window.partitionBy(Q).orderBy(F.desc(F.round(rerank, 9)), "id")  # the pool of a question is capped
    ranked = scored.withColumn("passes", rerank >= cfg.rerank_threshold).withColumn("n_pass", F.sum(F.col("passes").cast("int")).over(every)).withColumn("by_rerank", F.row_number().over(by_rerank))
    kept = ranked.where((F.col("passes")) | ((F.col("n_pass") == 0) & (F.col("by_rerank") <= cfg.fallback_results)))
    place = F.row_number().over(Window.partitionBy(Q).orderBy(F.desc(F.round("final_score", 9)), "id"))
    return kept.withColumn("position", place).where(F.col("position") <= cfg.max_results).drop("passes", "n_pass", "by_rerank")


def source_of(kind: Column) -> Column:
    """A provenance entry of a unit that no search found."""
    return F.array(F.struct(kind.alias("type"), F.lit(None).cast("int").alias("rank"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("sub_query_index")))


def capped(pool: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The ``pool_cap`` first candidates of each question: seeds, by score, then the others."""
    place = F.row_number().over(Window.partitionBy(Q).orderBy(F.desc(F.col("role") == "seed"), F.desc(F.round(F.coalesce("vector_score", F.lit(0.0)), 9)), "id"))
    return pool.withColumn("__place", place).where(F.col("__place") <= cfg.pool_cap).drop("__place")


def retrieve(lib: Library, queries: DataFrame, n_queries: int, seen: DataFrame | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """Candidates of all questions, capped, re-ranked and scored: question_id, id, type, name, scores, source_sub_queries, provenance, role.

    Concept expansion comes first: units that share a concept with a seed join the seeds, and if there is any new one,
    every candidate that mentions a chosen concept gains its provenance. Then table types bring their neighbours.
    Expanded units have no sub-query, so they are not re-ranked, unless the configuration lets them inherit their seeds'.
    """
    fused = search.rrf(ranked_lists(lib, queries, n_queries, seen, cfg), cfg.rrf_k)
    n_sub = queries.groupBy(Q).agg(F.count("*").alias("n_sub_queries"))
    merged = store(merge_sub_queries(fused), "merged")
    n_seeds = merged.count()
    seeds = store(lib.units.select("id", "type", "parent_unit_id").join(few(merged, n_seeds), "id"), "seeds")
    ranked = seeds.select(Q, "id", F.row_number().over(Window.partitionBy(Q).orderBy(F.desc(F.round("vector_score", 9)), "id")).alias("rank"))
    chosen, shared = concepts.cooccurring(ranked, n_seeds, lib.mentions, cfg.concepts_expanded, cfg.units_per_concept)
    chosen = store(chosen, "chosen")
    if seen is not None:
        shared = shared.join(seen.withColumnRenamed("id", "unit_id"), [Q, "unit_id"], "left_anti")
    new = store(shared.groupBy(Q, F.col("unit_id").alias("id")).agg(F.collect_set("term").alias("terms")), "expanded")
    candidates = seeds.select(Q, "id").unionByName(new.select(Q, "id"))
    n_candidates = candidates.count()
    told = lib.mentions.select("unit_id", "term").distinct().join(few(candidates.withColumnRenamed("id", "unit_id"), n_candidates), "unit_id").join(few(chosen.select(Q, "term"), n_seeds), [Q, "term"])
    told = store(told.join(new.select(Q).distinct(), Q, "left_semi").select(Q, F.col("unit_id").alias("id")).distinct(), "told")
    around = hierarchy.expand(seeds, lib.units, (Q,), n_seeds).join(new.select(Q, "id"), [Q, "id"], "left_anti")
    if seen is not None:
        around = around.join(seen, [Q, "id"], "left_anti")

    subs = F.array().cast("array<int>")
    near, far = around.withColumn("subs", subs), new.withColumn("subs", subs)
    if cfg.expansion_inherits_subquery:
        held = seeds.select(Q, F.col("id").alias("seed"), "source_sub_queries")
        merged_subs = F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_sub_queries")))).alias("subs")
        by_seed = around.select(Q, "id", F.explode("from_seeds").alias("seed")).join(held, [Q, "seed"]).groupBy(Q, "id").agg(merged_subs)
        of_term = lib.mentions.select(F.col("unit_id").alias("seed"), "term").distinct().join(held, "seed").groupBy(Q, "term").agg(merged_subs).withColumnRenamed("subs", "source_sub_queries")
        by_term = new.select(Q, "id", F.explode("terms").alias("term")).join(of_term, [Q, "term"]).groupBy(Q, "id").agg(merged_subs)
        near, far = around.join(by_seed, [Q, "id"]), new.join(by_term, [Q, "id"])
    nothing, score = F.array().cast(seeds.schema["provenance"].dataType), F.lit(None).cast("double").alias("vector_score")
    pool = (
        seeds.select(Q, "id", "vector_score", "source_sub_queries", "provenance", F.lit("seed").alias("role"), F.lit(None).cast("string").alias("via"))
        .unionByName(far.select(Q, "id", score, F.col("subs").alias("source_sub_queries"), nothing.alias("provenance"), F.lit("seed").alias("role"), F.lit("concept_expansion").alias("via")))
        .unionByName(near.select(Q, "id", score, F.col("subs").alias("source_sub_queries"), source_of(F.col("role")).alias("provenance"), "role", F.lit("hierarchy_expansion").alias("via")))
    )
    best = store(capped(pool, cfg).join(told.withColumn("told", F.lit(True)), [Q, "id"], "left"), "pool")
    best = best.withColumn("provenance", F.when(F.col("told"), F.concat("provenance", source_of(F.lit("concept")))).otherwise(F.col("provenance"))).drop("told")
    n_best = best.count()
    full = lib.units.select("id", "type", "name", "parent_unit_id", "content_hash", "summary", "section", "content", "metadata").join(few(best, n_best), "id")
    document = X.tokens(X.rerank_document(F.col("section"), F.col("name"), F.col("summary"), X.aliases_text(F.col("metadata.aliases")), F.col("content")))
    asked = queries.select(Q, "sub_query_index", X.tokens(F.col("query")).alias("words"))
    each = full.select(Q, "id", document.alias("document"), "source_sub_queries").withColumn("sub_query_index", F.explode("source_sub_queries")).join(few(asked, n_queries), search.KEY)
    reranked = each.groupBy(Q, "id").agg(F.max(X.overlap_score(F.col("words"), F.col("document"))).alias("rerank_score"))
    return final_score(full.join(reranked, [Q, "id"], "left").join(few(n_sub, n_queries), Q), cfg)


def sufficiency(found: DataFrame, queries: DataFrame) -> DataFrame:
    """(question_id, sufficient, follow_ups): a question suffices if each of its sub-queries found something; the others are asked again."""
    met = found.select(Q, F.explode("source_sub_queries").alias("sub_query_index")).distinct().withColumn("met", F.lit(True))
    each = queries.select(*search.KEY, "query").join(met, search.KEY, "left")
    gaps = F.array_sort(F.collect_set(F.when(F.col("met").isNull(), F.col("query"))))
    return each.groupBy(Q).agg(gaps.alias("follow_ups")).withColumn("sufficient", F.size("follow_ups") == 0)


def answers(found: DataFrame) -> DataFrame:
    """(question_id, answer, citations): the offline answer to each question from its results in order, and the ids that it cites."""
    rows = F.array_sort(F.collect_list(F.struct("position", "id", F.substring("summary", 1, 80).alias("part"))))
    held = found.groupBy(Q).agg(rows.alias("rows"))
    ids = F.transform("rows", lambda r: r["id"])
    text = F.concat(F.lit("Based on "), F.array_join(ids, ", "), F.lit(": "), F.array_join(F.transform("rows", lambda r: r["part"]), " "))
    known = held.select(Q, text.alias("answer"), ids.alias("ids"))
    return known.select(Q, "answer", F.array_intersect(X.citations(F.col("answer")), "ids").alias("citations"))


def planned(asked: DataFrame) -> DataFrame:
    """``asked`` (question_id, question) with what routing and decomposing say: rag, language, entities, sub_queries, is_list, complex.

    The steps of the offline provider as columns, for any number of questions; a question without words needs no documents.
    """
    q = F.trim("question")
    parts = X.sub_queries(q)
    return asked.withColumns({
        "rag": X.needs_documents(F.col("question")) & (F.size(parts) > 0), "language": F.lit("en"), "entities": X.entities(q), "sub_queries": parts,
        "is_list": q.rlike(r"(?i)^\s*(list|all|which|name)\b"), "complex": F.size(parts) > 2,
    })


def grouped_evidence(found: DataFrame, queries: DataFrame, units: DataFrame) -> DataFrame:
    """(question_id, evidence): results by the sub-query that found them, as one text for a prompt; sub-queries without results are left out.

    A result of several sub-queries stands under each. Of a question there are at most ``max_results`` results; they are stored
    and counted, so that the units' texts are not shuffled to meet them.
    """
    found = store(found.select(Q, "id", "type", "section", "position", "source_sub_queries"), "found")
    n_found = found.count()
    text = units.select("id", "page", F.col("content").alias("whole"))
    each = text.join(few(found, n_found), "id").withColumn("sub_query_index", F.explode("source_sub_queries"))
    head = F.concat(F.lit("["), "id", F.lit("] ("), "type", F.lit(", "), X.section_path(F.col("section")), F.lit(", page "), F.col("page").cast("string"), F.lit(")\n"), "whole")
    rows = F.array_sort(F.collect_list(F.struct("position", head.alias("part"))))
    group = each.groupBy(*search.KEY).agg(F.array_join(F.transform(rows, lambda r: r["part"]), "\n\n").alias("part")).join(queries.select(*search.KEY, "query"), search.KEY)
    titled = F.concat(F.lit("--- Search "), (F.col("sub_query_index") + 1).cast("string"), F.lit(": "), "query", F.lit(" ---\n"), "part")
    parts = F.array_sort(F.collect_list(F.struct("sub_query_index", titled.alias("part"))))
    return group.groupBy(Q).agg(F.array_join(F.transform(parts, lambda r: r["part"]), "\n\n").alias("evidence"))


def projected(found: DataFrame, units: DataFrame) -> DataFrame:
    """Results as a caller sees them, without nulls in name and section."""
    page = units.select("id", "page")
    name, section = F.coalesce("name", F.lit("")), F.coalesce(X.section_path(F.col("section")), F.lit(""))
    rows = found.select(Q, "position", "id", "type", name.alias("name"), section.alias("section"), F.coalesce("rerank_score", F.lit(0.0)).alias("score"), F.size("source_sub_queries").cast("long").alias("n_sub_queries"), "role")
    rows = store(rows, "results")
    return page.join(few(rows, rows.count()), "id").select(*rows.columns, "page")


def merged_rounds(rounds: list[DataFrame]) -> DataFrame:
    """Candidates (question_id, id, rerank_score, sources) of several rounds as one: the best score, all sources."""
    every = rounds[0]
    for x in rounds[1:]:
        every = every.unionByName(x)
    return every.groupBy(Q, "id").agg(F.max("rerank_score").alias("rerank_score"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"))


def enriched(chosen: DataFrame, units: DataFrame, jumps: hierarchy.Jumps, n_chosen: int) -> DataFrame:
    """``chosen`` (query_id, id, rank; ``n_chosen`` rows) with the units' text, the names of all ancestors, and of those that are chosen too up to the first that is not.

    Ancestors are followed from the chosen units over stored jumps, so other units' chains are not read.
    """
    ids = chosen.select("id").distinct()
    chains = hierarchy.chains_of(ids, units, jumps, n_chosen).select("id", F.col("parents").alias("parent_chain"))
    among = store(units.select("id", "name", "parent_unit_id").join(few(chosen.select("query_id", "id"), n_chosen), "id"), "chosen")
    keyed = among.select(F.struct("query_id", "id").alias("id"), F.struct("query_id", F.col("parent_unit_id").alias("id")).alias("parent_unit_id"), "name")
    known = hierarchy.parent_chains(keyed).select("id.query_id", "id.id", F.col("parents").alias("known_chain"))
    text = units.select("id", "type", "section", "name", "summary", "content").join(few(chosen, n_chosen), "id")
    return text.join(chains, "id").join(known, ["query_id", "id"])


def evidence_context(evidence_: DataFrame) -> DataFrame:
    """(query_id, context): the evidence of a question as one text, in order: type, path, summary, content."""
    path = F.array_join(F.filter(F.array(X.section_path(F.col("section")), F.array_join("parent_chain", " > "), F.col("name")), lambda x: x != ""), " > ")
    part = F.concat(F.lit("["), "type", F.lit("] "), path, F.lit("\n"), F.coalesce("summary", F.lit("")), F.lit("\n"), "content")
    rows = F.array_sort(F.collect_list(F.struct("rank", part.alias("part"))))
    return evidence_.groupBy("query_id").agg(F.array_join(F.transform(rows, lambda r: r["part"]), "\n\n").alias("context"))


class Offline(Models):
    """The offline models, with the steps of a query as plans over all questions."""

    planned = staticmethod(planned)
    sufficient = staticmethod(sufficiency)
    answers = staticmethod(answers)
    nothing = "Nothing in the documents answers this question."


def run_queries(spark: SparkSession, questions: list[str], lib: Library | Callable[[], Library], embed, provider: Offline | None = None, cfg: Config = DEFAULT, max_iterations: int | None = None, is_list: bool | None = None) -> list[dict]:
    """Route, decompose, retrieve until the sub-queries are covered, select evidence, answer; for all ``questions`` together.

    ``lib`` is what ingestion stored, or opens it. ``embed`` maps a list of texts to vectors. A round is one plan for all questions that are still open; at most
    ``max_results`` results of each question and round come to the driver, and rounds are bounded by the configuration.
    """
    provider = provider or Offline()
    out: list[dict] = []
    open_: dict[int, list[str]] = {}
    asked_ = spark.createDataFrame(list(enumerate(questions)), "question_id long, question string")
    for r in sorted(provider.planned(asked_).collect(), key=lambda r: r[Q]):
        plan = {"sub_queries": list(r.sub_queries), "is_list": r.is_list, "complex": r.complex} if r.rag else None
        out.append({"question": r.question, "found": {}, "trail": [], "plan": plan, "answer": None if plan else provider.chat(r.question, r.language), "citations": [], "evidence": [], "iterations": 0})
        if plan:
            open_[r[Q]] = plan["sub_queries"]
    limit = {i: max_iterations or (cfg.max_iterations_complex if out[i]["plan"]["complex"] else cfg.max_iterations) for i in open_}
    k = 0
    if open_ and callable(lib):  # a batch of greetings opens nothing
        lib = lib()
    while open_:
        flat = [(i, s, q) for i, asked in open_.items() for s, q in enumerate(asked)]
        vectors = embed([q for _, _, q in flat])
        queries = spark.createDataFrame([(i, s, q, v) for (i, s, q), v in zip(flat, vectors, strict=True)], QUERIES)
        known = [(i, x) for i in open_ for x in out[i]["found"]]
        seen = spark.createDataFrame(known, "question_id long, id string") if known else None
        best = store(passing(retrieve(lib, queries, len(flat), seen, cfg), cfg).drop("content"), "round")
        n_best = dict.fromkeys(open_, 0)
        for r in (r.asDict(recursive=True) for r in best.collect()):
            n_best[r[Q]] += 1
            out[r[Q]]["found"].setdefault(r["id"], r | {"iteration": k})
        gaps = {r[Q]: list(r.follow_ups) for r in provider.sufficient(best, queries).collect()}
        left: dict[int, list[str]] = {}
        for i, asked in open_.items():
            follow = [] if k == limit[i] - 1 else gaps.get(i, [])
            out[i]["trail"].append({"iteration": k, "sub_queries": asked, "found": n_best[i], "follow_ups": follow})
            if follow:
                left[i] = follow[: cfg.max_sub_queries]
        open_, k = left, k + 1
    told = []
    for i, x in enumerate(out):
        if not x["plan"]:
            continue
        pool = [
            evidence.Candidate(r["id"], r["parent_unit_id"], r["content_hash"], r["name"], r["final_score"], r["direct"], frozenset(r["source_sub_queries"] if r["iteration"] == 0 else ()), r["metadata"]["mentions"], r["metadata"]["aliases"])
            for r in sorted(x["found"].values(), key=lambda r: (-r["final_score"], r["id"]))
        ]
        wants_all = x["plan"]["is_list"] if is_list is None else is_list
        chosen = evidence.select_evidence(pool, len(x["trail"][0]["sub_queries"]), wants_all, cfg)
        x.update(answer=provider.nothing, evidence=[c.id for c in chosen], iterations=len(x["trail"]))
        told += [(i, n, c.id, x["found"][c.id]["summary"] or "") for n, c in enumerate(chosen)]
    if told:
        for r in provider.answers(spark.createDataFrame(told, "question_id long, position int, id string, summary string")).collect():
            out[r[Q]].update(answer=r.answer, citations=list(r.citations))
    return out


def run_query(spark: SparkSession, question: str, lib: Library, embed, **options) -> dict:
    """:func:`run_queries` for one question."""
    return run_queries(spark, [question], lib, embed, **options)[0]
