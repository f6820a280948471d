"""Concept resolution in batches: exact aliases first, then neighbours by vector and a validator, then new concepts.

The order in which terms first occur decides: a term can only join a concept that occurs earlier, so the result
does not depend on how the work is cut up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmere.config import DEFAULT, Config
from quillmere.functions import text as X
from quillmere.operators import vector_index
from quillmere.operators.search import few, top_k
from quillmere.operators.store import insert_ignore, upsert
from quillmere.session import discard, store


def raw_mentions(units: DataFrame) -> DataFrame:
    """(unit_id, page, source_order, pos, raw_term, mention_type): defined terms, then mentioned ones; at least two characters."""
    tag = lambda a, kind: F.transform(F.coalesce(F.col(f"metadata.{a}"), F.array()), lambda t: F.struct(F.trim(t).alias("raw_term"), F.lit(kind).alias("mention_type")))
    both = units.select(F.col("id").alias("unit_id"), "page", "source_order", F.posexplode(F.concat(tag("defines", "defines"), tag("mentions", "mentions"))).alias("pos", "m"))
    return both.select("unit_id", "page", "source_order", "pos", "m.raw_term", "m.mention_type").where("length(raw_term) >= 2")


def group_terms(mentions: DataFrame, unicode: bool = True) -> DataFrame:
    """One row per unit and normalised term: any defining mention makes it defining, the first raw form stays."""
    named = mentions.withColumn("term", X.normalize_term(F.col("raw_term"), unicode))
    return named.groupBy("unit_id", "term").agg(
        F.when(F.bool_or(F.col("mention_type") == "defines"), "defines").otherwise("mentions").alias("mention_type"),
        F.min_by("raw_term", "pos").alias("raw_term"),
        F.min(F.struct("page", "source_order", "pos")).alias("first"),
    )


def similar_text(a: Column, b: Column, least: float = 0.8) -> Column:
    """The offline validator: Levenshtein similarity of two normalised terms."""
    most = F.greatest(F.length(a), F.length(b), F.lit(1))
    return (1 - F.levenshtein(a, b) / most) >= least


def resolve(terms: DataFrame, aliases: DataFrame, vectors: DataFrame, cfg: Config = DEFAULT, known_vectors: DataFrame | None = None, probes: int | None = 0) -> DataFrame:
    """(term, concept_term, method, confidence) for each distinct term.

    ``terms``: term, first (a sortable place). ``aliases``: normalized_alias, concept_term. ``vectors``: term, vec.
    Known aliases resolve by join. Of the others, a term joins the best of its ``concept_top_k`` nearest earlier
    terms above the threshold that the validator accepts; else it founds a concept. Chains are followed to their end.
    ``known_vectors`` (term, vec): concepts of earlier batches, earlier than every term. Candidates come from
    inverted lists, ``probes`` of them for each term (0: as :func:`vector_index.nearest_earlier` chooses), and are compared exactly; None compares with all.
    """
    every = terms.groupBy("term").agg(F.min("first").alias("first"))
    known = every.join(aliases.groupBy(F.col("normalized_alias").alias("term")).agg(F.min("concept_term").alias("concept_term")), "term").select("term", "concept_term", F.lit("exact_alias").alias("method"), F.lit(1.0).alias("confidence"))
    open_ = store(every.join(known.select("term"), "term", "left_anti"), "terms")
    held = store(open_.join(vectors, "term"), "term-vectors")
    near = earlier_neighbours(held, known_vectors, probes, cfg.concept_threshold, cfg.concept_top_k)
    best = top_k(near, cfg.concept_top_k, key="term").where(similar_text(F.col("term"), F.col("id")))
    link = store(best.groupBy("term").agg(F.min_by("id", "rank").alias("up"), F.max_by("score", -F.col("rank")).alias("confidence")), "links")
    now = store(open_.join(link, "term", "left").select("term", F.col("up").alias("concept_term"), "up", "confidence"), "chains")
    edges = link.select(F.col("term").alias("e_term"), F.col("up").alias("e_up"))
    while now.where("up IS NOT NULL").limit(1).count():  # a term's concept is earlier than the term, so chains end
        step = now.join(edges, now["up"] == edges["e_term"], "left")
        after = store(step.select("term", F.coalesce("e_up", "concept_term").alias("concept_term"), F.col("e_up").alias("up"), "confidence"), "chains")
        discard(now)
        now = after
    fresh = now.select("term", F.coalesce("concept_term", "term").alias("concept_term"), F.when(F.col("concept_term").isNull(), "manual").otherwise("embedding").alias("method"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"))
    return known.unionByName(fresh)


def earlier_neighbours(terms: DataFrame, known: DataFrame | None = None, probes: int | None = 0, least: float = -2.0, most: int | None = None) -> DataFrame:
    """(term, id, score): each of ``terms`` (term, first, vec) with earlier ones, and with all of ``known`` (term, vec), that its lists or keys hold.

    ``probes`` None looks through all lists: the exact answer, for comparison. ``most``: as :func:`vector_index.nearest_earlier` says.
    """
    base = terms.where("first IS NOT NULL").select(F.col("term").alias("id"), F.col("first").alias("first2"), F.col("vec").alias("vec2"))
    if known is not None:  # before all others
        base = base.unionByName(known.select(F.col("term").alias("id"), F.lit(None).cast(terms.schema["first"].dataType).alias("first2"), F.col("vec").alias("vec2")))
    return vector_index.nearest_earlier(terms, base, probes, least, most)


def contexts(mentions: DataFrame, units: DataFrame, most: int = 3, chars: int = 500, total: int = 2000, with_units: bool = False) -> DataFrame:
    """(term, context): contents of the first units that define a term (or else mention it), joined and cut."""
    kind = F.when(F.col("mention_type") == "defines", 0).otherwise(1)
    met = mentions.join(units.select(F.col("id").alias("unit_id"), "page", "source_order", F.substring("content", 1, chars).alias("part")), "unit_id").withColumn("kind", kind)
    best = met.withColumn("least", F.min("kind").over(Window.partitionBy("term"))).where("kind = least")
    n = F.row_number().over(Window.partitionBy("term").orderBy("page", "source_order"))
    first = best.withColumn("n", n).where(F.col("n") <= most)
    sorted_ = F.array_sort(F.collect_list(F.struct("n", "part", "unit_id")))
    out = first.groupBy("term").agg(F.substring(F.array_join(F.transform(sorted_, lambda x: x["part"]), "\n---\n"), 1, total).alias("context"), F.transform(sorted_, lambda x: x["unit_id"]).alias("source_unit_ids"))
    return out if with_units else out.drop("source_unit_ids")


def cooccurring(seeds: DataFrame, n_seeds: int, mentions: DataFrame, concepts: int = DEFAULT.concepts_expanded, per_concept: int = DEFAULT.units_per_concept) -> tuple[DataFrame, DataFrame]:
    """(question_id, term, best) of the chosen concepts, and (question_id, term, unit_id) of the units that share one with a seed.

    ``seeds``: question_id, id, rank. The concepts of a question's best-ranked seeds come first, ``concepts`` of them; for
    each the first ``per_concept`` other units by id, the question's seeds left out. Of a concept only as many units are
    looked at as its seeds could hide, so that a concept that very many units mention costs no more than others.
    """
    s = few(seeds.select("question_id", F.col("id").alias("unit_id"), "rank"), n_seeds)
    held = mentions.select("unit_id", "term").distinct()
    by_rank = Window.partitionBy("question_id").orderBy("best", "term")
    chosen = held.join(s, "unit_id").groupBy("question_id", "term").agg(F.min("rank").alias("best")).withColumn("n", F.row_number().over(by_rank)).where(F.col("n") <= concepts).drop("n")
    most = seeds.groupBy("question_id").count().agg(F.max("count")).first()[0] or 0
    head = held.join(few(chosen.select("term").distinct(), n_seeds), "term", "left_semi")
    head = head.withColumn("n", F.row_number().over(Window.partitionBy("term").orderBy("unit_id"))).where(F.col("n") <= most + per_concept).drop("n")
    other = head.join(chosen.select("question_id", "term"), "term").join(s.select("question_id", "unit_id"), ["question_id", "unit_id"], "left_anti")
    n = F.row_number().over(Window.partitionBy("question_id", "term").orderBy("unit_id"))
    return chosen, other.withColumn("n", n).where(F.col("n") <= per_concept).select("question_id", "term", "unit_id")


def concept_id(term: Column) -> Column:
    return F.concat(F.lit("CONCEPT-"), F.substring(F.sha2(term, 256), 1, 32))


def tables(mentions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Concepts, aliases and mentions of a batch (unit_id, term, mention_type): a concept for each term, known by its own name."""
    named = mentions.select(concept_id(F.col("term")).alias("concept_id"), "unit_id", "term", "mention_type")
    concepts = named.select(F.col("concept_id").alias("id"), F.col("term").alias("canonical_name")).distinct()
    aliases = concepts.select(F.col("id").alias("concept_id"), F.col("canonical_name").alias("alias"), X.normalize_term(F.col("canonical_name"), unicode=False).alias("normalized_alias"), F.lit(0.8).alias("confidence"))
    rows = named.select("concept_id", "unit_id", F.col("term").alias("raw_term"), "mention_type", F.lit(1.0).alias("confidence"))
    return concepts, aliases, rows


def stored_batch(state: tuple[DataFrame, DataFrame, DataFrame], batch: tuple[DataFrame, DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Concept tables after a batch: concepts replaced or added, aliases added where they are new, mentions appended."""
    return upsert(state[0], batch[0], ["id"]), insert_ignore(state[1], batch[1], ["concept_id", "normalized_alias"]), state[2].unionByName(batch[2])


def by_alias(rows: DataFrame, raw: str, aliases: DataFrame, unicode: bool = False) -> DataFrame:
    """``rows`` with the concept that is known by the normalised text in ``raw``, the smallest id if there are several."""
    one = aliases.groupBy("normalized_alias").agg(F.min("concept_id").alias("concept_id"))
    return rows.withColumn("normalized_alias", X.normalize_term(F.col(raw), unicode)).join(one, "normalized_alias")


def overview(concepts: DataFrame, aliases: DataFrame, mentions: DataFrame) -> DataFrame:
    """Concepts with how many aliases and mentions they have, none included."""
    a = aliases.groupBy(F.col("concept_id").alias("id")).agg(F.count("*").alias("alias_count"))
    m = mentions.groupBy(F.col("concept_id").alias("id")).agg(F.count("*").alias("mention_count"))
    return concepts.join(a, "id", "left").join(m, "id", "left").fillna(0, ["alias_count", "mention_count"])


def described(mentions: DataFrame, units: DataFrame, describe=lambda context: F.substring(context, 1, 240)) -> DataFrame:
    """(term, description, source_unit_ids): ``describe`` turns the context of a concept's first units into its description."""
    ctx = contexts(mentions, units, with_units=True)
    return ctx.select("term", describe(F.col("context")).alias("description"), "source_unit_ids")


def affected(mentions: DataFrame, units: DataFrame, pages: list[int]) -> DataFrame:
    """New descriptions of the concepts that the given pages mention, from all other pages; those left without a unit have none."""
    on = mentions.join(units.select(F.col("id").alias("unit_id"), "page"), "unit_id")
    touched = on.where(F.col("page").isin(pages)).select("term").distinct()
    left = on.where(~F.col("page").isin(pages)).drop("page").join(touched, "term", "left_semi")
    return described(left, units)
