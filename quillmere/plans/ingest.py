"""Ingestion: phases over units, each a status filter, a transformation and a merge; resets and cleanup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.config import DEFAULT, Config
from quillmere.functions import text as X
from quillmere.operators import embedding, hierarchy
from quillmere.plans.provider import Offline
from quillmere.schemas import STATUSES, TABLE_TYPES

#: phase: the status it consumes and the one it leaves
STEPS = {p: (STATUSES[k], STATUSES[k + 1]) for k, p in enumerate(["summary", "metadata", "embedding", "concepts"])}


def summary_inputs(units: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(id, parent_name, children): children's names in order, unless their contents are too long together."""
    parents = units.select(F.col("id").alias("parent_unit_id"), F.coalesce("name", F.lit("")).alias("parent_name"))
    named = F.struct("source_order", F.coalesce("name", F.lit("(unnamed)")).alias("name"))
    kids = units.where("parent_unit_id IS NOT NULL").groupBy(F.col("parent_unit_id").alias("id")).agg(F.sum(F.length("content")).alias("chars"), F.array_sort(F.collect_list(named)).alias("kids"))
    listed = kids.where(F.col("chars") <= cfg.children_chars).select("id", F.array_join(F.transform("kids", lambda x: x["name"]), ", ").alias("children"))
    found = units.select("id", "parent_unit_id").join(parents, "parent_unit_id", "left").join(listed, "id", "left")
    return found.select("id", F.coalesce("parent_name", F.lit("")).alias("parent_name"), F.coalesce("children", F.lit("")).alias("children"))


def text_columns(units: DataFrame) -> DataFrame:
    """(id, metadata_terms_text, section_path_text, aliases_text)."""
    return units.select("id", X.metadata_terms(F.col("metadata.defines"), F.col("metadata.mentions")).alias("metadata_terms_text"), X.section_path(F.col("section")).alias("section_path_text"), X.aliases_text(F.col("metadata.aliases")).alias("aliases_text"))


def run_phase(units: DataFrame, phase: str, pages: list[int] | None = None, provider: Offline | None = None) -> DataFrame:
    """All units in the phase's status (on the given pages) transformed and moved on; the others as they are."""
    provider = provider or Offline()
    before, after = STEPS[phase]
    due = (F.col("status") == before) & (F.col("page").isin(pages) if pages else F.lit(True))
    out = units
    if phase == "summary":
        out = out.withColumn("summary", F.when(due, provider.summarise(F.col("content"))).otherwise(F.col("summary")))
    if phase == "metadata":
        out = out.withColumn("metadata", F.when(due, provider.extract(F.col("content"))).otherwise(F.col("metadata")))
    if phase == "embedding":
        for c in ("subject_embedding_id", "content_embedding_id"):
            out = out.withColumn(c, F.when(due, F.col("id")).otherwise(F.col(c) if c in out.columns else F.lit(None).cast("string")))
    return out.withColumn("status", F.when(due, F.lit(after)).otherwise(F.col("status")))


def embedding_documents(units: DataFrame, document_name: str, cfg: Config = DEFAULT) -> DataFrame:
    """(id, subject, content): what the two embeddings are made of."""
    joined = units.join(hierarchy.parent_chains(units), "id")
    path = X.unit_path(F.col("section"), F.col("parents"), F.col("name"))
    subject = X.subject_document(F.lit(document_name), path, F.col("name"), F.col("summary"), X.aliases_text(F.col("metadata.aliases")))
    return joined.select("id", subject.alias("subject"), X.content_document(subject, F.col("content"), cfg.embed_budget_tokens, cfg.bytes_per_token).alias("content"))


def repair_table_types(units: DataFrame, scope: tuple[str, ...] = ("document_id", "page"), order: str = "source_order") -> DataFrame:
    """(id, type) with table types made consistent, one page at a time in unit order.

    First a header makes its children rows and a list makes its children items, reading types as they then are;
    then a row or item makes a parent of no table type a header or list. Units of a page are few, and their order matters.
    """
    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        place = {i: k for k, i in enumerate(rows["id"])}
        parents = [place.get(p) if isinstance(p, str) else None for p in rows["parent_unit_id"]]
        return pd.DataFrame({"id": list(rows["id"]), "type": repaired_types(known_types(rows["type"]), parents)})

    return units.select("id", "type", "parent_unit_id", order, *scope).groupBy(*scope).applyInPandas(run, "id string, type string")


def repaired_types(kinds: list[str], parents: list[int | None]) -> list[str]:
    """The types of one page's units, ``parents`` being places in the page: what holds for a unit's children, then for its parent."""
    kinds, below = list(kinds), {"DataTableHeader": "DataTableRow", "ColumnListTable": "ColumnListItem"}
    above = {v: k for k, v in below.items()}
    children: dict[int, list[int]] = {}
    for k, p in enumerate(parents):
        if p is not None:
            children.setdefault(p, []).append(k)
    for k in range(len(kinds)):
        if kinds[k] in below:
            for c in children.get(k, ()):
                kinds[c] = below[kinds[k]]
    for k, p in enumerate(parents):
        if p is not None and kinds[p] not in TABLE_TYPES and kinds[k] in above:
            kinds[p] = above[kinds[k]]
    return kinds


def known_types(kinds: list[str]) -> list[str]:
    from quillmere.schemas import UNIT_TYPES

    return [k if k in UNIT_TYPES else "Rule" for k in kinds]


def progress(units: DataFrame) -> DataFrame:
    """Units of each status, and how many are left for each phase."""
    return units.groupBy("document_id", "status").agg(F.count("*").alias("n"))


def edit_units(units: DataFrame, changes: DataFrame, fields: list[str]) -> DataFrame:
    """Units with non-null ``fields`` of ``changes`` (id, fields) put in, and what follows from them refreshed.

    Hash and text columns are computed again; the vectors of a changed unit are no longer its own, so their ids go.
    """
    from quillmere.operators import store

    changed = F.col("id").isNotNull() & F.col("__changed").isNotNull()
    out = store.partial_update(units, changes, "id", fields).join(changes.select("id").distinct().withColumn("__changed", F.lit(True)), "id", "left")
    m = F.col("metadata")
    out = out.withColumns({"content_hash": F.when(changed, F.sha2("content", 256)).otherwise(F.col("content_hash")), "metadata_terms_text": X.metadata_terms(m["defines"], m["mentions"]), "section_path_text": X.section_path(F.col("section")), "aliases_text": X.aliases_text(m["aliases"])})
    return out.withColumns({c: F.when(~changed, F.col(c)) for c in ("subject_embedding_id", "content_embedding_id") if c in units.columns}).drop("__changed")


def unit_vectors(units: DataFrame, document_name: str, embed=X.hashed_vector) -> DataFrame:
    """(index, id, vec): a subject and a content vector of each unit, left out where there is no text to embed."""
    docs = embedding_documents(units, document_name)
    both = docs.select(F.lit("subjects").alias("index"), "id", embed(F.col("subject")).alias("vec")).unionByName(docs.select(F.lit("content").alias("index"), "id", embed(F.col("content")).alias("vec")))
    return both.where("vec IS NOT NULL")


def learned_vectors(units: DataFrame, due: DataFrame, document_name: str, index) -> DataFrame:
    """(index, id, vec): :func:`unit_vectors` of the ``due`` units (id) by the embedding that the text ``index`` has learnt."""
    docs = embedding_documents(units, document_name).join(due, "id", "left_semi")
    both = docs.select(F.struct(F.lit("subjects").alias("index"), "id").alias("id"), F.col("subject").alias("text")).unionByName(docs.select(F.struct(F.lit("content").alias("index"), "id").alias("id"), F.col("content").alias("text")))
    return embedding.vectors(both, index.frequencies, index.n_units).select("id.index", "id.id", "vec")


def vector_metadata(units: DataFrame) -> DataFrame:
    """(id, meta): what a vector index keeps beside a unit's vector, as JSON."""
    return units.select("id", F.to_json(F.struct("id", "document_id", "type", "name", "page", X.section_path(F.col("section")).alias("section"), "parent_unit_id", "source_order", F.substring("summary", 1, 200).alias("summary"))).alias("meta"))


#: Elements that become units, and what may stand inside one.
BLOCK = r"<(?:h1|p|li)(?:\s[^>]*)?>[^<]*(?:</?(?:b|i|em|strong|a|br)(?:\s[^>]*)?>[^<]*)*"


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page, source_order, type, name, content) from ``pages`` (page, html): headings, paragraphs and list items as units.

    The offline stand-in for reading a page's picture; everything stays in the JVM. Null html has no units.
    """
    raw = pages.select("page", F.posexplode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(BLOCK), F.lit(0))).alias("k", "raw"))
    content = F.trim(F.regexp_replace(F.regexp_replace("raw", "<[^>]*>", ""), r"\s+", " "))
    kind = F.when(F.regexp_extract("raw", "^<([a-z0-9]+)", 1) == "li", "ColumnListItem").otherwise("Rule")
    held = raw.select("page", "k", kind.alias("type"), content.alias("content")).where("content <> ''")
    from pyspark.sql.window import Window

    order = (F.row_number().over(Window.partitionBy("page").orderBy("k")) - 1).cast("int")
    return held.select("page", order.alias("source_order"), "type", F.array_join(F.slice(F.split("content", " "), 1, 5), " ").alias("name"), "content")


def processed_pages(pages: DataFrame) -> DataFrame:
    """Unit rows of ``pages`` (document_id, page, html), with ids that stay the same when a page comes again; all are pending."""
    named = pages.select(F.struct("document_id", "page").alias("page"), "html")
    units = extract_pages(named).select("page.document_id", "page.page", "source_order", "type", "name", "content")
    return units.select(X.unit_id(F.col("type"), F.col("document_id"), F.col("page"), F.col("source_order")).alias("id"), "*", F.sha2("content", 256).alias("content_hash"), F.lit(STATUSES[0]).alias("status"))


def replaced_pages(units: DataFrame, fresh: DataFrame) -> DataFrame:
    """``units`` with all units of the pages in ``fresh`` replaced, so that a page that shrank leaves none behind."""
    pages = fresh.select("document_id", "page").distinct()
    return units.join(pages, ["document_id", "page"], "left_anti").select(*units.columns).unionByName(fresh.select(*units.columns))


def remaining(units: DataFrame) -> DataFrame:
    """For each document how many units each phase still has to do, and whether all are done."""
    due = [F.count_if(F.col("status") == before).alias(phase) for phase, (before, _) in STEPS.items()]
    return units.groupBy("document_id").agg(F.count("*").alias("total"), *due, F.bool_and(F.col("status") == STATUSES[-1]).alias("done"))
