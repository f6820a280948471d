"""Upserts, conditional inserts, cascaded deletes and stage resets over immutable tables.

Parquet has no row updates, so a table is an append-only log and its current state the latest row of each key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.schemas import STATUSES


def keep_latest(log: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The row of each key with the largest ``seq``, of several the one with the largest hash: one aggregation with map-side combine, no sort."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(seq, F.xxhash64(*rest))).alias("__row")).select(*keys, *(F.col(f"__row.{c}").alias(c) for c in rest))


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``changes`` replace those of the same key; columns in ``keep`` hold on to their first value."""
    cols = current.columns
    a, b = current.alias("a"), changes.alias("b")
    joined = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full_outer")
    new = F.col(f"b.{keys[0]}").isNotNull()
    out: list[Column] = []
    for c in cols:
        old, fresh = F.col(f"a.{c}"), F.col(f"b.{c}")
        out.append((F.coalesce(old, fresh) if c in keep or c in keys else F.when(new, fresh).otherwise(old)).alias(c))
    return joined.select(*out)


def insert_ignore(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return current.unionByName(new.dropDuplicates(keys).join(current.select(*keys), keys, "left_anti").select(*current.columns))


def partial_update(current: DataFrame, changes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Non-null fields of ``changes`` overwrite; derived columns are for the caller to refresh."""
    fresh = changes.select(key, *(F.col(f).alias(f"__{f}") for f in fields))
    return current.join(fresh, key, "left").select(*(F.coalesce(f"__{c}", c).alias(c) if c in fields else F.col(c) for c in current.columns))


def delete(current: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return current.join(gone.select(*keys).distinct(), keys, "left_anti")


def delete_vectors(vectors: DataFrame, gone: DataFrame, longest: int = 64) -> DataFrame:
    """``vectors`` without the ids of ``gone``; ids that no index can hold are passed over."""
    return vectors.join(gone.where(F.length("id") <= longest).select("id").distinct(), "id", "left_anti")


def cascade_delete(tables: dict[str, DataFrame], document_id: str) -> dict[str, DataFrame]:
    """All tables without a document: mentions, aliases, concepts, vectors, units, jobs, document; logs stay."""
    out = dict(tables)
    concepts = tables["concepts"].where(F.col("document_id") == document_id).select(F.col("id").alias("concept_id"))
    units = tables["units"].where(F.col("document_id") == document_id).select(F.col("id").alias("unit_id"))
    out["concept_mentions"] = delete(delete(tables["concept_mentions"], units, ["unit_id"]), concepts, ["concept_id"])
    out["concept_aliases"] = delete(tables["concept_aliases"], concepts, ["concept_id"])
    if "vectors" in tables:
        ids = concepts.select(F.col("concept_id").alias("id")).unionByName(units.select(F.col("unit_id").alias("id")))
        out["vectors"] = delete(tables["vectors"], ids, ["id"])
    for name in ("concepts", "units", "jobs"):
        if name in tables:
            out[name] = tables[name].where(~F.col("document_id").eqNullSafe(F.lit(document_id)))
    if "documents" in tables:
        out["documents"] = tables["documents"].where(F.col("id") != document_id)
    return out


#: stage: columns to null, statuses it applies to (none: all), status afterwards
RESETS: dict[str, tuple[list[str], list[str], str]] = {
    "summary": (["summary", "metadata", "metadata_terms_text", "aliases_text", "subject_embedding_id", "content_embedding_id"], [], STATUSES[0]),
    "metadata": (["metadata", "metadata_terms_text", "aliases_text", "subject_embedding_id", "content_embedding_id"], STATUSES[2:], STATUSES[1]),
    "embedding": (["subject_embedding_id", "content_embedding_id"], STATUSES[3:], STATUSES[2]),
    "concepts": ([], STATUSES[4:], STATUSES[3]),
}


def reset_stage(units: DataFrame, stage: str, pages: list[int] | None = None) -> DataFrame:
    """Units rewound to before ``stage``, for the given pages or all; ``vision`` drops the units."""
    within = F.col("page").isin(pages) if pages else F.lit(True)
    if stage == "vision":
        return units.where(~within)
    nulled, guard, status = RESETS[stage]
    hit = within & (F.col("status").isin(guard) if guard else F.lit(True))
    return units.withColumns({c: F.when(~hit, F.col(c)) for c in nulled if c in units.columns} | {"status": F.when(hit, F.lit(status)).otherwise(F.col("status"))})


def reset_concepts(concepts: DataFrame, aliases: DataFrame, mentions: DataFrame, units: DataFrame, pages: list[int] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Concept tables after a reset: empty for a whole document, else without the pages' mentions and the concepts they orphan."""
    if not pages:
        return concepts.limit(0), aliases.limit(0), mentions.limit(0)
    scope = units.where(F.col("page").isin(pages)).select(F.col("id").alias("unit_id"))
    left = mentions.join(scope, "unit_id", "left_anti")
    touched = mentions.join(scope, "unit_id", "left_semi").select("concept_id").distinct()
    orphans = touched.join(left, "concept_id", "left_anti")
    return delete(concepts, orphans.select(F.col("concept_id").alias("id")), ["id"]), delete(aliases, orphans, ["concept_id"]), left
