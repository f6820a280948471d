"""Evidence selection: order-sensitive rules over the few dozen candidates of a question.

The rules are greedy, so each question's candidates go through one function; questions run in parallel.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from quillmere.config import DEFAULT, Config

DIRECT = frozenset(["vector_subject", "vector_content", "lexical"])


@dataclass
class Candidate:
    id: str
    parent: str | None
    content_hash: str | None
    name: str | None
    score: float
    direct: bool
    sub_queries: frozenset[int]
    mentions: list[str] = field(default_factory=list)
    aliases: list[str] = field(default_factory=list)


def without_near_duplicates(pool: Iterable[Candidate]) -> list[Candidate]:
    """In score order: no content twice, no id twice, and no unit whose parent or child is kept already."""
    kept: list[Candidate] = []
    hashes, ids, parents = set(), set(), set()
    for c in pool:
        if c.id in ids or (c.content_hash and c.content_hash in hashes) or c.id in parents or c.parent in ids:
            continue
        kept.append(c)
        ids.add(c.id)
        hashes.add(c.content_hash)
        if c.parent:
            parents.add(c.parent)
    return kept


def cover_sub_queries(pool: list[Candidate], count: int) -> list[Candidate]:
    """The best unused candidate of each sub-query comes first, the rest follow in their order."""
    if count <= 1:
        return pool
    picked: list[Candidate] = []
    for k in range(count):
        found = next((c for c in pool if k in c.sub_queries and c not in picked), None)
        if found:
            picked.append(found)
    return picked + [c for c in pool if c not in picked]


def direct_first(pool: list[Candidate], delta: float) -> list[Candidate]:
    """One pass from the left: a direct hit moves ahead of a neighbour that is none if their scores are close."""
    out = list(pool)
    for k in range(len(out) - 1):
        a, b = out[k], out[k + 1]
        if b.direct and not a.direct and abs(a.score - b.score) <= delta:
            out[k], out[k + 1] = b, a
    return out


def complements(name: str, term: str) -> bool:
    return bool(name) and (name in term or term in name)


def with_complements(selected: list[Candidate], pool: list[Candidate]) -> list[Candidate]:
    """Candidates that a selected unit mentions by name or alias are appended; empty names match nothing."""
    out = list(selected)
    taken = {c.id for c in out}
    for c in selected:
        terms = [t.strip().lower() for t in c.mentions]
        for other in pool:
            names = [(other.name or "").strip().lower(), *(a.strip().lower() for a in other.aliases)]
            if other.id not in taken and any(complements(n, t) for n in names for t in terms):
                out.append(other)
                taken.add(other.id)
    return out


def select_evidence(pool: list[Candidate], sub_queries: int, is_list: bool, cfg: Config = DEFAULT) -> list[Candidate]:
    """All rules in order; a list question keeps everything in score order."""
    ordered = sorted(pool, key=lambda c: -c.score)  # stable, so ties keep their order
    if is_list:
        return ordered
    chosen = direct_first(cover_sub_queries(without_near_duplicates(ordered), sub_queries), cfg.comparable_delta)
    return with_complements(chosen, ordered)[: min(cfg.evidence_budget, cfg.evidence_hard_cap)]


def select_all(candidates: DataFrame, sub_queries: int, is_list: bool = False, cfg: Config = DEFAULT) -> DataFrame:
    """(query_id, position, id, score, direct) from candidates: query_id, id, parent_unit_id, content_hash, name,
    final_score, direct, source_sub_queries, mentions, aliases."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["final_score", "id"], ascending=[False, True])
        pool = [
            Candidate(r.id, r.parent_unit_id if isinstance(r.parent_unit_id, str) else None, r.content_hash, r.name_, r.final_score, bool(r.direct), frozenset(map(int, r.source_sub_queries)), list(r.mentions if r.mentions is not None else []), list(r.aliases if r.aliases is not None else []))
            for r in rows.rename(columns={"name": "name_"}).itertuples()
        ]
        chosen = select_evidence(pool, sub_queries, is_list, cfg)
        first = rows["query_id"].iloc[0]
        return pd.DataFrame({"query_id": [first] * len(chosen), "position": list(range(1, len(chosen) + 1)), "id": [c.id for c in chosen], "score": [c.score for c in chosen], "direct": [c.direct for c in chosen]})

    kind = candidates.schema["query_id"].dataType.simpleString()
    return candidates.groupBy("query_id").applyInPandas(run, f"query_id {kind}, position int, id string, score double, direct boolean")
