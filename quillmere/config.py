"""Constants of ingestion and retrieval; one frozen record that callers replace fields of."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class Config:
    history_turns: int = 6
    max_iterations: int = 3
    max_iterations_complex: int = 5
    chunk_chars: int = 50
    subject_top_k: int = 15
    content_top_k: int = 15
    lexical_top_k: int = 15
    rrf_k: int = 60
    concepts_expanded: int = 5
    units_per_concept: int = 3
    pool_cap: int = 50
    weight_rerank: float = 0.70
    weight_coverage: float = 0.15
    weight_direct: float = 0.10
    weight_diversity: float = 0.05
    source_types: int = 6
    rerank_threshold: float = 0.4
    max_results: int = 12
    fallback_results: int = 3
    evidence_budget: int = 8
    evidence_hard_cap: int = 10
    comparable_delta: float = 0.05
    max_sub_queries: int = 5
    embed_budget_tokens: int | None = None  # for an embedding that takes no longer texts, as the reference's 6000; those of this package take any
    bytes_per_token: float = 2.5
    concept_threshold: float = 0.55
    concept_top_k: int = 5
    children_chars: int = 3000
    summary_chars: int = 240
    containers_carried: int = 4
    carry_pages: int = 20
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    bm25_least_idf: float = 1e-6
    expansion_inherits_subquery: bool = False
    citation_pattern: str = "[A-Z]+-[0-9a-f]{32}"


DEFAULT = Config()


def load_config(path: str) -> Config:
    """A JSON or simple YAML file of fields; leaves may be {value, description} records, whose description is dropped."""
    text = Path(path).read_text()
    data = json.loads(text) if path.endswith(".json") else _yaml(text)
    fields = {f.name for f in dataclasses.fields(Config)}
    flat = {k: v["value"] if isinstance(v, dict) and "value" in v else v for k, v in data.items()}
    return dataclasses.replace(DEFAULT, **{k: v for k, v in flat.items() if k in fields})


def _yaml(text: str) -> dict[str, Any]:
    """Nested maps of scalars, indented by spaces: the part of YAML that configuration files here use."""
    top: dict[str, Any] = {}
    stack: list[tuple[int, dict]] = [(-1, top)]
    for line in text.splitlines():
        body = line.split(" #")[0].rstrip()
        if not body.strip() or body.lstrip().startswith("#"):
            continue
        indent = len(body) - len(body.lstrip())
        key, _, value = body.strip().partition(":")
        while stack[-1][0] >= indent:
            stack.pop()
        if value.strip():
            try:
                stack[-1][1][key] = json.loads(value)
            except ValueError:
                stack[-1][1][key] = value.strip().strip("'\"")
        else:
            stack[-1][1][key] = {}
            stack.append((indent, stack[-1][1][key]))
    return top
