"""The models behind the engine, as an interface with a deterministic offline default that SQL can check."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmere.config import DEFAULT
from quillmere.functions import text as X


class Provider(Protocol):
    """Models as column expressions; the steps of a query, which are plans, are in :mod:`quillmere.plans.retrieval`."""

    def score(self, query: Column, document: Column) -> Column: ...

    def summarise(self, content: Column) -> Column: ...

    def extract(self, content: Column) -> Column: ...

    def chat(self, question: str, language: str) -> str: ...


class Offline:
    """Token overlap for relevance, leading characters for summaries, word shapes for terms."""

    def score(self, query: Column, document: Column) -> Column:
        return X.overlap_score(X.tokens(query), X.tokens(document))

    def summarise(self, content: Column) -> Column:
        return F.substring(content, 1, DEFAULT.summary_chars)

    def extract(self, content: Column) -> Column:
        """Metadata: capitalised words of the beginning are defined, long words of the whole mentioned."""
        caps = F.filter(F.regexp_extract_all(F.substring(content, 1, DEFAULT.summary_chars), F.lit("[A-Z][a-z]+"), F.lit(0)), lambda t: F.length(t) >= 3)
        long = F.filter(F.regexp_extract_all(F.lower(content), F.lit("[a-z]+"), F.lit(0)), lambda t: F.length(t) >= 9)
        return F.struct(F.slice(F.array_distinct(caps), 1, 5).alias("defines"), F.slice(F.array_distinct(long), 1, 10).alias("mentions"), F.array().cast("array<string>").alias("aliases"))

    def chat(self, question: str, language: str) -> str:
        """An answer to a question that needs no documents; the same for all where no model is there."""
        return f"Hello. Ask me about the documents. ({language})"
