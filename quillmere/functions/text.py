"""Scalar functions as column expressions; only NFC and the counts behind vectors are Arrow UDFs."""

from __future__ import annotations

import unicodedata
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillmere.config import DEFAULT
from quillmere.schemas import TABLE_TYPES, UNIT_TYPES

NOT_WORD = r"[^\p{L}\p{N}]+"


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def normalize_term(term: Column, unicode: bool = True) -> Column:
    """Trimmed, in NFC, lower case, white space collapsed. Pure ASCII needs no UDF: pass ``unicode=False``."""
    trimmed = F.regexp_replace(F.trim(term), r"^\s+|\s+$", "")
    return F.regexp_replace(F.lower(nfc(trimmed) if unicode else trimmed), r"\s+", " ")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, repeats included."""
    return F.filter(F.split(F.lower(text), NOT_WORD, -1), lambda x: x != "")


def lexical_query(query: Column) -> Column:
    """A question without the characters that the text index reserves."""
    return F.trim(F.regexp_replace(query, "[\"'*:]", " "))


def section_path(section: Column) -> Column:
    return F.array_join(section, " > ")


def aliases_text(aliases: Column) -> Column:
    return F.array_join(aliases, ", ")


def metadata_terms(defines: Column, mentions: Column) -> Column:
    both = F.transform(F.concat(F.coalesce(defines, F.array()), F.coalesce(mentions, F.array())), lambda x: F.trim(x))
    return F.array_join(F.filter(both, lambda x: x != ""), " ")


def unit_path(section: Column, parents: Column, name: Column) -> Column:
    """Section, names of all parents and own name; blanks left out."""
    tree = F.filter(F.concat(parents, F.array(name)), lambda x: x.isNotNull() & (x != ""))
    whole = F.array(section_path(section), F.array_join(tree, " > "))
    return F.array_join(F.filter(whole, lambda x: x != ""), " > ")


def _line(label: str, value: Column) -> Column:
    return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"{label}: "), value))


def subject_document(document: Column, path: Column, name: Column, summary: Column, aliases: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("Document: "), document), _line("Path", path), _line("Name", name), _line("Summary", summary), _line("Aliases", aliases))


def token_estimate(text: Column, bytes_per_token: float = DEFAULT.bytes_per_token) -> Column:
    return F.ceil(F.octet_length(text) / F.lit(bytes_per_token)).cast("long")


def content_document(prefix: Column, content: Column, budget: int | None = DEFAULT.embed_budget_tokens, bytes_per_token: float = DEFAULT.bytes_per_token) -> Column:
    """The subject document and the whole content; over a ``budget``, if there is one, only the content is cut, by characters."""
    whole = F.concat(prefix, F.lit("\n\nContent:\n"), content)
    if budget is None:
        return whole
    left = F.lit(budget) - token_estimate(prefix, bytes_per_token) - 10
    cut = F.concat(prefix, F.lit("\n\nContent:\n"), F.substring(content, F.lit(1), F.floor(left * bytes_per_token).cast("int")))
    return F.when(token_estimate(whole, bytes_per_token) <= budget, whole).when(left <= 0, prefix).otherwise(cut)


def rerank_document(section: Column, name: Column, summary: Column, aliases: Column, content: Column) -> Column:
    head = F.concat_ws("\n", _line("Section", section_path(section)), _line("Name", name), _line("Summary", summary), _line("Aliases", aliases))
    return F.concat(head, F.lit("\n\nContent:\n"), content)


def concept_document(name: Column, aliases: Column, description: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("Name: "), name), _line("Aliases", aliases_text(aliases)), _line("Description", description))


def type_prefix(kind: Column) -> Column:
    return F.when(kind == "Image", "IMG").when(kind.isin(TABLE_TYPES), "TABLE").otherwise("RULE")


def unit_id(kind: Column, document: Column, page: Column, order: Column) -> Column:
    """The same unit gets the same id whenever its page is read again."""
    key = F.concat_ws(":", document, page.cast("string"), order.cast("string"))
    return F.concat(type_prefix(kind), F.lit("-"), F.substring(F.sha2(key, 256), 1, 32))


def valid_type(kind: Column) -> Column:
    return F.when(kind.isin(UNIT_TYPES), kind).otherwise("Rule")


def display_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def page_key(document: Column, page: Column) -> Column:
    return F.format_string("pages/%s/%d.png", document, page)


def bare_text(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def json_block(text: Column) -> Column:
    """The fenced block if there is one, else from the first to the last bracket, else the trimmed text."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    bare = F.regexp_extract(text, r"(?s)([\[{].*[\]}])", 1)
    return F.when(fenced != "", bare_text(fenced)).when(bare != "", bare).otherwise(bare_text(text))


def citations(answer: Column, pattern: str = DEFAULT.citation_pattern) -> Column:
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(pattern), F.lit(0)))


def clamp(x: Column, low: float = 0.0, high: float = 1.0, default: float = 0.3) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), F.coalesce(x, F.lit(default))))


def chunks(text: Column, size: int = DEFAULT.chunk_chars) -> Column:
    """Stretches of ``size`` characters; none for an empty text."""
    n = F.length(text)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n, F.lit(size)), lambda i: F.substring(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def backoff_ms(attempt: Column, base: int = 500, most: int = 30_000) -> Column:
    return F.least(F.lit(most).cast("double"), F.lit(base) * F.pow(F.lit(2), attempt)).cast("long")


def page_range(spec: Column) -> Column:
    """"1,3,5-10" to sorted distinct numbers; parts that are no page or range, or run backwards, are left out."""
    good = F.filter(F.transform(F.split(spec, ","), lambda p: F.trim(p)), lambda p: p.rlike(r"^[1-9][0-9]{0,8}(\s*-\s*[1-9][0-9]{0,8})?$"))
    low = lambda p: F.regexp_extract(p, r"^([0-9]+)", 1).cast("int")
    high = lambda p: F.regexp_extract(p, r"([0-9]+)$", 1).cast("int")
    spans = F.filter(good, lambda p: low(p) <= high(p))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(spans, lambda p: F.sequence(low(p), high(p))))))


def overlap_score(query_tokens: Column, doc_tokens: Column) -> Column:
    """Share of the distinct query tokens that the document has: the offline model's relevance score."""
    q = F.array_distinct(query_tokens)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, doc_tokens)) / F.size(q)).otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def hashed_vector(text: Column, dimensions: int = 64) -> Column:
    """The offline embedding: counts of words by their first and last letter and length, scaled to length one; null without words."""
    slot = lambda w: F.pmod(F.ascii(w) * 31 + F.ascii(F.substring(w, -1, 1)) * 7 + F.length(w), F.lit(dimensions))
    slots = F.transform(tokens(text), slot)
    return _slot_counts(dimensions)(slots)


def _slot_counts(dimensions: int):
    @F.pandas_udf("array<double>")
    def count(slots: pd.Series) -> pd.Series:
        def one(s):
            if s is None or not len(s):
                return None
            n = np.bincount(np.asarray(s, np.int64), minlength=dimensions).astype(np.float64)
            return n / np.sqrt((n * n).sum())

        return pd.Series([one(s) for s in slots], dtype=object)

    return count


def term_vector(term: Column, dimensions: int = 256) -> Column:
    """The embedding of a short term: counts of its runs of three characters (with marks at both ends) by hash, scaled to length one; null for an empty one."""
    marked = F.concat(F.lit("^"), F.lower(term), F.lit("$"))
    return F.when(F.length(term) > 0, _run_counts(dimensions)(marked))


def _run_counts(dimensions: int):
    @F.pandas_udf("array<double>")
    def count(marked: pd.Series) -> pd.Series:
        def one(t: str | None):
            if t is None:
                return None
            slots = [zlib.crc32(t[i : i + 3].encode()) % dimensions for i in range(max(1, len(t) - 2))]
            n = np.bincount(slots, minlength=dimensions).astype(np.float64)
            return n / np.sqrt((n * n).sum())

        return pd.Series([one(t) for t in marked], dtype=object)

    return count


def only_strings(json: Column) -> Column:
    """The strings among the elements of a JSON array; what is no array has none."""
    parts = F.from_json(json, "array<variant>")
    kept = F.filter(parts, lambda v: F.schema_of_variant(v) == "STRING")
    return F.coalesce(F.transform(kept, lambda v: F.variant_get(v, "$", "string")), F.array().cast("array<string>"))


def strict_true(value: Column) -> Column:
    """True only for the word true, as a JSON true gives it."""
    return F.coalesce(value == "true", F.lit(False))


def one_of(value: Column, allowed: list[str], default: str) -> Column:
    return F.when(value.isin(allowed), value).otherwise(default)


def json_repaired(text: Column) -> Column:
    """The JSON block of a text if it parses, else with trailing commas and unclosed ends mended, else null."""
    block = json_block(text)
    mended = F.regexp_replace(F.regexp_replace(block, r",\s*([}\]])", "$1"), r",\s*$", "")
    missing = F.repeat(F.lit("}"), F.greatest(F.lit(0), F.length(F.regexp_replace(mended, r"[^{]", "")) - F.length(F.regexp_replace(mended, r"[^}]", ""))))
    fixed = F.concat(mended, missing)
    return F.when(F.try_parse_json(block).isNotNull(), block).when(F.try_parse_json(fixed).isNotNull(), fixed)


def integer_or(text: Column, default: int) -> Column:
    """The leading digits of a text as a number, else ``default``."""
    return F.coalesce(F.regexp_extract(text, r"^\s*(-?[0-9]{1,9})", 1).try_cast("int"), F.lit(default))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.concat(F.format_number(100 * part / whole, 1), F.lit("%"))).otherwise("0.0%")


def html_escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def filled_template(template: str, values: dict[str, Column]) -> Column:
    """A template with each ${name} replaced."""
    out: Column = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("${" + name + "}"), value)
    return out


def retry_delay_ms(attempt: Column) -> Column:
    """Delay before a task tries again: a second, doubled each time."""
    return (F.lit(1000) * F.pow(F.lit(2), attempt)).cast("long")


def random_id(prefix: str) -> Column:
    return F.concat(F.lit(prefix + "-"), F.uuid())


def sub_queries(question: Column, most: int = DEFAULT.max_sub_queries) -> Column:
    """A question cut at its ends and conjunctions, at most ``most`` parts: the offline decomposition, for a table of questions."""
    parts = F.transform(F.split(question, r"[?;]|\band\b|\bor\b", -1), lambda p: F.trim(p))
    return F.slice(F.filter(parts, lambda p: p != ""), 1, most)


def needs_documents(question: Column) -> Column:
    """Whether a question is more than a greeting."""
    return ~F.lower(question).rlike(r"^\s*(hi|hello|thanks|thank you)[.!\s]*$")


def entities(question: Column, most: int = 5) -> Column:
    return F.slice(F.regexp_extract_all(question, F.lit(r"\b[A-Z][A-Za-z0-9_]+"), F.lit(0)), 1, most)
