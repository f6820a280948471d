"""Personal data: fixed patterns, and information-theoretic sanitisation of terms that reveal what they stand by.

Patterns find e-mail addresses, IP addresses, card and phone numbers: the protected entities. Over the whole corpus,
a term that stands next to an entity in several different texts is weighed by how much it tells: the share of the
texts with the term that hold the entity anywhere, and the bits it adds over the entity's own frequency. Terms above
both thresholds disclose the entity even where it is removed, so each of their occurrences is generalised too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.session import store

KINDS = ["email", "ip", "card", "phone"]
#: Fixed patterns. Guards and possessive quantifiers only keep the search linear: what matches is the same as without.
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
LETTERS = r"[^\p{L}]+"
BROADCAST_ROWS = 200_000


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check of card numbers."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


CHECKS: dict[str, Callable[[Column], Column]] = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"),
    "card": lambda v: F.length(digits_of(v)).between(16, 19) & luhn(digits_of(v)),
    "phone": lambda v: F.length(digits_of(v)).between(8, 15),
}
#: Cheap tests that every text with a span of the kind passes.
SCREENS: dict[str, Callable[[Column], Column]] = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; named within a lambda as it stands, it would be computed for each element."""
    return F.transform(F.array(value), body)[0]


#: Matches that are counted up together: a step copies what its block has so far, so that blocks keep the work linear.
MATCHES = 128


def located(text: Column, pattern: Column, kind: str) -> Column:
    """All leftmost non-overlapping matches as spans, positions in code points: pieces between matches give the offsets."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    pairs = F.arrays_zip(found.alias("value"), F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("left"))
    length = lambda x: F.length(x["left"]) + F.length(x["value"])

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["left"])
        end = start + F.length(x["value"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("out"))

    def block(z: Column, base: Column, k: Column) -> Column:
        first = F.struct(F.aggregate(F.slice(base, F.lit(1), k), F.lit(0), lambda n, x: n + x).alias("at"), F.array().cast(SPAN).alias("out"))
        return F.aggregate(F.slice(z, k * MATCHES + 1, F.lit(MATCHES)), first, step)["out"]

    def spans(z: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(z) - 1) / MATCHES).cast("int"))
        totals = F.transform(blocks, lambda k: F.aggregate(F.slice(z, k * MATCHES + 1, F.lit(MATCHES)), F.lit(0), lambda n, x: n + length(x)))
        return bound(totals, lambda base: F.flatten(F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / MATCHES).cast("int")), lambda k: block(z, base, k))))

    return bound(pairs, lambda z: F.when(F.size(z) > 0, spans(z)))


def base_spans(text: str) -> Column:
    """The spans of the fixed patterns, by kind in the order of KINDS and then by start."""
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast(SPAN)

    def of(kind: str) -> Column:
        spans = F.coalesce(located(t, F.lit(PATTERNS[kind]), kind), none)
        return F.when(SCREENS[kind](t), F.filter(spans, lambda s: CHECKS[kind](s["value"]))).otherwise(none)

    return F.concat(*(of(k) for k in KINDS))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def mentions_of(text: str, near: int) -> Column:
    """(entity, terms) of each base span: ``near`` words on either side are its context, up to the next match of the same kind.

    Whole words count, whatever their number of characters; words are runs of two letters or more in lower case.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    filled = lambda a: F.filter(F.split(F.lower(a), LETTERS, -1), lambda x: F.length(x) >= 2)

    def of(kind: str) -> Column:
        pattern = F.lit(PATTERNS[kind])
        values, between = F.regexp_extract_all(t, pattern, F.lit(0)), F.split(t, pattern, -1)
        sides = F.arrays_zip(values.alias("value"), F.slice(between, F.lit(1), F.size(values)).alias("left"), F.slice(between, F.lit(2), F.size(values)).alias("right"))

        def mention(s: Column) -> Column:
            left, right = filled(s["left"]), filled(s["right"])
            context = F.concat(F.slice(left, F.greatest(F.lit(1), F.size(left) - near + 1), F.lit(near)), F.slice(right, 1, near))
            name = digits_of(s["value"]) if kind in ("card", "phone") else F.lower(s["value"])
            return F.struct(F.concat_ws(":", F.lit(kind), name).alias("entity"), F.array_distinct(context).alias("terms"))

        found = F.transform(F.filter(sides, lambda s: CHECKS[kind](s["value"])), mention)
        return F.when(SCREENS[kind](t) & (F.size(values) > 0), found).otherwise(F.array().cast("array<struct<entity:string,terms:array<string>>>"))

    return F.concat(*(of(k) for k in KINDS))


def words_of(keyed: DataFrame) -> DataFrame:
    """(k, k2, term) of each word of each text, repeats included."""
    return keyed.select("k", "k2", F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), LETTERS, -1)).alias("term"))


def disclosing_terms(keyed: DataFrame, support: int, share: float, bits: float, near: int) -> DataFrame:
    """(term): terms that reveal an entity. ``keyed``: text and its key (k, k2).

    Different texts count, so copies are no evidence. A term is weighed if it stands beside the entity in ``support``
    texts; the texts that hold both anywhere must then be at least ``share`` of all texts with the term, and the term
    must raise the entity's probability by ``bits`` bits.
    """
    each = keyed.select("k", "k2", F.explode(mentions_of("text", near)).alias("m"))
    mentions = store(each.select("k", "k2", "m.entity", "m.terms"), "mentions")
    held = mentions.select("entity", "k", "k2").distinct()
    of_entity = held.groupBy("entity").agg(F.count("*").alias("c_e"))
    beside = mentions.select("entity", "k", "k2", F.explode("terms").alias("term")).distinct().groupBy("entity", "term").agg(F.count("*").alias("near")).where(F.col("near") >= support)
    # a term is in at least as many texts as it is near mentions in, whosesoever; common words go here, before texts are searched for them
    at_least = mentions.select("k", "k2", F.explode("terms").alias("term")).distinct().groupBy("term").agg(F.count("*").alias("least_t"))
    beside = store(beside.join(of_entity, "entity").join(at_least, "term").where(share * F.col("least_t") <= F.col("c_e")).select("entity", "term", "c_e"), "beside")
    terms = beside.select("term").distinct()
    hashes = terms.agg(F.count("*").alias("n"), F.count_distinct(F.hash("term")).alias("different")).first()
    number = F.hash("term") if hashes.n == hashes.different else F.xxhash64("term")  # four bytes for a term where they tell all apart
    terms = terms.select("term", number.alias("t"))
    # a row for each different text with the candidates in it: small beside the text, however many candidates there come to be
    met = words_of(keyed).join(F.broadcast(terms) if hashes.n <= BROADCAST_ROWS else terms, "term")
    texts = store(met.groupBy("k", "k2").agg(F.collect_set("t").alias("ts")), "texts")
    of_term = texts.select(F.explode("ts").alias("t")).groupBy("t").agg(F.count("*").alias("c_t")).join(terms, "t").select("term", "c_t")
    asked = held.join(beside.select("entity", "term"), "entity").withColumn("t", number)
    both = asked.join(texts, ["k", "k2"]).where(F.array_contains("ts", F.col("t"))).groupBy("entity", "term").agg(F.count("*").alias("c_te"))
    total = keyed.select("k", "k2").distinct().agg(F.count("*").alias("n"))
    told = F.log2(F.col("c_te") * F.col("n") / (F.col("c_t") * F.col("c_e")))
    weighed = beside.join(both, ["entity", "term"]).join(of_term, "term").join(F.broadcast(total))  # one row
    return weighed.where((F.col("c_te") >= share * F.col("c_t")) & (told >= bits)).select("term").distinct()


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = 3, share: float = 0.8, bits: float = 5.0, near: int = 3) -> DataFrame:
    """All rows of ``docs`` with their columns and ``pii_spans``: spans (kind, start, end, value), base kinds first, then kind term.

    Base spans stay whatever the method adds; a term inside a base span is no span of its own. Null and empty texts
    have no spans. Repeated rows all come back. An empty table gives an empty table. Columns that clash with
    ``pii_spans`` or with names that start with __pii are replaced.
    """
    keyed = docs.select(F.col(text_col).alias("text")).select("text", F.xxhash64("text").alias("k"), F.hash("text").alias("k2"))
    found = store(disclosing_terms(keyed, support, share, bits, near), "disclosing")
    by_text = words_of(keyed).join(F.broadcast(found) if found.count() <= BROADCAST_ROWS else found, "term", "left_semi").distinct().groupBy("k", "k2").agg(F.array_join(F.array_sort(F.collect_set("term")), "|").alias("__pii_terms"))
    by_text = store(by_text, "termed")
    n = by_text.count()
    by_text = by_text.select(F.col("k").alias("__pii_k"), F.col("k2").alias("__pii_k2"), "__pii_terms")
    rows = docs.drop("pii_spans", "__pii_k", "__pii_k2", "__pii_terms").withColumns({"__pii_k": F.xxhash64(text_col), "__pii_k2": F.hash(text_col)})
    rows = rows.join(F.broadcast(by_text) if n <= BROADCAST_ROWS else by_text, ["__pii_k", "__pii_k2"], "left") if n else rows.withColumn("__pii_terms", F.lit(None).cast("string"))
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.col("__pii_terms"), F.lit(r")(?!\p{L})"))
    rows = rows.withColumn("pii_spans", base_spans(text_col))
    outside = lambda s: ~F.exists("pii_spans", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    more = F.filter(located(F.col(text_col), pattern, "term"), outside)
    all_spans = F.when(F.col("__pii_terms").isNotNull(), F.concat("pii_spans", F.coalesce(more, F.array().cast(SPAN)))).otherwise(F.col("pii_spans"))
    return rows.withColumn("pii_spans", all_spans).drop("__pii_k", "__pii_k2", "__pii_terms")


def sanitised(text: str, spans: str) -> Column:
    """The text with each span replaced by its kind in square brackets; spans that overlap become one, named after the first."""
    kind_rank = F.array(*(F.lit(k) for k in [*KINDS, "term"]))
    order = F.array_sort(F.transform(F.col(spans), lambda s: F.struct(s["start"].alias("start"), F.array_position(kind_rank, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]
        added = F.concat(acc["out"], F.array(F.concat(F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(added).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(order, first, step)
    tail = F.substring(F.col(text), done["at"] + 1, F.length(text))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(done["out"], ""), tail)).otherwise(F.col(text))
