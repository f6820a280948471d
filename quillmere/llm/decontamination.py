"""Benchmark decontamination by a positional inverted index, in DataFrame operations only.

Corpus frequencies of all benchmark terms tell which two terms of a window are its rarest. An index stores the
positions of those terms in the corpus. Postings of a window's rarest term, shifted by its offset, are intersected
with those of the second rarest, which leaves alignments of an item with a document; the other terms are then
matched along the alignments that remain, and runs of matches as long as a window are exact phrase matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmere.session import store

#: Separators before lower-casing; words are the same as those of the lower-cased text.
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_ROWS = 2_000_000  # keys of 12 bytes: below 100 MB as a hash table


def pieces(text: str) -> Column:
    """The words of a text, with an empty piece before or after them where the text starts or ends with a separator."""
    return F.split(F.coalesce(F.col(text), F.lit("")), SEPARATOR, -1)


def word_count(words: Column) -> Column:
    n = F.size(words)
    return (n - (F.get(words, 0 * n) == "").cast("int") - ((n > 1) & (F.get(words, n - 1) == "")).cast("int")).cast("long")


def folded(word: str) -> Column:
    """A word with A-Z lower-cased and nothing else."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows that agree in id and text share the key (k, k2), 96 bits, and so their result."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).select(
        "doc_id", "text", F.xxhash64("doc_id", "text").alias("k"), F.hash("text", "doc_id").alias("k2")
    )


def _postings(keyed: DataFrame) -> DataFrame:
    """(k, k2, pos, term) of each word."""
    return keyed.select("k", "k2", F.posexplode(pieces("text")).alias("pos", "word")).where("word <> ''").select("k", "k2", "pos", folded("word").alias("term"))


def item_words(items: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """(ik, item_id, o, term, n, w): the words of each distinct item; w is the length of its windows. A null id counts as ''."""
    named = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item_id"), F.col(text_col).alias("text")).distinct()
    words = pieces("text")
    lead = (F.get(words, F.lit(0)) == "").cast("int")
    return (
        named.select(F.xxhash64("item_id", "text").alias("ik"), "item_id", word_count(words).cast("int").alias("n"), lead.alias("lead"), F.posexplode(words).alias("p", "word"))
        .where("word <> ''")
        .select("ik", "item_id", (F.col("p") - F.col("lead")).alias("o"), folded("word").alias("term"), "n", F.least("n", F.lit(window)).alias("w"))
    )


def windowed(words: DataFrame) -> DataFrame:
    """``words`` once for each window that a word lies in, with the window's start s."""
    start = F.explode(F.sequence(F.greatest(F.lit(0), F.col("o") - F.col("w") + 1), F.least("o", F.col("n") - F.col("w"))))
    return words.withColumn("s", start)


def rarest_pairs(words: DataFrame, counts: DataFrame) -> DataFrame:
    """(ik, o1, t1, o2, t2): for each window its rarest term and the second rarest, with their offsets in the item.

    A window with a term that the corpus lacks cannot occur and is left out; a window of one word has no second term.
    """
    each = windowed(words.join(counts, "term")).select("ik", "o", "term", "w", "cf", "s")
    rank = F.row_number().over(Window.partitionBy("ik", "s").orderBy("cf", "o"))
    found = F.count("*").over(Window.partitionBy("ik", "s"))
    best = each.withColumn("found", found).withColumn("rank", rank).where("found = w AND rank <= 2")
    pick = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    return best.groupBy("ik", "s").agg(pick(1, "o").alias("o1"), pick(1, "term").alias("t1"), pick(2, "o").alias("o2"), pick(2, "term").alias("t2")).drop("s").distinct()


def decontaminate(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, items (sorted ids of items with a window in the document), and the key (k, k2).

    A word is hit if it lies in any occurrence of a window of ``window`` words of an item; a shorter item with words
    is one window. Null and empty texts have no words, on either side. Repeated rows all come back with equal
    results. Empty tables give no hits or no rows. Only the id and text columns are read.
    """
    keyed = _keyed(docs, id_col, text_col)
    words = store(item_words(items, item_col, item_text_col, window), "items")
    terms = words.select("term").distinct()
    counts = store(_postings(keyed).select("term").join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("cf")), "terms")
    pairs = store(rarest_pairs(words, counts), "pairs")
    wanted = pairs.select(F.col("t1").alias("term")).unionByName(pairs.where("t2 IS NOT NULL").select(F.col("t2").alias("term"))).distinct()
    index = store(_postings(keyed).join(wanted, "term", "left_semi"), "index")

    first = index.join(pairs, index["term"] == pairs["t1"]).select("k", "k2", "ik", (F.col("pos") - F.col("o1")).alias("at"), "o2", "t2")
    second = index.select("k", "k2", F.col("term").alias("t2"), F.col("pos").alias("pos2"))
    met = first.where("t2 IS NOT NULL").withColumn("pos2", F.col("at") + F.col("o2")).join(second, ["k", "k2", "t2", "pos2"], "left_semi")
    alignments = store(met.select("k", "k2", "ik", "at").unionByName(first.where("t2 IS NULL").select("k", "k2", "ik", "at")).distinct(), "aligned")

    holders = alignments.select("k", "k2").distinct()
    n_holders = holders.count()
    holders = F.broadcast(holders) if n_holders <= BROADCAST_ROWS else holders
    content = _postings(keyed.join(holders, ["k", "k2"], "left_semi"))
    needed = alignments.join(words.select("ik", "item_id", "o", "term", "w"), "ik").withColumn("pos", F.col("at") + F.col("o")).where("pos >= 0")
    matched = needed.join(content, ["k", "k2", "pos", "term"], "left_semi")
    run = F.col("o") - F.row_number().over(Window.partitionBy("k", "k2", "ik", "at").orderBy("o"))
    runs = (
        matched.withColumn("run", run)
        .groupBy("k", "k2", "ik", "item_id", "at", "run")
        .agg(F.min("pos").alias("low"), F.max("pos").alias("high"), F.max("w").alias("w"))
        .where("high - low + 1 >= w")
    )
    runs = store(runs.select("k", "k2", "item_id", "low", "high"), "runs")
    hits = runs.select("k", "k2", F.explode(F.sequence("low", "high")).alias("pos")).distinct().groupBy("k", "k2").agg(F.count("*").alias("n_hit"))
    found = runs.groupBy("k", "k2").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    counted = keyed.select("doc_id", word_count(pieces("text")).alias("n_words"), "k", "k2")
    return (
        counted.join(hits.join(found, ["k", "k2"]), ["k", "k2"], "left")
        .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), "k", "k2")
    )


def proximity(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, slack: int = 2) -> DataFrame:
    """(k, k2, item_id, at, n_near): alignments of an item in which some window has all but ``slack`` of its words in place, and the most that one has.

    Exact windows miss phrases that differ in a few words. Of the ``slack + 1`` rarest terms of such a window at least
    one is in place, so their postings give all alignments; positions of the item's other words are then intersected,
    and counted window by window. A window needs one word in place at least. Null and empty texts have no alignments.
    """
    keyed = _keyed(docs, id_col, text_col)
    words = store(item_words(items, item_col, item_text_col, window), "items")
    counts = store(_postings(keyed).select("term").join(words.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("cf")), "terms")
    each = windowed(words.join(counts, "term", "left")).withColumn("cf", F.coalesce("cf", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("ik", "s").orderBy("cf", "o"))
    anchors = store(each.withColumn("rank", rank).where((F.col("rank") <= slack + 1) & (F.col("cf") > 0)).select("ik", "o", "term").distinct(), "anchors")
    index = store(_postings(keyed).join(words.select("term").distinct(), "term", "left_semi"), "index")
    first = index.join(anchors, "term").select("k", "k2", "ik", (F.col("pos") - F.col("o")).alias("at")).distinct()
    met = first.join(words, "ik").withColumn("pos", F.col("at") + F.col("o")).join(index, ["k", "k2", "pos", "term"], "left_semi")
    near = windowed(met).groupBy("k", "k2", "item_id", "ik", "at", "s").agg(F.count("*").alias("n_near"), F.max("w").alias("w")).where(f"n_near >= greatest(1, w - {slack})")
    return near.groupBy("k", "k2", "item_id", "at").agg(F.max("n_near").alias("n_near"))
