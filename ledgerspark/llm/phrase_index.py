"""Find test passages in training text with a positional inverted index.

The index holds postings ``(term, document, position)``.  A window of consecutive item words is
looked up from its rarest terms: the postings of the rarest, shifted by its place in the item, give
the places where the item could lie in a document; they are intersected with the offset-adjusted
postings of the second rarest, and what is left with those of all other terms of the item.  Runs
of confirmed terms that are as long as a window are exact matches.

Only postings of test terms are ever looked up, so only those are indexed, in two parts: those of
the rarest terms for all documents (stored), and those of the other terms for the documents that
have a place left.  Everything is DataFrame expressions.

Words are lower-cased runs of ASCII letters and digits and of non-ASCII characters.  Defined
cases: a null text has no words; a null document id is an id like others; rows that repeat an id
are judged each by its own text; an item without words is never found; an item without an id marks
words but is not counted; items that share an id count once; empty tables give empty results.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import small, staged

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# a word before letters are lower-cased
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
# a document is its id and a hash of its text, so that rows repeating an id stay apart
KEY = ["doc_id", "tag"]


def lowered(term: Column) -> Column:
    """A-Z in lower case, other letters as they are; most terms need no change."""
    ascii_lower = F.translate(term, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.lower(term) != term, ascii_lower).otherwise(term)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, tag, text)``."""
    return docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("tag"), F.col(text_col).cast("string").alias("text")
    )


def tokens(docs: DataFrame) -> DataFrame:
    """``(doc_id, tag, pos, term)``: every word of every document.

    Positions count from a document's first separator or word, whichever comes first; only their
    differences matter.
    """
    split = docs.select(*KEY, F.posexplode(F.split("text", SEPARATORS, -1)).alias("pos", "_w"))
    return split.select(*KEY, "pos", lowered(F.col("_w")).alias("term"))


def item_texts(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item_id, body, terms)``: the words of each item that has any; ``body`` is 60 bits of their digest."""
    lower = F.translate(F.col(text_col).cast("string"), string.ascii_uppercase, string.ascii_lowercase)
    terms = F.array_remove(F.split(lower, SEPARATORS, -1), "")
    rows = items.select(F.col(id_col).alias("item_id"), terms.alias("terms")).where(F.size("terms") > 0)
    digest = F.sha2(F.array_join("terms", " ").cast("binary"), 256)
    return rows.select("item_id", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("body"), "terms")


def body_terms(texts: DataFrame) -> DataFrame:
    """``(body, n_terms, off, term)`` of the distinct item texts."""
    bodies = texts.select("body", "terms").dropDuplicates(["body"])
    return bodies.select(
        F.col("body"), F.size("terms").alias("n_terms"), F.posexplode("terms").alias("off", "term")
    )


def rarest_terms(docs: DataFrame, terms: DataFrame, window: int) -> DataFrame:
    """``(body, n_terms, off, term, off2, term2)``: the two rarest terms of each window.

    Windows with a term that never occurs are left out.  Frequencies are counted over all
    documents.  A window is ``window`` words; a shorter item is one window, and a window of one
    word names it twice.
    """
    vocabulary = small(terms.select("term").distinct())
    counts = tokens(docs).join(vocabulary, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    size = F.least(F.col("n_terms"), F.lit(window))
    starts = F.sequence(F.greatest(F.lit(0), F.col("off") - size + 1), F.least(F.col("off"), F.col("n_terms") - size))
    known = terms.join(counts, "term", "left").withColumn("start", F.explode(starts))
    # the terms of one window: at most its size, so these lists are short
    ranked = F.sort_array(F.collect_list(F.struct("n", "off", "term")))
    return (
        known.groupBy("body", "n_terms", "start")
        .agg(ranked.alias("r"), F.min(F.col("n").isNotNull()).alias("all"))
        .where("all")
        .select("body", "n_terms", F.col("r")[0].alias("a"), F.coalesce(F.get("r", F.lit(1)), F.col("r")[0]).alias("b"))
        .select("body", "n_terms", "a.off", "a.term", F.col("b.off").alias("off2"), F.col("b.term").alias("term2"))
        .distinct()
    )


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``(term, doc_id, tag, pos)`` of the given terms in all documents."""
    return tokens(docs).join(small(terms.select("term").distinct()), "term").select("term", *KEY, "pos")


def phrase_matches(docs: DataFrame, terms: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, tag, body, start, n)``: the longest runs of item words in ``keyed`` documents.

    A run starts at word ``start`` and has at least ``window`` words or is the whole of a shorter
    item; ``terms`` comes from ``body_terms``.
    """
    probes = staged(rarest_terms(docs, terms, window))
    probe_terms = probes.select("term").union(probes.select("term2"))
    rare = staged(postings(docs, probe_terms))
    first = rare.join(small(probes), "term").select(
        F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), "body", F.col("term2").alias("_term"),
        (F.col("pos") - F.col("off")).alias("place"), (F.col("pos") + F.col("off2") - F.col("off")).alias("_pos"),
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag"))
    met = (F.col("term") == F.col("_term")) & (F.col("pos") == F.col("_pos"))
    places = staged(first.join(rare, same & met).select(*KEY, "body", "place").distinct())
    left = places.select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag")).distinct()
    lists = postings(docs.join(small(left), same, "left_semi"), terms)
    wanted = places.join(small(terms), "body").select(
        F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), "body", "place", "n_terms", "off",
        F.col("term").alias("_term"), (F.col("place") + F.col("off")).alias("_pos"),
    )
    found = (
        wanted.join(lists, same & met)
        .groupBy(*KEY, "body", "place", "n_terms")
        .agg(F.sort_array(F.collect_set("off")).alias("offs"))
        .where(F.size("offs") >= F.least("n_terms", F.lit(window)))
        .select(*KEY, "body", "place", "n_terms", F.posexplode("offs").alias("i", "off"))
    )
    return (
        found.groupBy(*KEY, "body", "place", "n_terms", (F.col("off") - F.col("i")).alias("run"))
        .agg(F.min("off").alias("first"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= F.least("n_terms", F.lit(window)))
        .select(*KEY, "body", (F.col("place") + F.col("first")).alias("start"), "n")
    )


def proximity_matches(docs: DataFrame, terms: DataFrame, slop: int) -> DataFrame:
    """``(doc_id, tag, body, pos)``: places of an item's rarest term that have every other term
    of the item, in any order, at most ``n_terms - 1 + slop`` words away."""
    probes = staged(rarest_terms(docs, terms, 1 << 30))
    places = staged(postings(docs, probes).join(small(probes), "term").select(*KEY, "body", "n_terms", "pos").distinct())
    wanted = places.join(small(terms.select("body", "term").distinct()), "body").select(
        F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), "body", "n_terms",
        F.col("term").alias("_term"), F.col("pos").alias("_at"),
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag"))
    near = F.abs(F.col("pos") - F.col("_at")) <= F.col("n_terms") - 1 + slop
    distinct = terms.groupBy("body").agg(F.count_distinct("term").alias("n_distinct"))
    left = places.select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag")).distinct()
    lists = postings(docs.join(small(left), same, "left_semi"), terms)
    return (
        wanted.join(lists, same & (F.col("term") == F.col("_term")) & near)
        .groupBy(*KEY, "body", F.col("_at").alias("pos"))
        .agg(F.count_distinct("term").alias("found"))
        .join(small(distinct), "body")
        .where("found = n_distinct")
        .select(*KEY, "body", "pos")
    )


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: ``doc_id, tag, n_words, n_hit, n_items, items_sha256, contaminated``.

    ``n_hit`` counts the words inside any place of any of the items' windows; ``items_sha256`` is
    over the ids of the items found, sorted as strings and joined by commas.
    """
    docs, texts = keyed(docs), staged(item_texts(items))
    matches = staged(phrase_matches(docs, staged(body_terms(texts)), window))
    covered = matches.select(
        *KEY, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("pos")
    )
    hit = covered.groupBy(*KEY).agg(F.count_distinct("pos").alias("n_hit"))
    found = (
        matches.select(*KEY, "body").distinct()
        .join(small(texts.select("item_id", "body")), "body")
        .where(F.col("item_id").isNotNull())
        .select(*KEY, F.col("item_id").cast("string").alias("item")).distinct()
        .groupBy(*KEY)
        .agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.sort_array(F.collect_list("item")), ",").alias("items"))
    )
    of = lambda df, a: df.withColumnsRenamed({"doc_id": f"{a}_id", "tag": f"{a}_tag"})
    met = lambda a: F.col("doc_id").eqNullSafe(F.col(f"{a}_id")) & (F.col("tag") == F.col(f"{a}_tag"))
    counted = docs.select(*KEY, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"))
    rows = counted.join(of(hit, "h"), met("h"), "left").join(of(found, "f"), met("f"), "left")
    n_hit, n_items = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("n_items", F.lit(0).cast("long"))
    return rows.select(
        *KEY, "n_words", n_hit.alias("n_hit"), n_items.alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
