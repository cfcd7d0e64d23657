"""Leak test: texts that share whole word runs with guarded ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import plain_words, word_grams
from plumbline.operators.skew import lookup_join
from plumbline.session import stage

GRAM = 8
SHARED = 2


def fingerprints(items: DataFrame, key: str, k: int = GRAM) -> DataFrame:
    """``(key, gram)``: the distinct hashed runs of ``k`` words of every item."""
    g = items.select(key, F.explode(word_grams(plain_words(F.col("text")), k)).alias("g"))
    return g.select(key, F.xxhash64("g").alias("gram")).distinct()


def search(documents: DataFrame, doc_key: str, items: DataFrame, item_key: str, k: int = GRAM, least: int = SHARED) -> DataFrame:
    """``(doc_key, item_key, shared)``: pairs that share at least ``least`` distinct runs of ``k`` words.

    Runs with the same items are met as one: a run is looked up by its hash and brings the number of the item set it
    belongs to, the runs of a document are counted per set, and only then are sets opened. So an instruction that all
    items of a suite share makes one row a document, not one for every item and run. Null and short texts match nothing.
    """
    i = stage(fingerprints(items, item_key, k))
    sets = i.groupBy("gram").agg(F.sort_array(F.collect_list(item_key)).alias("items"))
    sets = stage(sets.withColumn("set", F.xxhash64("items")))
    d = fingerprints(documents, doc_key, k)
    n = lookup_join(d, sets.select("gram", "set"), "gram", sets.select("gram", F.size("items").cast("long").alias("n")), "inner")
    n = n.groupBy(doc_key, "set").agg(F.count("*").alias("n"))
    members = sets.select("set", "items").distinct().select("set", F.explode("items").alias(item_key))
    met = n.join(members, "set").groupBy(doc_key, item_key).agg(F.sum("n").alias("shared"))
    return met.where(F.col("shared") >= least)


def exact_leaks(documents: DataFrame, doc_key: str, items: DataFrame, item_key: str, marks: DataFrame) -> DataFrame:
    """``(doc_key, found, what)``: documents that are an item's whole text, word for word, whatever its length, or hold
    one of the ``marks(mark)`` as a word. Whole texts meet by digest, marks by the words of the documents."""
    digest = F.md5(F.array_join(plain_words(F.col("text")), " "))
    texts = items.where("length(text) > 0").select(F.col(item_key).cast("string").alias("found"), digest.alias("h"))
    d = documents.where("length(text) > 0")
    whole = d.select(doc_key, digest.alias("h")).join(texts, "h").select(doc_key, "found", F.lit("text").alias("what"))
    words = d.select(doc_key, F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("mark"))
    held = words.join(marks.select("mark").distinct(), "mark").select(doc_key, F.col("mark").alias("found"), F.lit("mark").alias("what"))
    return whole.unionByName(held).distinct()
