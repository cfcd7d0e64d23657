"""Constraints over facts: which facts cannot all hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ready(facts: DataFrame) -> DataFrame:
    """Facts whose ``depends`` are all present among their document's facts; null and empty arrays depend on nothing."""
    need = facts.select("doc_id", "fact_id", F.explode("depends").alias("d")).distinct()
    there = facts.select("doc_id", F.col("fact_id").alias("d")).distinct()
    missing = need.join(there, ["doc_id", "d"], "left_anti").select("doc_id", "fact_id").distinct()
    return facts.join(missing, ["doc_id", "fact_id"], "left_anti")


def value_conflicts(facts: DataFrame) -> DataFrame:
    """``(doc_id, subject, attribute, values)`` with more than one value stated, or one both stated and negated."""
    g = facts.where("value is not null").groupBy("doc_id", "subject", "attribute").agg(
        F.count_distinct(F.when(~F.col("negated"), F.col("value"))).alias("values"),
        F.array_sort(F.collect_set(F.when(~F.col("negated"), F.col("value")))).alias("has"),
        F.array_sort(F.collect_set(F.when(F.col("negated"), F.col("value")))).alias("lacks"),
    )
    clash = F.size(F.array_intersect("has", "lacks"))
    return g.select("doc_id", "subject", "attribute", "values", clash.alias("denied")).where("values > 1 or denied > 0")


def equal_but_different(facts: DataFrame, different: DataFrame) -> DataFrame:
    """Statements that two subjects differ in an attribute in which both have the same single value."""
    v = facts.where("not negated and value is not null").groupBy("doc_id", "subject", "attribute").agg(
        F.min("value").alias("value"), F.count_distinct("value").alias("n")).where("n = 1")
    side = lambda k: v.select("doc_id", "attribute", F.col("subject").alias(k), F.col("value").alias(f"v{k}"))
    d = different.where("a <> b").join(side("a"), ["doc_id", "attribute", "a"]).join(side("b"), ["doc_id", "attribute", "b"])
    return d.where("va = vb").select("doc_id", "attribute", "a", "b", F.col("va").alias("value"))
