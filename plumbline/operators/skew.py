"""Joins and ranks that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key is hot from this share of the rows on, so at most 1 / HOT_SHARE keys are.
HOT_SHARE = 0.002


def lookup_join(rows: DataFrame, table: DataFrame, key: str, counts: DataFrame, how: str = "left") -> DataFrame:
    """Join ``rows`` to ``table``, which has one row per ``key``.

    ``counts(key, n)`` says how many rows each key has. Keys with more than ``HOT_SHARE`` of all rows number at most
    ``1 / HOT_SHARE``; only their table rows are broadcast. All others go through an ordinary shuffle join. Null keys
    match nothing. Column names other than ``key`` must not clash.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = [r[0] for r in counts.where(F.col("n") > F.lit(total * HOT_SHARE)).select(key).collect()]
    if not hot:
        return rows.join(table, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    warm = rows.where(is_hot).join(F.broadcast(table.where(F.col(key).isin(hot))), key, how)
    cold = rows.where(~is_hot).join(table.where(~F.col(key).isin(hot)), key, how)
    return warm.unionByName(cold)


def salted_sum(
    df: DataFrame, keys: list[str], order: list[Column], bucket: Column, out: str, value: Column | None = None
) -> DataFrame:
    """Sum of ``value`` (by default 1 a row: the 0-based rank) over the rows before each row within ``keys``.

    No key is gathered in one task: rows are spread by ``bucket``, an integer function of the row, and the order is by
    bucket first, then by ``order``. Deterministic if ``order`` is total within a key and bucket. Null keys are a group.
    """
    v = F.lit(1) if value is None else value
    b = df.withColumn("__b", bucket.cast("int")).withColumn("__v", v)
    sizes = b.groupBy(*keys, "__b").agg(F.sum("__v").alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.partitionBy(*keys).orderBy("__b")) - F.col("__n"))
    local = b.withColumn("__r", F.sum("__v").over(
        Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__v"))
    cond = [F.col(f"l.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*keys, "__b"]]
    joined = local.alias("l").join(before.drop("__n").alias("s"), cond, "inner")
    return joined.select("l.*", (F.col("__before") + F.col("__r")).alias(out)).drop("__b", "__r", "__v")
