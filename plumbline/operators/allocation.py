"""Exact proportional allocation, stratified splits and seeded draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.sequences import hash_rank


def keyed_hash(seed: int, *cols: str) -> Column:
    """Seeded pseudo-random digest of the columns, the same on every run and in every engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def largest_remainder(weights: DataFrame, by: list[str], key: str, weight: str, total: str, seed: int) -> DataFrame:
    """``parts``: whole numbers with sum ``total`` per group, proportional to ``weight``.

    The units left after rounding down go to the largest remainders, ties by a seeded hash. All in whole numbers, so
    parts always add up. A group without weight gets nothing; null weights count as 0. A group holds categories.
    """
    w = F.coalesce(F.col(weight), F.lit(0)).cast("long")
    all_ = F.sum("__w").over(Window.partitionBy(*by))
    x = weights.withColumn("__w", w).withColumn("__all", all_)
    exact = F.when(F.col("__all") > 0, F.col(total) * F.col("__w"))
    x = x.withColumn("__base", F.coalesce(F.floor(F.expr(f"({total} * __w) div nullif(__all, 0)")), F.lit(0)))
    x = x.withColumn("__rest", F.coalesce(F.expr(f"({total} * __w) % nullif(__all, 0)"), F.lit(0)))
    left = F.col(total) - F.sum("__base").over(Window.partitionBy(*by))
    order = Window.partitionBy(*by).orderBy(F.desc("__rest"), keyed_hash(seed, *by, key))
    extra = F.when((F.row_number().over(order) <= left) & (F.col("__all") > 0), 1).otherwise(0)
    del exact
    return x.withColumn("parts", (F.col("__base") + extra).cast("long")).drop("__w", "__all", "__base", "__rest")


def dealt(parts: DataFrame, by: list[str], key: str, n: str) -> DataFrame:
    """Copies of each key in an even order: copy i of n stands at (2i + 1) / 2n, ties by key; ``place`` from 0."""
    c = parts.where(F.col(n) > 0).withColumn("i", F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int"))))
    at = (2 * F.col("i") + 1) / (2 * F.col(n)).cast("double")
    w = Window.partitionBy(*by).orderBy(F.round(at, 12), key, "i")
    return c.select(*by, key, "i", (F.row_number().over(w) - 1).alias("place"))


def stratified(df: DataFrame, strata: list[str], key: str, shares: list[tuple[str, int]], seed: int) -> DataFrame:
    """``split`` per row: every stratum is shuffled by a seeded hash and cut by largest remainders of ``shares``."""
    h = df.select(*strata, key).distinct().withColumn("__h", keyed_hash(seed, key))
    sizes = h.groupBy(*strata).agg(F.count("*").alias("total"))
    listed = F.explode(F.array(*[F.struct(F.lit(i).alias("o"), F.lit(s).alias("split"), F.lit(w).alias("w")) for i, (s, w) in enumerate(shares)]))
    cut = largest_remainder(sizes.select(*strata, "total", listed.alias("x")).select(*strata, "total", "x.*"), strata, "split", "w", "total", seed)
    w = Window.partitionBy(*strata).orderBy("o")
    cut = cut.withColumn("hi", F.sum("parts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    cut = cut.select(*strata, "split", (F.col("hi") - F.col("parts")).alias("lo"), "hi")
    ranked = hash_rank(h, strata, "__h", "rank")
    cond = [F.col(f"r.{s}").eqNullSafe(F.col(f"c.{s}")) for s in strata]
    cond += [F.col("rank") >= F.col("lo"), F.col("rank") < F.col("hi")]
    return ranked.alias("r").join(cut.alias("c"), cond).select(*[F.col(f"r.{s}") for s in strata], F.col(f"r.{key}"), "split")


def spot_check(df: DataFrame, by: list[str], key: str, percent: int, least: int, seed: int) -> DataFrame:
    """The first ceil(percent of n) rows, at least ``least``, of every group in seeded hash order."""
    h = df.select(*by, key).distinct().withColumn("__h", keyed_hash(seed, key))
    sizes = h.groupBy(*by).agg(F.greatest(F.ceil(F.count("*") * percent / 100), F.lit(least)).alias("take"))
    cond = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in by]
    ranked = hash_rank(h, by, "__h", "rank").alias("r").join(sizes.alias("s"), cond)
    return ranked.where("rank < take").select(*[F.col(f"r.{c}") for c in by], F.col(f"r.{key}"))


def batches(df: DataFrame, by: list[str], key: str, size: int, salt: str) -> DataFrame:
    """Batches of at most ``size`` rows in the order of salted opaque ids."""
    h = df.select(*by, key).distinct().withColumn("opaque_id", F.sha2(F.concat_ws("\n", F.lit(salt), F.col(key).cast("string")), 256))
    r = hash_rank(h, by, "opaque_id", "rank")
    return r.select(*by, key, "opaque_id", F.floor(F.col("rank") / size).cast("int").alias("batch"))


def round_robin(df: DataFrame, kind: str, key: str, first_of: str, take: int) -> DataFrame:
    """One of each kind in turn, kinds in the order they are first seen; the first ``take`` with their ``place``.

    Only the ``take`` best of each kind can be among them, so no more are ordered.
    """
    own = Window.partitionBy(kind).orderBy(first_of, key)
    seen = df.groupBy(kind).agg(F.min(first_of).alias("__seen"))
    top = df.withColumn("turn", F.row_number().over(own)).where(F.col("turn") <= take).join(seen, kind)
    w = Window.orderBy("turn", "__seen", kind)
    return top.orderBy("turn", "__seen", kind).limit(take).withColumn("place", F.row_number().over(w)).select(kind, key, "turn", "place")
