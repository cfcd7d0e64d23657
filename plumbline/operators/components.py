"""Connected components of an undirected edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import stage


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges(u, v)``; ``component`` is the smallest node of its component.

    Alternating large-star and small-star rounds (Kiveris et al., SoCC 2014). A star's centre is only ever met through
    grouped minima, which combine map-side, and through a join on the centre that AQE may split, so a hub with a large
    share of all edges is never gathered in one task. Rounds grow with the logarithm of the longest path. Null ends
    and loops are ignored; repeated edges count once; an empty table gives an empty result. Fails rather than return
    an unfinished labelling after ``max_rounds``.
    """
    e = (
        edges.select("u", "v")
        .where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    cur = stage(e)
    seen = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of u is linked to the smallest of u and its neighbours
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: u and its smaller neighbours are linked to the smallest of them
        mins = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(mins, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        nxt = small.unionByName(mins.select("u", F.col("m").alias("v"))).distinct()
        cur = stage(nxt, drop=cur)
        now = cur.agg(
            F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))
        ).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = cur.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return members.unionByName(roots)
