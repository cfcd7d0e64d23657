"""Breadth-first distances over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.skew import salted_sum
from plumbline.session import stage


def hop_distances(edges: DataFrame, sources: DataFrame, limit: int = 10_000) -> DataFrame:
    """``(source, node, hops)``: for every source the nodes it reaches along ``edges(u, v)``, at most ``limit`` hops.

    Sources go in blocks of 64, one bit each, so a round joins the frontier with the edges once a block and combines
    what meets at a node by a grouped bit-or; bits met before are taken off, so a round only carries what is new. A
    source reaches itself in 0 hops, whether or not it has edges. Null ends are ignored.
    """
    e = stage(edges.select("u", "v").where("u is not null and v is not null").distinct())
    s = sources.where("source is not null").select("source").distinct()
    s = salted_sum(s, [], [F.col("source")], F.pmod(F.xxhash64("source"), F.lit(1024)), "rank")
    s = stage(s.select("source", F.floor(F.col("rank") / 64).alias("block"), (F.col("rank") % 64).cast("int").alias("bit")))
    one = F.lit(1).cast("long")
    frontier = stage(s.select(F.col("source").alias("node"), "block", F.call_function("shiftleft", one, F.col("bit")).alias("bits"), F.lit(0).alias("hops")))
    parts, hop = [frontier], 0
    while hop < limit:
        hop += 1
        reached = frontier.join(e, frontier["node"] == e["u"]).select(F.col("v").alias("node"), "block", "bits")
        reached = reached.groupBy("node", "block").agg(F.bit_or("bits").alias("bits"), F.lit(0).cast("long").alias("known"))
        known = parts[0]
        for p in parts[1:]:
            known = known.unionByName(p)
        both = reached.unionByName(known.select("node", "block", F.lit(0).cast("long").alias("bits"), F.col("bits").alias("known")))
        both = both.groupBy("node", "block").agg(F.bit_or("bits").alias("bits"), F.bit_or("known").alias("known"))
        new = both.select("node", "block", F.col("bits").bitwiseAND(F.bitwise_not("known")).alias("bits"), F.lit(hop).alias("hops"))
        new = stage(new.where("bits <> 0"))
        if new.isEmpty():
            break
        parts.append(new)
        frontier = new
        if len(parts) > 12:  # keep the union short
            whole = parts[0]
            for p in parts[1:-1]:
                whole = whole.unionByName(p)
            parts = [stage(whole), new]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    members = s.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bit", "source"))).alias("members"))
    held = F.filter("members", lambda m: F.call_function("shiftright", F.col("bits"), m["bit"]).bitwiseAND(one) == 1)
    out = out.join(members, "block").select("node", "hops", F.explode(held).alias("m"))
    return out.select(F.col("m.source").alias("source"), "node", "hops")


def both_ways(edges: DataFrame) -> DataFrame:
    """Undirected edges as pairs in either direction."""
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def cyclic_nodes(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """``node``: what is left of a directed graph after nodes without a way in or without a way out are removed again
    and again; empty exactly if there is no cycle. Loops count as cycles."""
    cur = stage(edges.select("u", "v").distinct())
    n = cur.count()
    for _ in range(max_rounds):
        kept = cur.join(cur.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
        kept = kept.join(cur.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u", "v")
        cur = stage(kept, drop=cur)
        now = cur.count()
        if now == n:
            break
        n = now
    else:
        raise RuntimeError("cycle trimming did not settle")
    return cur.select(F.col("u").alias("node")).distinct()
