"""Signed claim graphs: what groups of claims cannot all hold."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.components import connected_components
from plumbline.operators.paths import both_ways, hop_distances
from plumbline.operators.per_document import labels, numbered, solve
from plumbline.session import stage

#: Kinds of claims that a verdict may rest on.
ASSERTING = ("asserted", "premise")
THRESHOLD = 0.5


def enum_key(c: Column) -> Column:
    """A label apart from case and outer blanks."""
    return F.lower(F.trim(c))


def weight(confidence: Column) -> Column:
    """Confidence as an edge weight: null and NaN are 0, the rest is clipped to [0, 1]."""
    return F.least(F.greatest(F.coalesce(F.nanvl(confidence, F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def first_wins(relations: DataFrame) -> DataFrame:
    """One row per document and unordered pair, the first by ``seq``, with the number of later ones as ``repeats``.

    The first relation counts even if it makes no edge. Relations of a claim with itself, and null ends, are dropped.
    """
    r = relations.where("a is not null and b is not null and a <> b")
    r = r.withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b"), "relation": enum_key(F.col("relation"))})
    return r.groupBy("doc_id", "a", "b").agg(
        F.min_by(F.struct("seq", "relation", "confidence"), F.col("seq")).alias("x"),
        (F.count("*") - 1).alias("repeats"),
    ).select("doc_id", "a", "b", "x.*", "repeats")


def signed_edges(relations: DataFrame) -> DataFrame:
    """``(doc_id, a, b, sign, weight)``: supports +1, contradicts -1; no edge for other labels or zero weight."""
    sign = F.when(F.col("relation") == "supports", 1).when(F.col("relation") == "contradicts", -1)
    e = first_wins(relations).select("doc_id", "a", "b", sign.alias("sign"), weight(F.col("confidence")).alias("weight"))
    return e.where("sign is not null and weight > 0")


def graph_counters(relations: DataFrame) -> DataFrame:
    """Per document: pairs, edges, repeated relations, tension pairs, and edges lost to zero weight."""
    f = first_wins(relations)
    signed = F.col("relation").isin("supports", "contradicts")
    w = weight(F.col("confidence"))
    return f.groupBy("doc_id").agg(
        F.count("*").alias("pairs"),
        F.count_if(signed & (w > 0)).alias("edges"),
        F.sum("repeats").alias("repeats"),
        F.count_if(F.col("relation") == "tension").alias("tension"),
        F.count_if(signed & (w <= 0)).alias("zero_weight"),
    )


def direct_pairs(edges: DataFrame, claims: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Negative edges of weight at least ``threshold`` between two asserting claims."""
    kinds = claims.where(F.col("kind").isin(*ASSERTING)).select("doc_id", "claim_id")
    hit = edges.where((F.col("sign") < 0) & (F.col("weight") >= threshold))
    hit = hit.join(kinds.withColumnRenamed("claim_id", "a"), ["doc_id", "a"], "left_semi")
    return hit.join(kinds.withColumnRenamed("claim_id", "b"), ["doc_id", "b"], "left_semi").select("doc_id", "a", "b")


def pairwise_documents(edges: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The baseline: documents with any strong negative edge, whatever the claims' kind."""
    return edges.where((F.col("sign") < 0) & (F.col("weight") >= threshold)).select("doc_id").distinct()


def signed_laplacian(edges: DataFrame) -> DataFrame:
    """Non-zero entries ``(doc_id, row, col, value)`` of degree minus signed adjacency, by document."""
    off = -F.col("sign") * F.col("weight")
    parts = [
        edges.select("doc_id", F.col("a").alias("row"), F.col("b").alias("col"), off.alias("value")),
        edges.select("doc_id", F.col("b").alias("row"), F.col("a").alias("col"), off.alias("value")),
        edges.select("doc_id", F.col("a").alias("row"), F.col("a").alias("col"), F.col("weight").alias("value")),
        edges.select("doc_id", F.col("b").alias("row"), F.col("b").alias("col"), F.col("weight").alias("value")),
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("doc_id", "row", "col").agg(F.sum("value").alias("value"))


def _key(claim: str, parity: Column | int = 0) -> Column:
    """Document, claim and parity as one string that orders like them (documents may be of any type)."""
    p = F.lit(parity) if isinstance(parity, int) else parity
    return F.concat_ws("|", F.col("doc_id").cast("string"), F.lpad(F.col(claim).cast("string"), 10, "0"), p.cast("string"))


def _unkey(edges: DataFrame, key: str) -> tuple[Column, Column, Column]:
    kind = dict(edges.dtypes)["doc_id"]
    doc = F.regexp_extract(key, r"^(.*)\|[0-9]+\|[01]$", 1)
    claim = F.element_at(F.split(key, r"\|"), -2).cast("int")
    return doc.cast(kind), claim, F.right(F.col(key), F.lit(1)).cast("int")


def _balance(doc, a, b, sign):
    """Per claim of every document: the smallest claim connected to it, and whether both its parities are."""
    (u, v), nodes = numbered([doc, a], [doc, b])
    n, odd = len(nodes[0]), (np.asarray(sign, float) < 0).astype(np.int64)
    part = labels(n, u, v)
    cover = labels(2 * n, np.concatenate([2 * u, 2 * u + 1]), np.concatenate([2 * v + odd, 2 * v + 1 - odd]))
    return nodes, nodes[1][part], cover[0::2] == cover[1::2]


def _solved(edges: DataFrame, large) -> DataFrame:
    """``(doc_id, claim_id, component, unbalanced)`` of the claims that have edges."""
    e = edges.select("doc_id", F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), F.col("sign").cast("int").alias("sign"))

    def kernel(doc, a, b, sign):
        nodes, part, bad = _balance(doc, a, b, sign)
        return nodes[0], [nodes[1], part, bad]

    schema = f"doc_id {dict(edges.dtypes)['doc_id']}, claim_id int, component int, unbalanced boolean"
    return solve(stage(e), ["a", "b", "sign"], kernel, schema, large)


def _large_components(edges: DataFrame) -> DataFrame:
    cc = connected_components(edges.select(_key("a").alias("u"), _key("b").alias("v")))
    doc, claim, _ = _unkey(edges, "node")
    return cc.select(doc.alias("doc_id"), claim.alias("claim_id"), _unkey(edges, "component")[1].alias("component"), F.lit(False).alias("unbalanced"))


def components(edges: DataFrame, claims: DataFrame) -> DataFrame:
    """``(doc_id, claim_id, component)``: the smallest claim connected to each claim; a lone claim is its own."""
    cc = _solved(edges, _large_components).drop("unbalanced")
    return claims.select("doc_id", "claim_id").join(cc, ["doc_id", "claim_id"], "left").withColumn(
        "component", F.coalesce("component", "claim_id"))


def double_cover(edges: DataFrame) -> DataFrame:
    """Edges between (document, claim, parity); a negative edge changes the parity."""
    flip = F.when(F.col("sign") < 0, 1).otherwise(0)
    return edges.select(_key("a", 0).alias("u"), _key("b", flip).alias("v")).unionByName(
        edges.select(_key("a", 1).alias("u"), _key("b", 1 - flip).alias("v")))


def _large_unbalanced(edges: DataFrame) -> DataFrame:
    cc = connected_components(double_cover(edges))
    both = cc.groupBy(F.expr("substring(node, 1, length(node) - 1)").alias("c"), "component").agg(F.count("*").alias("n"))
    both = both.where("n = 2").select(F.concat("c", F.lit("0")).alias("node"))
    doc, claim, _ = _unkey(edges, "node")
    return both.select(doc.alias("doc_id"), claim.alias("claim_id"), F.lit(None).cast("int").alias("component"), F.lit(True).alias("unbalanced"))


def unbalanced_claims(edges: DataFrame) -> DataFrame:
    """``(doc_id, claim_id)`` of the claims whose component no two-colouring fits: both parities are connected."""
    return _solved(edges, _large_unbalanced).where("unbalanced").select("doc_id", "claim_id")


def _shortest(n: int, u: np.ndarray, v: np.ndarray, odd: np.ndarray) -> int:
    """Length of the shortest closed walk with an odd number of odd edges; 0 if there is none. It is a cycle."""
    near: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for x, y, p in zip(u.tolist(), v.tolist(), odd.tolist()):
        near[x].append((y, p))
        near[y].append((x, p))
    best = 0
    for s in range(n):
        seen, front, hops = {(s, 0)}, [(s, 0)], 0
        while front and not (best and hops + 1 >= best):
            hops += 1
            nxt = []
            for x, p in front:
                for y, q in near[x]:
                    to = (y, p ^ q)
                    if to not in seen:
                        seen.add(to)
                        nxt.append(to)
            if (s, 1) in seen:
                best = hops
                break
            front = nxt
    return best


def frustrated_cycle_lengths(edges: DataFrame) -> DataFrame:
    """``(doc_id, length)`` of the shortest cycle with an odd number of negative edges, for documents that have one,
    however long it is.

    Distances from every (claim, 0) to (claim, 1) in the double cover, sought in unbalanced components only.
    """
    e = stage(edges.select("doc_id", F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), F.col("sign").cast("int").alias("sign")))

    def kernel(doc, a, b, sign):
        (u, v), nodes = numbered([doc, a], [doc, b])
        odd = (np.asarray(sign, float) < 0).astype(np.int64)
        cover = labels(2 * len(nodes[0]), np.concatenate([2 * u, 2 * u + 1]), np.concatenate([2 * v + odd, 2 * v + 1 - odd]))
        bad = np.flatnonzero((cover[0::2] == cover[1::2])[u])
        found: dict[int, int] = {}
        order = bad[np.argsort(doc[bad], kind="stable")]
        for mine in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1) if len(order) else []:
            names, where = np.unique(np.concatenate([u[mine], v[mine]]), return_inverse=True)
            found[int(doc[mine[0]])] = _shortest(len(names), where[: len(mine)], where[len(mine) :], odd[mine])
        return np.array(list(found), np.int64), [np.array(list(found.values()), np.int64)]

    def large(rows):
        bad = _large_unbalanced(rows)
        docs = rows.join(bad.select("doc_id").distinct(), "doc_id", "left_semi")
        hops = hop_distances(both_ways(double_cover(docs)), bad.select(_key("claim_id", 0).alias("source")))
        back = hops.where("node = concat(substring(source, 1, length(source) - 1), '1')")
        return back.groupBy(_unkey(rows, "source")[0].alias("doc_id")).agg(F.min("hops").cast("int").alias("length"))

    return solve(e, ["a", "b", "sign"], kernel, f"doc_id {dict(edges.dtypes)['doc_id']}, length int", large)


def residual_ranking(residuals: DataFrame, least: Column, top: int = 3) -> DataFrame:
    """Claims by residual, largest first, with ``rank``; those at or under ``least`` are left out.

    Residuals equal to 9 digits of the document's largest tie, and ties go by claim.
    """
    most = F.max("residual").over(Window.partitionBy("doc_id"))
    r = residuals.withColumn("share", F.round(F.col("residual") / most, 9)).where(F.col("residual") > least)
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("share"), "claim_id"))
    return r.withColumn("rank", rank).where(F.col("rank") <= top).select("doc_id", "claim_id", "rank")
