"""Measures of undirected graphs given as edge tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.paths import both_ways, hop_distances
from plumbline.operators.searches import shells
from plumbline.session import stage


def canonical_edges(pairs: DataFrame) -> DataFrame:
    """Distinct ``(u, v)`` with u < v; loops and null ends are dropped."""
    p = pairs.where("u is not null and v is not null and u <> v")
    return p.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("u").alias("node")).agg(F.count("*").alias("degree"))


def ball_masses(edges: DataFrame, sources: DataFrame, limit: int = 10_000) -> DataFrame:
    """``(source, hops, mass)``: nodes within ``hops`` steps, from shells summed up; sources without edges have 1."""
    w = Window.partitionBy("source").orderBy("hops").rowsBetween(Window.unboundedPreceding, 0)
    return shells(edges, sources, limit).select("source", "hops", F.sum("n").over(w).alias("mass"))


def mass_dimension(masses: DataFrame, least: int = 3) -> DataFrame:
    """Slope of log mass against log radius per source, over at least ``least`` radii."""
    m = masses.where("hops > 0").select("source", F.log("hops").alias("x"), F.log("mass").alias("y"))
    return m.groupBy("source").agg(F.regr_slope("y", "x").alias("dimension"), F.count("*").alias("radii")).where(F.col("radii") >= least)


def double_sweep(edges: DataFrame, start: DataFrame, limit: int = 10_000) -> DataFrame:
    """A lower bound of the diameter: the farthest node from ``start``, and the distance of the farthest from that."""
    two = stage(both_ways(edges))
    far = lambda s: hop_distances(two, s, limit).agg(F.max_by("node", F.struct("hops", "node")).alias("source"), F.max("hops").alias("hops"))
    first = stage(far(start.select("source")))
    return far(first.select("source")).select(F.col("source").alias("end"), F.col("hops").alias("diameter"))


def cut_value(edges: DataFrame, sides: DataFrame) -> DataFrame:
    """Weight of the edges between the two sides, and of all edges. ``edges(u, v, weight)``, ``sides(node, side)``."""
    s = lambda k: sides.select(F.col("node").alias(k), F.col("side").alias(f"s{k}"))
    e = edges.join(s("u"), "u").join(s("v"), "v")
    return e.agg(F.sum(F.when(F.col("su") != F.col("sv"), F.col("weight")).otherwise(0)).alias("cut"), F.sum("weight").alias("total"))


def best_cuts(edges: DataFrame, most: int = 12) -> DataFrame:
    """``(graph, cut)``: the largest cut of every graph of at most ``most`` nodes, by trying all sides of each.

    ``edges(graph, u, v, weight)``, nodes numbered from 0. Every graph becomes one row of edges, whose number the bound
    on its nodes bounds; ``exact_cuts`` has the larger graphs too.
    """
    n = edges.groupBy("graph").agg((F.max(F.greatest("u", "v")) + 1).alias("n")).where(F.col("n") <= most)
    rows = edges.join(n, "graph").groupBy("graph", "n").agg(F.collect_list(F.struct("u", "v", "weight")).alias("e"))
    sides = F.sequence(F.lit(0), F.shiftleft(F.lit(1), most - 1) - 1)
    value = lambda mask: F.aggregate(
        "e", F.lit(0.0), lambda a, x: a + F.when(
            (F.call_function("shiftright", mask, x["u"]).bitwiseXOR(F.call_function("shiftright", mask, x["v"]))).bitwiseAND(F.lit(1)) == 1,
            x["weight"].cast("double")).otherwise(0.0))
    return rows.select("graph", F.array_max(F.transform(sides, value)).alias("cut"))


def _near(factors: list) -> dict:
    near: dict = {}
    for scope, _ in factors:
        for x in scope:
            near.setdefault(x, set()).update(scope)
    return near


def _most(factors: list, width: int) -> float:
    """Largest sum of ``factors``, each (variables, table over their values 0 and 1), variables eliminated one by one."""
    total = float(sum(table for scope, table in factors if not scope))
    factors = [f for f in factors if f[0]]
    while factors:
        near = _near(factors)
        x = min(near, key=lambda k: (len(near[k]), k))
        if len(near[x]) > width:  # no table of that size: try both values of the most connected one
            y = max(near, key=lambda k: (len(near[k]), k))
            return total + max(_most([
                (tuple(z for z in s if z != y), t.take(v, s.index(y)) if y in s else t) for s, t in factors], width) for v in (0, 1))
        scope = (x, *sorted(near[x] - {x}))
        table = np.zeros((2,) * len(scope))
        for s, t in factors:
            if x in s:
                order = sorted(range(len(s)), key=lambda i: scope.index(s[i]))
                table += t.transpose(order).reshape([2 if k in s else 1 for k in scope])
        factors = [f for f in factors if x not in f[0]]
        if len(scope) > 1:
            factors.append((scope[1:], table.max(axis=0)))
        else:
            total += float(table.max())
    return total


def max_cut(u, v, w, width: int = 20) -> float:
    """The largest cut of one graph, exactly: each component by eliminating its least connected nodes first, as on a
    tree decomposition. Tables hold at most 2 ** ``width`` numbers; denser components branch on a node first."""
    weight: dict = {}
    for a, b, x in zip(u, v, w):
        if a != b:
            weight[min(a, b), max(a, b)] = weight.get((min(a, b), max(a, b)), 0.0) + float(x)
    factors = [(e, np.array([[0.0, x], [x, 0.0]])) for e, x in weight.items()]
    near, seen, total = _near(factors), set(), 0.0
    for root in near:
        if root in seen:
            continue
        part, todo = {root}, [root]
        for x in todo:
            todo += near[x] - part
            part |= near[x]
        seen |= part
        held = ((root,), np.array([0.0, -np.inf]))  # a cut and its mirror are one
        total += _most([held, *(f for f in factors if f[0][0] in part)], width)
    return total


def exact_cuts(edges: DataFrame, most: int = 9) -> DataFrame:
    """``(graph, cut)``: the largest cut of every graph, of whatever size; ``best_cuts`` for those of at most ``most``
    nodes, an exact kernel (``max_cut``) for the others. Every graph becomes one row of edges."""
    n = edges.groupBy("graph").agg((F.max(F.greatest("u", "v")) + 1).alias("n")).where(F.col("n") > most)
    rows = edges.join(n, "graph", "left_semi").groupBy("graph").agg(
        F.collect_list("u").alias("u"), F.collect_list("v").alias("v"), F.collect_list(F.col("weight").cast("double")).alias("w"))

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"graph": pdf["graph"], "cut": [max_cut(*x) for x in zip(pdf["u"], pdf["v"], pdf["w"])]})

    large = rows.mapInPandas(run, f"graph {dict(edges.dtypes)['graph']}, cut double")
    return best_cuts(edges, most).unionByName(large)


def dirichlet_energy(edges: DataFrame, stalks: DataFrame) -> DataFrame:
    """Per edge the squared distance of its ends' vectors, scaled by its weight, and as ``total`` over all edges.

    ``edges(u, v, weight)``, ``stalks(node, x)`` with arrays of one length; an end without a vector gives null.
    """
    s = lambda k: stalks.select(F.col("node").alias(k), F.col("x").alias(f"x{k}"))
    gap = F.aggregate(F.zip_with("xu", "xv", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda t, y: t + y)
    return edges.join(s("u"), "u", "left").join(s("v"), "v", "left").select("u", "v", (F.col("weight") * gap).alias("energy"))


def spectra(edges: DataFrame, most: int = 512) -> DataFrame:
    """``(doc_id, nodes, parts, gap, repeats, side)`` of every document's undirected graph ``edges(doc_id, a, b, weight)``.

    ``parts`` is how often the Laplacian has the eigenvalue 0, ``gap`` the smallest eigenvalue above, ``repeats`` how
    often that occurs (to 8 digits of the largest), and ``side`` how many nodes the smaller side of the Fiedler cut has:
    the sign of the gap's eigenvector, null where the gap is repeated and the cut not unique. Repeated edges add up,
    loops count for nothing. Graphs of more than ``most`` nodes raise: a dense spectrum has no distributed form here.
    """
    e = edges.where("a <> b").groupBy("doc_id").agg(F.collect_list(F.struct(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("weight").cast("double").alias("w"))).alias("e"))
    kind = dict(edges.dtypes)["doc_id"]

    def run(batches):
        for pdf in batches:
            rows = []
            for doc, a, b, w in zip(pdf["doc_id"], pdf["a"], pdf["b"], pdf["w"]):
                ids, where = np.unique(np.concatenate([a, b]), return_inverse=True)
                n, m = len(ids), len(a)
                if n > most:
                    raise ValueError(f"a graph has {n} nodes, more than {most}")
                u, v = where[:m], where[m:]
                lap = np.zeros((n, n))
                for x, y, z in ((u, u, w), (v, v, w), (u, v, -w), (v, u, -w)):
                    np.add.at(lap, (x, y), z)
                value, vector = np.linalg.eigh(lap)
                tiny = 1e-8 * max(value[-1], 1e-300)
                parts = int((value <= tiny).sum())
                if parts >= n:
                    rows.append((doc, n, parts, None, 0, None))
                    continue
                repeats = int((np.abs(value - value[parts]) <= tiny).sum())
                x = vector[:, parts]
                side = int(min((x > 1e-9).sum(), (x < -1e-9).sum())) if repeats == 1 and parts == 1 else None
                rows.append((doc, n, parts, float(value[parts]), repeats, side))
            yield pd.DataFrame(rows, columns=["doc_id", "nodes", "parts", "gap", "repeats", "side"]).astype({"gap": "float64", "side": "Int64"})

    flat = e.select("doc_id", *[F.col(f"e.{k}").alias(k) for k in ("a", "b", "w")])
    out = flat.mapInPandas(run, f"doc_id {kind}, nodes long, parts long, gap double, repeats long, side long")
    return out.withColumn("gap", F.nanvl("gap", F.lit(None)))
