"""Harmony of a signed claim graph: how well claims held at +1 fit the relations between them.

For every document the energy sum w (x_a - s x_b)^2 + mu sum (x_i - 1)^2 over asserted i is minimised with premises and
evidence fixed at +1. All of it falls apart by connected component, so components are what is solved: those of a bounded
size in a NumPy kernel, larger ones by conjugate gradients and inverse iteration whose vectors and matrix are tables. A
document's figures are sums over its components and do not depend on the way.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.components import connected_components
from plumbline.operators.signed_graph import components, residual_ranking
from plumbline.session import stage, unstage

MU = 1.0
#: Claims a component may have to be solved in one piece.
DENSE = 1024
#: Relative size of the residual, and of the last change of an eigenvalue, at which distributed iterations end; rounds
#: after which they fail.
RTOL, ROUNDS = 1e-10, 2000


def _laplacian(n: int, a: np.ndarray, b: np.ndarray, s: np.ndarray, w: np.ndarray) -> np.ndarray:
    lap = np.zeros((n, n))
    np.add.at(lap, (a, a), w)
    np.add.at(lap, (b, b), w)
    np.add.at(lap, (a, b), -s * w)
    np.add.at(lap, (b, a), -s * w)
    return lap


def _parts(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b]) if len(a) else label[:0]
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        if (new == label).all():
            return label
        label = new


def solve_document(kind: np.ndarray, fixed: np.ndarray, a, b, s, w) -> dict:
    """Assignment, residuals, harmony and conflict of one document; claims are numbered 0..n-1."""
    n = len(kind)
    asserted = kind == "asserted"
    lap, part = _laplacian(n, a, b, s, w), _parts(n, a, b)
    x, eres, cres = np.ones(n), np.zeros(len(a)), np.zeros(n)
    conflict, energy, total, anchors = 0.0, 0.0, 0.0, 0
    for c in np.unique(part):
        mine = np.flatnonzero(part == c)
        e = np.flatnonzero(part[a] == c) if len(a) else np.zeros(0, int)
        anchored = bool((fixed[mine] | asserted[mine]).any())
        anchors += anchored
        value, vec = np.linalg.eigh(lap[np.ix_(mine, mine)])
        tiny = 1e-9 * max(value[-1], 1e-300)
        conflict += 0.0 if value[0] <= tiny else float(value[0])
        if anchored:
            free = mine[~fixed[mine]]
            if len(free):
                m = lap[np.ix_(free, free)] + np.diag(MU * asserted[free])
                held = mine[fixed[mine]]
                x[free] = np.linalg.solve(m, MU * asserted[free] - lap[np.ix_(free, held)].sum(1))
            eres[e] = w[e] * (x[a[e]] - s[e] * x[b[e]]) ** 2
            cres[mine] = MU * asserted[mine] * (x[mine] - 1) ** 2
            total += float(w[e].sum())
            energy += float(eres[e].sum() + cres[mine].sum())
        else:
            # no claim holds this component: the residual is the mean over its lowest eigenspace
            low = vec[:, value - value[0] <= 1e-8 * max(value[-1], 1e-300)]
            at = {v: i for i, v in enumerate(mine)}
            i, j = [at[v] for v in a[e]], [at[v] for v in b[e]]
            eres[e] = w[e] * ((low[i] - s[e][:, None] * low[j]) ** 2).sum(1) / low.shape[1]
            first = vec[:, 0]
            top = int(np.flatnonzero(np.abs(first) >= np.abs(first).max() - 1e-12)[0])
            x[mine] = first * np.sign(first[top])
    res = cres.copy()
    np.add.at(res, a, eres)
    np.add.at(res, b, eres)
    related = np.zeros(n, bool)
    related[a] = related[b] = True
    size = 4 * total + 4 * MU * (asserted & related).sum()
    h = 1 - energy / size if anchors and total > 0 else None
    return {"x": x, "residual": res, "harmony": h, "conflict": conflict, "anchored": anchors, "energy": energy,
            "weight": total, "all_weight": float(w.sum()), "related": int((asserted & related).sum())}


def _parts_of(edges: DataFrame, claims: DataFrame, evidence: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(claims with ``fixed`` and ``component``, edges with ``component``), staged."""
    c = claims.groupBy("doc_id", "claim_id").agg(F.min("kind").alias("kind"))
    if evidence is not None:
        c = c.join(evidence.select("doc_id", "claim_id").distinct().withColumn("marked", F.lit(True)), ["doc_id", "claim_id"], "left")
    else:
        c = c.withColumn("marked", F.lit(False))
    c = stage(c.withColumn("fixed", (F.col("kind") == "premise") | F.coalesce("marked", F.lit(False))).drop("marked"))
    e = stage(edges.select("doc_id", F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), F.col("sign").cast("double").alias("sign"), "weight"))
    part = stage(components(e, c))
    nodes = stage(c.join(part, ["doc_id", "claim_id"]))
    return nodes, stage(e.join(part.withColumnRenamed("claim_id", "a"), ["doc_id", "a"]))


_RESULT = "claim_id int, x double, residual double, energy double, weight double, all_weight double, related int, anchored int, conflict double"


def _kernel(nodes: DataFrame, edges: DataFrame, doc_type: str) -> DataFrame:
    """Solve components, one row of arrays each; what holds for a component stands with its smallest claim."""
    key = ["doc_id", "component"]
    n = nodes.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("claim_id", "kind", "fixed"))).alias("nodes"))
    lines = edges.groupBy(*key).agg(F.collect_list(F.struct("a", "b", "sign", "weight")).alias("lines"))
    cols = [F.col(f"nodes.{k}").alias(k) for k in ("claim_id", "kind", "fixed")] + [
        F.coalesce(F.col(f"lines.{k}"), F.array().cast(f"array<{t}>")).alias(k)
        for k, t in (("a", "int"), ("b", "int"), ("sign", "double"), ("weight", "double"))
    ]
    rows = n.join(lines, key, "left").select("doc_id", *cols)

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                ids = np.asarray(r.claim_id)
                a, b = (np.searchsorted(ids, np.asarray(x)).astype(int) for x in (r.a, r.b))
                got = solve_document(np.asarray(r.kind, str), np.asarray(r.fixed, bool), a, b,
                                     np.asarray(r.sign, float), np.asarray(r.weight, float))
                once = np.arange(len(ids)) == 0
                part = {"doc_id": [r.doc_id] * len(ids), "claim_id": ids, "x": got["x"], "residual": got["residual"]}
                out.append(part | {k: np.where(once, got[k], 0) for k in ("energy", "weight", "all_weight", "related", "anchored", "conflict")})
            if out:
                yield pd.DataFrame({k: np.concatenate([o[k] for o in out]) for k in out[0]})

    return rows.mapInPandas(run, f"doc_id {doc_type}, {_RESULT}")


def _times(two: DataFrame, v: DataFrame, value: str) -> DataFrame:
    """``(part, claim_id, sp)``: the off-diagonal part of the matrix times a vector."""
    near = v.select("part", F.col("claim_id").alias("b"), F.col(value).alias("p"))
    return two.join(near, ["part", "b"]).groupBy("part", F.col("a").alias("claim_id")).agg(F.sum(F.col("sw") * F.col("p")).alias("sp"))


def conjugate_gradients(two: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(part, claim_id, x)`` with ``diag x - sum of sw x over neighbours = rhs``, all parts at once and none gathered.

    ``two(part, a, b, sw)`` in both directions, ``nodes(part, claim_id, diag, rhs)`` of positive definite parts. One
    join with the edges and two grouped sums a round. Ends when every part's residual is small against its right side;
    fails after ``ROUNDS``.
    """
    cur = stage(nodes.select("part", "claim_id", "diag", F.lit(0.0).alias("x"), F.col("rhs").alias("r"), F.col("rhs").alias("p")))
    size = stage(nodes.groupBy("part").agg(F.sum(F.col("rhs") * F.col("rhs")).alias("size")))
    for _ in range(ROUNDS):
        q = stage(cur.join(_times(two, cur, "p"), ["part", "claim_id"], "left").withColumn("q", F.col("diag") * F.col("p") - F.coalesce("sp", F.lit(0.0))).drop("sp"))
        step = q.groupBy("part").agg(F.sum(F.col("r") * F.col("r")).alias("rr"), F.sum(F.col("p") * F.col("q")).alias("pq"))
        step = step.select("part", "rr", F.when(F.col("pq") > 0, F.col("rr") / F.col("pq")).otherwise(0.0).alias("alpha"))
        moved = stage(q.join(step, "part").select(
            "part", "claim_id", "diag", (F.col("x") + F.col("alpha") * F.col("p")).alias("x"), (F.col("r") - F.col("alpha") * F.col("q")).alias("r"), "p", "rr"), drop=cur)
        unstage(q)
        now = F.sum(F.col("r") * F.col("r"))
        beta = stage(moved.groupBy("part").agg((now / F.nullif(F.max("rr"), F.lit(0.0))).alias("beta"), now.alias("now")))
        cur = stage(moved.join(beta, "part").select("part", "claim_id", "diag", "x", "r", (F.col("r") + F.coalesce("beta", F.lit(0.0)) * F.col("p")).alias("p")), drop=moved)
        if beta.join(size, "part").where(F.col("now") > RTOL**2 * F.col("size")).isEmpty():
            return cur.select("part", "claim_id", "x")
    raise RuntimeError(f"conjugate gradients did not settle in {ROUNDS} rounds")


def lowest_eigenvectors(two: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(part, claim_id, x)`` of unit length and ``(part, conflict)``: the lowest eigenpair of each positive definite
    part, by inverse iteration. ``nodes(part, claim_id, diag)``. Fails where it does not settle, as it does if the lowest
    eigenvalues of a part lie together without being equal."""
    x = stage(nodes.select("part", "claim_id", "diag", (F.pmod(F.xxhash64("claim_id", F.lit(3)), F.lit(1000)) / 1000 - 0.47).alias("rhs")))
    last = None
    for _ in range(ROUNDS // 10):
        y = stage(conjugate_gradients(two, x).join(x, ["part", "claim_id"]))
        sums = y.groupBy("part").agg(F.sum(F.col("x") * F.col("rhs")).alias("xr"), F.sum(F.col("x") * F.col("x")).alias("xx"))
        pair = stage(sums.select("part", (F.col("xr") / F.col("xx")).alias("conflict"), F.sqrt("xx").alias("norm")))
        new = stage(y.join(pair, "part").select("part", "claim_id", "diag", (F.col("x") / F.col("norm")).alias("rhs")), drop=x)
        if last is not None and pair.join(last.withColumnRenamed("conflict", "before"), "part").where(F.abs(F.col("conflict") - F.col("before")) > RTOL * F.col("conflict")).isEmpty():
            return new.select("part", "claim_id", F.col("rhs").alias("x")), pair.select("part", "conflict")
        x, last = new, pair.select("part", "conflict")
    raise RuntimeError("inverse iteration did not settle")


def _large(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The same columns as the kernel's for components above its bound."""
    asserted = (F.col("kind") == "asserted").cast("double")
    part = F.xxhash64("doc_id", "component").alias("part")
    v = stage(nodes.select("doc_id", part, "claim_id", "fixed", (asserted * MU).alias("pull")))
    e = stage(edges.select(part, "a", "b", "sign", "weight"))
    off = e.select("part", "a", "b", (F.col("sign") * F.col("weight")).alias("sw"), "weight")
    two = stage(off.unionByName(off.select("part", F.col("b").alias("a"), F.col("a").alias("b"), "sw", "weight")))
    deg = two.groupBy("part", F.col("a").alias("claim_id")).agg(F.sum("weight").alias("deg"))
    v = stage(v.join(deg, ["part", "claim_id"]))
    kinds = stage(v.groupBy("part").agg(F.bool_or(F.col("fixed") | (F.col("pull") > 0)).alias("anchored"), F.count("*").alias("n"), F.min("claim_id").alias("root")))

    # held by premises and assertions: the energy's minimum
    load = two.join(v.where("fixed").select("part", F.col("claim_id").alias("b")), ["part", "b"]).groupBy("part", F.col("a").alias("claim_id")).agg(F.sum("sw").alias("load"))
    free = v.where("not fixed").join(kinds.where("anchored").select("part"), "part", "left_semi").join(load, ["part", "claim_id"], "left")
    free = free.select("part", "claim_id", (F.col("deg") + F.col("pull")).alias("diag"), (F.col("pull") + F.coalesce("load", F.lit(0.0))).alias("rhs"))
    x = conjugate_gradients(two, free).unionByName(v.where("fixed").select("part", "claim_id", F.lit(1.0).alias("x")))

    # conflict: 0 where two colours fit, else the lowest eigenvalue; its vector is what unanchored components are held at
    flip = F.when(F.col("sign") < 0, 1).otherwise(0)
    node = lambda c, p: F.struct("part", F.col(c).alias("claim"), p.alias("parity"))
    cover = e.select(node("a", F.lit(0)).alias("u"), node("b", flip).alias("v")).unionByName(e.select(node("a", F.lit(1)).alias("u"), node("b", 1 - flip).alias("v")))
    side = stage(connected_components(cover).where("node.parity = 0").select("node.part", F.col("node.claim").alias("claim_id"), F.col("component.parity").alias("colour"), "component"))
    both = connected_components(cover).groupBy("node.part", "node.claim").agg(F.count_distinct("component").alias("n"))
    balanced = stage(both.groupBy("part").agg((F.min("n") > 1).alias("balanced")))
    odd = balanced.where("not balanced").select("part")
    vector, value = lowest_eigenvectors(two, v.join(odd, "part", "left_semi").select("part", "claim_id", F.col("deg").alias("diag")))
    even = side.join(balanced.where("balanced").select("part"), "part", "left_semi").join(kinds.select("part", "n"), "part")
    even = even.select("part", "claim_id", F.when(F.col("colour") == 0, 1 / F.sqrt("n")).otherwise(-1 / F.sqrt("n")).alias("x"))
    top = F.max_by(F.signum("x"), F.struct(F.round(F.abs("x"), 12), -F.col("claim_id")))
    turned = vector.join(vector.groupBy("part").agg(top.alias("turn")), "part").select("part", "claim_id", (F.col("x") * F.col("turn")).alias("x"))
    loose = even.unionByName(turned).join(kinds.where("not anchored").select("part"), "part", "left_semi")
    x = stage(x.unionByName(loose))

    ends = lambda k: x.select("part", F.col("claim_id").alias(k), F.col("x").alias(f"x{k}"))
    er = e.join(ends("a"), ["part", "a"]).join(ends("b"), ["part", "b"]).withColumn("er", F.col("weight") * F.pow(F.col("xa") - F.col("sign") * F.col("xb"), 2))
    er = stage(er.select("part", "a", "b", "weight", "er"))
    near = er.select("part", F.col("a").alias("claim_id"), "er").unionByName(er.select("part", F.col("b").alias("claim_id"), "er"))
    out = v.join(x, ["part", "claim_id"]).join(near.groupBy("part", "claim_id").agg(F.sum("er").alias("er")), ["part", "claim_id"]).join(kinds, "part")
    own = F.when(F.col("anchored"), F.col("pull") * F.pow(F.col("x") - 1, 2)).otherwise(0.0)
    out = stage(out.withColumn("own", own))
    sums = out.groupBy("part").agg(F.sum("own").alias("own_sum"), F.count_if(F.col("pull") > 0).alias("rel"))
    sums = sums.join(er.groupBy("part").agg(F.sum("er").alias("er_sum"), F.sum("weight").alias("w")), "part").join(value, "part", "left")
    held = F.col("anchored") & (F.col("claim_id") == F.col("root"))
    first = F.col("claim_id") == F.col("root")
    once = lambda cond, c: F.when(cond, c).otherwise(0)
    return out.join(sums, "part").select(
        "doc_id", "claim_id", "x", (F.col("own") + F.col("er")).alias("residual"), once(held, F.col("own_sum") + F.col("er_sum")).cast("double").alias("energy"),
        once(held, F.col("w")).cast("double").alias("weight"), once(first, F.col("w")).cast("double").alias("all_weight"), once(first, F.col("rel")).cast("int").alias("related"),
        once(held, F.lit(1)).cast("int").alias("anchored"), once(first, F.coalesce("conflict", F.lit(0.0))).cast("double").alias("conflict"))


def solved(edges: DataFrame, claims: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """Every claim's ``x`` and ``residual``; its component's figures stand with the component's smallest claim."""
    nodes, e = _parts_of(edges, claims, evidence)
    big = stage(nodes.groupBy("doc_id", "component").agg(F.count("*").alias("n")).where(F.col("n") > DENSE).drop("n"))
    doc_type = dict(claims.dtypes)["doc_id"]
    if big.isEmpty():
        return stage(_kernel(nodes, e, doc_type))
    key = ["doc_id", "component"]
    small = _kernel(nodes.join(big, key, "left_anti"), e.join(big, key, "left_anti"), doc_type)
    return stage(small.unionByName(_large(stage(nodes.join(big, key, "left_semi")), stage(e.join(big, key, "left_semi")))))


def assignments(edges: DataFrame, claims: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """``(doc_id, claim_id, x, residual, scale)`` for every claim; a document without relations keeps its claims at +1."""
    s = solved(edges, claims, evidence)
    scale = s.groupBy("doc_id").agg((F.sum("all_weight") + MU * F.sum("related")).alias("scale"))
    return s.join(scale, "doc_id").select("doc_id", "claim_id", "x", "residual", "scale")


def harmony(edges: DataFrame, claims: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """``(doc_id, harmony, conflict, anchored)``. Harmony is null without anchors or relations of anchored components;
    conflict is the sum of the components' smallest eigenvalues, 0 where balanced."""
    g = solved(edges, claims, evidence).groupBy("doc_id").agg(
        *[F.sum(c).alias(c) for c in ("energy", "weight", "related", "conflict")], F.sum("anchored").cast("int").alias("anchored"))
    h = F.when((F.col("anchored") > 0) & (F.col("weight") > 0), 1 - F.col("energy") / (4 * F.col("weight") + 4 * MU * F.col("related")))
    return g.select("doc_id", h.alias("harmony"), "conflict", "anchored")


def culprits(edges: DataFrame, claims: DataFrame, evidence: DataFrame | None = None, top: int = 3) -> DataFrame:
    """``(doc_id, claim_id, rank, conflict_drop, harmony_change)``: the ``top`` claims by residual, and what becomes of
    their document without each. Every claim left out makes a copy of its document, and all copies are solved together.
    ``harmony_change`` is null where either harmony is."""
    e, c = stage(edges), stage(claims)
    ranked = stage(residual_ranking(assignments(e, c, evidence), F.lit(1e-12) * F.col("scale"), top))
    out = ranked.select("doc_id", F.col("claim_id").alias("out"), "rank")
    copy = F.struct("doc_id", "out").alias("copy")
    ce = e.join(out.select("doc_id", "out"), "doc_id").where("a <> out and b <> out").select(copy, "a", "b", "sign", "weight")
    cc = c.join(out.select("doc_id", "out"), "doc_id").where("claim_id <> out").select(copy, "claim_id", "kind")
    number = lambda df: df.withColumn("doc_id", F.concat_ws("|", F.col("copy.doc_id").cast("string"), F.col("copy.out").cast("string"))).drop("copy")
    ev = None if evidence is None else number(evidence.join(out.select("doc_id", "out"), "doc_id").where("claim_id <> out").select(copy, "claim_id"))
    before = harmony(e, c, evidence).select("doc_id", F.col("harmony").alias("h0"), F.col("conflict").alias("c0"))
    after = harmony(number(ce), number(cc), ev).select(F.col("doc_id").alias("copy"), F.col("harmony").alias("h1"), F.col("conflict").alias("c1"))
    return ranked.withColumn("copy", F.concat_ws("|", F.col("doc_id").cast("string"), F.col("claim_id").cast("string"))).join(before, "doc_id").join(after, "copy", "left").select(
        "doc_id", "claim_id", "rank", (F.col("c0") - F.coalesce("c1", F.lit(0.0))).alias("conflict_drop"), (F.col("h1") - F.col("h0")).alias("harmony_change"))
