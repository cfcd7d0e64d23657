"""Contradictions among statements that entities are the same, different or ordered in an attribute."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.components import connected_components
from plumbline.operators.paths import both_ways, cyclic_nodes, hop_distances
from plumbline.operators.per_document import cyclic, labels, numbered, solve
from plumbline.session import stage


def canonical_key(c: Column) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def _node(side: str) -> Column:
    return F.struct(F.col("doc_id").alias("doc"), F.col("attribute").alias("attribute"), F.col(side).alias("entity"))


_COLUMNS = ["attribute", "kind", "a", "b"]


def _kinds(relations: DataFrame) -> tuple[str, str, str]:
    t = dict(relations.dtypes)
    return t["doc_id"], t["attribute"], t["a"]


def _large_classes(relations: DataFrame) -> DataFrame:
    same = relations.where("kind = 'same'").select(_node("a").alias("u"), _node("b").alias("v"))
    cc = connected_components(same)
    return cc.select(
        F.col("node.doc").alias("doc_id"), F.col("node.attribute").alias("attribute"),
        F.col("node.entity").alias("entity"), F.col("component.entity").alias("class"),
    )


def equality_classes(relations: DataFrame) -> DataFrame:
    """``(doc_id, attribute, entity, class)`` under the ``same`` relations, the smallest entity as the class; entities
    without one are left out."""
    doc, attribute, entity = _kinds(relations)
    same = stage(relations.where("kind = 'same' and a <> b").select("doc_id", "attribute", "kind", "a", "b"))

    def kernel(d, att, _, a, b):
        (u, v), nodes = numbered([d, att, a], [d, att, b])
        return nodes[0], [nodes[1], nodes[2], nodes[2][labels(len(nodes[0]), u, v)]]

    return solve(same, _COLUMNS, kernel, f"doc_id {doc}, attribute {attribute}, entity {entity}, class {entity}", _large_classes)


def by_class(relations: DataFrame, classes: DataFrame) -> DataFrame:
    """The relations with the classes of both ends as ``ca`` and ``cb``; an entity without a class is its own."""
    out = relations
    for side in ("a", "b"):
        c = classes.select("doc_id", "attribute", F.col("entity").alias(side), F.col("class").alias(f"c{side}"))
        out = out.join(c, ["doc_id", "attribute", side], "left").withColumn(f"c{side}", F.coalesce(f"c{side}", side))
    return out


def different_within_class(classed: DataFrame) -> DataFrame:
    """``different`` relations whose ends are equal or in one class."""
    return classed.where("kind = 'different' and ca = cb").select("doc_id", "attribute", "rel_id", "claim_id")


def _class_node(side: str, parity: int | None = None) -> Column:
    parts = [F.col("doc_id").alias("doc"), F.col("attribute").alias("attribute"), F.col(side).alias("entity")]
    return F.struct(*parts, *([] if parity is None else [F.lit(parity).alias("parity")]))


def parity_violations(classed: DataFrame, arities: DataFrame) -> DataFrame:
    """``(doc_id, attribute)`` with an odd cycle of ``different`` relations between classes, where the attribute is
    binary by ``arities(doc_id, attribute, arity)``; an unknown arity is not binary."""
    binary = arities.where("arity = 'binary'").select("doc_id", "attribute")
    e = classed.where("kind = 'different' and ca <> cb").join(binary, ["doc_id", "attribute"], "left_semi")
    cover = e.select(_class_node("ca", 0).alias("u"), _class_node("cb", 1).alias("v")).unionByName(
        e.select(_class_node("ca", 1).alias("u"), _class_node("cb", 0).alias("v")))
    cc = connected_components(cover).select("node.*", "component")
    both = cc.groupBy("doc", "attribute", "entity", "component").agg(F.count("*").alias("n")).where("n = 2")
    return both.select(F.col("doc").alias("doc_id"), "attribute").distinct()


def order_cycles(classed: DataFrame) -> DataFrame:
    """``(doc_id, attribute)`` where some ``greater`` relation is closed by others and by equalities.

    Classes are contracted; then a cycle is what remains after trimming. A ``greater`` inside a class is one too.
    """
    g = classed.where("kind = 'greater'").select(_class_node("ca").alias("u"), _class_node("cb").alias("v"))
    return cyclic_nodes(g).select(F.col("node.doc").alias("doc_id"), F.col("node.attribute").alias("attribute")).distinct()


def _shortest_order(n: int, rows: list[tuple[int, int, bool]]) -> int:
    """Relations in the shortest order cycle of one attribute, its equalities included; 0 if there is none."""
    near: list[set[int]] = [set() for _ in range(n)]
    starts: dict[int, set[int]] = {}
    for x, y, order in rows:
        near[x].add(y)
        if order:
            starts.setdefault(y, set()).add(x)
        else:
            near[y].add(x)
    best = 0
    for s, goals in starts.items():
        seen, front, hops = {s}, [s], 0
        while front and not goals & seen and not (best and hops + 1 >= best):
            hops += 1
            front = list({y for x in front for y in near[x]} - seen)
            seen.update(front)
        if goals & seen and not (best and hops + 1 >= best):
            best = hops + 1
    return best


def order_cycle_lengths(relations: DataFrame) -> DataFrame:
    """``(doc_id, attribute, length)``: relations in the shortest order cycle, ``same`` relations included, however
    long it is."""
    doc, attribute, _ = _kinds(relations)
    r = stage(relations.where("kind in ('greater', 'same') and not (kind = 'same' and a = b)").select("doc_id", *_COLUMNS))

    def kernel(d, att, kind, a, b):
        (u, v), nodes = numbered([d, att, a], [d, att, b])
        (group,), names = numbered([d, att])
        order = np.argsort(group, kind="stable")
        at, out = [], []
        for mine in np.split(order, np.flatnonzero(np.diff(group[order])) + 1) if len(order) else []:
            ids, where = np.unique(np.concatenate([u[mine], v[mine]]), return_inverse=True)
            m = len(mine)
            length = _shortest_order(len(ids), list(zip(where[:m].tolist(), where[m:].tolist(), (kind[mine] == "greater").tolist())))
            if length:
                at.append(group[mine[0]])
                out.append(length)
        return names[0][at] if at else np.zeros(0, np.int64), [names[1][at] if at else [], np.array(out, np.int64)]

    def large(rows):
        g = rows.where("kind = 'greater'").select(_node("a").alias("u"), _node("b").alias("v"))
        moves = g.unionByName(both_ways(rows.where("kind = 'same'").select(_node("a").alias("u"), _node("b").alias("v"))))
        hops = hop_distances(moves, g.select(F.col("v").alias("source")))
        back = hops.select(F.col("source").alias("v"), F.col("node").alias("u"), "hops")
        closed = g.join(back, ["u", "v"]).select(F.col("u.doc").alias("doc_id"), F.col("u.attribute").alias("attribute"), "hops")
        return closed.groupBy("doc_id", "attribute").agg((F.min("hops") + 1).cast("int").alias("length"))

    return solve(r, _COLUMNS, kernel, f"doc_id {doc}, attribute {attribute}, length int", large)


def arities(declared: DataFrame) -> DataFrame:
    """Per document and attribute: binary if every declaration says so, else multi if any does, else unknown; with the
    first span by ``seq``."""
    return declared.groupBy("doc_id", "attribute").agg(
        F.when(F.bool_and(F.col("arity") == "binary"), "binary")
        .when(F.bool_or(F.col("arity") == "multi"), "multi").otherwise("unknown").alias("arity"),
        F.min_by("span", "seq").alias("span"),
    )


#: Kinds of contradiction, and what a relation that a superlative stands for is marked with.
TYPES = ("different_within_class", "binary_parity", "order_cycle")
COLLISION = "superlative_collision"


def _large_contradictions(r: DataFrame) -> DataFrame:
    classed = stage(by_class(r, _large_classes(r)))
    binary = r.where("binary").select("doc_id", "attribute", F.lit("binary").alias("arity")).distinct()
    parts = [
        different_within_class(classed.withColumns({"rel_id": F.lit(0), "claim_id": F.lit(0)})).select("doc_id", "attribute").distinct(),
        parity_violations(classed, binary), order_cycles(classed),
    ]
    parts = [p.withColumn("type", F.lit(t)) for p, t in zip(parts, TYPES)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def contradictions(relations: DataFrame, arity: DataFrame) -> DataFrame:
    """``(doc_id, attribute, type)`` of every kind of contradiction present, all of a document's in one pass: its
    equality classes, ``different`` relations inside one, odd cycles of such between the classes of a binary attribute,
    and order cycles over the contracted classes."""
    doc, attribute, _ = _kinds(relations)
    binary = arity.where("arity = 'binary'").select("doc_id", "attribute", F.lit(True).alias("binary")).distinct()
    r = relations.select("doc_id", *_COLUMNS).join(binary, ["doc_id", "attribute"], "left").withColumn("binary", F.coalesce("binary", F.lit(False)))

    def kernel(d, att, kind, a, b, two):
        (u, v), nodes = numbered([d, att, a], [d, att, b])
        n = len(nodes[0])
        same, apart, above = kind == "same", kind == "different", kind == "greater"
        part = labels(n, u[same], v[same])
        u, v = part[u], part[v]
        inside = u[apart & (u == v)]
        odd = apart & two.astype(bool) & (u != v)
        cover = labels(2 * n, np.concatenate([2 * u[odd], 2 * u[odd] + 1]), np.concatenate([2 * v[odd] + 1, 2 * v[odd]]))
        parity = np.unique(u[odd][cover[2 * u[odd]] == cover[2 * u[odd] + 1]])
        circle = u[above][cyclic(n, u[above], v[above])]
        at = np.concatenate([inside, parity, circle])
        type_ = np.repeat(np.arange(3), [len(inside), len(parity), len(circle)])
        _, names = numbered([nodes[0][at], nodes[1][at], type_])
        return names[0], [names[1], np.array(TYPES, object)[names[2].astype(int)]]

    return solve(stage(r), [*_COLUMNS, "binary"], kernel, f"doc_id {doc}, attribute {attribute}, type string", _large_contradictions)


def superlative_collisions(expanded: DataFrame) -> DataFrame:
    """``(doc_id, attribute, a, b, side)``: two entities outside one class of which each is said to be the most, or each
    the least. ``expanded`` as of ``expand_superlatives``: two such relations of one side that point both ways."""
    x = expanded.select("doc_id", "attribute", "a", "b", "side").distinct()
    back = x.select("doc_id", "attribute", F.col("b").alias("a"), F.col("a").alias("b"), "side")
    return x.where("a < b").join(back, ["doc_id", "attribute", "a", "b", "side"], "left_semi")


def eligible(relations: DataFrame, claims: DataFrame, threshold: float, kinds: tuple[str, ...]) -> DataFrame:
    """Relations of at least ``threshold`` that an asserting claim states."""
    ok = claims.where(F.col("kind").isin(*kinds)).select("doc_id", "claim_id")
    return relations.where(F.col("confidence") >= threshold).join(ok, ["doc_id", "claim_id"], "left_semi")


def expand_superlatives(extremes: DataFrame, participants: DataFrame, classes: DataFrame) -> DataFrame:
    """``greater`` relations that "X is the most" stands for: X over every participant of the attribute outside its
    class, with the ``side``. ``extremes(doc_id, claim_id, attribute, entity, side)`` with side max or min (min swaps the
    ends)."""
    c = classes.select("doc_id", "attribute", "entity", "class")
    x = extremes.join(c, ["doc_id", "attribute", "entity"], "left").withColumn("class", F.coalesce("class", "entity"))
    p = participants.join(c, ["doc_id", "attribute", "entity"], "left").select(
        "doc_id", "attribute", F.col("entity").alias("other"), F.coalesce("class", "entity").alias("other_class"))
    top = F.col("side") == "max"
    return x.join(p, ["doc_id", "attribute"]).where("class <> other_class").select(
        "doc_id", "claim_id", "attribute", "side", F.when(top, F.col("entity")).otherwise(F.col("other")).alias("a"),
        F.when(top, F.col("other")).otherwise(F.col("entity")).alias("b"),
    )
