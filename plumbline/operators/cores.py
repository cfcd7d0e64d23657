"""Whether a document's facts can all hold, and the smallest lists of them that cannot."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.entity_graph import equality_classes
from plumbline.operators.per_document import cyclic, labels, numbered, solve
from plumbline.session import stage


def _groups(doc: np.ndarray, attribute: np.ndarray):
    """The rows of each document and attribute, as (document, attribute, row numbers in their order)."""
    (group,), names = numbered([doc, attribute])
    order = np.argsort(group, kind="stable")
    for mine in np.split(order, np.flatnonzero(np.diff(group[order])) + 1) if len(order) else []:
        yield names[0][group[mine[0]]], names[1][group[mine[0]]], mine


def _too_large(what: str, columns: list[str], schema: str):
    """Documents above the bound have no exact way here, so they fail loudly."""

    def large(rows: DataFrame) -> DataFrame:
        raise ValueError(f"{what}: a document has more rows than are solved at once, see per_document.MOST")

    return large


def fits(n: int, apart: list[tuple[int, int]], named: dict[int, object], most: int) -> bool:
    """Whether ``n`` classes can take at most ``most`` values: different ones where ``apart`` says so, the given value
    where ``named`` has one. The class with the fewest values left comes next."""
    values = {v: i for i, v in enumerate(sorted(set(named.values()), key=repr))}
    if len(values) > most or any(a == b for a, b in apart):
        return False
    near: list[set[int]] = [set() for _ in range(n)]
    for a, b in apart:
        near[a].add(b)
        near[b].add(a)
    value = {c: values[v] for c, v in named.items()}
    if any(value[b] == v for a, v in value.items() for b in near[a] if b in value):
        return False

    def place() -> bool:
        free = [c for c in range(n) if c not in value]
        if not free:
            return True
        taken = lambda c: {value[x] for x in near[c] if x in value}
        c = max(free, key=lambda c: (len(taken(c)), len(near[c]), -c))
        seen = max([len(values) - 1, *value.values()])
        for v in range(min(most, seen + 2)):  # values that nothing has yet are alike: one of them is enough
            if v not in taken(c):
                value[c] = v
                if place():
                    return True
                del value[c]
        return False

    return place()


def within_values(facts: DataFrame, most: DataFrame) -> DataFrame:
    """``(doc_id, attribute, fits)``: whether each attribute's entities can do with as many values as it has.

    ``facts(doc_id, attribute, kind, a, b, value)`` of kind ``same`` or ``different`` (of a and b) or ``value`` (of a);
    ``most(doc_id, attribute, most)``. Equal entities are one class; a class with two named values does not fit.
    Documents of more than ``per_document.MOST`` facts raise: colouring has no distributed exact way.
    """
    t = dict(facts.dtypes)
    r = facts.select("doc_id", "attribute", "kind", "a", F.coalesce("b", "a").alias("b"), F.coalesce(F.col("value").cast("string"), F.lit("")).alias("value"))
    r = r.join(most.select("doc_id", "attribute", F.col("most").cast("int").alias("most")).distinct(), ["doc_id", "attribute"])
    columns = ["attribute", "kind", "a", "b", "value", "most"]

    def kernel(doc, att, kind, a, b, value, most_):
        at, names, out = [], [], []
        for d, x, mine in _groups(doc, att):
            ids, where = np.unique(np.concatenate([a[mine], b[mine]]), return_inverse=True)
            u, v, k = where[: len(mine)], where[len(mine) :], kind[mine]
            part = labels(len(ids), u[k == "same"], v[k == "same"])
            _, part = np.unique(part, return_inverse=True)
            named: dict[int, object] = {}
            ok = True
            for c, val in zip(part[u[k == "value"]].tolist(), value[mine][k == "value"].tolist()):
                ok &= named.setdefault(c, val) == val
            apart = list(zip(part[u[k == "different"]].tolist(), part[v[k == "different"]].tolist()))
            at.append(d)
            names.append(x)
            out.append(ok and fits(int(part.max()) + 1, apart, named, int(most_[mine[0]])))
        return np.array(at, np.int64), [names, np.array(out, bool)]

    schema = f"doc_id {t['doc_id']}, attribute {t['attribute']}, fits boolean"
    return solve(stage(r), columns, kernel, schema, _too_large("values", columns, schema))


def _clash(kind: np.ndarray, u: np.ndarray, v: np.ndarray, n: int, binary: bool) -> bool:
    """Whether relations contradict each other: a difference inside a class, an odd cycle of differences in a binary
    attribute, or an order cycle over the classes."""
    same = kind == 0
    part = labels(n, u[same], v[same])
    u, v = part[u], part[v]
    apart, above = kind == 1, kind == 2
    if (u[apart] == v[apart]).any() or cyclic(n, u[above], v[above]).any():
        return True
    if not binary:
        return False
    a, b = u[apart], v[apart]
    cover = labels(2 * n, np.concatenate([2 * a, 2 * a + 1]), np.concatenate([2 * b + 1, 2 * b]))
    return bool((cover[2 * a] == cover[2 * a + 1]).any())


def minimal_cores(relations: DataFrame, arity: DataFrame) -> DataFrame:
    """``(doc_id, attribute, rel_id)``: for every attribute that contradicts itself one minimal list of relations that
    do; in the order of ``rel_id`` each relation is left out if the others still contradict each other.

    Documents of more than ``per_document.MOST`` relations raise, as deletion goes through them one by one.
    """
    t = dict(relations.dtypes)
    binary = arity.where("arity = 'binary'").select("doc_id", "attribute", F.lit(True).alias("binary")).distinct()
    r = relations.select("doc_id", "attribute", "rel_id", "kind", "a", "b").join(binary, ["doc_id", "attribute"], "left")
    r = r.withColumn("binary", F.coalesce("binary", F.lit(False)))
    columns = ["attribute", "rel_id", "kind", "a", "b", "binary"]
    number = {"same": 0, "different": 1, "greater": 2}

    def kernel(doc, att, rel, kind, a, b, two):
        at, names, out = [], [], []
        for d, x, mine in _groups(doc, att):
            mine = mine[np.argsort(rel[mine], kind="stable")]
            ids, where = np.unique(np.concatenate([a[mine], b[mine]]), return_inverse=True)
            u, v = where[: len(mine)], where[len(mine) :]
            k = np.array([number.get(y, 3) for y in kind[mine]])
            keep, n, pair = np.ones(len(mine), bool), len(ids), bool(two[mine[0]])
            if not _clash(k, u, v, n, pair):
                continue
            for i in range(len(mine)):
                keep[i] = False
                keep[i] = not _clash(k[keep], u[keep], v[keep], n, pair)
            at += [d] * int(keep.sum())
            names += [x] * int(keep.sum())
            out += rel[mine][keep].tolist()
        return np.array(at, np.int64), [names, out]

    schema = f"doc_id {t['doc_id']}, attribute {t['attribute']}, rel_id {t['rel_id']}"
    return solve(stage(r), columns, kernel, schema, _too_large("cores", columns, schema))


def one_identity(facts: DataFrame, identity: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts with subjects by their identity, documents whose identities contradict each other).

    ``identity(doc_id, kind, a, b)`` says that two names are one subject (``conflate``) or two (``distinct``); a subject
    goes by the smallest of its names.
    """
    same = identity.where("kind = 'conflate'").select("doc_id", F.lit(0).alias("attribute"), F.lit("same").alias("kind"), "a", "b")
    classes = stage(equality_classes(same).select("doc_id", F.col("entity").alias("subject"), "class"))
    side = lambda k: classes.select("doc_id", F.col("subject").alias(k), F.col("class").alias(f"c{k}"))
    apart = identity.where("kind = 'distinct'").join(side("a"), ["doc_id", "a"], "left").join(side("b"), ["doc_id", "b"], "left")
    bad = apart.where(F.coalesce("ca", "a") == F.coalesce("cb", "b")).select("doc_id").distinct()
    out = facts.join(classes, ["doc_id", "subject"], "left").withColumn("subject", F.coalesce("class", "subject")).drop("class")
    return out, bad
