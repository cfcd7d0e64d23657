"""Graphs of many documents at once: those of a bounded size are solved in Arrow batches, larger ones as tables.

A document's rows become arrays of one row; a task sees a batch of documents, numbers their nodes and solves all of them
together in NumPy. What holds for a document does not depend on which way it went.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import stage

_ARROW = {
    "int": pa.int32(), "bigint": pa.int64(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(),
}
#: Rows a document may have to be solved as one; documents with more go through distributed rounds.
MOST = 1024


def labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component: hooking and pointer jumping."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while (new != (up := new[new])).any():
            new = up
        if (new == label).all():
            return label
        label = new


def cyclic(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Which edges remain when nodes without a way in or out are taken off again and again: none without a cycle."""
    alive = np.ones(len(u), bool)
    while True:
        enters, leaves = np.zeros(n, bool), np.zeros(n, bool)
        enters[v[alive]] = True
        leaves[u[alive]] = True
        kept = alive & enters[u] & leaves[v]
        if (kept == alive).all():
            return alive
        alive = kept


def numbered(*parts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(numbers of the nodes of each part, the distinct nodes' columns): each part is a list of columns."""
    columns = [np.concatenate(c) for c in zip(*parts)]
    codes = [np.unique(c, return_inverse=True) for c in columns]
    key = codes[0][1].astype(np.int64)
    for names, code in codes[1:]:
        key = key * max(1, len(names)) + code
    _, first, where = np.unique(key, return_index=True, return_inverse=True)
    cuts = np.cumsum([len(p[0]) for p in parts])[:-1]
    return np.split(where, cuts), [c[first] for c in columns]


def solve(
    rows: DataFrame, columns: list[str], kernel: Callable, schema: str, large: Callable[[DataFrame], DataFrame],
    most: int | None = None,
) -> DataFrame:
    """``kernel(doc, columns...)`` over batches of documents, and ``large(rows)`` for documents with over ``most`` rows.

    ``rows`` is staged and has ``doc_id``; the kernel gets each row's document number and the columns as arrays, and
    returns (document numbers, columns of the result). ``schema`` starts with ``doc_id``. Rows with a null in one of the
    columns are left out.
    """
    most = MOST if most is None else most
    rows = rows.where(F.col("doc_id").isNotNull()).dropna(subset=columns)
    big = stage(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > most).select("doc_id"))
    any_big = not big.isEmpty()
    small = rows.join(big, "doc_id", "left_anti") if any_big else rows
    packed = small.groupBy("doc_id").agg(F.collect_list(F.struct(*columns)).alias("x"))
    packed = packed.select("doc_id", *[F.col(f"x.{c}").alias(c) for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lists = [b.column(c) for c in columns]
            sizes = np.diff(lists[0].offsets.to_numpy())
            doc = np.repeat(np.arange(b.num_rows), sizes)
            at, out = kernel(doc, *[x.flatten().to_numpy(zero_copy_only=False) for x in lists])
            docs = b.column("doc_id").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([docs, *[pa.array(x, k) for x, k in zip(out, kinds)]], names)

    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [_ARROW[c.split()[1]] for c in schema.split(", ")[1:]]
    found = packed.mapInArrow(run, schema)
    return found.unionByName(large(rows.join(big, "doc_id", "left_semi"))) if any_big else found
