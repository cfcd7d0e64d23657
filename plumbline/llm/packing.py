"""Problem 6: filling fixed-capacity containers with items.

Shallow combinations of lengths that fill a container are enumerated on the histogram of lengths (its size is bounded by
the capacity, not by the data); non-negative least squares finds how often to use each, the counts are rounded down, and
what is left is packed greedily, still on the histogram. Each item then finds its container by its rank among the items
of its length.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.skew import salted_sum
from plumbline.session import parallelism, stage, table

#: Vocabulary file of the public tokenizer.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: How shallow combinations are: so many weighty lengths are tried as the second part of three, and so many lengths as
#: the last part. Every length that occurs is the first part of some.
PARTNERS, COMPLETIONS = 12, 2
#: Lengths that the plan tells apart, as it is made on the driver. In capacities above, lengths are rounded up to whole
#: grains of capacity / LENGTHS, so an item takes at most that much more room than it needs.
LENGTHS = 1 << 15
_ENCODERS: dict = {}


def _encoder(path: str | None):
    import public_tokenizers
    import tiktoken

    path = path or public_tokenizers.path(VOCABULARY)
    if path not in _ENCODERS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding(
            "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
    return _ENCODERS[path]


def token_counts(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``(doc_id, tokens)`` of whole texts in tokens of a public tokenizer; null and empty texts have none and are left
    out, repeated ids count once. ``vocabulary`` is the path of a rank file that every executor can read."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoder(vocabulary)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "tokens": [len(enc.encode_ordinary(t)) for t in pdf["text"]]})

    texts = documents.where("doc_id is not null and length(text) > 0").select("doc_id", "text")
    counted = texts.mapInPandas(count, "doc_id long, tokens long")
    return counted.groupBy("doc_id").agg(F.max("tokens").alias("tokens"))


def combinations(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> np.ndarray:
    """Shallow combinations that fill ``capacity`` to within a small window, a row each: up to three times (index of a
    length, copies), copies 0 where there are fewer parts.

    For each length: copies of it alone, and copies of it with one or two lengths that complete them; the weightiest
    lengths first, as they fill most of the containers. No more copies than there are.
    """
    window = max(1, capacity // 512)
    order = np.argsort(-(lengths * counts), kind="stable")
    partners = order[:PARTNERS]
    none = np.zeros(len(order), np.int64)
    rows, rank = [], np.arange(len(order))

    def add(ok, *parts):
        rows.append(np.stack([rank, *parts], 1)[ok])

    def last(room, back):
        """Index of the ``back``-th longest length that fits into ``room``, and whether it fills it."""
        i = np.searchsorted(lengths, room, "right") - 1 - back
        return np.maximum(i, 0), (i >= 0) & (room > 0) & (lengths[np.maximum(i, 0)] >= room - window)

    size = lengths[order]
    for copies in (capacity // size, np.maximum(1, capacity // (2 * size)), none + 1):
        rest = capacity - copies * size
        full = rest <= window
        add((rest >= 0) & full, order, copies, none, none, none, none)
        for back in range(COMPLETIONS):
            i, ok = last(rest, back)
            add((rest >= 0) & ~full & ok, order, copies, i, none + 1, none, none)
        for p in partners.tolist():
            i, ok = last(rest - lengths[p], 0)
            add((rest >= 0) & ~full & ok, order, copies, none + p, none + 1, i, none + 1)
    c = np.concatenate(rows)
    c = c[np.argsort(c[:, 0], kind="stable"), 1:]
    for x, y in ((0, 2), (0, 4), (2, 4)):  # the same length twice is one part
        same = (c[:, x] == c[:, y]) & (c[:, y + 1] > 0)
        c[same, x + 1] += c[same, y + 1]
        c[same, y + 1] = 0
    c = c[np.all([counts[c[:, x]] >= c[:, x + 1] for x in (0, 2, 4)], 0)]
    _, first = np.unique(c, axis=0, return_index=True)
    return c[np.sort(first)]


def nonnegative_counts(lengths: np.ndarray, counts: np.ndarray, combos: np.ndarray, sweeps: int = 40) -> np.ndarray:
    """How often to use each combination: non-negative least squares against the histogram, weighted by length, by
    coordinate descent. After the first sweep over all combinations those in use are refined, and all again at the end
    of every eighth."""
    weight = lengths / lengths.max()
    parts = [[(i, k * weight[i]) for i, k in ((r[0], r[1]), (r[2], r[3]), (r[4], r[5])) if k] for r in combos.tolist()]
    square = [sum(a * a for _, a in p) for p in parts]
    left = (counts * weight).tolist()
    use = [0.0] * len(parts)
    for sweep in range(sweeps):
        moved = 0.0
        every = sweep % 8 == 0
        for p in range(len(parts)) if every else [p for p, u in enumerate(use) if u]:
            new = max(0.0, use[p] + sum(a * left[i] for i, a in parts[p]) / square[p])
            by = new - use[p]
            if by:
                for i, a in parts[p]:
                    left[i] -= a * by
                moved = max(moved, abs(by))
                use[p] = new
        if every and moved < 0.05:
            break
    return np.array(use)


def plan_containers(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """[(repeats, {length: copies})]: containers that together hold every item of the histogram exactly once."""
    lengths = np.array(sorted(x for x, n in histogram.items() if n > 0), int)
    if not len(lengths):
        return []
    counts = np.array([histogram[x] for x in lengths.tolist()], int)
    left = counts.copy()
    plan: list[tuple[int, dict[int, int]]] = []
    combos = combinations(lengths, counts, capacity)
    use = nonnegative_counts(lengths, counts.astype(float), combos) if len(combos) else np.zeros(0)
    for p in np.argsort(-use, kind="stable").tolist():
        if use[p] < 0.5:
            break
        c = [(int(combos[p, x]), int(combos[p, x + 1])) for x in (0, 2, 4) if combos[p, x + 1]]
        n = min([int(use[p] + 0.5), *[int(left[i]) // k for i, k in c]])
        if n > 0:
            plan.append((n, {int(lengths[i]): k for i, k in c}))
            for i, k in c:
                left[i] -= n * k
    # the rest: the largest item first, then always the largest that fits, each filling repeated while it can be
    alive = np.flatnonzero(left)
    while len(alive):
        room, c, got = capacity, {}, {}
        top = len(alive)
        while room > 0:
            k = int(np.searchsorted(lengths[alive[:top]], room, "right")) - 1
            if k < 0:
                break
            i = int(alive[k])
            x = int(lengths[i])
            take = min(int(left[i]) - got.get(i, 0), room // x)
            if take > 0:
                c[x] = c.get(x, 0) + take
                got[i] = got.get(i, 0) + take
                room -= take * x
            top = k
            if top == 0:
                break
        n = min(int(left[i]) // k for i, k in got.items())
        plan.append((n, c))
        for i, k in got.items():
            left[i] -= n * k
        alive = alive[left[alive] > 0]
    return plan


class Slots:
    """The plan as sorted arrays: for each length, intervals of ranks and the containers they go to."""

    def __init__(self, plan: list[tuple[int, dict[int, int]]]):
        used: dict[int, int] = {}
        rows = []
        base = 0
        for n, c in plan:
            place = offset = 0
            for x in sorted(c, reverse=True):
                rows.append((x, used.get(x, 0), base, c[x], place, offset))
                used[x] = used.get(x, 0) + n * c[x]
                place += c[x]
                offset += c[x] * x
            base += n
        self.containers = base
        rows.sort()
        self.rows = np.array(rows, np.int64).reshape(-1, 6)
        self.key = (self.rows[:, 0] << 40) + self.rows[:, 1]

    def find(self, length: np.ndarray, rank: np.ndarray):
        """(container, position, offset) of the ``rank``-th item of each ``length``."""
        k = np.searchsorted(self.key, (length << 40) + rank, "right") - 1
        _, start, base, copies, place, offset = self.rows[k].T
        turn = rank - start
        slot = turn % copies
        return base + turn // copies, place + slot, offset + slot * length


def pack(sizes: DataFrame, capacities: DataFrame) -> DataFrame:
    """``(capacity_id, container_id, position, start, doc_id, piece, first_token, tokens)``.

    ``sizes(doc_id, tokens)``, ``capacities(capacity_id, capacity_tokens)``. Every document with tokens gets one piece
    in one container of every capacity, at ``start`` tokens from its beginning; only one that exceeds the capacity is
    cut, into full containers and a last piece. Capacities that are null or not positive are left out; repeated ones
    count once. The plan's size depends on the capacity only; ranks are counted in salted parts, so a length that a
    third of all items have is never gathered.
    """
    spark = sizes.sparkSession
    caps = {r[0]: int(r[1]) for r in capacities.select("capacity_id", "capacity_tokens").dropna().where("capacity_tokens > 0").orderBy("capacity_id").collect()}
    schema = "capacity_id int, container_id long, position int, start int, doc_id long, piece int, first_token long, tokens int"
    if not caps:
        return spark.createDataFrame([], schema)
    listed = F.explode(F.array(*[F.struct(F.lit(i).cast("int").alias("capacity_id"), F.lit(c).alias("cap")) for i, c in caps.items()]))
    per = sizes.where("tokens > 0").select("doc_id", "tokens", listed.alias("c")).select("doc_id", "tokens", "c.*")
    full = F.when(F.col("tokens") > F.col("cap"), F.floor(F.col("tokens") / F.col("cap"))).otherwise(0)
    per = per.withColumn("full", full).withColumn("rest", F.col("tokens") - F.col("full") * F.col("cap"))
    grain = F.greatest(F.lit(1), F.ceil(F.col("cap") / LENGTHS))
    per = per.withColumn("grain", grain).withColumn("bin", F.least(F.ceil(F.col("rest") / F.col("grain")), F.floor(F.col("cap") / F.col("grain"))))
    per = stage(per)
    plans: dict[int, Slots] = {}
    seen: dict[int, dict[int, int]] = {i: {} for i in caps}
    for r in per.where("rest > 0").groupBy("capacity_id", "bin").agg(F.count("*").alias("n")).collect():
        seen[r["capacity_id"]][r["bin"]] = r["n"]
    for i, c in caps.items():
        plans[i] = Slots(plan_containers(seen[i], c // max(1, -(-c // LENGTHS))))
    held = spark.sparkContext.broadcast(plans)
    buckets = F.pmod(F.xxhash64("doc_id"), F.lit(parallelism(spark)))
    ranked = salted_sum(
        per.where("rest > 0").select("capacity_id", "doc_id", "full", "cap", "rest", "bin", "grain"), ["capacity_id", "bin"],
        [F.col("doc_id")], buckets, "rank",
    )

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, g in pdf.groupby("capacity_id"):
                box, position, start = held.value[i].find(g["bin"].to_numpy(), g["rank"].to_numpy())
                start = start * g["grain"].to_numpy()
                yield pd.DataFrame({
                    "capacity_id": g["capacity_id"], "container_id": box, "position": position, "start": start,
                    "doc_id": g["doc_id"], "piece": g["full"], "first_token": g["full"] * g["cap"], "tokens": g["rest"],
                })

    placed = ranked.mapInPandas(place, schema)
    whole = salted_sum(
        per.where("full > 0").select("capacity_id", "doc_id", "full", "cap"), ["capacity_id"], [F.col("doc_id")],
        buckets, "before", F.col("full"),
    )
    base = F.coalesce(*[F.when(F.col("capacity_id") == i, F.lit(plans[i].containers)) for i in caps])
    whole = whole.select(
        "capacity_id", "doc_id", "cap", (base + F.col("before")).alias("first"),
        F.explode(F.sequence(F.lit(0), (F.col("full") - 1).cast("int"))).alias("piece"),
    ).select(
        "capacity_id", (F.col("first") + F.col("piece")).cast("long").alias("container_id"),
        F.lit(0).alias("position"), F.lit(0).alias("start"), "doc_id", "piece",
        (F.col("piece") * F.col("cap")).cast("long").alias("first_token"), F.col("cap").cast("int").alias("tokens"),
    )
    return placed.unionByName(whole)


def p6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = stage(token_counts(table(spark, sf_dir, "documents")))
    return pack(sizes, table(spark, sf_dir, "capacities"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per capacity: containers, tokens, and the share of the containers' room that they fill."""
    packed = p6_packing(spark, sf_dir)
    boxes = packed.groupBy("capacity_id", "container_id").agg(F.sum("tokens").alias("filled"))
    per = boxes.groupBy("capacity_id").agg(F.count("*").alias("containers"), F.sum("filled").alias("tokens"))
    return per.join(table(spark, sf_dir, "capacities"), "capacity_id").withColumn(
        "fill", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))
    )
