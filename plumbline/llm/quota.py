"""Problem 4: a sample that matches target category proportions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.skew import lookup_join, salted_sum
from plumbline.session import stage, table

DIMENSIONS = ["plant_type", "level", "provider", "genre"]
#: Acceptance probabilities are raised by this factor, so that most cells need only be cut down afterwards.
OVERSAMPLE = 1.15
SEED = 7


def name_key(c: Column) -> Column:
    """Names are the same if they differ only in case, outer blanks or separators."""
    return F.trim(F.regexp_replace(F.lower(c.cast("string")), r"[\s\p{Z}_\p{Pd}]+", " "))


def clean_units(units: DataFrame, dimensions: list[str]) -> DataFrame:
    """One row per run and unit with normal names; of differing repeats, the greatest name that is not null."""
    named = units.select("unit_id", name_key(F.col("run")).alias("run"), *[name_key(F.col(d)).alias(d) for d in dimensions])
    named = named.where("unit_id is not null and run is not null")
    return named.groupBy("run", "unit_id").agg(*[F.max(d).alias(d) for d in dimensions])


def category_counts(units: DataFrame, targets: DataFrame, dimensions: list[str]) -> DataFrame:
    """Each target row with ``called_for`` and ``available``, the distinct units of its category in its run."""
    cats = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("cat")) for d in dimensions]))
    have = (
        units.select("run", cats.alias("c")).select(F.col("run").alias("run_key"), "c.*").where("cat is not null")
        .groupBy("run_key", "dimension", "cat").agg(F.count("*").alias("available"))
    )
    want = targets.select("run", "sample_size", "dimension", "category", "share_pct", "min_count").distinct().select(
        "*", name_key(F.col("run")).alias("run_key"), name_key(F.col("category")).alias("cat"),
        F.greatest(F.col("sample_size") * F.col("share_pct") / 100, F.col("min_count").cast("double")).alias("called_for"),
    )
    return want.join(have, ["run_key", "dimension", "cat"], "left").fillna(0, ["available"])


def _whole(parts: np.ndarray, total: int, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whole numbers near ``parts`` between ``least`` and ``most``, with sum ``total`` where these allow it."""
    base = np.clip(np.floor(parts), least, most).astype(int)
    while base.sum() < total and (base < most).any():
        base[int(np.argmax(np.where(base < most, (parts - base) / np.maximum(parts, 1), -np.inf)))] += 1
    while base.sum() > total and (base > least).any():
        base[int(np.argmax(np.where(base > least, base - parts, -np.inf)))] -= 1
    return base


def _plan_run(cells: pd.DataFrame, goals: pd.DataFrame, dimensions: list[str]) -> pd.DataFrame:
    """Acceptance probability and exact quota of each cell of one run, by raking the cells to the goals."""
    n = cells["n"].to_numpy(float)
    size = int(goals["sample_size"].max()) if len(goals) else 0
    wants, member = [], []
    for d in dimensions:
        g = goals[goals["dimension"] == d]
        cats = list(g["cat"])
        share = (g["share_pct"].to_numpy(float) / 100) * size
        least = g["min_count"].to_numpy(int)
        have = np.array([n[(cells[d] == c).to_numpy()].sum() for c in cats])
        least = np.minimum(least, have)
        want = _whole(np.maximum(share, least), size, least, have) if len(cats) else share
        for c, w in zip(cats, want):
            wants.append(float(w))
            member.append((cells[d] == c).to_numpy())
        if len(cats):
            # what no target lists is not asked for
            wants.append(0.0)
            member.append(~cells[d].isin(cats).to_numpy())
    m = np.array(member, bool).reshape(-1, len(n))
    q = n * min(1.0, size / max(n.sum(), 1))
    for _ in range(60):
        for row, w in zip(m, wants):
            have = q[row].sum()
            if have > 0:
                q[row] = np.minimum(n[row], q[row] * (w / have))
    quota = np.minimum(np.floor(q), n).astype(int)
    goal = np.array(wants)
    off = goal - m @ quota  # by category: units still missing
    mi = m.astype(int)
    inside = mi.sum(0)
    for _ in range(8 * size + 100):
        # the squared shortfall falls by adding a unit of cell i, by dropping one of cell j, or by both
        add = np.where(quota < n, inside - 2 * (mi.T @ off), np.inf)
        i = int(np.argmin(add))
        if quota.sum() < size and (add[i] < 0 or (np.isfinite(add[i]) and off.sum() > 0)):
            quota[i] += 1
            off = off - mi[:, i]
            continue
        if not np.isfinite(add[i]):
            break
        after = off - mi[:, i]
        cut = np.where(quota > 0, inside + 2 * (mi.T @ after), np.inf)
        j = int(np.argmin(cut))
        if add[i] + cut[j] >= 0:
            break
        quota[i] += 1
        quota[j] -= 1
        off = after + mi[:, j]
    p = np.minimum(1.0, OVERSAMPLE * np.maximum(q, quota) / np.maximum(n, 1))
    return pd.DataFrame({"cell": cells["cell"], "probability": p, "quota": quota})


def least_shortfall(cells: pd.DataFrame, goals: pd.DataFrame, dimensions: list[str], rounds: int = 300) -> float:
    """A proven lower bound of the units by which any sample of one run must fall short of all its goals together.

    Lagrangian: with a price from 0 to 1 on every goal, no sample of the size can earn more than the cells with the
    highest prices, each up to its units; what the goals cost beyond that is missing whatever is drawn. The prices are
    raised and lowered by subgradients; every one of them gives a valid bound, the best is kept.
    """
    n = cells["n"].to_numpy(float)
    size = float(goals["sample_size"].max()) if len(goals) else 0.0
    want = np.maximum(goals["sample_size"].to_numpy(float) * goals["share_pct"].to_numpy(float) / 100, goals["min_count"].to_numpy(float))
    want = np.floor(want + 1e-9)
    member = np.array([(cells[d] == c).to_numpy() for d, c in zip(goals["dimension"], goals["cat"])], float).reshape(len(goals), len(n))
    price, best = np.full(len(goals), 0.5), 0.0
    for step in range(rounds):
        worth = price @ member
        order = np.argsort(-worth, kind="stable")
        before = np.concatenate([[0.0], np.cumsum(n[order])[:-1]])
        take = np.zeros(len(n))
        take[order] = np.clip(size - before, 0, n[order])
        best = max(best, float(price @ want - worth @ take))
        price = np.clip(price + (want - member @ take) / max(size, 1) / (1 + step / 20), 0, 1)
    return best


def shortfalls(units: DataFrame, targets: DataFrame, dimensions: list[str] = DIMENSIONS) -> DataFrame:
    """``(run, least_shortfall)`` of every run that ``targets`` names: what no sample can avoid, over all its goals."""
    keyed = clean_units(units, dimensions)
    counts = keyed.groupBy("run", *dimensions).agg(F.count("*").alias("n"))
    want = targets.select(
        name_key(F.col("run")).alias("run"), "dimension", name_key(F.col("category")).alias("cat"), "sample_size", "share_pct", "min_count"
    ).dropna().distinct()
    dims = list(dimensions)

    def bound(key, cells, goals):
        if not len(goals):
            return pd.DataFrame({"run": np.empty(0, object), "least_shortfall": np.empty(0)})
        return pd.DataFrame({"run": [key[0]], "least_shortfall": [least_shortfall(cells, goals, dims)]})

    return counts.groupBy("run").cogroup(want.groupBy("run")).applyInPandas(bound, "run string, least_shortfall double")


def draw(units: DataFrame, targets: DataFrame, dimensions: list[str] = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """``(run, unit_id, accepted)``: the sample of every run that ``targets`` names (names in normal form).

    Acceptance probabilities follow from the ratio of target to observed counts, raked over all dimensions on the
    table of category combinations (its size is bounded by the product of the categories); each unit is accepted by a
    keyed hash with slight oversampling. Counts are then made exact: a combination with more accepted units than its
    quota keeps those with the smallest hashes, one with fewer is filled up with rejected ones (not ``accepted``).
    Units without a run or id, and units in a category that no target of their run lists, are not drawn. Empty tables
    give an empty sample.
    """
    return _drawn(stage(clean_units(units, dimensions)), targets, dimensions, seed).select("run", "unit_id", "accepted")


def _drawn(u: DataFrame, targets: DataFrame, dimensions: list[str], seed: int) -> DataFrame:
    """``draw`` from clean units, with their categories."""
    cell = F.concat_ws("|", "run", *[F.coalesce(d, F.lit("\u0000")) for d in dimensions])
    keyed = u.withColumn("cell", cell)
    want = targets.select(
        name_key(F.col("run")).alias("run"), "dimension", name_key(F.col("category")).alias("cat"), "sample_size",
        "share_pct", "min_count",
    ).dropna()
    counts = keyed.groupBy("run", "cell", *dimensions).agg(F.count("*").alias("n"))
    dims = list(dimensions)

    def plan(key, cells, goals):
        if not len(cells) or not len(goals):
            return pd.DataFrame({"cell": np.empty(0, object), "probability": np.empty(0), "quota": np.empty(0, "int64")})
        return _plan_run(cells, goals, dims)

    quotas = stage(
        counts.groupBy("run").cogroup(want.groupBy("run"))
        .applyInPandas(plan, "cell string, probability double, quota long").where("quota > 0")
    )
    sizes = counts.select("cell", "n")
    u01 = (F.xxhash64(F.lit(seed), "run", "unit_id").bitwiseAND(F.lit((1 << 52) - 1))) / F.lit(float(1 << 52))
    tried = lookup_join(keyed.select("run", "unit_id", "cell", *dims), quotas, "cell", sizes, "inner").withColumn("u", u01)
    tried = stage(tried.withColumn("accepted", F.col("u") < F.col("probability")).drop("probability"))
    order, bucket = [F.col("u"), F.col("unit_id")], F.floor(F.col("u") * 64)
    # what was accepted beyond the quota goes; where too little was, units that were rejected fill up
    kept = salted_sum(tried.where("accepted"), ["cell"], order, bucket, "rank").where("rank < quota")
    enough = tried.where("accepted").groupBy("cell").agg(F.count("*").alias("accepts"))
    short = quotas.select("cell", "quota").join(enough, "cell", "left").select("cell", (F.col("quota") - F.coalesce("accepts", F.lit(0))).alias("lacks"))
    short = stage(short.where("lacks > 0"))
    rest = tried.where("not accepted")
    if short.isEmpty():
        filled = rest.where("false").withColumn("rank", F.lit(0).cast("long"))
    else:
        left = rest.groupBy("cell").agg(F.count("*").alias("n"))
        rest = lookup_join(rest, short, "cell", left, "inner")
        filled = salted_sum(rest, ["cell"], order, bucket, "rank").where("rank < lacks").drop("lacks")
    return kept.unionByName(filled).select("run", "unit_id", *dims, "accepted")


def deficits(units: DataFrame, targets: DataFrame, dimensions: list[str] = DIMENSIONS) -> DataFrame:
    """Target rows that the sample of their run cannot meet: units ``drawn`` of the category and those to
    ``spare``, all that a further correction could add, number fewer than called for. ``available`` is their sum.

    Null names count for no category; empty ``units`` make every row that calls for any unit a deficit.
    """
    clean = stage(clean_units(units, dimensions))
    sample = stage(_drawn(clean, targets, dimensions, SEED))
    all_, named = category_counts(clean, targets, dimensions), ["run", "dimension", "category", "sample_size", "share_pct", "min_count"]
    got = category_counts(sample, targets, dimensions).select(*named, F.col("available").alias("drawn"))
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in named]
    met = all_.alias("x").join(got.alias("y"), same, "left").select("x.*", F.coalesce("drawn", F.lit(0)).alias("drawn"))
    met = met.withColumn("spare", F.col("available") - F.col("drawn"))
    return met.where(F.col("drawn") + F.col("spare") < F.col("called_for"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deficits(table(spark, sf_dir, "units"), table(spark, sf_dir, "targets"))
    return found.select("run", "dimension", "category").distinct()


def p4_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draw(table(spark, sf_dir, "units"), table(spark, sf_dir, "targets"))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target row: units called for, available, drawn and missing; and for its run how many units are missing over
    all rows, and how many any sample of the size must miss at least."""
    units, targets = table(spark, sf_dir, "units"), table(spark, sf_dir, "targets")
    clean = stage(clean_units(units, DIMENSIONS))
    sample = draw(units, targets).select("run", "unit_id")
    got = category_counts(clean.join(sample, ["run", "unit_id"], "left_semi"), targets, DIMENSIONS)
    got = got.select("run", "dimension", "category", F.col("available").alias("drawn"))
    all_ = category_counts(clean, targets, DIMENSIONS).select("run", "dimension", "category", "called_for", "available")
    rows = stage(all_.join(got, ["run", "dimension", "category"]).withColumn("missing", F.greatest(F.floor(F.col("called_for") + 1e-9) - F.col("drawn"), F.lit(0))))
    per = rows.groupBy("run").agg(F.sum("missing").alias("run_missing"))
    least = shortfalls(units, targets).withColumnRenamed("run", "key")
    per = per.withColumn("key", name_key(F.col("run"))).join(least, "key", "left").drop("key")
    return rows.join(per, "run")


_KEY = "trim(regexp_replace(lower(cast({} as varchar)), '[\\s\\p{{Z}}_\\p{{Pd}}]+', ' ', 'g'))"
P4_FOUND_SQL = f"""
with u as (
  select distinct unit_id, {_KEY.format("run")} run, d.dimension, {_KEY.format("d.cat")} cat
  from (select unit_id, run, unnest([
      {{'dimension': 'plant_type', 'cat': plant_type}}, {{'dimension': 'level', 'cat': cast(level as varchar)}},
      {{'dimension': 'provider', 'cat': provider}}, {{'dimension': 'genre', 'cat': genre}}]) d from units)
  where d.cat is not null and run is not null and unit_id is not null),
c as (select run, dimension, cat, count(distinct unit_id) n from u group by all)
select distinct t.run, t.dimension, t.category from targets t left join c
  on c.run = {_KEY.format("t.run")} and c.dimension = t.dimension and c.cat = {_KEY.format("t.category")}
where coalesce(c.n, 0) < greatest(t.sample_size * t.share_pct / 100, t.min_count)
"""
