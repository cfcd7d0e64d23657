"""Problem 3: splits that keep related records together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators.components import connected_components
from plumbline.operators.skew import lookup_join, salted_sum
from plumbline.session import stage, table

#: Components above this share of all records, at most its inverse in number, are placed one by one.
LARGE = 0.005
BASE = r"^[\s\p{Z}]*([a-z]{2})[\s\p{Z}_\p{Pd}]*0*([0-9]+)[\s\p{Z}_\p{Pd}]*([a-z]?)[\s\p{Z}]*$"


def base_key(base_id: Column) -> Column:
    """``bp-158b`` for ``BP_00000158-B`` and the like; null for what names no base."""
    low = F.lower(base_id)
    part = [F.regexp_extract(low, BASE, i) for i in (1, 2, 3)]
    return F.when(low.rlike(BASE), F.concat(part[0], F.lit("-"), part[1], part[2]))


def label_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[\s\p{Z}_\p{Pd}]+", " "))


def latest_records(records: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """One row per record: the one exported last, with its base key, relations and ``labels``; texts stay unread.
    Records without an id are dropped."""
    cols = list(dict.fromkeys(["base_id", "doc_id", "derived_from", *(labels or [])]))
    last = F.max_by(F.struct(*cols), F.struct(F.col("exported_at"), F.hash(*cols)))
    one = records.where("record_id is not null").groupBy("record_id").agg(last.alias("x")).select("record_id", "x.*")
    return one.withColumn("base", base_key(F.col("base_id")))


def group_records(records: DataFrame) -> DataFrame:
    """``(record_id, group_id, group_size)`` for every record; ``records`` as of ``latest_records``.

    Records are related through a common base or through ``derived_from``; ``group_id`` is the smallest record of all
    related ones. Each base is first reduced to its smallest record by a grouped minimum, so the components are sought
    among bases and base-less records only and a base of any size is never gathered. Null bases, and ``derived_from``
    that names no record, relate nothing.
    """
    r = stage(records.select("record_id", "doc_id", "base", "derived_from"))
    bases = r.where("base is not null").groupBy("base").agg(F.min("record_id").alias("rep"), F.count("*").alias("n"))
    counts = bases.select("base", "n")
    with_node = lookup_join(r, bases.select("base", "rep"), "base", counts)
    nodes = stage(with_node.select("record_id", "doc_id", "derived_from", F.coalesce("rep", "record_id").alias("node")))
    named = nodes.where("derived_from is not null").groupBy(F.col("derived_from").alias("doc_id")).agg(
        F.count("*").alias("n"))
    targets = nodes.where("doc_id is not null").join(named.select("doc_id"), "doc_id", "left_semi")
    docs = targets.groupBy("doc_id").agg(F.min("node").alias("doc_node"))
    same = targets.select("doc_id", "node").distinct().join(docs, "doc_id")
    derived = nodes.where("derived_from is not null").select(F.col("derived_from").alias("doc_id"), "node").distinct()
    made = lookup_join(derived, docs, "doc_id", named, "inner")
    edges = same.unionByName(made).select(F.col("node").alias("u"), F.col("doc_node").alias("v"))
    comp = connected_components(edges)
    sized = bases.select(F.col("rep").alias("node"), "base", "n").unionByName(
        r.where("base is null").select(
            F.col("record_id").alias("node"), F.lit(None).cast("string").alias("base"), F.lit(1).cast("long").alias("n"))
    )
    placed = sized.join(comp, "node", "left").withColumn("group_id", F.coalesce("component", "node"))
    sizes = placed.groupBy("group_id").agg(F.sum("n").alias("group_size"))
    placed = stage(placed.join(sizes, "group_id").select("node", "base", "group_id", "group_size"))
    of_base = placed.where("base is not null").select("base", "group_id", "group_size")
    lone = placed.where("base is null").select(F.col("node").alias("record_id"), "group_id", "group_size")
    via_base = lookup_join(r.where("base is not null").select("record_id", "base"), of_base, "base", counts, "inner")
    return via_base.select("record_id", "group_id", "group_size").unionByName(lone)


def stratified_splits(records: DataFrame, plan: DataFrame, labels: list[str]) -> DataFrame:
    """``(record_id, group_id, split)``: all records of a group in one split, shares of ``plan(split, share_pct)``.

    Grouped iterative stratification over ``labels`` (columns; spellings that differ in case, blanks or separators are
    one label). The rarest label that is still outstanding comes first; its groups go to the splits in proportion to
    what each still needs of that label, the neediest first. Groups above ``LARGE`` of all records, a bounded number,
    are placed one by one before. Every record gets a split; null labels count for no label.
    """
    r = latest_records(records, labels)
    g = stage(group_records(r).select("record_id", "group_id"))
    want = {x["split"]: float(x["share_pct"]) for x in plan.select("split", "share_pct").dropna().distinct().collect()}
    whole = sum(want.values())
    shares = {s: p / whole for s, p in sorted(want.items())}
    marks = F.explode(F.array_compact(F.array(
        F.lit("all"), *[F.concat(F.lit(f"{c}="), label_key(F.col(c).cast("string"))) for c in labels])))
    long = stage(
        r.select("record_id", *labels).join(g, "record_id").select("group_id", marks.alias("label")).groupBy("group_id", "label").agg(
            F.count("*").alias("n"))
    )
    totals = {x["label"]: x["n"] for x in long.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    if len(totals) > 500:
        raise ValueError("stratification labels must be categories, at most 500 of them")
    if not totals:
        return g.withColumn("split", F.lit(None).cast("string"))
    need = {(s, lab): p * n for s, p in shares.items() for lab, n in totals.items()}
    left = dict(totals)
    spark = records.sparkSession
    big: list[tuple[int, str]] = []
    cut = LARGE * totals["all"]
    large = long.where("label = 'all'").where(F.col("n") > cut).select("group_id")
    vectors: dict[int, dict[str, int]] = {}
    for x in long.join(F.broadcast(large), "group_id", "left_semi").collect():
        vectors.setdefault(x["group_id"], {})[x["label"]] = x["n"]
    for gid, vec in sorted(vectors.items(), key=lambda x: (-x[1]["all"], x[0])):
        rare = min((lab for lab in vec if lab != "all"), key=lambda lab: (left[lab], lab), default="all")
        to = max(shares, key=lambda s: (need[s, rare], need[s, "all"], s))
        big.append((gid, to))
        for lab, n in vec.items():
            need[to, lab] -= n
            left[lab] -= n
    done = spark.createDataFrame(big, "group_id long, split string")
    parts = [done]
    rest = stage(long.join(F.broadcast(large), "group_id", "left_anti"))
    while any(n > 0 for n in left.values()):
        rare = min((lab for lab, n in left.items() if n > 0), key=lambda lab: (lab == "all", left[lab], lab))
        order = sorted(shares, key=lambda s: (-need[s, rare], s))
        wants = [max(need[s, rare], 0.0) for s in order]
        scale = left[rare] / sum(wants) if sum(wants) else 0.0
        cum, at = 0.0, F.lit(order[-1])
        bounds = []
        for s, w in zip(order, wants):
            cum += w * scale
            bounds.append((s, cum))
        for s, top in reversed(bounds[:-1]):
            at = F.when(F.col("cum") + F.col("n") / 2 <= top, F.lit(s)).otherwise(at)
        mine = rest.where(F.col("label") == rare).select("group_id", "n")
        salt = F.xxhash64("group_id")
        placed = stage(
            salted_sum(mine, [], [salt, F.col("group_id")], F.pmod(salt, F.lit(64)), "cum", F.col("n"))
            .select("group_id", at.alias("split"))
        )
        for x in rest.join(placed, "group_id").groupBy("split", "label").agg(F.sum("n").alias("n")).collect():
            need[x["split"], x["label"]] -= x["n"]
            left[x["label"]] -= x["n"]
        left[rare] = 0
        rest = stage(rest.join(placed, "group_id", "left_anti"), drop=rest)
        parts.append(placed)
    splits = parts[0]
    for p in parts[1:]:
        splits = splits.unionByName(p)
    sizes = long.where("label = 'all'").select("group_id", "n")
    return lookup_join(g, splits, "group_id", sizes)


def split_shares(records: DataFrame, splits: DataFrame, plan: DataFrame, labels: list[str]) -> DataFrame:
    """``(label, split, records, share_pct, planned_pct)``: how each label's records, and ``all`` of them, came to lie.

    ``splits`` as of ``stratified_splits``. Splits that got none of a label have a row with 0.
    """
    r = latest_records(records, labels).select("record_id", *labels)
    marks = F.explode(F.array_compact(F.array(
        F.lit("all"), *[F.concat(F.lit(f"{c}="), label_key(F.col(c).cast("string"))) for c in labels])))
    got = stage(r.join(splits.select("record_id", "split"), "record_id").select("split", marks.alias("label")).groupBy("label", "split").agg(F.count("*").alias("n")))
    p = plan.select("split", F.col("share_pct").cast("double").alias("p")).dropna().distinct()
    p = p.select("split", (F.col("p") * 100 / F.sum("p").over(Window.partitionBy(F.lit(0)))).alias("planned_pct"))
    totals = got.groupBy("label").agg(F.sum("n").alias("t"))
    # at most 500 labels times the splits of the plan
    full = totals.join(F.broadcast(p)).join(got, ["label", "split"], "left")
    n = F.coalesce("n", F.lit(0))
    return full.select("label", "split", n.alias("records"), (100 * n / F.col("t")).alias("share_pct"), "planned_pct")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = group_records(latest_records(table(spark, sf_dir, "export_records")))
    return groups.where("group_size > 1").select("record_id", "group_id")


def p3_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified_splits(
        table(spark, sf_dir, "export_records"), table(spark, sf_dir, "split_plan"),
        ["plant_type", "variant", "difficulty_level"],
    )


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that p3_splits reaches, by label and split."""
    records, plan = table(spark, sf_dir, "export_records"), table(spark, sf_dir, "split_plan")
    labels = ["plant_type", "variant", "difficulty_level"]
    return split_shares(records, stage(stratified_splits(records, plan, labels)), plan, labels)


P3_FOUND_SQL = r"""
with recursive r as (
  select record_id, arg_max(base_id, exported_at) base_id, arg_max(doc_id, exported_at) doc_id,
         arg_max(coalesce(derived_from, ''), exported_at) derived_from
  from export_records where record_id is not null group by record_id),
k as (
  select *, regexp_extract(lower(base_id), '^[\s\p{Z}]*([a-z]{2})[\s\p{Z}_\p{Pd}]*0*([0-9]+)[\s\p{Z}_\p{Pd}]*([a-z]?)[\s\p{Z}]*$',
    ['code', 'num', 'suffix']) m from r),
n as (select record_id, doc_id, derived_from,
  case when m.code <> '' then m.code || '-' || m.num || m.suffix end base from k),
reps as (select *, coalesce(min(record_id) over (partition by base), record_id) rep
         from n where base is not null
         union all select *, record_id rep from n where base is null),
e as (select a.rep u, b.rep v from reps a join reps b on a.derived_from = b.doc_id where a.rep <> b.rep),
both_ways as (select u, v from e union select v, u from e),
walk as (select distinct rep s, rep t from reps union select w.s, b.v from walk w join both_ways b on w.t = b.u),
g as (select s, min(t) group_id from walk group by s),
x as (select reps.record_id, g.group_id, count(*) over (partition by g.group_id) c from reps join g on reps.rep = g.s)
select record_id, group_id from x where c > 1
"""
