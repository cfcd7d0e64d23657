"""Queries of windows, allocation, set operations and integrity checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators import allocation as A
from plumbline.operators import sequences as Q
from plumbline.operators.evaluation import ratio
from plumbline.operators.skew import salted_sum
from plumbline.plans.registry import Family
from plumbline.session import table

family = Family()
q = family.query


@q("wn3_chain_breaks", """with d as (select distinct seq, prev, hash from decisions)
select d.seq, case when p.seq is null then 'gap' when p.hash <> d.prev then 'broken' end as fault from d left join d p on p.seq = d.seq - 1
where d.seq > (select min(seq) from d) and (p.seq is null or p.hash <> d.prev)""")
def wn3_chain_breaks(spark, d):
    """Entries whose predecessor is missing or has another hash than they say. The chain is checked by a join of each
    entry with the one before it, so it needs no order over the whole table."""
    e = table(spark, d, "decisions").select("seq", "prev", "hash").distinct()
    p = e.select((F.col("seq") + 1).alias("seq"), F.col("hash").alias("before"))
    first = e.agg(F.min("seq").alias("lo"))
    out = e.join(p, "seq", "left").join(F.broadcast(first), F.col("seq") > F.col("lo"))
    fault = F.when(F.col("before").isNull(), "gap").when(F.col("before") != F.col("prev"), "broken")
    return out.select("seq", fault.alias("fault")).where("fault is not null")


_CHAIN = """e as (select seq, kind, coalesce(doc_id, '') d, coalesce(decision, '') c, prev, hash from (select *, row_number() over (partition by seq order by received_at, hash) rn from decisions) z where rn = 1),
k as (select seq, sha256(concat_ws('|', 'e', seq - 1, coalesce(prev, ''))) prev, sha256(concat_ws('|', 'e', seq, coalesce(hash, ''))) hash, sha256(concat_ws('|', seq, kind, d, c)) stated, sha256(concat_ws('|', seq, kind, d, case when seq % 41 = 0 then c || '!' else c end)) found from e)"""


@q("wn3_recomputed", f"""with {_CHAIN}, l as (select seq, stated, found, case when seq % 43 = 0 then prev else p.link end link, p.link is null gap from k left join (select seq + 1 as seq, hash link from k where seq % 53 <> 0) p using (seq))
select seq, case when gap then 'gap' when stated <> found then 'altered' when seq % 43 = 0 then 'broken' end as fault from l where seq > (select min(seq) from k) and (gap or stated <> found or seq % 43 = 0)""")
def wn3_recomputed(spark, d):
    """A log whose entries' digests are computed anew: entries that were altered after they were signed, whose
    predecessor is gone, or that name another predecessor than they follow. Such faults are planted here; every entry is
    checked on its own and against the one before it, by a join."""
    e = table(spark, d, "decisions").groupBy("seq").agg(F.min_by(F.struct(
        "kind", F.coalesce("doc_id", F.lit("")).alias("d"), F.coalesce("decision", F.lit("")).alias("c"), "prev", "hash"), F.struct("received_at", "hash")).alias("x")).select("seq", "x.*")
    digest = lambda *cols: F.sha2(F.concat_ws("|", *cols), 256)
    text = F.col("seq").cast("string")
    changed = F.when(F.col("seq") % 41 == 0, F.concat("c", F.lit("!"))).otherwise(F.col("c"))
    own = digest(F.lit("e"), text, F.coalesce("hash", F.lit("")))
    e = e.select("seq", own.alias("own"), digest(text, "kind", "d", "c").alias("stated"), digest(text, "kind", "d", changed).alias("found"))
    before = e.where("seq % 53 <> 0").select((F.col("seq") + 1).alias("seq"), F.col("own").alias("link"))
    named = F.when(F.col("seq") % 43 == 0, F.lit("another")).otherwise(F.col("link"))
    l = e.join(before, "seq", "left").withColumn("named", named).join(F.broadcast(e.agg(F.min("seq").alias("lo"))), F.col("seq") > F.col("lo"))
    fault = F.when(F.col("link").isNull(), "gap").when(F.col("stated") != F.col("found"), "altered").when(F.col("named") != F.col("link"), "broken")
    return l.select("seq", fault.alias("fault")).where("fault is not null")


@q("wn4_seed_order", """with d as (select run, min(seq) filter (kind = 'quota_seed') a, min(seq) filter (kind = 'split_seed') b, min(seq) filter (kind = 'sample_seed') c,
 min(seq) filter (kind = 'decision') e, count(distinct seq) filter (kind like '%seed') seeds from decisions group by 1)
select run, seeds, coalesce(a < e and b < e, false) as seeds_first, coalesce(a < b, false) as quota_first from d""")
def wn4_seed_order(spark, d):
    at = lambda k: F.min(F.when(F.col("kind") == k, F.col("seq")))
    g = table(spark, d, "decisions").groupBy("run").agg(
        at("quota_seed").alias("a"), at("split_seed").alias("b"), at("decision").alias("e"),
        F.count_distinct(F.when(F.col("kind").endswith("seed"), F.col("seq"))).alias("seeds"))
    first = F.coalesce((F.col("a") < F.col("e")) & (F.col("b") < F.col("e")), F.lit(False))
    return g.select("run", "seeds", first.alias("seeds_first"), F.coalesce(F.col("a") < F.col("b"), F.lit(False)).alias("quota_first"))


@q("wn8_value_levels", """with v as (select distinct user_id, value from events), g as (select *, case when value - lag(value) over (partition by user_id order by value) <= 0.5 + 0.01 * abs(value) then 0 else 1 end n from v),
i as (select user_id, value, sum(n) over (partition by user_id order by value rows unbounded preceding) lvl from g)
select user_id, cast(lvl as bigint) as lvl, min(value) as low, max(value) as high, count(*) as n from i group by 1, 2""")
def wn8_value_levels(spark, d):
    gap = 0.5 + 0.01 * F.abs("value")
    i = Q.islands(table(spark, d, "events").select("user_id", "value"), ["user_id"], "value", gap, "lvl")
    return i.groupBy("user_id", "lvl").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"))


@q("wn9_level_ratio", """with m as (select o_orderstatus, date_trunc('year', o_orderdate) y, sum(o_totalprice) x, count(*) n from orders group by 1, 2),
l as (select o_orderstatus, year(y) lvl, x, n, lag(x) over w px, lag(n) over w pn from m window w as (partition by o_orderstatus order by y))
select o_orderstatus, lvl, ln(x / px) / nullif(ln(n * 1.0 / pn), 0) as exponent from l where px > 0 and pn > 0""", floats="exponent")
def wn9_level_ratio(spark, d):
    m = table(spark, d, "orders").groupBy("o_orderstatus", F.year("o_orderdate").cast("long").alias("lvl")).agg(F.sum("o_totalprice").alias("x"), F.count("*").alias("n"))
    w = Window.partitionBy("o_orderstatus").orderBy("lvl")
    l = m.withColumns({"px": F.lag("x").over(w), "pn": F.lag("n").over(w)}).where("px > 0 and pn > 0")
    return l.select("o_orderstatus", "lvl", (F.log(F.col("x") / F.col("px")) / F.nullif(F.log(F.col("n") / F.col("pn")), F.lit(0.0))).alias("exponent"))


@q("wn10_sliding_slope", """with d as (select user_id, ts::date as d1, cast(sum(round(value * 100)) as bigint) v from events group by 1, 2), x as (select *, date_diff('day', date '2024-01-01', d1) x from d),
s as (select user_id, x, count(*) over w n, cast(sum(x) over w as double) sx, cast(sum(v) over w as double) sy, cast(sum(x * v) over w as double) sxy, cast(sum(x * x) over w as double) sxx from x window w as (partition by user_id order by x rows 6 preceding))
select user_id, x, case when n >= 3 then (n * sxy - sx * sy) / (n * sxx - sx * sx) / 100 end as slope from s""", floats="slope")
def wn10_sliding_slope(spark, d):
    """Slope of a user's daily sums over the last seven days with events, from whole cents: no sum depends on the order."""
    x = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long")
    g = table(spark, d, "events").groupBy("user_id", x.alias("x")).agg(F.sum(F.round(F.col("value") * 100)).cast("long").alias("v"))
    w = Window.partitionBy("user_id").orderBy("x").rowsBetween(-6, 0)
    sums = {"n": F.count("*"), "sx": F.sum("x"), "sy": F.sum("v"), "sxy": F.sum(F.col("x") * F.col("v")), "sxx": F.sum(F.col("x") * F.col("x"))}
    g = g.select("user_id", "x", *[c.over(w).cast("double").alias(k) for k, c in sums.items()])
    return g.select("user_id", "x", F.when(F.col("n") >= 3, F.expr("(n * sxy - sx * sy) / (n * sxx - sx * sx) / 100")).alias("slope"))


@q("wn11_bounded_log", "select user_id, event_id, value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 20")
def wn11_bounded_log(spark, d):
    """The last 20 rows of every user. Each day keeps its own last 20 first, so a busy user is never ordered whole."""
    e = table(spark, d, "events").withColumn("d1", F.to_date("ts"))
    last = [F.desc("ts"), F.desc("event_id")]
    near = e.withColumn("k", F.row_number().over(Window.partitionBy("user_id", "d1").orderBy(*last))).where("k <= 20")
    return near.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy(*last))).where("k <= 20").select("user_id", "event_id", "value")


_SPEND = """r as (select reply_id, arg_max({m: model, i: input_tokens, o: output_tokens}, created_at) x, max(created_at) as t0 from llm group by 1),
s as (select x.m model, reply_id, t0, sum(coalesce(x.i, 0) + coalesce(x.o, 0)) over (partition by x.m order by t0, reply_id) spent from r)"""


def _spend(spark, d):
    r = table(spark, d, "llm").groupBy("reply_id").agg(
        F.max_by(F.struct("model", "input_tokens", "output_tokens"), "created_at").alias("x"), F.max("created_at").alias("at")).select("reply_id", "at", "x.*")
    used = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))
    return Q.running_sum(r, ["model"], "at", ["reply_id"], used, "spent")


@q("wn12_running_spend", f"with {_SPEND} select model, reply_id, cast(spent as bigint) as spent from s")
def wn12_running_spend(spark, d):
    return _spend(spark, d).select("model", "reply_id", "spent")


@q("wn12_first_breach", f"with {_SPEND} select model, arg_min(reply_id, (t0, reply_id)) as reply_id, cast(min(spent) as bigint) as spent from s where spent > 100000 group by 1")
def wn12_first_breach(spark, d):
    """The request of each model that would exceed a cap of 100,000 tokens."""
    over = _spend(spark, d).where("spent > 100000")
    return over.groupBy("model").agg(F.min_by("reply_id", F.struct("at", "reply_id")).alias("reply_id"), F.min("spent").alias("spent"))


@q("wn13_ordered_dedupe", "select o_custkey, o_orderpriority, min(o_orderkey) as first from orders group by 1, 2")
def wn13_ordered_dedupe(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("first"))


@q("wn15_round_robin", """with s as (select event_type, min(event_id) f from events group by 1), t as (select event_type, event_id, row_number() over (partition by event_type order by event_id) turn from events),
o as (select t.event_type, event_id, turn, row_number() over (order by turn, f, t.event_type) place from t join s using (event_type) where turn <= 60) select * from o where place <= 60""")
def wn15_round_robin(spark, d):
    return A.round_robin(table(spark, d, "events").select("event_type", "event_id"), "event_type", "event_id", "event_id", 60)


@q("al1_largest_remainder", """with w as (select c_nationkey, c_mktsegment, count(*) weight, 100 total from customer group by 1, 2),
b as (select *, (total * weight) // sum(weight) over p base, (total * weight) % sum(weight) over p rest from w window p as (partition by c_nationkey)),
r as (select *, row_number() over (partition by c_nationkey order by rest desc, md5('11|' || c_nationkey || '|' || c_mktsegment)) rn, total - sum(base) over (partition by c_nationkey) lft from b)
select c_nationkey, c_mktsegment, weight, cast(base + case when rn <= lft then 1 else 0 end as bigint) as parts from r""")
def al1_largest_remainder(spark, d):
    w = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("weight")).withColumn("total", F.lit(100).cast("long"))
    return A.largest_remainder(w, ["c_nationkey"], "c_mktsegment", "weight", "total", 11).select("c_nationkey", "c_mktsegment", "weight", "parts")


@q("al2_quota_cells", """with a as (select distinct plant_type from targets t, lateral (select category plant_type) where dimension = 'plant_type'),
l as (select distinct category as level from targets where dimension = 'level'), p as (select distinct category as provider from targets where dimension = 'provider')
select plant_type, level, provider from a cross join l cross join p""")
def al2_quota_cells(spark, d):
    """All cells of three small dimensions, at most their categories multiplied."""
    t = table(spark, d, "targets")
    dims = [t.where(F.col("dimension") == k).select(F.col("category").alias(k)).distinct() for k in ("plant_type", "level", "provider")]
    return dims[0].crossJoin(F.broadcast(dims[1])).crossJoin(F.broadcast(dims[2]))


@q("al3_dealt", """with n as (select c_nationkey, c_mktsegment, count(*) n from customer group by 1, 2), c as (select c_nationkey, c_mktsegment, n, unnest(range(n)) i from n)
select c_nationkey, c_mktsegment, cast(i as int) as i, row_number() over (partition by c_nationkey order by round((2 * i + 1) / (2.0 * n), 12), c_mktsegment, i) - 1 as place from c""")
def al3_dealt(spark, d):
    n = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return A.dealt(n, ["c_nationkey"], "c_mktsegment", "n")


@q("al4_progress", """with u as (select distinct unit_id, lower(trim(provider)) provider, level, attempts from units where level between 1 and 5)
select provider, level, count(*) as planned, count(*) filter (attempts > 0) as tried, cast(sum(attempts) as bigint) as attempts, sum(attempts) >= greatest(10, 3 * count(*)) as exhausted from u where provider is not null group by 1, 2""")
def al4_progress(spark, d):
    u = table(spark, d, "units").where("level between 1 and 5").select("unit_id", F.lower(F.trim("provider")).alias("provider"), "level", "attempts").distinct()
    g = u.where("provider is not null").groupBy("provider", "level").agg(
        F.count("*").alias("planned"), F.count_if(F.col("attempts") > 0).alias("tried"), F.sum("attempts").alias("attempts"))
    return g.withColumn("exhausted", F.col("attempts") >= F.greatest(F.lit(10), 3 * F.col("planned")))


@q("al5_stratified_splits", """with h as (select p_brand, p_partkey, row_number() over (partition by p_brand order by md5('5|' || p_partkey)) - 1 rk, count(*) over (partition by p_brand) n from part),
s as (select p_brand, any_value(n) n from h group by 1), b as (select p_brand, n, o, split, w, (n * w) // 100 base, (n * w) % 100 rest from s cross join (values (0, 'development', 50), (1, 'calibration', 15), (2, 'test', 35)) t(o, split, w)),
r as (select *, row_number() over (partition by p_brand order by rest desc, md5('5|' || p_brand || '|' || split)) rn, n - sum(base) over (partition by p_brand) lft from b),
c as (select p_brand, split, sum(base + case when rn <= lft then 1 else 0 end) over (partition by p_brand order by o) hi, base + case when rn <= lft then 1 else 0 end k from r)
select h.p_brand, p_partkey, split from h join c on c.p_brand = h.p_brand and rk < hi and rk >= hi - k""")
def al5_stratified_splits(spark, d):
    return A.stratified(table(spark, d, "part"), ["p_brand"], "p_partkey", [("development", 50), ("calibration", 15), ("test", 35)], 5)


@q("al6_spot_check", """select o_orderstatus, o_orderkey from orders qualify row_number() over (partition by o_orderstatus order by md5('3|' || o_orderkey)) <= greatest(ceil(count(*) over (partition by o_orderstatus) * 10 / 100.0), 1)""")
def al6_spot_check(spark, d):
    return A.spot_check(table(spark, d, "orders"), ["o_orderstatus"], "o_orderkey", 10, 1, 3)


@q("al8_batches", """with h as (select c_mktsegment, c_custkey, sha256('salt' || chr(10) || c_custkey) opaque_id from customer)
select *, cast((row_number() over (partition by c_mktsegment order by opaque_id) - 1) // 20 as int) as batch from h""")
def al8_batches(spark, d):
    return A.batches(table(spark, d, "customer"), ["c_mktsegment"], "c_custkey", 20, "salt")


@q("al9_rotation", """select c_custkey, c_nationkey, (row_number() over (partition by c_nationkey order by c_custkey) - 1) % 3 as renderer from customer""")
def al9_rotation(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    r = salted_sum(c, ["c_nationkey"], [F.col("c_custkey")], F.floor(F.col("c_custkey") / 4096), "rank")
    return r.select("c_custkey", "c_nationkey", F.pmod("rank", F.lit(3)).cast("long").alias("renderer"))


@q("al12_top_k", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def al12_top_k(spark, d):
    """A report of the 25 largest orders."""
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@q("al12_argbest", "select o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) as best, arg_min(o_orderkey, (o_totalprice, o_orderkey)) as least from orders group by 1")
def al12_argbest(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(
        F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("best"),
        F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("least"))


@q("st1_clamped", "select o_custkey, o_orderkey from orders where o_orderpriority = '1-URGENT' union select l_suppkey + 0, l_orderkey from lineitem where l_quantity > 49.5")
def st1_clamped(spark, d):
    a = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey", "o_orderkey")
    return a.union(table(spark, d, "lineitem").where("l_quantity > 49.5").select("l_suppkey", "l_orderkey")).distinct()


@q("st3_uncovered", "select p_partkey from part except select l_partkey from lineitem where l_quantity > 48 and l_tax > 0.06 except select l_partkey from lineitem where l_quantity < 3 and l_discount > 0.08")
def st3_uncovered(spark, d):
    l = table(spark, d, "lineitem")
    left = table(spark, d, "part").select("p_partkey").join(l.where("l_quantity > 48 and l_tax > 0.06").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti")
    return left.join(l.where("l_quantity < 3 and l_discount > 0.08").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti").distinct()


@q("st5_shared", "select l_orderkey, l_suppkey from lineitem where l_quantity > 25 intersect select l_orderkey, l_suppkey from lineitem where l_discount > 0.04")
def st5_shared(spark, d):
    l = table(spark, d, "lineitem")
    return l.where("l_quantity > 25").select("l_orderkey", "l_suppkey").intersect(l.where("l_discount > 0.04").select("l_orderkey", "l_suppkey"))


@q("st6_variant_balance", """with c as (select lower(trim(variant)) v, count(distinct record_id) n from export_records where variant is not null group by 1)
select v as variant, n, n = max(n) over () as fullest from c""")
def st6_variant_balance(spark, d):
    c = table(spark, d, "export_records").where("variant is not null").groupBy(F.lower(F.trim("variant")).alias("variant")).agg(F.count_distinct("record_id").alias("n"))
    return c.join(F.broadcast(c.agg(F.max("n").alias("m")))).select("variant", "n", (F.col("n") == F.col("m")).alias("fullest"))


_MANIFEST = """a as (select record_id, arg_min(sha256(coalesce(text, '')), (exported_at, text)) h from export_records where split <> 'judged' group by 1),
b as (select record_id, arg_max(sha256(trim(coalesce(text, ''))), (exported_at, text)) h from export_records where mode <> 'pipeline_test' group by 1)"""


@q("jn18_manifest", f"""with {_MANIFEST} select coalesce(a.record_id, b.record_id) as record_id, case when b.h is null then 'missing' when a.h is null then 'extra' else 'changed' end as state
from a full outer join b on a.record_id = b.record_id where a.h is null or b.h is null or a.h <> b.h""")
def jn18_manifest(spark, d):
    """Two lists of digests compared: what one lacks, what the other has besides, what differs."""
    r = table(spark, d, "export_records").withColumn("t", F.coalesce("text", F.lit("")))
    a = r.where("split <> 'judged'").groupBy("record_id").agg(F.min_by(F.sha2("t", 256), F.struct("exported_at", "text")).alias("a"))
    b = r.where("mode <> 'pipeline_test'").groupBy("record_id").agg(F.max_by(F.sha2(F.trim("t"), 256), F.struct("exported_at", "text")).alias("b"))
    state = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, "record_id", "full_outer").select("record_id", state.alias("state")).where("state is not null")


@q("jn22_asof", """select l.event_id, r.value from events l asof left join (select user_id, ts, max(value) as value from events where event_type = 'view' group by 1, 2) r
on l.user_id = r.user_id and l.ts >= r.ts where l.event_type = 'purchase'""")
def jn22_asof(spark, d):
    """Each purchase with the value of the user's last view before it."""
    e = table(spark, d, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'view'").select("user_id", "ts", "value")
    return Q.asof_join(left, right, ["user_id"], "ts", "value", "value").select("event_id", "value")


_SPANS = "select user_id, event_id as span_id, ts as s, ts + interval 3 hour as e, event_type as place from events where event_type = 'signup'"


@q("jn23_inside", f"with s as ({_SPANS}) select s.span_id, p.event_id from s join events p on p.user_id = s.user_id and p.ts between s.s and s.e and p.event_type <> s.place")
def jn23_inside(spark, d):
    """Events of another type that fall into the three hours after a sign-up of the same user."""
    e = table(spark, d, "events")
    spans = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("span_id"), F.col("ts").alias("s"), (F.col("ts") + F.expr("interval 3 hours")).alias("e"))
    points = e.where("event_type <> 'signup'").select("user_id", "event_id", "ts")
    return Q.interval_join(points, spans, "user_id", "ts", "s", "e", 3 * 3600).select("span_id", "event_id")


_MISSING = """with v as (select distinct doc_id, trim(regexp_replace(lower(reviewer), '[\\s_-]+', ' ', 'g')) r from decisions where kind = 'decision' and doc_id is not null and reviewer is not null),
n as (select distinct r from v), w as (select distinct doc_id from v)
select w.doc_id, n.r as reviewer from w cross join n where not exists (select 1 from v where v.doc_id = w.doc_id and v.r = n.r)"""


@q("jn14_missing_reviews", _MISSING)
@q("jn14_all_missing_reviews", _MISSING)
def jn14_missing_reviews(spark, d):
    """Documents and reviewers without a vote, over all reviewers: the reviewers go to every task as one row, and each
    document's own are taken off."""
    key = F.trim(F.regexp_replace(F.lower("reviewer"), r"[\s_-]+", " "))
    v = table(spark, d, "decisions").where("kind = 'decision' and doc_id is not null and reviewer is not null").select("doc_id", key.alias("r")).distinct()
    panel = F.broadcast(v.agg(F.sort_array(F.collect_set("r")).alias("panel")))
    done = v.groupBy("doc_id").agg(F.collect_list("r").alias("done"))
    return done.join(panel).select("doc_id", F.explode(F.array_except("panel", "done")).alias("reviewer"))


@q("jn19_variant_diff", """with r as (select upper(trim(base_id)) b, lower(trim(variant)) v, arg_max(md5(coalesce(text, '')), (exported_at, record_id)) h, count(*) n from export_records where base_id is not null group by 1, 2),
a as (select * from r where v = 'consistent'), c as (select * from r where v = 'planted')
select coalesce(a.b, c.b) as base, case when a.b is null then 'added' when c.b is null then 'removed' when a.h <> c.h then 'changed' else 'same' end as state from a full outer join c on a.b = c.b""")
def jn19_variant_diff(spark, d):
    r = table(spark, d, "export_records").where("base_id is not null").groupBy(F.upper(F.trim("base_id", F.lit(" "))).alias("base"), F.lower(F.trim("variant")).alias("v")).agg(
        F.max_by(F.md5(F.coalesce("text", F.lit(""))), F.struct("exported_at", "record_id")).alias("h"))
    a, c = (r.where(F.col("v") == v).select("base", F.col("h").alias(n)) for v, n in (("consistent", "a"), ("planted", "c")))
    state = F.when(F.col("a").isNull(), "added").when(F.col("c").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("c")), "changed").otherwise("same")
    return a.join(c, "base", "full_outer").select("base", state.alias("state"))


@q("flt11_field_check", """select count(*) filter (length(request) > 300) as long_requests, count(*) filter (input_tokens < 0) as negative, count(*) filter (stop_reason is null) as no_stop from llm""")
def flt11_field_check(spark, d):
    return table(spark, d, "llm").agg(F.count_if(F.length("request") > 300).alias("long_requests"), F.count_if(F.col("input_tokens") < 0).alias("negative"),
                                      F.count_if(F.col("stop_reason").isNull()).alias("no_stop"))


@q("rv2_reviewer_alarms", """with s as (select distinct reviewer, batch_id, clean, false_alarms, caught, defects from canary_scores)
select trim(regexp_replace(lower(reviewer), '[\\s_-]+', ' ', 'g')) as reviewer, count(*) filter (caught is null) as unusable, cast(sum(false_alarms) as bigint) as alarms, sum(false_alarms) * 1.0 / nullif(sum(clean), 0) as alarm_rate from s group by 1""", floats="alarm_rate")
def rv2_reviewer_alarms(spark, d):
    s = table(spark, d, "canary_scores").select("reviewer", "batch_id", "clean", "false_alarms", "caught", "defects").distinct()
    g = s.groupBy(F.trim(F.regexp_replace(F.lower("reviewer"), r"[\s_-]+", " ")).alias("reviewer")).agg(
        F.count_if(F.col("caught").isNull()).alias("unusable"), F.sum("false_alarms").alias("alarms"), F.sum("clean").alias("c"))
    return g.select("reviewer", "unusable", "alarms", ratio(F.col("alarms"), F.col("c"), None).alias("alarm_rate"))


@q("rv3_review_queue", """with r as (select record_id, arg_max(len(flags), exported_at) f, arg_max(genre, exported_at) g from export_records group by 1),
s as (select record_id from (select record_id, g, row_number() over (partition by g order by md5('9|' || record_id)) rn, count(*) over (partition by g) n from r where f = 0) where rn <= greatest(ceil(n * 10 / 100.0), 1))
select record_id, 'flag' as reason from r where f > 0 union all select record_id, 'sample' from s""")
def rv3_review_queue(spark, d):
    """Every flagged record, and a seeded tenth of the rest of each genre."""
    r = table(spark, d, "export_records").groupBy("record_id").agg(F.max_by(F.size("flags"), "exported_at").alias("f"), F.max_by("genre", "exported_at").alias("g"))
    s = A.spot_check(r.where("f = 0"), ["g"], "record_id", 10, 1, 9)
    return r.where("f > 0").select("record_id", F.lit("flag").alias("reason")).unionByName(s.select("record_id", F.lit("sample").alias("reason")))


queries, oracle_sql = family.queries, family.oracle_sql
