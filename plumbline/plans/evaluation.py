"""Queries of scores, agreement, fits and counts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators import evaluation as V
from plumbline.operators import entity_graph as E
from plumbline.plans.bindings import ENTITY_RELATIONS, entity_relations
from plumbline.plans.registry import Family
from plumbline.session import table

family = Family()
q = family.query
TAUS = [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9]

#: Labelled replies: the relation and confidence that a reply gives, latest delivery of each.
REPLIES = """
select reply_id, model, lower(trim(relation)) as relation, confidence, request, created_at from (
  select reply_id, model, request, created_at, {relation} as relation, {confidence} as confidence,
    row_number() over (partition by reply_id order by created_at desc, output) as rn
  from llm where schema_name = 'RelationV22' and output is not null) x
where rn = 1 and relation is not null and confidence is not null
"""
_REPLIES_SQL = REPLIES.format(relation="output->>'relation'", confidence="cast(output->>'confidence' as double)")
#: What stands in for truth: a property of the request that no reply sees.
_TRUTH = "(reply_id % 3 = 0)"


def replies(spark, d):
    text = REPLIES.format(relation="get_json_object(output, '$.relation')", confidence="cast(get_json_object(output, '$.confidence') as double)")
    return spark.sql(text.replace("from llm", "from {llm}"), llm=table(spark, d, "llm"))


def scored(spark, d):
    return replies(spark, d).withColumns({
        "truth": F.col("reply_id") % 3 == 0, "verdict": F.col("relation").isin("contradicts", "tension"),
        "score": F.when(F.col("relation") == "supports", 1 - F.col("confidence")).otherwise(F.col("confidence")),
    })


_S = f"""s as (select *, {_TRUTH} truth, relation in ('contradicts', 'tension') verdict,
  case relation when 'supports' then 1 - confidence else confidence end score from ({_REPLIES_SQL}) r)"""
_PRF = """count(*) filter (verdict and truth) tp, count(*) filter (verdict and not truth) fp,
  count(*) filter (not verdict and truth) fn"""
_F1 = "coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)"


@q("ag1_rate", f"with {_S} select relation, avg(cast(truth as int)) as rate, count(*) as n from s group by 1", floats="rate")
def ag1_rate(spark, d):
    return scored(spark, d).groupBy("relation").agg(V.rate(F.col("truth")).alias("rate"), F.count("*").alias("n"))


@q("ag2_prf", f"""with {_S}, c as (select model, {_PRF} from s group by 1)
select *, coalesce(1.0 * tp / nullif(tp + fp, 0), 0) as precision, coalesce(1.0 * tp / nullif(tp + fn, 0), 0) as recall, {_F1} as f1 from c""", floats="precision recall f1")
def ag2_prf(spark, d):
    return V.prf(scored(spark, d), "verdict", "truth", ["model"])


@q("ag3_auc", f"""with {_S}, p as (select model, score, rank() over (partition by model order by score)
  + (count(*) over (partition by model, score) - 1) / 2.0 rk, truth from s)
select model, (sum(rk) filter (truth) - count(*) filter (truth) * (count(*) filter (truth) + 1) / 2.0)
  / nullif(count(*) filter (truth) * count(*) filter (not truth), 0) as auc from p group by 1""", floats="auc")
def ag3_auc(spark, d):
    return V.auc(scored(spark, d), "score", "truth", ["model"])


@q("ag4_f1_by_type", f"""with {_S}, c as (select coalesce(model, 'all') kind, {_PRF} from s group by grouping sets ((), (model)))
select kind, tp, fp, fn, {_F1} as f1 from c""", floats="f1")
def ag4_f1_by_type(spark, d):
    """Overall and by type in one pass of counts."""
    per = V.prf(scored(spark, d), "verdict", "truth", ["model"]).select("model", "tp", "fp", "fn")
    g = per.rollup("model").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return g.select(F.coalesce("model", F.lit("all")).alias("kind"), "tp", "fp", "fn",
                    V.ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


@q("ag5_contamination", f"""with {_S} select coalesce(model, 'all') kind, count(*) pairs, count(*) filter (relation = 'contradicts') contradicts,
  count(*) filter (relation = 'contradicts') * 1.0 / count(*) as rate from s where not truth group by grouping sets ((), (model))""", floats="rate")
def ag5_contamination(spark, d):
    hit = F.count_if(F.col("relation") == "contradicts")
    g = scored(spark, d).where("not truth").rollup("model").agg(F.count("*").alias("pairs"), hit.alias("contradicts"))
    return g.select(F.coalesce("model", F.lit("all")).alias("kind"), "pairs", "contradicts", (F.col("contradicts") / F.col("pairs")).alias("rate"))


_FLAGS = """f as (select record_id, arg_max(list_sort(flags), exported_at) flags from export_records group by 1)"""


@q("ag6_flag_combinations", f"with {_FLAGS} select array_to_string(flags, '+') as combination, count(*) as n from f group by 1")
def ag6_flag_combinations(spark, d):
    r = table(spark, d, "export_records").groupBy("record_id").agg(F.max_by(F.sort_array("flags"), "exported_at").alias("flags"))
    return r.groupBy(F.array_join("flags", "+").alias("combination")).agg(F.count("*").alias("n"))


@q("ag22_flag_rates", """with r as (select distinct record_id, provider, unnest(flags) flag from export_records),
n as (select provider, count(distinct record_id) n from export_records group by 1)
select r.provider, flag, count(*) as flagged, count(*) * 1.0 / max(n.n) as rate from r join n on n.provider is not distinct from r.provider group by 1, 2""", floats="rate")
def ag22_flag_rates(spark, d):
    r = table(spark, d, "export_records").select("record_id", "provider", "flags")
    n = r.groupBy("provider").agg(F.count_distinct("record_id").alias("n"))
    x = r.select("record_id", "provider", F.explode("flags").alias("flag")).distinct()
    g = x.groupBy("provider", "flag").agg(F.count("*").alias("flagged"))
    return g.join(n, g["provider"].eqNullSafe(n["provider"])).select(g["provider"], "flag", "flagged", (F.col("flagged") / F.col("n")).alias("rate"))


@q("ag7_unscored", """with r as (select distinct reply_id, model, output from llm where schema_name = 'RelationV22'),
c as (select model, count(distinct reply_id) requested, count(distinct reply_id) filter (output is null or output->>'relation' is null) unscored from r group by 1)
select model, requested, unscored, 100 * unscored > requested as stop from c""")
def ag7_unscored(spark, d):
    """Requests whose reply gives no relation, and whether they exceed one in a hundred."""
    r = table(spark, d, "llm").where("schema_name = 'RelationV22'")
    none = F.get_json_object("output", "$.relation").isNull()
    g = r.groupBy("model").agg(F.count_distinct("reply_id").alias("requested"), F.count_distinct(F.when(none, F.col("reply_id"))).alias("unscored"))
    return g.withColumn("stop", 100 * F.col("unscored") > F.col("requested"))


@q("ag8_agreement", f"""with {_S} select model, avg(cast(verdict = (score >= 0.5) as int)) as agreement,
 count(*) filter (verdict <> (score >= 0.5)) as disagreements from s group by 1""", floats="agreement")
def ag8_agreement(spark, d):
    same = F.col("verdict") == (F.col("score") >= 0.5)
    return scored(spark, d).groupBy("model").agg(V.rate(same).alias("agreement"), F.count_if(~same).alias("disagreements"))


@q("ag9_method_scores", f"""with {_S}, u as (select 'verdict' as method, verdict as verdict, truth from s
 union all select 'score', score >= 0.5, truth from s union all select 'either', verdict or score >= 0.5, truth from s),
c as (select method, {_PRF} from u group by 1) select method, tp, fp, fn, {_F1} as f1 from c""", floats="f1")
def ag9_method_scores(spark, d):
    """One row per method from one row per item: the methods' verdicts are unpivoted."""
    high = F.col("score") >= 0.5
    s = scored(spark, d).select("truth", F.col("verdict").alias("v"), high.alias("s"), (F.col("verdict") | high).alias("e"))
    u = s.select("truth", F.expr("stack(3, 'verdict', v, 'score', s, 'either', e) as (method, said)"))
    return V.prf(u, "said", "truth", ["method"]).select("method", "tp", "fp", "fn", "f1")


@q("ag11_repeat_agreement", """with k as (select l_suppkey, l_partkey % 20 as pair, l_linenumber % 3 as repeat, max(l_returnflag) as label from lineitem group by 1, 2, 3)
select l_suppkey, pair, count(distinct label) as labels, count(distinct repeat) as seen,
 count(distinct label) = 1 and count(distinct repeat) = 3 as agrees from k group by 1, 2""")
def ag11_repeat_agreement(spark, d):
    l = table(spark, d, "lineitem").groupBy(
        "l_suppkey", (F.col("l_partkey") % 20).alias("pair"), (F.col("l_linenumber") % 3).alias("repeat")).agg(F.max("l_returnflag").alias("label"))
    return V.repeat_agreement(l, ["l_suppkey", "pair"], "repeat", "label", 3)


@q("ag12_direction_disagreements", f"""select doc_id, attribute, least(a, b) as x, greatest(a, b) as y, count(*) as relations
from ({ENTITY_RELATIONS}) r where kind = 'greater' and a <> b group by 1, 2, 3, 4 having count(distinct a) > 1""")
def ag12_direction_disagreements(spark, d):
    r = entity_relations(spark, d).where("kind = 'greater' and a <> b")
    g = r.groupBy("doc_id", "attribute", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    return g.agg(F.count("*").alias("relations"), F.count_distinct("a").alias("ways")).where("ways > 1").drop("ways")


@q("ag14_tokens_by_kind", """with r as (select reply_id, arg_max(schema_name, created_at) schema_name, max(input_tokens) i, max(output_tokens) o from llm group by 1)
select schema_name, count(*) as calls, cast(sum(i) as bigint) as input_tokens, cast(sum(o) as bigint) as output_tokens from r group by 1""")
def ag14_tokens_by_kind(spark, d):
    r = table(spark, d, "llm").groupBy("reply_id").agg(
        F.max_by("schema_name", "created_at").alias("schema_name"), F.max("input_tokens").alias("i"), F.max("output_tokens").alias("o"))
    return r.groupBy("schema_name").agg(F.count("*").alias("calls"), F.sum("i").alias("input_tokens"), F.sum("o").alias("output_tokens"))


_CURVE = f"""{_S}, c as (select model, t.tau, count(*) filter (score >= tau and truth) tp, count(*) filter (score >= tau and not truth) fp,
 count(*) filter (score < tau and truth) fn from s cross join (values {", ".join(f"({t})" for t in TAUS)}) t(tau) group by 1, 2),
k as (select model, cast(tau as double) as tau, tp, fp, fn, {_F1} as f1 from c)"""


@q("ag15_threshold_curve", f"with {_CURVE} select * from k", floats="f1")
def ag15_threshold_curve(spark, d):
    return V.threshold_curve(scored(spark, d), "score", "truth", TAUS, ["model"])


@q("ag15_best_threshold", f"with {_CURVE} select model, tau, f1 from k qualify row_number() over (partition by model order by round(f1, 12) desc, tau) = 1", floats="f1")
def ag15_best_threshold(spark, d):
    return V.best_threshold(ag15_threshold_curve(spark, d), ["model"])


@q("jn11_changed_verdicts", f"""with {_S}, c as (select model, score >= 0.5 a, score >= 0.7 b, truth from s)
select model, count(*) filter (a and not truth) as old_false, count(*) filter (b and not truth and not a) as new_false,
 count(*) filter (a and truth and not b) as lost from c group by 1""")
def jn11_changed_verdicts(spark, d):
    a, b, t = F.col("score") >= 0.5, F.col("score") >= 0.7, F.col("truth")
    return scored(spark, d).groupBy("model").agg(
        F.count_if(a & ~t).alias("old_false"), F.count_if(b & ~t & ~a).alias("new_false"), F.count_if(a & t & ~b).alias("lost"))


@q("ag18_first_mode", """with c as (select o_custkey, o_orderstatus, count(*) n, min((o_orderdate, o_orderkey)) f from orders group by 1, 2)
select o_custkey, arg_min(o_orderstatus, (-n, f)) as o_orderstatus, max(n) as n from c group by 1""")
def ag18_first_mode(spark, d):
    return V.first_mode(table(spark, d, "orders"), ["o_custkey"], "o_orderstatus", ["o_orderdate", "o_orderkey"])


@q("ag20_arities", """select o_custkey as doc_id, o_orderpriority as attribute,
 case when bool_and(o_orderkey % 4 < 3) then 'binary' when bool_or(o_orderkey % 8 = 7) then 'multi' else 'unknown' end as arity,
 arg_min(o_orderstatus, o_orderkey) as span from orders group by 1, 2""")
def ag20_arities(spark, d):
    o = table(spark, d, "orders")
    arity = F.when(F.col("o_orderkey") % 4 < 3, "binary").when(F.col("o_orderkey") % 8 == 7, "multi").otherwise("unknown")
    return E.arities(o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("attribute"),
                              arity.alias("arity"), F.col("o_orderstatus").alias("span"), F.col("o_orderkey").alias("seq")))


@q("ag21_spent", """with r as (select distinct reply_id, model, input_tokens, output_tokens from llm)
select model, cast(sum(input_tokens + coalesce(output_tokens, 0)) filter (input_tokens is not null) as bigint) as spent,
 count(*) filter (output_tokens is null) as unknown from r group by 1""")
def ag21_spent(spark, d):
    r = table(spark, d, "llm").select("reply_id", "model", "input_tokens", "output_tokens").distinct()
    return r.groupBy("model").agg(F.sum(F.col("input_tokens") + F.coalesce("output_tokens", F.lit(0))).alias("spent"),
                                  F.count_if(F.col("output_tokens").isNull()).alias("unknown"))


@q("ag23_canary_scores", """with s as (select distinct trim(regexp_replace(lower(reviewer), '[\\s_-]+', ' ', 'g')) reviewer, batch_id, defects, caught, clean, false_alarms from canary_scores)
select reviewer, cast(sum(defects) as bigint) as defects, cast(sum(caught) as bigint) as caught, cast(sum(false_alarms) as bigint) as false_alarms,
 sum(defects) >= 5 and 5 * sum(caught) >= 4 * sum(defects) as certified from s where caught is not null group by 1""")
def ag23_canary_scores(spark, d):
    key = F.trim(F.regexp_replace(F.lower("reviewer"), r"[\s_-]+", " ")).alias("reviewer")
    s = table(spark, d, "canary_scores").select(key, "batch_id", "defects", "caught", "clean", "false_alarms").distinct().where("caught is not null")
    g = s.groupBy("reviewer").agg(*[F.sum(c).alias(c) for c in ("defects", "caught", "false_alarms")])
    return g.withColumn("certified", (F.col("defects") >= 5) & (5 * F.col("caught") >= 4 * F.col("defects")))


@q("ag24_latest_decisions", """select doc_id, lower(trim(arg_max(decision, seq))) as decision, max(seq) as seq from decisions
where kind = 'decision' and doc_id is not null and decision is not null group by 1""")
def ag24_latest_decisions(spark, d):
    v = table(spark, d, "decisions").where("kind = 'decision' and doc_id is not null and decision is not null")
    return v.groupBy("doc_id").agg(F.lower(F.trim(F.max_by("decision", "seq"))).alias("decision"), F.max("seq").alias("seq"))


_ACCEPT = """r as (select record_id, arg_max({text: coalesce(text, ''), base_id: coalesce(trim(base_id), ''), flags: flags, reviewers: reviewers}, exported_at) x from export_records group by 1),
a as (select record_id, x.base_id base_id, list_filter([case when length(x.text) = 0 then 'no text' end, case when x.base_id in ('', '-', 'n/a', 'unknown') then 'no base' end,
 case when len(x.flags) > 0 then 'flagged' end, case when len(x.reviewers) < 2 then 'few reviewers' end], lambda z: z is not null) reasons from r)"""


def _accept(spark, d):
    r = table(spark, d, "export_records").groupBy("record_id").agg(F.max_by(F.struct(
        F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.trim("base_id"), F.lit("")).alias("base_id"), "flags", "reviewers"), "exported_at").alias("x")).select("record_id", "x.*")
    reasons = F.array_compact(F.array(
        F.when(F.length("text") == 0, "no text"), F.when(F.col("base_id").isin("", "-", "n/a", "unknown"), "no base"),
        F.when(F.size("flags") > 0, "flagged"), F.when(F.size("reviewers") < 2, "few reviewers")))
    return r.select("record_id", "base_id", reasons.alias("reasons"))


@q("ag25_reasons", f"with {_ACCEPT} select record_id, array_to_string(reasons, '; ') as reasons from a where len(reasons) > 0")
def ag25_reasons(spark, d):
    return _accept(spark, d).where(F.size("reasons") > 0).select("record_id", F.array_join("reasons", "; ").alias("reasons"))


@q("ag25_whole_bases", f"with {_ACCEPT} select base_id, count(*) as records, bool_and(len(reasons) = 0) as accepted from a group by 1")
def ag25_whole_bases(spark, d):
    return _accept(spark, d).groupBy("base_id").agg(F.count("*").alias("records"), F.bool_and(F.size("reasons") == 0).alias("accepted"))


@q("ag26_energy_by_depth", "select user_id % 12 as depth, round(sum(value * value), 2) as energy from events group by 1")
def ag26_energy_by_depth(spark, d):
    return table(spark, d, "events").groupBy((F.col("user_id") % 12).alias("depth")).agg(F.round(F.sum(F.col("value") * F.col("value")), 2).alias("energy"))


@q("ag27_loglog_fit", """select l_suppkey, regr_slope(ln(l_extendedprice), ln(l_quantity)) as slope, regr_intercept(ln(l_extendedprice), ln(l_quantity)) as intercept,
 regr_r2(ln(l_extendedprice), ln(l_quantity)) as r2, count(*) as n from lineitem where l_extendedprice > 0 and l_quantity > 0 group by 1 having count(*) >= 3""", floats="slope intercept r2")
def ag27_loglog_fit(spark, d):
    l = table(spark, d, "lineitem").where("l_extendedprice > 0 and l_quantity > 0").select("l_suppkey", F.log("l_quantity").alias("x"), F.log("l_extendedprice").alias("y"))
    return l.groupBy("l_suppkey").agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"),
                                      F.regr_r2("y", "x").alias("r2"), F.count("*").alias("n")).where("n >= 3")


@q("ag28_weighted_fit", """with s as (select l_returnflag, sum(l_quantity) sw, sum(l_quantity * l_discount) sx, sum(l_quantity * l_tax) sy,
 sum(l_quantity * l_discount * l_discount) sxx, sum(l_quantity * l_discount * l_tax) sxy, count(*) n from lineitem group by 1),
k as (select *, (sw * sxy - sx * sy) / nullif(sw * sxx - sx * sx, 0) slope from s) select l_returnflag, n, slope, (sy - slope * sx) / sw as intercept from k""", floats="slope intercept")
def ag28_weighted_fit(spark, d):
    return V.weighted_line(table(spark, d, "lineitem"), "l_discount", "l_tax", "l_quantity", ["l_returnflag"])


@q("ag29_gates", """select event_type, bool_or(value > 300) as passed, count(*) filter (value > 300) as members from events where event_type <> 'error' group by 1""")
def ag29_gates(spark, d):
    e = table(spark, d, "events").where("event_type <> 'error'")
    return e.groupBy("event_type").agg(F.bool_or(F.col("value") > 300).alias("passed"), F.count_if(F.col("value") > 300).alias("members"))


@q("ag30_paired_t", """with p as (select user_id, ts::date as d1, avg(value) filter (event_type = 'click') a, avg(value) filter (event_type = 'view') b from events group by 1, 2)
select user_id, count(a - b) as n, avg(a - b) as mean, avg(a - b) / nullif(stddev_samp(a - b) / sqrt(count(a - b)), 0) as t from p group by 1""", floats="mean t")
def ag30_paired_t(spark, d):
    e = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("d1")).agg(
        F.avg(F.when(F.col("event_type") == "click", F.col("value"))).alias("a"), F.avg(F.when(F.col("event_type") == "view", F.col("value"))).alias("b"))
    return V.paired_t(e, "a", "b", ["user_id"])


@q("ag31_correlation", """with c as (select ts::date as d1, count(*) filter (event_type = 'click') a, sum(value) filter (event_type = 'purchase') b, count(*) filter (event_type = 'error') c from events group by 1)
select corr(a, b) as clicks_purchases, corr(a, c) as clicks_errors from c""", floats="clicks_purchases clicks_errors")
def ag31_correlation(spark, d):
    n = lambda k: F.count_if(F.col("event_type") == k)
    c = table(spark, d, "events").groupBy(F.to_date("ts")).agg(
        n("click").alias("a"), F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("b"), n("error").alias("c"))
    return c.agg(F.corr("a", "b").alias("clicks_purchases"), F.corr("a", "c").alias("clicks_errors"))


@q("ag32_confusion", """with e as (select label, list_position(embedding[1:8], list_max(embedding[1:8])) - 1 as part from embeddings)
select label, cast(count(*) filter (part < 2) as bigint) as p0, count(*) filter (part in (2, 3)) as p1, count(*) filter (part in (4, 5)) as p2, count(*) filter (part > 5) as p3 from e group by 1""")
def ag32_confusion(spark, d):
    """Label by part, a part being a pair of the first eight coordinates: the one that holds the largest."""
    return _parts(spark, d).groupBy("label").pivot("part", [0, 1, 2, 3]).count().fillna(0).toDF("label", "p0", "p1", "p2", "p3")


def _parts(spark, d):
    head = F.slice("embedding", 1, 8)
    at = F.array_position(head, F.array_max(head)) - 1
    return table(spark, d, "embeddings").select("label", F.floor(at / 2).cast("int").alias("part"))


@q("ag33_purity", """with e as (select label, cast(floor((list_position(embedding[1:8], list_max(embedding[1:8])) - 1) / 2) as int) part from embeddings),
c as (select part, label, count(*) n from e group by 1, 2), m as (select part, max(n) top, sum(n) n from c group by 1) select sum(top) / sum(n) as purity, count(*) as parts from m""", floats="purity")
def ag33_purity(spark, d):
    return V.purity(_parts(spark, d), "part", "label")


@q("ag35_concentration", """with v as (select user_id, event_type, sum(value) v from events group by 1, 2), p as (select user_id, v / sum(v) over (partition by user_id) p from v)
select user_id, -sum(case when p > 0 then p * ln(p) else 0 end) as entropy, 1 / sum(p * p) as effective, max(p) as largest from p group by 1""", floats="entropy effective largest")
def ag35_concentration(spark, d):
    v = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.sum("value").alias("v"))
    p = v.withColumn("p", F.col("v") / F.sum("v").over(Window.partitionBy("user_id")))
    return p.groupBy("user_id").agg((-F.sum(F.when(F.col("p") > 0, F.col("p") * F.log("p")).otherwise(0.0))).alias("entropy"),
                                    (1 / F.sum(F.col("p") * F.col("p"))).alias("effective"), F.max("p").alias("largest"))


@q("ag36_miss_classes", """with o as (select o_custkey, bool_or(o_orderstatus = 'F') f, bool_or(o_orderpriority = '1-URGENT') u, bool_or(o_totalprice > 450000) b, count(*) n from orders group by 1)
select case when n < 5 then 'too few' when not f then 'no statement' when not u then 'no cue' when b then 'extra' else 'found' end as class, count(*) as n from o group by 1""")
def ag36_miss_classes(spark, d):
    """Ordered classes: the first that applies names why a planted cycle was missed."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(
        F.bool_or(F.col("o_orderstatus") == "F").alias("f"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("u"),
        F.bool_or(F.col("o_totalprice") > 450000).alias("b"), F.count("*").alias("k"))
    cls = F.when(F.col("k") < 5, "too few").when(~F.col("f"), "no statement").when(~F.col("u"), "no cue").when(F.col("b"), "extra").otherwise("found")
    return o.groupBy(cls.alias("class")).agg(F.count("*").alias("n"))


queries, oracle_sql = family.queries, family.oracle_sql
