"""Queries of projections, filters, joins and reports around claims, replies, records and reviews."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators import allocation as A
from plumbline.operators import entity_graph as E
from plumbline.operators import evaluation as V
from plumbline.operators import signed_graph as S
from plumbline.plans.bindings import CLAIMS, ENTITY_RELATIONS, RELATIONS, claims, entity_relations, pairs, relations
from plumbline.plans.consistency import _CLASSED, _COVER, _FIRST, _ORDER, _PARITY, _STRONG, _UNBALANCED, _arity_of
from plumbline.plans.evaluation import _F1, _PRF, _S, TAUS, scored
from plumbline.plans.matching import _LAST, last_records
from plumbline.plans.registry import Family
from plumbline.plans.texts import _SENT, _sentences
from plumbline.session import stage, table

family = Family()
q = family.query

# Fixed value: a fragment of JSON in running text, which shows a garbled reply.
JSON_FRAGMENT = r"""[{}]|["'][A-Za-z_]\w*["']\s*:|\b(relation|confidence|rationale)["']?\s*:"""


@q("prj1_enum_key", "select distinct stop_reason, lower(trim(stop_reason)) as key from llm where stop_reason is not null")
def prj1_enum_key(spark, d):
    return table(spark, d, "llm").where("stop_reason is not null").select("stop_reason", S.enum_key(F.col("stop_reason")).alias("key")).distinct()


@q("prj3_weight", f"""select doc_id, seq, round(case when seq % 97 = 0 then 0 else least(greatest(1.7 * confidence - 0.4, 0), 1) end, 9) as weight from ({RELATIONS}) r""")
def prj3_weight(spark, d):
    """Confidences beyond 0 and 1 are clipped; those that are no number weigh nothing."""
    c = F.when(F.col("seq") % 97 == 0, F.lit(float("nan"))).otherwise(1.7 * F.col("confidence") - 0.4)
    return relations(spark, d).select("doc_id", "seq", F.round(S.weight(c), 9).alias("weight"))


@q("prj5_sign", f"""select doc_id, seq, case lower(trim(relation)) when 'supports' then 1 else -1 end as sign from ({RELATIONS}) r where lower(trim(relation)) in ('supports', 'contradicts')""")
def prj5_sign(spark, d):
    k = S.enum_key(F.col("relation"))
    return relations(spark, d).select("doc_id", "seq", F.when(k == "supports", 1).when(k == "contradicts", -1).alias("sign")).where("sign is not null")


@q("prj6_renumbered", f"""with {_SENT} select record_id, pos, row_number() over (partition by record_id order by pos) - 1 as claim_id from s where not sentence like '%?'""")
def prj6_renumbered(spark, d):
    """Statements of a text, numbered without its questions."""
    s = _sentences(spark, d).where(~F.col("sentence").endswith("?"))
    k = F.row_number().over(Window.partitionBy("record_id").orderBy("pos")) - 1
    return s.select("record_id", F.col("pos").cast("long").alias("pos"), k.cast("long").alias("claim_id"))


@q("flt1_strong_edges", f"with {_FIRST} select doc_id, a, b, sign from e where weight >= 0.75")
def flt1_strong_edges(spark, d):
    return S.signed_edges(relations(spark, d)).where("weight >= 0.75").select("doc_id", "a", "b", "sign")


@q("flt4_eligible", f"""with k as (select doc_id, claim_id from ({CLAIMS}) q where kind in ('asserted', 'premise'))
select doc_id, rel_id from ({ENTITY_RELATIONS}) r join k using (doc_id, claim_id) where confidence >= 0.5""")
def flt4_eligible(spark, d):
    c = stage(claims(spark, d))
    return E.eligible(entity_relations(spark, d, pairs(spark, d, c)), c, S.THRESHOLD, S.ASSERTING).select("doc_id", "rel_id")


@q("flt5_malformed_rationale", """with r as (select distinct reply_id, (output->>'rationale') || case when reply_id % 40 = 0 then ' "relation": "x"' when reply_id % 41 = 0 then ' {' else '' end t from llm where schema_name = 'RelationV22' and output is not null and json_valid(output))
select reply_id, bool_or(regexp_matches(t, '[{}]|["''][A-Za-z_]\\w*["'']\\s*:|\\b(relation|confidence|rationale)["'']?\\s*:')) as malformed from r where t is not null group by 1""")
def flt5_malformed_rationale(spark, d):
    """Rationales that hold a fragment of JSON; some replies get one added."""
    more = F.when(F.col("reply_id") % 40 == 0, ' "relation": "x"').when(F.col("reply_id") % 41 == 0, " {").otherwise("")
    t = F.concat(F.get_json_object("output", "$.rationale"), more)
    r = table(spark, d, "llm").where("schema_name = 'RelationV22' and output is not null").select("reply_id", t.alias("t")).where("t is not null")
    return r.groupBy("reply_id").agg(F.bool_or(F.col("t").rlike(JSON_FRAGMENT)).alias("malformed"))


@q("flt6_relation_validity", f"""with n as (select doc_id, count(*) - 1 n from ({CLAIMS}) q group by 1)
select doc_id, count(*) filter (a >= 0 and a < b and b < n) as valid, count(*) filter (not (a >= 0 and a < b and b < n)) as invalid from ({RELATIONS}) r join n using (doc_id) group by 1""")
def flt6_relation_validity(spark, d):
    """Relations must point from an earlier to a later claim; the last claim of each document is not known here."""
    c = stage(claims(spark, d))
    n = c.groupBy("doc_id").agg((F.count("*") - 1).alias("n"))
    ok = F.expr("a >= 0 and a < b and b < n")
    return relations(spark, d, pairs(spark, d, c)).join(n, "doc_id").groupBy("doc_id").agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"))


@q("flt7_documents", f"with {_LAST} select record_id, x.v as variant from r where x.v in ('planted', 'trap') and x.t like '%older%' and x.b is not null")
def flt7_documents(spark, d):
    """Records by variant, by what their text holds, and with a base."""
    return last_records(spark, d).where("v in ('planted', 'trap') and contains(t, 'older') and b is not null").select("record_id", F.col("v").alias("variant"))


@q("flt8_latest_calls", """select distinct reply_id, model, kind, created_at from llm where created_at is not null order by created_at desc, reply_id desc, model, kind limit 50""")
def flt8_latest_calls(spark, d):
    """The fifty latest calls, without what was sent and answered."""
    c = table(spark, d, "llm").where("created_at is not null").select("reply_id", "model", "kind", "created_at").distinct()
    return c.orderBy(F.desc("created_at"), F.desc("reply_id"), "model", "kind").limit(50)


@q("flt12_scan_coverage", f"""with {_SENT}, w as (select record_id, unnest(regexp_extract_all(lower(sentence), '\\b([a-z]+er) than\\b', 1)) w from s), p(w, attribute) as (values ('older', 'age'), ('younger', 'age'), ('taller', 'height'), ('shorter', 'height'))
select record_id, count(*) as relevant, count(attribute) as covered, count(distinct w.w) filter (attribute is null) as words_without_pattern from w left join p on p.w = w.w group by 1""")
def flt12_scan_coverage(spark, d):
    """Comparisons in a record that the scan's patterns cover, and those that it has none for."""
    p = spark.createDataFrame([("older", "age"), ("younger", "age"), ("taller", "height"), ("shorter", "height")], "w string, attribute string")
    w = _sentences(spark, d).select("record_id", F.explode(F.regexp_extract_all(F.lower("sentence"), F.lit(r"\b([a-z]+er) than\b"), 1)).alias("w"))
    return w.join(F.broadcast(p), "w", "left").groupBy("record_id").agg(
        F.count("*").alias("relevant"), F.count("attribute").alias("covered"), F.count_distinct(F.when(F.col("attribute").isNull(), F.col("w"))).alias("words_without_pattern"))


@q("jn4_planted_pairs", f"""with m as (select distinct doc_id, claim_id, a % 3 as sentence from ({ENTITY_RELATIONS}) r where kind = 'different')
select distinct x.doc_id, x.claim_id as a, y.claim_id as b from m x join m y on x.doc_id = y.doc_id and x.claim_id < y.claim_id and x.sentence <> y.sentence""")
def jn4_planted_pairs(spark, d):
    """Claim pairs matched to two different planted sentences (here: three a document, by the entity).

    Sets of matched sentences meet, not single matches: a document has few different sets, so the pairs are formed
    once each."""
    m = entity_relations(spark, d).where("kind = 'different'").groupBy("doc_id", "claim_id").agg(F.sort_array(F.collect_set(F.col("a") % 3)).alias("s"))
    x, y = m.select("doc_id", F.col("claim_id").alias("a"), F.col("s").alias("p")), m.select("doc_id", F.col("claim_id").alias("b"), F.col("s").alias("t"))
    # only two equal sets of one sentence hold no two different ones
    return x.join(y, "doc_id").where("a < b and not (p = t and size(p) = 1)").select("doc_id", "a", "b")


_PLANTED = f"""pl as (select doc_id, rel_id, claim_id, kind, case when rel_id % 2 = 0 then b else a end a, case when rel_id % 2 = 0 then a else b end b, rel_id % 3 = 0 either from ({ENTITY_RELATIONS}) z where rel_id % 1000 % 5 <> 1),
ex as (select doc_id, claim_id, kind, a, b from ({ENTITY_RELATIONS}) z where confidence >= 0.3),
o as (select pl.*, bool_or(ex.a is not null and (ex.a = pl.a and ex.b = pl.b or kind <> 'greater')) fwd, bool_or(ex.a is not null) met
  from pl left join ex on ex.doc_id = pl.doc_id and ex.claim_id = pl.claim_id and ex.kind = pl.kind and (ex.a = pl.a and ex.b = pl.b or ex.a = pl.b and ex.b = pl.a) group by all)"""


@q("jn5_relations_extracted", f"""with {_PLANTED.replace("or kind <> 'greater'", "or pl.kind <> 'greater'")}, f as (select doc_id, count(distinct fwd) n from o where either and met group by 1)
select doc_id, rel_id, case when fwd then 'forward' when met then 'reverse' end as way, fwd or (met and either and coalesce(f.n, 0) = 1) as extracted from o left join f using (doc_id)""")
def jn5_relations_extracted(spark, d):
    """Planted relations and the way in which they were extracted. One that may stand either way counts if all such of
    its document were extracted the same way; equality and difference have no direction."""
    r = stage(entity_relations(spark, d))
    even = F.col("rel_id") % 2 == 0
    pl = r.where("rel_id % 1000 % 5 <> 1").select(
        "doc_id", "rel_id", "claim_id", "kind", F.when(even, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(even, F.col("a")).otherwise(F.col("b")).alias("b"), (F.col("rel_id") % 3 == 0).alias("either"))
    ex = r.where("confidence >= 0.3").select("doc_id", "claim_id", "kind", "a", "b").distinct()
    fwd = ex.withColumn("fwd", F.lit(True))
    rev = ex.select("doc_id", "claim_id", "kind", F.col("b").alias("a"), F.col("a").alias("b"), (F.col("kind") != "greater").alias("fwd"))
    way = fwd.unionByName(rev).groupBy("doc_id", "claim_id", "kind", "a", "b").agg(F.bool_or("fwd").alias("fwd"))
    o = stage(pl.join(way, ["doc_id", "claim_id", "kind", "a", "b"], "left"))
    n = o.where("either and fwd is not null").groupBy("doc_id").agg(F.count_distinct("fwd").alias("n"))
    either = F.col("fwd").isNotNull() & F.col("either") & (F.coalesce("n", F.lit(0)) == 1)
    return o.join(n, "doc_id", "left").select(
        "doc_id", "rel_id", F.when(F.col("fwd"), "forward").when(F.col("fwd").isNotNull(), "reverse").alias("way"), (F.coalesce("fwd", F.lit(False)) | either).alias("extracted"))


@q("jn8_edge_kinds", f"""with {_FIRST}, k as (select doc_id, claim_id, kind from ({CLAIMS}) q) select x.kind as kind_a, y.kind as kind_b, count(*) as edges from e
join k x on x.doc_id = e.doc_id and x.claim_id = a join k y on y.doc_id = e.doc_id and y.claim_id = b group by 1, 2""")
def jn8_edge_kinds(spark, d):
    c = stage(claims(spark, d))
    e = S.signed_edges(relations(spark, d, pairs(spark, d, c)))
    side = lambda k: c.select("doc_id", F.col("claim_id").alias(k), F.col("kind").alias(f"kind_{k}"))
    return e.join(side("a"), ["doc_id", "a"]).join(side("b"), ["doc_id", "b"]).groupBy("kind_a", "kind_b").agg(F.count("*").alias("edges"))


@q("jn15_batch_items", """with i as (select distinct doc_id, sha256('blind' || chr(10) || doc_id) as review_id from export_records where doc_id is not null),
v as (select distinct seq, sha256('blind' || chr(10) || doc_id) as review_id, lower(trim(decision)) as dec from decisions where kind = 'decision' and doc_id is not null)
select i.doc_id, count(v.seq) as reviews, count(v.seq) filter (dec = 'discard') as discards from i left join v using (review_id) group by 1""")
def jn15_batch_items(spark, d):
    """Reviews that only name an item's opaque id, brought back to the documents."""
    opaque = F.sha2(F.concat(F.lit("blind\n"), F.col("doc_id")), 256).alias("review_id")
    i = table(spark, d, "export_records").where("doc_id is not null").select("doc_id", opaque).distinct()
    v = table(spark, d, "decisions").where("kind = 'decision' and doc_id is not null").select("seq", opaque, S.enum_key(F.col("decision")).alias("dec")).distinct()
    return i.join(v, "review_id", "left").groupBy("doc_id").agg(F.count("seq").alias("reviews"), F.count_if(F.col("dec") == "discard").alias("discards"))


@q("jn26_audit", f"""with s as (select doc_id, claim_id, kind <> 'quoted' as has from ({CLAIMS}) q where claim_id % 7 <> 3), m as (select doc_id, claim_id, case k % 5 when 0 then 'absent' when 1 then 'contradicted' when 2 then 'unclear' when 3 then 'implied' else 'stated' end status
  from ({CLAIMS}) q where claim_id % 5 <> 2)
select doc_id, claim_id, case when s.has is null then 'unknown fact' when m.status is null then 'unmarked' when status = 'unclear' then 'no status' when has and status in ('absent', 'contradicted') then 'span but marked' else 'no span but marked' end as problem
from s full outer join m using (doc_id, claim_id) where s.has is null or m.status is null or status = 'unclear' or (has and status in ('absent', 'contradicted')) or (not has and status <> 'absent')""")
def jn26_audit(spark, d):
    """Where an audit's marks disagree with the spans that facts have; both lists lack some of the other's facts."""
    c = stage(claims(spark, d))
    s = c.where("claim_id % 7 <> 3").select("doc_id", "claim_id", (F.col("kind") != "quoted").alias("has"))
    k = F.col("k") % 5
    mark = F.when(k == 0, "absent").when(k == 1, "contradicted").when(k == 2, "unclear").when(k == 3, "implied").otherwise("stated")
    j = s.join(c.where("claim_id % 5 <> 2").select("doc_id", "claim_id", mark.alias("status")), ["doc_id", "claim_id"], "full_outer")
    problem = (
        F.when(F.col("has").isNull(), "unknown fact").when(F.col("status").isNull(), "unmarked").when(F.col("status") == "unclear", "no status")
        .when(F.col("has") & F.col("status").isin("absent", "contradicted"), "span but marked").when(~F.col("has") & (F.col("status") != "absent"), "no span but marked")
    )
    return j.select("doc_id", "claim_id", problem.alias("problem")).where("problem is not null")


@q("jn27_entity_names", """with u as (select distinct trim(regexp_replace(lower(trim(genre)), '[^a-z0-9]+', '_', 'g'), '_') k from units where genre is not null),
n as (select distinct trim(regexp_replace(lower(trim(split_part(category, ' ', 1))), '[^a-z0-9]+', '_', 'g'), '_') k from targets where dimension = 'genre'
  union select distinct trim(regexp_replace(lower(trim(category)), '[^a-z0-9]+', '_', 'g'), '_') from targets where dimension = 'genre')
select u.k as entity, n.k as name, u.k = n.k as same from u, n where contains('_' || u.k || '_', '_' || n.k || '_')""")
def jn27_entity_names(spark, d):
    """Entities that are a name, or hold it as whole words. Each entity's runs of words are looked up, so entities and
    names are not multiplied."""
    u = table(spark, d, "units").where("genre is not null").select(E.canonical_key(F.col("genre")).alias("entity")).distinct()
    c = table(spark, d, "targets").where("dimension = 'genre'")
    n = c.select(E.canonical_key(F.split_part("category", F.lit(" "), F.lit(1))).alias("name")).union(c.select(E.canonical_key(F.col("category")))).distinct()
    w = F.split("entity", "_")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: F.transform(F.sequence(i, F.size(w)), lambda j: F.array_join(F.slice(w, i, j - i + 1), "_"))))
    return u.select("entity", F.explode(F.array_distinct(runs)).alias("name")).join(n, "name").select("entity", "name", (F.col("entity") == F.col("name")).alias("same"))


@q("ag13_change_by_threshold", """with v as (select l_suppkey, l_partkey % 20 as unit, l_linenumber % 3 as repeat, max(l_discount * 10) as score from lineitem group by 1, 2, 3),
t as (select *, score >= tau as yes from v cross join (values (0.5), (0.7), (0.9)) t(tau)), u as (select l_suppkey, unit, tau, count(distinct yes) > 1 as changed from t group by 1, 2, 3)
select cast(tau as double) as tau, count(*) as units, count(*) filter (changed) as changed, avg(cast(changed as int)) as change_rate from u group by 1""", floats="change_rate")
def ag13_change_by_threshold(spark, d):
    """How often the repeats of one unit fall on both sides of a threshold."""
    v = table(spark, d, "lineitem").groupBy("l_suppkey", (F.col("l_partkey") % 20).alias("unit"), (F.col("l_linenumber") % 3).alias("repeat")).agg(F.max(F.col("l_discount") * 10).alias("score"))
    t = v.withColumn("tau", F.explode(F.array(*[F.lit(x) for x in (0.5, 0.7, 0.9)])))
    u = t.groupBy("l_suppkey", "unit", "tau").agg((F.count_distinct(F.col("score") >= F.col("tau")) > 1).alias("changed"))
    return u.groupBy("tau").agg(F.count("*").alias("units"), F.count_if("changed").alias("changed"), V.rate(F.col("changed")).alias("change_rate"))


_TAU_ROWS = ", ".join(f"({t})" for t in TAUS)
_METHODS = f"""{_S}, u as (select model, t.tau, 'score' as method, score >= tau as verdict, truth from s cross join (values {_TAU_ROWS}) t(tau)
  union all select model, tau, 'both', verdict and score >= tau, truth from s cross join (values {_TAU_ROWS}) t(tau) union all select model, tau, 'either', verdict or score >= tau, truth from s cross join (values {_TAU_ROWS}) t(tau)),
m as (select model, method, tau, {_PRF} from u group by 1, 2, 3), g as (select *, {_F1} f1 from m)"""


def by_method(spark, d):
    """Verdicts of three methods at every threshold of the grid, counted per model before any score is taken."""
    s = scored(spark, d).withColumn("tau", F.explode(F.array(*[F.lit(t) for t in TAUS])))
    high = F.col("score") >= F.col("tau")
    s = s.select("model", "tau", "truth", high.alias("h"), (F.col("verdict") & high).alias("b"), (F.col("verdict") | high).alias("e"))
    u = s.select("model", "tau", "truth", F.expr("stack(3, 'score', h, 'both', b, 'either', e) as (method, said)"))
    return V.prf(u, "said", "truth", ["model", "method", "tau"])


@q("ag16_method_report", f"""with {_METHODS} select method, cast(tau as double) as tau, count(*) as models, avg(f1) as mean, max(f1) - min(f1) as spread, cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp from g group by 1, 2""", floats="mean spread")
def ag16_method_report(spark, d):
    """Each method at each threshold: mean score of the models and how far they lie apart."""
    return by_method(spark, d).groupBy("method", "tau").agg(
        F.count("*").alias("models"), F.avg("f1").alias("mean"), (F.max("f1") - F.min("f1")).alias("spread"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))


@q("ag17_comparisons", f"""with {_S}, u as (select 'score' method, score >= 0.5 a, score >= 0.8 b, truth from s union all select 'both', verdict and score >= 0.5, verdict and score >= 0.8, truth from s
union all select 'either', verdict or score >= 0.5, verdict or score >= 0.8, truth from s)
select method, count(*) filter (a and truth and not b) as lost, count(*) filter (b and truth and not a) as gained, count(*) filter (a and not truth and not b) as false_gone, count(*) filter (b and not truth and not a) as false_new from u group by 1""")
def ag17_comparisons(spark, d):
    """What each method gains and loses between two thresholds."""
    lo, hi, v = F.col("score") >= 0.5, F.col("score") >= 0.8, F.col("verdict")
    s = scored(spark, d).select("truth", lo.alias("s1"), hi.alias("s2"), (v & lo).alias("b1"), (v & hi).alias("b2"), (v | lo).alias("e1"), (v | hi).alias("e2"))
    u = s.select("truth", F.expr("stack(3, 'score', s1, s2, 'both', b1, b2, 'either', e1, e2) as (method, a, b)"))
    n = lambda text, name: F.count_if(F.expr(text)).alias(name)
    return u.groupBy("method").agg(n("a and truth and not b", "lost"), n("b and truth and not a", "gained"), n("a and not truth and not b", "false_gone"), n("b and not truth and not a", "false_new"))


@q("rm6_flag_views", f"""with {_METHODS} select model, cast(tau as double) as tau, cast(sum(tp + fp) filter (method = 'score') as bigint) as by_score, cast(sum(tp + fp) filter (method = 'both') as bigint) as by_both, cast(sum(tp + fp) filter (method = 'either') as bigint) as by_either from m group by 1, 2""")
def rm6_flag_views(spark, d):
    """What each method flags at each threshold, side by side."""
    flagged = lambda m: F.sum(F.when(F.col("method") == m, F.col("tp") + F.col("fp"))).alias(f"by_{m}")
    return by_method(spark, d).groupBy("model", "tau").agg(flagged("score"), flagged("both"), flagged("either"))


@q("rm7_selected_view", f"""with {_METHODS}, b as (select model, method, tau from g qualify row_number() over (partition by model, method order by round(f1, 12) desc, tau) = 1)
select model, method, cast(tau as double) as tau, tp, fp, fn, f1 from g join b using (model, method, tau)""", floats="f1")
def rm7_selected_view(spark, d):
    """Every method of every model at its own best threshold."""
    g = stage(by_method(spark, d))
    best = V.best_threshold(g, ["model", "method"]).select("model", "method", "tau")
    return g.join(best, ["model", "method", "tau"]).select("model", "method", "tau", "tp", "fp", "fn", "f1")


@q("rm8_planted_cycles", f"""with recursive {_CLASSED}, {_ORDER}, t as (select distinct x.doc_id, x.attribute, x.a, x.b, y.b as c from r x join r y on y.doc_id = x.doc_id and y.attribute = x.attribute and y.a = x.b and y.kind = 'greater'
  where x.kind = 'greater' and x.a <> x.b and y.a <> y.b and x.a <> y.b)
select t.doc_id, t.attribute, t.a, t.b, t.c, exists (select 1 from r z where z.doc_id = t.doc_id and z.attribute = t.attribute and z.kind = 'greater' and z.a = t.c and z.b = t.a) as closes,
 exists (select 1 from reach w where w.doc_id = t.doc_id and w.attribute = t.attribute and w.s = w.v) as reported from t""")
def rm8_planted_cycles(spark, d):
    """Chains of two orders: whether a third closes them, and whether a cycle is reported for their attribute."""
    r = stage(entity_relations(spark, d))
    k = ["doc_id", "attribute"]
    g = stage(r.where("kind = 'greater' and a <> b").select(*k, "a", "b").distinct())
    t = g.join(g.select(*k, F.col("a").alias("b"), F.col("b").alias("c")), [*k, "b"]).where("a <> c")
    closing = g.select(*k, F.col("a").alias("c"), F.col("b").alias("a"), F.lit(True).alias("closes"))
    seen = E.contradictions(r, _arity_of(r)).where("type = 'order_cycle'").select(*k, F.lit(True).alias("reported"))
    return t.join(closing, [*k, "c", "a"], "left").join(seen, k, "left").select(*k, "a", "b", "c", F.coalesce("closes", F.lit(False)).alias("closes"), F.coalesce("reported", F.lit(False)).alias("reported"))


@q("wn1_residual_ranking", f"""with {_FIRST}, v as (select doc_id, a claim_id, weight * power(1 - sign, 2) x from e union all select doc_id, b, weight * power(1 - sign, 2) from e),
s as (select doc_id, claim_id, sum(x) residual from v group by 1, 2), n as (select doc_id, sum(weight) scale from e group by 1)
select doc_id, claim_id, row_number() over (partition by doc_id order by round(residual / m, 9) desc, claim_id) as rank from (select *, max(residual) over (partition by doc_id) m from s) join n using (doc_id)
where residual > 1e-12 * scale qualify row_number() over (partition by doc_id order by round(residual / m, 9) desc, claim_id) <= 3""")
def wn1_residual_ranking(spark, d):
    """The three claims of each document that fit worst if all are taken as true."""
    e = stage(S.signed_edges(relations(spark, d)))
    x = (F.col("weight") * F.pow(1 - F.col("sign"), 2)).alias("x")
    v = e.select("doc_id", F.col("a").alias("claim_id"), x).unionByName(e.select("doc_id", F.col("b").alias("claim_id"), x))
    s = v.groupBy("doc_id", "claim_id").agg(F.sum("x").alias("residual")).join(e.groupBy("doc_id").agg(F.sum("weight").alias("scale")), "doc_id")
    return S.residual_ranking(s, F.lit(1e-12) * F.col("scale")).withColumn("rank", F.col("rank").cast("long"))


@q("wn14_ball_masses", """with c as (select o_custkey as source, year(o_orderdate) - 1990 as hops, count(*) n from orders group by 1, 2) select source, hops, cast(sum(n) over (partition by source order by hops) as bigint) as mass from c""")
def wn14_ball_masses(spark, d):
    """Shell counts summed up to ball masses, with years as shells."""
    c = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("source"), (F.year("o_orderdate") - 1990).cast("long").alias("hops")).agg(F.count("*").alias("n"))
    return c.select("source", "hops", F.sum("n").over(Window.partitionBy("source").orderBy("hops").rowsBetween(Window.unboundedPreceding, 0)).alias("mass"))


@q("gr23_diagnostics", f"""with {_FIRST}, c as (select * from ({CLAIMS}) q), miss as (select x.doc_id, count(*) n from c x join c y on x.doc_id = y.doc_id and y.claim_id = x.claim_id + 2
 where not exists (select 1 from f where f.doc_id = x.doc_id and f.a = x.claim_id and f.b = y.claim_id) group by 1),
g as (select doc_id, count(*) pairs, cast(sum(c - 1) as bigint) repeats, count(*) filter (relation = 'tension') tension, count(*) filter (relation = 'unrelated') unrelated,
  count(*) filter (b - a = 3) blind, count(*) filter (b - a = 3 and relation in ('supports', 'contradicts')) blind_related from f group by 1), d as (select distinct doc_id from c)
select d.doc_id, coalesce(pairs, 0) as pairs, coalesce(repeats, 0) as repeats, coalesce(tension, 0) as tension, coalesce(unrelated, 0) as unrelated, coalesce(blind, 0) as blind, coalesce(blind_related, 0) as blind_related, coalesce(miss.n, 0) as unscored
from d left join g using (doc_id) left join miss using (doc_id)""")
def gr23_diagnostics(spark, d):
    """Per document: pairs, later statements of the same pair, tension, pairs without a relation, and blind pairs."""
    c = stage(claims(spark, d))
    f = stage(S.first_wins(relations(spark, d, pairs(spark, d, c))))
    k = F.col("relation")
    g = f.groupBy("doc_id").agg(
        F.count("*").alias("pairs"), F.sum("repeats").alias("repeats"), F.count_if(k == "tension").alias("tension"), F.count_if(k == "unrelated").alias("unrelated"),
        F.count_if(F.expr("b - a = 3")).alias("blind"), F.count_if(F.expr("b - a = 3 and relation in ('supports', 'contradicts')")).alias("blind_related"))
    asked = c.select("doc_id", F.col("claim_id").alias("a"), (F.col("claim_id") + 2).alias("b")).join(c.select("doc_id", F.col("claim_id").alias("b")), ["doc_id", "b"], "left_semi")
    miss = asked.join(f, ["doc_id", "a", "b"], "left_anti").groupBy("doc_id").agg(F.count("*").alias("unscored"))
    return c.select("doc_id").distinct().join(g, "doc_id", "left").join(miss, "doc_id", "left").fillna(0)


@q("rm1_analysis", f"""with recursive {_FIRST}, {_STRONG}, {_COVER}, {_UNBALANCED}, {_CLASSED}, {_PARITY}, {_ORDER},
 t as (select distinct doc_id, attribute, 1 k from c where kind = 'different' and ca = cb union select distinct doc_id, attribute, 2 from odd where s = v and p = 1 union select distinct doc_id, attribute, 3 from reach where s = v),
 n as (select doc_id, count(*) claims from ({CLAIMS}) q group by 1)
select n.doc_id, claims, (select count(*) from e where e.doc_id = n.doc_id) as edges, (select count(distinct s) from walk w where w.doc_id = n.doc_id and s = v and p = 1) as unbalanced, (select count(*) from t where t.doc_id = n.doc_id) as contradictions from n""")
def rm1_analysis(spark, d):
    """One row a document from its claims to its contradictions."""
    c = stage(claims(spark, d))
    p = pairs(spark, d, c)
    e = stage(S.signed_edges(relations(spark, d, p)))
    r = entity_relations(spark, d, p)
    count = lambda df, name: df.groupBy("doc_id").agg(F.count("*").alias(name))
    out = count(c, "claims")
    for part in (count(e, "edges"), count(S.unbalanced_claims(e.where("weight >= 0.5")), "unbalanced"), count(E.contradictions(r, _arity_of(r)), "contradictions")):
        out = out.join(part, "doc_id", "left")
    return out.fillna(0)


@q("rm3_open_requests", """with r as (select reply_id, arg_max(request, (created_at, request)) q, min(created_at) t0 from llm where request is not null group by 1), done as (select distinct sha256(q) k from r where reply_id % 4 = 0)
select sha256(q) as key, min(reply_id) as first, count(*) as wanted from r where sha256(q) not in (select k from done) group by 1""")
def rm3_open_requests(spark, d):
    """Requests that no kept reply answers: the work list, each once."""
    r = table(spark, d, "llm").where("request is not null").groupBy("reply_id").agg(F.max_by("request", F.struct("created_at", "request")).alias("q"))
    r = stage(r.select("reply_id", F.sha2("q", 256).alias("key")))
    return r.join(r.where("reply_id % 4 = 0").select("key").distinct(), "key", "left_anti").groupBy("key").agg(F.min("reply_id").alias("first"), F.count("*").alias("wanted"))


@q("rm10_review_protocol", f"""with {_LAST}, b as (select upper(trim(x.b)) base, count(*) n, bool_or(x.f is not null) flagged from r where x.b is not null and trim(x.b) <> '' group by 1)
select base, case when flagged then 'flag' else 'sample' end as reason from (select *, row_number() over (partition by flagged order by md5('10|' || base)) rn, count(*) over (partition by flagged) t from b) z where flagged or rn <= greatest(ceil(t * 10 / 100.0), 1)""")
def rm10_review_protocol(spark, d):
    """Every base with a derived record, and a seeded tenth of the others."""
    r = last_records(spark, d).where("b is not null and trim(b) <> ''")
    b = stage(r.groupBy(F.upper(F.trim("b")).alias("base")).agg(F.bool_or(F.col("f").isNotNull()).alias("flagged")))
    s = A.spot_check(b.where("not flagged").withColumn("all", F.lit(1)), ["all"], "base", 10, 1, 10)
    return b.where("flagged").select("base", F.lit("flag").alias("reason")).unionByName(s.select("base", F.lit("sample").alias("reason")))


@q("rm26_revisions", """with c as (select l_orderkey, l_linenumber, l_tax as old from lineitem where l_returnflag = 'R'), n as (select l_orderkey, l_suppkey % 7 + 1 as l_linenumber, count(*) n, min(l_tax) as new from lineitem where l_linestatus = 'F' group by 1, 2)
select l_orderkey, l_linenumber, case when c.old is null then 'not asked' when n.n is null then 'missing' when n.n > 1 then 'repeated' when n.new = c.old then 'unchanged' else 'good' end as state from c full outer join n using (l_orderkey, l_linenumber)""")
def rm26_revisions(spark, d):
    """New wordings against the facts to restate: each needs exactly one, which differs from the old."""
    l = table(spark, d, "lineitem")
    c = l.where("l_returnflag = 'R'").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.col("l_tax").alias("old"))
    n = l.where("l_linestatus = 'F'").groupBy("l_orderkey", (F.col("l_suppkey") % 7 + 1).cast("long").alias("l_linenumber")).agg(F.count("*").alias("n"), F.min("l_tax").alias("new"))
    state = F.when(F.col("old").isNull(), "not asked").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated").when(F.col("new") == F.col("old"), "unchanged").otherwise("good")
    return c.join(n, ["l_orderkey", "l_linenumber"], "full_outer").select("l_orderkey", "l_linenumber", state.alias("state"))


@q("rv1_blind_batches", """with e as (select distinct doc_id, genre from export_records where doc_id is not null), g as (select doc_id, min(genre) genre from e group by 1),
t as (select *, row_number() over (partition by genre order by md5('12|' || doc_id)) turn from g), h as (select doc_id, turn, sha256('review' || chr(10) || doc_id) opaque_id from t)
select opaque_id, doc_id, turn % 4 as panel, cast((row_number() over (partition by turn % 4 order by opaque_id) - 1) // 15 as int) as batch from h""")
def rv1_blind_batches(spark, d):
    """Documents dealt by genre to four panels, under opaque ids, in batches of fifteen."""
    g = table(spark, d, "export_records").where("doc_id is not null").groupBy("doc_id").agg(F.min("genre").alias("genre"))
    from plumbline.operators.sequences import hash_rank

    t = hash_rank(g.withColumn("h", F.md5(F.concat(F.lit("12|"), F.col("doc_id")))), ["genre"], "h", "turn")
    t = t.select("doc_id", F.pmod(F.col("turn") + 1, F.lit(4)).cast("long").alias("panel"))
    return A.batches(t, ["panel"], "doc_id", 15, "review").select("opaque_id", "doc_id", "panel", "batch")


@q("pv1_seal", """with r as (select record_id, arg_max(sha256(coalesce(text, '')), (exported_at, text)) h, arg_max(split, (exported_at, text)) split from export_records where record_id is not null group by 1)
select split, count(*) as records, bit_xor(cast('0x' || substr(h, 1, 15) as bigint)) as seal from r group by 1""")
def pv1_seal(spark, d):
    """A seal over each split's text digests that does not depend on their order, so no list is gathered."""
    r = table(spark, d, "export_records").where("record_id is not null").groupBy("record_id").agg(
        F.max_by(F.struct(F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"), "split"), F.struct("exported_at", "text")).alias("x")).select("x.*")
    return r.groupBy("split").agg(F.count("*").alias("records"), F.bit_xor(F.conv(F.substring("h", 1, 15), 16, 10).cast("long")).alias("seal"))


@q("pv1_verify", f"""with {_LAST}, now as (select record_id, sha256(case when record_id % 31 = 0 then x.t || ' ' else x.t end) h from r where record_id % 37 <> 0), then_ as (select record_id, sha256(x.t) h from r where record_id % 41 <> 0)
select record_id, case when now.h is null then 'missing' when then_.h is null then 'extra' else 'changed' end as state from now full outer join then_ using (record_id) where now.h is null or then_.h is null or now.h <> then_.h""")
def pv1_verify(spark, d):
    """A manifest checked against the records: some are taken out, added or changed here."""
    r = stage(last_records(spark, d).select("record_id", "t"))
    now = r.where("record_id % 37 <> 0").select("record_id", F.sha2(F.when(F.col("record_id") % 31 == 0, F.concat("t", F.lit(" "))).otherwise(F.col("t")), 256).alias("now"))
    then = r.where("record_id % 41 <> 0").select("record_id", F.sha2("t", 256).alias("then"))
    state = F.when(F.col("now").isNull(), "missing").when(F.col("then").isNull(), "extra").when(F.col("now") != F.col("then"), "changed")
    return now.join(then, "record_id", "full_outer").select("record_id", state.alias("state")).where("state is not null")


@q("src2_bases", f"with {_LAST} select record_id, cast(regexp_extract(x.b, '([0-9]+)', 1) as bigint) as base from r where cast(nullif(regexp_extract(x.b, '([0-9]+)', 1), '') as bigint) in (1, 2, 3, 5, 8)")
def src2_bases(spark, d):
    """The records of the bases asked for."""
    n = F.nullif(F.regexp_extract("b", "([0-9]+)", 1), F.lit("")).cast("long")
    return last_records(spark, d).select("record_id", n.alias("base")).where("base in (1, 2, 3, 5, 8)")


queries, oracle_sql = family.queries, family.oracle_sql
