"""Queries that match claims, sentences, statements, reviews and lists with one another."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators import allocation as A
from plumbline.operators import entity_graph as E
from plumbline.operators import signed_graph as S
from plumbline.operators.evaluation import ratio
from plumbline.plans.bindings import CLAIMS, ENTITY_RELATIONS, RELATIONS, claims, entity_relations, pairs, relations
from plumbline.plans.consistency import _CLASSED, _FIRST
from plumbline.plans.registry import Family
from plumbline.session import stage, table

family = Family()
q = family.query

_LAST = "r as (select record_id, arg_max({b: base_id, d: doc_id, f: derived_from, t: coalesce(text, ''), p: plant_type, v: lower(trim(variant))}, (exported_at, text)) x from export_records group by 1)"


def last_records(spark, d):
    cols = [F.col("base_id").alias("b"), F.col("doc_id").alias("d"), F.col("derived_from").alias("f"), F.coalesce("text", F.lit("")).alias("t"),
            F.col("plant_type").alias("p"), F.lower(F.trim("variant")).alias("v")]
    return table(spark, d, "export_records").groupBy("record_id").agg(F.max_by(F.struct(*cols), F.struct("exported_at", "text")).alias("x")).select("record_id", "x.*")


@q("jn2_blind_sample", f"""with {_FIRST}, c as (select * from ({CLAIMS}) q), n as (select doc_id, count(*) n from c group by 1 having count(*) > 12), f2 as (select distinct doc_id, a, b from f where doc_id in (select doc_id from n)),
p as (select x.doc_id, x.claim_id a, y.claim_id b from c x join c y on x.doc_id = y.doc_id and x.claim_id < y.claim_id where x.doc_id in (select doc_id from n)
  and not exists (select 1 from f2 where f2.doc_id = x.doc_id and f2.a = x.claim_id and f2.b = y.claim_id)),
k as (select *, row_number() over (partition by doc_id order by md5('8|' || doc_id || '|' || a || '|' || b)) rn, count(*) over (partition by doc_id) t from p)
select doc_id, a, b, true as blind from k where rn <= ceil(t * 10 / 100.0) union all select doc_id, a, b, false from f2""")
def jn2_blind_sample(spark, d):
    """In documents of more than twelve claims (usually 25, which none here has): the pairs that were proposed, and a
    seeded tenth, rounded up, of all others. The pairs are what is sampled, so each is made once; a document's number of
    claims bounds them."""
    c = stage(claims(spark, d))
    f = S.first_wins(relations(spark, d, pairs(spark, d, c))).select("doc_id", "a", "b")
    big = c.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 12").select("doc_id")
    f = stage(f.join(big, "doc_id", "left_semi"))
    n = c.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 12")
    p = n.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 2)).alias("a")).select(
        "doc_id", "a", F.explode(F.sequence(F.col("a") + 1, F.col("n") - 1)).alias("b"))
    p = p.select("doc_id", F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"))
    p = p.join(f, ["doc_id", "a", "b"], "left_anti").withColumn("pair", F.concat_ws("|", "doc_id", "a", "b"))
    p = stage(p)
    kept = p.join(A.spot_check(p, ["doc_id"], "pair", 10, 1, 8).select("pair"), "pair", "left_semi")
    return kept.select("doc_id", "a", "b", F.lit(True).alias("blind")).unionByName(f.withColumn("blind", F.lit(False)))


@q("jn7_blind_pairs_related", f"""with {_FIRST}, p as (select * from f where b - a = 3) select doc_id, count(*) as blind, count(*) filter (relation in ('supports', 'contradicts')) as related from p group by 1""")
def jn7_blind_pairs_related(spark, d):
    f = S.first_wins(relations(spark, d)).where("b - a = 3")
    return f.groupBy("doc_id").agg(F.count("*").alias("blind"), F.count_if(F.col("relation").isin("supports", "contradicts")).alias("related"))


@q("jn12_tension_before", f"""with {_FIRST}, p as (select doc_id, a, b, relation from f), o as (select doc_id, least(a, b) a, greatest(a, b) b, max(lower(trim(relation))) old from ({RELATIONS}) z where seq >= 1000000 group by 1, 2, 3)
select coalesce(o.old, 'none') as before, p.relation as now, count(*) as n from p left join o using (doc_id, a, b) where p.relation = 'tension' group by 1, 2""")
def jn12_tension_before(spark, d):
    r = relations(spark, d)
    now = S.first_wins(r).select("doc_id", "a", "b", "relation")
    old = S.first_wins(r.where("seq >= 1000000")).select("doc_id", "a", "b", F.col("relation").alias("old"))
    j = now.where("relation = 'tension'").join(old, ["doc_id", "a", "b"], "left")
    return j.groupBy(F.coalesce("old", F.lit("none")).alias("before"), F.col("relation").alias("now")).agg(F.count("*").alias("n"))


@q("jn13_label_diff", f"""with x as (select doc_id, a, b, lower(trim(relation)) r from ({RELATIONS}) z where seq < 1000000), y as (select doc_id, b a, a b, lower(trim(relation)) r from ({RELATIONS}) z where seq >= 1000000)
select doc_id, a, b, x.r as first, y.r as second from x join y using (doc_id, a, b) where x.r <> y.r""")
def jn13_label_diff(spark, d):
    r = relations(spark, d).withColumn("r", S.enum_key(F.col("relation")))
    x = r.where("seq < 1000000").select("doc_id", "a", "b", F.col("r").alias("first"))
    y = r.where("seq >= 1000000").select("doc_id", F.col("b").alias("a"), F.col("a").alias("b"), F.col("r").alias("second"))
    return x.join(y, ["doc_id", "a", "b"]).where("first <> second")


@q("jn9_inventory", f"""with r as (select * from ({ENTITY_RELATIONS}) q), e as (select distinct doc_id, a as e from r where kind <> 'same') select r.doc_id, count(*) as statements,
 count(*) filter (r.a not in (select e from e where e.doc_id = r.doc_id)) as unknown_a, count(*) filter (r.b not in (select e from e where e.doc_id = r.doc_id)) as unknown_b from r group by 1""")
def jn9_inventory(spark, d):
    """Statements whose entities are not in the document's inventory, here: entities that ever stand first."""
    r = entity_relations(spark, d)
    e = r.where("kind <> 'same'").select("doc_id", F.col("a").alias("e"), F.lit(True).alias("ok")).distinct()
    side = lambda k: e.select("doc_id", F.col("e").alias(k), F.col("ok").alias(f"ok_{k}"))
    j = r.join(side("a"), ["doc_id", "a"], "left").join(side("b"), ["doc_id", "b"], "left")
    return j.groupBy("doc_id").agg(F.count("*").alias("statements"), F.count_if(F.col("ok_a").isNull()).alias("unknown_a"), F.count_if(F.col("ok_b").isNull()).alias("unknown_b"))


@q("jn10_superlatives", f"""with recursive {_CLASSED}, x as (select doc_id, claim_id, attribute, a entity, case when claim_id % 2 = 0 then 'max' else 'min' end side from r where kind = 'greater'),
p as (select distinct doc_id, attribute, a o from r union select distinct doc_id, attribute, b from r),
j as (select x.*, p.o, coalesce(s.class, x.entity) ca, coalesce(t.class, p.o) cb from x join p using (doc_id, attribute)
 left join cls s on s.doc_id = x.doc_id and s.attribute = x.attribute and s.entity = x.entity left join cls t on t.doc_id = x.doc_id and t.attribute = x.attribute and t.entity = p.o)
select distinct doc_id, claim_id, attribute, case side when 'max' then entity else o end as a, case side when 'max' then o else entity end as b from j where ca <> cb""")
def jn10_superlatives(spark, d):
    """Every order statement read as a superlative, of even claims as the most and of odd ones as the least, expanded over
    the attribute's other participants."""
    r = stage(entity_relations(spark, d))
    x = r.where("kind = 'greater'").select(
        "doc_id", "claim_id", "attribute", F.col("a").alias("entity"), F.when(F.col("claim_id") % 2 == 0, "max").otherwise("min").alias("side"))
    p = r.select("doc_id", "attribute", F.col("a").alias("entity")).union(r.select("doc_id", "attribute", "b")).distinct()
    return E.expand_superlatives(x, p, E.equality_classes(r)).drop("side").distinct()


@q("jn28_closing_triples", f"""with g as (select distinct doc_id, attribute, a, b from ({ENTITY_RELATIONS}) q where kind = 'greater' and a <> b)
select x.doc_id, x.attribute, x.a, x.b, y.b as c from g x join g y on y.doc_id = x.doc_id and y.attribute = x.attribute and y.a = x.b
join g z on z.doc_id = x.doc_id and z.attribute = x.attribute and z.a = y.b and z.b = x.a where x.a < x.b and x.a < y.b and x.b <> y.b""")
def jn28_closing_triples(spark, d):
    """Three orders that chain into a cycle, each cycle once."""
    g = stage(entity_relations(spark, d).where("kind = 'greater' and a <> b").select("doc_id", "attribute", "a", "b").distinct())
    k = ["doc_id", "attribute"]
    y = g.select(*k, F.col("a").alias("b"), F.col("b").alias("c"))
    z = g.select(*k, F.col("a").alias("c"), F.col("b").alias("a"))
    return g.join(y, [*k, "b"]).join(z, [*k, "c", "a"]).where("a < b and a < c and b <> c").select(*k, "a", "b", "c")


@q("gr22_minimal_verdict", f"""with {_FIRST}, k as (select * from ({CLAIMS}) q where kind in ('asserted', 'premise'))
select distinct e.doc_id, true as inconsistent from e join k x on x.doc_id = e.doc_id and x.claim_id = a join k y on y.doc_id = e.doc_id and y.claim_id = b where sign < 0 and weight >= 0.5""")
def gr22_minimal_verdict(spark, d):
    """Documents that the direct clause alone calls inconsistent."""
    return S.direct_pairs(S.signed_edges(relations(spark, d)), claims(spark, d)).select("doc_id").distinct().withColumn("inconsistent", F.lit(True))


@q("gr21_uncovered_claims", f"""with c as (select * from ({CLAIMS}) q), a as (select distinct doc_id, claim_id from ({ENTITY_RELATIONS}) z where confidence >= 0.5)
select doc_id, claim_id from c where kind <> 'quoted' and not exists (select 1 from a where a.doc_id = c.doc_id and a.claim_id = c.claim_id)""")
def gr21_uncovered_claims(spark, d):
    """Asserting claims that no confident statement was taken from."""
    said = entity_relations(spark, d).where("confidence >= 0.5").select("doc_id", "claim_id").distinct()
    return claims(spark, d).where("kind <> 'quoted'").select("doc_id", "claim_id").join(said, ["doc_id", "claim_id"], "left_anti")


@q("gr24_localised", f"""with {_FIRST}, p as (select doc_id, claim_id from ({CLAIMS}) q where claim_id % 4 in (0, 1)), g as (select doc_id, a, b from e where sign < 0 and weight >= 0.5),
m as (select g.doc_id, g.a, g.b, count(distinct p.claim_id) n from g join p on p.doc_id = g.doc_id and p.claim_id in (g.a, g.b) group by 1, 2, 3) select doc_id, count(*) filter (n >= 2) > 0 as localised from m group by 1""")
def gr24_localised(spark, d):
    """Whether some reported pair covers two of the document's planted claims."""
    e = S.signed_edges(relations(spark, d)).where("sign < 0 and weight >= 0.5")
    planted = claims(spark, d).where("claim_id % 4 in (0, 1)").select("doc_id", "claim_id")
    ends = e.select("doc_id", "a", "b", F.explode(F.array("a", "b")).alias("claim_id"))
    n = ends.join(planted, ["doc_id", "claim_id"]).groupBy("doc_id", "a", "b").agg(F.count_distinct("claim_id").alias("n"))
    return n.groupBy("doc_id").agg(F.bool_or(F.col("n") >= 2).alias("localised"))


def order_cycles(r, longest):
    """Simple order cycles of two up to ``longest`` relations, counted per length, each once: it starts at its smallest entity."""
    g = stage(r.where("kind = 'greater' and a <> b").select("doc_id", "attribute", F.col("a").alias("u"), F.col("b").alias("v")).distinct())
    k = ["doc_id", "attribute"]
    walk = g.where("v > u").select(*k, F.col("u").alias("s"), "v", F.array("u").alias("p"))
    found = None
    for _ in range(longest - 1):
        step = walk.withColumnRenamed("v", "u").join(g, [*k, "u"]).where("u <> s and v >= s and not array_contains(p, u)")
        walk = step.select(*k, "s", "v", F.concat("p", F.array("u")).alias("p"))
        closed = walk.where("v = s").select(*k, F.size("p").cast("long").alias("length"), "p")
        found = closed if found is None else found.unionByName(closed)
    return found.distinct().groupBy(*k, "length").agg(F.count("*").alias("cycles"))


_CYCLES = f"""with recursive g as (select distinct doc_id, attribute, a u, b v from ({ENTITY_RELATIONS}) q where kind = 'greater' and a <> b),
w as (select doc_id, attribute, u s, v, [u] p from g where v > u union all select w.doc_id, w.attribute, w.s, g.v, list_append(w.p, g.u) from w join g on g.doc_id = w.doc_id and g.attribute = w.attribute and g.u = w.v
 where len(w.p) < 6 and g.u <> w.s and g.v >= w.s and not list_contains(w.p, g.u)) select doc_id, attribute, len(p) as length, count(distinct p) as cycles from w where v = s group by 1, 2, 3"""


@q("gr25_short_cycles", _CYCLES)
@q("gr25_all_cycles", _CYCLES)
def gr25_short_cycles(spark, d):
    """Simple order cycles of up to six relations, each once: it starts at its smallest entity."""
    return order_cycles(entity_relations(spark, d), 6)



@q("jn3_shared_openings", f"""with {_LAST}, n as (select record_id, x.b b, string_split(trim(lower(regexp_replace(x.t, '\\s+', ' ', 'g'))), '. ') s from r where x.t <> '' and x.b is not null),
c as (select b, s, count(*) n from (select distinct record_id, b, unnest(s) s from n) z group by 1, 2) select n.record_id, c.n - 1 as others from n join c on c.b = n.b and c.s = n.s[1]""")
def jn3_shared_openings(spark, d):
    """For every record the number of others of its base that hold its opening sentence, apart from case and blanks.

    Sentences are counted per base first, so the records of a base are not paired with each other."""
    r = last_records(spark, d).where("length(t) > 0 and b is not null")
    n = r.select("record_id", "b", F.split(F.trim(F.lower(F.regexp_replace("t", r"\s+", " "))), r"\. ").alias("s"))
    c = n.select("b", F.explode(F.array_distinct("s")).alias("s")).groupBy("b", "s").agg(F.count("*").alias("n"))
    return n.select("record_id", "b", F.get("s", 0).alias("s")).join(c, ["b", "s"]).select("record_id", (F.col("n") - 1).alias("others"))


@q("jn3_held_sentences", f"""with {_LAST}, n as (select record_id, x.b b, trim(lower(regexp_replace(x.t, '[\\s\\pZ]+', ' ', 'g'))) t from r where x.t <> '' and x.b is not null),
o as (select record_id, b, split_part(t, '. ', 1) s from n) select o.record_id, count(n.record_id) as holders from o left join n on n.b = o.b and n.record_id <> o.record_id and contains(n.t, o.s) group by 1""")
def jn3_held_sentences(spark, d):
    """For every record the number of others of its base whose text holds its opening as it stands, anywhere.

    A base's different openings meet its texts once each, and a text is read once for all of them; copies of an opening
    are counted, not compared."""
    r = last_records(spark, d).where("length(t) > 0 and b is not null")
    n = stage(r.select("record_id", "b", F.trim(F.lower(F.regexp_replace("t", r"[\s\p{Z}]+", " "))).alias("t")))
    o = n.select("record_id", "b", F.split_part("t", F.lit(". "), F.lit(1)).alias("s"))
    kinds = o.select("b", "s").distinct()
    holders = n.join(kinds, "b").where(F.contains("t", "s")).groupBy("b", "s").agg(F.count("*").alias("n"))
    # a text holds its own opening, which does not count
    return o.join(holders, ["b", "s"]).select("record_id", (F.col("n") - 1).alias("holders"))


@q("jn17_orphans", f"with {_LAST} select record_id, x.f as derived_from from r where x.f is not null and x.f not in (select x.d from r where x.d is not null)")
def jn17_orphans(spark, d):
    """Records made from one that is not there."""
    r = last_records(spark, d)
    return r.where("f is not null").join(r.select(F.col("d").alias("f")), "f", "left_anti").select("record_id", F.col("f").alias("derived_from"))


@q("jn25_panel", """with v as (select distinct trim(regexp_replace(lower(reviewer), '[\\s_-]+', ' ', 'g')) reviewer from canary_scores where reviewer is not null), p as (select reviewer, split_part(reviewer, ' ', 2) provider from v)
select a.provider as author, p.reviewer, row_number() over (partition by a.provider order by p.reviewer) as place from (select distinct provider from p) a join p on p.provider <> a.provider
qualify row_number() over (partition by a.provider order by p.reviewer) <= 3""")
def jn25_panel(spark, d):
    """For each provider the first three reviewers of another one. The few providers are joined with the first three
    reviewers of each, which is all that can be chosen."""
    key = F.trim(F.regexp_replace(F.lower("reviewer"), r"[\s_-]+", " "))
    v = table(spark, d, "canary_scores").where("reviewer is not null").select(key.alias("reviewer")).distinct()
    p = v.withColumn("provider", F.split_part("reviewer", F.lit(" "), F.lit(2)))
    top = p.withColumn("k", F.row_number().over(Window.partitionBy("provider").orderBy("reviewer"))).where("k <= 3")
    authors = F.broadcast(p.select(F.col("provider").alias("author")).distinct())
    w = Window.partitionBy("author").orderBy("reviewer")
    return top.join(authors, F.col("provider") != F.col("author")).withColumn("place", F.row_number().over(w).cast("long")).where("place <= 3").select("author", "reviewer", "place")


@q("ag10_score_by_group", """with s as (select c_mktsegment g, c_acctbal x, c_nationkey % 2 = 0 t from customer), p as (select g, t, rank() over (partition by g order by x) + (count(*) over (partition by g, x) - 1) / 2.0 rk from s)
select g as segment, (sum(rk) filter (t) - count(*) filter (t) * (count(*) filter (t) + 1) / 2.0) / nullif(count(*) filter (t) * count(*) filter (not t), 0) as auc from p group by 1""", floats="auc")
def ag10_score_by_group(spark, d):
    from plumbline.operators.evaluation import auc

    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("x"), (F.col("c_nationkey") % 2 == 0).alias("t"))
    return auc(c, "x", "t", ["segment"])


@q("ag34_plateaus", """with v as (select event_type, user_id, round(avg(value), 1) v from events group by 1, 2), c as (select event_type, v, count(*) n from v group by 1, 2)
select event_type, count(*) filter (n > 1) as plateaus, coalesce(max(n), 0) as widest, sum(n) filter (n > 1) * 1.0 / sum(n) as share from c group by 1""", floats="share")
def ag34_plateaus(spark, d):
    """Values that several users share, and the share of users on them."""
    v = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.round(F.avg("value"), 1).alias("v"))
    c = v.groupBy("event_type", "v").agg(F.count("*").alias("n"))
    return c.groupBy("event_type").agg(F.count_if(F.col("n") > 1).alias("plateaus"), F.max("n").alias("widest"),
                                       ratio(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.sum("n"), None).alias("share"))


@q("wn7_cluster_check", f"""with {_FIRST}, g as (select doc_id, a, a - lag(a) over (partition by doc_id order by a) gap from (select distinct doc_id, a from e where sign < 0))
select doc_id, count(*) as cues, coalesce(min(gap), 0) as least_gap, max(a) - min(a) as reach, coalesce(min(gap) >= 2, true) and max(a) - min(a) >= 5 as spread from g group by 1""")
def wn7_cluster_check(spark, d):
    e = S.signed_edges(relations(spark, d)).where("sign < 0").select("doc_id", "a").distinct()
    g = e.withColumn("gap", F.col("a") - F.lag("a").over(Window.partitionBy("doc_id").orderBy("a")))
    reach = F.max("a") - F.min("a")
    return g.groupBy("doc_id").agg(F.count("*").alias("cues"), F.coalesce(F.min("gap"), F.lit(0)).alias("least_gap"), reach.alias("reach"),
                                   (F.coalesce(F.min("gap") >= 2, F.lit(True)) & (reach >= 5)).alias("spread"))


@q("al7_two_pools", """with e as (select event_type, event_id, value > 40 as hit from events), s as (select event_type, min(event_id) f from e where hit group by 1),
t as (select event_type, event_id, row_number() over (partition by event_type order by event_id) turn from e where hit), o as (select event_type, event_id, row_number() over (order by turn, f, t.event_type) place from t join s using (event_type) where turn <= 5)
select 'defect' as pool, event_id from o where place <= 5 union all (select 'clean', event_id from e where not hit order by md5('6|' || event_id) limit 2)""")
def al7_two_pools(spark, d):
    """Five from one pool, its kinds in turn, and two of the other by a seeded hash."""
    e = table(spark, d, "events")
    hit = A.round_robin(e.where("value > 40").select("event_type", "event_id"), "event_type", "event_id", "event_id", 5)
    clean = e.where("value <= 40").select("event_id", A.keyed_hash(6, "event_id").alias("h")).orderBy("h").limit(2)
    return hit.select(F.lit("defect").alias("pool"), "event_id").unionByName(clean.select(F.lit("clean").alias("pool"), "event_id"))


@q("al10_feasible_settings", """with l as (select distinct level v from units where level between 1 and 5), a as (select distinct attempts v from units where attempts is not null)
select l.v as level, a.v as attempts from l cross join a where l.v + a.v <= 6""")
def al10_feasible_settings(spark, d):
    """Settings of two small knobs that fit together."""
    u = table(spark, d, "units")
    lev = u.where("level between 1 and 5").select("level").distinct()
    return lev.crossJoin(F.broadcast(u.where("attempts is not null").select("attempts").distinct())).where("level + attempts <= 6")


@q("st2_all_statements", f"select doc_id, claim_id, kind, count(*) as n from (select doc_id, claim_id, kind from ({ENTITY_RELATIONS}) x union all select doc_id, claim_id, kind from ({CLAIMS}) y) z group by 1, 2, 3")
def st2_all_statements(spark, d):
    a = entity_relations(spark, d).select("doc_id", "claim_id", "kind")
    return a.unionByName(claims(spark, d).select("doc_id", "claim_id", "kind")).groupBy("doc_id", "claim_id", "kind").agg(F.count("*").alias("n"))


@q("st7_set_overlap", """with a as (select distinct l_suppkey s, l_partkey p from lineitem where l_returnflag = 'A'), b as (select distinct l_suppkey s, l_partkey p from lineitem where l_returnflag = 'R'),
j as (select coalesce(a.s, b.s) s, a.p x, b.p y from a full join b on a.s = b.s and a.p = b.p)
select s as l_suppkey, count(*) filter (x = y) * 1.0 / count(*) as jaccard, count(*) filter (x = y) * 1.0 / nullif(count(x), 0) as containment from j group by 1""", floats="jaccard containment")
def st7_set_overlap(spark, d):
    l = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(
        F.bool_or(F.col("l_returnflag") == "A").alias("a"), F.bool_or(F.col("l_returnflag") == "R").alias("b")).where("a or b")
    both = F.count_if(F.col("a") & F.col("b"))
    return l.groupBy("l_suppkey").agg((both / F.count("*")).alias("jaccard"), ratio(both, F.count_if(F.col("a")), None).alias("containment"))


@q("sf11_request_keys", """select distinct reply_id, sha256(concat_ws('|', 'model=' || coalesce(model, ''), 'request=' || coalesce(request, ''), 'schema=' || coalesce(schema_name, ''))) as key from llm""")
def sf11_request_keys(spark, d):
    """Digest of a request's fields in a fixed order, nulls as empty."""
    part = lambda n, c: F.concat(F.lit(f"{n}="), F.coalesce(c, F.lit("")))
    key = F.sha2(F.concat_ws("|", part("model", "model"), part("request", "request"), part("schema", "schema_name")), 256)
    return table(spark, d, "llm").select("reply_id", key.alias("key")).distinct()


@q("sf14_splice", f"""with {_LAST}, s as (select record_id, x.t t, split_part(x.t, '. ', 1) o from r where x.t <> ''), c as (select record_id, t, o, (length(t) - length(replace(t, o, ''))) // length(o) n from s where o <> '')
select record_id, n as found, case when n = 1 then sha256(replace(t, o, '<cut>')) end as digest from c""")
def sf14_splice(spark, d):
    """The opening of a text replaced if it stands in it exactly once."""
    r = last_records(spark, d).where("length(t) > 0").select("record_id", "t", F.split_part("t", F.lit(". "), F.lit(1)).alias("o")).where("length(o) > 0")
    n = X.occurrences(F.col("t"), F.col("o")).cast("long")
    return r.select("record_id", n.alias("found"), F.when(n == 1, F.sha2(F.replace("t", F.col("o"), F.lit("<cut>")), 256)).alias("digest"))


@q("sf16_unit_match", "select l_orderkey, l_linenumber, abs(l_quantity * 0.621371192 - round(l_quantity * 0.62, 2)) <= 0.05 as near from lineitem")
def sf16_unit_match(spark, d):
    """Kilometres and miles that agree within the tolerance."""
    near = F.abs(F.col("l_quantity") * 0.621371192 - F.round(F.col("l_quantity") * 0.62, 2)) <= 0.05
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", near.alias("near"))


@q("sf20_roughness", """with v as (select user_id, event_type, avg(value) f from events group by 1, 2), p as (select a.user_id, abs(a.f - b.f) / least(a.f, b.f) x from v a join v b on a.user_id = b.user_id and a.event_type < b.event_type where least(a.f, b.f) > 0)
select user_id, sum(exp(-3.5 * x) - exp(-5.75 * x)) as roughness from p group by 1""", floats="roughness")
def sf20_roughness(spark, d):
    """Pairwise roughness of a user's mean values by type; the types are few."""
    v = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("f"))
    w = v.select("user_id", F.col("event_type").alias("t2"), F.col("f").alias("g"))
    x = F.abs(F.col("f") - F.col("g")) / F.least("f", "g")
    p = v.join(w, "user_id").where("event_type < t2 and least(f, g) > 0").withColumn("x", x)
    return p.groupBy("user_id").agg(F.sum(F.exp(-3.5 * F.col("x")) - F.exp(-5.75 * F.col("x"))).alias("roughness"))


@q("sf25_digits", "select o_orderkey, [o_orderkey % 3, (o_orderkey // 3) % 3, (o_orderkey // 9) % 3, (o_orderkey // 27) % 3] as digits, (o_orderkey % 3 = 0 and (o_orderkey // 3) % 3 = 0) as corner from orders")
def sf25_digits(spark, d):
    """The last four base-3 digits, which label a vertex of the triangle graphs."""
    k = F.col("o_orderkey")
    digit = lambda i: F.floor(k / 3**i) % 3
    return table(spark, d, "orders").select("o_orderkey", F.array(*[digit(i) for i in range(4)]).alias("digits"), ((digit(0) == 0) & (digit(1) == 0)).alias("corner"))


@q("sf29_report_json", "select o_custkey, '{\"orders\":' || count(*) || ',\"first\":' || min(o_orderkey) || '}' as report from orders group by 1")
def sf29_report_json(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.to_json(F.struct(F.count("*").alias("orders"), F.min("o_orderkey").alias("first"))).alias("report"))


@q("pv2_same_outside", f"""with {_LAST}, p as (select record_id, x.f f, x.t t from r where x.f is not null), o as (select x.d d, x.t t from r)
select p.record_id, length(p.t) = length(o.t) as same_length, p.t = o.t as same_text, split_part(p.t, '. ', 1) = split_part(o.t, '. ', 1) as same_opening from p join o on p.f = o.d""")
def pv2_same_outside(spark, d):
    """How a derived record's text relates to that of its source."""
    r = last_records(spark, d)
    p = r.where("f is not null").select("record_id", F.col("f").alias("d"), F.col("t").alias("t1"))
    opening = lambda c: F.split_part(c, F.lit(". "), F.lit(1))
    return p.join(r.select("d", "t"), "d").select(
        "record_id", (F.length("t1") == F.length("t")).alias("same_length"), (F.col("t1") == F.col("t")).alias("same_text"), (opening("t1") == opening("t")).alias("same_opening"))


@q("rv4_decision_log", """with x as (select distinct seq, doc_id, lower(trim(decision)) dec, kind from decisions where kind = 'decision' and doc_id is not null), l as (select doc_id, seq, dec, lag(dec) over (partition by doc_id order by seq) p from x)
select doc_id, count(*) as entries, count(*) filter (p is not null and p is distinct from dec) as changes from l group by 1""")
def rv4_decision_log(spark, d):
    """Entries per document and how often the decision changed from one to the next."""
    x = table(spark, d, "decisions").where("kind = 'decision' and doc_id is not null").select("seq", "doc_id", F.lower(F.trim("decision")).alias("dec")).distinct()
    p = F.lag("dec").over(Window.partitionBy("doc_id").orderBy("seq"))
    changed = F.col("p").isNotNull() & ~F.col("p").eqNullSafe(F.col("dec"))
    return x.withColumn("p", p).groupBy("doc_id").agg(F.count("*").alias("entries"), F.count_if(changed).alias("changes"))


@q("rm2_inventory", f"""with r as (select * from ({ENTITY_RELATIONS}) q) select doc_id, a as entity, count(*) as mentions, min(rel_id) as first, arg_min(attribute, rel_id) as attribute from r group by 1, 2""")
def rm2_inventory(spark, d):
    """Entities with their mentions; the attribute named first is theirs."""
    return entity_relations(spark, d).groupBy("doc_id", F.col("a").alias("entity")).agg(
        F.count("*").alias("mentions"), F.min("rel_id").alias("first"), F.min_by("attribute", "rel_id").alias("attribute"))


@q("rm4_listed_contradictions", """with x as (select distinct reply_id, model, output from llm where schema_name = 'ContradictionList' and output is not null)
select reply_id, cast(json_array_length(output, '$.contradictions') as int) as listed, json_array_length(output, '$.contradictions') > 0 as inconsistent from x""")
def rm4_listed_contradictions(spark, d):
    x = table(spark, d, "llm").where("schema_name = 'ContradictionList' and output is not null").select("reply_id", "model", "output").distinct()
    n = F.json_array_length(F.get_json_object("output", "$.contradictions"))
    return x.select("reply_id", n.alias("listed"), (n > 0).alias("inconsistent"))


@q("rm29_canary_per_split", "select split, count(distinct canary) as canaries, count(distinct canary) = 1 as unique_canary from export_records group by 1")
def rm29_canary_per_split(spark, d):
    n = F.count_distinct("canary")
    return table(spark, d, "export_records").groupBy("split").agg(n.alias("canaries"), (n == 1).alias("unique_canary"))


@q("rm31_stop_classes", """select case when lower(trim(stop_reason)) in ('end_turn', 'stop') then 'finished' when lower(trim(stop_reason)) in ('max_tokens', 'length') then 'cut' when lower(trim(stop_reason)) = 'refusal' then 'declined'
 when stop_reason is null then 'unknown' else 'other' end as class, count(distinct reply_id) as n from llm group by 1""")
def rm31_stop_classes(spark, d):
    s = F.lower(F.trim("stop_reason"))
    c = F.when(s.isin("end_turn", "stop"), "finished").when(s.isin("max_tokens", "length"), "cut").when(s == "refusal", "declined").when(s.isNull(), "unknown").otherwise("other")
    return table(spark, d, "llm").groupBy(c.alias("class")).agg(F.count_distinct("reply_id").alias("n"))


queries, oracle_sql = family.queries, family.oracle_sql
