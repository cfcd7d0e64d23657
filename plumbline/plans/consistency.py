"""Queries of the signed claim graph and the entity graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import entity_graph as E
from plumbline.operators import harmony as H
from plumbline.operators import signed_graph as S
from plumbline.plans.bindings import CLAIMS, ENTITY_RELATIONS, RELATIONS, claims, entity_relations, pairs, relations
from plumbline.plans.registry import Family
from plumbline.session import stage

family = Family()

_FIRST = f"""
rel as (select doc_id, seq, least(a, b) a, greatest(a, b) b, lower(trim(relation)) relation, confidence
        from ({RELATIONS}) x where a <> b),
firsts as (select *, row_number() over (partition by doc_id, a, b order by seq) rn,
           count(*) over (partition by doc_id, a, b) c from rel),
f as (select * from firsts where rn = 1),
e as (select doc_id, a, b, case relation when 'supports' then 1 else -1 end sign,
        least(greatest(confidence, 0), 1) weight from f
      where relation in ('supports', 'contradicts') and confidence > 0)
"""
_STRONG = "s as (select doc_id, a, b, sign from e where weight >= 0.5)"
_COVER = """
cover as (select doc_id, a u, p pu, b v, case when sign < 0 then 1 - p else p end pv from s cross join (values (0), (1)) t(p)
          union all select doc_id, b, case when sign < 0 then 1 - p else p end, a, p from s cross join (values (0), (1)) t(p))
"""
_UNBALANCED = """
walk as (select distinct doc_id, u s, u v, 0 p from cover
         union select w.doc_id, w.s, c.v, c.pv from walk w join cover c on c.doc_id = w.doc_id and c.u = w.v and c.pu = w.p)
"""


@family.query("ag19_first_wins", f"with {_FIRST} select doc_id, a, b, seq, relation, c - 1 as repeats from f")
def ag19_first_wins(spark, d):
    return S.first_wins(relations(spark, d)).select("doc_id", "a", "b", "seq", "relation", "repeats")


@family.query("gr1_signed_edges", f"with {_FIRST} select doc_id, a, b, sign, round(weight, 6) as weight from e")
def gr1_signed_edges(spark, d):
    return S.signed_edges(relations(spark, d)).withColumn("weight", F.round("weight", 6))


@family.query(
    "gr1_counters",
    f"""with {_FIRST} select doc_id, count(*) pairs,
    count(*) filter (where relation in ('supports', 'contradicts') and confidence > 0) edges,
    cast(sum(c - 1) as bigint) repeats, count(*) filter (where relation = 'tension') tension,
    count(*) filter (where relation in ('supports', 'contradicts') and confidence <= 0) zero_weight from f group by 1""",
)
def gr1_counters(spark, d):
    return S.graph_counters(relations(spark, d))


@family.query(
    "gr2_signed_laplacian",
    f"""with {_FIRST}, x as (select doc_id, a r, b c, -sign * weight v from e union all select doc_id, b, a, -sign * weight from e
    union all select doc_id, a, a, weight from e union all select doc_id, b, b, weight from e)
    select doc_id, r as "row", c as "col", round(sum(v), 6) as "value" from x group by 1, 2, 3""",
)
def gr2_signed_laplacian(spark, d):
    return S.signed_laplacian(S.signed_edges(relations(spark, d))).withColumn("value", F.round("value", 6))


@family.query(
    "gr3_components",
    f"""with recursive {_FIRST}, {_STRONG}, two as (select doc_id, a u, b v from s union select doc_id, b, a from s),
    walk as (select doc_id, claim_id s, claim_id v from ({CLAIMS}) q
             union select w.doc_id, w.s, t.v from walk w join two t on t.doc_id = w.doc_id and t.u = w.v)
    select doc_id, s as claim_id, min(v) as component from walk group by 1, 2""",
)
def gr3_components(spark, d):
    e = S.signed_edges(relations(spark, d)).where("weight >= 0.5")
    return S.components(e, claims(spark, d))


@family.query(
    "gr4_unbalanced_claims",
    f"""with recursive {_FIRST}, {_STRONG}, {_COVER}, {_UNBALANCED}
    select distinct doc_id, s as claim_id from walk where s = v and p = 1""",
)
def gr4_unbalanced_claims(spark, d):
    return S.unbalanced_claims(S.signed_edges(relations(spark, d)).where("weight >= 0.5"))


@family.query(
    "gr5_frustrated_cycle_length",
    f"""with recursive {_FIRST}, {_STRONG}, {_COVER},
    walk as (select distinct doc_id, u s, u v, 0 p, 0 n from cover
             union select w.doc_id, w.s, c.v, c.pv, w.n + 1 from walk w
             join cover c on c.doc_id = w.doc_id and c.u = w.v and c.pu = w.p
             where w.n < 14 and c.v >= w.s)
    select doc_id, min(n) as length from walk where s = v and p = 1 group by 1""",
)
def gr5_frustrated_cycle_length(spark, d):
    return S.frustrated_cycle_lengths(stage(S.signed_edges(relations(spark, d)).where("weight >= 0.5")))


@family.query(
    "flt2_pairwise_only", f"with {_FIRST} select distinct doc_id from e where sign < 0 and weight >= 0.5"
)
def flt2_pairwise_only(spark, d):
    return S.pairwise_documents(S.signed_edges(relations(spark, d)))


@family.query(
    "flt3_direct_pairs",
    f"""with {_FIRST}, k as (select * from ({CLAIMS}) q where kind in ('asserted', 'premise'))
    select e.doc_id, a, b from e join k x on x.doc_id = e.doc_id and x.claim_id = a
    join k y on y.doc_id = e.doc_id and y.claim_id = b where sign < 0 and weight >= 0.5""",
)
def flt3_direct_pairs(spark, d):
    return S.direct_pairs(S.signed_edges(relations(spark, d)), claims(spark, d))


@family.query(
    "jn1_claim_pairs",
    f"""with c as (select * from ({CLAIMS}) q), n as (select doc_id from c group by 1 having count(*) <= 25)
    select x.doc_id, x.claim_id as a, y.claim_id as b from c x join c y on x.doc_id = y.doc_id and x.claim_id < y.claim_id
    where x.doc_id in (select doc_id from n)""",
)
def jn1_claim_pairs(spark, d):
    """All pairs of the claims of documents with at most 25 claims, which bounds the pairs of one."""
    c = claims(spark, d).select("doc_id", "claim_id")
    small = c.groupBy("doc_id").agg(F.count("*").alias("n")).where("n <= 25").select("doc_id")
    c = c.join(small, "doc_id", "left_semi")
    x, y = c.withColumnRenamed("claim_id", "a"), c.withColumnRenamed("claim_id", "b")
    return x.join(y, "doc_id").where("a < b")


@family.query(
    "jn6_unrelated_requests",
    f"""with {_FIRST}, c as (select * from ({CLAIMS}) q)
    select x.doc_id, x.claim_id as a, y.claim_id as b from c x join c y on x.doc_id = y.doc_id and y.claim_id = x.claim_id + 2
    where not exists (select 1 from f where f.doc_id = x.doc_id and f.a = x.claim_id and f.b = y.claim_id)
    union all select doc_id, a, b from f where relation = 'unrelated'""",
)
def jn6_unrelated_requests(spark, d):
    """Requested pairs without a relation (here: of claims two apart), and those whose relation makes no edge."""
    f = S.first_wins(relations(spark, d))
    c = claims(spark, d)
    asked = c.select("doc_id", F.col("claim_id").alias("a"), (F.col("claim_id") + 2).alias("b")).join(
        c.select("doc_id", F.col("claim_id").alias("b")), ["doc_id", "b"], "left_semi")
    missing = asked.join(f, ["doc_id", "a", "b"], "left_anti").select("doc_id", "a", "b")
    return missing.unionByName(f.where("relation = 'unrelated'").select("doc_id", "a", "b"))


@family.query(
    "gr14_equality_classes",
    f"""with recursive r as (select * from ({ENTITY_RELATIONS}) q where kind = 'same' and a <> b),
    two as (select doc_id, attribute, a u, b v from r union select doc_id, attribute, b, a from r),
    walk as (select distinct doc_id, attribute, u s, u v from two
             union select w.doc_id, w.attribute, w.s, t.v from walk w
             join two t on t.doc_id = w.doc_id and t.attribute = w.attribute and t.u = w.v)
    select doc_id, attribute, s as entity, min(v) as class from walk group by 1, 2, 3""",
)
def gr14_equality_classes(spark, d):
    return E.equality_classes(entity_relations(spark, d))


_CLASSED = f"""
r as (select * from ({ENTITY_RELATIONS}) q),
two as (select doc_id, attribute, a u, b v from r where kind = 'same' and a <> b
        union select doc_id, attribute, b, a from r where kind = 'same' and a <> b),
eq as (select distinct doc_id, attribute, u s, u v from two
       union select w.doc_id, w.attribute, w.s, t.v from eq w
       join two t on t.doc_id = w.doc_id and t.attribute = w.attribute and t.u = w.v),
cls as (select doc_id, attribute, s entity, min(v) class from eq group by 1, 2, 3),
c as (select r.*, coalesce(x.class, r.a) ca, coalesce(y.class, r.b) cb from r
      left join cls x on x.doc_id = r.doc_id and x.attribute = r.attribute and x.entity = r.a
      left join cls y on y.doc_id = r.doc_id and y.attribute = r.attribute and y.entity = r.b)
"""
_PARITY = """
d1 as (select doc_id, attribute, ca u, cb v from c where kind = 'different' and ca <> cb and attribute = 'O'
       union select doc_id, attribute, cb, ca from c where kind = 'different' and ca <> cb and attribute = 'O'),
odd as (select distinct doc_id, attribute, u s, u v, 0 p from d1
        union select w.doc_id, w.attribute, w.s, t.v, 1 - w.p from odd w
        join d1 t on t.doc_id = w.doc_id and t.attribute = w.attribute and t.u = w.v)
"""
_ORDER = """
gr as (select distinct doc_id, attribute, ca u, cb v from c where kind = 'greater'),
reach as (select doc_id, attribute, u s, v from gr
          union select w.doc_id, w.attribute, w.s, t.v from reach w
          join gr t on t.doc_id = w.doc_id and t.attribute = w.attribute and t.u = w.v)
"""


def _classed(spark, d):
    r = stage(entity_relations(spark, d))
    return r, stage(E.by_class(r, E.equality_classes(r)))


def _arity_of(r):
    """The attribute O is binary, the others are not."""
    a = F.when(F.col("attribute") == "O", "binary").otherwise("multi").alias("arity")
    return r.select("doc_id", "attribute", a).distinct()


def _arity(spark, d):
    return _arity_of(entity_relations(spark, d))


@family.query(
    "gr15_different_within_class",
    f"with recursive {_CLASSED} select doc_id, attribute, rel_id, claim_id from c where kind = 'different' and ca = cb",
)
def gr15_different_within_class(spark, d):
    return E.different_within_class(_classed(spark, d)[1])


@family.query(
    "gr16_binary_parity",
    f"with recursive {_CLASSED}, {_PARITY} select distinct doc_id, attribute from odd where s = v and p = 1",
)
def gr16_binary_parity(spark, d):
    return E.parity_violations(_classed(spark, d)[1], _arity(spark, d))


@family.query(
    "gr17_order_cycles", f"with recursive {_CLASSED}, {_ORDER} select distinct doc_id, attribute from reach where s = v"
)
def gr17_order_cycles(spark, d):
    return E.order_cycles(_classed(spark, d)[1])


@family.query(
    "gr17_order_cycle_lengths",
    f"""with recursive r as (select * from ({ENTITY_RELATIONS}) q),
    m as (select distinct doc_id, attribute, a u, b v from r where kind = 'greater'
          union select doc_id, attribute, a, b from r where kind = 'same' and a <> b
          union select doc_id, attribute, b, a from r where kind = 'same' and a <> b),
    g as (select distinct doc_id, attribute, a, b from r where kind = 'greater'),
    walk as (select distinct doc_id, attribute, b s, b v, 0 n from g
             union select w.doc_id, w.attribute, w.s, m.v, w.n + 1 from walk w
             join m on m.doc_id = w.doc_id and m.attribute = w.attribute and m.u = w.v where w.n < 14)
    select g.doc_id, g.attribute, min(w.n) + 1 as length from g
    join walk w on w.doc_id = g.doc_id and w.attribute = g.attribute and w.s = g.b and w.v = g.a group by 1, 2""",
)
def gr17_order_cycle_lengths(spark, d):
    return E.order_cycle_lengths(stage(entity_relations(spark, d)))


@family.query(
    "gr19_contradictions",
    f"""with recursive {_CLASSED}, {_PARITY}, {_ORDER}
    select distinct doc_id, attribute, 'different_within_class' as type from c where kind = 'different' and ca = cb
    union all select distinct doc_id, attribute, 'binary_parity' from odd where s = v and p = 1
    union all select distinct doc_id, attribute, 'order_cycle' from reach where s = v""",
)
def gr19_contradictions(spark, d):
    r = entity_relations(spark, d)
    return E.contradictions(r, _arity_of(r))


@family.query(
    "gr12_verdict",
    f"""with recursive {_FIRST}, {_STRONG}, {_COVER}, {_UNBALANCED},
    k as (select * from ({CLAIMS}) q where kind in ('asserted', 'premise')),
    direct as (select distinct e.doc_id from e join k x on x.doc_id = e.doc_id and x.claim_id = a
      join k y on y.doc_id = e.doc_id and y.claim_id = b where sign < 0 and weight >= 0.5),
    bad as (select distinct doc_id from walk where s = v and p = 1),
    {_CLASSED.replace(f"({ENTITY_RELATIONS}) q", f"({ENTITY_RELATIONS}) q join k using (doc_id, claim_id) where confidence >= 0.5")
      .replace("select * from (", "select q.doc_id, rel_id, claim_id, attribute, q.kind, a, b, confidence from (")}, {_PARITY}, {_ORDER},
    ent as (select doc_id from c where kind = 'different' and ca = cb union select doc_id from odd where s = v and p = 1
            union select doc_id from reach where s = v),
    docs as (select distinct doc_id from ({CLAIMS}) q)
    select doc_id, doc_id in (select doc_id from direct) as direct, doc_id in (select doc_id from bad) as claim_balance,
      doc_id in (select doc_id from ent) as entity,
      doc_id in (select doc_id from direct union select doc_id from bad union select doc_id from ent) as inconsistent
    from docs""",
)
def gr12_verdict(spark, d):
    """Every document with the clauses that fired: direct contradiction, unbalanced claims, entity contradiction."""
    c = stage(claims(spark, d))
    p = pairs(spark, d, c)
    e = stage(S.signed_edges(relations(spark, d, p)))
    r = E.eligible(entity_relations(spark, d, p), c, S.THRESHOLD, S.ASSERTING)
    parts = {
        "direct": S.direct_pairs(e, c), "claim_balance": S.unbalanced_claims(e.where("weight >= 0.5")),
        "entity": E.contradictions(r, _arity_of(r)),
    }
    out = c.select("doc_id").distinct()
    for name, hits in parts.items():
        out = out.join(hits.select("doc_id").distinct().withColumn(name, F.lit(True)), "doc_id", "left")
    out = out.fillna(False, list(parts))
    return out.withColumn("inconsistent", F.col("direct") | F.col("claim_balance") | F.col("entity"))


@family.query("gr6_harmony")
def gr6_harmony(spark, d):
    """Per document: harmony, conflict and the number of anchored components."""
    return H.harmony(S.signed_edges(relations(spark, d)), claims(spark, d))


#: The energy's minimum by Jacobi rounds, from +1; what nobody asserts or fixes is left out, as are its components.
_MINIMUM = f"""{_FIRST}, k as (select doc_id, claim_id, kind, {{fixed}} fixed from ({CLAIMS}) q), two as (select doc_id, a u, b v, sign * weight sw, weight w from e union all select doc_id, b, a, sign * weight, weight from e),
reach as (select doc_id, claim_id from k where (fixed or kind = 'asserted') union select r.doc_id, t.v from reach r join two t on t.doc_id = r.doc_id and t.u = r.claim_id),
n as (select k.doc_id, k.claim_id, fixed, case when kind = 'asserted' then 1.0 else 0.0 end pull, coalesce((select sum(w) from two where two.doc_id = k.doc_id and u = k.claim_id), 0) deg from k join reach using (doc_id, claim_id)),
x as (select 0 i, doc_id, claim_id, cast(1.0 as double) x from n
  union all select s.i + 1, s.doc_id, s.claim_id, s.x from (select x.i, n.doc_id, n.claim_id, case when any_value(n.fixed) then 1.0 when any_value(n.pull + n.deg) = 0 then any_value(x.x)
      else (any_value(n.pull) + coalesce(sum(t.sw * y.x), 0)) / any_value(n.pull + n.deg) end x
    from x join n on n.doc_id = x.doc_id and n.claim_id = x.claim_id left join two t on t.doc_id = n.doc_id and t.u = n.claim_id left join x y on y.doc_id = t.doc_id and y.claim_id = t.v and y.i = x.i
    where x.i < 200 group by 1, 2, 3) s),
z as (select doc_id, claim_id, x from x where i = 200),
er as (select e.doc_id, e.a, e.b, e.weight, e.weight * power(p.x - e.sign * q.x, 2) er from e join z p on p.doc_id = e.doc_id and p.claim_id = e.a join z q on q.doc_id = e.doc_id and q.claim_id = e.b),
own as (select n.doc_id, sum(pull * power(z.x - 1, 2)) own, count(*) filter (pull > 0 and deg > 0) rel from n join z using (doc_id, claim_id) group by 1),
h as (select doc_id, case when ew.w > 0 then 1 - (ew.er + own.own) / (4 * ew.w + 4 * rel) end as harmony from own left join (select doc_id, sum(er) er, sum(weight) w from er group by 1) ew using (doc_id))"""


def _solution(fixed, what):
    return f"with recursive {_MINIMUM.format(fixed=fixed)} {what}"


_HARMONY = f"select distinct q.doc_id, h.harmony from ({CLAIMS}) q left join h on h.doc_id = q.doc_id"


@family.query("gr8_harmony", _solution("kind = 'premise'", _HARMONY), floats="harmony")
def gr8_harmony(spark, d):
    """Harmony of every document."""
    return H.harmony(S.signed_edges(relations(spark, d)), claims(spark, d)).select("doc_id", "harmony")


@family.query("gr9_claim_residuals")
def gr9_claim_residuals(spark, d):
    return H.assignments(S.signed_edges(relations(spark, d)), claims(spark, d))


@family.query("gr11_culprits")
def gr11_culprits(spark, d):
    """The three claims of each document that fit worst, and what becomes of it without each."""
    c = stage(claims(spark, d))
    return H.culprits(S.signed_edges(relations(spark, d, pairs(spark, d, c))), c)


@family.query("gr13_with_evidence", _solution("(kind = 'premise' or k % 5 = 0)", _HARMONY), floats="harmony")
def gr13_with_evidence(spark, d):
    """Harmony of every document once some of its claims are found to hold (here: those of every fifth order), from
    the relations that are there."""
    c = stage(claims(spark, d))
    e = S.signed_edges(relations(spark, d, pairs(spark, d, c)))
    return H.harmony(e, c, c.where("k % 5 = 0").select("doc_id", "claim_id")).select("doc_id", "harmony")


@family.query("wn2_top_residuals")
def wn2_top_residuals(spark, d):
    r = stage(H.assignments(S.signed_edges(relations(spark, d)), claims(spark, d)))
    return S.residual_ranking(r, F.lit(1e-12) * F.col("scale"))


queries, oracle_sql = family.queries, family.oracle_sql
