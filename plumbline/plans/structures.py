"""Queries of graph measures and fact constraints."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import facts as C
from plumbline.operators import metrics as M
from plumbline.operators.evaluation import purity
from plumbline.operators.searches import distances
from plumbline.plans.bindings import CLAIMS, ENTITY_RELATIONS, entity_relations
from plumbline.plans.consistency import _CLASSED, _COVER, _FIRST, _ORDER, _PARITY, _UNBALANCED, _arity_of
from plumbline.plans.registry import Family
from plumbline.session import stage, table

family = Family()
q = family.query

#: Parts and suppliers that share an order line: parts have even numbers, suppliers odd ones.
_EDGES = "e as (select distinct least(u, v) u, greatest(u, v) v from (select l_partkey * 2 as u, l_suppkey * 2 + 1 as v from lineitem) g where u is not null and v is not null)"


_FACTS = """f as (select l_suppkey as doc_id, l_orderkey * 10 + l_linenumber as fact_id, l_partkey as subject, l_linestatus as attribute, l_returnflag as value,
 l_quantity > 45 as negated from lineitem)"""


def _facts(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("doc_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fact_id"), F.col("l_partkey").alias("subject"),
        F.col("l_linestatus").alias("attribute"), F.col("l_returnflag").alias("value"), (F.col("l_quantity") > 45).alias("negated"))


def lines(spark, d):
    """The graph's edges as order lines give them, repeats included."""
    return table(spark, d, "lineitem").select((F.col("l_partkey") * 2).alias("u"), (F.col("l_suppkey") * 2 + 1).alias("v"))


def graph(spark, d):
    return M.canonical_edges(lines(spark, d))


def sources(spark, d):
    return table(spark, d, "supplier").select((F.col("s_suppkey") * 2 + 1).alias("source"))


@q("gm1_canonical_edges", f"with {_EDGES} select * from e")
@q("gm1_all_edges", f"with {_EDGES} select * from e")
def gm1_canonical_edges(spark, d):
    return graph(spark, d)


_DEGREES = f"with {_EDGES} select node, count(*) as degree from (select u as node from e union all select v from e) n group by 1"


@q("gm2_degrees", _DEGREES)
@q("gm2_all_degrees", _DEGREES)
def gm2_degrees(spark, d):
    return M.degrees(graph(spark, d))


@q("gm6_hop_distances")
@q("gm6_all_distances")
def gm6_hop_distances(spark, d):
    """Distances from every supplier over all order lines, however far."""
    return distances(lines(spark, d), sources(spark, d))


@q("gm9_ball_masses")
@q("gm9_all_masses")
def gm9_ball_masses(spark, d):
    return M.ball_masses(lines(spark, d), sources(spark, d))


@q("gm9_mass_dimension", floats="dimension")
@q("gm9_all_dimension", floats="dimension")
def gm9_mass_dimension(spark, d):
    return M.mass_dimension(M.ball_masses(lines(spark, d), sources(spark, d)))


@q("gm7_double_sweep")
@q("gm7_all_sweep")
def gm7_double_sweep(spark, d):
    """Farthest node from a first one, then the farthest from that, without a bound on the distance."""
    g = stage(graph(spark, d))
    return M.double_sweep(g, g.agg(F.min("u").alias("source")))


@q("gm13_class_share", "with c as (select label, count(*) n from embeddings group by 1) select label, n, n * 1.0 / sum(n) over () as share from c", floats="share")
def gm13_class_share(spark, d):
    c = table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    return c.join(F.broadcast(c.agg(F.sum("n").alias("t")))).select("label", "n", (F.col("n") / F.col("t")).alias("share"))


@q("gm13_spectra", floats="gap")
def gm13_spectra(spark, d):
    """Spectral gap, its multiplicity, connected parts and the Fiedler cut of every document's claim graph."""
    from plumbline.operators.signed_graph import signed_edges
    from plumbline.plans.bindings import relations

    return M.spectra(signed_edges(relations(spark, d)).select("doc_id", "a", "b", "weight"))


@q("gm13_parts", f"""with recursive {_FIRST}, two as (select doc_id, a u, b v from e union select doc_id, b, a from e), walk as (select distinct doc_id, u s, u v from two union select w.doc_id, w.s, t.v from walk w join two t on t.doc_id = w.doc_id and t.u = w.v),
c as (select doc_id, s, min(v) r from walk group by 1, 2) select doc_id, count(*) as nodes, count(distinct r) as parts from c group by 1""")
def gm13_parts(spark, d):
    """How often the Laplacian of a document's claims has the eigenvalue 0: its connected parts."""
    return gm13_spectra(spark, d).select("doc_id", "nodes", "parts")


@q("gr7_balanced_documents", f"""with recursive {_FIRST}, s as (select doc_id, a, b, sign from e), {_COVER}, {_UNBALANCED}, d as (select distinct doc_id from ({CLAIMS}) q)
select doc_id, doc_id not in (select doc_id from walk where s = v and p = 1) as balanced from d""")
def gr7_balanced_documents(spark, d):
    """Documents without conflict: the smallest eigenvalue of every component is exactly 0."""
    from plumbline.operators.harmony import harmony
    from plumbline.operators.signed_graph import signed_edges
    from plumbline.plans.bindings import claims, pairs, relations

    c = stage(claims(spark, d))
    h = harmony(signed_edges(relations(spark, d, pairs(spark, d, c))), c)
    return h.select("doc_id", (F.col("conflict") == 0).alias("balanced"))


@q("rm18_support", f"""with {_FACTS}, n as (select doc_id, fact_id, unnest([fact_id - 1, fact_id - 2]) as need from f where fact_id % 10 > 2), m as (select n.doc_id, n.fact_id, count(*) filter (g.fact_id is null) as missing from n left join f g on g.doc_id = n.doc_id and g.fact_id = n.need group by 1, 2)
select doc_id, count(*) as facts, count(*) filter (missing = 0) as supported, cast(sum(missing) as bigint) as missing from m group by 1""")
def rm18_support(spark, d):
    """Per document how many facts have all that they depend on, and how much is missing."""
    f = stage(_facts(spark, d).select("doc_id", "fact_id"))
    need = f.where("fact_id % 10 > 2").select("doc_id", "fact_id", F.explode(F.array(F.col("fact_id") - 1, F.col("fact_id") - 2)).alias("need"))
    there = f.select("doc_id", F.col("fact_id").alias("need"), F.lit(1).alias("there")).distinct()
    m = need.join(there, ["doc_id", "need"], "left").groupBy("doc_id", "fact_id").agg(F.count_if(F.col("there").isNull()).alias("missing"))
    return m.groupBy("doc_id").agg(F.count("*").alias("facts"), F.count_if(F.col("missing") == 0).alias("supported"), F.sum("missing").alias("missing"))


@q("gm14_kmeans_purity")
def gm14_kmeans_purity(spark, d):
    """Clusters of the embeddings and how far they follow the labels."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    e = table(spark, d, "embeddings").where("embedding is not null").select(
        "label", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    e = stage(e)
    k = e.select("label").distinct().count()
    model = KMeans(k=max(2, k), seed=5, initSteps=4, maxIter=30).fit(e)
    return purity(model.transform(e), "prediction", "label")


@q("mc1_cut_value", """with e as (select l_suppkey u, l_partkey v, sum(l_quantity) w from lineitem group by 1, 2)
select sum(case when u % 2 <> (v // 3) % 2 then w else 0 end) as cut, sum(w) as total from e""", floats="cut total")
def mc1_cut_value(spark, d):
    e = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") * 2 + 1).alias("u"), (F.col("l_partkey") * 2).alias("v")).agg(F.sum("l_quantity").alias("weight"))
    sup = table(spark, d, "supplier").select((F.col("s_suppkey") * 2 + 1).alias("node"), (F.col("s_suppkey") % 2).alias("side"))
    par = table(spark, d, "part").select((F.col("p_partkey") * 2).alias("node"), (F.floor(F.col("p_partkey") / 3) % 2).alias("side"))
    return M.cut_value(e, sup.unionByName(par))


@q("mc1_best_cuts", floats="cut")
@q("mc1_all_cuts", floats="cut")
def mc1_all_cuts(spark, d):
    """The largest cut among every customer's orders, however many; without related orders it is 0."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("k"))
    x = o.select(F.col("o_custkey").alias("graph"), "k", F.posexplode("k").alias("u", "ku"))
    x = x.select("graph", "u", "ku", F.posexplode("k").alias("v", "kv")).where("u < v and (ku + kv) % 3 = 0")
    cuts = M.exact_cuts(stage(x.select("graph", "u", "v", ((F.col("ku") * 7 + F.col("kv") * 13) % 10).alias("weight"))))
    return o.select(F.col("o_custkey").alias("graph")).join(cuts, "graph", "left").select("graph", F.coalesce("cut", F.lit(0.0)).alias("cut"))


@q("sh1_dirichlet_energy", """with e as (select a.vec_id u, a.vec_id + 1 v from embeddings a) select u, v, list_sum(list_transform(range(1, len(x.embedding) + 1), lambda i: pow(x.embedding[i]::double - y.embedding[i]::double, 2))) as energy
from e join embeddings x on x.vec_id = u join embeddings y on y.vec_id = v""", floats="energy")
def sh1_dirichlet_energy(spark, d):
    """Energy of the path through the embeddings in the order of their ids."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").alias("x"))
    e = v.select(F.col("node").alias("u"), (F.col("node") + 1).alias("v"), F.lit(1.0).alias("weight"))
    return M.dirichlet_energy(e, v).where("energy is not null")


@q("sv1_value_conflicts", f"""with {_FACTS}, g as (select doc_id, subject, attribute, count(distinct value) filter (not negated) v, list_distinct(list(value) filter (not negated)) h, list_distinct(list(value) filter (negated)) l from f group by 1, 2, 3)
select doc_id, subject, attribute, v as values, coalesce(len(list_intersect(h, l)), 0) as denied from g where v > 1 or coalesce(len(list_intersect(h, l)), 0) > 0""")
def sv1_value_conflicts(spark, d):
    return C.value_conflicts(_facts(spark, d)).withColumn("denied", F.col("denied").cast("long"))


@q("sv1_equal_but_different", f"""with {_FACTS}, v as (select doc_id, subject, attribute, min(value) value from f where not negated group by 1, 2, 3 having count(distinct value) = 1)
select x.doc_id, x.attribute, x.subject as a, y.subject as b, x.value from v x join v y on x.doc_id = y.doc_id and x.attribute = y.attribute and y.subject = x.subject + 100 and x.value = y.value""")
def sv1_equal_but_different(spark, d):
    f = _facts(spark, d)
    diff = f.select("doc_id", "attribute", F.col("subject").alias("a"), (F.col("subject") + 100).alias("b")).distinct()
    return C.equal_but_different(f, diff)


@q("sv3_ready_facts", f"""with {_FACTS} select doc_id, fact_id from f where exists (select 1 from f g where g.doc_id = f.doc_id and g.fact_id = f.fact_id - 1) or fact_id % 10 = 1""")
def sv3_ready_facts(spark, d):
    """Facts whose predecessor of the same order line is there too; first lines depend on nothing."""
    need = F.when(F.col("fact_id") % 10 != 1, F.array(F.col("fact_id") - 1))
    return C.ready(_facts(spark, d).withColumn("depends", need)).select("doc_id", "fact_id")


@q("sv7_leave_one_out", f"""with {_FACTS}, c as (select doc_id, subject, attribute, value, count(*) n from f where not negated group by 1, 2, 3, 4), g as (select doc_id, subject, attribute, count(*) k, min(n) least from c group by 1, 2, 3)
select doc_id, subject, attribute, k = 2 and least = 1 as single_cause from g where k > 1""")
def sv7_leave_one_out(spark, d):
    """Conflicts that one fact less would solve: two values, one of them stated once."""
    c = _facts(spark, d).where("not negated").groupBy("doc_id", "subject", "attribute", "value").agg(F.count("*").alias("n"))
    g = c.groupBy("doc_id", "subject", "attribute").agg(F.count("*").alias("k"), F.min("n").alias("least")).where("k > 1")
    return g.select("doc_id", "subject", "attribute", ((F.col("k") == 2) & (F.col("least") == 1)).alias("single_cause"))


_COLOURED = f"""f as (select doc_id, attribute, case kind when 'greater' then 'value' else kind end kind, a, b, case when kind = 'greater' then b % 3 end v, case attribute when 'O' then 2 when 'P' then 1 else 3 end most
  from ({ENTITY_RELATIONS}) z where kind <> 'greater' or rel_id % 4 = 0),
asg as (select unnest(range(2187)) i), x as (select doc_id, attribute, i, any_value(most) most, bool_and(case kind when 'same' then (i // 3 ** a) % 3 = (i // 3 ** b) % 3 when 'different' then (i // 3 ** a) % 3 <> (i // 3 ** b) % 3 else (i // 3 ** a) % 3 = v end) ok,
  bit_or(cast(case when kind = 'value' then 1 << cast((i // 3 ** a) % 3 as int) else (1 << cast((i // 3 ** a) % 3 as int)) | (1 << cast((i // 3 ** b) % 3 as int)) end as int)) used from f cross join asg group by 1, 2, 3)"""


@q("sv2_within_values", f"""with {_COLOURED.replace("3 ** a", "cast(power(3, a) as bigint)").replace("3 ** b", "cast(power(3, b) as bigint)")}
select doc_id, attribute, coalesce(bool_or(ok and bit_count(used) <= most), false) as fits from x group by 1, 2""")
def sv2_within_values(spark, d):
    """Whether each attribute's entities can do with one, two or three values; some have theirs named."""
    from plumbline.operators.cores import within_values

    r = stage(entity_relations(spark, d).where("kind <> 'greater' or rel_id % 4 = 0"))
    value = F.when(F.col("kind") == "greater", F.col("b") % 3)
    facts = r.select("doc_id", "attribute", F.when(F.col("kind") == "greater", "value").otherwise(F.col("kind")).alias("kind"), "a",
                     F.when(F.col("kind") != "greater", F.col("b")).alias("b"), value.alias("value"))
    most = F.when(F.col("attribute") == "O", 2).when(F.col("attribute") == "P", 1).otherwise(3)
    return within_values(facts, r.select("doc_id", "attribute", most.alias("most")).distinct())


_IDENTITY = """select l_suppkey as doc_id, case when l_quantity <= 4 then 'conflate' else 'distinct' end as kind, l_partkey as a, l_partkey + l_suppkey % 5 + case when l_quantity <= 4 then 1 else 2 end as b
from lineitem where l_quantity <= 4 or l_quantity > 47"""


@q("sv4_satisfiable", f"""with recursive {_FACTS}, i as ({_IDENTITY}), two as (select doc_id, a u, b v from i where kind = 'conflate' union select doc_id, b, a from i where kind = 'conflate'),
w as (select distinct doc_id, u s, u v from two union select w.doc_id, w.s, t.v from w join two t on t.doc_id = w.doc_id and t.u = w.v), cls as (select doc_id, s entity, min(v) c from w group by 1, 2),
r as (select f.doc_id, coalesce(cls.c, subject) subject, attribute, value, negated from f left join cls on cls.doc_id = f.doc_id and cls.entity = f.subject),
bad as (select distinct i.doc_id from i left join cls x on x.doc_id = i.doc_id and x.entity = i.a left join cls y on y.doc_id = i.doc_id and y.entity = i.b where kind = 'distinct' and coalesce(x.c, i.a) = coalesce(y.c, i.b)),
g as (select doc_id, subject, attribute, count(distinct value) filter (not negated) v, list_distinct(list(value) filter (not negated)) h, list_distinct(list(value) filter (negated)) l from r group by 1, 2, 3)
select doc_id, count(*) as subjects, count(*) filter (v > 1 or coalesce(len(list_intersect(h, l)), 0) > 0) as conflicts, doc_id in (select doc_id from bad) as identity_conflict from g group by 1""")
def sv4_satisfiable(spark, d):
    """Facts by the identity of their subjects: subjects and attributes that cannot all hold, and documents in which one
    subject is said to be two."""
    from plumbline.operators.cores import one_identity

    few = F.col("l_quantity") <= 4
    identity = table(spark, d, "lineitem").where("l_quantity <= 4 or l_quantity > 47").select(
        F.col("l_suppkey").alias("doc_id"), F.when(few, "conflate").otherwise("distinct").alias("kind"), F.col("l_partkey").alias("a"),
        (F.col("l_partkey") + F.col("l_suppkey") % 5 + F.when(few, 1).otherwise(2)).alias("b"))
    facts, bad = one_identity(_facts(spark, d), stage(identity))
    facts = stage(facts)
    all_ = facts.select("doc_id", "subject", "attribute").distinct().groupBy("doc_id").agg(F.count("*").alias("subjects"))
    hit = C.value_conflicts(facts).groupBy("doc_id").agg(F.count("*").alias("conflicts"))
    out = all_.join(hit, "doc_id", "left").join(bad.withColumn("identity_conflict", F.lit(True)), "doc_id", "left")
    return out.select("doc_id", "subjects", F.coalesce("conflicts", F.lit(0)).alias("conflicts"), F.coalesce("identity_conflict", F.lit(False)).alias("identity_conflict"))


@q("sv5_minimal_cores")
def sv5_minimal_cores(spark, d):
    """One minimal list of relations that cannot all hold, for every attribute that contradicts itself."""
    from plumbline.operators.cores import minimal_cores

    r = stage(entity_relations(spark, d))
    return minimal_cores(r, _arity_of(r))


@q("sv6_naive_readings", f"""with recursive {_CLASSED}, {_PARITY.replace("and attribute = 'O'", "")}, {_ORDER}, k as (select doc_id, claim_id from ({CLAIMS}) q where kind in ('asserted', 'premise')),
 t as (select distinct doc_id, attribute from c where kind = 'different' and ca = cb union select doc_id, attribute from reach where s = v)
select distinct doc_id, attribute, 'two values' as reading from odd o where s = v and p = 1 and attribute <> 'O' and not exists (select 1 from t where t.doc_id = o.doc_id and t.attribute = o.attribute)""")
def sv6_naive_readings(spark, d):
    """Attributes that only contradict themselves if they are taken to have two values."""
    from plumbline.operators.entity_graph import contradictions

    r = stage(entity_relations(spark, d))
    two = contradictions(r, r.select("doc_id", "attribute", F.lit("binary").alias("arity")).distinct()).select("doc_id", "attribute").distinct()
    real = contradictions(r, _arity_of(r)).select("doc_id", "attribute")
    return two.join(real, ["doc_id", "attribute"], "left_anti").withColumn("reading", F.lit("two values"))


@q("sv6_naive_cores")
def sv6_naive_cores(spark, d):
    """The relations that a reader who takes every attribute to have two values would flag."""
    from plumbline.operators.cores import minimal_cores

    r = stage(entity_relations(spark, d))
    return minimal_cores(r, r.select("doc_id", "attribute", F.lit("binary").alias("arity")).distinct())


queries, oracle_sql = family.queries, family.oracle_sql
