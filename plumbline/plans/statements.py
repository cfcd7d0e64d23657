"""Queries of statements: comparisons, the relations derived from them, and what was overridden or left open."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import entity_graph as E
from plumbline.operators import statements as T
from plumbline.plans.bindings import _PAIRS, CLAIMS, claims, pairs
from plumbline.plans.registry import Family
from plumbline.plans.texts import _SENT, _sentences

family = Family()
q = family.query

#: What is said of a customer's orders: orders and extremes in several wordings, equality and difference.
_STATEMENTS_OF = """
select doc_id, a * 1000 + b as seq, case when (ka + kb) % 23 = 0 then 999 else a end as claim_id,
  case when (ka + kb) % 5 = 0 then 'extreme' when (ka + kb) % 5 = 1 then case when ka % 2 = 0 then 'same' else 'different' end else 'order' end as statement,
  case (ka * 3 + kb) % 4 when 0 then ' Age' when 1 then 'Older' when 2 then 'Arrival time' else 'rank' end as attribute,
  case when (ka + kb) % 5 = 0 then
    case (ka * 7 + kb * 5) % 8 when 0 then 'first' when 1 then 'the Oldest' when 2 then '"Last".' when 3 then 'earliest' when 4 then 'tallest' when 5 then 'calmest' when 6 then 'most' else 'fewest' end
  else
    case (ka * 7 + kb * 5) % 11 when 0 then 'Older than' when 1 then 'younger' when 2 then 'earlier  than' when 3 then 'after' when 4 then 'more' when 5 then 'calmer than'
      when 6 then '(fewer than)' when 7 then 'Before' when 8 then 'ahead of' when 9 then 'the lighter' else 'prior to' end end as comparative,
  concat('P-', cast(ka % 6 as varchar(9))) as subject, concat(' p ', cast(kb % 6 as varchar(9))) as object,
  case when ka % 9 = 0 then 'of the two' when ka % 9 = 1 then ' ' end as restriction,
  case when ka % 4 = 0 then null when (ka + kb) % 5 = 0 then case when kb % 2 = 0 then 'max' else 'min' end when kb % 3 = 0 then 'object' else 'subject' end as greater_side,
  case (ka * 3 + kb) % 4 when 2 then 'sequence' when 3 then 'other' else 'magnitude' end as order_kind
from {pairs} p
"""
_STATEMENTS = _STATEMENTS_OF.format(pairs=f"({_PAIRS})")


def statements(spark, d):
    c = claims(spark, d)
    return spark.sql(_STATEMENTS_OF, pairs=pairs(spark, d, c)), c


def derivation(spark, d):
    from plumbline.session import stage

    s, c = statements(spark, d)
    s = stage(s)
    return T.Derivation(s, s.select("doc_id", "attribute", "seq", "order_kind"), s.select("doc_id", "attribute", "comparative", "seq", "greater_side"), c)


_KEY = "trim(regexp_replace(lower(trim({0})), '[^a-z0-9]+', '_', 'g'), '_')"
_RENAME = "case {0} " + " ".join(f"when '{k}' then '{n}'" for k, (n, _) in T.COMPARATIVES.items()) + " else {0} end"
_ATTR = _RENAME.format(_KEY.format("{0}"))
_COMP = """regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(lower({0}), '\\s+', ' ', 'g')), '^[ \\t\\n"''.,;:!?()\\[\\]]+|[ \\t\\n"''.,;:!?()\\[\\]]+$', '', 'g'), '^the ', ''), '(.) than$', '\\1')"""
_LEX = ", ".join(f"('{k}', '{w.removesuffix(' than')}', '{s}')" for k, sides in T.LEXICON.items() for s, words in sides.items() for w in words)
_DERIVED = f"""
st as (select * from ({_STATEMENTS}) z), lex(kind, word, side) as (values {_LEX}),
k as (select st.* exclude (attribute, subject, object), comparative as stated, {_ATTR.format("attribute")} attribute, {_COMP.format("comparative")} word, {_KEY.format("subject")} sk, {_KEY.format("object")} ok,
  statement = 'extreme' and coalesce(length(trim(restriction)) > 0, false) restricted from st),
kinds as (select doc_id, attribute, arg_min(order_kind, seq) kind from k group by 1, 2),
model as (select doc_id, attribute, word, arg_min(greater_side, seq) model from k where greater_side is not null group by 1, 2, 3),
s as (select k.*, lex.side lexical, model.model, coalesce(lex.side, model.model) side from k join kinds using (doc_id, attribute) left join model using (doc_id, attribute, word)
  left join lex on lex.kind = kinds.kind and lex.word = k.word where exists (select 1 from ({CLAIMS}) c where c.doc_id = k.doc_id and c.claim_id = k.claim_id)),
two as (select doc_id, attribute, sk u, ok v from s where statement = 'same' and sk <> ok union select doc_id, attribute, ok, sk from s where statement = 'same' and sk <> ok),
eq as (select distinct doc_id, attribute, u s, u v from two union select w.doc_id, w.attribute, w.s, t.v from eq w join two t on t.doc_id = w.doc_id and t.attribute = w.attribute and t.u = w.v),
cls as (select doc_id, attribute, s entity, min(v) class from eq group by 1, 2, 3),
dir as (select * from s where statement in ('order', 'extreme') and not restricted),
part as (select distinct doc_id, attribute, sk o from dir union select doc_id, attribute, ok from dir where statement = 'order'),
ext as (select distinct x.doc_id, x.claim_id, x.attribute, x.side, case x.side when 'max' then x.sk else p.o end a, case x.side when 'max' then p.o else x.sk end b
  from dir x join part p using (doc_id, attribute) left join cls c1 on c1.doc_id = x.doc_id and c1.attribute = x.attribute and c1.entity = x.sk
  left join cls c2 on c2.doc_id = x.doc_id and c2.attribute = x.attribute and c2.entity = p.o
  where x.statement = 'extreme' and x.side in ('max', 'min') and coalesce(c1.class, x.sk) <> coalesce(c2.class, p.o)),
rel as (select doc_id, claim_id, attribute, statement as kind, sk a, ok b, false from_extreme from s where statement in ('same', 'different')
  union select doc_id, claim_id, attribute, 'greater', case side when 'subject' then sk else ok end, case side when 'subject' then ok else sk end, false from s where statement = 'order' and side in ('subject', 'object')
  union select doc_id, claim_id, attribute, 'greater', a, b, true from ext)
"""


@q("sf8_comparatives", f"""select distinct comparative, {_COMP.format("comparative")} as key from ({_STATEMENTS}) z""")
def sf8_comparatives(spark, d):
    """Wordings of comparisons in normal form."""
    return statements(spark, d)[0].select("comparative", T.comparative_key(F.col("comparative")).alias("key")).distinct()


@q("sf8_lexicon_words", f"""with {_SENT}, h as (select record_id, pos, unnest(regexp_extract_all(lower(sentence), '\\b({"|".join(sorted(T.WORDS, key=len, reverse=True))})\\b', 1)) as word from s)
select record_id, word, count(*) as n from h group by 1, 2""")
def sf8_lexicon_words(spark, d):
    """The lexicon's words that each record's sentences hold."""
    h = _sentences(spark, d).select("record_id", F.explode(T.lexicon_words(F.col("sentence"))).alias("word"))
    return h.groupBy("record_id", "word").agg(F.count("*").alias("n"))


@q("prj4_normalized_relations", f"""with r as (select doc_id, seq, attribute, 'greater' as kind, subject, object, {_KEY.format("attribute")} as raw from ({_STATEMENTS}) z)
select doc_id, seq, {_RENAME.format("raw")} as attribute, {_KEY.format("case when raw in ('younger', 'shorter', 'lighter', 'earlier', 'slower') then object else subject end")} as a,
 {_KEY.format("case when raw in ('younger', 'shorter', 'lighter', 'earlier', 'slower') then subject else object end")} as b
from (select * replace (case when seq % 3 = 0 then 'younger' else raw end as raw) from r) x""")
def prj4_normalized_relations(spark, d):
    """Relations under attributes that are themselves comparisons, some of them pointing to less."""
    s = statements(spark, d)[0]
    raw = F.when(F.col("seq") % 3 == 0, "Younger").otherwise(F.col("attribute"))
    r = s.select("doc_id", "seq", raw.alias("attribute"), F.lit("greater").alias("kind"), F.col("subject").alias("a"), F.col("object").alias("b"))
    return T.normalize_relations(r).drop("kind")


@q("gr20_derived_relations", f"with recursive {_DERIVED} select * from rel")
def gr20_derived_relations(spark, d):
    """All relations that the statements stand for, each once a claim."""
    return derivation(spark, d).relations().distinct()


@q("gr20_overrides", f"with recursive {_DERIVED} select doc_id, claim_id, attribute, stated as comparative, model, lexical from dir where lexical <> model")
def gr20_overrides(spark, d):
    return derivation(spark, d).overrides()


@q("gr20_unresolved", f"""with recursive {_DERIVED} select doc_id, claim_id, attribute, stated as comparative, statement, side as sense from dir
where side is null or (statement = 'order' and side not in ('subject', 'object')) or (statement = 'extreme' and side not in ('max', 'min'))""")
def gr20_unresolved(spark, d):
    return derivation(spark, d).unresolved()


@q("gr20_restricted", f"with recursive {_DERIVED} select doc_id, claim_id, attribute, sk as entity, restriction from s where restricted")
def gr20_restricted(spark, d):
    return derivation(spark, d).restricted()


@q("gr18_superlative_collisions", f"""with recursive {_DERIVED} select distinct x.doc_id, x.attribute, x.a, x.b, x.side from ext x
join ext y on y.doc_id = x.doc_id and y.attribute = x.attribute and y.a = x.b and y.b = x.a and y.side = x.side where x.a < x.b""")
def gr18_superlative_collisions(spark, d):
    """Two entities that are both said to be the most, or both the least."""
    return E.superlative_collisions(derivation(spark, d).expanded())


queries, oracle_sql = family.queries, family.oracle_sql
