"""Inputs of the consistency operators, derived from the driver tables by plain SQL.

The same text runs on Spark and inside the queries' SQL; what is under test are the operators above these inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.session import stage, table

#: A customer is a document, its orders in key order are the claims.
CLAIMS = """
select o_custkey as doc_id, cast(row_number() over (partition by o_custkey order by o_orderkey) - 1 as int) as claim_id,
  case when o_orderpriority = '1-URGENT' then 'premise' when o_orderpriority = '2-HIGH' then 'quoted'
       else 'asserted' end as kind,
  o_orderkey as k, o_orderstatus as status
from orders
"""
_PAIRS_OF = """
select x.doc_id, x.claim_id as a, y.claim_id as b, x.k as ka, y.k as kb, x.status as status
from {claims} x join {claims} y on x.doc_id = y.doc_id where y.claim_id - x.claim_id in (1, 3)
"""
_PAIRS = _PAIRS_OF.format(claims=f"({CLAIMS})")
#: Neighbouring claims are related; some pairs are stated twice, the later time the other way round.
_RELATIONS_OF = """
select doc_id, a * 1000 + b as seq, a, b,
  case (ka * 31 + kb * 17) % 6 when 0 then 'contradicts' when 1 then 'unrelated' when 2 then 'tension' else ' Supports' end
    as relation,
  cast((ka * 7919 + kb * 104729) % 1100 as double) / 1000 as confidence
from {pairs} p
union all
select doc_id, 1000000 + a * 1000 + b, b, a, 'contradicts', 0.9 from {pairs} q where (ka + kb) % 11 = 0
"""
RELATIONS = _RELATIONS_OF.format(pairs=f"({_PAIRS})")
#: Entities stated by the claims: their order, equality and difference in an attribute.
_ENTITY_OF = """
select doc_id, a * 1000 + b as rel_id, a as claim_id, status as attribute,
  case when (ka + kb) % 5 = 0 then 'same' when (ka + kb) % 5 in (1, 2) then 'different' else 'greater' end as kind,
  case when (ka * 3 + kb) % 2 = 0 then ka % 7 else kb % 7 end as a,
  case when (ka * 3 + kb) % 2 = 0 then kb % 7 else ka % 7 end as b,
  cast((ka * 7919 + kb * 104729) % 1000 as double) / 1000 as confidence
from {pairs} r
"""
ENTITY_RELATIONS = _ENTITY_OF.format(pairs=f"({_PAIRS})")


def orders_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(text.replace("from orders", "from {orders}"), orders=table(spark, sf_dir, "orders"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_sql(spark, sf_dir, CLAIMS)


def pairs(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """The pairs that both kinds of relations are stated of, staged: they are read several times."""
    return stage(spark.sql(_PAIRS_OF, claims=stage(claims(spark, sf_dir)) if of is None else of))


def relations(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    return spark.sql(_RELATIONS_OF, pairs=pairs(spark, sf_dir) if of is None else of)


def entity_relations(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    return spark.sql(_ENTITY_OF, pairs=pairs(spark, sf_dir) if of is None else of)
