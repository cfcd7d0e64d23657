"""Every core query against its SQL on the smallest tables; queries without SQL must run and give rows."""

import glob
import math
import os

import duckdb
import numpy as np
import pytest

from plumbline import plans

QUERIES = {k: f for m in plans.modules() for k, f in m.queries().items()}
SQL = {k: s for m in plans.modules() for k, s in m.oracle_sql().items()}
#: Queries whose result may rightly be empty.
MAY_BE_EMPTY = {"wn3_chain_breaks", "jn17_orphans", "jn28_closing_triples", "gr25_short_cycles", "gr25_all_cycles", "ag12_direction_disagreements", "vf1_repeated_sentences", "wn12_first_breach", "vf3_forbidden", "sc1_collisions", "src2_bases", "sv6_naive_readings"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(norm(x) for x in v)
    return str(v) if hasattr(v, "isoformat") else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got or name in MAY_BE_EMPTY
    if name in SQL:
        r = duck.execute(SQL[name])
        names = [c[0] for c in r.description]
        assert sorted(names) == sorted(df.columns)
        assert got == rows(names, r.fetchall())
