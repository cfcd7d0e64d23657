"""Graph queries without bounds against plain Python on the smallest tables."""

import random
from collections import defaultdict
from functools import partial

import numpy as np
import pyarrow as pa
import pytest

from plumbline.operators import metrics, searches
from plumbline.operators.paths import both_ways, hop_distances
from plumbline.plans import matching, ordered, structures


def neighbours(edges):
    near = defaultdict(set)
    for u, v in edges:
        near[u].add(v)
        near[v].add(u)
    return near


def search(near, source):
    hops, todo = {source: 0}, [source]
    for u in todo:
        for v in near[u]:
            if v not in hops:
                hops[v] = hops[u] + 1
                todo.append(v)
    return hops


def farthest(hops):
    return max((h, n) for n, h in hops.items())


def test_long_path_and_many_sources(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(17)] + [(rnd.randrange(100, 220), rnd.randrange(100, 220)) for _ in range(120)]
    e = metrics.canonical_edges(spark.createDataFrame(edges, "u long, v long"))
    near = neighbours(edges)
    sources = [0, 8, 17, 999, *range(100, 230)]
    got = {(r.source, r.node): r.hops for r in hop_distances(both_ways(e), spark.createDataFrame([(s,) for s in sources], "source long")).collect()}
    assert got == {(s, n): h for s in sources for n, h in search(near, s).items()}
    end = metrics.double_sweep(e, spark.createDataFrame([(8,)], "source long")).first()
    assert end["diameter"] == 17


def test_whole_graph_queries(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_partkey", "l_suppkey").collect()
    suppliers = [r[0] * 2 + 1 for r in spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey").collect()]
    near = neighbours({(r[0] * 2, r[1] * 2 + 1) for r in lines})
    want = {s: search(near, s) for s in suppliers}
    q = structures.queries
    assert {(r.source, r.node, r.hops) for r in q()["gm6_all_distances"](spark, sf).collect()} == {(s, n, h) for s in want for n, h in want[s].items()}
    masses = {(r.source, r.hops): r.mass for r in q()["gm9_all_masses"](spark, sf).collect()}
    assert masses == {(s, k): sum(h <= k for h in want[s].values()) for s in want for k in set(want[s].values())}
    _, first = farthest(search(near, min(near)))
    diameter, end = farthest(search(near, first))
    assert [tuple(r) for r in q()["gm7_all_sweep"](spark, sf).collect()] == [(end, diameter)]


def brute_cut(n, edges):
    return max(sum(w for u, v, w in edges if (m >> u ^ m >> v) & 1) for m in range(1 << (n - 1)))


def test_cuts_of_any_size(spark):
    rnd = random.Random(8)
    graphs = {}
    for g, (n, p) in enumerate([(3, 1), (9, 0.5), (10, 1), (12, 0.3), (13, 0.8), (14, 0.15)]):
        graphs[g] = n, [(u, v, rnd.randrange(-2, 9)) for u in range(n) for v in range(u) if rnd.random() < p]
    want = {g: brute_cut(n, e) for g, (n, e) in graphs.items()}
    for width in (3, 20):
        assert {g: metrics.max_cut(*zip(*e), width) for g, (_, e) in graphs.items()} == want
    df = spark.createDataFrame([(g, *x) for g, (_, e) in graphs.items() for x in e], "graph long, u int, v int, weight int")
    assert {r.graph: r.cut for r in metrics.exact_cuts(df).collect()} == want


def test_every_customer_has_a_cut(spark, sf):
    keys = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey", "o_orderkey").collect():
        keys[r[0]].append(r[1])
    got = {r.graph: r.cut for r in structures.queries()["mc1_all_cuts"](spark, sf).collect()}
    assert set(got) == set(keys) and max(len(k) for k in keys.values()) > 9
    for g, k in keys.items():
        if len(k) <= 13:
            k.sort()
            e = [(u, v, (k[u] * 7 + k[v] * 13) % 10) for v in range(len(k)) for u in range(v) if (k[u] + k[v]) % 3 == 0]
            assert got[g] == (brute_cut(len(k), e) if e else 0)


def test_missing_reviews_of_all_reviewers(spark, tmp_path):
    rows = [("decision", f"d{i}", f"Rev_{j}") for i in range(4) for j in range(9) if (i + j) % 3 == 0] + [("decision", None, "x"), ("note", "d0", "y")]
    spark.createDataFrame(rows, "kind string, doc_id string, reviewer string").write.parquet(f"{tmp_path}/decisions.parquet")
    got = [tuple(r) for r in ordered.queries()["jn14_all_missing_reviews"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted((f"d{i}", f"rev {j}") for i in range(4) for j in range(9) if (i + j) % 3)


def test_cycles_of_up_to_six(spark):
    rnd = random.Random(6)
    edges = {(rnd.randrange(7), rnd.randrange(7)) for _ in range(22)} | {(10 + i, 10 + (i + 1) % 6) for i in range(6)}
    want = defaultdict(int)

    def walk(path):
        for u, v in edges:
            if u == path[-1] and u != v:
                if v == path[0] and len(path) <= 6:
                    want[len(path)] += 1
                elif v > path[0] and v not in path and len(path) < 6:
                    walk([*path, v])

    for s in range(16):
        walk([s])
    rows = [("d", "age", "greater", u, v) for u, v in edges]
    df = spark.createDataFrame(rows, "doc_id string, attribute string, kind string, a long, b long")
    assert {r.length: r.cycles for r in matching.order_cycles(df, 6).collect()} == dict(want) and want[6]


def scattered():
    """Components of every kind, far ids, repeats, loops, and sources with and without edges."""
    rnd = random.Random(5)
    edges = [(i, i + 1) for i in range(9)] + [(10**12 + rnd.randrange(150), 10**12 + rnd.randrange(150)) for _ in range(400)]
    edges += [(5_000 + 2 * i, 5_001 + 2 * i) for i in range(60)] + [(-7, -7), (-9, -8), (-8, -9), (700, 800)] + [(800, 801 + i) for i in range(90)]
    rnd.shuffle(edges)
    return edges, [0, 20, 40, -7, -8, 999, 5_003, 5_002, 800, 700, *range(10**12, 10**12 + 140)]


@pytest.mark.parametrize("kernel", [1 << 20, 100, 0])
@pytest.mark.parametrize("limit", [10_000, 2])
def test_searches_by_component(spark, kernel, limit):
    edges, sources = scattered()
    near = neighbours(edges)
    want = {(s, n): h for s in sources for n, h in search(near, s).items() if h <= limit}
    e = spark.createDataFrame([*edges, (None, 3), (4, None)], "u long, v long").repartition(3)
    s = spark.createDataFrame([(s,) for s in [*sources, None, 20]], "source long")
    rows = searches.distances(e, s, limit, kernel).collect()
    assert {(r.source, r.node): r.hops for r in rows} == want and len(rows) == len(want)
    counts = {}
    for (a, _), h in want.items():
        counts[a, h] = counts.get((a, h), 0) + 1
    rows = searches.shells(e, s, limit, kernel).collect()
    assert {(r.source, r.hops): r.n for r in rows} == counts and len(rows) == len(counts)


def test_searches_without_rows(spark):
    none, one = spark.createDataFrame([], "u long, v long"), spark.createDataFrame([(3,)], "source long")
    assert [tuple(r) for r in searches.distances(none, one).collect()] == [(3, 3, 0)]
    assert searches.shells(spark.createDataFrame([(1, 2)], "u long, v long"), one.where("source is null")).collect() == []


def test_bundles_keep_every_edge(monkeypatch):
    monkeypatch.setattr(searches, "ROW", 7)
    edges, _ = scattered()
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*edges[i : i + 50])], ["u", "v"]) for i in range(0, len(edges), 50)]
    for batch, many in ((1, len(batches)), (1 << 20, 1)):
        monkeypatch.setattr(searches, "BATCH", batch)
        rows = [r for b in searches._bundles(iter(batches)) for r in b.to_pylist()]
        assert sorted(e for r in rows for e in zip(r["us"], r["vs"])) == sorted(edges)
        assert all(len(r["us"]) <= 7 for r in rows)
        nodes = [n for r in rows for n in r["nodes"]]
        assert set(nodes) == {n for e in edges for n in e} and (many > 1 or len(nodes) == len(set(nodes)))


def test_ball_masses_list_no_pairs(spark, monkeypatch):
    """Masses come from counts made where a component is searched; no row stands for a pair of nodes."""
    monkeypatch.setattr(metrics, "hop_distances", None)
    monkeypatch.setattr(searches, "hop_distances", None)
    edges, sources = scattered()
    near = neighbours(edges)
    rows = metrics.ball_masses(spark.createDataFrame(edges, "u long, v long"), spark.createDataFrame([(s,) for s in sources], "source long")).collect()
    want = {s: list(search(near, s).values()) for s in sources}
    assert {(r.source, r.hops): r.mass for r in rows} == {(s, k): sum(h <= k for h in hs) for s, hs in want.items() for k in set(hs)}


@pytest.mark.parametrize("name", ["gm6_all_distances", "gm6_hop_distances", "gm9_all_masses", "gm9_mass_dimension"])
def test_graph_queries_take_no_rounds(spark, sf, monkeypatch, name):
    """Graphs of a size that a task can hold are searched there; a round a hop is for larger ones."""
    for where in (metrics, searches, structures):
        monkeypatch.setattr(where, "hop_distances", None, raising=False)
    assert structures.queries()[name](spark, sf).count() > 0


@pytest.mark.parametrize("chunk", [0, 1, 64, 1 << 18])
def test_words_follow_edges(monkeypatch, chunk):
    """Several words of sources at once reach what plain searches reach, whichever end the edges are followed from."""
    monkeypatch.setattr(searches, "CHUNK", max(chunk, 1))
    rnd = random.Random(11)
    n, many = 700, 150
    near = neighbours([(rnd.randrange(n), rnd.randrange(n)) for _ in range(2 * n)] + [(0, i) for i in range(300, 400)])
    lists = [sorted(near[u]) for u in range(n)]
    start = np.cumsum([0, *map(len, lists)])
    flat = np.array([v for x in lists for v in x], np.int32)
    bit = np.arange(many)
    new = np.zeros((n, 3), np.uint64)
    new[bit * 4, bit // 64] = np.left_shift(np.uint64(1), (bit % 64).astype(np.uint64))
    full = np.bitwise_or.reduce(new, axis=0)
    known, got = new.copy(), []
    while new.any():
        got.append(searches._bit_counts(new)[:many])
        new = searches._follow(new, known, full, start, flat)
        known |= new
    want = [list(search(near, s * 4).values()) for s in range(many)]
    assert [[x.count(h) for h in range(len(got))] for x in want] == np.array(got).T.tolist()


def test_large_components_take_no_rounds(spark, monkeypatch):
    """Components above the kernel's size are held by every task, which has some sources; no row stands for a pair."""
    monkeypatch.setattr(searches, "hop_distances", None)
    edges, sources = scattered()
    near = neighbours(edges)
    e, s = spark.createDataFrame(edges, "u long, v long"), spark.createDataFrame([(s,) for s in sources], "source long")
    rows = searches.shells(e, s, kernel=100).collect()
    want = {s: list(search(near, s).values()) for s in sources}
    assert {(r.source, r.hops): r.n for r in rows} == {(s, k): hs.count(k) for s, hs in want.items() for k in set(hs)}
    monkeypatch.undo()
    monkeypatch.setattr(searches, "WIDE", 0)
    assert sorted(map(tuple, searches.shells(e, s, kernel=100).collect())) == sorted(map(tuple, rows))


@pytest.mark.parametrize("name", ["gm9_all_masses", "gm9_mass_dimension", "gm6_all_distances", "gm6_hop_distances"])
def test_graph_queries_of_large_components(spark, sf, monkeypatch, name):
    """A component above the kernel's size gives the same rows, without a round a hop."""
    whole = sorted(map(tuple, structures.queries()[name](spark, sf).collect()))
    monkeypatch.setattr(searches, "hop_distances", None)
    monkeypatch.setattr(structures, "distances", partial(searches.distances, kernel=10))
    monkeypatch.setattr(metrics, "shells", partial(searches.shells, kernel=10))
    got = sorted(map(tuple, structures.queries()[name](spark, sf).collect()))
    assert whole and [tuple(round(x, 9) for x in r) for r in got] == [tuple(round(x, 9) for x in r) for r in whole]
