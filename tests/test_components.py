import random

from plumbline.operators.components import connected_components


def brute(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


def run(spark, edges):
    df = spark.createDataFrame(edges, "u long, v long")
    return {r.node: r.component for r in connected_components(df).collect()}


def test_random_graphs(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(120), rnd.randrange(120)) for _ in range(90)]
    edges = [(u, v) for u, v in edges if u != v]
    assert run(spark, edges + edges[:5]) == brute(edges)


def test_path_and_hub(spark):
    path = [(i, i + 1) for i in range(40)]
    hub = [(100, i) for i in range(101, 160)]
    assert run(spark, path + hub) == brute(path + hub)


def test_empty_nulls_loops(spark):
    assert run(spark, []) == {}
    assert run(spark, [(None, 1), (2, 2), (3, 4)]) == {3: 3, 4: 3}
