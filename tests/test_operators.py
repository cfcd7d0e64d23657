"""Known cases of the core operators and their behaviour on nulls, ties and empty tables."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators import allocation, entity_graph, evaluation, facts, harmony, leak, metrics, per_document, sequences, signed_graph
from plumbline.operators.skew import lookup_join, salted_sum
from plumbline.sources import files

REL = "doc_id string, seq int, a int, b int, relation string, confidence double"
CLAIM = "doc_id string, claim_id int, kind string"
ENT = "doc_id string, rel_id int, claim_id int, attribute string, kind string, a string, b string, confidence double"


def claims(spark, n, kind="asserted", doc="d"):
    return spark.createDataFrame([(doc, i, kind) for i in range(n)], CLAIM)


def graph(spark, *edges):
    rows = [("d", i, a, b, {1: "supports", -1: "contradicts"}[s], w) for i, (a, b, s, w) in enumerate(edges)]
    return spark.createDataFrame(rows, REL)


def test_frustrated_triangle(spark):
    e = signed_graph.signed_edges(graph(spark, (0, 1, 1, 1.0), (1, 2, 1, 1.0), (0, 2, -1, 1.0)))
    c = claims(spark, 3)
    assert {tuple(r) for r in signed_graph.direct_pairs(e, c).collect()} == {("d", 0, 2)}
    assert signed_graph.unbalanced_claims(e).count() == 3
    assert signed_graph.frustrated_cycle_lengths(e).first()["length"] == 3
    h = harmony.harmony(e, c).first()
    assert h["conflict"] == pytest.approx(1.0) and 0 < h["harmony"] < 1


def test_balanced_square(spark):
    e = signed_graph.signed_edges(graph(spark, (0, 1, 1, 1.0), (1, 2, -1, 1.0), (2, 3, 1, 1.0), (0, 3, -1, 1.0)))
    assert signed_graph.unbalanced_claims(e).count() == 0
    assert signed_graph.frustrated_cycle_lengths(e).count() == 0
    assert harmony.harmony(e, claims(spark, 4)).first()["conflict"] == 0.0


def test_first_relation_wins(spark):
    r = spark.createDataFrame([
        ("d", 2, 1, 0, "supports", 0.9), ("d", 1, 0, 1, " Unrelated ", 0.9), ("d", 3, 2, 2, "supports", 1.0),
        ("d", 4, 1, 2, "supports", float("nan")), ("d", 5, 0, 2, "contradicts", 7.0), ("d", 6, None, 2, "supports", 1.0),
    ], REL)
    assert [tuple(x) for x in signed_graph.signed_edges(r).collect()] == [("d", 0, 2, -1, 1.0)]
    k = signed_graph.graph_counters(r).first()
    assert (k["pairs"], k["edges"], k["repeats"], k["zero_weight"]) == (3, 1, 1, 1)
    assert signed_graph.signed_edges(r.limit(0)).count() == 0


def test_large_components_agree_with_the_kernel(spark, monkeypatch):
    """Anchored, balanced and unbalanced loose components, lone claims and documents without edges, by either way."""
    rnd = random.Random(3)
    rows, kinds = [], []
    add = lambda d, a, b, s: rows.append((d, len(rows), a, b, "supports" if s > 0 else "contradicts", rnd.uniform(0.2, 1)))
    for a, b, s in ((0, 1, 1), (1, 2, -1), (0, 2, 1), (2, 3, 1)):
        add("d", a, b, s)
    kinds += [("d", i, ["asserted", "premise", "quoted"][i % 3]) for i in range(4)]
    for a, b, s in ((20, 21, 1), (21, 22, -1)):
        add("d", a, b, s)  # balanced, nobody asserts it
    for a, b, s in ((30, 31, 1), (31, 32, 1), (30, 32, -1)):
        add("d", a, b, s)  # frustrated, nobody asserts it
    kinds += [("d", i, "quoted") for i in (20, 21, 22, 30, 31, 32)] + [("d", 50, "asserted"), ("lone", 0, "asserted"), ("lone", 1, "quoted")]
    e = signed_graph.signed_edges(spark.createDataFrame(rows, REL))
    c = spark.createDataFrame(kinds, CLAIM)
    both = []
    monkeypatch.setattr(harmony, "RTOL", 1e-5)
    for dense in (1024, 2):
        monkeypatch.setattr(harmony, "DENSE", dense)
        both.append(({(r.doc_id, r.claim_id): r for r in harmony.assignments(e, c).collect()}, {r.doc_id: r for r in harmony.harmony(e, c).collect()}))
    (small, hs), (large, hl) = both
    assert small.keys() == large.keys() and len(small) == 13
    for k, r in small.items():
        assert large[k]["x"] == pytest.approx(r["x"], abs=1e-2), k
        assert large[k]["residual"] == pytest.approx(r["residual"], abs=1e-2) and large[k]["scale"] == pytest.approx(r["scale"])
    for d in ("d", "lone"):
        assert hl[d]["conflict"] == pytest.approx(hs[d]["conflict"], abs=1e-3) and hl[d]["anchored"] == hs[d]["anchored"]
        assert hl[d]["harmony"] == pytest.approx(hs[d]["harmony"], abs=1e-4)
    assert hs["lone"]["harmony"] is None and hs["d"]["anchored"] == 2


def test_iterations_that_do_not_settle_fail(spark, monkeypatch):
    e = signed_graph.signed_edges(graph(spark, *[(i, i + 1, 1, 1.0) for i in range(6)]))
    monkeypatch.setattr(harmony, "DENSE", 3)
    monkeypatch.setattr(harmony, "ROUNDS", 1)
    with pytest.raises(RuntimeError):
        harmony.harmony(e, spark.createDataFrame([("d", i, "asserted" if i else "quoted") for i in range(7)], CLAIM)).count()


def test_culprits(spark):
    """Leaving the claim out that contradicts all others settles the document."""
    e = signed_graph.signed_edges(graph(spark, (0, 1, 1, 1.0), (1, 2, 1, 1.0), (0, 2, 1, 1.0), (0, 3, -1, 1.0), (1, 3, -1, 1.0), (2, 3, -1, 1.0)))
    out = {r.claim_id: r for r in harmony.culprits(e, claims(spark, 4)).collect()}
    assert out[3]["rank"] == 1 and out[3]["harmony_change"] > 0 and len(out) == 3
    rest = signed_graph.signed_edges(graph(spark, (0, 1, 1, 1.0), (1, 2, 1, 1.0), (0, 2, 1, 1.0)))
    want = harmony.harmony(rest, claims(spark, 3)).first()["harmony"] - harmony.harmony(e, claims(spark, 4)).first()["harmony"]
    assert out[3]["harmony_change"] == pytest.approx(want)


def ent(spark, *rows):
    return spark.createDataFrame([("d", i, i, "age", k, a, b, 1.0) for i, (k, a, b) in enumerate(rows)], ENT)


def brute_contradictions(rows, binary):
    """Every kind of contradiction by its definition: values tried out one by one, orders followed step by step."""
    names = sorted({x for _, a, b in rows for x in (a, b)})
    root = {x: x for x in names}
    for _ in names:
        for k, a, b in rows:
            if k == "same":
                root[a] = root[b] = min(root[a], root[b])
    out = set()
    if any(k == "different" and root[a] == root[b] for k, a, b in rows):
        out.add("different_within_class")
    apart = [(root[a], root[b]) for k, a, b in rows if k == "different" and root[a] != root[b]]
    if binary and not any(all(m >> names.index(x) & 1 != m >> names.index(y) & 1 for x, y in apart) for m in range(1 << len(names))):
        out.add("binary_parity")
    reach = {(root[a], root[b]) for k, a, b in rows if k == "greater"}
    for _ in names:
        reach |= {(x, z) for x, y in reach for y2, z in reach if y == y2}
    if any(x == y for x, y in reach):
        out.add("order_cycle")
    return out


@pytest.mark.parametrize("most", [0, 1024])
def test_entity_contradictions(spark, monkeypatch, most):
    """Random documents by either way, the per-document one and the distributed one, against brute force."""
    monkeypatch.setattr(per_document, "MOST", most)
    rnd = random.Random(21)
    docs = {}
    for k in range(40):
        n = rnd.randrange(2, 7)
        docs[f"doc{k}"] = [(rnd.choice(["same", "different", "different", "greater", "greater"]), *(f"n{rnd.randrange(n)}" for _ in "ab")) for _ in range(rnd.randrange(1, 8))]
    rows = [(d, i, i, "rank", *r, 1.0) for d, x in docs.items() for i, r in enumerate(x)]
    arity = spark.createDataFrame([(d, "rank", "binary" if int(d[3:]) % 2 else "multi") for d in docs], "doc_id string, attribute string, arity string")
    df = spark.createDataFrame(rows, ENT)
    got = {d: set() for d in docs}
    for r in entity_graph.contradictions(df, arity).collect():
        got[r.doc_id].add(r.type)
    assert got == {d: brute_contradictions(x, int(d[3:]) % 2 == 1) for d, x in docs.items()}
    assert entity_graph.contradictions(df.limit(0), arity).count() == 0


@pytest.mark.parametrize("most, n", [(0, 11), (1024, 70)])
def test_cycles_of_any_length(spark, monkeypatch, most, n):
    """A frustrated ring and an order ring beside short ones, by either way."""
    monkeypatch.setattr(per_document, "MOST", most)
    ring = lambda d, n, odd: [(d, i, i, (i + 1) % n, "contradicts" if odd and i == 0 else "supports", 1.0) for i in range(n)]
    r = ring("long", n, True) + ring("even", 8, False) + ring("short", 5, True) + [("short", 9, 0, 2, "supports", 1.0)]
    e = signed_graph.signed_edges(spark.createDataFrame(r, REL))
    assert {tuple(x) for x in signed_graph.frustrated_cycle_lengths(e).collect()} == {("long", n), ("short", 3)}
    bad = {}
    for x in signed_graph.unbalanced_claims(e).collect():
        bad[x.doc_id] = bad.get(x.doc_id, 0) + 1
    assert bad == {"long": n, "short": 5}
    claims_ = spark.createDataFrame([(d, i, "asserted") for d, k in (("long", n + 1), ("even", 8)) for i in range(k)], CLAIM)
    parts = {(x.doc_id, x.claim_id): x.component for x in signed_graph.components(e, claims_).collect()}
    assert parts == {("long", i): 0 for i in range(n)} | {("long", n): n} | {("even", i): 0 for i in range(8)}
    rows = [("greater", f"n{i:02}", f"n{(i + 1) % n:02}") for i in range(n - 1)] + [("same", f"n{n - 1:02}", "n00")]
    rows += [("greater", "x", "y"), ("same", "z", "y"), ("greater", "z", "w"), ("greater", "v", "u")]
    df = ent(spark, *rows)
    assert {tuple(x) for x in entity_graph.order_cycle_lengths(df).collect()} == {("d", "age", n)}
    assert {tuple(x) for x in entity_graph.order_cycle_lengths(df.union(ent(spark, ("same", "x", "w")))).collect()} == {("d", "age", 4)}


def test_superlative_collision(spark):
    x = spark.createDataFrame([("d", 1, "age", "kim", "max"), ("d", 2, "age", "lou", "max"), ("d", 3, "age", "moe", "min")], "doc_id string, claim_id int, attribute string, entity string, side string")
    p = spark.createDataFrame([("d", "age", n) for n in ("kim", "lou", "moe")], "doc_id string, attribute string, entity string")
    c = spark.createDataFrame([], "doc_id string, attribute string, entity string, class string")
    assert [tuple(r) for r in entity_graph.superlative_collisions(entity_graph.expand_superlatives(x, p, c)).collect()] == [("d", "age", "kim", "lou", "max")]
    same = spark.createDataFrame([("d", "age", "kim", "kim"), ("d", "age", "lou", "kim")], c.schema)
    assert entity_graph.superlative_collisions(entity_graph.expand_superlatives(x, p, same)).count() == 0


def test_superlatives(spark):
    x = spark.createDataFrame([("d", 1, "age", "kit", "max")], "doc_id string, claim_id int, attribute string, entity string, side string")
    p = spark.createDataFrame([("d", "age", n) for n in ("kit", "lee", "mae", "noa")], "doc_id string, attribute string, entity string")
    c = spark.createDataFrame([("d", "age", "kit", "kit"), ("d", "age", "noa", "kit")], "doc_id string, attribute string, entity string, class string")
    out = entity_graph.expand_superlatives(x, p, c)
    assert {(r.a, r.b) for r in out.collect()} == {("kit", "lee"), ("kit", "mae")}


def test_largest_remainder(spark):
    """Against the definition: whole parts, then one more to the largest fractions."""
    rnd = random.Random(22)
    rows = [(g, k, rnd.randrange(0, 40), 17 + g) for g in range(12) for k in "pqrst"]
    got = {(r.g, r.k): r.parts for r in allocation.largest_remainder(spark.createDataFrame(rows, "g int, k string, w long, total long"), ["g"], "k", "w", "total", 1).collect()}
    for g in range(12):
        mine = [(k, w) for x, k, w, _ in rows if x == g]
        whole, total = sum(w for _, w in mine), 17 + g
        exact = {k: w * total / whole for k, w in mine}
        assert sum(got[g, k] for k, _ in mine) == total
        assert all(got[g, k] in (int(x), int(x) + 1) for k, x in exact.items())
        up, down = ([x - int(x) for k, x in exact.items() if got[g, k] - int(x) == n] for n in (1, 0))
        assert min(up, default=1) >= max(down, default=0) - 1e-9
    none = spark.createDataFrame([(1, "p", 0, 5), (1, "q", 0, 5)], "g int, k string, w long, total long")
    assert {r.parts for r in allocation.largest_remainder(none, ["g"], "k", "w", "total", 1).collect()} == {0}


def test_largest_remainder_sums(spark):
    df = spark.createDataFrame([(t, k, 1, t) for t in range(40) for k in "abc"], "g long, k string, w long, total long")
    out = allocation.largest_remainder(df, ["g"], "k", "w", "total", 1).groupBy("g").agg(F.sum("parts").alias("s"), (F.max("parts") - F.min("parts")).alias("d"))
    assert all(r.s == r.g and r.d <= 1 for r in out.collect())


def test_salted_sum_and_lookup(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), "id", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.lit("x")).alias("z"))
    out = salted_sum(df, ["k", "z"], [F.col("id")], F.floor(F.col("id") / 64), "r", F.col("id")).toPandas()
    for _, g in out.groupby("k"):
        g = g.sort_values("id")
        assert (g["r"].to_numpy() == g["id"].cumsum().to_numpy() - g["id"].to_numpy()).all()
    table = spark.createDataFrame([("a", 1), ("b", 2)], "key string, v int")
    rows = spark.createDataFrame([("a",)] * 50 + [("b",), ("c",), (None,)], "key string")
    counts = rows.groupBy("key").agg(F.count("*").alias("n"))
    got = {r.key: r.v for r in lookup_join(rows, table, "key", counts).collect()}
    assert got == {"a": 1, "b": 2, "c": None, None: None}


def test_asof_and_intervals(spark):
    t = datetime(2026, 1, 1)
    rnd = random.Random(4)
    left = [(i, rnd.choice(["u", "v", None]), t + timedelta(hours=rnd.randrange(200))) for i in range(80)] + [(99, "u", None)]
    right = [(rnd.choice(["u", "v", None]), t + timedelta(hours=rnd.randrange(200)), float(i)) for i in range(40)]
    l_, r_ = spark.createDataFrame(left, "i int, k string, t timestamp"), spark.createDataFrame(right, "k string, t timestamp, v double")
    got = {r.i: r.v for r in sequences.asof_join(l_, r_, ["k"], "t", "v", "v").collect()}
    for i, k, at in left:
        met = [(s, v) for q, s, v in right if q == k and at and s <= at and k]
        assert got[i] == (max(met)[1] if met else None)
    spans = spark.createDataFrame([("u", 1, t, t + timedelta(hours=30)), ("u", 2, t, t - timedelta(hours=1)), (None, 3, t, t)], "k string, s int, a timestamp, b timestamp")
    got = {(r.i, r.s) for r in sequences.interval_join(l_, spans, "k", "t", "a", "b", 7200).collect()}
    assert got == {(i, 1) for i, k, at in left if k == "u" and at and at <= t + timedelta(hours=30)}


def test_scores(spark):
    df = spark.createDataFrame([("m", 0.9, True), ("m", 0.5, True), ("m", 0.5, False), ("m", 0.1, False), ("m", None, True), ("n", 0.3, True)], "g string, s double, t boolean")
    assert {r.g: r.auc for r in evaluation.auc(df, "s", "t", ["g"]).collect()} == {"m": 0.875, "n": None}
    p = evaluation.prf(df.withColumn("p", F.lit(False)), "p", "t", ["g"]).where("g = 'm'").first()
    assert (p["precision"], p["recall"], p["f1"]) == (0.0, 0.0, 0.0)
    assert df.where("g = 'x'").agg(evaluation.rate(F.col("t"))).first()[0] is None
    assert evaluation.auc(df.limit(0), "s", "t", ["g"]).count() == 0


def test_text_functions(spark):
    df = spark.createDataFrame([("Mr. Ann saw  Dr. Bo. He left! ok? Yes",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(X.simple_sentences(F.col("t"))).collect()]
    assert got == [["Mr. Ann saw Dr. Bo.", "He left! ok?", "Yes"], [""], None]
    grams = [r[0] for r in df.select(X.word_grams(X.plain_words(F.col("t")), 3)).collect()]
    assert len(grams[0]) == 7 and grams[1] == [] and grams[2] in ([], None)
    c = spark.createDataFrame([([3, 1, 2],), ([2, 3, 1],), ([1, 3, 2],), ([5],)], "c array<int>")
    assert [r[0] for r in c.select(X.canonical_cycle(F.col("c"))).collect()] == [[1, 2, 3]] * 3 + [[5]]
    k = spark.createDataFrame([("26:05",), ("x",), ("7:30",), (None,)], "c string")
    assert [r[0] for r in k.select(X.clock_minutes(F.col("c"))).collect()] == [1565, None, 450, None]


def test_leak_search(spark):
    run = " ".join(f"w{i}" for i in range(12))
    items = spark.createDataFrame([(1, run), (2, "short one"), (3, None)], "item_id int, text string")
    docs = spark.createDataFrame([(1, "so " + run.upper() + "!"), (2, " ".join(run.split()[:8])), (3, None), (4, "")], "doc_id int, text string")
    assert [tuple(r) for r in leak.search(docs, "doc_id", items, "item_id").collect()] == [(1, 1, 5)]


def test_facts(spark):
    f = spark.createDataFrame([
        ("d", 1, "ana", "hat", "red", False, None), ("d", 2, "ana", "hat", "red", True, [1]), ("d", 3, "ben", "hat", "red", False, [9]),
        ("d", 4, "cy", "hat", None, False, []),
    ], "doc_id string, fact_id int, subject string, attribute string, value string, negated boolean, depends array<int>")
    assert {r.fact_id for r in facts.ready(f).collect()} == {1, 2, 4}
    assert [tuple(r) for r in facts.value_conflicts(f).collect()] == [("d", "ana", "hat", 1, 1)]
    different = spark.createDataFrame([("d", "hat", "ana", "ben"), ("d", "hat", "ana", "cy")], "doc_id string, attribute string, a string, b string")
    assert [r.b for r in facts.equal_but_different(f, different).collect()] == ["ben"]


def test_graph_measures(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(3, 3), (None, 1), (1, 0)], "u long, v long")
    e = metrics.canonical_edges(path)
    assert e.count() == 9
    s = spark.createDataFrame([(4,), (77,)], "source long")
    masses = {(r.source, r.hops): r.mass for r in metrics.ball_masses(e, s, 20).collect()}
    assert masses[(4, 0)] == 1 and masses[(4, 2)] == 5 and masses[(4, 5)] == 10 and masses[(77, 0)] == 1
    assert metrics.double_sweep(e, s.where("source = 4")).first()["diameter"] == 9
    k4 = spark.createDataFrame([("g", u, v, 1) for u in range(4) for v in range(u)], "graph string, u int, v int, weight int")
    assert metrics.best_cuts(k4).first()["cut"] == 4.0


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "x"), (2, None, "y")], "i int, t string, split string")
    files.write_json_lines(df, f"{tmp_path}/j")
    (tmp_path / "j" / "z.json").write_text('\n   \n{"i": 3, "t": "c", "split": "x"}\n')
    assert {r.i for r in files.read_json_lines(spark, f"{tmp_path}/j", df.schema).collect()} == {1, 2, 3}
    files.write_export(df, f"{tmp_path}/e")
    with pytest.raises(Exception):
        files.write_export(df, f"{tmp_path}/e")
    (tmp_path / "t" / "u").mkdir(parents=True)
    (tmp_path / "t" / "u" / "a.txt").write_bytes("é".encode())
    (tmp_path / "t" / "b.bin").write_bytes(b"\xff\xfe\xfa")
    assert [r.text for r in files.text_tree(spark, f"{tmp_path}/t").collect()] == ["é"]
    key = F.lit("0123456789abcdef")
    assert [r[0] for r in df.select(files.unsealed(files.sealed(F.col("t"), key), key)).collect()] == ["a", None]
    rec = spark.createDataFrame([("p", 1)], "tag string, v int")
    with pytest.raises(Exception):
        files.replay(spark.createDataFrame([("q",)], "tag string"), rec, "tag").collect()
    sent, open_ = files.split_cached(spark.createDataFrame([("p",), ("q",)], "tag string"), rec, "tag")
    assert sent.count() == 1 and open_.first().tag == "q"


def test_streams(spark, sf):
    from plumbline.streaming import jobs

    out = jobs.run_to_end(jobs.drift_alarms(jobs.event_stream(spark, sf)), ["key"]).toPandas()
    batch = spark.read.parquet(f"{sf}/events.parquet").groupBy("event_type").count().toPandas()
    assert dict(zip(out["key"], out["seen"])) == dict(zip(batch["event_type"], batch["count"]))
    assert (out["alarms"] > 0).any() and np.isfinite(out["mean"]).all()
