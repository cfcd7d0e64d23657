"""Derived relations, minimal cores, colourings, streams and leaks on small cases, against brute force where there is one."""

import itertools
import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators import cores, leak, signed_graph, statements
from plumbline.streaming import jobs

ST = "doc_id string, seq int, claim_id int, statement string, attribute string, comparative string, subject string, object string, restriction string, confidence double"
KI = "doc_id string, attribute string, seq int, order_kind string"
SE = "doc_id string, attribute string, comparative string, seq int, greater_side string"
CL = "doc_id string, claim_id int, kind string"


def test_derivation(spark):
    rows = [
        ("d", 1, 0, "order", "Age", "older than", "Kim", "Lou", None, 1.0),
        ("d", 2, 1, "order", "age", "The Younger", "kim", "moe", None, 1.0),
        ("d", 3, 2, "order", "mood", "calmer", "kim", "lou", None, 1.0),
        ("d", 4, 2, "order", "mood", "odder", "kim", "lou", None, 1.0),
        ("d", 5, 3, "extreme", "age", "oldest", "Lou", None, None, 1.0),
        ("d", 6, 3, "extreme", "age", "oldest", "kim", None, "  ", 1.0),
        ("d", 7, 3, "extreme", "age", "oldest", "moe", None, "of the two", 1.0),
        ("d", 8, 99, "order", "age", "older", "x", "y", None, 1.0),
        ("d", 9, 4, "same", "age", None, "moe", "ned", None, 1.0),
        (None, 10, 0, "order", "age", "older", "x", "y", None, 1.0),
    ]
    kinds = [("d", "Age", 1, None), ("d", "older", 2, "magnitude"), ("d", "age", 3, "sequence"), ("d", "mood", 1, "other")]
    senses = [("d", "age", "older", 1, "object"), ("d", "mood", "calmer than", 1, "object"), ("d", "mood", "calmer", 2, "subject")]
    known = [("d", i, "asserted") for i in range(5)]
    d = statements.Derivation(spark.createDataFrame(rows, ST), spark.createDataFrame(kinds, KI), spark.createDataFrame(senses, SE), spark.createDataFrame(known, CL))
    got = {tuple(r) for r in d.relations().collect()}
    assert got == {
        ("d", 0, "age", "greater", "kim", "lou", False), ("d", 1, "age", "greater", "moe", "kim", False), ("d", 2, "mood", "greater", "lou", "kim", False),
        ("d", 3, "age", "greater", "lou", "kim", True), ("d", 3, "age", "greater", "lou", "moe", True),
        ("d", 3, "age", "greater", "kim", "lou", True), ("d", 3, "age", "greater", "kim", "moe", True), ("d", 4, "age", "same", "moe", "ned", False),
    }
    assert [(r.claim_id, r.model, r.lexical) for r in d.overrides().collect()] == [(0, "object", "subject")]
    assert [(r.comparative, r.sense) for r in d.unresolved().collect()] == [("odder", None)]
    assert [r.entity for r in d.restricted().collect()] == ["moe"]
    none = statements.Derivation(*[spark.createDataFrame([], s) for s in (ST, KI, SE, CL)])
    assert none.relations().count() == 0


def test_texts(spark):
    df = spark.createDataFrame([("The  Older than",), ("“ＦＵＬＬ” Straße…",), ("",), (None,), ("first of all, OLDER than most",)], "t string")
    rows = df.select(statements.comparative_key(F.col("t")).alias("k"), X.folded_words(F.col("t")).alias("w"), X.review_form(F.col("t")).alias("r"), statements.lexicon_words(F.col("t")).alias("l")).collect()
    assert [r.k for r in rows] == ["older", "“ｆｕｌｌ” straße…", "", None, "first of all, older than most"]
    assert [r.w for r in rows] == [["the", "older", "than"], ["full", "strasse"], [], [], ["first", "of", "all", "older", "than", "most"]]
    assert rows[1].r == "full strasse..." and rows[4].l == ["first", "older", "most"]


def colours(n, apart, named, most):
    palette = sorted(set(named.values())) + [f"new{i}" for i in range(most)]
    for take in itertools.product(palette, repeat=n):
        if all(take[a] != take[b] for a, b in apart) and all(take[c] == v for c, v in named.items()) and len(set(take) | set(named.values())) <= most:
            return True
    return False


def test_values_fit():
    rnd = random.Random(31)
    for _ in range(300):
        n, most = rnd.randrange(1, 6), rnd.randrange(1, 4)
        apart = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(rnd.randrange(7))]
        apart = [(a, b) for a, b in apart if a != b]
        named = {c: rnd.choice("pq") for c in range(n) if rnd.random() < 0.2}
        assert cores.fits(n, apart, named, most) == colours(n, apart, named, most), (n, apart, named, most)
    assert not cores.fits(2, [(1, 1)], {}, 3)


def clash(rows, binary):
    names = sorted({x for _, a, b in rows for x in (a, b)})
    ranks = range(len(names))
    for rank in itertools.product(ranks, repeat=len(names)):
        r = dict(zip(names, rank))
        if all(r[a] == r[b] if k == "same" else r[a] > r[b] if k == "greater" else True for k, a, b in rows):
            break
    else:
        return True
    root = {x: x for x in names}
    for _ in names:
        for k, a, b in rows:
            if k == "same":
                root[a] = root[b] = min(root[a], root[b])
    apart = [(root[a], root[b]) for k, a, b in rows if k == "different"]
    if any(a == b for a, b in apart):
        return True
    return binary and not any(all((m >> names.index(a) ^ m >> names.index(b)) & 1 for a, b in apart) for m in range(1 << len(names)))


def test_minimal_cores(spark):
    rnd = random.Random(32)
    docs = {f"c{k}": [(rnd.choice(["same", "different", "greater"]), rnd.choice("wxyz"), rnd.choice("wxyz")) for _ in range(rnd.randrange(1, 7))] for k in range(30)}
    rows = [(d, "size", i, *r) for d, x in docs.items() for i, r in enumerate(x)] + [("n", "size", 1, "greater", None, "x")]
    arity = spark.createDataFrame([(d, "size", "binary" if int(d[1:]) % 2 else "multi") for d in docs], "doc_id string, attribute string, arity string")
    df = spark.createDataFrame(rows, "doc_id string, attribute string, rel_id int, kind string, a string, b string")
    got = {}
    for r in cores.minimal_cores(df, arity).collect():
        got.setdefault(r.doc_id, []).append(r.rel_id)
    for d, x in docs.items():
        binary = int(d[1:]) % 2 == 1
        assert (d in got) == clash(x, binary), x
        core = [x[i] for i in got.get(d, [])]
        assert not core or clash(core, binary) and not any(clash(core[:i] + core[i + 1 :], binary) for i in range(len(core)))


def test_identity(spark):
    facts = spark.createDataFrame([("d", s, i) for i, s in enumerate("abcd")], "doc_id string, subject string, n int")
    same = spark.createDataFrame([("d", "conflate", "a", "b"), ("d", "conflate", "b", "c"), ("d", "distinct", "a", "c"), ("e", "distinct", "a", "b")], "doc_id string, kind string, a string, b string")
    out, bad = cores.one_identity(facts, same)
    assert {(r.n, r.subject) for r in out.collect()} == {(0, "a"), (1, "a"), (2, "a"), (3, "d")} and [r[0] for r in bad.collect()] == ["d"]


@pytest.mark.parametrize("files", [1, 3])
def test_sliding_turns_over_batches(spark, tmp_path, files):
    rnd, t = random.Random(33), datetime(2026, 1, 1)
    rows = [(rnd.choice("uv"), t + timedelta(minutes=i), i, rnd.uniform(-9, 9)) for i in range(60)]
    schema = "user_id string, ts timestamp_ntz, event_id long, phase double"
    for k in range(files):
        part = rows[k * 60 // files : (k + 1) * 60 // files]
        rnd.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(f"{tmp_path}/e")
    got = {r.event_id: r.turn for r in jobs.sliding_turns(stream, width=4).collect()}
    want, steps, last = {}, {"u": [], "v": []}, {}
    for user, _, i, x in rows:
        if user in last:
            d = x - last[user]
            q = d / (2 * math.pi)
            steps[user].append(d - 2 * math.pi * (math.floor(abs(q) + 0.5) * (1 if q > 0 else -1)))
        last[user] = x
        want[i] = sum(steps[user][-4:]) if len(steps[user]) >= 4 else None
    assert got.keys() == want.keys()
    assert all(got[i] is None if w is None else got[i] == pytest.approx(w) for i, w in want.items())


def test_sealed_blocks_show_changes(spark, tmp_path):
    def log(name, parts):
        for p in parts:
            spark.createDataFrame([(i, "x" if i != 5 else name) for i in p], "seq long, c string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        s = spark.readStream.schema("seq long, c string").option("maxFilesPerTrigger", "1").parquet(f"{tmp_path}/{name}")
        return [(r["rows"], r.seal) for r in jobs.sealed_blocks(s, ["seq", "c"]).orderBy("block").collect()]

    one, two = log("p", [range(4), range(4, 8), range(8, 9)]), log("q", [range(4), range(4, 8), range(8, 9)])
    assert [n for n, _ in one] == [4, 4, 1] and one[0] == two[0] and one[1] != two[1] and one[2] != two[2]


def test_late_events_are_dropped(spark, tmp_path):
    t = datetime(2026, 1, 10)
    for part in ([(t, 1)], [(t + timedelta(hours=1), 2)], [(t - timedelta(days=5), 3), (t, 4)]):
        spark.createDataFrame([(at, i, "k", 1.0) for at, i in part], "ts timestamp_ntz, event_id long, event_type string, value double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema("ts timestamp_ntz, event_id long, event_type string, value double").option("maxFilesPerTrigger", "1").parquet(f"{tmp_path}/e")
    got = {(r.day_start, r.n) for r in jobs.run_to_end(jobs.window_counts(stream), ["day_start", "event_type"]).collect()}
    assert got == {(t, 3)}


def test_leaks_by_set_and_whole_text(spark):
    lead = "please read all of this text now and mark it "
    items = spark.createDataFrame([(k, lead + " ".join(f"w{k}x{j}" for j in range(12))) for k in range(6)] + [(9, "two words"), (10, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, lead + "nothing else"), (2, " ".join(f"w3x{j}" for j in range(10))), (3, "Two, WORDS!"), (4, "has MARK-1 in it"), (5, None)], "doc_id long, text string")
    assert {tuple(r) for r in leak.search(docs, "doc_id", items, "item_id").collect()} == {(1, k, 3) for k in range(6)} | {(2, 3, 3)}
    marks = spark.createDataFrame([("MARK-1",), (None,)], "mark string")
    assert {tuple(r) for r in leak.exact_leaks(docs, "doc_id", items, "item_id", marks).collect()} == {(3, "9", "text"), (4, "MARK-1", "mark")}


def test_ranking_of_empty_graph(spark):
    e = spark.createDataFrame([], "doc_id string, a int, b int, sign int, weight double")
    assert signed_graph.unbalanced_claims(e).count() == 0 and signed_graph.frustrated_cycle_lengths(e).count() == 0
