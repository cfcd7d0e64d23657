"""Edge cases of every training-data operator, and small cases with known answers."""

import random
import time
from datetime import datetime
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import consensus, leakage, overlap, packing, pairs, quota, related, sentences
from plumbline.llm.automaton import SuffixAutomaton
from plumbline.session import shared_dir

T0 = datetime(2026, 1, 1)
LLM = "reply_id long, request string, output string, stop_reason string, schema_name string, model string, created_at timestamp, n long, ctx string, verdict string"
REC = "record_id long, doc_id string, base_id string, derived_from string, text string, split string, plant_type string, variant string, provider string, difficulty_level int, exported_at timestamp, node long, group_id long, side string, x string"
DEC = "doc_id string, reviewer string, seq long, kind string, decision string, r string, v int, item string"
CAN = "reviewer string, batch_id string, defects int, caught int, clean int, false_alarms int, n int"
UNI = "unit_id long, run string, plant_type string, level int, provider string, genre string, cell string, n long"
TAR = "run string, sample_size long, dimension string, category string, share_pct double, min_count int, cat string, available long"
DOC = "doc_id long, text string, form string, item_id long, unit int, tokens long, start_char int"
ITE = "item_id long, suite string, text string, share double, doc_id long"


def row(schema, **kw):
    return tuple(kw.get(c.split()[0]) for c in schema.split(", "))


def frame(spark, schema, rows):
    return spark.createDataFrame([row(schema, **r) for r in rows], schema)


def got(df):
    return {tuple(r) for r in df.collect()}


# problem 1
def reply(i, rationale, request="Claim 1: Ana left the mill at noon. Claim 2: Ben never saw the mill. Do they agree? Say why.", **kw):
    import json

    out = json.dumps({"a": 1, "b": 2, "rationale": rationale, "relation": "supports", "confidence": 0.5})
    return dict(reply_id=i, request=request, output=out, schema_name="RelationV22", stop_reason="end_turn", created_at=T0) | kw


def test_defects(spark):
    good = [
        reply(100 + i, f"{a} has nothing to do with {b}, so both may well be true.")
        for i, (a, b) in enumerate([("Ana", "Ben"), ("Cy", "Dee"), ("Eve", "Fay"), ("Gus", "Hal"), ("Ida", "Jo"), ("Kim", "Lou")])
    ]
    rows = good + [
        reply(1, "I'm sorry, but I cannot assist with that request."),
        reply(2, ""), reply(3, "n/a"), reply(4, None), reply(5, "​"),
        reply(6, "Ana has nothing to do with"), reply(7, 'Ana says "the mill was'), reply(8, "Both may well be"),
        reply(9, "ana left the mill at noon ben never saw the mill"),
        reply(10, "Die Aussagen sind nicht dasselbe, und beide können wahr sein, weil es um den Abend geht."),
        reply(11, "Ana has nothing to do with Ben, so both may well be true"),
        reply(12, '"Ana left the mill at noon." is what claim 1 says. Ben has nothing to do with Cy, so both may well be true.'),
        reply(13, "fine and true.", stop_reason="REFUSAL"), reply(14, None, output=None),
        reply(15, "", schema_name="Other"), dict(reply_id=None), dict(reply_id=16),
        reply(17, "Although Ana refused to answer the clerk, claim 2 has nothing to do with that, so both may well be true."),
    ]
    df = frame(spark, LLM, rows)
    want = {(1, "refusal"), (13, "refusal"), (9, "copy"), (10, "language")} | {(i, "empty") for i in (2, 3, 4, 5, 14)}
    want |= {(i, "truncated") for i in (6, 7, 8)}
    assert got(pairs.defects(df)) == want
    assert got(pairs.defects(df.union(df))) == want  # delivered twice


def test_defects_empty(spark):
    assert got(pairs.defects(frame(spark, LLM, []))) == set()


def test_automaton():
    rnd = random.Random(1)
    for _ in range(50):
        a = [rnd.randrange(4) for _ in range(rnd.randrange(12))]
        b = [rnd.randrange(4) for _ in range(10)]
        sub = {tuple(a[i:j]) for i in range(len(a)) for j in range(i, len(a) + 1)}
        want = [max(k for k in range(i + 2) if tuple(b[i + 1 - k : i + 1]) in sub | {()}) for i in range(len(b))]
        assert SuffixAutomaton(a).match_lengths(b) == want


# problem 2
def vote_rows(seed, n_docs, skill):
    rnd = random.Random(seed)
    rows, truth, seq = [], {}, 0
    for i in range(n_docs):
        t = truth[f"d{i}"] = rnd.choice(consensus.LABELS)
        for who, p in rnd.sample(sorted(skill.items()), 5):
            seq += 1
            vote = t if rnd.random() < p else rnd.choice([x for x in consensus.LABELS if x != t])
            rows.append(dict(doc_id=f"d{i}", reviewer=who, seq=seq, kind="decision", decision=vote))
    return rows, truth


SKILL = {"ann": 0.95, "bob": 0.93, "cat": 0.9, "dan": 0.4, "eli": 0.35, "fay": 0.34, "gil": 0.33}


def test_consensus_beats_majority(spark):
    rows, truth = vote_rows(3, 500, SKILL)
    can = [dict(reviewer=w, batch_id="b", defects=50, caught=round(50 * p), clean=20, false_alarms=round(20 * (1 - p))) for w, p in SKILL.items()]
    args = frame(spark, DEC, rows), frame(spark, CAN, can), frame(spark, REC, [])
    model = consensus.fit(*args)
    out = {r.doc_id: r.decision for r in model.posteriors().collect()}
    count = {}
    for r in rows:
        count.setdefault(r["doc_id"], []).append(r["decision"])
    most = {d: max(sorted(set(v)), key=v.count) for d, v in count.items()}
    share = lambda x: np.mean([x[d] == t for d, t in truth.items()])
    assert share(out) > 0.9 and share(out) > share(most) + 0.03
    joined = {r.doc_id: r.decision for r in consensus.fit(*args, held=1).posteriors().collect()}
    assert np.mean([joined[d] == out[d] for d in truth]) > 0.99


def test_votes(spark):
    rows = [
        dict(doc_id="d", reviewer=" Ann_B ", seq=1, kind="decision", decision="accept"),
        dict(doc_id="d", reviewer="ann-b", seq=3, kind="decision", decision=" DISCARD "),
        dict(doc_id="d", reviewer="ann-b", seq=4, kind="decision", decision="maybe"),
        dict(doc_id="d", reviewer="ann-b", seq=5, kind="quota_seed", decision="accept"),
        dict(doc_id=None, reviewer="x", seq=6, kind="decision", decision="accept"),
        dict(doc_id="d", reviewer=None, seq=7, kind="decision", decision="accept"),
        dict(doc_id="d", reviewer="  ", seq=8, kind="decision", decision="accept"), {},
    ]
    assert got(consensus.last_votes(frame(spark, DEC, rows))) == {("d", "ann b", 1)}


def test_consensus_empty(spark):
    m = consensus.fit(frame(spark, DEC, []), frame(spark, CAN, []), frame(spark, REC, []))
    assert m.posteriors().count() == 0


# problem 3
def rec(i, base=None, doc=None, made=None, **kw):
    return dict(record_id=i, base_id=base, doc_id=doc or f"x{i}", derived_from=made, exported_at=T0, plant_type=f"p{i % 3}") | kw


def test_groups(spark):
    rows = [
        rec(1, "bp-00000158"), rec(2, " BP_158\t"), rec(3, "bp-158b"), rec(4, "bp–00000158-B"), rec(5, "unknown"),
        rec(6, None), rec(7, "-"), rec(8, None, made="x6"), rec(9, "qa-1", made="x3"), rec(10, "qa-2", made="nowhere"),
        rec(11, "bp-1580"), dict(record_id=None), rec(2, " BP_158\t"), rec(12, None, made="x12"),
    ]
    r = related.latest_records(frame(spark, REC, rows))
    want = {(1, 1, 2), (2, 1, 2), (3, 3, 3), (4, 3, 3), (9, 3, 3), (6, 6, 2), (8, 6, 2), (5, 5, 1), (7, 7, 1), (10, 10, 1), (11, 11, 1), (12, 12, 1)}
    assert got(related.group_records(r)) == want


def test_hot_base_and_long_chain(spark):
    rows = [rec(i, "sc-7") for i in range(1, 60)] + [rec(100 + i, None, made=f"x{99 + i}" if i else None) for i in range(30)]
    out = {r.record_id: r.group_id for r in related.group_records(related.latest_records(frame(spark, REC, rows))).collect()}
    assert {out[i] for i in range(1, 60)} == {1} and {out[i] for i in range(100, 130)} == {100}


def test_splits(spark):
    rnd = random.Random(2)
    rows = [rec(i, f"bp-{rnd.randrange(120)}", variant=rnd.choice(["a", "b", None])) for i in range(400)]
    plan = spark.createDataFrame([("development", 50.0, None), ("calibration", 15.0, None), ("test", 35.0, None)], "split string, share_pct double, note string")
    df = frame(spark, REC, rows)
    out = related.stratified_splits(df, plan, ["plant_type", "variant"]).toPandas()
    assert len(out) == 400 and out.groupby("group_id")["split"].nunique().max() == 1
    share = out["split"].value_counts(normalize=True)
    assert abs(share["development"] - 0.5) < 0.05 and abs(share["test"] - 0.35) < 0.05
    assert related.stratified_splits(frame(spark, REC, []), plan, ["plant_type"]).count() == 0
    shares = related.split_shares(df, spark.createDataFrame(out), plan, ["plant_type", "variant"]).toPandas()
    whole = shares[shares["label"] == "all"].set_index("split")
    assert whole["records"].sum() == 400 and whole["planned_pct"].to_dict() == {"development": 50, "calibration": 15, "test": 35}
    assert whole["records"].to_dict() == out["split"].value_counts().to_dict()
    assert (shares.groupby("label")["share_pct"].sum() - 100).abs().max() < 1e-9 and (shares.groupby("label").size() == 3).all()


# problem 4
def test_deficits_and_draw(spark):
    rnd = random.Random(4)
    rows = [dict(unit_id=i, run=rnd.choice(["Run A", "run_a", " run-a "]), provider=rnd.choice(["oak", "OAK ", "elm", "elm", "elm", None]), level=rnd.randrange(1, 4)) for i in range(300)]
    rows += [dict(rows[0], provider="Oak"), {}, dict(unit_id=None, run="run a")]
    tar = [
        dict(run="run a", sample_size=60, dimension="provider", category="oak", share_pct=50.0, min_count=0),
        dict(run="run a", sample_size=60, dimension="provider", category="elm", share_pct=50.0, min_count=0),
        dict(run="run a", sample_size=60, dimension="provider", category="yew", share_pct=0.0, min_count=2),
        dict(run="run b", sample_size=10, dimension="provider", category="oak", share_pct=100.0, min_count=0),
        dict(run="run b", sample_size=10, dimension="provider", category="fir", share_pct=0.0, min_count=0),
        dict(run="run a", sample_size=60, dimension="level", category="1", share_pct=60.0, min_count=0),
        dict(run="run a", sample_size=60, dimension="level", category="2", share_pct=40.0, min_count=0),
    ]
    u, t = frame(spark, UNI, rows), frame(spark, TAR, tar)
    short = {(r.run, r.dimension, r.category) for r in quota.deficits(u, t, ["provider", "level"]).collect()}
    assert short == {("run a", "provider", "yew"), ("run b", "provider", "oak")}
    s = quota.draw(u, t, ["provider", "level"])
    names = quota.clean_units(u, ["provider", "level"]).join(s, ["run", "unit_id"]).toPandas()
    assert len(names) == 60 and names["unit_id"].is_unique
    assert abs((names["provider"] == "oak").sum() - 30) <= 1 and abs((names["level"] == "1").sum() - 36) <= 1
    assert got(s) == got(quota.draw(u, t, ["provider", "level"]))
    assert quota.draw(frame(spark, UNI, []), t, ["provider"]).count() == 0
    assert quota.draw(u, frame(spark, TAR, []), ["provider"]).count() == 0
    assert quota.deficits(u, frame(spark, TAR, []), ["provider"]).count() == 0


def test_deficits_follow_the_draw(spark):
    """Accepted units first, rejected ones only where a combination lacks some; deficits are read off that sample."""
    rnd = random.Random(9)
    rows = [dict(unit_id=i, run="r", provider=rnd.choice("aaab"), level=rnd.randrange(1, 9)) for i in range(300)]
    tar = [dict(run="r", sample_size=80, dimension=d, category=c, share_pct=s, min_count=0)
           for d, c, s in (("provider", "a", 60.0), ("provider", "b", 40.0), ("provider", "c", 5.0), *(("level", str(k), 12.5) for k in range(1, 9)))]
    u, t = frame(spark, UNI, rows), frame(spark, TAR, tar)
    filled = [r.accepted for r in quota.draw(u, t, ["provider", "level"], 8).collect()]
    assert set(filled) == {True, False} and len(filled) == 80
    sample = {r.unit_id for r in quota.draw(u, t, ["provider", "level"]).collect()}
    assert len(sample) == 80
    drawn = {c: sum(r["provider"] == c for r in rows if r["unit_id"] in sample) for c in "abc"}
    have = {c: sum(r["provider"] == c for r in rows) for c in "abc"}
    got_ = {r.category: (r.drawn, r.spare, r.available) for r in quota.deficits(u, t, ["provider", "level"]).collect()}
    short = {c for c, s in (("a", 60), ("b", 40), ("c", 5)) if have[c] < 80 * s / 100}
    assert got_ == {c: (drawn[c], have[c] - drawn[c], have[c]) for c in short} and "c" in got_


def test_least_shortfall_is_a_bound():
    """Against the best of all samples of small tables."""
    import itertools

    import pandas as pd

    rnd = random.Random(14)
    for _ in range(12):
        cells = pd.DataFrame([(a, b, rnd.randrange(0, 4)) for a in "xy" for b in "uvw"], columns=["a", "b", "n"])
        size = rnd.randrange(2, 7)
        goals = pd.DataFrame(
            [("a", c, size, rnd.choice([30.0, 50.0, 70.0]), rnd.randrange(0, 3)) for c in "xy"] + [("b", c, size, rnd.choice([20.0, 40.0, 60.0]), 1) for c in "uvw"],
            columns=["dimension", "cat", "sample_size", "share_pct", "min_count"],
        )
        want = np.floor(np.maximum(goals["sample_size"] * goals["share_pct"] / 100, goals["min_count"]) + 1e-9)
        least = min(
            sum(max(0, w - sum(k for k, x in zip(take, cells[d]) if x == c)) for d, c, w in zip(goals["dimension"], goals["cat"], want))
            for take in itertools.product(*[range(n + 1) for n in cells["n"]]) if sum(take) <= size
        )
        got_ = quota.least_shortfall(cells, goals, ["a", "b"])
        assert got_ <= least + 1e-6 and got_ >= least - 1.5


# problem 5
def plain_distance(a, b):
    row_ = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row_[0] = row_[0], i
        for j, y in enumerate(b, 1):
            prev, row_[j] = row_[j], min(row_[j] + 1, row_[j - 1] + 1, prev + (x != y))
    return row_[-1]


def test_edit_distance():
    rnd = random.Random(6)
    for _ in range(300):
        a, b = ([rnd.randrange(4) for _ in range(rnd.randrange(14))] for _ in range(2))
        d = plain_distance(a, b)
        assert overlap.edit_distance(a, b, 20) == d
        assert overlap.edit_distance(a, b, 3) == min(d, 4)


def test_overlap_is_exact(spark):
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(30)]
    rows = []
    for k in range(60):
        base = [rnd.choice(words) for _ in range(rnd.choice([1, 4, 5, 6, 9, 12, 15, 20, 40]))]
        for _ in range(4):
            t = list(base)
            for _ in range(rnd.randrange(0, max(2, len(t) // 3))):
                j = rnd.randrange(len(t) + 1)
                how = rnd.randrange(3)
                t[j : j + (how > 0)] = [rnd.choice(words)] if how < 2 else []
            text = " ".join(t)
            if rnd.random() < 0.3:
                text = text.upper().replace(" ", ",  ") + "!"
            elif rnd.random() < 0.3:  # blanks that are no ASCII ones
                text = "".join(rnd.choice("\u00a0\u2009\u3000\n ") if c == " " else c for c in text)
            rows.append(rec(len(rows), text=text, split=rnd.choice(["development", "Test ", "judged", "calibration", "other", None])))
    rows += [rec(900, text=None, split="test"), rec(901, text="", split="development"), rec(902, text="?!", split="test"), rec(903, text="—", split="development"), dict(record_id=None)]
    rows.append(dict(rows[0]))
    out = got(overlap.cross_split_pairs(frame(spark, REC, rows)))
    clean = {r["record_id"]: (overlap_words(r["text"]), (r.get("split") or "").strip().lower()) for r in rows if r["record_id"] is not None}
    want = set()
    for i, (a, s) in clean.items():
        for j, (b, t) in clean.items():
            if i != j and a and b and s == "development" and t in ("test", "judged", "calibration"):
                if plain_distance(a, b) <= max(len(a), len(b)) // 5:
                    want.add((min(i, j), max(i, j)))
    assert out == want and len(want) > 20
    assert overlap.cross_split_pairs(frame(spark, REC, [])).count() == 0


def test_overlap_boilerplate(spark):
    """Texts that share three fifths of their words are not even compared."""
    lead = " ".join(f"c{i}" for i in range(60))
    rows = [rec(i, text=lead + " " + " ".join(f"p{i}x{j}" for j in range(40)), split="development" if i % 2 else "test") for i in range(200)]
    texts, _ = overlap.distinct_texts(frame(spark, REC, rows))
    assert overlap.candidates(texts).count() == 0
    rows[7]["text"] = rows[4]["text"].replace("p4x9", "other")
    assert got(overlap.cross_split_pairs(frame(spark, REC, rows))) == {(4, 7)}


@pytest.mark.parametrize("block", [1, 40])
def test_coverage_over_many_ranges(spark, monkeypatch, block):
    """Runs of equal heads that many ranges share: coverage against plain sets of spans."""
    rnd = random.Random(12)
    rows = [
        rec(i, text=" ".join(rnd.choice("abcd") for _ in range(rnd.choice([1, 2, 3, 9]))), split=rnd.choice(["development", "test"]))
        for i in range(40)
    ]
    monkeypatch.setattr(overlap, "BLOCK", block)
    spans = {"development": set(), "test": set()}
    for r in rows:
        w = r["text"].split()
        spans[r["split"]] |= {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    want = set()
    for r in rows:
        w, facing = r["text"].split(), "test" if r["split"] == "development" else "development"
        there = {j for i in range(len(w) - 2) if tuple(w[i : i + 3]) in spans[facing] for j in (i, i + 1, i + 2)}
        same = any(x["text"] == r["text"] and x["split"] == facing for x in rows)
        want.add((r["record_id"], len(w), len(w) if same else len(there)))
    assert got(overlap.span_coverage(frame(spark, REC, rows))) == want
    assert overlap.span_coverage(frame(spark, REC, [])).count() == 0


def test_overlap_in_turns(spark, monkeypatch):
    """Suffixes, spans and texts that take turns give what they give at once."""
    rnd = random.Random(3)
    rows = []
    for k in range(25):
        base = [rnd.choice("abcdefghij") for _ in range(rnd.choice([2, 5, 9, 30]))]
        for split in ("development", "test", "test"):
            t = list(base)
            t[rnd.randrange(len(t))] = rnd.choice("abcxyz")
            rows.append(rec(len(rows), text=" ".join(t), split=split))
    records = frame(spark, REC, rows)
    once = got(overlap.cross_split_pairs(records)), got(overlap.span_coverage(records))
    monkeypatch.setattr(overlap, "FEW", 40)
    assert overlap.Compared(overlap.distinct_texts(records)[0]).turns == overlap.PASSES
    assert (got(overlap.cross_split_pairs(records)), got(overlap.span_coverage(records))) == once and len(once[0]) > 10


def test_overlap_frees_its_disk(spark):
    """Shuffle files are gone once a step is staged, and of what is staged only the texts and the pairs remain."""
    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    shuffled = lambda: {p for f in folders for p in Path(f).rglob("shuffle_*.data")}
    rows = [rec(i, text=" ".join(f"w{(i // 2 + j) % 37}" for j in range(20)), split="development" if i % 2 else "test") for i in range(40)]
    records = frame(spark, REC, rows)
    shared = Path(shared_dir(spark).removeprefix("file://"), "plumbline")
    staged = lambda: {p.parent for p in shared.rglob("*.parquet")}
    files, held = shuffled(), staged() if shared.exists() else set()
    texts, members = overlap.distinct_texts(records)
    pairs = overlap.candidates(texts)
    kept = {Path(x._staged_at.removeprefix("file://")) for x in (texts, members, pairs)}
    assert not pairs.isEmpty() and kept < staged() and len(staged() - held) <= 5  # besides these the texts' sides
    for _ in range(100):  # they go in the background
        left = sum(p.stat().st_size for p in shuffled() - files if p.exists())
        if left < 5_000:
            break
        time.sleep(0.1)
    assert left < 5_000


def test_overlap_packs_its_suffixes():
    """Suffixes go to their ranges packed, not a row each; none is lost, and equal heads fall into several ranges."""
    texts = [[5, 6, 7]] * 40 + [[i, i + 1] for i in range(9)]
    starts = [sum(map(len, texts[:i])) for i in range(len(texts))]
    batch = pa.RecordBatch.from_arrays([pa.array(starts), pa.array([1 + i % 2 for i in range(len(texts))]), pa.array(texts, pa.list_(pa.int64()))], ["start", "side", "words"])
    rows = [r for b in overlap._sampled(1 << 12, 1, 1)(iter([batch])) for r in b.to_pylist()]
    keys = sorted((r["k0"], r["k1"], r["tie"]) for r in rows)
    bounds = tuple(np.array(x) for x in zip(*keys[10::10]))
    packs = [r for b in overlap._suffixes(1 << 12, 0, 1, bounds)(iter([batch])) for r in b.to_pylist()]
    assert len(packs) == len(bounds[0]) + 1 < len(rows) == sum(map(len, texts))
    got = [overlap._numbers(r["pack"], 3) for r in packs]
    assert sorted(x >> 2 for g in got for x in g[0].tolist()) == list(range(len(rows)))
    ends = [((g[1][0], g[2][0]), (g[1][-1], g[2][-1])) for g in got]
    assert ends == sorted(ends) and sum(a == b for a, b in ends) > 5


def overlap_words(text):
    return [w for w in "".join(c if c.isalnum() or c.isspace() else "" for c in (text or "").lower()).split() if w]


# problem 6
@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_everything(seed):
    rnd = random.Random(seed)
    cap = rnd.choice([16, 100, 512])
    hist = {}
    for _ in range(rnd.choice([1, 30, 800])):
        x = rnd.randrange(1, cap + 1)
        hist[x] = hist.get(x, 0) + 1
    plan = packing.plan_containers(hist, cap)
    used = {}
    for n, c in plan:
        assert n > 0 and sum(x * k for x, k in c.items()) <= cap
        for x, k in c.items():
            used[x] = used.get(x, 0) + n * k
    assert used == hist


def test_pack(spark):
    rnd = random.Random(8)
    sizes = [(i, rnd.choice([7, 7, 7, rnd.randrange(1, 60)])) for i in range(500)] + [(900, 1000), (901, 64), (902, 0), (903, 128)]
    s = spark.createDataFrame(sizes, "doc_id long, tokens long")
    caps = spark.createDataFrame([(1, 64, None), (2, 256, "x"), (3, None, "x"), (4, 0, None), (1, 64, None)], "capacity_id int, capacity_tokens int, tokens string")
    p = packing.pack(s, caps).toPandas()
    for i, cap in ((1, 64), (2, 256)):
        g = p[p["capacity_id"] == i].sort_values(["container_id", "position"])
        assert g.groupby("container_id")["tokens"].sum().max() <= cap
        assert (g.groupby("container_id")["tokens"].cumsum() - g["tokens"] == g["start"]).all()
        want = {d: n for d, n in sizes if n}
        assert g.groupby("doc_id")["tokens"].sum().to_dict() == want
        assert (g[g["doc_id"].map(want) <= cap].groupby("doc_id").size() == 1).all()
        total = sum(want.values())
        assert g["container_id"].nunique() <= -(-total // cap) + 3
    assert packing.pack(s.limit(0), caps).count() == 0
    assert packing.pack(s, caps.limit(0)).count() == 0


def test_pack_large_capacity(spark):
    rnd = random.Random(11)
    cap = 100_001
    sizes = [(i, rnd.choice([cap, cap - 1, rnd.randrange(1, 250_000), rnd.randrange(1, 900)])) for i in range(300)]
    caps = spark.createDataFrame([(1, cap)], "capacity_id int, capacity_tokens int")
    g = packing.pack(spark.createDataFrame(sizes, "doc_id long, tokens long"), caps).toPandas().sort_values(["container_id", "start"])
    ends = g["start"] + g["tokens"]
    assert ends.max() <= cap and g.groupby("doc_id")["tokens"].sum().to_dict() == dict(sizes)
    assert (g["start"] >= ends.groupby(g["container_id"]).shift(fill_value=0)).all()


def test_token_counts(spark):
    docs = frame(spark, DOC, [dict(doc_id=1, text="one two three"), dict(doc_id=2, text=""), dict(doc_id=3), dict(doc_id=None, text="x"), dict(doc_id=1, text="one two three"), dict(doc_id=4, text="long text " * 20000)])
    n = dict(got(packing.token_counts(docs)))
    assert n.keys() == {1, 4} and n[1] == 3 and n[4] > 30000


# problem 7
def passage(rnd, n):
    return [f"{a}{b}" for a, b in ((rnd.choice("bcdfglmnprst"), rnd.randrange(300)) for _ in range(n))]


def test_leaks(spark):
    rnd = random.Random(9)
    lead = "Read the text and mark every pair of statements that cannot both hold at once ."
    own = {i: passage(rnd, 45) for i in range(1, 9)}
    items = [dict(item_id=i, suite="s", text=lead + " " + " ".join(w)) for i, w in own.items()] + [dict(item_id=50, suite="s"), dict(item_id=None, suite="s", text="x")]
    other = lambda n: " ".join(passage(rnd, n))
    w = own[2]
    docs = [
        dict(doc_id=1, text=other(60) + " " + " ".join(own[1]).upper().replace(" ", ",  ") + "! " + other(60)),
        dict(doc_id=2, text=other(30) + " " + " ".join(w[:12]) + " " + other(30) + " " + " ".join(w[25:37]) + " " + other(9)),
        dict(doc_id=3, text=other(30) + " " + " ".join(own[3][:5]) + " " + other(30)),
        dict(doc_id=4, text=lead + " " + other(50)), dict(doc_id=5), dict(doc_id=6, text=""), dict(doc_id=None, text=" ".join(own[1])),
        dict(doc_id=7, text="<p>" + " <b>".join(x if k % 11 else "zz" for k, x in enumerate(own[4])) + "</p>" + other(4000)),
        dict(doc_id=8, text=" ".join(own[5][30:] + own[5][:10])[:90]),
    ]
    d, i = frame(spark, DOC, docs + docs[:1]), frame(spark, ITE, items)
    found = got(leakage.leaks(d, i).select("doc_id", "item_id"))
    assert found - {(8, 5)} == {(1, 1), (2, 2), (7, 4)}
    assert leakage.leaks(d, frame(spark, ITE, [])).count() == 0
    assert leakage.leaks(frame(spark, DOC, []), i).count() == 0


def test_leak_blocks_agree(spark, monkeypatch):
    rnd = random.Random(10)
    items = [dict(item_id=i, suite=f"s{i % 3}", text="Do this task now : " + " ".join(passage(rnd, 30))) for i in range(9)]
    docs = [dict(doc_id=i, text=items[i]["text"]) for i in range(9)]
    d, i = frame(spark, DOC, docs), frame(spark, ITE, items)
    whole = got(leakage.leaks(d, i).select("doc_id", "item_id"))
    monkeypatch.setattr(leakage, "BLOCK", 70)
    assert got(leakage.leaks(d, i).select("doc_id", "item_id")) == whole == {(k, k) for k in range(9)}
    monkeypatch.setattr(leakage, "BLOCK", 20)
    with pytest.raises(ValueError):
        leakage.leaks(d, i)


def test_leak_in_many_short_pieces(spark):
    """Every fifth word changed, in a passage of any length, with other pieces of it in between."""
    rnd = random.Random(13)
    w = passage(rnd, 400)
    items = [dict(item_id=1, suite="s", text=" ".join(w)), dict(item_id=2, suite="s", text=" ".join(passage(rnd, 50)))]
    noise = [x for k in range(0, 300, 30) for x in [*w[k : k + 6], "zz", "yy"]]
    changed = [x if k < 20 or k % 5 else "qq" for k, x in enumerate(w)]
    docs = [dict(doc_id=1, text=" ".join(noise + changed)), dict(doc_id=2, text=" ".join(noise[:8]))]
    out = leakage.leaks(frame(spark, DOC, docs), frame(spark, ITE, items)).collect()
    assert [(r.doc_id, r.item_id) for r in out] == [(1, 1)] and out[0].share > 0.75


def test_instruction_of_a_suite(spark):
    items = [dict(item_id=k, suite="s", text=f"Read this now: w{k} x{k} y{k}") for k in range(5)] + [dict(item_id=9, suite="s", text="Read on w9"), dict(item_id=10, text="Read this now"), dict(item_id=11, suite="s")]
    own = {r.item_id: r.toks for r in leakage.own_passages(leakage.item_tokens(frame(spark, ITE, items))).collect()}
    assert own == {k: [f"w{k}", f"x{k}", f"y{k}"] for k in range(5)} | {9: ["on", "w9"], 10: ["read", "this", "now"]}


# problem 8
CASES = [
    "Dr. Ann met Mr. B. C. Cole at 3 p.m.|She left at 4.|It cost 3.50, i.e. less than No. 8, etc., and more!",
    'He wrote: "The key is here. Take it."|"Who has it?" Bob asked.|"I left," said Ann, "and you know it."|No.|We filed it under plan B.|A. B. Cole saw it.',
    "Wait... what is this?|It is fine… Yes.|Am 5. Mai kam z. B. Dr. Ott, usw., und ging.|„Wer hat das?“ fragte Eva.",
    "M. Roy a dit : « La clé est à moi. Ana le sait. »|« Qui est là ? » demanda Eve.|Voir l'art. 9 : c'est dit !",
    "¿Estaba Ana?|¡No!|La Dra. Ruiz midió 17,9 m, p. ej. en Lima.|—No estuve —dijo Ana a Eva.",
    "他说：“我不在。他可以作证。”|谁拿了？|“谁？”安在家问。|好……|走吧！",
    "「私は先に着いた。誰もいない。」と彼は言った。|長さは5.9メートルだ。",
    "Он ушёл и т. д., пишет Иван.|«Кто взял?» — спросил он.|В 17 г. стульев было 9.|Там стоял стул…|Нет.",
    "क्या यह है?|उसने कहा: \"मेरी है। वह जानता है।\"|वह गया।",
    "كتب د. علي أن الباب مغلق!|قال: «لم أكن. اسألوا.»|من أخذ؟",
    "Նա եկավ։|Նա գնաց։", "እሱ መጣ።|እሷ ሄደች።", "သူလာသည်။|သူမသွားသည်။", "You did what‽|I did.", "Ａ氏は来た．|Ｂ氏は３．５キロ歩いた．",
    "គាត់មក។|នាងទៅ។", "ཁོ་ཡོང་།|མོ་སོང་།", "וא הלך.|היא באה!",
    "ไม่มีใครเห็น|เชือกยาว 6.34 เมตรตามที่เขียน|เขาไป",
]


@pytest.mark.parametrize("case", CASES)
def test_sentences(case):
    want = case.replace("It is fine… Yes.", "It is fine…|Yes.").split("|")
    text = " ".join(want) if not case.startswith(("他", "「")) else "".join(want)
    assert [text[a:b] for a, b in sentences.units(text)] == want


def test_paragraphs_and_bounds():
    assert sentences.units("One\u2028two\u2029Three") == [(0, 7), (8, 13)]
    text = "  Heading \n\nOne line\nand more. Two.Three.\r\n\r\n  Last  "
    assert [text[a:b] for a, b in sentences.units(text)] == ["Heading", "One line\nand more.", "Two.", "Three.", "Last"]
    for t in ("", "   \n ", '"', "...", "“" * 50, "A." * 500, "x" * 200_000 + ". Y"):
        for a, b in sentences.units(t):
            assert t[a:b] == t[a:b].strip() and b > a
        assert "".join(t[a:b] for a, b in sentences.units(t)).replace(" ", "") == "".join(t.split())


def test_sentence_operator(spark):
    docs = [dict(doc_id=1, text="One. Two.", form="prose"), dict(doc_id=2, form="prose"), dict(doc_id=3, text=" \n", form="prose"), dict(doc_id=4, text="> a\n> b", form=None), dict(doc_id=None, text="x", form="prose")]
    d = frame(spark, DOC, docs)
    assert got(sentences.sentence_units(d)) == {(1, 0, 0, 4), (1, 1, 5, 9), (4, 0, 0, 3), (4, 1, 4, 7)}
    assert sentences.sentence_units(d.limit(0)).count() == 0


# queries
COLUMNS = {
    "p1_found": ["reply_id", "defect"], "p2_found": ["doc_id", "decision"], "p3_found": ["record_id", "group_id"],
    "p4_found": ["run", "dimension", "category"], "p5_found": ["record_id_1", "record_id_2"],
    "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id", "start_char", "end_char"],
}


def test_queries_with_sql(spark, sf):
    import glob
    import os

    import duckdb

    from plumbline.llm.queries import oracle_sql, queries

    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    for name, sql in oracle_sql().items():
        df = queries()[name](spark, sf)
        r = con.execute(f"select {', '.join(df.columns)} from ({sql}) q")
        assert sorted(map(tuple, df.collect()), key=repr) == sorted(map(tuple, r.fetchall()), key=repr), name


def test_reports(spark, sf):
    """What the further queries say of the whole tables, checked against the tables and the operators they report on."""
    from plumbline.llm.queries import queries

    q = {k: f for k, f in queries().items()}
    run = lambda name: q[name](spark, sf).toPandas()
    load = lambda name: spark.read.parquet(f"{sf}/{name}.parquet").toPandas()
    reviewers = run("p2_reviewers")
    votes = consensus.last_votes(spark.read.parquet(f"{sf}/decisions.parquet"))
    assert reviewers["votes"].sum() == votes.count() and reviewers["reviewer"].is_unique
    assert reviewers["reliability"].between(0, 1).all() and reviewers["follows_consensus"].between(0, 1).all()
    report = run("p4_report")
    assert len(report) == len(load("targets")) and (report["drawn"] <= report["available"]).all()
    assert (report["least_shortfall"] <= report["run_missing"] + 1e-6).all()
    drawn = run("p4_sample")
    assert (report[report["dimension"] == "level"].groupby("run")["drawn"].sum().sum()) == len(drawn)
    cover = run("p5_coverage")
    assert (cover["covered"] <= cover["words"]).all() and (cover["covered"] >= 0).all() and cover["record_id"].is_unique
    pairs_ = run("p5_found")
    words = cover.set_index("record_id")
    both = words.loc[sorted({*pairs_["record_id_1"], *pairs_["record_id_2"]})]
    assert (both["covered"] > 0).mean() > 0.95  # a twin shares spans unless it is very short
    p5 = run("p5_report")
    assert p5["records"].sum() == len(both)
    fill = run("p6_report")
    sizes = packing.token_counts(spark.read.parquet(f"{sf}/documents.parquet")).toPandas()["tokens"].sum()
    assert (fill["tokens"] == sizes).all() and (fill["fill"] > 0.9).all() and (fill["fill"] <= 1).all()
    leaked = run("p7_found")
    assert set(run("p7_clean")["doc_id"]) == set(load("documents")["doc_id"]) - set(leaked["doc_id"])
    assert run("p7_item_report")["documents"].sum() == len(leaked)
    kinds = run("p1_defect_counts")
    found = run("p1_found")["defect"].value_counts().to_dict()
    assert {d: kinds[d].sum() for d in ("refusal", "empty", "copy", "truncated", "language")} == {d: found.get(d, 0) for d in ("refusal", "empty", "copy", "truncated", "language")}
    shares = run("p3_report")
    assert shares[shares["label"] == "all"]["records"].sum() == len(run("p3_splits"))
    units = run("p8_units")
    assert len(units) >= len(run("p8_found")) and (units["end_char"] > units["start_char"]).all()
    agree = run("p2_consensus")
    assert (agree[["p_accept", "p_discard", "p_regenerate"]].sum(1) - 1).abs().max() < 1e-9


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_found_columns(spark, sf, name):
    from plumbline.llm.queries import queries

    df = queries()[name](spark, sf)
    assert df.columns == COLUMNS[name]
    assert df.count() == df.distinct().count() > 0
