"""Problem 2: consensus from several annotators' labels.

Feature-assisted Dawid-Skene: expectation-maximisation over annotator confusion matrices and a regularised softmax
classifier of the items' features, whose output is the label prior. Every iteration is one pass over the items that
returns sums per annotator and per feature; the canary scores enter as prior counts of the confusion matrices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.skew import lookup_join
from plumbline.session import parallelism, stage, table

LABELS = ["accept", "discard", "regenerate"]
FEATURES = ["plant_type", "variant", "provider", "difficulty_level"]
#: Up to so many annotators every task holds all confusion matrices (9 doubles each); beyond, they are joined.
HELD = 50_000
#: Weights of the classifier: a feature's value has its weight by hash, so different values hardly ever share one.
CATEGORIES = 1 << 16
ROUNDS, RIDGE = 40, 4.0
#: Weight of one canary, against one vote, and counts that every annotator starts with.
CANARY_WEIGHT, START = 0.3, 3.0


def reviewer_key(c: Column) -> Column:
    """One reviewer whatever the case, outer blanks or separators; null if nothing is left."""
    k = F.trim(F.regexp_replace(F.lower(c), r"[\s\p{Z}_\p{Pd}]+", " "))
    return F.when(k != "", k)


def last_votes(decisions: DataFrame) -> DataFrame:
    """``(doc_id, reviewer, vote)``: each reviewer's last valid decision by ``seq`` on each document.

    Other kinds, decisions outside the vocabulary, and null documents or reviewers are no votes.
    """
    d = decisions.select(
        "doc_id", reviewer_key(F.col("reviewer")).alias("reviewer"), "seq",
        F.lower(F.trim("kind")).alias("kind"), F.lower(F.trim("decision")).alias("decision"),
    ).where("kind = 'decision' and doc_id is not null and reviewer is not null")
    d = d.where(F.col("decision").isin(LABELS))
    number = F.array_position(F.array(*[F.lit(x) for x in LABELS]), F.col("decision")).cast("int") - 1
    return d.groupBy("doc_id", "reviewer").agg(F.max_by(number, F.struct("seq", number)).alias("vote"))


def canary_rates(scores: DataFrame) -> DataFrame:
    """Per reviewer the defects shown and caught and the clean items shown and flagged, repeated rows once."""
    s = scores.select(reviewer_key(F.col("reviewer")).alias("reviewer"), "batch_id", "defects", "caught", "clean", "false_alarms")
    s = s.where("reviewer is not null").distinct()
    known = F.col("caught").isNotNull() & F.col("defects").isNotNull()
    quiet = F.col("false_alarms").isNotNull() & F.col("clean").isNotNull()
    return s.groupBy("reviewer").agg(
        F.coalesce(F.sum(F.when(known, F.col("defects"))), F.lit(0)).alias("defects"),
        F.coalesce(F.sum(F.when(known, F.col("caught"))), F.lit(0)).alias("caught"),
        F.coalesce(F.sum(F.when(quiet, F.col("clean"))), F.lit(0)).alias("clean"),
        F.coalesce(F.sum(F.when(quiet, F.col("false_alarms"))), F.lit(0)).alias("false_alarms"),
    )


def prior_counts(defects, caught, clean, false_alarms) -> np.ndarray:
    """Prior counts [annotator, truth, vote] from canary results: what is caught is not accepted."""
    d, c, k, a = (np.asarray(x, float) for x in (defects, caught, clean, false_alarms))
    hit, alarm = (c + 3.5) / (d + 5), (a + 1) / (k + 5)
    rate = np.empty((len(d), 3, 3))
    rate[:, 0] = np.stack([1 - alarm, alarm / 2, alarm / 2], 1)
    rate[:, 1] = np.stack([1 - hit, hit * 0.75, hit * 0.25], 1)
    rate[:, 2] = np.stack([1 - hit, hit * 0.25, hit * 0.75], 1)
    weight = np.stack([START + CANARY_WEIGHT * k, START + CANARY_WEIGHT * d / 2, START + CANARY_WEIGHT * d / 2], 1)
    return rate * weight[:, :, None]


def _posterior(pdf: pd.DataFrame, logs: np.ndarray | None, weights: np.ndarray):
    """(posterior, prior, item of each vote, annotators, votes, item of each feature, features)."""
    n = len(pdf)
    v, f = np.concatenate(list(pdf["v"])), np.concatenate(list(pdf["f"]))
    item = np.repeat(np.arange(n), [len(x) for x in pdf["v"]])
    owner = np.repeat(np.arange(n), [len(x) for x in pdf["f"]])
    if logs is not None:
        r = np.concatenate(list(pdf["r"]))
        like = logs[r, :, v]
    else:
        r = None
        like = np.concatenate(list(pdf["l"])).reshape(-1, 3)
    prior = np.stack([np.bincount(owner, weights[f, t], n) for t in range(3)], 1)
    prior -= prior.max(1, keepdims=True)
    prior = np.exp(prior)
    prior /= prior.sum(1, keepdims=True)
    post = np.log(prior + 1e-12) + np.stack([np.bincount(item, like[:, t], n) for t in range(3)], 1)
    post = np.exp(post - post.max(1, keepdims=True))
    post /= post.sum(1, keepdims=True)
    return post, prior, item, r, v, owner, f


class Consensus:
    """The fitted model: ``items(doc_id, r, v, f)``, confusion matrices and classifier weights."""

    def __init__(self, items: DataFrame, names: list[str] | None, joined: DataFrame | None, weights: np.ndarray):
        self.items, self.names, self.joined, self.weights = items, names, joined, weights
        self.confusion: np.ndarray | None = None
        self.rounds = 0

    def posteriors(self) -> DataFrame:
        """``(doc_id, votes, kinds, agreement, p_accept, p_discard, p_regenerate, decision)``."""
        logs = None if self.confusion is None else np.log(self.confusion)
        weights = self.weights

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not len(pdf):
                    continue
                post, _, item, _, v, _, _ = _posterior(pdf, logs, weights)
                counts = np.stack([np.bincount(item, v == t, len(pdf)) for t in range(3)], 1)
                n = counts.sum(1)
                same = (counts * (counts - 1)).sum(1) / np.maximum(n * (n - 1), 1)
                yield pd.DataFrame({
                    "doc_id": pdf["doc_id"], "votes": n.astype(int), "kinds": (counts > 0).sum(1),
                    "agreement": np.where(n > 1, same, np.nan), "p_accept": post[:, 0], "p_discard": post[:, 1],
                    "p_regenerate": post[:, 2], "decision": np.array(LABELS)[post.argmax(1)],
                })

        rows = self.items if self.joined is None else _with_likelihoods(self.items, self.joined)
        return rows.mapInPandas(
            score, "doc_id string, votes int, kinds int, agreement double, p_accept double, p_discard double, "
            "p_regenerate double, decision string",
        )


def _with_likelihoods(items: DataFrame, confusion: DataFrame) -> DataFrame:
    """Items with, for each vote, the log-probabilities of its annotator giving it under each truth."""
    long = items.select("doc_id", "f", F.explode(F.arrays_zip("r", "v")).alias("x")).select("doc_id", "f", "x.r", "x.v")
    got = lookup_join(long, confusion, "r", long.groupBy("r").agg(F.count("*").alias("n")), "inner").select(
        "doc_id", "f", "r", "v", F.array(*[F.log(F.get("m", F.col("v") + 3 * t)) for t in range(3)]).alias("l"))
    return got.groupBy("doc_id").agg(
        F.first("f").alias("f"), F.collect_list("r").alias("r"), F.collect_list("v").alias("v"),
        F.flatten(F.collect_list("l")).alias("l"),
    )


def _classifier_step(weights: np.ndarray, want: np.ndarray, have: np.ndarray, parts: int) -> np.ndarray:
    """One damped Newton step of the ridge softmax classifier from sums per feature of posteriors and of its output."""
    gain = want - have - RIDGE * weights
    size = have.sum(1, keepdims=True)
    curve = have * (1 - have / np.maximum(size, 1e-9)) * parts + RIDGE
    return weights + np.clip(gain / curve, -1, 1)


def fit(decisions: DataFrame, scores: DataFrame, records: DataFrame, held: int = HELD) -> Consensus:
    """Fit annotators and classifier to all votes; ``records`` gives the documents' features by doc_id.

    Null features are a category of their own; documents without a record have a feature vector of nulls; reviewers
    without canaries start from the same weak prior. Empty tables give a model without items.
    """
    spark = decisions.sparkSession
    votes = stage(last_votes(decisions))
    per = votes.groupBy("reviewer").agg(F.count("*").alias("n")).join(canary_rates(scores), "reviewer", "left")
    per = stage(per.fillna(0))
    count = per.count()
    feats = [
        F.pmod(F.xxhash64(F.lit(c), F.coalesce(F.lower(F.trim(F.col(c).cast("string"))), F.lit(""))), F.lit(CATEGORIES)).cast("int")
        for c in FEATURES
    ]
    about = records.where("doc_id is not null").groupBy("doc_id").agg(
        F.max_by(F.struct(*FEATURES), F.col("exported_at")).alias("x")
    ).select("doc_id", "x.*")
    names = None
    if count <= held:
        ordered = per.orderBy("reviewer").collect()
        names = [r["reviewer"] for r in ordered]
        ids = spark.createDataFrame([(i, x) for i, x in enumerate(names)], "r int, reviewer string")
        votes = votes.join(F.broadcast(ids), "reviewer")
        prior = prior_counts(*[[r[c] for r in ordered] for c in ("defects", "caught", "clean", "false_alarms")])
    else:
        votes = votes.withColumnRenamed("reviewer", "r")
    items = votes.groupBy("doc_id").agg(F.collect_list("r").alias("r"), F.collect_list("vote").alias("v"))
    items = stage(
        items.join(about, "doc_id", "left").select("doc_id", "r", "v", F.array(*feats).alias("f"))
        .repartition(parallelism(spark), "doc_id")
    )
    weights = np.zeros((CATEGORIES, 3))
    weights_start = votes.groupBy("vote").agg(F.count("*").alias("n")).collect()
    total = sum(r["n"] for r in weights_start)
    base = np.log(np.array([dict((r["vote"], r["n"]) for r in weights_start).get(t, 0) + 1 for t in range(3)]) / (total + 3))
    weights += base / len(FEATURES)
    model = Consensus(items, names, None, weights)
    if names is None:
        _fit_joined(model, per)
    else:
        _fit_held(model, prior)
    return model


def _fit_held(model: Consensus, prior: np.ndarray) -> None:
    n = len(model.names)
    confusion = prior / prior.sum(2, keepdims=True)
    spark = model.items.sparkSession
    for step in range(ROUNDS):
        weights = model.weights
        sent = spark.sparkContext.broadcast((np.log(confusion), weights))

        def sums(batches, sent=sent):
            logs, weights = sent.value
            c, w, h = np.zeros(n * 9), np.zeros((CATEGORIES, 3)), np.zeros((CATEGORIES, 3))
            for pdf in batches:
                if not len(pdf):
                    continue
                post, pri, item, r, v, owner, f = _posterior(pdf, logs, weights)
                for t in range(3):
                    c += np.bincount(r * 9 + t * 3 + v, post[item, t], n * 9)
                    w[:, t] += np.bincount(f, post[owner, t], CATEGORIES)
                    h[:, t] += np.bincount(f, pri[owner, t], CATEGORIES)
            k, g = np.flatnonzero(c), np.flatnonzero(h.any(1))
            yield pd.DataFrame({
                "kind": [0] * len(k) + [1] * 3 * len(g) + [2] * 3 * len(g),
                "k": np.concatenate([k, *[g * 3 + t for t in range(3)] * 2]),
                "x": np.concatenate([c[k], *[w[g, t] for t in range(3)], *[h[g, t] for t in range(3)]]),
            })

        got = model.items.mapInPandas(sums, "kind int, k long, x double").groupBy("kind", "k").agg(F.sum("x").alias("x")).toPandas()
        sent.destroy()
        parts = [np.zeros(n * 9), np.zeros(CATEGORIES * 3), np.zeros(CATEGORIES * 3)]
        for kind, part in enumerate(parts):
            mine = got[got["kind"] == kind]
            part[mine["k"].to_numpy(int)] = mine["x"].to_numpy()
        counts = parts[0].reshape(n, 3, 3) + prior
        new = counts / counts.sum(2, keepdims=True)
        model.weights = _classifier_step(weights, parts[1].reshape(-1, 3), parts[2].reshape(-1, 3), len(FEATURES))
        moved = float(np.abs(new - confusion).max()) if n else 0.0
        confusion = new
        model.rounds = step + 1
        if moved < 2e-3:
            break
    model.confusion = confusion


def _fit_joined(model: Consensus, per: DataFrame) -> None:
    """The same iteration with the confusion matrices in a table that is joined to the votes."""

    def start(batches):
        for pdf in batches:
            p = prior_counts(pdf["defects"], pdf["caught"], pdf["clean"], pdf["false_alarms"])
            yield pd.DataFrame({"r": pdf["reviewer"], "prior": list(p.reshape(-1, 9))})

    priors = stage(per.mapInPandas(start, "r string, prior array<double>"))
    norm = F.transform("c", lambda x, i: x / F.aggregate(F.slice("c", (F.floor(i / 3) * 3 + 1).cast("int"), 3), F.lit(0.0), lambda a, y: a + y))
    table_ = stage(priors.select("r", F.col("prior").alias("c")).select("r", norm.alias("m")))
    for step in range(ROUNDS):
        weights = model.weights

        def post(batches, weights=weights):
            for pdf in batches:
                if not len(pdf):
                    continue
                p, q, item, _, v, owner, f = _posterior(pdf, None, weights)
                r = np.concatenate([np.asarray(x, object) for x in pdf["r"]])
                yield pd.concat([
                    *[pd.DataFrame({"kind": 0, "r": r, "k": t * 3 + v, "x": p[item, t]}) for t in range(3)],
                    *[pd.DataFrame({"kind": 1, "r": "", "k": f * 3 + t, "x": p[owner, t]}) for t in range(3)],
                    *[pd.DataFrame({"kind": 2, "r": "", "k": f * 3 + t, "x": q[owner, t]}) for t in range(3)],
                ])

        got = stage(
            _with_likelihoods(model.items, table_).mapInPandas(post, "kind int, r string, k int, x double")
            .groupBy("kind", "r", "k").agg(F.sum("x").alias("x"))
        )
        feats = got.where("kind > 0").select("kind", "k", "x").toPandas()
        want, have = (np.zeros(CATEGORIES * 3) for _ in range(2))
        for kind, part in ((1, want), (2, have)):
            mine = feats[feats["kind"] == kind]
            part[mine["k"].to_numpy(int)] = mine["x"].to_numpy()
        model.weights = _classifier_step(weights, want.reshape(-1, 3), have.reshape(-1, 3), len(FEATURES))
        sums = got.where("kind = 0").groupBy("r").agg(F.map_from_entries(F.collect_list(F.struct("k", "x"))).alias("s"))
        c = F.transform("prior", lambda x, i: x + F.coalesce(F.col("s")[i], F.lit(0.0)))
        new = stage(priors.join(sums, "r", "left").select("r", c.alias("c")).select("r", norm.alias("m")))
        gap = F.array_max(F.zip_with("n.m", "o.m", lambda x, y: F.abs(x - y)))
        moved = new.alias("n").join(table_.alias("o"), F.col("n.r") == F.col("o.r")).agg(F.max(gap)).first()[0]
        table_ = new
        model.rounds = step + 1
        if moved is None or moved < 2e-3:
            break
    model.joined = table_


def _fit_tables(spark: SparkSession, sf_dir: str) -> Consensus:
    return fit(*[table(spark, sf_dir, t) for t in ("decisions", "canary_scores", "export_records")])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit_tables(spark, sf_dir).posteriors().where("votes >= 3 and kinds > 1").select("doc_id", "decision")


def p2_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every voted document with its consensus, the label probabilities and the share of agreeing pairs of votes."""
    return _fit_tables(spark, sf_dir).posteriors()


def p2_reviewers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per reviewer: votes, the share of votes that follow the consensus and that the model expects to be right, and
    the canaries caught and flagged."""
    model = _fit_tables(spark, sf_dir)
    post = model.posteriors().select("doc_id", "decision", "p_accept", "p_discard", "p_regenerate")
    votes = last_votes(table(spark, sf_dir, "decisions"))
    right = F.get(F.array("p_accept", "p_discard", "p_regenerate"), F.col("vote"))
    follows = (F.get(F.array(*[F.lit(x) for x in LABELS]), F.col("vote")) == F.col("decision")).cast("double")
    per = votes.join(post, "doc_id").groupBy("reviewer").agg(
        F.count("*").alias("votes"), F.avg(follows).alias("follows_consensus"), F.avg(right).alias("reliability")
    )
    return per.join(canary_rates(table(spark, sf_dir, "canary_scores")), "reviewer", "left")
