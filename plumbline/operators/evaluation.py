"""Scores of verdicts against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(x: Column, y: Column, default: float | None = 0.0) -> Column:
    """``x / y``; ``default`` (0, or null) where ``y`` is 0."""
    r = x.cast("double") / F.nullif(y, F.lit(0)).cast("double")
    return r if default is None else F.coalesce(r, F.lit(default))


def rate(flag: Column) -> Column:
    """Share of true values among those that are not null; null if there are none."""
    return F.avg(flag.cast("double"))


def prf(df: DataFrame, pred: str, truth: str, by: list[str]) -> DataFrame:
    """Precision, recall, F1 and the counts behind them per group; 0 where a denominator is 0. Null flags are false."""
    p, t = F.coalesce(F.col(pred), F.lit(False)), F.coalesce(F.col(truth), F.lit(False))
    c = df.groupBy(*by).agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"))
    return c.select(
        *by, "tp", "fp", "fn", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
    )


def auc(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """Area under the ROC curve per group, ties counting half; null if one side is empty. Null scores are left out.

    Scores are first counted per distinct value; then cumulative counts of negatives give the pairs won. The window
    runs over distinct scores, not over rows.
    """
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    per = rows.groupBy(*by, score).agg(F.count_if(F.col(label)).alias("p"), F.count_if(~F.col(label)).alias("q"))
    w = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("q").over(w), F.lit(0))
    won = per.withColumn("won", F.col("p") * (below + F.col("q") / 2))
    out = won.groupBy(*by).agg(F.sum("won").alias("won"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    return out.select(*by, ratio(F.col("won"), F.col("p") * F.col("q"), None).alias("auc"))


def threshold_curve(df: DataFrame, score: str, truth: str, taus: list[float], by: list[str]) -> DataFrame:
    """Precision, recall and F1 of ``score >= tau`` for every tau of the grid, which is exploded onto the rows' counts.

    Rows are first reduced to how many thresholds they reach, so the grid never multiplies the rows.
    """
    reached = sum((F.col(score) >= t).cast("int") for t in taus)
    c = df.groupBy(*by, reached.alias("k")).agg(F.count_if(truth).alias("t"), F.count_if(~F.col(truth)).alias("f"))
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("tau")) for i, t in enumerate(taus)]))
    x = c.select(*by, "k", "t", "f", grid.alias("g")).select(*by, "k", "t", "f", "g.*")
    hit = F.col("k") > F.col("i")
    s = x.groupBy(*by, "tau").agg(
        F.sum(F.when(hit, F.col("t")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("f")).otherwise(0)).alias("fp"),
        F.sum(F.when(hit, 0).otherwise(F.col("t"))).alias("fn"),
    )
    return s.select(*by, "tau", "tp", "fp", "fn", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def best_threshold(curve: DataFrame, by: list[str]) -> DataFrame:
    """The threshold with the highest F1 per group; ties, to 12 digits, go to the lowest."""
    return curve.groupBy(*by).agg(F.min_by(F.struct("tau", "f1"), F.struct(-F.round("f1", 12), F.col("tau"))).alias("best")).select(*by, "best.tau", "best.f1")


def repeat_agreement(df: DataFrame, keys: list[str], repeat: str, label: str, repeats: int) -> DataFrame:
    """Per key whether all repeats gave one label; a repeat without a label counts as a label of its own."""
    per = df.groupBy(*keys).agg(F.count_distinct(label).alias("labels"), F.count_distinct(F.when(F.col(label).isNotNull(), F.col(repeat))).alias("seen"))
    return per.withColumn("agrees", (F.col("labels") == 1) & (F.col("seen") == repeats))


def first_mode(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """The most frequent value per key; ties go to the value seen first in ``order``."""
    per = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("first"))
    return per.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("n"), F.col("first"))).alias(value), F.max("n").alias("n"))


def weighted_line(df: DataFrame, x: str, y: str, w: str, by: list[str]) -> DataFrame:
    """Weighted least squares of ``y`` on ``x`` per group, in one pass of sums; null slope where ``x`` does not vary."""
    X, Y, W = (F.col(c).cast("double") for c in (x, y, w))
    s = df.where(X.isNotNull() & Y.isNotNull() & W.isNotNull()).groupBy(*by).agg(
        F.sum(W).alias("sw"), F.sum(W * X).alias("sx"), F.sum(W * Y).alias("sy"), F.sum(W * X * X).alias("sxx"),
        F.sum(W * X * Y).alias("sxy"), F.count("*").alias("n"))
    slope = (F.col("sw") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.nullif(
        F.col("sw") * F.col("sxx") - F.col("sx") * F.col("sx"), F.lit(0.0))
    return s.select(*by, "n", slope.alias("slope"), ((F.col("sy") - slope * F.col("sx")) / F.col("sw")).alias("intercept"))


def paired_t(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Student's t of the paired differences per group; null with fewer than two pairs or without spread."""
    d = F.col(x) - F.col(y)
    s = df.groupBy(*by).agg(F.count(d).alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"))
    return s.select(*by, "n", "mean", (F.col("mean") / F.nullif(F.col("sd") / F.sqrt("n"), F.lit(0.0))).alias("t"))


def purity(df: DataFrame, part: str, label: str) -> DataFrame:
    """Share of rows whose label is the most frequent one of their part."""
    per = df.groupBy(part, label).agg(F.count("*").alias("n")).groupBy(part).agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    return per.agg((F.sum("top") / F.sum("n")).alias("purity"), F.count("*").alias("parts"))
