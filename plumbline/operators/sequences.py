"""Ordered operators that stay balanced when one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.skew import salted_sum


def hash_rank(df: DataFrame, keys: list[str], digest: str, out: str) -> DataFrame:
    """0-based rank of the rows of each key in the order of ``digest``, a hex string; its first two digits are the
    buckets, so the order is that of the whole digest and no key is gathered."""
    bucket = F.conv(F.substring(digest, 1, 2), 16, 10)
    return salted_sum(df, keys, [F.col(digest)], bucket, out)


def running_sum(df: DataFrame, keys: list[str], time: str, order: list[str], value: Column, out: str) -> DataFrame:
    """Sum of ``value`` over the earlier rows and the row itself of each key, in the order of (``time``, ``order``).

    Time is cut into days; each day is summed on its own and starts from the total of the days before. Null values
    add nothing; rows without a time come first.
    """
    v = F.coalesce(value, F.lit(0))
    day = F.coalesce(F.unix_date(F.to_date(time)), F.lit(-(10**6)))
    return salted_sum(df, keys, [F.col(time).asc_nulls_first(), *[F.col(c) for c in order]], day, out, v).withColumn(out, F.col(out) + v)


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, value: str, tie: str) -> DataFrame:
    """Each row of ``left`` with ``value`` of the last ``right`` row of its key before it, null if there is none.

    Equal times count as before. Time is cut into days: within a day a window carries values forward, and a second,
    over (key, day) only, brings them into later days. Null keys or times match nothing; of equal right times the one
    with the greatest ``tie`` counts.
    """
    r = right.where(" and ".join(f"{c} is not null" for c in [*keys, time])).groupBy(*keys, time).agg(
        F.max_by(value, tie).alias("__v"))
    both = left.withColumn("__v", F.lit(None).cast(dict(right.dtypes)[value])).withColumn("__left", F.lit(True))
    both = both.unionByName(r.withColumn("__left", F.lit(False)), allowMissingColumns=True).withColumn("__day", F.to_date(time))
    own = Window.partitionBy(*keys, "__day").orderBy(F.col(time), F.col("__left")).rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("__own", F.last("__v", ignorenulls=True).over(own))
    days = both.groupBy(*keys, "__day").agg(F.max_by("__v", F.when(~F.col("__left"), F.col(time))).alias("__last"))
    w = Window.partitionBy(*keys).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("__carried", F.last("__last", ignorenulls=True).over(w)).drop("__last")
    cond = [F.col(f"m.{k}").eqNullSafe(F.col(f"d.{k}")) for k in [*keys, "__day"]]
    out = met.where("__left").alias("m").join(days.alias("d"), cond, "left")
    anchored = F.lit(True)
    for k in [*keys, time]:
        anchored &= F.col(f"m.{k}").isNotNull()
    return out.select(*[F.col(f"m.{c}") for c in left.columns], F.when(anchored, F.coalesce("__own", "__carried")).alias(value))


def interval_join(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, width: int) -> DataFrame:
    """Points inside spans of the same key, ends included, by an equi-join on (key, bucket of ``width`` seconds).

    A span is copied to the buckets it covers, so choose ``width`` near a usual span. Nulls match nothing.
    """
    sec = lambda c: F.unix_timestamp(c)
    s = spans.where(F.col(start) <= F.col(end)).withColumn(
        "__b", F.explode(F.sequence(F.floor(sec(start) / width), F.floor(sec(end) / width))))
    p = points.where(F.col(at).isNotNull()).withColumn("__b", F.floor(sec(at) / width))
    return p.join(s, [key, "__b"]).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("__b")


def islands(df: DataFrame, keys: list[str], value: str, gap: Column, out: str) -> DataFrame:
    """Number of the run each row belongs to, per key in the order of ``value``; a run ends where the step to the next
    value exceeds ``gap`` (which may refer to the row's own value). The rows of a key are its distinct values."""
    w = Window.partitionBy(*keys).orderBy(value)
    prev = F.lag(value).over(w)
    new = F.when(prev.isNull() | (F.col(value) - prev > gap), 1).otherwise(0)
    return df.select(*keys, value).distinct().withColumn("__new", new).withColumn(
        out, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")
