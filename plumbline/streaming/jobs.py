"""Structured Streaming jobs over the event tables; each runs to the end of what is there and returns the result."""

from __future__ import annotations

import math
import os
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.session import shared_dir, stage


def event_stream(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """A table as a stream of files, whether it is one file or a folder of parts."""
    path = os.path.join(sf_dir, f"{name}.parquet")
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if os.path.isdir(path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def run_to_end(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Run an updating stream over all input and return each key's last row.

    Every batch is written under its number, so a batch that is repeated after a failure replaces itself. A stream with
    ``_fold(batch, before)`` goes through that, where ``before`` has each key's last row of the batches before, or is
    None; columns whose names begin with an underscore are kept for it alone.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/plumbline/streams/{uuid.uuid4().hex}"

    fold = getattr(stream, "_fold", None)

    def last(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (*keys, "batch")]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(*keys, "x.*")

    def keep(batch: DataFrame, number: int) -> None:
        if fold:
            before = batch.sparkSession.read.parquet(f"{base}/out").where(F.col("number") < number).drop("number") if number else None
            batch = fold(batch, last(before) if number else None)
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/number={number}")

    query = (
        stream.writeStream.outputMode("update").foreachBatch(keep)
        .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    out = last(spark.read.parquet(f"{base}/out").drop("number"))
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def window_counts(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Events and sum of values per day and type; rows later than ``late`` behind the newest are dropped."""
    # windows follow UTC; the events' clock has no zone, so it is read as UTC and given back as it was
    zone = F.current_timezone()
    e = events.withColumn("at", F.from_utc_timestamp(F.col("ts").cast("timestamp"), zone))
    g = e.withWatermark("at", late).groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(
        F.count("*").alias("n"), F.sum("value").alias("total"))
    start = F.to_utc_timestamp(F.col("w.start"), zone).cast("timestamp_ntz")
    return g.select(start.alias("day_start"), "event_type", "n", "total")


def running_totals(events: DataFrame, key: str, value: str) -> DataFrame:
    """Resumable spend per key."""
    return events.groupBy(key).agg(F.count("*").alias("n"), F.sum(value).alias("spent"))


def sliding_turns(stream: DataFrame, key: str = "user_id", width: int = 5) -> DataFrame:
    """``(event_id, key, turn)``: how far a phase has turned over the last ``width`` events of its key, unwrapped step by
    step; null before a key has so many. ``stream(key, ts, event_id, phase)``, events of a key in time order from batch to
    batch; within a batch any order will do.

    Only the last ``width + 1`` events of a key are kept between batches, as a table. A batch is bounded by the stream's
    source options, and its rows go through one window over the key whose frame is ``width`` rows.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/plumbline/streams/{uuid.uuid4().hex}"
    cols = [key, "ts", "event_id", "phase"]
    order = Window.partitionBy(key).orderBy("ts", "event_id")

    def fold(batch: DataFrame, number: int) -> None:
        rows = batch.select(*cols, F.lit(True).alias("new"))
        if number:
            rows = rows.unionByName(batch.sparkSession.read.parquet(f"{base}/kept/number={number - 1}").select(*cols, F.lit(False).alias("new")))
        rows = stage(rows)
        step = F.col("phase") - F.lag("phase").over(order)
        turned = rows.withColumn("step", step - 2 * math.pi * F.round(step / (2 * math.pi)))
        last = order.rowsBetween(1 - width, 0)
        turn = F.when(F.count("step").over(last) == width, F.sum("step").over(last))
        turned.withColumn("turn", turn).where("new").select("event_id", key, "turn").write.mode("overwrite").parquet(f"{base}/out/number={number}")
        back = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("event_id"))
        kept = rows.withColumn("k", F.row_number().over(back)).where(F.col("k") <= width + 1)
        kept.select(*cols).write.mode("overwrite").parquet(f"{base}/kept/number={number}")

    stream.writeStream.foreachBatch(fold).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("number")


def sealed_blocks(stream: DataFrame, columns: list[str]) -> DataFrame:
    """``(block, rows, seal)``: an append-only log of the stream's batches. A block's seal is the digest of the seal
    before it, its number of rows and the exclusive or of its rows' digests, which does not depend on their order; so a
    row that is changed, dropped or moved to another block breaks every later seal, and no block is gathered."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/plumbline/streams/{uuid.uuid4().hex}"
    row = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)

    def append(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        before = s.read.parquet(f"{base}/log/block={number - 1}").first()["seal"] if number else ""
        part = batch.agg(F.count("*").alias("rows"), F.coalesce(F.bit_xor(F.conv(F.substring(row, 1, 15), 16, 10).cast("long")), F.lit(0)).alias("fold"))
        seal = F.sha2(F.concat_ws("|", F.lit(before), F.col("rows").cast("string"), F.col("fold").cast("string")), 256)
        part.select("rows", seal.alias("seal")).write.mode("overwrite").parquet(f"{base}/log/block={number}")

    stream.writeStream.foreachBatch(append).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/log").select(F.col("block").cast("long").alias("block"), "rows", "seal")


def drift_alarms(events: DataFrame, key: str = "event_type", weight: float = 0.05, limit: float = 3.0) -> DataFrame:
    """Per key the number of values that lie more than ``limit`` deviations from an exponentially weighted mean of what
    came before, without looking ahead; state is kept between batches. Values of one batch are taken in time order.

    Mean and variance are linear in what they start from, so each (key, hour) is reduced from 0 on its own, the hours of
    a key are chained by their totals alone, and then every hour counts its alarms; no key's values are in one task.
    """
    stay = 1.0 - weight
    k, h = "key", "hour"

    def chain(totals: DataFrame, end: str, start: str) -> DataFrame:
        """What every hour of ``totals(key, hour, n, end, from)`` starts with, if ``from`` is what the key starts with."""

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf, out = pdf.sort_values(h), []
            x = pdf["from"].iloc[0]
            for n, c in zip(pdf["n"], pdf[end]):
                out.append(x)
                x = stay**n * x + c
            return pd.DataFrame({k: pdf[k], h: pdf[h], start: out})

        return totals.groupBy(k).applyInPandas(run, f"{k} string, {h} long, {start} double")

    def fold(batch: DataFrame, before: DataFrame | None) -> DataFrame:
        hour = F.datediff(F.to_date("ts"), F.lit("1970-01-01")).cast("long") * 24 + F.hour("ts")
        rows = batch.where("value is not null and not isnan(value)").select(
            F.col(key).cast("string").alias(k), F.coalesce(hour, F.lit(1 << 40)).alias(h), F.struct("ts", "event_id", F.col("value").cast("double").alias("value")).alias("x"))
        b = rows.groupBy(k, h).agg(F.sort_array(F.collect_list("x"))["value"].alias("xs"), F.count("*").alias("n"))
        state = batch.sparkSession.createDataFrame([], f"{k} string, mean double, seen long, alarms long, _var double") if before is None else before
        state = state.select(F.col(k).alias("k0"), F.col("mean").alias("m0"), F.col("_var").alias("v0"), F.col("seen").alias("s0"), F.col("alarms").alias("a0"))
        b = stage(b.join(state, F.col(k).eqNullSafe(F.col("k0")), "left").drop("k0"))
        same = lambda x, y: [F.col(f"{x}.{c}").eqNullSafe(F.col(f"{y}.{c}")) for c in (k, h)]
        first = Window.partitionBy(k).orderBy(h)
        # the windows below see a row an hour, never its values
        totals = stage(b.select(k, h, "n", "m0", "s0", F.get("xs", F.lit(0)).alias("x0"), F.aggregate("xs", F.lit(0.0), lambda m, x: m + weight * (x - m)).alias("end")))
        means = chain(totals.select(k, h, "n", "end", F.coalesce("m0", F.first("x0").over(first)).alias("from")), "end", "m")
        seen = totals.select(k, h, (F.coalesce("s0", F.lit(0)) + F.sum("n").over(first) - F.col("n")).alias("s"))
        b = b.alias("b").join(means.alias("c"), same("b", "c")).select("b.*", "c.m")
        b = stage(b.alias("b").join(seen.alias("c"), same("b", "c")).select("b.*", "c.s"))
        drift = F.aggregate("xs", F.struct(F.col("m").alias("m"), F.lit(0.0).alias("v")), lambda a, x: F.struct(
            (a["m"] + weight * (x - a["m"])).alias("m"), (stay * (a["v"] + weight * (x - a["m"]) * (x - a["m"]))).alias("v")))
        spread = b.select(k, h, "n", drift["v"].alias("end"), F.coalesce("v0", F.lit(0.0)).alias("from"))
        b = b.alias("b").join(chain(spread, "end", "v").alias("c"), same("b", "c")).select("b.*", "c.v")

        def count(a, x):
            gap = x - a["m"]
            alarm = (a["s"] >= 20) & (a["v"] > 0) & (gap * gap > limit * limit * a["v"])
            return F.struct((a["m"] + weight * gap).alias("m"), (stay * (a["v"] + weight * gap * gap)).alias("v"),
                            (a["s"] + 1).alias("s"), (a["a"] + F.when(alarm, 1).otherwise(0)).alias("a"))

        begin = F.struct("m", "v", F.col("s").cast("long").alias("s"), F.lit(0).cast("long").alias("a"))
        done = b.select(k, h, "a0", F.aggregate("xs", begin, count).alias("e"))
        end = done.groupBy(k).agg(F.max_by("e", h).alias("e"), F.sum("e.a").alias("a"), F.max("a0").alias("a0"))
        return end.select(k, F.col("e.m").alias("mean"), F.col("e.s").alias("seen"), (F.col("a") + F.coalesce("a0", F.lit(0))).alias("alarms"), F.col("e.v").alias("_var"))

    out = events.select(*dict.fromkeys([key, "ts", "event_id", "value"]))
    out._fold = fold  # type: ignore[attr-defined]
    return out
