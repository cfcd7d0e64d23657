"""Session helpers: table reading and lineage cuts in the cluster's shared folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which a query's shuffle files are removed at its end.
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named parquet table of a data directory."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset only a local master, whose one
    machine holds all tasks, gets a folder of its own; on a cluster it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"file:///tmp/plumbline-{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def stage(df: DataFrame, *, drop: DataFrame | None = None, schema: str | None = None, by: str | None = None, codec: str = "snappy") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, so that neither later jobs nor a lost executor
    recompute what came before. The shuffle files that it took go as soon as it is written, not when the driver
    happens to collect its garbage. ``drop`` is an earlier staged frame that nothing needs any more; ``by`` is a column with a folder a value."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/plumbline/{uuid.uuid4().hex}"
    kind = schema or df.schema
    was = spark.conf.get(_RELEASE, "false")
    spark.conf.set(_RELEASE, "true")
    try:
        df.write.parquet(path, partitionBy=by, compression=codec)
    finally:
        spark.conf.set(_RELEASE, was)
    out = spark.read.schema(kind).parquet(path)
    out._staged_at = path  # type: ignore[attr-defined]
    if drop is not None and getattr(drop, "_staged_at", None):
        unstage(drop)
    return out


def unstage(df: DataFrame, part: str | None = None) -> None:
    """Delete what ``stage`` wrote for ``df``, or the folder of it named ``part``."""
    path = getattr(df, "_staged_at", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{path}/{part}" if part else path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def parallelism(spark: SparkSession) -> int:
    """Tasks to spread Python work over: the session's shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
