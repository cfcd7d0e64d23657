"""Readers and writers of files: JSON lines, CSV, split exports, raw text trees, cached answers, sealed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json_lines(spark: SparkSession, path: str, schema) -> DataFrame:
    """JSON lines with a declared schema; blank lines are skipped, a broken line gives a row of nulls."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    return lines.select(F.from_json("value", schema).alias("x")).select("x.*")


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", False).mode("errorifexists").json(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    """Append to a log of JSON lines: every call adds files, none is changed."""
    df.write.option("ignoreNullFields", False).mode("append").json(path)


def log_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A log of JSON lines as a stream of its files."""
    return spark.readStream.schema(schema).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).mode("errorifexists").csv(path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def write_export(df: DataFrame, path: str, by: str = "split") -> None:
    """One folder of JSON lines per split, written once: an existing export is an error."""
    df.write.partitionBy(by).mode("errorifexists").json(path)


def text_tree(spark: SparkSession, path: str) -> DataFrame:
    """``(path, text)`` of all files below ``path`` that are UTF-8; others are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return raw.where(F.is_valid_utf8("content")).select("path", F.decode("content", "UTF-8").alias("text"))


def split_cached(requests: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Requests answered by the cache, with its columns, and those still to be sent."""
    return requests.join(cache, key, "inner"), requests.join(cache.select(key), key, "left_anti")


def replay(requests: DataFrame, recorded: DataFrame, tag: str) -> DataFrame:
    """Recorded answers by tag; a request without one is an error when the frame is evaluated."""
    got = requests.join(recorded.withColumn("__there", F.lit(True)), tag, "left")
    ok = F.when(F.col("__there").isNull(), F.raise_error(F.concat(F.lit("no recorded answer for "), F.col(tag)))).otherwise(F.col("__there"))
    return got.where(ok).drop("__there")


def sealed(c: Column, key: Column) -> Column:
    """AES-GCM encrypted and base64 encoded; null stays null."""
    return F.base64(F.aes_encrypt(F.encode(c, "UTF-8"), key))


def unsealed(c: Column, key: Column) -> Column:
    return F.decode(F.aes_decrypt(F.unbase64(c), key), "UTF-8")
