"""Queries of sources, sinks and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plumbline.plans.registry import Family
from plumbline.session import shared_dir, table
from plumbline.sources import files
from plumbline.streaming import jobs

family = Family()
q = family.query


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/plumbline/files/{uuid.uuid4().hex}"


@q("src1_json_lines", "select doc_id, length(text) as n, lang from documents")
def src1_json_lines(spark, d):
    """Documents written as JSON lines and read back with a declared schema."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    at = _folder(spark)
    files.write_json_lines(docs, at)
    back = files.read_json_lines(spark, at, docs.schema)
    return back.select("doc_id", F.length("text").cast("long").alias("n"), "lang")


@q("snk2_csv", "select c_mktsegment, count(*) as n, round(sum(c_acctbal), 2) as balance from customer group by 1", floats="balance")
def snk2_csv(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    at = _folder(spark)
    files.write_csv(c, at)
    return files.read_csv(spark, at, c.schema).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("balance"))


@q("snk3_split_export", "select split, count(*) as n, cast(sum(length(coalesce(text, ''))) as bigint) as characters from export_records group by 1")
def snk3_split_export(spark, d):
    r = table(spark, d, "export_records").select("record_id", "text", "split")
    at = _folder(spark)
    files.write_export(r, at)
    back = spark.read.schema("record_id long, text string, split string").json(at)
    return back.groupBy("split").agg(F.count("*").alias("n"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("characters"))


@q("snk6_sealed", "select distinct record_id, sha256(coalesce(text, '')) as digest from export_records")
def snk6_sealed(spark, d):
    """Texts encrypted and decrypted again."""
    key = F.lit("0123456789abcdef")
    r = table(spark, d, "export_records").select("record_id", files.sealed(F.coalesce("text", F.lit("")), key).alias("s"))
    return r.select("record_id", F.sha2(files.unsealed(F.col("s"), key), 256).alias("digest")).distinct()


@q("src9_text_tree", "select coalesce(source, '') as source, count(*) as n from documents where length(text) > 0 group by 1")
def src9_text_tree(spark, d):
    """Documents written as raw text below a folder per source, found again by a recursive walk and counted by line."""
    docs = table(spark, d, "documents").where("length(text) > 0")
    at = _folder(spark)
    one_line = F.regexp_replace("text", r"\s+", " ")
    docs.select(F.concat_ws("\t", F.coalesce("source", F.lit("")), one_line).alias("value"), F.pmod(F.xxhash64("doc_id"), F.lit(8)).alias("part")).write.partitionBy("part").text(at)
    lines = files.text_tree(spark, at).select(F.explode(F.split("text", "\n")).alias("line")).where("length(line) > 0")
    return lines.groupBy(F.split("line", "\t")[0].alias("source")).agg(F.count("*").alias("n"))


@q("src4_replay", "select tag, count(*) as n from (select distinct reply_id, tag from llm where tag is not null) x group by 1")
def src4_replay(spark, d):
    """Requests answered by recorded replies with the same tag."""
    l = table(spark, d, "llm").where("tag is not null").select("reply_id", "tag").distinct()
    recorded = l.groupBy("tag").agg(F.count("*").alias("n"))
    return files.replay(l.select("tag").distinct(), recorded, "tag")


@q("str1_window_counts", "select date_trunc('day', ts) as day_start, event_type, count(*) as n, sum(value) as total from events group by 1, 2", floats="total")
def str1_window_counts(spark, d):
    return jobs.run_to_end(jobs.window_counts(jobs.event_stream(spark, d)), ["day_start", "event_type"])


@q("str3_running_totals", "select user_id, count(*) as n, sum(value) as spent from events group by 1", floats="spent")
def str3_running_totals(spark, d):
    return jobs.run_to_end(jobs.running_totals(jobs.event_stream(spark, d), "user_id", "value"), ["user_id"])


@q("src5_call_log", "select coalesce(kind, '') as kind, count(*) as calls, cast(sum(coalesce(output_tokens, 0)) as bigint) as tokens from llm group by 1")
def src5_call_log(spark, d):
    """Calls appended to a log in two parts and read back as a stream."""
    l = table(spark, d, "llm").select("reply_id", F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("output_tokens", F.lit(0)).cast("long").alias("tokens"))
    at = _folder(spark)
    files.append_json_lines(l.where("reply_id % 2 = 0"), at)
    files.append_json_lines(l.where("reply_id % 2 <> 0 or reply_id is null"), at)
    totals = files.log_stream(spark, at, l.schema).groupBy("kind").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"))
    return jobs.run_to_end(totals, ["kind"])


@q("snk1_json_results", "select l_returnflag, l_linestatus, count(*) as n, max(l_shipdate)::date as latest from lineitem group by 1, 2")
def snk1_json_results(spark, d):
    """A report written as JSON lines and read back as it was."""
    r = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.max("l_shipdate").cast("date").alias("latest"))
    at = _folder(spark)
    files.write_json_lines(r, at)
    return files.read_json_lines(spark, at, r.schema)


@q("str2_sliding_turns", """with p as (select user_id, event_id, ts, value as phase, value - lag(value) over (partition by user_id order by ts, event_id) d from events),
s as (select *, d - 2 * pi() * round(d / (2 * pi())) as step from p)
select event_id, user_id, case when count(step) over w = 5 then sum(step) over w end as turn from s window w as (partition by user_id order by ts, event_id rows 4 preceding)""", floats="turn")
def str2_sliding_turns(spark, d):
    """How far each user's value, read as a phase, has turned over the last five events."""
    e = jobs.event_stream(spark, d)
    return jobs.sliding_turns(e.select("user_id", "ts", "event_id", F.col("value").alias("phase")))


@q("str4_sealed_log", """select cast(0 as bigint) as block, count(*) as rows, sha256(concat_ws('|', '', count(*)::varchar, bit_xor(cast('0x' || substr(sha256(concat_ws('|', coalesce(seq::varchar, ''), coalesce(kind, ''), coalesce(doc_id, ''), coalesce(decision, ''), coalesce(reviewer, ''))), 1, 15) as bigint))::varchar)) as seal from decisions""")
def str4_sealed_log(spark, d):
    """Decisions appended to a sealed log, a block for every batch (the table is one file, so it is one batch)."""
    return jobs.sealed_blocks(jobs.event_stream(spark, d, "decisions"), ["seq", "kind", "doc_id", "decision", "reviewer"])


@q("str6_drift_alarms", """with recursive r as (select event_type k, value x, row_number() over (partition by event_type order by ts, event_id) n from events where value is not null),
w as (select k, cast(1 as bigint) n, x m, cast(0 as double) v, cast(0 as bigint) a from r where n = 1
  union all select w.k, r.n, w.m + 0.05 * (r.x - w.m), 0.95 * (w.v + 0.05 * (r.x - w.m) * (r.x - w.m)), w.a + case when w.n >= 20 and w.v > 0 and (r.x - w.m) * (r.x - w.m) > 9 * w.v then 1 else 0 end from w join r on r.k = w.k and r.n = w.n + 1)
select k as key, arg_max(m, n) as mean, max(n) as seen, max(a) as alarms from w group by 1""", floats="mean")
def str6_drift_alarms(spark, d):
    return jobs.run_to_end(jobs.drift_alarms(jobs.event_stream(spark, d)), ["key"])


queries, oracle_sql = family.queries, family.oracle_sql
