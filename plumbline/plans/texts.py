"""Queries of text functions, scans and the leak test."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators import leak
from plumbline.operators.entity_graph import canonical_key
from plumbline.plans.registry import Family
from plumbline.session import table

family = Family()
q = family.query

_RECORDS = "r as (select record_id, arg_max(coalesce(text, ''), (exported_at, text)) as text from export_records group by 1)"
_PLAIN = "trim(regexp_replace(regexp_replace(lower(text), '\\p{P}', '', 'g'), '[\\s\\pZ]+', ' ', 'g'))"


def records(spark, d):
    """The last text of every record; null is empty."""
    return table(spark, d, "export_records").groupBy("record_id").agg(
        F.max_by(F.coalesce("text", F.lit("")), F.struct("exported_at", "text")).alias("text"))


@q("prj2_canonical_key", """select distinct plant_type, trim(regexp_replace(lower(trim(plant_type)), '[^a-z0-9]+', '_', 'g'), '_') as key from units where plant_type is not null""")
def prj2_canonical_key(spark, d):
    u = table(spark, d, "units").where("plant_type is not null").select("plant_type").distinct()
    return u.withColumn("key", canonical_key(F.col("plant_type")))


@q("sf1_normalize_ws", f"with {_RECORDS} select record_id, length(trim(regexp_replace(text, '[\\s\\pZ]+', ' ', 'g'))) as n from r")
def sf1_normalize_ws(spark, d):
    return records(spark, d).select("record_id", F.length(X.normalize_ws(F.col("text"))).cast("long").alias("n"))


@q("sf2_sentences", f"""with {_RECORDS}, m as (select record_id, text t0, regexp_replace(trim(regexp_replace(text, '[\\s\\pZ]+', ' ', 'g')), '\\b(Mr|Mrs|Ms|Dr|St|Prof)\\.', '\\1' || chr(1), 'g') t from r)
select record_id, len(string_split(regexp_replace(t, '([.!?]) ([A-Z])', '\\1' || chr(2) || '\\2', 'g'), chr(2))) as sentences from m""")
def sf2_sentences(spark, d):
    return records(spark, d).select("record_id", F.size(X.simple_sentences(F.col("text"))).cast("long").alias("sentences"))


@q("sf3_occurrences", f"with {_RECORDS} select record_id, (length(text) - length(replace(text, 'the', ''))) // 3 as n from r")
def sf3_occurrences(spark, d):
    return records(spark, d).select("record_id", X.occurrences(F.col("text"), F.lit("the")).cast("long").alias("n"))


@q("sf5_text_digest", f"with {_RECORDS} select record_id, sha256({_PLAIN}) as digest from r")
def sf5_text_digest(spark, d):
    return records(spark, d).select("record_id", F.sha2(F.array_join(X.plain_words(F.col("text")), " "), 256).alias("digest"))


@q("sf6_word_grams", f"""with {_RECORDS}, w as (select record_id, string_split({_PLAIN}, ' ') w from r where {_PLAIN} <> ''), g as (select record_id, array_to_string(w[i:i + 7], ' ') g from w, lateral (select unnest(range(1, len(w) - 6)) i) t)
select record_id, count(distinct g) as grams from g group by 1""")
def sf6_word_grams(spark, d):
    g = records(spark, d).select("record_id", F.size(X.word_grams(X.plain_words(F.col("text")), 8)).cast("long").alias("grams"))
    return g.where("grams > 0")


@q("sf9_tags", "select distinct reply_id, substr(sha256(coalesce(request, '')), 1, 12) as short, lpad(cast(reply_id % 1000 as varchar), 3, '0') as padded from llm")
def sf9_tags(spark, d):
    return table(spark, d, "llm").select("reply_id", F.substring(F.sha2(F.coalesce("request", F.lit("")), 256), 1, 12).alias("short"),
                                         F.lpad((F.col("reply_id") % 1000).cast("string"), 3, "0").alias("padded")).distinct()


@q("sf10_call_kind", """select kind, count(*) as n from (select distinct reply_id, case when tag like '%direct%' then 'direct' when tag like '%entities%' then 'entities'
 when regexp_matches(tag, '-[0-9]{3}-[0-9]{3}$') then 'pairs' when tag is null then 'none' else 'other' end as kind from llm) x group by 1""")
def sf10_call_kind(spark, d):
    t = F.col("tag")
    kind = F.when(t.contains("direct"), "direct").when(t.contains("entities"), "entities").when(t.rlike("-[0-9]{3}-[0-9]{3}$"), "pairs").when(t.isNull(), "none").otherwise("other")
    return table(spark, d, "llm").select("reply_id", kind.alias("kind")).distinct().groupBy("kind").agg(F.count("*").alias("n"))


@q("sf12_canary_digests", "select split, count(distinct regexp_extract(canary, 'XC-([0-9a-f]{20})', 1)) as canaries, min(sha256(canary)) as digest from export_records where canary is not null group by 1")
def sf12_canary_digests(spark, d):
    r = table(spark, d, "export_records").where("canary is not null")
    return r.groupBy("split").agg(F.count_distinct(F.regexp_extract("canary", "XC-([0-9a-f]{20})", 1)).alias("canaries"), F.min(F.sha2("canary", 256)).alias("digest"))


@q("sf13_json_leaves", """with o as (select distinct reply_id, output from llm where output is not null and json_valid(output)), k as (select reply_id, unnest(json_keys(output)) k, output from o)
select reply_id, k as leaf, json_extract_string(output, '$.' || k) as text from k where json_type(output, '$.' || k) = 'VARCHAR'""")
def sf13_json_leaves(spark, d):
    """The string members of every JSON object."""
    o = table(spark, d, "llm").where("output is not null").select("reply_id", "output").distinct()
    v = o.select("reply_id", F.expr("try_parse_json(output)").alias("v"))
    x = v.where("v is not null").lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
    return x.where(F.expr("schema_of_variant(value) = 'STRING'")).select("reply_id", F.col("key").alias("leaf"), F.expr("cast(value as string)").alias("text"))


@q("sf15_clocks", """with e as (select event_id, strftime(ts, '%H:%M') c from events) select event_id, cast(split_part(c, ':', 1) as int) * 60 + cast(split_part(c, ':', 2) as int) as minutes,
 (cast(split_part(c, ':', 1) as int) * 60 + cast(split_part(c, ':', 2) as int) - 600 + 1440) % 1440 < 120 as in_span from e""")
def sf15_clocks(spark, d):
    """Minutes of the day, and whether they lie in the two hours from ten on."""
    m = X.clock_minutes(F.date_format("ts", "HH:mm"))
    return table(spark, d, "events").select("event_id", m.alias("minutes"), (F.pmod(m - 600, F.lit(1440)) < 120).alias("in_span"))


@q("sf18_token_estimate", "select distinct reply_id, cast(ceil(length(coalesce(request, '')) / 3.5) as bigint) as tokens from llm")
def sf18_token_estimate(spark, d):
    return table(spark, d, "llm").select("reply_id", F.ceil(F.length(F.coalesce("request", F.lit(""))) / 3.5).alias("tokens")).distinct()


@q("sf19_length_range", f"""with {_RECORDS}, w as (select record_id, len(string_split({_PLAIN}, ' ')) n from r where {_PLAIN} <> '')
select record_id, n, greatest(n - greatest(cast(ceil(n * 15 / 100.0) as bigint), 25), 0) as low, n + greatest(cast(ceil(n * 15 / 100.0) as bigint), 25) as high from w""")
def sf19_length_range(spark, d):
    w = records(spark, d).select("record_id", F.size(X.plain_words(F.col("text"))).cast("long").alias("n")).where("n > 0")
    low, high = X.length_range(F.col("n"))
    return w.select("record_id", "n", low.alias("low"), high.alias("high"))


@q("sf22_circular_mean", """with e as (select user_id, 2 * pi() * (hour(ts) * 60 + minute(ts)) / 1440 a from events) select user_id, atan2(sum(sin(a)), sum(cos(a))) as angle,
 sqrt(sum(sin(a)) ** 2 + sum(cos(a)) ** 2) / count(*) as strength from e group by 1""", floats="angle strength")
def sf22_circular_mean(spark, d):
    """Mean time of day of a user's events as an angle, and how far they agree."""
    a = 2 * F.pi() * (F.hour("ts") * 60 + F.minute("ts")) / 1440
    g = table(spark, d, "events").groupBy("user_id").agg(F.sum(F.sin(a)).alias("s"), F.sum(F.cos(a)).alias("c"), F.count("*").alias("n"))
    return g.select("user_id", F.atan2("s", "c").alias("angle"), (F.sqrt(F.col("s") * F.col("s") + F.col("c") * F.col("c")) / F.col("n")).alias("strength"))


_ROTATED = """with o as (select o_custkey, list(o_orderkey order by md5('' || o_orderkey)) c from orders group by 1 having count(*) >= 3),
t as (select o_custkey, c, list_position(c, list_min(c)) p from o), u as (select o_custkey, list_concat(c[p:], c[:p - 1]) f from t)
select o_custkey, array_to_string(case when f[2] <= f[len(f)] then f else list_concat(f[:1], list_reverse(f[2:])) end, ',') as cycle from u"""


@q("sf24_cycle_rotation", _ROTATED)
@q("sf24_all_rotations", _ROTATED)
def sf24_cycle_rotation(spark, d):
    """Cycles of three and more orders, however long."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct(F.md5(F.col("o_orderkey").cast("string")).alias("h"), "o_orderkey"))).alias("c"))
    o = o.where(F.size("c") >= 3).select("o_custkey", F.col("c.o_orderkey").alias("c"))
    return o.select("o_custkey", F.array_join(X.canonical_cycle(F.col("c")), ",").alias("cycle"))


@q("sf27_unordered_keys", "select distinct least(l_suppkey, l_partkey) || '|' || greatest(l_suppkey, l_partkey) as key from lineitem")
def sf27_unordered_keys(spark, d):
    k = F.concat_ws("|", F.least("l_suppkey", "l_partkey").cast("string"), F.greatest("l_suppkey", "l_partkey").cast("string"))
    return table(spark, d, "lineitem").select(k.alias("key")).distinct()


def _sentences(spark, d):
    s = records(spark, d).select("record_id", F.posexplode(X.simple_sentences(F.col("text"))).alias("pos", "sentence"))
    return s.where("length(sentence) > 0")


_SENT = f"""{_RECORDS}, m as (select record_id, regexp_replace(trim(regexp_replace(text, '[\\s\\pZ]+', ' ', 'g')), '\\b(Mr|Mrs|Ms|Dr|St|Prof)\\.', '\\1' || chr(1), 'g') t from r),
l as (select record_id, string_split(regexp_replace(t, '([.!?]) ([A-Z])', '\\1' || chr(2) || '\\2', 'g'), chr(2)) l from m),
s as (select record_id, i - 1 as pos, replace(l[i], chr(1), '.') as sentence from l, lateral (select unnest(range(1, len(l) + 1)) i) x where l[i] <> '')"""


@q("sc2_cue_hits", f"with {_SENT} select record_id, pos, sentence from s where regexp_matches(sentence, '\\b(older|younger|taller|shorter)\\b') and regexp_matches(sentence, '[A-Z][a-z]+.*[A-Z][a-z]+')")
def sc2_cue_hits(spark, d):
    """Sentences that hold a comparison and two names."""
    hit = F.col("sentence").rlike(r"\b(older|younger|taller|shorter)\b") & F.col("sentence").rlike(r"[A-Z][a-z]+.*[A-Z][a-z]+")
    return _sentences(spark, d).where(hit).select("record_id", F.col("pos").cast("long").alias("pos"), "sentence")


@q("sc3_order_edges", f"""with {_SENT}, e as (select record_id, regexp_extract(sentence, '\\b([A-Z][a-z]+) is (older|younger|taller|shorter) than ([A-Z][a-z]+)', ['a', 'w', 'b']) e from s)
select distinct record_id, case when e.w in ('older', 'taller') then e.a else e.b end as greater, case when e.w in ('older', 'taller') then e.b else e.a end as lesser, case when e.w in ('older', 'younger') then 'age' else 'height' end as attribute from e where e.a <> ''""")
def sc3_order_edges(spark, d):
    """Stated comparisons as directed edges."""
    rx = r"\b([A-Z][a-z]+) is (older|younger|taller|shorter) than ([A-Z][a-z]+)"
    e = _sentences(spark, d).select("record_id", *[F.regexp_extract("sentence", rx, i).alias(n) for i, n in ((1, "a"), (2, "w"), (3, "b"))]).where("a <> ''")
    up = F.col("w").isin("older", "taller")
    return e.select("record_id", F.when(up, F.col("a")).otherwise(F.col("b")).alias("greater"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("lesser"),
                    F.when(F.col("w").isin("older", "younger"), "age").otherwise("height").alias("attribute")).distinct()


@q("sc5_record_scan", f"""with {_SENT} select record_id, count(*) as sentences, count(*) filter (sentence like '%?') as questions, count(*) filter (regexp_matches(sentence, '[0-9]')) as with_numbers,
 count(*) filter (regexp_matches(sentence, '\\b(not|never|nobody|no)\\b')) as negated from s group by 1""")
def sc5_record_scan(spark, d):
    s = F.col("sentence")
    return _sentences(spark, d).groupBy("record_id").agg(F.count("*").alias("sentences"), F.count_if(s.endswith("?")).alias("questions"),
                                                         F.count_if(s.rlike("[0-9]")).alias("with_numbers"), F.count_if(s.rlike(r"\b(not|never|nobody|no)\b")).alias("negated"))


@q("vf1_repeated_sentences", f"with {_SENT} select sentence, count(distinct record_id) as records, count(*) as n from s where length(sentence) > 30 group by 1 having count(distinct record_id) > 3")
def vf1_repeated_sentences(spark, d):
    s = _sentences(spark, d).where("length(sentence) > 30")
    return s.groupBy("sentence").agg(F.count_distinct("record_id").alias("records"), F.count("*").alias("n")).where("records > 3")


@q("wn5_cue_spacing", f"""with {_SENT}, c as (select record_id, pos, pos - lag(pos) over (partition by record_id order by pos) gap from s where regexp_matches(sentence, '[0-9]'))
select record_id, count(*) as cues, min(gap) as least_gap, max(pos) - min(pos) as reach from c group by 1""")
def wn5_cue_spacing(spark, d):
    """How far apart the sentences with numbers stand; a record's sentences are bounded by its text."""
    c = _sentences(spark, d).where(F.col("sentence").rlike("[0-9]")).select("record_id", F.col("pos").cast("long").alias("pos"))
    gap = F.col("pos") - F.lag("pos").over(Window.partitionBy("record_id").orderBy("pos"))
    return c.withColumn("gap", gap).groupBy("record_id").agg(F.count("*").alias("cues"), F.min("gap").alias("least_gap"), (F.max("pos") - F.min("pos")).alias("reach"))


@q("wn6_sentence_offsets", f"""with {_SENT} select record_id, pos, coalesce(sum(len(string_split(sentence, ' '))) over (partition by record_id order by pos rows between unbounded preceding and 1 preceding), 0) as words_before from s""")
def wn6_sentence_offsets(spark, d):
    w = Window.partitionBy("record_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    s = _sentences(spark, d).withColumn("n", F.size(F.split("sentence", " ")).cast("long"))
    return s.select("record_id", F.col("pos").cast("long").alias("pos"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("words_before"))


_GRAMS = """w as (select {key} as k, string_split(trim(regexp_replace(regexp_replace(lower(text), '\\p{{P}}', '', 'g'), '[\\s\\pZ]+', ' ', 'g')), ' ') w from {t} where text is not null),
g as (select distinct k, array_to_string(w[i:i + 7], ' ') g from w, lateral (select unnest(range(1, len(w) - 6)) i) t)"""


@q("lk1_fingerprints", f"with {_GRAMS.format(key='item_id', t='eval_items')} select k as item_id, count(*) as grams from g group by 1")
def lk1_fingerprints(spark, d):
    return leak.fingerprints(table(spark, d, "eval_items"), "item_id").groupBy("item_id").agg(F.count("*").alias("grams"))


@q("lk2_shared_runs", f"""with {_GRAMS.format(key='item_id', t='eval_items')}, {_GRAMS.format(key='doc_id', t='documents').replace('w as', 'w2 as').replace('from w,', 'from w2,').replace('g as (', 'g2 as (')}
select g2.k as doc_id, g.k as item_id, count(*) as shared from g2 join g using (g) group by 1, 2 having count(*) >= 2""")
def lk2_shared_runs(spark, d):
    return leak.search(table(spark, d, "documents"), "doc_id", table(spark, d, "eval_items"), "item_id")


@q("jn16_gram_probe", f"""with {_GRAMS.format(key='item_id', t='eval_items')}, {_GRAMS.format(key='doc_id', t='documents').replace('w as', 'w2 as').replace('from w,', 'from w2,').replace('g as (', 'g2 as (')},
i as (select g, count(*) items from g group by 1) select g2.k as doc_id, count(*) as runs, max(items) as widest, count(*) >= 2 as leaks from g2 join i using (g) group by 1""")
def jn16_gram_probe(spark, d):
    """Documents' word runs looked up in the index of all items' runs."""
    from plumbline.operators.skew import lookup_join

    i = leak.fingerprints(table(spark, d, "eval_items"), "item_id").groupBy("gram").agg(F.count("*").alias("items"))
    n = lookup_join(leak.fingerprints(table(spark, d, "documents"), "doc_id"), i, "gram", i.select("gram", F.col("items").alias("n")), "inner")
    return n.groupBy("doc_id").agg(F.count("*").alias("runs"), F.max("items").alias("widest"), (F.count("*") >= 2).alias("leaks"))


@q("rm27_exclusions", f"""with {_GRAMS.format(key='item_id', t='eval_items')}, s as (select item_id, suite from eval_items), n as (select suite, count(distinct item_id) n from s group by 1),
c as (select suite, g, count(*) c from g join s on s.item_id = g.k group by 1, 2) select suite, count(*) filter (2 * c > n) as shared, count(*) filter (2 * c <= n) as own from c join n using (suite) group by 1""")
def rm27_exclusions(spark, d):
    """Word runs that most of a suite's items share, as its instruction does, and those that a leak test counts."""
    items = table(spark, d, "eval_items")
    s = items.select("item_id", "suite").distinct()
    n = s.groupBy("suite").agg(F.count_distinct("item_id").alias("n"))
    c = leak.fingerprints(items, "item_id").join(s, "item_id").groupBy("suite", "gram").agg(F.count("*").alias("c")).join(n, "suite")
    return c.groupBy("suite").agg(F.count_if(F.expr("2 * c > n")).alias("shared"), F.count_if(F.expr("2 * c <= n")).alias("own"))


@q("lk2_exact_leaks", f"""with {_RECORDS}, i as (select record_id, {_PLAIN} t from r where text <> ''), e as (select doc_id, text from export_records where doc_id is not null),
h as (select distinct doc_id, md5({_PLAIN}) h, text from e where text <> ''), m as (select distinct split_part(text, ' ', 2) mark from r where record_id % 50 = 0 and length(split_part(text, ' ', 2)) > 6)
select distinct doc_id, cast(i.record_id as varchar) as found, 'text' as what from h join i on md5(i.t) = h.h union select distinct doc_id, mark, 'mark' from (select doc_id, unnest(regexp_split_to_array(text, '\\s+')) mark from h) w join m using (mark)""")
def lk2_exact_leaks(spark, d):
    """Documents that are a record's whole text apart from case and marks, or hold a mark as a word (here: second words
    of some records stand in for canaries)."""
    r = records(spark, d)
    marks = r.where("record_id % 50 = 0").select(F.split_part("text", F.lit(" "), F.lit(2)).alias("mark")).where("length(mark) > 6")
    e = table(spark, d, "export_records").where("doc_id is not null").select("doc_id", "text")
    return leak.exact_leaks(e, "doc_id", r, "record_id", marks)


@q("st4_own_grams", f"""with {_GRAMS.format(key='item_id', t='eval_items')}, c as (select g, count(*) n from g group by 1) select k as item_id, count(*) as own from g join c using (g) where n = 1 group by 1""")
def st4_own_grams(spark, d):
    """Each item's word runs that no other item has: shared instructions drop out."""
    g = leak.fingerprints(table(spark, d, "eval_items"), "item_id")
    n = g.groupBy("gram").agg(F.count("*").alias("n")).where("n = 1")
    return g.join(n, "gram", "left_semi").groupBy("item_id").agg(F.count("*").alias("own"))


@q("src3_cache_hits", """with r as (select reply_id, arg_max(request, created_at) request, min(created_at) t0 from llm group by 1),
c as (select sha256(request) k, min((t0, reply_id)) f from r where request is not null group by 1)
select r.reply_id, (r.t0, r.reply_id) > c.f as hit from r join c on sha256(r.request) = c.k""")
def src3_cache_hits(spark, d):
    """A request is answered from the cache if the same one was sent before."""
    r = table(spark, d, "llm").groupBy("reply_id").agg(F.max_by("request", "created_at").alias("request"), F.min("created_at").alias("t0"))
    r = r.where("request is not null").select("reply_id", "t0", F.sha2("request", 256).alias("k"))
    first = r.groupBy("k").agg(F.min(F.struct("t0", "reply_id")).alias("f"))
    return r.join(first, "k").select("reply_id", (F.struct("t0", "reply_id") > F.col("f")).alias("hit"))


@q("src6_ordered_answers", """with r as (select reply_id, arg_max(coalesce(schema_name, ''), created_at) s, arg_max(coalesce(model, ''), created_at) m, sha256(arg_max(coalesce(request, ''), created_at)) h, min(created_at) t0 from llm group by 1)
select reply_id, cast(row_number() over (partition by h, s, m order by t0, reply_id) as int) as kth from r""")
def src6_ordered_answers(spark, d):
    """The k-th answer to the same request, schema and model: what an ordered replay would return next."""
    last = lambda c: F.max_by(F.coalesce(c, F.lit("")), "created_at")
    r = table(spark, d, "llm").groupBy("reply_id").agg(last("schema_name").alias("s"), last("model").alias("m"), F.sha2(last("request"), 256).alias("h"), F.min("created_at").alias("t0"))
    w = Window.partitionBy("h", "s", "m").orderBy("t0", "reply_id")
    return r.select("reply_id", F.row_number().over(w).alias("kth"))


queries, oracle_sql = family.queries, family.oracle_sql
