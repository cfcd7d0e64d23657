"""Queries that check rendered texts: what sentences state, forbidden content, cue scans and review matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.plans.matching import _LAST, last_records
from plumbline.plans.registry import Family
from plumbline.plans.texts import _RECORDS, _SENT, _sentences, records
from plumbline.session import stage, table

family = Family()
q = family.query

# Number words, and the wordings that negate or tell apart.
NUMBERS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve"]
NEGATION = r"\b(not|never|no longer|neither|nor)\b|n['’]t\b"
DIFFERENCE = NEGATION + r"|\b(different|differ\w*|separate\w*|rival|opposing|opposite)\b"
#: Comparisons that the checks read: attribute and whether the first person named is the greater one.
ORDER = {"older": ("age", True), "younger": ("age", False), "taller": ("height", True), "shorter": ("height", False)}
WORDS_OF = {"age": "old|older|young|younger|age|born", "height": "tall|taller|short|shorter|height"}
_NEG_SQL = r"\b(not|never|no longer|neither|nor)\b|n[''’]t\b"
_DIFF_SQL = _NEG_SQL + r"|\b(different|differ\w*|separate\w*|rival|opposing|opposite)\b"
_STATED = r"\b([A-Z][a-z]+) (is|was) (older|younger|taller|shorter) than ([A-Z][a-z]+)"
_ORDERED = f"""o as (select record_id, pos, sentence, regexp_extract(sentence, '{_STATED}', ['a', 'be', 'w', 'b']) e from s),
f as (select record_id, pos, sentence, e.a as a, e.b as b, e.w as w, case when e.w in ('older', 'younger') then 'age' else 'height' end attribute, e.w in ('older', 'taller') up from o where e.a <> '')"""


def ordered(spark, d):
    """Sentences that state an order between two people: (record_id, pos, sentence, a, b, w, attribute, up)."""
    s = _sentences(spark, d)
    part = lambda i, n: F.regexp_extract("sentence", _STATED, i).alias(n)
    f = s.select("record_id", F.col("pos").cast("long").alias("pos"), "sentence", part(1, "a"), part(4, "b"), part(3, "w")).where("a <> ''")
    return f.withColumns({"attribute": F.when(F.col("w").isin("older", "younger"), "age").otherwise("height"), "up": F.col("w").isin("older", "taller")})


def letters(c):
    """Only the letters' runs, a space around each, so that a name is found as a whole word."""
    return F.concat(F.lit(" "), F.regexp_replace(c, "[^A-Za-z]+", " "), F.lit(" "))


_LET = "' ' || regexp_replace({0}, '[^A-Za-z]+', ' ', 'g') || ' '"


@q("sf4_words", f"""with {_RECORDS}, w as (select record_id, trim(regexp_replace(regexp_replace(replace(lower(replace(replace(text, chr(160), ' '), '…', '...')), 'ß', 'ss'), '\\p{{P}}', '', 'g'), '\\s+', ' ', 'g')) t from r)
select record_id, case when t = '' then 0 else len(string_split(t, ' ')) end as words, md5(t) as digest from w""")
def sf4_words(spark, d):
    """Words in compatibility form, caseless and without marks."""
    w = records(spark, d).select("record_id", X.folded_words(F.col("text")).alias("w"))
    return w.select("record_id", F.size("w").cast("long").alias("words"), F.md5(F.array_join("w", " ")).alias("digest"))


@q("sf7_found", f"""with {_LAST}, {_SENT.replace("r as (", "r2 as (").replace("from r)", "from r2)")}, n as (select record_id, pos, trim(regexp_replace(regexp_replace(replace(replace(lower(sentence), chr(160), ' '), '…', '...'), '[“”‘’"'']', '', 'g'), '\\s+', ' ', 'g')) k from s),
d as (select record_id, pos, k from n where pos in (0, 1, 2)), p as (select r.record_id, x.f f from r where x.f is not null), src as (select record_id, x.d d from r where x.d is not null),
hits as (select p.record_id, d.k, max(case when n.k is not null then 1 else 0 end) hit from p join src on src.d = p.f join d on d.record_id = src.record_id left join n on n.record_id = p.record_id and n.k = d.k group by 1, 2)
select record_id, count(*) as sentences, cast(sum(hit) as bigint) as hits, sum(hit) >= least(2, count(*)) as found from hits group by 1""")
def sf7_found(spark, d):
    """Whether a derived record still holds at least two of its source's first three sentences, compared in review form:
    compatibility form, caseless, without quotes."""
    s = _sentences(spark, d).select("record_id", "pos", X.review_form(F.col("sentence")).alias("k"))
    s = stage(s)
    r = stage(last_records(spark, d).select("record_id", "d", "f"))
    pairs_ = r.where("f is not null").select("record_id", F.col("f").alias("d")).join(r.where("d is not null").select("d", F.col("record_id").alias("source")), "d")
    want = pairs_.join(s.where("pos < 3").select(F.col("record_id").alias("source"), "k"), "source").select("record_id", "k").distinct()
    have = s.select("record_id", "k", F.lit(1).alias("hit")).distinct()
    m = want.join(have, ["record_id", "k"], "left").groupBy("record_id").agg(F.count("*").alias("sentences"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"))
    return m.withColumn("found", F.col("hits") >= F.least(F.lit(2), F.col("sentences")))


_NUMBER_MAP = "map {" + ", ".join(f"'{w}': '{i}'" for i, w in enumerate(NUMBERS, 1)) + "}"


@q("sf26_numbers", f"""with {_SENT}, n as (select record_id, pos, list_transform(regexp_extract_all(lower(sentence), '\\b({"|".join(NUMBERS[1:])})\\b|[0-9]+', 0), lambda x: coalesce({_NUMBER_MAP}[x], x)) v, sentence from s)
select record_id, pos, list_sort(list_distinct(v)) as numbers, regexp_matches(lower(sentence), '{_NEG_SQL}') as negated, regexp_matches(lower(sentence), '{_DIFF_SQL}') as differs from n""")
def sf26_numbers(spark, d):
    """Numbers of a sentence as digits, whether it negates, and whether it tells apart."""
    word = F.create_map(*[F.lit(x) for i, w in enumerate(NUMBERS, 1) for x in (w, str(i))])
    s = F.lower("sentence")
    found = F.transform(F.regexp_extract_all(s, F.lit(rf"\b({'|'.join(NUMBERS[1:])})\b|[0-9]+"), 0), lambda x: F.coalesce(word[x], x))
    return _sentences(spark, d).select("record_id", F.col("pos").cast("long").alias("pos"), F.array_sort(F.array_distinct(found)).alias("numbers"), s.rlike(NEGATION).alias("negated"), s.rlike(DIFFERENCE).alias("differs"))


@q("vf2_content", f"""with {_SENT}, {_ORDERED}, g as (select f.record_id, f.pos, f.a, f.b, f.attribute, f.up, s.sentence span from f join s on s.record_id = f.record_id and s.pos = f.pos + case when f.pos % 3 = 0 then 1 else 0 end),
x as (select *, regexp_extract(span, '{_STATED}', ['a', 'be', 'w', 'b']) e, {_LET.format("span")} l from g)
select record_id, pos, not contains(l, ' ' || a || ' ') as lacks_first, not contains(l, ' ' || b || ' ') as lacks_second, regexp_matches(lower(span), '{_NEG_SQL}') as negated,
 case when e.a = '' or (case when e.w in ('older', 'younger') then 'age' else 'height' end) <> attribute then null when e.a = a and e.b = b then (e.w in ('older', 'taller')) = up when e.a = b and e.b = a then (e.w in ('older', 'taller')) <> up end as right_way from x""")
def vf2_content(spark, d):
    """Whether the sentence given for a fact states it: both people named, no negation, the order the right way round.
    For every third fact the sentence after its own is given."""
    s = stage(_sentences(spark, d).select("record_id", F.col("pos").cast("long").alias("at"), F.col("sentence").alias("span")))
    f = ordered(spark, d).withColumn("at", F.col("pos") + F.when(F.col("pos") % 3 == 0, 1).otherwise(0)).drop("sentence", "w")
    x = f.join(s, ["record_id", "at"]).select("*", *[F.regexp_extract("span", _STATED, i).alias(n) for i, n in ((1, "x"), (3, "v"), (4, "y"))])
    up = F.col("v").isin("older", "taller")
    same = F.when(F.col("v").isin("older", "younger"), "age").otherwise("height") == F.col("attribute")
    way = F.when((F.col("x") == "") | ~same, None).when(F.expr("x = a and y = b"), up == F.col("up")).when(F.expr("x = b and y = a"), up != F.col("up"))
    named = lambda c: F.contains(letters(F.col("span")), F.concat(F.lit(" "), F.col(c), F.lit(" ")))
    return x.select("record_id", "pos", (~named("a")).alias("lacks_first"), (~named("b")).alias("lacks_second"), F.lower("span").rlike(NEGATION).alias("negated"), way.alias("right_way"))


_FIRST_ORDER = "p as (select record_id, arg_min({a: a, b: b, attribute: attribute, sentence: sentence}, pos) x from f group by 1)"


@q("vf3_forbidden", f"""with {_SENT}, {_ORDERED}, {_FIRST_ORDER}
select s.record_id, s.pos, contains({_LET.format("s.sentence")}, ' ' || x.a || ' ') as first, contains({_LET.format("s.sentence")}, ' ' || x.b || ' ') as second from s join p using (record_id)
where not contains(s.sentence, x.sentence) and (contains({_LET.format("s.sentence")}, ' ' || x.a || ' ') or contains({_LET.format("s.sentence")}, ' ' || x.b || ' '))
 and case x.attribute when 'age' then regexp_matches(lower(s.sentence), '\\b({WORDS_OF["age"]})\\b') else regexp_matches(lower(s.sentence), '\\b({WORDS_OF["height"]})\\b') end""")
def vf3_forbidden(spark, d):
    """Sentences beside the planted one that name a planted person together with words for the planted attribute."""
    p = ordered(spark, d).groupBy("record_id").agg(F.min_by(F.struct("a", "b", "attribute", F.col("sentence").alias("planted")), "pos").alias("x")).select("record_id", "x.*")
    s = _sentences(spark, d).select("record_id", F.col("pos").cast("long").alias("pos"), "sentence").join(p, "record_id")
    named = lambda c: F.contains(letters(F.col("sentence")), F.concat(F.lit(" "), F.col(c), F.lit(" ")))
    words = F.when(F.col("attribute") == "age", F.lower("sentence").rlike(rf"\b({WORDS_OF['age']})\b")).otherwise(F.lower("sentence").rlike(rf"\b({WORDS_OF['height']})\b"))
    s = s.select("*", named("a").alias("first"), named("b").alias("second")).where(~F.contains("sentence", "planted") & words)
    return s.where("first or second").select("record_id", "pos", "first", "second")


@q("vf5_keywords", f"""with {_SENT}, {_ORDERED}, k as (select distinct record_id, unnest([a, b]) word from f), r1 as (select record_id, {_LET.format("text")} l from r),
c as (select k.record_id, word, (length(l) - length(replace(l, ' ' || word || ' ', ' '))) // (length(word) + 1) n from k join r1 using (record_id))
select record_id, count(*) as required, count(*) filter (n = 0) as missing, count(*) filter (n > 3) as repeated, any_value((length(lower(l)) - length(replace(lower(l), ' perhaps ', ' '))) // 8) as banned from c join r1 using (record_id) group by 1""")
def vf5_keywords(spark, d):
    """Required names of a record: missing, or named more than three times; and how often a banned word stands in it."""
    f = stage(ordered(spark, d).select("record_id", F.explode(F.array("a", "b")).alias("word")).distinct())
    text = records(spark, d).select("record_id", letters(F.col("text")).alias("l"))
    padded = F.concat(F.lit(" "), F.col("word"), F.lit(" "))
    times = ((F.length("l") - F.length(F.replace("l", padded, F.lit(" ")))) / (F.length("word") + 1)).cast("long")
    low = F.lower("l")
    banned = ((F.length(low) - F.length(F.replace(low, F.lit(" perhaps "), F.lit(" ")))) / 8).cast("long")
    c = f.join(text, "record_id").select("record_id", times.alias("n"), banned.alias("banned"))
    return c.groupBy("record_id").agg(F.count("*").alias("required"), F.count_if(F.col("n") == 0).alias("missing"), F.count_if(F.col("n") > 3).alias("repeated"), F.first("banned").alias("banned"))


_PEOPLE = r"\b([A-Z][a-z]+) (?:is|was|met|wrote|judged|arrived|left|counted|keeps)\b"
#: Cues of being the most or least, by attribute and pole.
POLES = [("age", "max", "older of the two"), ("age", "min", "younger of the two"), ("height", "max", "taller of the two"),
         ("height", "min", "shorter of the two"), ("arrival", "min", "arrived before"), ("arrival", "max", "arrived after")]
_CUES = ", ".join(f"('{a}', '{p}', '{c}')" for a, p, c in POLES)
_OWNED = f"""people as (select distinct record_id, unnest(regexp_extract_all(sentence, '{_PEOPLE}', 1)) person from s), cues(attribute, pole, cue) as (values {_CUES}),
hit as (select record_id, pos, sentence, attribute, pole, string_split(trim({_LET.format("split_part(sentence, cue, 1)")}), ' ') before from s join cues on contains(sentence, cue)),
near as (select h.record_id, h.pos, h.attribute, h.pole, b.i, h.before[b.i] person from hit h, lateral (select unnest(range(1, len(before) + 1)) i) b),
own as (select n.record_id, n.pos, n.attribute, n.pole, arg_max(n.person, n.i) owner from near n join people p on p.record_id = n.record_id and p.person = n.person group by 1, 2, 3, 4)"""


def owned_cues(spark, d):
    """(record_id, pos, sentence, attribute, pole, owner): the listed person named last before a cue. The cues are few
    and matched row by row; people are looked up, not multiplied."""
    s = stage(_sentences(spark, d).select("record_id", F.col("pos").cast("long").alias("pos"), "sentence"))
    people = s.select("record_id", F.explode(F.regexp_extract_all("sentence", F.lit(_PEOPLE), 1)).alias("person")).distinct()
    cue = F.explode(F.array_compact(F.array(*[
        F.when(F.contains("sentence", F.lit(c)), F.struct(F.lit(a).alias("attribute"), F.lit(p).alias("pole"), F.split_part("sentence", F.lit(c), F.lit(1)).alias("before"))) for a, p, c in POLES])))
    hit = s.select("record_id", "pos", "sentence", cue.alias("c")).select("record_id", "pos", "sentence", "c.*")
    near = hit.select("record_id", "pos", "sentence", "attribute", "pole", F.posexplode(F.split(F.trim(letters(F.col("before"))), " ")).alias("i", "person"))
    return near.join(people, ["record_id", "person"]).groupBy("record_id", "pos", "sentence", "attribute", "pole").agg(F.max_by("person", "i").alias("owner"))


@q("jn21_sentence_cues", f"""with {_SENT}, {_OWNED} select n.record_id, n.pos, n.attribute, n.pole, n.person, count(*) as times from near n join people p on p.record_id = n.record_id and p.person = n.person group by all""")
def jn21_sentence_cues(spark, d):
    """Sentences, cues and the listed people before them."""
    s = stage(_sentences(spark, d).select("record_id", F.col("pos").cast("long").alias("pos"), "sentence"))
    people = s.select("record_id", F.explode(F.regexp_extract_all("sentence", F.lit(_PEOPLE), 1)).alias("person")).distinct()
    parts = F.array_compact(F.array(*[
        F.when(F.contains("sentence", F.lit(c)), F.struct(F.lit(a).alias("attribute"), F.lit(p).alias("pole"), F.split(F.trim(letters(F.split_part("sentence", F.lit(c), F.lit(1)))), " ").alias("words"))) for a, p, c in POLES]))
    n = s.select("record_id", "pos", F.explode(parts).alias("c")).select("record_id", "pos", "c.attribute", "c.pole", F.explode("c.words").alias("person"))
    return n.join(people, ["record_id", "person"]).groupBy("record_id", "pos", "attribute", "pole", "person").agg(F.count("*").alias("times"))


@q("rm22_cue_owners", f"with {_SENT}, {_OWNED} select * from own")
def rm22_cue_owners(spark, d):
    """Whom a cue is said of."""
    return owned_cues(spark, d).drop("sentence")


@q("rm22_other_sentences", f"""with {_LAST}, {_SENT.replace("r as (", "r2 as (").replace("from r)", "from r2)")}, p as (select r.record_id, src.record_id source from r join (select record_id, x.d d from r) src on src.d = r.x.f)
select s.record_id, s.pos from s join p using (record_id) where not exists (select 1 from s t where t.record_id = p.source and t.sentence = s.sentence)""")
def rm22_other_sentences(spark, d):
    """Sentences of a derived record that its source does not have."""
    r = stage(last_records(spark, d).select("record_id", "d", "f"))
    p = r.where("f is not null").select("record_id", F.col("f").alias("d")).join(r.where("d is not null").select("d", F.col("record_id").alias("source")), "d").select("record_id", "source")
    s = stage(_sentences(spark, d).select("record_id", F.col("pos").cast("long").alias("pos"), "sentence"))
    mine = s.join(p, "record_id")
    return mine.join(s.select(F.col("record_id").alias("source"), "sentence").distinct(), ["source", "sentence"], "left_anti").select("record_id", "pos")


@q("sc1_collisions", f"with {_SENT}, {_OWNED} select record_id, attribute, pole, list_sort(list(distinct owner)) as people from own group by 1, 2, 3 having count(distinct owner) >= 2")
def sc1_collisions(spark, d):
    """Different people of one record of whom the same extreme is said."""
    g = owned_cues(spark, d).groupBy("record_id", "attribute", "pole").agg(F.array_sort(F.collect_set("owner")).alias("people"))
    return g.where(F.size("people") >= 2)


#: Activities that are the same under another word.
ACTIVITIES = {"repair": "mended|repaired|fixed", "carry": "carried|hauled|brought", "measure": "measured|weighed|counted", "trade": "sold|traded|rented"}


@q("sc4_activities", f"""with {_SENT} select record_id, {", ".join(f"count(*) filter (regexp_matches(lower(sentence), '\\b({w})\\b')) as {a}" for a, w in ACTIVITIES.items())} from s group by 1""")
def sc4_activities(spark, d):
    """Sentences of each activity, under any of its words."""
    return _sentences(spark, d).groupBy("record_id").agg(*[F.count_if(F.lower("sentence").rlike(rf"\b({w})\b")).alias(a) for a, w in ACTIVITIES.items()])


@q("sc6_scan_trust", """with s as (select distinct trim(regexp_replace(lower(reviewer), '[\\s_-]+', ' ', 'g')) scan, batch_id, defects, caught from canary_scores)
select scan, count(*) filter (caught = defects) as caught, count(*) filter (caught is distinct from defects) as missed, count(*) filter (defects > 0) > 0 and coalesce(bool_and(caught = defects), true) and count(*) filter (caught is null) = 0 as trusted from s group by 1""")
def sc6_scan_trust(spark, d):
    """A scan is trusted if it was shown canaries and caught every one."""
    key = F.trim(F.regexp_replace(F.lower("reviewer"), r"[\s_-]+", " "))
    s = table(spark, d, "canary_scores").select(key.alias("scan"), "batch_id", "defects", "caught").distinct()
    hit = F.col("caught").eqNullSafe(F.col("defects")) & F.col("caught").isNotNull()
    return s.groupBy("scan").agg(F.count_if(hit).alias("caught"), F.count_if(~hit).alias("missed"), ((F.count_if(F.col("defects") > 0) > 0) & F.bool_and(hit)).alias("trusted"))


@q("rm21_whole_sentences", f"""with {_SENT}, e as (select record_id, pos, sentence from s where pos % 4 = 0), p as (select record_id, sentence, min(pos) first, count(*) n from s group by 1, 2), t as (select record_id, trim(regexp_replace(text, '[\\s\\pZ]+', ' ', 'g')) t from r)
select e.record_id, e.pos, p.first, (length(t) - length(replace(t, e.sentence, ''))) // length(e.sentence) as times, p.n = 1 and (length(t) - length(replace(t, e.sentence, ''))) // length(e.sentence) = 1 as whole
from e join p on p.record_id = e.record_id and p.sentence = e.sentence join t on t.record_id = e.record_id""")
def rm21_whole_sentences(spark, d):
    """Where an exempt sentence stands first, how often its words occur, and whether it is a whole sentence found once."""
    s = stage(_sentences(spark, d).select("record_id", F.col("pos").cast("long").alias("pos"), "sentence"))
    p = s.groupBy("record_id", "sentence").agg(F.min("pos").alias("first"), F.count("*").alias("n"))
    t = records(spark, d).select("record_id", X.normalize_ws(F.col("text")).alias("t"))
    x = s.where("pos % 4 = 0").join(p, ["record_id", "sentence"]).join(t, "record_id")
    times = X.occurrences(F.col("t"), F.col("sentence")).cast("long")
    return x.select("record_id", "pos", "first", times.alias("times"), ((F.col("n") == 1) & (times == 1)).alias("whole"))


@q("rm23_uncertified", """with s as (select distinct trim(regexp_replace(lower(reviewer), '[\\s_-]+', ' ', 'g')) reviewer, batch_id, defects, caught from canary_scores where reviewer is not null)
select reviewer, batch_id, defects, caught, case when defects = 0 then reviewer || ' was shown no defect in ' || batch_id when caught is null then reviewer || ' gave no usable answer in ' || batch_id
 else reviewer || ' caught ' || caught || ' of ' || defects || ' in ' || batch_id end as reason from s where defects = 0 or caught is null or caught * 5 < defects * 4""")
def rm23_uncertified(spark, d):
    """Batches whose reviewer cannot certify documents as clean, and why in words."""
    key = F.trim(F.regexp_replace(F.lower("reviewer"), r"[\s_-]+", " "))
    s = table(spark, d, "canary_scores").where("reviewer is not null").select(key.alias("reviewer"), "batch_id", "defects", "caught").distinct()
    s = s.where("defects = 0 or caught is null or caught * 5 < defects * 4")
    why = (
        F.when(F.col("defects") == 0, F.concat("reviewer", F.lit(" was shown no defect in "), "batch_id"))
        .when(F.col("caught").isNull(), F.concat("reviewer", F.lit(" gave no usable answer in "), "batch_id"))
        .otherwise(F.concat("reviewer", F.lit(" caught "), F.col("caught").cast("string"), F.lit(" of "), F.col("defects").cast("string"), F.lit(" in "), "batch_id"))
    )
    return s.withColumn("reason", why)


@q("rm24_canaries_caught", """with s as (select distinct trim(regexp_replace(lower(reviewer), '[\\s_-]+', ' ', 'g')) reviewer, batch_id, missed, alarms from canary_scores), m as (select reviewer, unnest(missed) canary, 'defect' kind from s union all select reviewer, unnest(alarms), 'clean' from s)
select canary, kind, count(*) as failures, count(distinct split_part(reviewer, ' ', 2)) as providers from m group by 1, 2""")
def rm24_canaries_caught(spark, d):
    """Per canary how often it was missed, or raised a false alarm, and by reviewers of how many providers."""
    key = F.trim(F.regexp_replace(F.lower("reviewer"), r"[\s_-]+", " "))
    s = stage(table(spark, d, "canary_scores").select(key.alias("reviewer"), "batch_id", "missed", "alarms").distinct())
    m = s.select("reviewer", F.explode("missed").alias("canary"), F.lit("defect").alias("kind")).unionByName(s.select("reviewer", F.explode("alarms").alias("canary"), F.lit("clean").alias("kind")))
    return m.groupBy("canary", "kind").agg(F.count("*").alias("failures"), F.count_distinct(F.split_part("reviewer", F.lit(" "), F.lit(2))).alias("providers"))


@q("vf4_measures", f"""with {_SENT}, w as (select record_id, pos, len(string_split(sentence, ' ')) n, regexp_matches(sentence, '[0-9]') cue, length(sentence) - length(replace(replace(replace(sentence, '"', ''), '“', ''), '”', '')) marks from s),
g as (select record_id, pos - lag(pos) over (partition by record_id order by pos) gap from w where cue), lg as (select record_id, min(gap) gap from g group by 1), t as (select record_id, cast(sum(n) as bigint) n, cast(sum(marks) as bigint) marks, count(*) filter (cue) cues, coalesce(max(pos) filter (cue) - min(pos) filter (cue), 0) reach from w group by 1)
select record_id, n as words, n between 100 - 25 and 100 + 25 as length_fits, marks % 2 = 0 as quotes_close, coalesce(lg.gap >= 2, true) as spaced, cues < 2 or reach >= 5 as spread from t left join lg using (record_id)""")
def vf4_measures(spark, d):
    """A text's length against a target of a hundred words, its quotation marks, and how its cues are spaced and spread."""
    from pyspark.sql import Window

    low, high = X.length_range(F.lit(100))
    s = _sentences(spark, d).select("record_id", F.col("pos").cast("long").alias("pos"), F.size(F.split("sentence", " ")).alias("n"), F.col("sentence").rlike("[0-9]").alias("cue"),
                                    (F.length("sentence") - F.length(F.regexp_replace("sentence", '["“”]', ""))).alias("marks"))
    cue_pos = F.when(F.col("cue"), F.col("pos"))
    before = F.last(cue_pos, True).over(Window.partitionBy("record_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("gap", cue_pos - before).withColumn("at", cue_pos)
    g = s.groupBy("record_id").agg(F.sum("n").alias("words"), F.sum("marks").alias("marks"), F.count("at").alias("cues"), F.coalesce(F.max("at") - F.min("at"), F.lit(0)).alias("reach"), F.min("gap").alias("gap"))
    return g.select("record_id", "words", F.col("words").between(low, high).alias("length_fits"), (F.col("marks") % 2 == 0).alias("quotes_close"),
                    F.coalesce(F.col("gap") >= 2, F.lit(True)).alias("spaced"), ((F.col("cues") < 2) | (F.col("reach") >= 5)).alias("spread"))


queries, oracle_sql = family.queries, family.oracle_sql
