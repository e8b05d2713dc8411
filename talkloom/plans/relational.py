"""Queries over whole tables, with their SQL. A key names the operator rows of the survey that it exercises."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import LATIN
from ..functions import text as fx
from ..functions import vectors
from ..operators import conversation as conv
from ..operators import pairing, quality, retrieval, selection, stats, tables
from ..session import table
from .. import fixed
from .scalars import BEST_SQL, CLAR, CONTEXT_SQL, HAS, SCORE_SQL, SWITCH_SQL, TAG, SCRIPT_CHARS, THREE_WAY_SQL, TOKENS, WORDS, S, sql_any, sql_list

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Registers a query whose arguments name the tables it reads."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        names = f.__code__.co_varnames[: f.__code__.co_argcount]
        FOUND[f.__name__] = (lambda spark, sf_dir: f(*[table(spark, sf_dir, n) for n in names]), sql)
        return f

    return register


# --- pairing and windows

PAIRS = """
with m as (select *, role = 'assistant' as is_owner from conversations),
r as (select *, sum(case when coalesce(lag_owner, true) then 1 else 0 end) over (partition by conv_id order by turn) as run
      from (select *, lag(is_owner) over (partition by conv_id order by turn) as lag_owner from m)),
g as (select conv_id, run, string_agg(text, chr(10) order by turn) filter (not is_owner) as input, count(*) filter (not is_owner) as n_messages,
      max(turn) filter (is_owner) as reply_order, max_by(text, turn) filter (is_owner) as reply from r group by all)
select conv_id, reply_order, input, reply, n_messages from g where reply_order is not null and n_messages > 0
"""


@query(f"""
with pairs as ({PAIRS}),
scored as (select p.*, case when regexp_matches(reply, '{S}') then 'te' else 'en' end as lang, substr(sha256(reply || input), 1, 16) as hash,
    cast({SCORE_SQL.replace('(text', '(reply').replace('text)', 'reply)').replace(' text ', ' reply ')} as int) as score from pairs p),
firsts as (select * from (select *, row_number() over (partition by hash order by conv_id, reply_order) as n from scored) where n = 1)
select lang, case when score >= 80 then 'excellent' when score >= 60 then 'good' when score >= 40 then 'fair' else 'poor' end as bucket,
    count(*) as n, round(avg(score), 6) as avg_score, cast(sum(n_messages) as bigint) as messages from firsts group by all
""")
def flagship_curation(conversations: DataFrame) -> DataFrame:
    """Turns to reply pairs, scored, deduplicated and counted."""
    pairs = pairing.reply_pairs(conversations.withColumn("is_owner", F.col("role") == "assistant"), None, "conv_id", "turn", "turn")
    reply = F.col("reply")
    scored = pairs.withColumn("lang", fx.lang_two_way(reply, LATIN)).withColumn("hash", fx.content_hash("reply", "input")).withColumn("score", quality.quality_score(reply, fx.is_script_related(reply), reply.contains("?"), LATIN))
    firsts = selection.first_of_each(scored, ["hash"], [F.col("conv_id"), F.col("reply_order")])
    named = firsts.withColumn("bucket", stats.bucket(F.col("score"), [(80, "excellent"), (60, "good"), (40, "fair")], "poor"))
    return named.groupBy("lang", "bucket").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("avg_score"), F.sum("n_messages").alias("messages"))


@query(PAIRS.replace("n_messages from g", "cast(n_messages as int) as n_messages from g"))
def win1_reply_pairs(conversations: DataFrame) -> DataFrame:
    return pairing.reply_pairs(conversations.withColumn("is_owner", F.col("role") == "assistant"), None, "conv_id", "turn", "turn")


@query("""
with m as (select *, event_type = 'purchase' as is_owner from events),
l as (select *, lag(is_owner) over w as lo, lag(ts) over w as lt from m window w as (partition by user_id order by event_id)),
r as (select *, sum(case when coalesce(lo, true) or ts - lt > interval 720 minute then 1 else 0 end) over (partition by user_id order by event_id) as run from l),
g as (select user_id, run, string_agg(event_type, chr(10) order by event_id) filter (not is_owner) as input, count(*) filter (not is_owner) as n, max(event_id) filter (is_owner) as reply_order from r group by all)
select user_id, reply_order, input, 'purchase' as reply, cast(n as int) as n_messages from g where reply_order is not null and n > 0
""")
def win1_burst_reply(events: DataFrame) -> DataFrame:
    return pairing.reply_pairs(events.withColumn("is_owner", F.col("event_type") == "purchase"), 720 * 60, "user_id", "event_id", "ts", "is_owner", "event_type")


@query("""
with n as (select event_id, user_id, count(*) over (partition by user_id) as n, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events),
c as (select *, greatest(ceil(n * 0.1), case when n >= 5 then 1 else 0 end) as c from n)
select event_id, user_id, case when r <= case when c >= n then case when n > 1 then greatest(1, n // 5) else n end else c end then 'val' else 'train' end as split from c
""")
def win2_holdout(events: DataFrame) -> DataFrame:
    return pairing.holdout(events.select("event_id", "user_id", "ts"), 0.1, "user_id", "ts", "event_id").select("event_id", "user_id", "split")


@query("""
with f as (select user_id, event_type as name_key, min(event_id) as first from events where event_type not in ('purchase') group by all)
select user_id, name_key, '{NAME_' || chr(cast(65 + (row_number() over (partition by user_id order by first, name_key) - 1) % 26 as int)) || '}' as placeholder from f
""")
def fn16_win4_name_map(events: DataFrame) -> DataFrame:
    return pairing.name_map(events, ["purchase"], "user_id", "event_id", "event_type")


@query("""
with f as (select user_id, event_type as name_key, min(event_id) as first from events where event_type not in ('purchase') group by all),
p as (select user_id, name_key, '{NAME_' || chr(cast(65 + (row_number() over (partition by user_id order by first, name_key) - 1) % 26 as int)) || '}' as placeholder from f)
select e.event_id, e.user_id, coalesce(p.placeholder, e.event_type) as shown from events e left join p on p.user_id = e.user_id and p.name_key = e.event_type
""")
def jn12_named_speakers(events: DataFrame) -> DataFrame:
    names = pairing.name_map(events, ["purchase"], "user_id", "event_id", "event_type")
    return pairing.with_placeholders(events, names, "user_id", "event_type").select("event_id", "user_id", "shown")


@query("select doc_id, md5(regexp_replace(regexp_replace(text, '(?i)the', '{NAME_A}', 'g'), '(?i)und', '{NAME_B}', 'g')) as redacted from documents")
def fn17_redact_names(documents: DataFrame) -> DataFrame:
    names = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("placeholder")) for n, p in (("the", "{NAME_A}"), ("und", "{NAME_B}"))])
    return documents.select("doc_id", F.md5(fx.redact_names(F.col("text"), names).cast("binary")).alias("redacted"))


@query("select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn desc) as n from conversations) where n <= 2")
def win7_last_turns(conversations: DataFrame) -> DataFrame:
    return selection.last_n(conversations, "conv_id", "turn", 2).select("conv_id", "turn", "role")


@query("""select conv_id, turn, cast(running as bigint) as running from
    (select *, sum(length(text) // 4) over (partition by conv_id order by turn desc rows unbounded preceding) as running from conversations) where running <= 300""")
def win8_token_budget(conversations: DataFrame) -> DataFrame:
    return selection.within_budget(conversations, "conv_id", "turn", fx.tokens_by_chars(F.col("text")), 300).select("conv_id", "turn", "running")


@query("""select o_orderkey, o_custkey, round(coalesce((lag(o_totalprice) over w + o_totalprice) / 2, o_totalprice - 1), 6) as slot_before,
    round(coalesce((o_totalprice + lead(o_totalprice) over w) / 2, o_totalprice + 1), 6) as slot_after from orders window w as (partition by o_custkey order by o_totalprice)""")
def win9_ret9_midpoints(orders: DataFrame) -> DataFrame:
    rows = orders.select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("double").alias("p"))
    return tables.midpoint_order(rows, "o_custkey", "p").select("o_orderkey", "o_custkey", F.round("slot_before", 6).alias("slot_before"), F.round("slot_after", 6).alias("slot_after"))


@query("""with g as (select event_id, user_id, event_type <> 'error' as speech, sum(case when event_type <> 'error' then 1 else 0 end) over (partition by user_id order by event_id) as g from events)
    select event_id, user_id, cast(sum(case when speech then 0 else 1 end) over (partition by user_id, g order by event_id rows unbounded preceding) as bigint) as run_length from g""")
def win10_silence_runs(events: DataFrame) -> DataFrame:
    rows = events.select("event_id", "user_id", (F.col("event_type") != "error").alias("speech"))
    return selection.islands(rows, "user_id", "event_id", "speech").select("event_id", "user_id", "run_length")


@query("""select event_id, user_id, round(avg(case when event_type <> 'error' then 1.0 else 0.0 end) over (partition by user_id order by event_id rows between 29 preceding and current row), 6) as voiced from events""")
def win11_ag28_voiced_share(events: DataFrame) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-29, 0)
    return events.select("event_id", "user_id", F.round(F.avg((F.col("event_type") != "error").cast("double")).over(w), 6).alias("voiced"))


@query("""select * from (select o_custkey, o_orderkey as "from", lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as "to", 'sequence' as kind from orders) where "to" is not null""")
def win12_sequence_links(orders: DataFrame) -> DataFrame:
    rows = orders.select("o_custkey", "o_orderkey", F.struct("o_orderdate", "o_orderkey").alias("place"))
    return tables.linked_neighbours(rows, "o_custkey", "place", "o_orderkey")


@query("""select event_id, user_id, last_value(case when event_type in ('signup', 'purchase') then event_type end ignore nulls) over (partition by user_id order by event_id rows unbounded preceding) as context from events""")
def win13_sticky_context(events: DataFrame) -> DataFrame:
    rows = events.select("event_id", "user_id", F.when(F.col("event_type").isin("signup", "purchase"), F.col("event_type")).alias("own"))
    return selection.carry_forward(rows, "user_id", "event_id", "own", "context").select("event_id", "user_id", "context")


@query("""with l as (select *, lag(ts) over (partition by user_id order by ts) as lt from events),
    s as (select *, sum(case when lt is null or ts - lt >= interval 1800 second then 1 else 0 end) over (partition by user_id order by ts) as session from l)
    select user_id, cast(session as bigint) as session, min(ts) as start, max(ts) as "end", count(*) as n from s group by all""")
def str2_sessions(events: DataFrame) -> DataFrame:
    return selection.sessions(events, "user_id", "ts", 1800)


CONTEXTS_SQL = f"""with m as (select conv_id, turn, ['', 'scene script dialogue write ', 'scene act ', 'go to kitchen now ', 'oven recipe cook bake fry ', ''][(conv_id + turn) % 6 + 1] || text as text, case when turn % 7 = 3 then 'Kitchen table' else '' end as place, row_number() over (partition by conv_id order by turn) as k from conversations),
    s as (select *, {SWITCH_SQL} as sw, case when contains(lower(place), 'kitchen') then 'kitchen' end as pl, {CONTEXT_SQL} as word, {BEST_SQL} as score from m),
    o as (select *, word is not null and (score > 0.7 or (score > 0.5 and k = 1)) as strong from s), c as (select *, coalesce(sw, pl, case when strong then word end, case when k = 1 then 'writers_room' end) as own from o)
    select conv_id, turn, last_value(own ignore nulls) over (partition by conv_id order by turn rows unbounded preceding) as context, round(case when sw is not null then 1.0 when pl is not null then 0.9 when strong then score when k = 1 then 0.5 else 0.6 end, 6) as confidence from c"""


@query(CONTEXTS_SQL)
def cls1_contexts(conversations: DataFrame) -> DataFrame:
    said = F.array(*[F.lit(x) for x in ("", "scene script dialogue write ", "scene act ", "go to kitchen now ", "oven recipe cook bake fry ", "")])
    turns = conversations.withColumn("text", F.concat(F.get(said, ((F.col("conv_id") + F.col("turn")) % 6).cast("int")), "text")).withColumn("place", F.when(F.col("turn") % 7 == 3, "Kitchen table"))
    found = conv.detect_contexts(turns, "conv_id", "turn", "text", "place")
    return found.select("conv_id", "turn", "context", F.round("confidence", 6).alias("confidence"))


# --- selection

QUOTAS = {"en": 300, "fr": 60, "de": 50}


@query("""with h as (select doc_id, lang, sha256('42:' || doc_id) as h from documents), r as (select *, row_number() over (partition by lang order by h, doc_id) as n from h),
    q as (select *, n > coalesce(case lang when 'en' then 300 when 'fr' then 60 when 'de' then 50 end, 0) as late from r)
    select doc_id, lang from q order by late, h, doc_id limit 500""")
def smp1_stratified(documents: DataFrame) -> DataFrame:
    return selection.stratified(documents.select("doc_id", "lang"), "lang", QUOTAS, 500, "doc_id")


@query(f"""with d as (select doc_id, length(text) as l, {TAG} as p from documents), n as (select *, row_number() over (partition by p order by l desc, doc_id) as n, count(*) over (partition by p) as c from d)
    select doc_id, cast(l as int) as l from n where p or n <= c // 2 order by case when p then 0 else 1 end, case when p then '' else sha256('42:' || doc_id) end, doc_id limit 300""")
def smp2_priority_longest(documents: DataFrame) -> DataFrame:
    rows = documents.select("doc_id", F.length("text").alias("l"), fx.is_script_related(F.col("text")).alias("p"))
    return selection.priority_then_longest(rows, F.col("p"), F.col("l"), 300, "doc_id").select("doc_id", "l")


@query("""with d as (select doc_id, source, n_chars as score from documents), s as (select source, count(*) as size, min(doc_id) as first, sum(count(*)) over () as total from d group by source),
    r as (select d.*, s.first, row_number() over (partition by d.source order by score desc, doc_id) as n, greatest(1, floor(350 * (size::double / total) * 1.2::double)) as quota from d join s using (source))
    select doc_id, source, score from r where n <= quota order by first, n limit 350""")
def win5_smp3_quota_top(documents: DataFrame) -> DataFrame:
    return selection.quota_top(documents.select("doc_id", "source", F.col("n_chars").alias("score")), "source", "score", "doc_id", 350)


@query("""with d as (select doc_id, sha256('42:' || doc_id) as h from documents)
    select doc_id, case when row_number() over (order by h, doc_id) <= greatest(1, floor(count(*) over () * 0.1)) then 'val' else 'train' end as split from d""")
def smp5_split(documents: DataFrame) -> DataFrame:
    return selection.split_shuffled(documents.select("doc_id"), "doc_id", 0.1)


@query("select doc_id, sha256('42:' || doc_id) as position from documents")
def smp4_shuffled(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", selection.drawn(F.col("doc_id")).alias("position"))


@query("select substr(sha256(text), 1, 16) as hash, min(doc_id) as doc_id from documents group by 1")
def set4_fn27_dedup(documents: DataFrame) -> DataFrame:
    rows = documents.select("doc_id", fx.content_hash("text").alias("hash"))
    return selection.first_of_each(rows, ["hash"], [F.col("doc_id")]).select("hash", "doc_id")


@query("""with u as (select doc_id, sha256(text) as h, source as src from documents), r as (select *, row_number() over (partition by h order by src, doc_id) > 1 as is_dup from u)
    select src, count(*) as loaded, count(*) filter (not is_dup) as added, count(*) filter (is_dup) as duplicates from r group by src""")
def win6_ag17_source_report(documents: DataFrame) -> DataFrame:
    rows = documents.select("doc_id", F.sha2("text", 256).alias("h"), F.col("source").alias("src"))
    marked = selection.mark_duplicates(rows, ["h"], ["src", "doc_id"])
    return marked.groupBy("src").agg(F.count("*").alias("loaded"), F.count_if(~F.col("is_dup")).alias("added"), F.count_if("is_dup").alias("duplicates"))


@query("select case when lang = 'es' then null else lang end as k, min(doc_id) as doc_id from documents group by 1")
def set3_dedup_null_key(documents: DataFrame) -> DataFrame:
    rows = documents.select("doc_id", F.when(F.col("lang") != "es", F.col("lang")).alias("k"))
    return selection.first_of_each(rows, ["k"], [F.col("doc_id")]).select("k", "doc_id")


@query("select count(*) - count(distinct sha256(text)) as duplicates from documents")
def ag10_duplicates(documents: DataFrame) -> DataFrame:
    return stats.duplicate_count(documents, F.sha2("text", 256))


# --- aggregates


@query("select lang, source, count(*) as n from documents group by all")
def ag1_counts(documents: DataFrame) -> DataFrame:
    return documents.groupBy("lang", "source").agg(F.count("*").alias("n"))


TAGS_SQL = f"list_filter(['persona', 'chat', case when {TAG} then 'script' end, case when {CLAR} then 'clarifying' end], lambda x: x is not null)"


@query(f"with t as (select unnest({TAGS_SQL}) as label from documents) select label, count(*) as n, round(count(*) / (select count(*)::double from documents), 3) as share from t group by 1")
def ag2_ag3_tag_fractions(documents: DataFrame) -> DataFrame:
    text = F.col("text")
    tags = F.filter(F.array(F.lit("persona"), F.lit("chat"), F.when(fx.is_script_related(text), "script"), F.when(text.contains("?"), "clarifying")), lambda x: x.isNotNull())
    return stats.tag_fractions(documents, tags)


@query("select lang as label, count(*) as n, round(count(*) / (select count(*)::double from documents), 3) as share from documents group by 1")
def ag3_language_mix(documents: DataFrame) -> DataFrame:
    return stats.fractions(documents, F.col("lang"))


@query("select source, lang, count(*) as n from documents group by rollup (source, lang)")
def ag3_mix_rollup(documents: DataFrame) -> DataFrame:
    return documents.rollup("source", "lang").agg(F.count("*").alias("n"))


@query(f"with s as (select {SCORE_SQL} as s from documents) select case when s >= 80 then 'excellent' when s >= 60 then 'good' when s >= 40 then 'fair' else 'poor' end as bucket, count(*) as n from s group by 1")
def ag4_score_buckets(documents: DataFrame) -> DataFrame:
    text = F.col("text")
    score = quality.quality_score(text, fx.is_script_related(text), text.contains("?"), LATIN)
    return documents.select(stats.bucket(score, [(80, "excellent"), (60, "good"), (40, "fair")], "poor").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


@query(f"with w as (select len({WORDS}) as w from documents) select case when w > 50 then 'over_50' when w >= 21 then 'to_50' when w >= 6 then 'to_20' else 'to_5' end as bucket, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 1) as pct from w group by 1")
def ag5_length_buckets(documents: DataFrame) -> DataFrame:
    counts = documents.select(stats.bucket(fx.word_count(F.col("text")), [(51, "over_50"), (21, "to_50"), (6, "to_20")], "to_5").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    total = documents.agg(F.count("*")).scalar()
    return counts.select("bucket", "n", F.round(100.0 * F.col("n") / total, 1).alias("pct"))


@query(f"select source, min(n_chars) as min_chars, max(n_chars) as max_chars, round(avg(n_chars), 6) as avg_chars, cast(sum(n_chars) // count(*) as bigint) as whole_mean, round(avg(len({WORDS})), 6) as avg_words from documents group by 1")
def ag6_ag7_lengths(documents: DataFrame) -> DataFrame:
    return documents.groupBy("source").agg(F.min("n_chars").alias("min_chars"), F.max("n_chars").alias("max_chars"), F.round(F.avg("n_chars"), 6).alias("avg_chars"), F.expr("sum(n_chars) div count(*)").alias("whole_mean"), F.round(F.avg(fx.word_count(F.col("text"))), 6).alias("avg_words"))


@query("""with r as (select lang, length(text) // 4 as v, row_number() over (partition by lang order by length(text) // 4) - 1 as i, count(*) over (partition by lang) as n from documents),
    p as (select unnest([0.5, 0.75, 0.9, 0.95, 0.99])::double as p)
    select lang, p, v as value from r join p on i = least(floor(n * p), n - 1)""")
def ag8_nearest_rank(documents: DataFrame) -> DataFrame:
    return stats.nearest_rank(documents.select("lang", fx.tokens_by_chars(F.col("text")).alias("v")), "v", [0.5, 0.75, 0.9, 0.95, 0.99], "lang")


@query("select lang, cast(floor(median(n_chars)) as int) as median_chars, cast(floor(avg(n_chars)) as int) as mean_chars from documents group by 1")
def ag9_median(documents: DataFrame) -> DataFrame:
    return documents.groupBy("lang").agg(F.percentile("n_chars", 0.5).cast("int").alias("median_chars"), F.avg("n_chars").cast("int").alias("mean_chars"))


@query("select count(distinct substr(text, 1, 100)) as openings, count(distinct substr(text, 1, 100)) <= 3 as few from documents")
def ag11_openings(documents: DataFrame) -> DataFrame:
    return documents.agg(F.countDistinct(F.substring("text", 1, 100)).alias("openings")).withColumn("few", F.col("openings") <= 3)


@query("select role, count(*) filter (length(text) >= 200) as long_turns, count(*) as turns, round(100.0 * count(*) filter (length(text) >= 200) / count(*), 1) as pct from conversations group by 1")
def ag12_ag14_rates(conversations: DataFrame) -> DataFrame:
    return conversations.groupBy("role").agg(F.count_if(F.length("text") >= 200).alias("long_turns"), F.count("*").alias("turns")).withColumn("pct", F.coalesce(F.round(100.0 * F.try_divide("long_turns", "turns"), 1), F.lit(0.0)))


@query("""with k as (select lang as topic from documents union all select 'tag:' || source from documents) select topic, count(*) as n from k group by 1 order by n desc, topic limit 20""")
def ag15_topics(documents: DataFrame) -> DataFrame:
    keys = documents.select(F.explode(F.array(F.col("lang"), F.concat(F.lit("tag:"), F.col("source")))).alias("topic"))
    return stats.top_counts(keys, ["topic"], 20)


@query(f"""with k as (select case when doc_id % 40 < 7 then [{sql_list(fixed.TOPICS)}][doc_id % 40 + 1] else 'other' end as topic from documents union all select 'tag:' || case when doc_id % 20 < 3 then [{sql_list(fixed.TOPICS)}][doc_id % 20 + 1] else 'x' end from documents),
    w as (select unnest([{sql_list(fixed.TOPICS)}]) as gap), n as (select gap, count(topic)::double as value from w left join k on topic = gap or topic = 'tag:' || gap group by 1), te as (select 100.0 * count(*) filter (doc_id % 4 = 0) / count(*) as value from documents)
    select gap, value from n where value < 50 union all select 'lang:te', value::double from te where value < 30""")
def ag16_gaps(documents: DataFrame) -> DataFrame:
    listed = F.array(*[F.lit(t) for t in fixed.TOPICS])
    topic = lambda k: F.coalesce(F.get(listed, (F.col("doc_id") % k).cast("int")), F.lit("other"))
    tag = F.when(F.col("doc_id") % 20 < 3, topic(20)).otherwise("x")
    topics = documents.select(F.explode(F.array(topic(40), F.concat(F.lit("tag:"), tag))).alias("topic"))
    return stats.gaps(topics, documents.select(F.when(F.col("doc_id") % 4 == 0, "te").otherwise("en").alias("lang")), "te")


@query("""with b as (select 1 as batch, ['src0', 'src1'] as topics union all select 2, ['src0', 'src1', 'src2', 'src3'] union all select 3, ['src0', 'src1', 'src2', 'src3', 'src4', 'src5'])
    select batch, count(*) as n, count(distinct source) as topics from b join documents on list_contains(b.topics, source) group by 1""")
def ag18_jn17_batches(documents: DataFrame) -> DataFrame:
    batches = documents.sparkSession.createDataFrame([(k, [f"src{i}" for i in range(2 * k)]) for k in (1, 2, 3)], "batch int, topics array<string>")
    rows = batches.select("batch", F.explode("topics").alias("source"))
    return documents.select("source").join(rows, "source").groupBy("batch").agg(F.count("*").alias("n"), F.countDistinct("source").alias("topics"))


@query("select n_name, count(c_custkey) as customers from nation left join customer on n_nationkey = c_nationkey group by 1")
def ag19_children(nation: DataFrame, customer: DataFrame) -> DataFrame:
    return nation.join(customer, F.col("n_nationkey") == F.col("c_nationkey"), "left").groupBy("n_name").agg(F.count("c_custkey").alias("customers"))


@query("select conv_id, cast(sum(length(text) // 4) as bigint) as tokens, count(distinct role) as roles from conversations group by 1")
def ag21_ag25_memory(conversations: DataFrame) -> DataFrame:
    return conversations.groupBy("conv_id").agg(F.sum(fx.tokens_by_chars(F.col("text"))).alias("tokens"), F.size(F.collect_set("role")).cast("long").alias("roles"))


@query("""with h as (select conv_id, text, turn, row_number() over (partition by conv_id order by turn) as n, count(*) over (partition by conv_id) as c from conversations),
    w as (select distinct conv_id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: length(x) > 4)) as w from h where n <= c // 2),
    r as (select *, row_number() over (partition by conv_id order by w) as k from w)
    select conv_id, string_agg(w, ',' order by w) as topics from r where k <= 10 group by 1""")
def ag26_topics(conversations: DataFrame) -> DataFrame:
    w = Window.partitionBy("conv_id")
    half = conversations.withColumn("n", F.row_number().over(w.orderBy("turn"))).withColumn("c", F.count("*").over(w)).filter(F.col("n") <= F.floor(F.col("c") / 2))
    return half.groupBy("conv_id").agg(F.concat_ws(",", conv.topic_words(F.collect_list("text"))).alias("topics")).filter("topics != ''")


@query("select 'documents' as name, count(*) as n from documents union all select 'labels', count(*) from labels union all select 'events', count(*) from events")
def ag29_row_counts(documents: DataFrame, labels: DataFrame, events: DataFrame) -> DataFrame:
    one = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return one("documents", documents).union(one("labels", labels)).union(one("events", events))


@query("select event_type, count(*) as n from events group by 1 order by n desc, event_type limit 3")
def srt6_most_common(events: DataFrame) -> DataFrame:
    return stats.top_counts(events, ["event_type"], 3)


@query("select user_id, event_type, n, cast(rank as int) as rank from (select user_id, event_type, count(*) as n, row_number() over (partition by user_id order by count(*) desc, event_type) as rank from events group by 1, 2) where rank <= 3")
def par5_top_speakers(events: DataFrame) -> DataFrame:
    return stats.top_counts(events, ["event_type"], 3, ["user_id"])


@query("select doc_id, source, cast(n as int) as place from (select *, row_number() over (partition by source order by doc_id) as n from documents) where n <= 25")
def srt8_first_of_source(documents: DataFrame) -> DataFrame:
    w = Window.partitionBy("source").orderBy("doc_id")
    return documents.select("doc_id", "source", F.row_number().over(w).alias("place")).filter("place <= 25")


# --- joins and table changes


@query("select c.c_custkey, c.c_name, n.n_name from customer c join nation n on c.c_nationkey = n.n_nationkey where n.n_nationkey = 3")
def jn1_children_of_slug(customer: DataFrame, nation: DataFrame) -> DataFrame:
    return customer.join(nation.filter("n_nationkey = 3"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name")


@query("select r_name, n_name, count(*) as customers from region join nation on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey group by all")
def jn2_three_way(region: DataFrame, nation: DataFrame, customer: DataFrame) -> DataFrame:
    return region.join(nation, F.col("n_regionkey") == F.col("r_regionkey")).join(customer, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name", "n_name").agg(F.count("*").alias("customers"))


@query("""select c_custkey, coalesce(string_agg(cast(o_orderkey as varchar), ',' order by o_orderkey), '') as orders from customer left join orders on o_custkey = c_custkey group by 1""")
def jn3_jn5_ag23_nested(customer: DataFrame, orders: DataFrame) -> DataFrame:
    nested = tables.nested(customer.select("c_custkey"), orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice"), "c_custkey", "o_orderkey", ["o_orderkey", "o_totalprice"], "found")
    return nested.select("c_custkey", F.concat_ws(",", F.transform("found", lambda x: x["o_orderkey"].cast("string"))).alias("orders"))


@query("""select o_orderkey, upper(o_orderstatus) || ' ' || upper(o_orderpriority) || coalesce(chr(10) || string_agg('Line ' || l_linenumber || ': part ' || l_partkey, chr(10) order by l_linenumber, cast(l_partkey as varchar)), '') as text
    from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey, o_orderstatus, o_orderpriority""")
def fn33_fn34_scene_text(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    lines = lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    line = F.concat(F.lit("Line "), F.col("l_linenumber").cast("string"), F.lit(": part "), F.col("l_partkey").cast("string"))
    return tables.compose_text(orders.select("o_orderkey", "o_orderstatus", "o_orderpriority"), lines, "o_orderkey", "l_linenumber", line, fx.scene_heading(F.col("o_orderstatus"), F.col("o_orderpriority")))


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def jn6_jn9_set8_absent(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return tables.insert_absent(labels, documents.select("doc_id"), ["doc_id"])


@query("select count(*) as n from orders where o_custkey in (select c_custkey from customer where c_acctbal > 0)")
def jn11_membership(orders: DataFrame, customer: DataFrame) -> DataFrame:
    return orders.join(customer.filter("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").agg(F.count("*").alias("n"))


@query("""select d.lang, l.quality, l.toxic, count(*) as n, round(avg(d.n_chars), 6) as avg_chars from labels l join documents d using (doc_id) group by all""")
def jn16_results(labels: DataFrame, documents: DataFrame) -> DataFrame:
    return labels.join(documents.select("doc_id", "lang", "n_chars"), "doc_id").groupBy("lang", "quality", "toxic").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("avg_chars"))


OLD = "select doc_id, n_chars as size, 'old' as created from documents where doc_id % 3 <> 0"
NEW = "select doc_id, n_chars + 1 as size, 'new' as created from documents where doc_id % 2 = 0 or doc_id % 3 = 0"


def _old(documents: DataFrame) -> DataFrame:
    return documents.filter("doc_id % 3 <> 0").select("doc_id", F.col("n_chars").alias("size"), F.lit("old").alias("created"))


def _new(documents: DataFrame) -> DataFrame:
    return documents.filter("doc_id % 2 = 0 or doc_id % 3 = 0").select("doc_id", (F.col("n_chars") + 1).alias("size"), F.lit("new").alias("created"))


@query(f"with o as ({OLD}), n as ({NEW}) select coalesce(n.doc_id, o.doc_id) as doc_id, coalesce(n.size, o.size) as size, coalesce(o.created, n.created) as created from o full join n on o.doc_id = n.doc_id")
def snk6_upsert(documents: DataFrame) -> DataFrame:
    return tables.upsert(_old(documents), _new(documents), "doc_id", ("created",))


@query(f"with o as ({OLD}), n as ({NEW}) select n.doc_id, n.size, coalesce(o.created, n.created) as created from n left join o on o.doc_id = n.doc_id")
def snk7_jn10_registry(documents: DataFrame) -> DataFrame:
    return tables.upsert(_old(documents), _new(documents), "doc_id", ("created",), replace=True)


@query(f"with o as ({OLD}), n as ({NEW}) select * from o union all select * from n where doc_id not in (select doc_id from o)")
def snk8_insert_absent(documents: DataFrame) -> DataFrame:
    return _old(documents).unionByName(tables.insert_absent(_old(documents), _new(documents), ["doc_id"]).select("doc_id", "size", "created"))


@query("select doc_id, case when doc_id % 4 = 0 then length(text) else n_chars end as n, doc_id % 4 = 0 as filled from documents")
def snk9_fill(documents: DataFrame) -> DataFrame:
    rows = documents.select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("n_chars")).alias("n"), "text")
    return tables.fill_missing(rows, "n", F.length("text").cast("long")).select("doc_id", "n", "filled")


@query("select doc_id, source, n_chars from documents where source not in ('src1', 'src2') union all select doc_id, source, 0 from documents where source in ('src1', 'src2') and doc_id % 3 = 0")
def snk10_snk16_replace(documents: DataFrame) -> DataFrame:
    rows = documents.select("doc_id", "source", "n_chars")
    new = rows.filter("source in ('src1', 'src2') and doc_id % 3 = 0").withColumn("n_chars", F.lit(0).cast("long"))
    return tables.replace_group(rows, new, "source").select("doc_id", "source", "n_chars")


@query("select doc_id, case when source = 'src1' then 'xx' else lang end as lang, source = 'src1' as changed from documents")
def snk11_patch(documents: DataFrame) -> DataFrame:
    return tables.patch(documents.select("doc_id", "source", "lang"), F.col("source") == "src1", {"lang": F.lit("xx")}).select("doc_id", "lang", "changed")


@query("select l_orderkey, coalesce(max(l_linenumber), -1) + 1 as next_index from lineitem group by 1")
def snk12_next_index(lineitem: DataFrame) -> DataFrame:
    return tables.next_index(lineitem, "l_orderkey", "l_linenumber")


@query("select a, b, 'sequence' as kind from (select doc_id as a, doc_id + 7 as b from documents) where b in (select doc_id from documents)")
def snk13_ret8_edges(documents: DataFrame) -> DataFrame:
    new = documents.select(F.col("doc_id").alias("a"), (F.col("doc_id") + 7).alias("b"), F.lit("sequence").alias("kind"))
    return tables.insert_edge(new.limit(0), documents, new, "doc_id")


@query("select doc_id, sha256(text) as hash from documents where doc_id % 2 = 1")
def snk14_new_hashes(documents: DataFrame) -> DataFrame:
    rows = documents.select("doc_id", F.sha2("text", 256).alias("hash"))
    return tables.insert_absent(rows.filter("doc_id % 2 = 0"), rows, ["doc_id", "hash"])


@query("select 'd' as kind, doc_id as id, lang, null as role from documents union all select 'c', conv_id, null, role from conversations")
def set1_union(documents: DataFrame, conversations: DataFrame) -> DataFrame:
    a = documents.select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), "lang")
    return a.unionByName(conversations.select(F.lit("c").alias("kind"), F.col("conv_id").alias("id"), "role"), allowMissingColumns=True)


@query("select event_id, cast(json_extract_string(props, '$.k') as int) as k, coalesce(json_extract_string(props, '$.chat'), 'unknown') as chat from events")
def fn51_json_get(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.coalesce(F.get_json_object("props", "$.chat"), F.lit("unknown")).alias("chat"))


@query("select event_id, cast(json_extract_string(props, '$.k') as varchar) as k, event_type as kind from events")
def fn52_metadata(events: DataFrame) -> DataFrame:
    old = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("drop"), F.lit("x"))
    new = F.map_concat(F.map_filter(old, lambda k, _: k != "drop"), F.create_map(F.lit("kind"), F.col("event_type")))
    return events.select("event_id", new["k"].alias("k"), new["kind"].alias("kind"))


@query("select strftime(ts, '%Y/%m/%d') as folder, count(*) as n from events group by 1")
def fn49_folders(events: DataFrame) -> DataFrame:
    return events.groupBy(fx.date_folder(F.col("ts")).alias("folder")).agg(F.count("*").alias("n"))


# --- retrieval

ASK = "the of that and thing there"


@query(f"""select doc_id, cast(len(list_intersect(list_distinct({TOKENS}), ['the', 'of', 'that', 'and', 'thing', 'there'])) as double) as score from documents order by score desc, doc_id limit 10""")
def ret1_ret2_srt1_lexical(documents: DataFrame) -> DataFrame:
    return retrieval.search_text(documents, ASK, F.col("text"), "doc_id", 10).select("doc_id", "score")


@query("""with q as (select embedding as q from embeddings where vec_id = 0) select vec_id, round(list_dot_product(embedding::double[], q::double[]) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(q::double[], q::double[]))), 6) as score
    from embeddings, q order by list_dot_product(embedding::double[], q::double[]) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(q::double[], q::double[]))) desc, vec_id limit 10""")
def ret3_fn30_jn18_cosine(embeddings: DataFrame) -> DataFrame:
    asked = embeddings.filter("vec_id = 0").agg(F.first("embedding")).scalar()
    scored = embeddings.withColumn("q", asked).withColumn("score", vectors.cosine(F.col("embedding"), F.col("q")))
    return retrieval.top_k(scored, "score", "vec_id", 10).select("vec_id", F.round("score", 6).alias("score"))


COS_SQL = "list_dot_product(embedding::double[], list_reverse(embedding)::double[]) / nullif(list_dot_product(embedding::double[], embedding::double[]), 0)"


@query(f"select vec_id, case when vec_id % 3 = 0 then -1.0 else coalesce(round({COS_SQL}, 6), -1.0) end::double as strict, case when vec_id % 3 = 0 then 0.0 else coalesce(round({COS_SQL}, 6), 0.0) end::double as loose, -1.0::double as shorter from embeddings")
def fn30_fn31_sentinels(embeddings: DataFrame) -> DataFrame:
    e = F.col("embedding")
    other = F.when(F.col("vec_id") % 3 == 0, F.transform(e, lambda x: F.lit(0.0).cast("float"))).otherwise(F.reverse(e))
    return embeddings.select("vec_id", F.round(vectors.cosine(e, other), 6).alias("strict"), F.round(vectors.cosine(e, other, 0.0, False), 6).alias("loose"), vectors.cosine(e, F.slice(e, 1, 3)).alias("shorter"))


@query()
def fn32_fuzzy_ratio(benchmark: DataFrame) -> DataFrame:
    return benchmark.select("item_id", F.round(retrieval.ratio(F.lit("that and the thing in there"), F.lower("text")), 6).alias("ratio"))


@query(r"""select doc_id, array_to_string(list_filter([case when contains(lower(text), 'the') then 'film' end, case when contains(lower(text), 'und') then 'work' end], lambda x: x is not null), ',') as tags from documents""")
def ret7_routes(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.concat_ws(",", retrieval.routed_tags(F.col("text"), {"the": "film", "und": "work"})).alias("tags"))


# --- chat examples and gates


@query("""with m as (select conv_id, list(struct_pack(role := role, content := text) order by turn) as m from conversations group by 1)
    select conv_id, array_to_string(list_filter([case when len(list_filter(m, lambda x: x.role not in ('system', 'user', 'assistant', 'tool'))) > 0 then 'unknown role' end, case when len(list_filter(m, lambda x: trim(x.content) = '')) > 0 then 'blank content' end,
    case when len(list_filter(m, lambda x: x.role = 'user')) = 0 then 'no user message' end, case when len(list_filter(m, lambda x: x.role = 'assistant')) = 0 then 'no assistant message' end], lambda x: x is not null), ',') as errors from m""")
def val1_fn41_chat_errors(conversations: DataFrame) -> DataFrame:
    return conv.chat_examples(conversations, "conv_id", "turn").select("conv_id", F.concat_ws(",", quality.chat_errors(F.col("messages"))).alias("errors"))


@query("""with o as (select *, sum(length(text)) over (partition by conv_id order by turn) as hi from conversations)
    select conv_id, string_agg((hi - length(text)) || '-' || hi, ',' order by turn) as spans from o where role = 'assistant' group by 1""")
def llm3_spans(conversations: DataFrame) -> DataFrame:
    ex = conv.chat_examples(conversations, "conv_id", "turn")
    return ex.select("conv_id", F.array_join(F.transform(conv.assistant_spans(F.col("messages")), lambda x: F.concat(x["lo"].cast("string"), F.lit("-"), x["hi"].cast("string"))), ",").alias("spans")).filter("spans != ''")


def gates_sql(source: str, gates, values: dict[str, str], below: tuple[str, ...] = ()) -> str:
    """SQL of the gates over one row of measures."""
    number = lambda x: "null::double" if x is None else f"{x}::double"
    rows = ", ".join(f"struct_pack(c := '{c}', v := ({values[c]})::double, lo := {number(lo)}, hi := {number(hi)}, miss := '{miss}', strict := {c in below})" for c, lo, hi, miss in gates)
    return f"""with {source}, g as (select unnest([{rows}]) as x from m)
    select x.c as "check", round(x.v, 6) as value, x.lo as low, x.hi as high, case when (x.lo is null or x.v >= x.lo) and (x.hi is null or x.v < x.hi or (x.v = x.hi and not x.strict)) then 'pass' else x.miss end as status from g"""


DOMAIN_SQL, META_SQL = "['film', 'persona', 'tools', 'general', 'tools'][doc_id % 5 + 1]", "n_chars > 50"
DATASET_VALUES = {
    "total": "n", "duplicates": "dup", **{f"domain {d}": d for d in ("film", "persona", "tools", "general")}, **{f"lang {x}": x for x in ("te", "en", "mixed")}, "invalid": "invalid", "p95 tokens": "p95",
    "tool examples": "with_tool", "system prompts": "prompts", "metadata share": "meta",
}
DATASET_SQL = f"""r as (select *, {THREE_WAY_SQL} as l, {DOMAIN_SQL} as dom, cast(floor(len({WORDS}) * case when {HAS} then 1.5::double else 1.3::double end) as int) as tok from documents),
    o as (select tok, row_number() over (order by tok) - 1 as i, count(*) over () as n from r),
    m as (select count(*) as n, count(*) - count(distinct sha256(text)) as dup, {', '.join(f"count(*) filter ({META_SQL} and dom = '{d}') / count(*)::double as {d}" for d in ('film', 'persona', 'tools', 'general'))}, {', '.join(f"count(*) filter (l = '{x}') / count(*)::double as {x}" for x in ('te', 'en', 'mixed'))},
        count(*) filter (trim(text) = '') as invalid, count(*) filter (doc_id % 5 = 0) as with_tool, count(distinct source) as prompts, count(*) filter ({META_SQL}) / count(*)::double as meta, (select max(tok) from o where i = least(floor(n * 0.95), n - 1)) as p95 from r)"""


@query(gates_sql(DATASET_SQL, fixed.DATASET_GATES, DATASET_VALUES))
def val2_dataset_gates(documents: DataFrame) -> DataFrame:
    text, domains = F.col("text"), F.array(*[F.lit(d) for d in ("film", "persona", "tools", "general", "tools")])
    rows = documents.select(
        F.sha2("text", 256).alias("hash"), F.get(domains, (F.col("doc_id") % 5).cast("int")).alias("domain"), fx.lang_three_way(text, LATIN).alias("lang"), (F.trim("text") != "").alias("valid"),
        fx.tokens_by_words(text, LATIN).alias("tokens"), (F.col("doc_id") % 5 == 0).alias("has_tool"), F.col("source").alias("prompt"), (F.col("n_chars") > 50).alias("has_metadata"),
    )
    return quality.dataset_gates(rows).withColumn("value", F.round("value", 6))


MARKERS_SQL = f"({SCRIPT_CHARS}) <= 5 and len(list_filter({WORDS}, lambda w: regexp_matches(w, '{S}'))) <= 2 and {sql_any('lower(text)', [x.lower() for x in LATIN.romanized_markers])}"
ANSWERS_SQL = f"""a as (select conv_id, max_by(text, turn) || case when conv_id % 9 = 0 then ' Ye? ' when conv_id % 4 = 0 then ' nenu' else '' end as text from conversations where role = 'assistant' group by 1), b as (select * from a where length(text) > 0),
    m as (select avg(len({WORDS})) as words, 100.0 * count(*) filter (len({WORDS}) <= 5) / count(*) as short, count(*) filter (regexp_matches(text, '(?i)\\bye\\?\\s*$')) as ye, count(*) filter ({sql_any('lower(text)', LATIN.meta_patterns)}) as meta, 100.0 * count(*) filter ({MARKERS_SQL}) / count(*) as mixed from b)"""


@query(gates_sql(ANSWERS_SQL, fixed.ANSWER_GATES, {"avg words": "words", "very short pct": "short", "ends with ye": "ye", "meta content": "meta", "code-switched pct": "mixed"}, ("very short pct",)))
def val3_answer_gates(conversations: DataFrame) -> DataFrame:
    last = conversations.filter("role = 'assistant'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))
    tail = F.when(F.col("conv_id") % 9 == 0, " Ye? ").when(F.col("conv_id") % 4 == 0, " nenu").otherwise("")
    return quality.answer_gates(last, F.concat("text", tail), LATIN).withColumn("value", F.round("value", 6))


@query("""with r as (select source, n_chars // 4 * 3 as v, row_number() over (partition by source order by n_chars // 4) - 1 as i, count(*) over (partition by source) as c from documents),
    p as (select source, (c * (10 + 5 * (ascii(right(source, 1)) % 7)))::bigint as n, max(v) filter (i = least(floor(c * 0.95::double), c - 1)) as p95, max(v) filter (i = least(floor(c * 0.99::double), c - 1)) as p99 from r group by source, c),
    a as (select *, case when p99 > 2048 then 2 else 1 end as batch_size, case when n < 600 then 8 else 64 end as accumulation, case when n > 1000 then 2 else 5 end as epochs from p), b as (select *, n // (batch_size * accumulation) * epochs as steps from a)
    select source, case when n < 1200 then 'ml.g5.2xlarge' else 'ml.g5.12xlarge' end as instance, case when p99 > 2048 then 3072 when p95 < 1024 then 1536 else 2048 end as max_length, batch_size, accumulation, epochs, steps,
        round(steps * 1.5::double / 60 / 60 * case when n < 1200 then 1.5::double else 9.0::double end, 6) as cost from b""")
def val4_advice(documents: DataFrame) -> DataFrame:
    rows = documents.select("source", (F.floor(F.col("n_chars") / 4) * 3).alias("v"))
    at = lambda p: F.max(F.when(F.col("p") == p, F.col("value")))
    ranks = stats.nearest_rank(rows, "v", [0.95, 0.99], "source").groupBy("source").agg(at(0.95).alias("p95"), at(0.99).alias("p99"))
    sized = rows.groupBy("source").agg((F.count("*") * (10 + 5 * (F.ascii(F.right("source", F.lit(1))) % 7))).alias("n")).join(ranks, "source")
    advice = sized.select("source", quality.training_advice(F.col("n"), F.col("p95"), F.col("p99")).alias("a")).select("source", "a.*")
    return advice.select("source", "instance", "max_length", "batch_size", "accumulation", "epochs", "steps", F.round("cost", 6).alias("cost"))


@query(f"""select role, bool_and(length(text) > 0) as all_there, count(*) filter (len({WORDS}) >= 3) as passed from conversations group by 1""")
def ag24_passes(conversations: DataFrame) -> DataFrame:
    return conversations.groupBy("role").agg(F.every(F.length("text") > 0).alias("all_there"), F.count_if(fx.word_count(F.col("text")) >= 3).alias("passed"))


@query("""with p as (select event_id, event_type, unnest(range(0, (length(event_type) + 2) // 3)) as chunk from events) select event_id, cast(chunk as int) as chunk, substr(event_type, chunk * 3 + 1, 3) as piece from p""")
def str7_rechunk(events: DataFrame) -> DataFrame:
    from ..streaming.chunks import rechunk

    return events.select("event_id", F.posexplode(rechunk(F.split("event_type", ""), 3, F.lit(""))).alias("chunk", "piece")).select("event_id", "chunk", F.concat_ws("", "piece").alias("piece"))


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in FOUND.items() if sql}
