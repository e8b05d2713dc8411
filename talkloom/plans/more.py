"""Further queries: lookups, samples, reports and prompt assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import LATIN
from ..functions import text as fx
from ..operators import conversation as conv
from .. import fixed
from ..operators import curation, selection, stats, tables
from ..operators.quality import needs_generation
from .relational import query
from .scalars import TITLE_SQL, TOKENS, WORDS, S


LETTERS = r"[\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{017F}]"
PROFILE_SQL = rf"""
with c as (select doc_id, text, len(regexp_extract_all(text, '\p{{L}}'))::double as letters, len(regexp_extract_all(text, '{LETTERS}')) as script, len(regexp_extract_all(text, '[A-Za-z]')) as ascii,
    {' + '.join(f"len(regexp_extract_all(lower(text), '{p}'))" for p in fx.ROMANIZED)} as roman, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{M}}\p{{N}}_]+'), lambda x: x <> '') as toks from documents),
d as (select *, coalesce(len(list_filter(toks, lambda w: w in ({', '.join(f"'{w}'" for w in fx.STOP_WORDS)})))::double / nullif(len(toks), 0), 0) as stops, coalesce(script / nullif(letters, 0), 0) as sr, coalesce(ascii / nullif(letters, 0), 0) as er, roman >= 2 as rom, script > 0 as scr from c),
e as (select *, case when rom and not scr then least(0.5::double, roman * 0.1::double) else 0.0::double end as shift from d),
f as (select *, sr + shift as sr1, case when shift > 0 then greatest(0.0::double, er - shift) else er end as er1, not scr and rom and stops <= 0.4 as as_script from e),
g as (select *, case when scr then case when sr1 > 0.7 then 'te' when er1 > 0.7 then 'en' else 'mixed' end when rom then case when stops > 0.4 then 'mixed' else 'te' end else 'en' end as lang,
    case when as_script then 1.0 - stops else sr1 end as sr2, case when as_script then stops else er1 end as er2,
    case when scr then case when sr1 > 0.7 then er1 when er1 > 0.7 then sr1 else 1.0 - abs(sr1 - er1) end when rom then case when stops > 0.4 then 0.5::double else stops end else 0.0::double end as mixed from f),
h as (select doc_id, lang, round(sr2, 3) as script_ratio, round(er2, 3) as english_ratio, round(mixed, 3) as mixed_ratio, scr as has_script, rom as has_romanized,
    round(greatest(0.0::double, least(1.0::double, case lang when 'te' then sr2 when 'en' then case when rom then 1.0 - roman * 0.1::double else er2 end else mixed end)), 3) as confidence from g)
select *, lang = 'mixed' or (has_script and english_ratio > 0.1) as code_switched from h"""


@query("select doc_id, md5(['What is: ', 'Explain: ', 'Tell me about: '][('0x' || substr(sha256('42:' || doc_id), 1, 8))::bigint % 3 + 1] || text) as prompt from documents")
def smp6_templates(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.md5(F.concat(selection.template_of(F.col("doc_id"), ["What is: ", "Explain: ", "Tell me about: "]), F.col("text")).cast("binary")).alias("prompt"))


@query("select conv_id, md5(string_agg(text, '|' order by turn)) as firsts from (select *, row_number() over (partition by conv_id order by turn) as n from conversations) where n <= 3 group by 1")
def smp7_first_three(conversations: DataFrame) -> DataFrame:
    ex = conv.chat_examples(conversations, "conv_id", "turn")
    return ex.select("conv_id", F.md5(F.array_join(F.transform(F.slice("messages", 1, 3), lambda m: m["content"]), "|").cast("binary")).alias("firsts"))


@query("select o_custkey, min(o_totalprice) filter (o_totalprice > 100000)::double as next, max(o_totalprice) filter (o_totalprice < 100000)::double as previous from orders group by 1")
def srt5_neighbours(orders: DataFrame) -> DataFrame:
    p = F.col("o_totalprice")
    return orders.groupBy("o_custkey").agg(F.min(F.when(p > 100000, p)).cast("double").alias("next"), F.max(F.when(p < 100000, p)).cast("double").alias("previous"))


@query("select user_id, max(ts) as updated_at from events group by 1 order by 2 desc, 1 limit 20")
def srt7_latest_sessions(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(F.max("ts").alias("updated_at")).orderBy(F.desc("updated_at"), "user_id").limit(20)


@query("select event_id, user_id, event_type from events order by ts desc, event_id desc limit 50")
def srt9_srt10_recent(events: DataFrame) -> DataFrame:
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "user_id", "event_type")


@query("""select substr(sha256(text), 1, 16) as r, min(conv_id * 1000000 + turn) as first from conversations where role = 'assistant' group by 1""")
def set5_dedup_response(conversations: DataFrame) -> DataFrame:
    rows = conversations.filter("role = 'assistant'").select(fx.content_hash("text").alias("r"), (F.col("conv_id") * 1000000 + F.col("turn")).alias("first"))
    return selection.first_of_each(rows, ["r"], [F.col("first")]).select("r", "first")


@query(f"select doc_id, cast(len(list_intersect(list_distinct({TOKENS}), ['the', 'of', 'und', 'que'])) as int) as shared from documents")
def set6_set7_overlap(documents: DataFrame) -> DataFrame:
    known = F.array(*[F.lit(w) for w in ("the", "of", "und", "que")])
    return documents.select("doc_id", F.size(F.array_intersect(F.array_distinct(fx.tokens(F.col("text"))), known)).alias("shared"))


@query("select c_custkey, o_orderkey, cast(row_number() over (partition by c_custkey order by o_orderdate, o_orderkey) as int) as place from customer join orders on o_custkey = c_custkey where c_mktsegment = 'BUILDING'")
def jn4_ret5_ordered_children(customer: DataFrame, orders: DataFrame) -> DataFrame:
    joined = customer.filter("c_mktsegment = 'BUILDING'").join(orders, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select("c_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("c_custkey").orderBy("o_orderdate", "o_orderkey")).alias("place"))


@query("select d.doc_id from documents d where not exists (select 1 from documents o where o.doc_id % 2 = 0 and trim(o.text) = trim(d.text))")
def jn8_new_memories(documents: DataFrame) -> DataFrame:
    rows = documents.select("doc_id", F.sha2(F.trim("text"), 256).alias("h"))
    return tables.insert_absent(rows.filter("doc_id % 2 = 0"), rows, ["h"]).select("doc_id")


@query("""with c as (select conv_id, turn, text from conversations where role = 'user'), r as (select conv_id, turn - 1 as turn, text from conversations where role = 'assistant')
    select c.conv_id, c.turn, length(c.text) as asked, length(r.text) as answered from c left join r using (conv_id, turn)""")
def jn14_jn15_call_results(conversations: DataFrame) -> DataFrame:
    c = conversations.filter("role = 'user'").select("conv_id", "turn", F.length("text").cast("long").alias("asked"))
    r = conversations.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.length("text").cast("long").alias("answered"))
    return c.join(r, ["conv_id", "turn"], "left")


@query(r"""with t as (select doc_id, lower(substr(trim(string_split(trim(text), chr(10))[1]), 1, 80)) as title from documents) select min(doc_id) as doc_id, title from t where doc_id % 3 <> 0 and title not in (select title from t where doc_id % 3 = 0) group by 2""")
def jn21_new_titles(documents: DataFrame) -> DataFrame:
    rows = documents.select("doc_id", F.lower(fx.title(F.col("text"))).alias("title"))
    fresh = tables.insert_absent(rows.filter("doc_id % 3 = 0"), rows.filter("doc_id % 3 <> 0"), ["title"])
    return selection.first_of_each(fresh, ["title"], [F.col("doc_id")]).select("doc_id", "title")


CALLS_SQL = "case when role = 'assistant' and conv_id % 2 = 0 then [case turn % 3 when 0 then 'search' when 1 then 'link' end, 'notes'] end"


def with_calls(conversations: DataFrame) -> DataFrame:
    """The turns with tool calls of assistants in every second conversation; a turn in three is a tool's."""
    name = F.when(F.col("turn") % 3 == 0, "search").when(F.col("turn") % 3 == 1, "link")
    call = lambda n: F.struct(n.alias("name"), F.concat(F.lit('{"turn": '), F.col("turn").cast("string"), F.lit("}")).alias("arguments"))
    return conversations.withColumn("tool_calls", F.when((F.col("role") == "assistant") & (F.col("conv_id") % 2 == 0), F.array(call(name), call(F.lit("notes")))))


@query(f"""with c as (select conv_id, turn, {CALLS_SQL} as calls from conversations), f as (select *, row_number() over (partition by conv_id order by turn) as k from c where calls is not null)
    select coalesce(tool, 'unknown') as tool, count(*) as n from (select unnest(calls) as tool from f where k = 1) group by 1""")
def ag13_tool_operations(conversations: DataFrame) -> DataFrame:
    ex = conv.chat_examples(with_calls(conversations), "conv_id", "turn", ("tool_calls",))
    return ex.select(F.explode(conv.first_tool_calls(F.col("messages"))).alias("tool")).groupBy("tool").agg(F.count("*").alias("n"))


LLM1_SQL = f"""with c as (select *, {CALLS_SQL} as calls, case when conv_id % 4 = 0 then 'film' end as name from conversations),
    m as (select conv_id, turn, case when role <> 'assistant' and turn % 3 = 2 then 'user' else role end as role, regexp_matches(role, 'assistant') as own, case
        when role <> 'assistant' and turn % 3 = 2 then regexp_replace('[tool:' || coalesce(name, 'tool') || '] ' || text, '^\\s+|\\s+$', '', 'g')
        when calls is not null then regexp_replace(text || chr(10) || array_to_string(list_transform(calls, lambda x: '<tool_call name="' || coalesce(x, 'tool') || '">{{"turn": ' || turn || '}}</tool_call>'), chr(10)), '^\\s+|\\s+$', '', 'g') else text end as content, text from c)
    select conv_id, md5(string_agg(role || ':' || content, chr(10) order by turn)) as flat, bool_or(own and length(text) > 0) as trains from m group by 1"""


@query(LLM1_SQL)
def llm1_llm2_flatten(conversations: DataFrame) -> DataFrame:
    turns = with_calls(conversations).withColumn("name", F.when(F.col("conv_id") % 4 == 0, "film"))
    turns = turns.withColumn("role", F.when((F.col("role") != "assistant") & (F.col("turn") % 3 == 2), "tool").otherwise(F.col("role")))
    ex = conv.chat_examples(turns, "conv_id", "turn", ("name", "tool_calls"))
    flat = F.array_join(F.transform(conv.flatten_tools(F.col("messages")), lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")
    return ex.select("conv_id", F.md5(flat.cast("binary")).alias("flat"), conv.has_assistant_text(F.col("messages")).alias("trains"))


@query("""with m as (select conv_id, role, case (conv_id + turn) % 3 when 0 then text when 1 then 'Summary: ...' || chr(10) || text else ' ' || chr(10) end as c from conversations where role <> 'assistant' or conv_id % 2 = 0 or turn % 5 <> 0)
    select conv_id, not bool_or(role = 'assistant' and regexp_matches(c, '\\S') and not contains(c, '...') and not contains(c, 'Examples:')) as needs from m group by 1""")
def flt10_needs_generation(conversations: DataFrame) -> DataFrame:
    kind = (F.col("conv_id") + F.col("turn")) % 3
    said = F.when(kind == 0, F.col("text")).when(kind == 1, F.concat(F.lit("Summary: ...\n"), F.col("text"))).otherwise(" \n")
    turns = conversations.filter("role <> 'assistant' or conv_id % 2 = 0 or turn % 5 <> 0").withColumn("text", said)
    return conv.chat_examples(turns, "conv_id", "turn").select("conv_id", needs_generation(F.col("messages")).alias("needs"))


@query("select role, cast(sum(length(text) // 4) as bigint) as tokens, cast(sum(length(text)) as bigint) as chars from conversations group by rollup (role)")
def ag27_usage(conversations: DataFrame) -> DataFrame:
    return conversations.rollup("role").agg(F.sum(F.floor(F.length("text") / 4)).alias("tokens"), F.sum(F.length("text")).alias("chars"))


@query("""select o_orderkey, count(l_linenumber) as lines, round(sum(l_extendedprice::double * (1 - l_discount::double)), 4) as amount, o_orderpriority from orders left join lineitem on l_orderkey = o_orderkey group by all""")
def ret4_detail(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    joined = orders.join(lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    amount = F.sum(F.col("l_extendedprice").cast("double") * (1 - F.col("l_discount").cast("double")))
    return joined.groupBy("o_orderkey", "o_orderpriority").agg(F.count("l_linenumber").alias("lines"), F.round(amount, 4).alias("amount"))


@query("""with b as (select conv_id, max(length(text)) filter (turn = 0) // 4 as used from conversations group by 1),
    r as (select c.conv_id, c.turn, 2048 - coalesce(b.used, 0) - 500 as budget, sum(length(c.text) // 4) over (partition by c.conv_id order by c.turn desc rows unbounded preceding) as running from conversations c join b using (conv_id))
    select conv_id, turn, cast(running as bigint) as running from r where running <= budget""")
def str12_prompt_window(conversations: DataFrame) -> DataFrame:
    used = conversations.groupBy("conv_id").agg(F.floor(F.max(F.when(F.col("turn") == 0, F.length("text"))) / 4).alias("used"))
    rows = conversations.join(used, "conv_id").withColumn("budget", F.lit(2048) - F.coalesce("used", F.lit(0)) - 500)
    return selection.within_budget(rows, "conv_id", "turn", fx.tokens_by_chars(F.col("text")), F.col("budget")).select("conv_id", "turn", "running")


@query("""with p as (select c.conv_id, c.turn, c.text as question, r.text as actual from conversations c join conversations r on r.conv_id = c.conv_id and r.turn = c.turn + 1 where c.role = 'user' and r.role = 'assistant')
    select conv_id, turn, md5('| ' || question || ' | ' || actual || ' |') as line from p""")
def llm8_eval_table(conversations: DataFrame) -> DataFrame:
    q = conversations.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = conversations.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("actual"))
    return q.join(a, ["conv_id", "turn"]).select("conv_id", "turn", F.md5(curation.table_line(F.col("question"), F.col("actual")).cast("binary")).alias("line"))


@query(PROFILE_SQL)
def fn8_fn9_profile(documents: DataFrame) -> DataFrame:
    p = documents.select("doc_id", fx.lang_profile(F.col("text"), LATIN).alias("p"))
    return p.select("doc_id", "p.*", fx.is_code_switched(F.col("p"), LATIN).alias("code_switched"))


@query(f"select doc_id, md5(regexp_replace(text, '{S}', '?', 'g')) as text, md5(text) as text_original, regexp_matches(text, '{S}') as changed from documents")
def fn14_field(documents: DataFrame) -> DataFrame:
    out = curation.replace_field(documents.select("doc_id", "text"), "text", lambda c: F.regexp_replace(c, S, "?"))
    return out.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text"), F.md5(F.col("text_original").cast("binary")).alias("text_original"), "changed")


@query("""with p as (select lang as category, source, doc_id, row_number() over (partition by lang, source order by doc_id) as k from documents) select category, source as pair, doc_id from p where k = 1""")
def fn43_nested_pairs(documents: DataFrame) -> DataFrame:
    firsts = documents.groupBy("lang", "source").agg(F.min("doc_id").alias("doc_id"))
    nested = firsts.groupBy("lang").agg(F.collect_list(F.struct(F.col("source").alias("pair"), "doc_id")).alias("pairs")).select(F.create_map("lang", "pairs").alias("m"))
    return nested.select(F.explode("m").alias("category", "pairs")).select("category", F.explode("pairs").alias("x")).select("category", "x.*")


@query("select lang, round(avg(case when n_chars > 1000 then 1.0 else 0.0 end), 3) as share from documents group by 1")
def fn53_rounded_share(documents: DataFrame) -> DataFrame:
    return documents.groupBy("lang").agg(F.round(F.avg(F.when(F.col("n_chars") > 1000, 1.0).otherwise(0.0)), 3).alias("share"))


@query(f"select doc_id, md5('{{NAME_A}}: ' || text) as input, case when len({WORDS}) >= 3 and length(trim(text)) >= 10 then 'keep' else 'drop' end as verdict from documents where source = 'src1' or source = 'src2'")
def flt6_flt13_lookup(documents: DataFrame) -> DataFrame:
    from ..operators.quality import interview_ok

    rows = documents.filter(F.col("source").isin("src1", "src2"))
    return rows.select("doc_id", F.md5(F.concat(F.lit("{NAME_A}: "), F.col("text")).cast("binary")).alias("input"), F.when(interview_ok(F.col("text")), "keep").otherwise("drop").alias("verdict"))


@query("select lang, source, n from (select lang, source, count(*) as n, row_number() over (partition by lang order by count(*) desc, source) as k from documents group by 1, 2) where k = 1")
def par5_srt6_top_of_each(documents: DataFrame) -> DataFrame:
    return stats.top_counts(documents, ["source"], 1, ["lang"]).select("lang", "source", "n")


def _form_sql(form: str, fields: dict[str, str]) -> str:
    """SQL of a prompt form whose {names} are replaced by these expressions."""
    out = "'" + form.replace("'", "''") + "'"
    for name, sql in fields.items():
        out = out.replace("{" + name + "}", f"' || {sql} || '")
    return out


PROMPT_FIELDS = {
    "scene": {"text": r"regexp_replace(text, '^\s+|\s+$', '', 'g')"}, "word": {"word": "lang", "definition": "trim(title)"}, "principle": {"principle": "trim(title)"},
    "decision": {"situation": "title", "choice": "source", "rationale": "lang", "heuristics": "case when doc_id % 2 = 0 then lang || ', ' || source else '...' end", "domain": "case when doc_id % 3 = 0 then 'general' else lang end"},
}
PROMPTS_SQL = f"with d as (select *, {TITLE_SQL} as title from documents), p as (" + " union all ".join(
    f"select doc_id, '{task}' as task, {_form_sql(d, PROMPT_FIELDS[kind])} as domain, md5({_form_sql(q, PROMPT_FIELDS[kind])} || '|' || {_form_sql(a, PROMPT_FIELDS[kind])}) as prompt from d where {'trim(text)' if kind == 'scene' else 'title'} <> ''"
    for kind, forms in fixed.PROMPTS.items() for q, a, d, task in forms
) + ") select * from p"


@query(PROMPTS_SQL)
def jn20_fn44_two_prompts(documents: DataFrame) -> DataFrame:
    title, odd = fx.title(F.col("text")), F.col("doc_id") % 2 == 1
    every = F.concat(
        fx.prompts("scene", text=F.col("text")), fx.prompts("word", word=F.col("lang"), definition=title), fx.prompts("principle", principle=F.concat(F.lit(" 12. "), title)),
        fx.prompts("decision", situation=title, choice=F.col("source"), rationale=F.col("lang"), heuristics=F.when(odd, F.array().cast("array<string>")).otherwise(F.array("lang", "source")), domain=F.when(F.col("doc_id") % 3 != 0, F.col("lang"))),
    )
    return documents.select("doc_id", F.explode(every).alias("p")).select("doc_id", "p.task", "p.domain", F.md5(F.concat("p.question", F.lit("|"), "p.answer").cast("binary")).alias("prompt"))
