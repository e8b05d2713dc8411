"""Scalar queries: an expression over every document, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..config import LATIN
from ..functions import text as fx
from ..functions import vectors
from ..functions.vectors import let
from ..operators import conversation as conv
from ..operators import curation
from ..operators import quality as ql
from ..session import table
from ..sources import parse

S = r"[\x{00C0}-\x{017F}]"
HAS = f"regexp_matches(text, '{S}')"
WORDS = r"list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')"
LOW_WORDS = r"list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')"
SCRIPT_CHARS = f"(length(text) - length(regexp_replace(text, '{S}', '', 'g')))"
REPEATS = f"len({LOW_WORDS}) > 3 and len(list_filter(list_zip({LOW_WORDS}, {LOW_WORDS}[2:], {LOW_WORDS}[3:]), lambda x: x[1] = x[2] and x[2] = x[3])) > 0"
TOKENS = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


def sql_any(text: str, words) -> str:
    return "(" + " or ".join(f"contains({text}, '{w}')" for w in words) + ")"


def sql_list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def body_sql(text: str) -> str:
    return f"(case when starts_with({text}, 'Boss, ') then substr({text}, 7) else {text} end)"



CLAR, TAG = "contains(text, '?')", sql_any("lower(text)", LATIN.script_keywords)
SCORE_SQL = f"""greatest(0, least(100, 50 + case when {TAG} then 25 else 0 end + case when {CLAR} then 20 else 0 end
    + case when length({body_sql('text')}) > 100 then 15 when length({body_sql('text')}) > 50 then 10 when length({body_sql('text')}) > 25 then 5 when length({body_sql('text')}) <= 12 then -20 else 0 end
    + case when regexp_matches({body_sql('text')}, '{S}') then 10 else 0 end + case when lower(trim({body_sql('text')})) in ({sql_list(LATIN.low_value)}) then -40 else 0 end
    + case when {sql_any('lower(text)', [p.lower() for p in LATIN.filter_patterns])} then -50 else 0 end + case when {sql_any('text', LATIN.emoji)} then 5 else 0 end + case when {CLAR} then 5 else 0 end))"""

HASHED_SQL = f"""with t as (select doc_id, unnest({LOW_WORDS}) as t from documents), s as (select doc_id, ('0x' || substr(sha256(t), 1, 8))::bigint % 48 as at, sum(case when ('0x' || substr(sha256(t), 9, 1))::int % 2 = 1 then 1 else -1 end)::double as x from t group by all),
    n as (select doc_id, sqrt(sum(x * x)) as n from s group by 1), g as (select d.doc_id, i, coalesce(s.x, 0.0::double) as x, coalesce(n.n, 0.0::double) as n from documents d cross join range(0, 48) r(i) left join s on s.doc_id = d.doc_id and s.at = i left join n on n.doc_id = d.doc_id)
    select doc_id, string_agg(cast(round(case when n > 0 then round(x / n, 6) else 0.0 end * 1000) as int)::varchar, ',' order by i) as value from g group by 1"""


def context_score_sql(words) -> str:
    hits = " + ".join(f"contains(lower(text), '{w}')::int" for w in words)
    whole = f"len(list_intersect(list_distinct(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_]+')), [{sql_list(words)}]))"
    return f"least(({hits} + {whole}) / {len(words) * 0.3!r}::double, 1.0)"


_scores = [(name, context_score_sql(words)) for name, words in LATIN.context_keywords]
CONTEXT_SQL = "case " + " ".join(f"when {own} > 0 and " + " and ".join([f"{own} >= {other}" for _, other in _scores[k + 1:]] + [f"{own} > {other}" for _, other in _scores[:k]] or ["true"]) + f" then '{name}'" for k, (name, own) in enumerate(_scores)) + " end"



class OneOf:
    """One of these texts for each document, by its id: as a column [0] and as SQL [1]."""

    def __init__(self, *items: str):
        self.items = items

    def __getitem__(self, k: int) -> Column | str:
        if k:
            return f"[{sql_list(self.items)}][doc_id % {len(self.items)} + 1]"
        return F.element_at(F.array(*[F.lit(x) for x in self.items]), (F.col("doc_id") % len(self.items) + 1).cast("int"))


def before(items: OneOf, sql: str) -> str:
    """SQL over documents whose texts begin with one of the items."""
    return f"with m as (select * replace ({items[1]} || text as text) from documents) select doc_id, {sql} as value from m"


def decision(text: Column) -> Column:
    domain = F.element_at(F.array(*[F.lit(x) for x in ("film", "production", "kitchen", "other")]), (F.col("doc_id") % 4 + 1).cast("int"))
    choice, why = F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("lang")), F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("")
    return F.concat(fx.decision_question(domain, fx.title(text), choice), F.lit("|"), fx.decision_answer(fx.title(text), choice, why))


SAID = OneOf("", "scene ", "Oven, cook: recipe timer ", "A shot; camera angle frame ", "act2 ")
ASKED = OneOf("Plan the beats: genre tone audience rating ", "first step of an outline ", "Need only discovery ", "pitch ", "mix english lo ", "TELUGU plan ", "Plan it: time ", "")
SWORN = OneOf("", "Shit, ", "bullshit ", "what the FUCK ")
ROMAN = OneOf("SHOUTED httpx {NAME_A} the_word don't OK ", "[x] The THE BOSS's ", "")
SWITCH = OneOf("", "Let's go to kitchen ", "switch to moon, storyboard mode ", "visual mode ", "in the script ")
PLACES = OneOf("The Kitchen", "office", "garden", "film studio", "")
SWITCH_SQL = "coalesce(" + ", ".join(f"case regexp_extract(lower(text), '{p.replace(chr(39), chr(39) * 2)}', 1) " + " ".join(f"when '{k}' then '{v}'" for k, v in LATIN.switch_words.items()) + " end" for p in LATIN.switch_patterns) + ")"
BEST_SQL = "greatest(" + ", ".join(own for _, own in _scores) + ")"
THREE_WAY_SQL = f"case when {HAS} and regexp_matches(text, '[A-Za-z]') then 'mixed' when {HAS} then 'te' else 'en' end"
INTENT_SQL = f"""case when ({HAS} and not regexp_matches(text, '[A-Za-z]')) or regexp_matches(text, '^\\s*{LATIN.script_greeting}') or contains(lower(text), 'telugu') then false
    when contains(lower(text), 'first step') and contains(lower(text), 'outline') then false when contains(lower(text), 'need only discovery') then true
    when contains(lower(text), 'give me next beats') or contains(lower(text), 'already locked') then false
    when {sql_any('lower(text)', ['outline', 'beat', 'plan'])} then {' + '.join(f"contains(lower(text), '{k}')::int" for k in ('genre', 'tone', 'audience', 'rating', 'language', 'languages', 'runtime', 'budget', 'time', 'place', 'hero'))} < 4
    when contains(lower(text), 'need your default pitch') then false when contains(lower(text), 'pitch') then true else false end"""
MIX_SQL = "contains(lower(text), 'english lo') or contains(lower(text), 'mix') or (contains(lower(text), 'english') and contains(lower(text), 'telugu'))"
BULLETS = OneOf("- Boss, one, two \n•  • three\n\n", "బాస్, x\n", " -- \n", "")
PLAN_SQL = f"""case when {MIX_SQL} then 'mixed,బాస్,,false' when ({HAS} and not regexp_matches(text, '[A-Za-z]')) or regexp_matches(text, '^\\s*{LATIN.script_greeting}') or contains(lower(text), 'telugu') then 'te,బాస్,,' || ({INTENT_SQL})::varchar else 'en,Boss,,' || ({INTENT_SQL})::varchar end"""
STRIPPED = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
BARE = STRIPPED.format(r"regexp_replace(x, '^[•\- ]+|[•\- ]+$', '', 'g')")
LINES_SQL = f"""md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: case when starts_with(lower({BARE}), 'boss,') or starts_with({BARE}, 'బాస్,') then {STRIPPED.format(f"regexp_replace({BARE}, '^[^,]*,', '')")} else {BARE} end), lambda x: x <> ''), chr(10)))"""
TITLE_SQL = "substr(trim(string_split(trim(text), chr(10))[1]), 1, 80)"
DECISION_SQL = f"""with d as (select doc_id, {TITLE_SQL} as situation, case when doc_id % 7 = 0 then '' else lang end as choice, case when doc_id % 2 = 0 then source else '' end as rationale from documents)
    select doc_id, case when situation <> '' and choice <> '' then 'Boss, ' || lower(situation) || case doc_id % 4 when 0 then ' What should we do?' when 1 then ' What should we do?' when 2 then ' How do I handle this?' else ' Your take?' end || '|' || choice || case when rationale <> '' then '. ' || rationale else '' end end as value from d"""
RULES_SQL = f"""with r as (select doc_id, case when doc_id % 2 = 0 then starts_with(text, 'The') else true end as a, ({THREE_WAY_SQL}) = ['en', 'mixed', 'te'][doc_id % 3 + 1] as b,
    case when {TAG} then length(text) - length(replace(text, '?', '')) = 1 else not contains(text, '?') end as c, len(list_filter(string_split_regex(text, '[\\n\\r\\x0b\\x0c\\x1c-\\x1e]'), lambda x: regexp_matches(x, '\\S'))) <= 6 as d from documents)
    select doc_id, concat_ws(',', a::int, b::int, c::int, d::int, (a and b and c and d)::int) as value from r"""
ROMAN_SQL = f"""with w as (select doc_id, unnest(regexp_extract_all(regexp_replace({ROMAN[1]} || text, '([{{}}_\\[\\]])', '\\1\\1', 'g'), '[{{}}_\\[\\]]?[A-Za-z]+(?:''[A-Za-z]+)?[{{}}_\\[\\]]?')) as e from documents),
    x as (select doc_id, e, regexp_replace(e, '[^A-Za-z'']', '', 'g') as w from w), k as (select doc_id, count(*) as kept from x where lower(w) in ({sql_list([*fixed.SKIPPED, *fixed.COMMON])}) or starts_with(lower(w), 'http') or (w = upper(w) and length(w) > 4) or regexp_matches(e, '^[{{\\[_]') or regexp_matches(e, '[}}\\]_]$') group by 1)
    select doc_id, coalesce(kept, 0)::int as value from documents left join k using (doc_id)"""

SCALARS: dict[str, tuple[Callable[[Column], Column], str | None]] = {
    "fn1_has_script": (lambda t: fx.has_script(t, LATIN), HAS),
    "fn2_lang_two_way": (lambda t: fx.lang_two_way(t, LATIN), f"case when {HAS} then 'te' else 'en' end"),
    "fn3_lang_three_way": (lambda t: fx.lang_three_way(t, LATIN), f"case when {HAS} and regexp_matches(text, '[A-Za-z]') then 'mixed' when {HAS} then 'te' else 'en' end"),
    "fn4_lang_switched": (lambda t: fx.lang_switched(t, LATIN), f"case when {HAS} and regexp_matches(text, '[a-zA-Z]{{3,}}') then 'te-en' when {HAS} then 'te' else 'en' end"),
    "fn5_lang_markers": (lambda t: fx.lang_markers(t, LATIN), f"case when {SCRIPT_CHARS} > 5 or len(list_filter({WORDS}, lambda w: regexp_matches(w, '{S}'))) > 2 then 'te' when {sql_any('lower(text)', [m.lower() for m in LATIN.romanized_markers])} then 'te-en' else 'en' end"),
    "fn6_lang_ratio": (lambda t: fx.lang_ratio(t, LATIN), f"case when {SCRIPT_CHARS} > 0.5 * length(replace(text, ' ', '')) and length(replace(text, ' ', '')) > 0 then 'te' when {SCRIPT_CHARS}::double / nullif(length(replace(text, ' ', '')), 0) > 0.1 then 'te-en' else 'en' end"),
    "fn7_lang_category": (lambda t: fx.lang_category(t, LATIN), f"case when not {HAS} then 'english_only' when len(list_filter({WORDS}, lambda w: regexp_matches(w, '^[A-Za-z]+$')))::double / greatest(len({WORDS}), 1) > 0.7 then 'english_dominant' when len(list_filter({WORDS}, lambda w: regexp_matches(w, '^[A-Za-z]+$')))::double / greatest(len({WORDS}), 1) > 0.3 then 'code_switched' else 'script_dominant' end"),
    "fn11_normalize_lang": (lambda t: fx.normalize_lang(F.col("lang"), fx.has_script(t, LATIN), LATIN), f"case when lower(trim(lang)) in ('te', 'telugu') then 'te' when lower(trim(lang)) in ('en', 'english') then 'en' when lower(trim(lang)) in ('te-en', 'mixed', 'code-switched') then 'te-en' when {HAS} then 'te' else 'en' end"),
    "fn13_normalize_romanized": (lambda t: F.md5(fx.normalize_romanized(t).cast("binary")), "md5(replace(replace(replace(replace(text, '.h', ''), '.m', 'm'), '~n', 'n'), '~N', 'n'))"),
    "fn18_redact_pii": (lambda t: F.md5(fx.redact_pii(t).cast("binary")), r"md5(regexp_replace(regexp_replace(regexp_replace(text, '\+?\d[\d\s\-()]{5,}\d', '{PHONE}', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '{EMAIL}', 'g'), '\b[^\s@]+@[^\s@]+\b', '{EMAIL}', 'g'))"),
    "fn19_ensure_prefix": (lambda t: F.md5(fx.ensure_prefix(t).cast("binary")), "md5(case when starts_with(lower(ltrim(text)), 'boss,') then ltrim(text) else 'Boss, ' || ltrim(text) end)"),
    "fn20_strip_prefix": (lambda t: F.md5(fx.strip_prefix(F.concat(F.when(F.col("doc_id") % 2 == 0, "Boss, ").otherwise(""), t)).cast("binary")), "md5(text)"),
    "fn21_strip_placeholders": (lambda t: F.md5(fx.strip_placeholders(F.concat(F.lit("{NAME_B}: "), t)).cast("binary")), "md5(text)"),
    "fn22_script_related": (lambda t: fx.is_script_related(t), TAG),
    "fn23_tokens": (lambda t: F.md5(F.concat_ws("|", fx.tokens(t)).cast("binary")), f"md5(array_to_string({TOKENS}, '|'))"),
    "fn24_tokens_by_words": (lambda t: fx.tokens_by_words(t, LATIN), f"cast(floor(len({WORDS}) * case when {HAS} then 1.5::double else 1.3::double end) as int)"),
    "fn25_tokens_by_chars": (lambda t: fx.tokens_by_chars(t), "cast(length(text) // 4 as bigint)"),
    "fn26_word_count": (lambda t: fx.word_count(t), f"cast(len({WORDS}) as int)"),
    "fn27_content_hash": (lambda t: fx.content_hash(t), "substr(sha256(text), 1, 16)"),
    "fn28_full_hash": (lambda t: F.sha2(t, 256), "sha256(text)"),
    "fn35_preview": (lambda t: fx.preview(t), "case when length(text) > 200 then substr(text, 1, 200) || '...' else text end"),
    "fn36_title": (lambda t: fx.title(t), r"substr(trim(string_split(trim(text), chr(10))[1]), 1, 80)"),
    "fn37_html_escape": (lambda t: F.md5(fx.html_escape(t).cast("binary")), "md5(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '<br/>'))"),
    "fn38_profanity": (lambda t: fx.has_profanity(F.concat(SWORN[0], t)), before(SWORN, r"regexp_matches(text, '(?i)\b(fuck|douche|shit)\b')")),
    "fn39_repeats_word": (lambda t: fx.repeats_word(t), REPEATS),
    "fn40_char_spam": (lambda t: fx.is_char_spam(t), "len(list_distinct(string_split(replace(text, ' ', ''), ''))) < 4 and length(text) > 20"),
    "fn46_domain": (lambda t: fx.domain(F.array(F.col("lang")), t, F.when(F.col("doc_id") % 5 == 0, "tools").when(F.col("doc_id") % 5 == 1, "whatsapp").otherwise("x")), f"case when doc_id % 5 = 0 then 'tools' when {sql_any('lower(lang || chr(44) || text)', LATIN.film_words)} then 'film' when {sql_any('lower(lang || chr(44) || text)', LATIN.persona_words)} then 'persona' when doc_id % 5 = 1 then 'conversation' else 'general' end"),
    "fn42_decision": (lambda t: decision(t), DECISION_SQL),
    "fn47_real_time_factor": (lambda t: F.round(fx.real_time_factor(F.length(t), F.col("n_chars") - 500), 6), "case when n_chars > 500 then round(length(text)::double / (n_chars - 500), 6) else 0.0 end"),
    "fn48_seconds": (lambda t: F.round(fx.seconds(F.col("n_chars"), 16000), 9), "round(n_chars / 16000.0::double, 9)"),
    "fn54_session_key": (lambda t: fx.session_key(F.col("source"), F.col("doc_id").cast("string")), "substr(sha256(source || '_' || doc_id), 1, 12)"),
    "par12_slug": (lambda t: fx.slug(fx.title(t)), r"regexp_replace(regexp_replace(trim(lower(substr(trim(string_split(trim(text), chr(10))[1]), 1, 80))), '[^\p{L}\p{M}\p{N}_\s-]', '', 'g'), '[\s_]+', '-', 'g')"),
    "par12_slug_ascii": (lambda t: fx.slug(fx.title(t), True), r"coalesce(nullif(regexp_replace(regexp_replace(trim(lower(substr(trim(string_split(trim(text), chr(10))[1]), 1, 80))), '[^\w\s-]', '', 'g'), '[\s_]+', '-', 'g'), ''), 'screenplay')"),
    "par13_bullets": (lambda t: F.md5(fx.bullets(t).cast("binary")), r"md5(array_to_string(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '^\s*\d+\.', ''))), lambda x: x <> ''), lambda x: '- ' || x), chr(10)))"),
    "src12_newlines": (lambda t: F.md5(fx.newlines(F.replace(t, F.lit("\n"), F.lit("\r\n"))).cast("binary")), "md5(text)"),
    "flt1_skip_incoming": (lambda t: ql.skip_incoming(F.when(F.col("doc_id") % 7 == 0, "image omitted").otherwise(t)), "case when doc_id % 7 = 0 then true else trim(text) = '' or lower(trim(text)) in ('media omitted', '<media omitted>', 'sticker omitted') or (ends_with(lower(trim(text)), ' omitted') and not contains(lower(trim(text)), chr(10) || 'omitted')) or starts_with(lower(trim(text)), 'messages and calls are end-to-end encrypted') end"),
    "flt2_skip_reply": (lambda t: ql.skip_reply(F.when(F.col("doc_id") % 5 == 0, "Boss, ?!").otherwise(t)), r"case when doc_id % 5 = 0 then true else lower(trim(" + body_sql("text") + r")) in ('media omitted', 'sticker omitted', 'image omitted') or not regexp_matches(text, '[\p{L}\p{Nd}]') end"),
    "flt3_quality_reason": (lambda t: ql.quality_reason(t), f"case when length(text) < 15 then 'too_short' when {sql_any('lower(text)', LATIN.omitted)} then 'omitted_content' when trim(text) in ({sql_list(LATIN.placeholders)}) then 'placeholder_only' when trim(text) in ({sql_list(LATIN.generic)}) and length(text) < 12 then 'too_generic' else 'passed' end"),
    "flt4_high_quality": (lambda t: ql.is_high_quality(t, fx.is_script_related(t)), f"not (trim(lower(text)) in ({sql_list(LATIN.low_value_prefixed)}) or {sql_any('lower(text)', [p.lower() for p in LATIN.filter_patterns])} or (length({body_sql('text')}) <= 8 and not {TAG}) or (len(list_distinct(string_split(replace({body_sql('text')}, ' ', ''), ''))) < 4 and length({body_sql('text')}) > 20))"),
    "flt5_quality_score": (lambda t: ql.quality_score(t, fx.is_script_related(t), t.contains("?"), LATIN), f"cast({SCORE_SQL} as int)"),
    "flt6_interview_ok": (lambda t: ql.interview_ok(t), f"length(trim(text)) >= 10 and len({WORDS}) >= 3"),
    "flt7_for_memory": (lambda t: ql.for_memory(t), f"length(text) between 40 and 480 and len(regexp_extract_all(text, '\\?')) <= 1 and {sql_any('lower(text)', LATIN.memory_terms)}"),
    "flt8_for_snippet": (lambda t: ql.for_snippet(t), f"length(text) >= 60 and contains(text, chr(10)) and {sql_any('text', LATIN.list_markers)}"),
    "flt9_issues": (lambda t: F.concat_ws(",", ql.issues(t)), r"array_to_string(list_filter([case when regexp_matches(text, '(?i)\bye\?\s*$') then 'ends_with_ye' end, case when len(" + WORDS + r") <= 5 then 'very_short' end, case when " + REPEATS + r" then 'word_repetition' end, case when " + sql_any("lower(text)", LATIN.meta_patterns) + r" then 'meta_content' end], lambda x: x is not null), ',')"),
    "flt12_has_tags": (lambda t: ql.has_tags(fx.tokens(t), ["The", "and"]), f"list_has_all({TOKENS}, ['the', 'and'])"),
    "fn29_hashed_bag": (lambda t: F.concat_ws(",", F.transform(vectors.hashed_bag(fx.words(F.lower(t))), lambda x: F.round(x * 1000).cast("int").cast("string"))), HASHED_SQL),
    "fn15_kept_words": (lambda t: F.size(F.filter(curation.roman_words(F.concat(ROMAN[0], t)), lambda x: curation.stays_roman(x))), ROMAN_SQL),
    "cls2_explicit_switch": (lambda t: conv.explicit_switch(F.concat(SWITCH[0], t)), before(SWITCH, SWITCH_SQL)),
    "cls3_from_location": (lambda t: conv.from_location(F.concat(PLACES[0], F.lit(" "), F.col("source"))), "case " + " ".join(f"when contains(lower({PLACES[1]} || ' ' || source), '{k}') then '{c}'" for k, c in LATIN.locations) + " end"),
    "cls4_best_keyword": (lambda t: let(conv.best_keyword(F.concat(SAID[0], t)), lambda b: F.concat(b["context"], F.lit(":"), F.round(b["score"] * 10000).cast("long").cast("string"))), before(SAID, f"{CONTEXT_SQL} || ':' || cast(round({BEST_SQL} * 10000) as bigint)")),
    "cls5_intent": (lambda t: let(conv.intent(F.concat(ASKED[0], t), LATIN), lambda x: F.concat_ws(",", x["needs_clarifying"].cast("string"), x["should_mix"].cast("string"))), before(ASKED, f"concat_ws(',', ({INTENT_SQL})::varchar, ({MIX_SQL})::varchar)")),
    "cls6_reply_plan": (lambda t: let(conv.reply_plan(F.concat(ASKED[0], t), LATIN), lambda x: F.concat_ws(",", x["lang"], x["greeting"], x["asks"].cast("string"))), before(ASKED, PLAN_SQL)),
    "cls6_snippet_lines": (lambda t: F.md5(F.array_join(conv.snippet_lines(F.concat(BULLETS[0], t), 2**31 - 1), "\n").cast("binary")), before(BULLETS, LINES_SQL)),
    "llm4_padded": (lambda t: conv.padded(F.col("n_chars")), "cast((n_chars + 7) // 8 * 8 as bigint)"),
    "llm5_clamp_tokens": (lambda t: conv.clamp_new_tokens(F.lit(512), F.floor(F.col("n_chars") / 4), 2048), "case when n_chars // 4 < 2048 then least(512, 2048 - n_chars // 4) end"),
    "llm6_cut_at_stop": (lambda t: F.md5(fx.cut_at_stop(t, ["###", "\n\n", " the "]).cast("binary")), "md5(case when contains(text, '###') then substr(text, 1, instr(text, '###') - 1) when contains(text, chr(10) || chr(10)) then substr(text, 1, instr(text, chr(10) || chr(10)) - 1) when contains(text, ' the ') then substr(text, 1, instr(text, ' the ') - 1) else text end)"),
    "par14_tool_calls": (lambda t: F.size(parse.tool_calls(F.concat(F.expr("repeat('<tool_call name=\"a\">{\"x\": {\"y\": 1}}</tool_call>', cast(doc_id % 4 as int))"), t, F.lit('<tool_call name="b"></tool_call><tool_call name="c">{bad</tool_call>')))), "cast(doc_id % 4 + 1 as int)"),
    "val5_rule_metrics": (lambda t: let(ql.rule_metrics(t, F.element_at(F.array(F.lit("en"), F.lit("mixed"), F.lit("te")), (F.col("doc_id") % 3 + 1).cast("int")), fx.is_script_related(t), None, F.when(F.col("doc_id") % 2 == 0, "The"), LATIN), lambda r: F.concat_ws(",", *[r[k].cast("int").cast("string") for k in ("greeter_ok", "lang_ok", "clarifying_ok", "len_ok", "pass")])), RULES_SQL),
    "llm9_theme_coverage": (lambda t: conv.theme_coverage(t, F.array(F.lit("The"), F.lit("und"), F.lit("que"))), "cast(contains(lower(text), 'the') as int) + cast(contains(lower(text), 'und') as int) + cast(contains(lower(text), 'que') as int)"),
}


def scalar_query(expression: Callable[[Column], Column]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: table(spark, sf_dir, "documents").select("doc_id", expression(F.col("text")).alias("value"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: scalar_query(e) for name, (e, _) in SCALARS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql if sql.startswith("with") else f"select doc_id, {sql} as value from documents" for name, (_, sql) in SCALARS.items() if sql}
