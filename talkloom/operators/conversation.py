"""Context detection and chat examples: flattening, masks, prompt windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import text as fx


def _lookup(names: dict[str, str], key: Column) -> Column:
    return F.coalesce(*[F.when(key == k, v) for k, v in names.items()])


def explicit_switch(message: Column, s: Settings = DEFAULT) -> Column:
    """Context of the first pattern whose word is known; NULL if none. [CLS2]"""
    low = F.lower(message)
    return F.coalesce(*[_lookup(s.switch_words, F.regexp_extract(low, p, 1)) for p in s.switch_patterns])


def from_location(location: Column, s: Settings = DEFAULT) -> Column:
    """[CLS3]"""
    low = F.lower(location)
    return F.coalesce(*[F.when(low.contains(k), c) for k, c in s.locations])


def keyword_scores(message: Column, s: Settings = DEFAULT) -> Column:
    """Array of (context, score): substring hits and word hits over 0.3 of the keywords, 1 at most. [CLS4, JN19]"""
    low = F.lower(message)
    toks = F.array_distinct(F.filter(F.split(low, r"[^\p{L}\p{N}_]+"), lambda w: w != ""))
    out = []
    for name, words in s.context_keywords:
        hits = sum((F.when(low.contains(w), 1).otherwise(0) for w in words), F.lit(0)) + F.size(F.array_intersect(toks, F.array(*[F.lit(w) for w in words])))
        out.append(F.struct(F.lit(name).alias("context"), F.least(hits / F.lit(len(words) * 0.3), F.lit(1.0)).alias("score")))
    return F.array(*out)


def best_keyword(message: Column, s: Settings = DEFAULT) -> Column:
    """The highest score, the first listed of equal ones; NULL if all are 0. [CLS4]"""
    none = F.lit(None).cast("struct<context:string,score:double>")
    return F.aggregate(keyword_scores(message, s), none, lambda best, x: F.when((x["score"] > F.coalesce(best["score"], F.lit(0.0))), x).otherwise(best))


def detect_contexts(turns: DataFrame, session: str, order: str, message: str, location: str | None = None, default: str = "writers_room", s: Settings = DEFAULT) -> DataFrame:
    """Adds context and confidence of every turn: switch 1.0, location 0.9, keywords, the context before 0.6, default 0.5. [CLS1]

    A keyword of over 0.7, or of over 0.5 where no context is set, switches; any turn sets a context, so the
    rule for keywords between 0.5 and 0.7 matters on a session's first turn only.
    """
    w = Window.partitionBy(session).orderBy(order)
    place = from_location(F.col(location), s) if location else F.lit(None).cast("string")
    rows = turns.withColumn("_switch", explicit_switch(F.col(message), s)).withColumn("_place", place).withColumn("_word", best_keyword(F.col(message), s)).withColumn("_first", F.row_number().over(w) == 1)
    strong = (F.col("_word.score") > 0.7) | ((F.col("_word.score") > 0.5) & F.col("_first"))
    rows = rows.withColumn("_strong", F.coalesce(strong, F.lit(False)))
    own = F.coalesce("_switch", "_place", F.when(F.col("_strong"), F.col("_word.context")), F.when(F.col("_first"), F.lit(default)))
    rows = rows.withColumn("_own", own).withColumn("context", F.last("_own", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sure = F.when(F.col("_switch").isNotNull(), 1.0).when(F.col("_place").isNotNull(), 0.9).when(F.col("_strong"), F.col("_word.score")).when(F.col("_first"), 0.5).otherwise(0.6)
    return rows.withColumn("confidence", sure).drop("_switch", "_place", "_word", "_first", "_strong", "_own")


def intent(message: Column, s: Settings = DEFAULT) -> Column:
    """(needs_clarifying, should_mix): the first rule that a request meets decides. [CLS5]"""
    low = F.lower(message)
    has = low.contains
    own = (fx.lang_three_way(message, s) == s.script_lang) | F.regexp_replace(low, r"^\s+", "").startswith(s.script_greeting) | has(s.script_name)
    settled = sum((F.when(has(k), 1).otherwise(0) for k in s.knobs), F.lit(0))
    asks = F.when(own, False).when(has("first step") & has("outline"), False).when(has("need only discovery"), True).when(has("give me next beats") | has("already locked"), False)
    asks = asks.when(has("outline") | has("beat") | has("plan"), settled < 4).when(has("need your default pitch"), False).when(has("pitch"), True).otherwise(False)
    mixes = has("english lo") | has("mix") | (has("english") & has(s.script_name))
    return F.struct(asks.alias("needs_clarifying"), mixes.alias("should_mix"))


def reply_plan(message: Column, s: Settings = DEFAULT) -> Column:
    """(lang, greeting, asks) of the reply to a request: mixed if it asks for that, else the second language if it is in or about it;
    a mixed reply asks nothing back. [CLS6]"""
    low = F.lower(message)
    own = (fx.lang_three_way(message, s) == s.script_lang) | F.regexp_replace(low, r"^\s+", "").startswith(s.script_greeting) | low.contains(s.script_name)
    wants = intent(message, s)
    lang = F.when(wants["should_mix"], s.mixed_lang).when(own, s.script_lang).otherwise(s.other_lang)
    return F.struct(lang.alias("lang"), F.when(wants["should_mix"] | own, f"{s.script_greeting},").otherwise(s.prefix.strip()).alias("greeting"), (wants["needs_clarifying"] & ~wants["should_mix"]).alias("asks"))


def snippet_lines(body: Column, most: int = 4, s: Settings = DEFAULT) -> Column:
    """The first lines of a snippet without bullets and greetings, blank ones dropped. [CLS6]"""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    bare = F.transform(F.split(body, "\n"), lambda x: strip(F.regexp_replace(x, r"^[•\- ]+|[•\- ]+$", "")))
    greeted = lambda x: F.lower(x).startswith(f"{s.script_greeting},") | F.lower(x).startswith(s.prefix.strip().lower())
    said = F.transform(bare, lambda x: F.when(greeted(x), strip(F.regexp_replace(x, "^[^,]*,", ""))).otherwise(x))
    return F.slice(F.filter(said, lambda x: x != ""), 1, most)


def topic_words(texts: Column, n: int = 10) -> Column:
    """Distinct words of over four letters, in order of the alphabet, n at most. [AG26]"""
    words = F.flatten(F.transform(texts, lambda t: F.filter(F.split(F.lower(t), r"\s+"), lambda w: F.length(w) > 4)))
    return F.slice(F.sort_array(F.array_distinct(words)), 1, n)


# --- chat examples


def as_messages(*pairs: tuple[str, Column]) -> Column:
    """[FN41]"""
    return F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in pairs])


def chat_examples(turns: DataFrame, key: str, order: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """(key, messages): the turns of each conversation in order, with ``extra`` columns as further fields. [FN41]"""
    fields = ("role", "content", *extra)
    item = F.struct(F.col(order).alias("o"), "role", F.col("text").alias("content"), *extra)
    lists = turns.groupBy(key).agg(F.collect_list(item).alias("m"))
    in_order = F.array_sort("m", lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0))
    return lists.select(key, F.transform(in_order, lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias("messages"))


def flatten_tools(messages: Column) -> Column:
    """Messages (role, content, name, tool_calls of (name, arguments as JSON)) as plain (role, content). [LLM1]

    An assistant's calls follow its text as markup, one a line; a tool's message becomes a user's that names the tool.
    """
    named = lambda x: F.coalesce(x["name"], F.lit("tool"))
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    call = lambda c: F.concat(F.lit('<tool_call name="'), named(c), F.lit('">'), F.coalesce(c["arguments"], F.lit("{}")), F.lit("</tool_call>"))
    message = lambda role, content: F.struct(role.alias("role"), content.alias("content"))

    def flat(m: Column) -> Column:
        said = F.coalesce(m["content"], F.lit(""))
        calls = strip(F.concat(said, F.lit("\n"), F.array_join(F.transform(m["tool_calls"], call), "\n")))
        tool = strip(F.concat(F.lit("[tool:"), named(m), F.lit("] "), said))
        plain = F.when((m["role"] == "assistant") & (F.coalesce(F.size(m["tool_calls"]), F.lit(0)) > 0), message(m["role"], calls))
        return plain.when(m["role"] == "tool", message(F.lit("user"), tool)).otherwise(message(m["role"], said))

    return F.transform(messages, flat)


def first_tool_calls(messages: Column) -> Column:
    """Names of the tools that the first message with calls names ('unknown' where a call has none). [AG13]"""
    bearing = F.filter(messages, lambda m: m["tool_calls"].isNotNull())
    return F.coalesce(F.transform(F.get(bearing, F.lit(0))["tool_calls"], lambda c: F.coalesce(c["name"], F.lit("unknown"))), F.array().cast("array<string>"))


def has_assistant_text(messages: Column) -> Column:
    """[LLM2]"""
    return F.exists(messages, lambda m: (m["role"] == "assistant") & (F.length(m["content"]) > 0))


def assistant_spans(messages: Column) -> Column:
    """(from, to) character offsets of the assistant's messages in the messages joined. [LLM3]"""
    start = F.array().cast("array<struct<role:string,lo:int,hi:int>>")
    add = lambda acc, m: F.concat(acc, F.array(F.struct(m["role"].alias("role"), F.coalesce(F.element_at(acc, -1)["hi"], F.lit(0)).alias("lo"), (F.coalesce(F.element_at(acc, -1)["hi"], F.lit(0)) + F.length(m["content"])).alias("hi"))))
    spans = F.aggregate(messages, start, lambda acc, m: F.when(F.size(acc) > 0, add(acc, m)).otherwise(F.array(F.struct(m["role"].alias("role"), F.lit(0).alias("lo"), F.length(m["content"]).alias("hi")))))
    return F.transform(F.filter(spans, lambda x: x["role"] == "assistant"), lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi")))


def padded(n: Column, step: int = 8) -> Column:
    """[LLM4]"""
    return (F.ceil(n / step) * step).cast("long")


def clamp_new_tokens(asked: Column, used: Column, most: int) -> Column:
    """NULL where the input alone is too long. [LLM5]"""
    return F.when(used < most, F.least(asked, F.lit(most) - used))


def theme_coverage(text: Column, themes: Column) -> Column:
    """How many of the expected themes a text names. [LLM9]"""
    return F.size(F.filter(themes, lambda t: F.lower(text).contains(F.lower(t))))
