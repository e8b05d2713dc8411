"""Filters, scores, issue lists and gates over texts and chat examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..config import DEFAULT, Settings
from ..functions import text as fx


def skip_incoming(text: Column) -> Column:
    """Messages that are never part of a burst. [FLT1]"""
    t = F.trim(text)
    low = F.lower(t)
    return (t == "") | low.isin("media omitted", "<media omitted>", "sticker omitted") | (low.endswith(" omitted") & ~low.contains("\nomitted")) | low.startswith("messages and calls are end-to-end encrypted")


def skip_reply(reply: Column, s: Settings = DEFAULT) -> Column:
    """Replies that make no example: omitted media, or nothing but marks. [FLT2]"""
    body = F.lower(F.trim(fx.strip_prefix(reply, s)))
    return body.isin("media omitted", "sticker omitted", "image omitted") | ~body.rlike(r"[\p{L}\p{Nd}]")


def quality_reason(output: Column, least: int = 15, s: Settings = DEFAULT) -> Column:
    """'passed' or the first reason to drop. [FLT3]"""
    t = F.trim(output)
    return F.when(F.length(output) < least, "too_short").when(fx.any_of(F.lower(output), s.omitted), "omitted_content").when(t.isin(*s.placeholders), "placeholder_only").when(t.isin(*s.generic) & (F.length(output) < 12), "too_generic").otherwise("passed")


def is_high_quality(output: Column, priority: Column, s: Settings = DEFAULT) -> Column:
    """[FLT4]"""
    low = F.lower(output)
    body = F.when(low.startswith(s.prefix.lower()), F.substring(low, len(s.prefix) + 1, 2**31 - 1)).otherwise(low)
    return ~(F.trim(low).isin(*s.low_value_prefixed) | fx.any_of(low, [p.lower() for p in s.filter_patterns]) | ((F.length(body) <= 8) & ~priority) | fx.is_char_spam(body))


def score_parts(output: Column, script_tag: Column, clarifying_tag: Column, s: Settings = DEFAULT) -> list[tuple[str, Column, int]]:
    """(reason, condition, points) of the score."""
    body = fx.strip_prefix(output, s)
    n = F.length(body)
    return [
        ("script tag", script_tag, 25), ("clarifying tag", clarifying_tag, 20),
        ("long response", n > 100, 15), ("medium response", (n > 50) & (n <= 100), 10), ("decent length", (n > 25) & (n <= 50), 5), ("very short", n <= 12, -20),
        ("second script", fx.has_script(body, s), 10), ("low-value response", F.lower(F.trim(body)).isin(*s.low_value), -40),
        ("filter pattern", fx.any_of(F.lower(output), [p.lower() for p in s.filter_patterns]), -50),
        ("expressive emoji", fx.any_of(output, s.emoji), 5), ("asks back", body.contains("?"), 5),
    ]


def quality_score(output: Column, script_tag: Column, clarifying_tag: Column, s: Settings = DEFAULT) -> Column:
    """0 to 100. [FLT5]"""
    raw = sum((F.when(c, p).otherwise(0) for _, c, p in score_parts(output, script_tag, clarifying_tag, s)), F.lit(50))
    return F.greatest(F.lit(0), F.least(F.lit(100), raw))


def score_reasons(output: Column, script_tag: Column, clarifying_tag: Column, s: Settings = DEFAULT) -> Column:
    """The points given, as texts. [FLT5]"""
    return F.filter(F.array(*[F.when(c, f"{p:+d}: {r}") for r, c, p in score_parts(output, script_tag, clarifying_tag, s)]), lambda x: x.isNotNull())


def interview_ok(response: Column) -> Column:
    """[FLT6]"""
    return (F.length(F.trim(response)) >= 10) & (fx.word_count(response) >= 3)


def for_memory(text: Column, s: Settings = DEFAULT) -> Column:
    """[FLT7]"""
    return F.length(text).between(40, 480) & (F.regexp_count(text, F.lit(r"\?")) <= 1) & fx.any_of(F.lower(text), s.memory_terms)


def for_snippet(text: Column, s: Settings = DEFAULT) -> Column:
    """[FLT8]"""
    return (F.length(text) >= 60) & text.contains("\n") & fx.any_of(text, s.list_markers)


def ends_with_ye(text: Column) -> Column:
    return text.rlike(r"(?i)\bye\?\s*$")


def issues(text: Column, s: Settings = DEFAULT) -> Column:
    """Array of the problems of a response. [FLT9]"""
    found = [("ends_with_ye", ends_with_ye(text)), ("very_short", fx.word_count(text) <= 5), ("word_repetition", fx.repeats_word(text)), ("meta_content", fx.any_of(F.lower(text), s.meta_patterns))]
    return F.filter(F.array(*[F.when(c, n) for n, c in found]), lambda x: x.isNotNull())


def needs_generation(messages: Column, forms: tuple[str, ...] = fixed.FORMS) -> Column:
    """No assistant message says anything but a form to fill in. [FLT10]"""
    return ~F.exists(messages, lambda m: F.coalesce((m["role"] == "assistant") & m["content"].rlike(r"\S") & ~fx.any_of(m["content"], forms), F.lit(False)))


def turn_complete(transcript: Column, response: Column, lang: Column, langs: list[str]) -> Column:
    """[FLT11]"""
    return F.coalesce((F.length(F.trim(transcript)) >= 5) & (F.length(F.trim(response)) >= 10) & lang.isin(*langs), F.lit(False))


def has_tags(tags: Column, wanted: list[str]) -> Column:
    """All wanted tags are there, whatever their case. [FLT12]"""
    return F.size(F.array_except(F.array(*[F.lit(w.lower()) for w in wanted]).cast("array<string>"), F.transform(tags, lambda t: F.lower(t)))) == 0


ROLES = ("system", "user", "assistant", "tool")


def roles_ok(messages: Column, roles: tuple[str, ...] = ROLES) -> Column:
    """[FLT16]"""
    return F.forall(messages, lambda m: m["role"].isin(*roles))


def chat_errors(messages: Column, roles: tuple[str, ...] = ROLES) -> Column:
    """What is wrong with the structure of a chat example; an empty array if nothing. [VAL1]"""
    n = F.coalesce(F.size(messages), F.lit(0))
    m = F.coalesce(messages, F.array().cast("array<struct<role:string,content:string>>"))
    checks = [
        ("no messages", n <= 0), ("unknown role", ~F.coalesce(roles_ok(m, roles), F.lit(False))),
        ("blank content", F.exists(m, lambda x: F.coalesce(F.trim(x["content"]), F.lit("")) == "")),
        ("no user message", ~F.exists(m, lambda x: x["role"] == "user")), ("no assistant message", ~F.exists(m, lambda x: x["role"] == "assistant")),
    ]
    return F.filter(F.array(*[F.when(c, e) for e, c in checks]), lambda x: x.isNotNull())


def gates(row: DataFrame, checks: tuple[tuple[str, float | None, float | None, str], ...], below: tuple[str, ...] = ()) -> DataFrame:
    """(check, value, low, high, status) of a one-row frame with a column for each check; a bound of None isn't checked.

    A miss has the status that the check names: 'fail', or 'warn' and 'info', which fail nothing. A value of ``below``
    must lie below its upper bound. [VAL2, VAL3]
    """
    number = lambda x: F.lit(x).cast("double")
    items = []
    for name, low, high, miss in checks:
        v = F.col(f"`{name}`").cast("double")
        under = F.lit(True) if high is None else v < high if name in below else v <= high
        ok = (v >= low if low is not None else F.lit(True)) & under
        items.append(F.struct(F.lit(name).alias("check"), v.alias("value"), number(low).alias("low"), number(high).alias("high"), F.when(ok, "pass").otherwise(miss).alias("status")))
    return row.select(F.explode(F.array(*items)).alias("x")).select("x.*")


def dataset_gates(rows: DataFrame) -> DataFrame:
    """Gates over examples (hash, domain, lang, valid, tokens, has_tool, prompt, has_metadata). [VAL2]

    ``tokens`` at place int(0.95 n) count; domains are those of examples with metadata; a null prompt isn't counted.
    """
    from .stats import nearest_rank

    n, share = F.count("*"), lambda c: F.coalesce(F.try_divide(F.count_if(c), F.count("*")), F.lit(0.0))
    measures = [n.alias("total"), (n - F.countDistinct("hash")).alias("duplicates")]
    measures += [share(F.col("has_metadata") & (F.col("domain") == d)).alias(f"domain {d}") for d in ("film", "persona", "tools", "general")]
    measures += [share(F.col("lang") == x).alias(f"lang {x}") for x in ("te", "en", "mixed")]
    measures += [F.count_if(~F.col("valid")).alias("invalid"), F.count_if("has_tool").alias("tool examples"), F.countDistinct(F.substring("prompt", 1, 100)).alias("system prompts"), share(F.col("has_metadata")).alias("metadata share")]
    p95 = nearest_rank(rows, "tokens", [0.95]).agg(F.max("value")).scalar()
    return gates(rows.agg(*measures).withColumn("p95 tokens", F.coalesce(p95, F.lit(0))), fixed.DATASET_GATES)


def answer_gates(answers: DataFrame, text: Column, s: Settings = DEFAULT) -> DataFrame:
    """Gates over the last answer of each example. [VAL3]"""
    w, n = fx.word_count(F.col("t")), F.count("*")
    pct = lambda c: 100 * F.try_divide(F.count_if(c), n)
    found = answers.select(text.alias("t")).filter(F.length("t") > 0)
    row = found.agg(F.avg(w).alias("avg words"), pct(w <= 5).alias("very short pct"), F.count_if(ends_with_ye(F.col("t"))).alias("ends with ye"), F.count_if(fx.any_of(F.lower("t"), s.meta_patterns)).alias("meta content"), pct(fx.lang_markers(F.col("t"), s) == s.switched_lang).alias("code-switched pct"))
    return gates(row, fixed.ANSWER_GATES, below=("very short pct",))


def training_advice(n: Column, p95: Column, p99: Column) -> Column:
    """Instance, sequence length, batch, accumulation, epochs, steps and cost by data size and token counts. [VAL4]"""
    small, long_ = n < 1200, p99 > 2048
    batch, steps = F.when(long_, 2).otherwise(1), F.when(n < 600, 8).otherwise(64)
    epochs = F.when(n > 1000, 2).otherwise(5)
    total = F.floor(n / (batch * steps)) * epochs
    minutes = total * 1.5 / 60
    return F.struct(
        F.when(small, "ml.g5.2xlarge").otherwise("ml.g5.12xlarge").alias("instance"), F.when(long_, 3072).when(p95 < 1024, 1536).otherwise(2048).alias("max_length"), batch.alias("batch_size"), steps.alias("accumulation"),
        epochs.alias("epochs"), total.alias("steps"), minutes.alias("minutes"), (F.when(small, 1.5).otherwise(9.0) * minutes / 60).alias("cost"),
    )


LINE_END = r"[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def rule_metrics(response: Column, lang: Column, asks: Column, max_lines: Column | None = None, must_start: Column | None = None, s: Settings = DEFAULT) -> Column:
    """Rules of an evaluation case: prefix, language, exactly one or no question mark, non-blank lines (6 at most), all of them. [VAL5]

    ``must_start`` null or empty: any start will do; ``asks`` null: no question is asked for.
    """
    start = F.lit("") if must_start is None else F.coalesce(must_start, F.lit(""))
    most = F.lit(6) if max_lines is None else F.coalesce(max_lines, F.lit(6))
    marks = F.length(response) - F.length(F.replace(response, F.lit("?"), F.lit("")))
    lines = F.size(F.filter(F.split(response, LINE_END), lambda x: x.rlike(r"\S")))
    parts = {
        "greeter_ok": response.startswith(start), "lang_ok": F.coalesce(fx.lang_three_way(response, s) == lang, F.lit(False)),
        "clarifying_ok": F.when(F.coalesce(asks, F.lit(False)), marks == 1).otherwise(marks == 0), "len_ok": lines <= most,
    }
    every = None
    for p in parts.values():
        every = p if every is None else every & p
    return F.struct(*[p.alias(k) for k, p in parts.items()], every.alias("pass"))
