"""Scalar text functions as Column expressions. Letters in brackets name the operator of the survey."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from ..config import DEFAULT, Settings
from .vectors import let


def any_of(text: Column, words: Iterable[str]) -> Column:
    """True if the text contains one of the words (plain substrings, found byte by byte rather than as a pattern)."""
    return let(text, lambda t: reduce(or_, [t.contains(w) for w in words]))


def words(text: Column) -> Column:
    """Pieces between white space, none of them empty. [FN26]"""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """[FN26]"""
    return F.size(words(text))


def has_script(text: Column, s: Settings = DEFAULT) -> Column:
    """[FN1]"""
    return text.rlike(s.script_range)


def script_chars(text: Column, s: Settings = DEFAULT) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, s.script_range, ""))


def lang_two_way(text: Column, s: Settings = DEFAULT) -> Column:
    """[FN2]"""
    return F.when(has_script(text, s), s.script_lang).otherwise(s.other_lang)


def lang_three_way(text: Column, s: Settings = DEFAULT) -> Column:
    """[FN3]"""
    script = has_script(text, s)
    return F.when(script & text.rlike("[A-Za-z]"), s.mixed_lang).when(script, s.script_lang).otherwise(s.other_lang)


def lang_switched(text: Column, s: Settings = DEFAULT) -> Column:
    """Switched needs an English run of three letters. [FN4]"""
    script = has_script(text, s)
    return F.when(script & text.rlike("[a-zA-Z]{3,}"), s.switched_lang).when(script, s.script_lang).otherwise(s.other_lang)


def lang_markers(text: Column, s: Settings = DEFAULT) -> Column:
    """Script characters or words decide, then romanised markers. [FN5]"""
    scripted = F.size(F.filter(words(text), lambda w: w.rlike(s.script_range)))
    return F.when((script_chars(text, s) > 5) | (scripted > 2), s.script_lang).when(any_of(F.lower(text), [m.lower() for m in s.romanized_markers]), s.switched_lang).otherwise(s.other_lang)


def lang_ratio(text: Column, s: Settings = DEFAULT) -> Column:
    """Share of script characters among all but U+0020. [FN6]"""
    share = script_chars(text, s) / F.nullif(F.length(F.replace(text, F.lit(" "), F.lit(""))), F.lit(0))
    return F.when(share > 0.5, s.script_lang).when(share > 0.1, s.switched_lang).otherwise(s.other_lang)


def lang_category(text: Column, s: Settings = DEFAULT) -> Column:
    """Dominance by the share of plain English words. [FN7]"""
    english = F.size(F.filter(words(text), lambda w: w.rlike("^[A-Za-z]+$")))
    share = english / F.greatest(word_count(text), F.lit(1))
    return F.when(~has_script(text, s), "english_only").when(share > 0.7, "english_dominant").when(share > 0.3, "code_switched").otherwise("script_dominant")


# Marks of the second language in Latin letters, and frequent English words.
ROMANIZED = (r"\b(nenu|naku|meeru|miku)\b", r"\b(undi|undhi|unnadi)\b", r"\b(chesta|chestha|chesanu)\b", r"\b(kavali|vaddu)\b", r"\b(enti|emiti|ela)\b", r"\b(kosam|gurinchi)\b", r"\b(ledu|avunu)\b", r"\b(inka|antey|ante)\b")
STOP_WORDS = ("the", "a", "an", "is", "are", "was", "were", "be", "been", "to", "of", "in", "for", "on", "with", "at", "by", "from", "and", "but", "or", "not", "i", "you", "he", "she", "it", "we", "they", "this", "that", "what", "which", "who", "when", "where", "why", "how")


def lang_profile(text: Column, s: Settings = DEFAULT) -> Column:
    """Struct of language, ratios, script and romanisation flags and confidence. [FN8]"""
    t = F.coalesce(text, F.lit(""))
    low = F.lower(t)
    toks = F.filter(F.split(low, r"(?U)[^\w]+"), lambda w: w != "")
    counts = F.struct(
        F.regexp_count(t, F.lit(r"\p{L}")).alias("letters"), F.regexp_count(t, F.lit(r"(?=\p{L})" + s.script_range)).alias("script"), F.regexp_count(t, F.lit("[A-Za-z]")).alias("ascii"),
        sum((F.regexp_count(low, F.lit(p)) for p in ROMANIZED), F.lit(0)).alias("roman"), F.size(toks).alias("words"), F.size(F.filter(toks, lambda w: w.isin(*STOP_WORDS))).alias("stops"), (F.trim(t) == "").alias("blank"),
    )
    # bound to a lambda variable, each count is taken once however often the rules below name it
    return let(counts, lambda c: let(_shares(c), lambda x: _verdict(x, s)))


def _shares(c: Column) -> Column:
    part = lambda x, y: F.coalesce(x / F.nullif(y, F.lit(0)), F.lit(0.0))
    return F.struct(part(c["script"], c["letters"]).alias("sr"), part(c["ascii"], c["letters"]).alias("er"), part(c["stops"], c["words"]).alias("stops"), (c["roman"] >= 2).alias("rom"), (c["script"] > 0).alias("scr"), c["roman"].alias("roman"), c["blank"].alias("blank"))


def _verdict(c: Column, s: Settings) -> Column:
    shift = F.when(c["rom"] & ~c["scr"], F.least(F.lit(0.5), c["roman"] * 0.1)).otherwise(0.0)
    sr, er = c["sr"] + shift, F.when(shift > 0, F.greatest(F.lit(0.0), c["er"] - shift)).otherwise(c["er"])
    as_script = ~c["scr"] & c["rom"] & (c["stops"] <= 0.4)
    lang = F.when(c["scr"], F.when(sr > 0.7, s.script_lang).when(er > 0.7, s.other_lang).otherwise(s.mixed_lang)).when(c["rom"], F.when(c["stops"] > 0.4, s.mixed_lang).otherwise(s.script_lang)).otherwise(s.other_lang)
    sr2, er2 = F.when(as_script, 1.0 - c["stops"]).otherwise(sr), F.when(as_script, c["stops"]).otherwise(er)
    mixed = F.when(c["scr"], F.when(sr > 0.7, er).when(er > 0.7, sr).otherwise(1.0 - F.abs(sr - er))).when(c["rom"], F.when(c["stops"] > 0.4, 0.5).otherwise(c["stops"])).otherwise(0.0)
    sure = F.when(lang == s.script_lang, sr2).when(lang == s.other_lang, F.when(c["rom"], 1.0 - c["roman"] * 0.1).otherwise(er2)).otherwise(mixed)
    r = lambda x: F.when(c["blank"], 0.0).otherwise(F.round(x, 3))
    return F.struct(F.when(c["blank"], s.other_lang).otherwise(lang).alias("lang"), r(sr2).alias("script_ratio"), r(er2).alias("english_ratio"), r(mixed).alias("mixed_ratio"), (c["scr"] & ~c["blank"]).alias("has_script"), (c["rom"] & ~c["blank"]).alias("has_romanized"), r(F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure))).alias("confidence"))


def is_code_switched(profile: Column, s: Settings = DEFAULT) -> Column:
    """On the struct of lang_profile. [FN9]"""
    return (profile["lang"] == s.mixed_lang) | (profile["has_script"] & (profile["english_ratio"] > 0.1))


def normalize_lang(domain_lang: Column, had_script: Column, s: Settings = DEFAULT) -> Column:
    """Names of languages made one; where none is known, whether the text had the script. [FN11]"""
    low = F.lower(F.trim(domain_lang))
    return F.when(low.isin("te", "telugu"), s.script_lang).when(low.isin("en", "english"), s.other_lang).when(low.isin("te-en", "mixed", "code-switched"), s.switched_lang).when(had_script, s.script_lang).otherwise(s.other_lang)


def normalize_romanized(text: Column) -> Column:
    """[FN13]"""
    for old, new in ((".h", ""), (".m", "m"), ("~n", "n"), ("~N", "n")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def redact_pii(text: Column, s: Settings = DEFAULT) -> Column:
    """Phone numbers, then addresses, then anything like one. [FN18]"""
    phones = F.regexp_replace(text, s.phone, "{PHONE}")
    # an address has an @: texts without one are spared two passes
    return F.when(text.contains("@"), F.regexp_replace(F.regexp_replace(phones, s.email, "{EMAIL}"), s.email_lax, "{EMAIL}")).otherwise(phones)


def redact_names(text: Column, names: Column) -> Column:
    """``names``: array of structs (name, placeholder); each in turn, whatever its case, inside words too. [FN17]"""
    return F.aggregate(names, text, lambda t, n: F.regexp_replace(t, F.concat(F.lit(r"(?i)\Q"), n["name"], F.lit(r"\E")), n["placeholder"]))


def ensure_prefix(text: Column, s: Settings = DEFAULT) -> Column:
    """[FN19]"""
    t = F.ltrim(text)
    word = s.prefix.strip()
    return F.when(F.lower(t).startswith(word.lower()), t).otherwise(F.concat(F.lit(word + " "), t))


def strip_prefix(text: Column, s: Settings = DEFAULT) -> Column:
    """[FN20]"""
    return F.when(text.startswith(s.prefix), F.substring(text, len(s.prefix) + 1, 2**31 - 1)).otherwise(text)


def strip_placeholders(text: Column, every: bool = True) -> Column:
    """Name placeholders with their colon (all, or only the first name's literal one with line ends made spaces). [FN21]"""
    return F.regexp_replace(text, r"\{NAME_[A-Z]\}:\s*", "") if every else F.replace(F.replace(text, F.lit("{NAME_A}"), F.lit("")), F.lit("\n"), F.lit(" "))


def is_script_related(text: Column, s: Settings = DEFAULT) -> Column:
    """Substrings count: "act" is in "fact". [FN22]"""
    return any_of(F.lower(text), s.script_keywords)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits. [FN23]"""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def tokens_by_words(text: Column, s: Settings = DEFAULT) -> Column:
    """Words times 1.3, 1.5 with the script, cut to a whole number. [FN24]"""
    return (word_count(text) * F.when(has_script(text, s), F.lit(1.5)).otherwise(F.lit(1.3))).cast("int")


def tokens_by_chars(*texts: Column) -> Column:
    """All characters over four, rounded down once. [FN25]"""
    return F.floor(sum((F.length(F.coalesce(t, F.lit(""))) for t in texts), F.lit(0)) / 4)


def content_hash(*parts: Column, sep: str = "") -> Column:
    """First 16 hex digits of SHA-256 over the parts joined. [FN27]"""
    return F.substring(F.sha2(F.concat_ws(sep, *parts), 256), 1, 16)


def preview(text: Column, n: int = 200) -> Column:
    """[FN35]"""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def title(text: Column, n: int = 80) -> Column:
    """First line of the trimmed text. [FN36]"""
    return F.substring(F.trim(F.split(F.trim(text), "\n")[0]), 1, n)


def html_escape(text: Column) -> Column:
    """[FN37]"""
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "<br/>")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def has_profanity(text: Column, s: Settings = DEFAULT) -> Column:
    """[FN38]"""
    return text.rlike(r"(?i)\b(" + "|".join(s.profanity) + r")\b")


def repeats_word(text: Column) -> Column:
    """Three equal words in a row, in a text of more than three. [FN39, WIN14]"""
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"), F.lit(0).alias("n"))

    def step(a: Column, w: Column) -> Column:
        run = F.when(w == a["last"], a["run"] + 1).otherwise(1)
        return F.struct(w.alias("last"), run.alias("run"), F.greatest(a["most"], run).alias("most"), (a["n"] + 1).alias("n"))

    return F.aggregate(words(F.lower(text)), start, step, lambda a: (a["most"] >= 3) & (a["n"] > 3))


def is_char_spam(text: Column) -> Column:
    """[FN40]"""
    return (F.size(F.array_distinct(F.split(F.replace(text, F.lit(" "), F.lit("")), ""))) < 4) & (F.length(text) > 20)


def scene_heading(*parts: Column) -> Column:
    """[FN34]"""
    return F.concat_ws(" ", *[F.upper(p) for p in parts])


def domain(tags: Column, topic: Column, source: Column, s: Settings = DEFAULT) -> Column:
    """[FN46]"""
    said = F.lower(F.concat_ws(",", F.concat_ws(",", tags), topic))
    return F.when(source.isin("tools", "contrastive"), source).when(any_of(said, s.film_words), "film").when(any_of(said, s.persona_words), "persona").when(source == "whatsapp", "conversation").otherwise("general")


def slug(text: Column, ascii_only: bool = False) -> Column:
    """[PAR12]"""
    mode = "" if ascii_only else "(?U)"
    out = F.regexp_replace(F.regexp_replace(F.trim(F.lower(text)), mode + r"[^\w\s-]", ""), mode + r"[\s_]+", "-")
    return F.coalesce(F.nullif(out, F.lit("")), F.lit("screenplay")) if ascii_only else out


def decision_question(domain_: Column, situation: Column, choice: Column) -> Column:
    """Question of a decision scenario; NULL without situation or choice. [FN42]"""
    (first, end_first), (second, end_second), (_, end) = fixed.DECISION_ENDS
    ask = F.when(domain_.isin(*first), end_first).when(domain_.isin(*second), end_second).otherwise(end)
    return F.when((F.length(situation) > 0) & (F.length(choice) > 0), F.concat(F.lit("Boss, "), F.lower(situation), ask))


def decision_answer(situation: Column, choice: Column, rationale: Column) -> Column:
    """Choice, and the rationale where there is one; NULL without situation or choice. [FN42]"""
    said = F.when(F.length(rationale) > 0, F.concat(choice, F.lit(". "), rationale)).otherwise(choice)
    return F.when((F.length(situation) > 0) & (F.length(choice) > 0), said)


def filled(form: str, fields: dict[str, Column]) -> Column:
    """The form with each {name} replaced by that field."""
    parts = re.split(r"\{(\w+)\}", form)
    return F.concat(*[fields[p] if k % 2 else F.lit(p) for k, p in enumerate(parts)])


def prompts(kind: str, **fields: Column) -> Column:
    """Array of (question, answer, domain, task) of a generator: 'scene', 'word', 'principle' or 'decision'. [FN44, JN20]

    Empty where the row lacks what the generator asks for: a text, a word with its definition, a situation.
    """
    asked = {"scene": ("text",), "word": ("word", "definition"), "principle": ("principle",), "decision": ("situation",)}[kind]
    own = {k: F.coalesce(v, F.lit("")) for k, v in fields.items()}
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    own |= {k: strip(own[k]) for k in ("text", "definition", "principle") if k in own}
    if kind == "principle":
        own["principle"] = strip(F.regexp_replace(own["principle"], r"^\s*\d+\.\s*", ""))
    if kind == "decision":
        own["domain"] = F.coalesce(fields["domain"], F.lit("general")) if "domain" in fields else F.lit("general")
        own["heuristics"] = F.coalesce(F.nullif(F.array_join(fields["heuristics"], ", "), F.lit("")), F.lit("...")) if "heuristics" in fields else F.lit("...")
    items = [F.struct(filled(q, own).alias("question"), filled(a, own).alias("answer"), filled(d, own).alias("domain"), F.lit(t).alias("task")) for q, a, d, t in fixed.PROMPTS[kind]]
    there = None
    for k in asked:
        there = F.length(own[k]) > 0 if there is None else there & (F.length(own[k]) > 0)
    return F.when(there, F.array(*items)).otherwise(F.array().cast("array<struct<question:string,answer:string,domain:string,task:string>>"))


def real_time_factor(processing: Column, duration: Column) -> Column:
    """[FN47]"""
    return F.when(duration > 0, processing / duration).otherwise(F.lit(0.0))


def seconds(samples: Column, rate: int) -> Column:
    """[FN48]"""
    return samples / F.lit(float(rate))


def date_folder(ts: Column) -> Column:
    """[FN49]"""
    return F.date_format(ts, "yyyy/MM/dd")


def session_key(*parts: Column) -> Column:
    """A session id that the parts determine. [FN54]"""
    return F.substring(F.sha2(F.concat_ws("_", *parts), 256), 1, 12)


def bullets(text: Column) -> Column:
    """Numbered lines as bullets, blank ones dropped. [PAR13]"""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*\d+\.", ""))), lambda x: x != "")
    return F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x)), "\n")


def newlines(text: Column) -> Column:
    """[SRC12]"""
    return F.regexp_replace(text, "\r\n?", "\n")


def cut_at_stop(text: Column, stops: list[str]) -> Column:
    """Cuts at the first listed stop that occurs. [LLM6]"""
    out = None
    for stop in stops:
        hit = F.instr(text, stop)
        cut = F.substring(text, F.lit(1), hit - 1)
        out = F.when(hit > 0, cut) if out is None else out.when(hit > 0, cut)
    return text if out is None else out.otherwise(text)
