"""Literals of the engine, as one frozen record: every operator takes its words, ranges and thresholds from here."""

from __future__ import annotations

from dataclasses import dataclass, field

from . import fixed


@dataclass(frozen=True)
class Settings:
    """Fixed values the operators' results depend on; ``script_range`` is the Unicode block of the second language."""

    script_range: str = r"[\x{0C00}-\x{0C7F}]"
    script_lang: str = "te"
    mixed_lang: str = "mixed"
    switched_lang: str = "te-en"
    other_lang: str = "en"
    prefix: str = "Boss, "
    reply_window_minutes: int = 30
    seed: str = "42"
    script_keywords: tuple[str, ...] = ("script", "screenplay", "scene", "beat", "logline", "character", "arc", "plot", "story", "treatment", "short film", "pilot", "genre", "dialogue", "dialog", "climax", "act", "montage", "villain", "protagonist", "antagonist")
    omitted: tuple[str, ...] = ("audio omitted", "image omitted", "video omitted", "sticker omitted")
    placeholders: tuple[str, ...] = ("Boss, {PHONE}", "Boss, {NAME_A}", "{PHONE}", "{NAME_A}")
    generic: tuple[str, ...] = ("Boss, Hi", "Boss, Ok", "Boss, Ha", "Boss, Hmm", "Boss, Yes", "Boss, No")
    low_value: tuple[str, ...] = ("ha", "ok", "hmm", "yes", "no", "yep", "nope", "haha", "ya", "ha.", "ok.", "hmm.", "exactly", "correct", "right", "true", "అవును", "హా", "హా.", "లేదు", "ఓకే", "సరే")
    low_value_prefixed: tuple[str, ...] = ("boss, ha", "boss, ok", "boss, hmm", "boss, yes", "boss, no", "boss, yep", "boss, nope", "boss, haha", "boss, ya", "boss, okay", "boss, ha.", "boss, ok.", "boss, hmm.", "boss, exactly", "boss, correct", "boss, అవును", "boss, హా", "boss, హా.", "boss, లేదు", "boss, ఓకే", "boss, సరే", "boss, emo", "boss, lite le", "boss, good", "boss, nice", "boss, wow", "boss, oh", "boss, oho", "boss, cool", "boss, boring", "boss, hi")
    filter_patterns: tuple[str, ...] = ("{PHONE}", "{EMAIL}", "omitted", "deleted", "This message was deleted")
    emoji: tuple[str, ...] = ("😂", "🥲", "😅", "🤣", "😊")
    romanized_markers: tuple[str, ...] = ("nenu", "naku", "Boss", "chestha", "kavali", "antey", "undhi", "cheppu", "enti", "kosam", "aythe", "inka", "ledu", "avutundi")
    meta_patterns: tuple[str, ...] = ("voice call", "deleted this message", "audio omitted", "image omitted")
    memory_terms: tuple[str, ...] = ("always", "never", "prefer", "keep", "remember", "rule", "guardrail", "checklist", "workflow", "process", "format", "template", "steps", "points", "reminder", "script", "scene", "character", "arc", "outline", "treatment", "logline", "pitch", "story", "film", "movie", "pilot")
    list_markers: tuple[str, ...] = ("-", "•", "1.", "1)", "->")
    film_words: tuple[str, ...] = ("film", "screenplay", "scene", "dialogue", "story", "character", "production", "movie", "cinema")
    persona_words: tuple[str, ...] = ("persona", "belief", "value", "emotion", "relationship", "dream", "fear", "tech", "decision")
    profanity: tuple[str, ...] = fixed.PROFANITY
    script_name: str = "telugu"
    script_greeting: str = "బాస్"
    knobs: tuple[str, ...] = fixed.KNOBS
    phone: str = r"\+?\d[\d\s\-()]{5,}\d"
    email: str = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
    email_lax: str = r"\b[^\s@]+@[^\s@]+\b"
    switch_words: dict[str, str] = field(default_factory=lambda: {"kitchen": "kitchen", "cook": "kitchen", "cooking": "kitchen", "writers": "writers_room", "writing": "writers_room", "script": "writers_room", "storyboard": "storyboard", "visual": "storyboard", "general": "general"})
    switch_patterns: tuple[str, ...] = (r"switch to (\w+)", r"go to (\w+)", r"let'?s go to (\w+)", r"(\w+) mode", r"in the (\w+)")
    locations: tuple[tuple[str, str], ...] = (("kitchen", "kitchen"), ("cook", "kitchen"), ("writers", "writers_room"), ("writing", "writers_room"), ("office", "writers_room"), ("storyboard", "storyboard"), ("visual", "storyboard"), ("studio", "storyboard"))
    context_keywords: tuple[tuple[str, tuple[str, ...]], ...] = fixed.CONTEXT_WORDS


DEFAULT = Settings()


def load_settings(path: str, env: dict[str, str] | None = None, prefix: str = "TALKLOOM_") -> Settings:
    """Settings from a YAML (where a YAML reader is installed) or JSON file; environment values win. [SRC17]"""
    import json
    from dataclasses import fields

    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml

        given = yaml.safe_load(text) or {}
    except ImportError:
        given = json.loads(text)
    for x in fields(Settings):
        if (v := (env or {}).get(prefix + x.name.upper())) is not None:
            given[x.name] = v
    kinds = {x.name: type(getattr(DEFAULT, x.name)) for x in fields(Settings)}
    unknown = set(given) - set(kinds)
    if unknown:
        raise ValueError(f"unknown setting {sorted(unknown)[0]}")
    return Settings(**{k: kinds[k](v) for k, v in given.items()})


#: The tables of the query catalogue hold accented Latin text: the second script there is U+00C0 to U+017F.
LATIN = Settings(script_range=r"[\x{00C0}-\x{017F}]")
