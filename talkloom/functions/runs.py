"""Text functions that walk characters, over Arrow batches: language runs, transliteration, similarity."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd

LOW, HIGH = "ఀ", "౿"


def split_runs(text: str, low: str = LOW, high: str = HIGH, lang: str = "te", other: str = "en") -> list[tuple[str, str]]:
    """(segment, language): letters of neither script never end a run, other characters stay with theirs. [FN10]"""
    out, run, now = [], [], None
    for ch in text or "":
        if ch.isalpha():
            own = lang if low <= ch <= high else other if ch.isascii() else "other"
            if now is None:
                now = own
            elif own not in (now, "other"):
                out.append(("".join(run).strip(), now))
                run, now = [], own
        run.append(ch)
    out.append(("".join(run).strip(), now))
    return [(s, k) for s, k in out if s and k]


def language_runs(texts: pd.Series) -> pd.Series:
    return pd.Series([[{"segment": s, "lang": k} for s, k in split_runs(t)] for t in texts])


#: Romanisation by the characters' Unicode names: TELUGU LETTER KA is "k" with an inherent vowel, VOWEL SIGN AA is "A".
VOWELS = {"A": "a", "AA": "A", "I": "i", "II": "I", "U": "u", "UU": "U", "E": "e", "EE": "E", "AI": "ai", "O": "o", "OO": "O", "AU": "au", "VOCALIC R": "RRi", "VOCALIC RR": "RRI", "VOCALIC L": "LLi", "VOCALIC LL": "LLI"}
CONSONANTS = {"KA": "k", "KHA": "kh", "GA": "g", "GHA": "gh", "NGA": "~N", "CA": "ch", "CHA": "Ch", "JA": "j", "JHA": "jh", "NYA": "~n", "TTA": "T", "TTHA": "Th", "DDA": "D", "DDHA": "Dh", "NNA": "N", "TA": "t", "THA": "th", "DA": "d", "DHA": "dh", "NA": "n", "PA": "p", "PHA": "ph", "BA": "b", "BHA": "bh", "MA": "m", "YA": "y", "RA": "r", "RRA": "R", "LA": "l", "LLA": "L", "VA": "v", "SHA": "sh", "SSA": "Sh", "SA": "s", "HA": "h"}
SIGNS = {"CANDRABINDU": ".N", "ANUSVARA": "M", "VISARGA": "H"}


def romanize(text: str) -> str:
    """Characters of the script by name; all others stay. [FN12]"""
    out, pending = [], False
    for ch in text or "":
        name = unicodedata.name(ch, "") if LOW <= ch <= HIGH else ""
        kind, _, what = name.removeprefix("TELUGU ").rpartition("VOWEL SIGN ") if "VOWEL SIGN " in name else (name.removeprefix("TELUGU "), "", "")
        if "VOWEL SIGN " in name and what in VOWELS:
            out.append(VOWELS[what])
            pending = False
            continue
        if kind == "SIGN VIRAMA":
            pending = False
            continue
        if pending:
            out.append("a")
            pending = False
        letter = kind.removeprefix("LETTER ")
        if letter in CONSONANTS and kind.startswith("LETTER "):
            out.append(CONSONANTS[letter])
            pending = True
        elif letter in VOWELS and kind.startswith("LETTER "):
            out.append(VOWELS[letter])
        elif kind.startswith("SIGN ") and kind[5:] in SIGNS:
            out.append(SIGNS[kind[5:]])
        elif kind.startswith("DIGIT "):
            out.append(str(unicodedata.digit(ch)))
        else:
            out.append(ch)
    if pending:
        out.append("a")
    return "".join(out)


def transliterated(texts: pd.Series) -> pd.Series:
    return texts.map(romanize)


def ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])
