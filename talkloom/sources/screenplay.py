"""Screenplays in Fountain, Markdown and extracted PDF text to scene elements.

A script is read line by line by a small state machine, in an Arrow-batched function over whole files.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "file string, scene_number int, heading string, location string, time_of_day string, order_index int, kind string, character string, text string, translation string"
TIMES = ("DAY", "NIGHT", "MORNING", "EVENING", "DAWN", "DUSK", "AFTERNOON", "LATER", "CONTINUOUS", "SUNSET", "SUNRISE")
HEADING = re.compile(r"^(INT\.?/EXT|EXT\.?/INT|INT|EXT|EST|I/E)[.\s]", re.I)
CUE = re.compile(r"^[^a-z]*[A-Z][^a-z]*$")
SCENE_NUMBER = re.compile(r"\s*#?\d+[A-Z]?#?\s*$")
TRANSLATION = re.compile(r"\(([a-z][^()]*)\)\s*$")
SPACED = re.compile(r"\b(?:[A-Z] ){2,}[A-Z]\b")


def heading_parts(line: str) -> tuple[str, str, str]:
    """(heading, location, time of day)."""
    text = SCENE_NUMBER.sub("", line.strip().lstrip(".")).strip().upper()
    body = HEADING.sub("", text).strip(" .-")
    place, _, when = body.rpartition("-")
    when = when.strip()
    if any(t in when for t in TIMES):
        return text, place.strip(" -"), when
    return text, body, ""


class Script:
    """Collects the rows of one file."""

    def __init__(self, file: str):
        self.file, self.scene, self.heading, self.order, self.rows = file, 0, ("", "", ""), 0, []

    def open(self, line: str) -> None:
        self.scene, self.order, self.heading = self.scene + 1, 0, heading_parts(line)
        self.add("heading", text=self.heading[0])

    def add(self, kind: str, character: str | None = None, text: str = "", translation: str | None = None) -> None:
        if self.scene:
            self.rows.append((self.file, self.scene, *self.heading, self.order, kind, character, text, translation))
            self.order += 1


def is_heading(line: str) -> bool:
    return bool(HEADING.match(line)) or line.startswith(".") and not line.startswith("..")


def spoken(text: str) -> tuple[str, str | None]:
    m = TRANSLATION.search(text)
    return (text[:m.start()].strip(), m[1]) if m else (text, None)


def fountain(file: str, text: str) -> list[tuple]:
    """[PAR9]"""
    out, lines, who, said = Script(file), text.replace("\r", "").split("\n"), None, []

    def close() -> None:
        nonlocal who, said
        if who and said:
            out.add("dialogue", who, *spoken(" ".join(said)))
        who, said = None, []

    for k, raw in enumerate(lines):
        line = raw.strip()
        after = lines[k + 1].strip() if k + 1 < len(lines) else ""
        if not line:
            close()
        elif is_heading(line):
            close()
            out.open(line)
        elif line.endswith("TO:") and line.isupper() or line.startswith(">"):
            close()
            out.add("transition", text=line.lstrip("> ").strip())
        elif who:
            if line.startswith("(") and line.endswith(")") and not said:
                out.add("parenthetical", who, line.strip("()"))
            else:
                said.append(line)
        elif CUE.match(line) and after and not after.startswith(">"):
            who = re.sub(r"\s*\(.*\)$", "", line.lstrip("@")).strip()
        else:
            out.add("action", text=line)
    close()
    return out.rows


def markdown(file: str, text: str) -> list[tuple]:
    """[PAR10]"""
    out, who = Script(file), None
    for raw in text.replace("\r", "").split("\n"):
        line = raw.strip()
        m = re.match(r"^\*\*([^*]+?):\*\*\s*(.*)$", line) or re.match(r"^\*\*([^*]+?)\*\*:\s*(.*)$", line)
        if line.startswith("#"):
            who = None
            title = line.lstrip("# ").strip()
            if is_heading(title) or title.upper().startswith("SCENE"):
                out.open(title)
        elif m:
            who = m[1].strip()
            if m[2]:
                out.add("dialogue", who, *spoken(m[2]))
        elif line.startswith(">"):
            out.add("voice_over", who, line.lstrip("> "))
        elif line.startswith(("- ", "* ")) and who:
            out.add("dialogue", who, *spoken(line[2:].strip()))
        elif line.startswith("_") and line.endswith("_") and len(line) > 1:
            out.add("action", text=line.strip("_"))
        elif line:
            who = None
            out.add("action", text=line)
    return out.rows


def pdf_text(file: str, text: str) -> list[tuple]:
    """Text drawn from a PDF: letters set apart are joined, page numbers left out. [PAR11]"""
    lines = []
    for raw in text.replace("\r", "").split("\n"):
        line = SPACED.sub(lambda m: m[0].replace(" ", ""), raw.strip())
        if not re.fullmatch(r"\d+\.?", line):
            lines.append(line)
    joined, speaking = [], False
    for line in lines:
        if len(line) >= 100 or line.startswith("_"):
            if speaking:
                joined.append("")
            joined.append(line.strip("_"))
            speaking = False
        else:
            joined.append(line)
            speaking = bool(line) and (speaking or bool(CUE.match(line)))
    return fountain(file, "\n".join(joined))


PARSERS = {"fountain": fountain, "markdown": markdown, "pdf": pdf_text}


def parse_scripts(files: DataFrame, kind: str, file: str = "file", text: str = "text") -> DataFrame:
    """Element rows of every script (file, text). [PAR9-11, SRC16]"""
    parser = PARSERS[kind]
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for f, t in zip(frame[file], frame[text]):
                yield pd.DataFrame(parser(f, t or ""), columns=names)

    return files.select(file, text).mapInPandas(run, SCHEMA)
