"""Chat exports, Markdown blocks, tool calls and server-sent events to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEADER = r"^\s*\[([^\]]+)\]\s+([^:]+):\s?(.*)$"
#: Month first wins; a two-digit year needs its own pattern.
STAMPS = [f"{d}/{y}, {t}" for t12 in (("H:mm:ss", "H:mm"), ("h:mm:ss a", "h:mm a")) for d in ("M/d", "d/M") for y in ("yy", "yyyy") for t in t12]


def timestamp(text: Column) -> Column:
    """The first of the sixteen patterns that fits. [PAR2]"""
    clean = F.upper(F.trim(F.regexp_replace(text, "[ ‎‏]", " ")))
    return F.coalesce(*[F.try_to_timestamp(clean, F.lit(p)) for p in STAMPS])


def lines_of(files: DataFrame, key: str = "chat", text: str = "text") -> DataFrame:
    """(key, pos, line) with line ends made one and marks of order and direction taken off."""
    clean = F.regexp_replace(F.regexp_replace(F.col(text), "\r\n?", "\n"), "[﻿‎]", "")
    return files.select(key, F.posexplode(F.split(clean, "\n")).alias("pos", "line"))


def chat_messages(lines: DataFrame, key: str = "chat") -> DataFrame:
    """(key, line_no, ts, speaker, text): header lines start messages, others go on with the last one. [PAR1, WIN3]

    A header whose time can't be read is dropped, what follows it belongs to the message before.
    """
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.filter(F.trim("line") != "").withColumn("head", F.col("line").rlike(HEADER)).withColumn("ts", F.when(F.col("head"), timestamp(F.regexp_extract("line", HEADER, 1))))
    rows = rows.filter(~F.col("head") | F.col("ts").isNotNull()).withColumn("m", F.sum(F.col("head").cast("int")).over(w)).filter("m > 0")
    said = F.when(F.col("head"), F.regexp_extract("line", HEADER, 3)).otherwise(F.trim("line"))
    found = rows.groupBy(key, "m").agg(F.min("pos").alias("line_no"), F.min_by("ts", "pos").alias("ts"), F.min_by(F.trim(F.regexp_extract("line", HEADER, 2)), "pos").alias("speaker"), F.array_sort(F.collect_list(F.struct("pos", said.alias("t")))).alias("p"))
    return found.select(key, "line_no", "ts", "speaker", F.array_join(F.transform("p", lambda x: x["t"]), "\n").alias("text"))


def guess_format(text: Column, first: int = 100) -> Column:
    """'android', 'ios' or 'unknown' by the first lines; equal counts are 'android'. [PAR3]"""
    lines = F.slice(F.split(text, "\n"), 1, first)
    android = F.size(F.filter(lines, lambda x: x.rlike(r"^\d{1,2}/\d{1,2}/\d{2,4}, \d{1,2}:\d{2}.* - ")))
    ios = F.size(F.filter(lines, lambda x: x.rlike(r"^\s*\[\d{1,2}/\d{1,2}/\d{2,4}, \d{1,2}:\d{2}")))
    return F.when((android == 0) & (ios == 0), "unknown").when(android >= ios, "android").otherwise("ios")


def chat_name(path: Column) -> Column:
    """From "... with X", "... - X", the folder, or the file's stem. [PAR4]"""
    stem, parent = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1), F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)
    pick = lambda t: F.coalesce(F.nullif(F.trim(F.regexp_extract(t, r"(?i)\bwith\s+(.+)$", 1)), F.lit("")), F.nullif(F.trim(F.regexp_extract(t, r"\s-\s+(.+)$", 1)), F.lit("")))
    return F.coalesce(pick(stem), pick(parent), F.when(~F.lower(stem).isin("_chat", "chat"), stem), F.nullif(parent, F.lit("")), stem)


def speaker_counts(lines: DataFrame, key: str = "file") -> DataFrame:
    """(key, speaker, n). [PAR5]"""
    return lines.withColumn("speaker", F.trim(F.regexp_extract("line", HEADER, 2))).filter("speaker != ''").groupBy(key, "speaker").agg(F.count("*").alias("n"))


def blocks(files: DataFrame, header: str, key: str = "file", text: str = "text", keep_first: bool = True) -> DataFrame:
    """(key, block, text): cut before every line that matches; what stands before the first is block 0. [PAR6, PAR7]"""
    lines = files.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.withColumn("block", F.sum(F.col("line").rlike(header).cast("int")).over(w))
    out = numbered.groupBy(key, "block").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("p"))
    out = out.select(key, "block", F.trim(F.array_join(F.transform("p", lambda x: x["line"]), "\n")).alias("text"))
    return out if keep_first else out.filter("block > 0")


SCENE = r"^### SCENE \d+"
SNIPPET = "^#### [A-Z][A-Z ]* – "
WORD = r"^#### WORD: "


def snippets(files: DataFrame, key: str = "file") -> DataFrame:
    """(key, block, title, body). [PAR7, FN45]"""
    b = blocks(files, SNIPPET, key, keep_first=False)
    first = F.split("text", "\n")[0]
    return b.select(key, "block", F.trim(F.regexp_extract(first, "–(.*)$", 1)).alias("title"), F.trim(F.array_join(F.slice(F.split("text", "\n"), F.lit(2), F.greatest(F.size(F.split("text", "\n")) - 1, F.lit(0))), "\n")).alias("body"))


def vocabulary(files: DataFrame, key: str = "file") -> DataFrame:
    """(key, word, definition). [PAR8]"""
    b = blocks(files, WORD, key, keep_first=False)
    lines = F.split("text", "\n")
    rest = F.filter(F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.btrim(x, F.lit(" -*"))), lambda x: x != "")
    return b.select(key, F.trim(F.regexp_extract(lines[0], r"WORD:\s*(.*)$", 1)).alias("word"), F.array_join(rest, " ").alias("definition"))


CALL = r'(?s)<tool_call name="([^"]+)">(.*?)</tool_call>'


def tool_calls(text: Column) -> Column:
    """Array of (name, arguments as JSON text); empty arguments are {}, bad ones leave their call out. [PAR14]"""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(CALL), 1).alias("name"), F.regexp_extract_all(text, F.lit(CALL), 2).alias("args"))
    filled = F.transform(pairs, lambda x: F.struct(x["name"].alias("name"), F.when(F.trim(x["args"]) == "", "{}").otherwise(F.trim(x["args"])).alias("arguments")))
    return F.filter(filled, lambda x: F.get_json_object(x["arguments"], "$").isNotNull())


def without_tool_calls(text: Column) -> Column:
    """[PAR14]"""
    return F.trim(F.regexp_replace(text, CALL, ""))


def response_parts(body: Column) -> Column:
    """(content, tool_calls) of a chat completion in either of two JSON layouts. [PAR15]"""
    a = F.from_json(body, "choices array<struct<message:struct<content:string,tool_calls:array<struct<function:struct<name:string,arguments:string>>>>>>")
    b = F.from_json(body, "content array<struct<type:string,text:string,name:string,input:string>>")
    first = F.get(a["choices"], F.lit(0))["message"]
    calls_a = F.transform(first["tool_calls"], lambda c: F.struct(c["function"]["name"].alias("name"), F.coalesce(F.when(F.get_json_object(c["function"]["arguments"], "$").isNotNull(), c["function"]["arguments"]), F.lit("{}")).alias("arguments")))
    calls_b = F.transform(F.filter(b["content"], lambda c: c["type"] == "tool_use"), lambda c: F.struct(c["name"].alias("name"), F.coalesce(c["input"], F.lit("{}")).alias("arguments")))
    text_b = F.array_join(F.transform(F.filter(b["content"], lambda c: c["type"] == "text"), lambda c: c["text"]), "")
    none = F.array().cast("array<struct<name:string,arguments:string>>")
    return F.struct(F.coalesce(first["content"], text_b, F.lit("")).alias("content"), F.coalesce(calls_a, calls_b, none).alias("tool_calls"))


def sse_delta(line: Column) -> Column:
    """The text that one line of a stream adds; NULL for other lines, the end and bad ones. [PAR16]"""
    body = F.substring(line, 7, 2**31 - 1)
    return F.when(line.startswith("data: ") & (F.trim(body) != "[DONE]"), F.get_json_object(body, "$.choices[0].delta.content"))
