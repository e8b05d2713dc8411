"""Command line: python -m talkloom.cli inventory|examples|curate|add|search ... (JSON lines in and out)."""

from __future__ import annotations

import argparse
import json

from .memory import SCHEMAS, MemoryStore
from .plans import curation
from .session import session
from .sources import io, parse


def files(spark, path: str):
    from pyspark.sql import functions as F

    raw = spark.read.option("wholetext", True).text(path, recursiveFileLookup=True, pathGlobFilter="*.txt").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return raw.withColumn("chat", parse.chat_name(F.col("path")))


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="talkloom")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("inventory", "examples"):
        p = sub.add_parser(name)
        p.add_argument("source")
        p.add_argument("target")
    p.add_argument("--owner", action="append", default=[])
    p.add_argument("--val-ratio", type=float, default=0.1)
    p = sub.add_parser("curate")
    p.add_argument("source")
    p.add_argument("target")
    p.add_argument("--size", type=int, default=350)
    for name in ("add", "search"):
        p = sub.add_parser(name)
        p.add_argument("folder")
        p.add_argument("table", choices=[k for k in SCHEMAS if k != "stm"])
        p.add_argument("text", help="a row as JSON" if name == "add" else "the query")
    p.add_argument("--top-k", type=int, default=5)
    a = top.parse_args(argv)
    spark = session()
    if a.command == "inventory":
        io.write_jsonl(io.inventory(files(spark, a.source)), a.target)
    elif a.command == "examples":
        io.write_jsonl(curation.chat_examples(files(spark, a.source).select("chat", "text"), a.owner, val_ratio=a.val_ratio), a.target)
    elif a.command == "curate":
        io.write_jsonl(curation.curate(spark.read.json(a.source), a.size), a.target)
    elif a.command == "add":
        MemoryStore(spark, a.folder).add(a.table, **json.loads(a.text))
    else:
        for r in MemoryStore(spark, a.folder).search(a.table, a.text, top_k=a.top_k).toJSON().collect():
            print(r)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
