"""The memory store: JSON-lines tables in a folder, one sub-folder a table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import retrieval, tables
from .sources import io

STAMPS = "id string, created_at string, updated_at string"
SCHEMAS = {
    "ltm": "text string, lang string, tags array<string>, trust int, embedding array<double>, source string",
    "snippets": "title string, body string, lang string, tags array<string>, version int, embedding array<double>, domain string",
    "interactions": "session_id string, user_msg string, model_reply string, used_ltm_ids array<string>, used_snippet_ids array<string>, stm_summary string, lang string",
    "stm": "session_id string, rolling_summary string, target_lang string, updated_at string",
}
DEFAULTS = {"ltm": {"lang": "te", "trust": 3, "tags": []}, "snippets": {"lang": "te", "version": 1, "domain": "general", "tags": []}, "interactions": {"used_ltm_ids": [], "used_snippet_ids": []}}


@dataclass
class MemoryStore:
    spark: SparkSession
    folder: str

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def table(self, name: str) -> DataFrame:
        schema = SCHEMAS[name] if name == "stm" else f"{STAMPS}, {SCHEMAS[name]}"
        return io.read_jsonl_or_empty(self.spark, self.path(name), schema)

    def add(self, name: str, **values) -> None:
        """A row of ltm, snippets or interactions. [SNK3-5]"""
        row = {c.split()[0]: None for c in SCHEMAS[name].split(", ")} | DEFAULTS[name] | values
        io.insert_row(self.spark, self.path(name), row, SCHEMAS[name], {})

    def upsert_stm(self, session_id: str, rolling_summary: str, target_lang: str) -> None:
        """[SNK6] Written beside the old table, which it then replaces by two renames; what a crash between them leaves is put right first."""
        path, new, old = (self.path(x) for x in ("stm", "stm.new", "stm.old"))
        if not io.exists(self.spark, path) and io.exists(self.spark, old):
            io.move(self.spark, old, path)
        row = self.spark.createDataFrame([(session_id, rolling_summary, target_lang)], "session_id string, rolling_summary string, target_lang string").withColumn("updated_at", io.utc_now())
        io.write_jsonl(tables.upsert(self.table("stm"), row, "session_id"), new)
        if io.exists(self.spark, path):
            io.move(self.spark, path, old)
        io.move(self.spark, new, path)
        io.remove(self.spark, old)

    def search(self, name: str, query: str | None = None, vector: list[float] | None = None, tags: list[str] | None = None, top_k: int = 5) -> DataFrame:
        """[RET1, RET2]"""
        rows = self.table(name)
        if vector is not None:
            from .operators.quality import has_tags

            rows = rows.filter(has_tags(F.col("tags"), tags)) if tags else rows
            return retrieval.search_vector(rows, vector, "embedding", "created_at", top_k)
        text: Column = F.col("text") if name == "ltm" else F.concat_ws(" ", "title", "body")
        return retrieval.search_text(rows, query or "", text, "created_at", top_k, F.col("tags"), tags)
