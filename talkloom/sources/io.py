"""Readers and writers of JSON lines, documents, archives and chat exports."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import newlines


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType | str, mode: str = "drop") -> DataFrame:
    """JSON lines: bad ones dropped, refused ('strict') or kept in _corrupt_record ('count'). [SRC1-3, SRC5]"""
    reader = spark.read.schema(schema)
    if mode == "count":
        schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        return spark.read.schema(T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return reader.option("mode", {"drop": "DROPMALFORMED", "strict": "FAILFAST"}[mode]).json(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, asked of the file system that holds it."""
    fs, p = _file_system(spark, path)
    return bool(fs.globStatus(p))


def _file_system(spark: SparkSession, path: str) -> tuple:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder if it is there."""
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def move(spark: SparkSession, old: str, new: str) -> None:
    """Renames a file or folder; one that has the new name already goes."""
    remove(spark, new)
    fs, p = _file_system(spark, old)
    if not fs.rename(p, _file_system(spark, new)[1]):
        raise OSError(f"could not rename {old}")


def read_jsonl_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """[SRC4]"""
    return read_jsonl(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def read_many(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """Rows of all matching files with their file's stem. [SRC6]"""
    return read_jsonl(spark, glob, schema).select("*", file_stem(F.col("_metadata.file_path")).alias("file_stem"))


def read_documents(spark: SparkSession, dirs: list[str], schema: str) -> DataFrame:
    """One JSON document a file; dirs in order of priority. [SRC7]"""
    out = None
    for rank, d in enumerate(dirs):
        part = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(d).select("*", F.col("_metadata.file_path").alias("file"), F.lit(rank).alias("dir_rank"))
        out = part if out is None else out.unionByName(part)
    return out


def get_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """[SRC9]"""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def put_document(df: DataFrame, path: str) -> None:
    """[SRC9]"""
    df.withColumn("updated_at", utc_now()).coalesce(1).write.mode("overwrite").json(path)


def utc_now() -> Column:
    """[FN50]"""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines that keep null keys. [SNK1, SNK2]"""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def insert_row(spark: SparkSession, path: str, values: dict, schema: str, defaults: dict) -> None:
    """Appends one record with a new id and equal times of creation and change. [SNK3-5]"""
    row = spark.createDataFrame([{**defaults, **values}], schema).withColumn("id", F.replace(F.uuid(), F.lit("-"), F.lit(""))).withColumn("created_at", utc_now()).withColumn("updated_at", F.col("created_at"))
    write_jsonl(row, path, append=True)


def decode_bytes(data: bytes) -> tuple[str, str]:
    """(text, charset): UTF-8, else Windows-1252, else Latin-1. [SRC11]"""
    for name in ("utf-8", "cp1252", "latin-1"):
        try:
            return data.decode(name), name
        except UnicodeDecodeError:
            pass
    raise AssertionError("Latin-1 decodes everything")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, text, charset) of the .txt members of ZIP files, archives inside them too. [SRC10-12]"""

    def members(name: str, data: bytes) -> Iterator[tuple[str, bytes]]:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for m in sorted(z.namelist()):
                if m.lower().endswith(".txt"):
                    yield m, z.read(m)
                elif m.lower().endswith(".zip"):
                    for inner, text in members(m, z.read(m)):
                        yield f"{m}/{inner}", text

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, content in zip(frame["path"], frame["content"]):
                try:
                    rows = [(file, m, *decode_bytes(t)) for m, t in members(file, content)]
                except zipfile.BadZipFile:
                    rows = []
                yield pd.DataFrame(rows, columns=["archive", "member", "text", "charset"])

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    return raw.mapInPandas(run, "archive string, member string, text string, charset string").withColumn("text", newlines(F.col("text")))


def inventory(files: DataFrame) -> DataFrame:
    """(file_path, chat_name, line_count, guessed_format) of files (path, text). [SRC13, PAR3, PAR4]"""
    from .parse import chat_name, guess_format

    return files.select(F.col("path").alias("file_path"), chat_name(F.col("path")).alias("chat_name"), F.size(F.split("text", "\n")).alias("line_count"), guess_format(F.col("text")).alias("guessed_format"))


def inventory_chats(spark: SparkSession, path: str) -> DataFrame:
    """(chat, path) of an inventory document. [SRC14]"""
    doc = spark.read.schema("files array<struct<file_path:string,chat_name:string>>").option("multiLine", True).json(path)
    return doc.select(F.explode("files").alias("f")).select(F.coalesce("f.chat_name", file_stem(F.col("f.file_path"))).alias("chat"), F.col("f.file_path").alias("path"))


def jdbc_options(env: dict[str, str]) -> dict[str, str]:
    """Options for spark.read.jdbc from the environment. [SRC15]"""
    url = f"jdbc:postgresql://{env.get('DB_HOST', 'localhost')}:{env.get('DB_PORT', '5432')}/{env.get('DB_NAME', 'talkloom')}"
    return {"url": url, "user": env.get("DB_USER", ""), "password": env.get("DB_PASSWORD", ""), "driver": "org.postgresql.Driver"}


def stored_bytes(spark: SparkSession, path: str) -> DataFrame:
    """Files, bytes and MB under a folder. [AG20]"""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.round(F.coalesce(F.sum("length"), F.lit(0)) / (1024 * 1024), 2).alias("mb"))


def expired(files: DataFrame, cutoff: Column) -> DataFrame:
    """Files last changed before the cutoff. [SNK17]"""
    return files.filter(F.col("modificationTime") < cutoff)


def delete_expired(spark: SparkSession, path: str, days: int) -> int:
    """Deletes the files below a folder that are older than that; how many. The names alone reach the driver, in turn. [SNK17]"""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "modificationTime")
    n = 0
    for r in expired(files, F.current_timestamp() - F.expr(f"interval {int(days)} days")).toLocalIterator():
        remove(spark, r.path)
        n += 1
    return n


def table_columns(spark: SparkSession) -> DataFrame:
    """(table, column, type) of the session's views and tables."""
    rows = [(t.name, c.name, c.dataType) for t in spark.catalog.listTables() for c in spark.catalog.listColumns(t.name)]
    return spark.createDataFrame(rows, "table string, column string, type string")


def write_report(df: DataFrame, path: str) -> None:
    """A small table of measures as one JSON file beside the data. [SNK19]"""
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def create_table(spark: SparkSession, name: str, schema: str, seed: dict | None = None) -> None:
    """Creates a table if it is absent, and gives it its first row. [SNK21]"""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet")
    if seed and not spark.table(name).limit(1).count():
        spark.createDataFrame([seed], schema).write.insertInto(name)


def drop_table(spark: SparkSession, name: str) -> None:
    """[SNK21]"""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
