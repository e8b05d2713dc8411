"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

1. language ID: documents without a letter, or whose bytes no learned language predicts, go;
2. quality classifier: documents that are good with a probability below a half go;
3. SimHash near-dedup: candidates by fingerprint, links by a Jaccard similarity of 0.8 or more of five-word shingle sets; one of each group stays;
4. mixing sources to target weights: sources are repeated or thinned to their budgets, in blocks;
5. byte-level BPE: ids of every document, decoded again as a check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.llm import bpe, lang_id, mixing, quality, similar
from talkloom.llm.common import delete_folders, named_folders, written
from talkloom.llm.queries import ENTROPY_SHARE, GRADES, MAX_REPEATS, SELECT_AT, estimated_tokens, held_out, pattern, ratings, tokenizer

#: Above this many bits a byte a text is as good as noise to every learned language.
MOST_BITS = 6.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    trees = lang_id.train(docs.filter(~held_out()))
    found = lang_id.predict(docs, trees)
    return found.filter((F.col("lang_pred") != "und") & (F.col("bits_per_byte") <= MOST_BITS)).select(docs.columns)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = ratings(spark.read.parquet(f"{sf_dir}/labels.parquet")).filter(~held_out())
    model = quality.train(docs, labels, GRADES)
    return quality.predict(docs, model).filter(F.col("tails")[GRADES - 2] >= SELECT_AT).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, estimated_tokens(), max_repeats=MAX_REPEATS, target_entropy_share=ENTROPY_SHARE).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    back = bpe.encode_and_decode(docs, tokenizer("byte_bpe_50k.tiktoken"), pattern(), keep=["doc_id", "text", "lang", "source"])
    return back.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip"))


STAGES = [("language ID", language), ("quality", good), ("near-dedup", near_dedup), ("mixing", mix), ("bpe", encode)]

#: The stages run models and Arrow functions, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``. What a stage wrote goes once the next one's output stands."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), len(named_folders())
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        delete_folders(spark, named_folders()[before:-1])
    return docs
