"""Five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``. All but the last return the
columns of documents. Rows without an id have no place in a corpus whose results
name documents; the first stage drops them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowsight.llm import hyperminhash, mixture, packing, perplexity, templates
from rowsight.llm.shared import shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep: no base failure, perplexity inside the language's band."""
    docs = docs.where(F.col("doc_id").isNotNull())
    text = F.xxhash64("text")
    verdicts = perplexity.judge(docs.withColumn("key", F.struct("doc_id", text.alias("body"))), "key")
    # a row that repeats an id is judged by its own text
    kept = verdicts.where("kept").select("key.doc_id", "key.body").distinct()
    return docs.withColumn("body", text).join(kept, ["doc_id", "body"], "left_semi").select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; those that had nothing else go."""
    cleaned = templates.drop_recurring(docs, **templates.WHOLE_JOB)
    return cleaned.where("n_dropped = 0 OR trim(text) <> ''").withColumn("n_chars", F.char_length("text").cast("bigint")).select(COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five words, 0.8)."""
    return hyperminhash.keep_one(docs).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that all sources have equal shares, in random order."""
    return mixture.replicate(docs).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens: a row for each piece of each document."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near_copies), ("source_mix", mix), ("packing", pack)]

#: perplexities, hashes of registers and token ids have no counterpart in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/corpus-{spark.sql('SELECT uuid() AS id').first()['id']}"
    for number, (name, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        if number == len(STAGES) - 1:
            return done
        done.write.parquet(f"{folder}/{number}-{name}")
        docs = spark.read.parquet(f"{folder}/{number}-{name}")
    return docs
