"""One query for each operator of this package, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowsight.llm import (
    alignment, conversations, hyperminhash, importance, licences, mixture, neighbours, packing, perplexity, projections, rendering, separators, templates,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(vectors, vectors.where("vec_id % 50 = 0"))


def op2_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.judge(table(spark, sf_dir, "documents"))


#: documents as files: folders by source, language and range of ids; one that closes with a notice is its folder's licence file
FILE_PATH = """
concat_ws('/', coalesce(source, 'none'), coalesce(lang, 'none'), cast(floor(doc_id / 64) AS string),
          concat(CASE WHEN element_at(split(text, '\\n'), -1) RLIKE '(?i)licen[cs]e|rights reserved' THEN 'LICENSE-' ELSE 'file-' END, doc_id))
"""


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{FILE_PATH} AS path", "text")
    return licences.scan(files, keep=("doc_id",))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separators.counted(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.drop_recurring(table(spark, sf_dir, "documents"), **templates.WHOLE_JOB).select("doc_id", "n_lines", "n_dropped", "text")


def op6_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.replicate(table(spark, sf_dir, "documents"))


def op7_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=4, percent=80)


def op8_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    chats = conversations.formatted(conversations.threads(turns.unionByName(more), "conv_id", "turn", "role", "text"))
    back = conversations.read_back(F.col("formatted"))
    loss = conversations.learnt(F.col("formatted"), F.col("loss_spans"))
    return chats.select(F.col("tree").alias("conv_id"), "formatted", back.alias("turns"), loss.alias("loss")).select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op9_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendering.rendered(table(spark, sf_dir, "pages"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=("doc_id",))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_projection_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projections.near_vectors(table(spark, sf_dir, "embeddings"))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}
