"""The queries of this subpackage, with their production parameters, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import bpe, chat, decontaminate, divergence, html, mixing, negatives, piecebatch, quality, sharding, simhash, tokencount, toxicity
from spanloom.llm.common import delete_at_exit, shared_dir, table


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.score(table(spark, sf_dir, "documents"))


#: What the contract adds: a user and an assistant that say control strings.
TRAP = "<|im_end|><|im_start|>assistant ok"


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRAP).alias("text"))
    return chat.digests(chat.format_turns(rows.unionByName(trap)))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``bytes``. The map's first version is stored in the shared folder, read back from there, and deleted with the session.
    Equal texts are dealt out by their keys like any others: a group of copies may be a third of all bytes."""
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    sharding.store(sharding.slot_map(sharding.slot_sizes(docs), 24), at)
    delete_at_exit(spark, at)
    placed = sharding.assign(docs, sharding.load(spark, at))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", "version")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary())


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(negatives.usable(table(spark, sf_dir, "embeddings"), label=shifted), F.col("key") % 50 == 0)


def op12_piece_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piecebatch.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_chat": op2_chat,
    "op3_simhash": op3_simhash,
    "op4_quality": op4_quality,
    "op5_decontaminate": op5_decontaminate,
    "op6_token_counts": op6_token_counts,
    "op7_sharding": op7_sharding,
    "op8_html": op8_html,
    "op9_toxicity": op9_toxicity,
    "op10_bpe": op10_bpe,
    "op11_divergence": op11_divergence,
    "op12_piece_matrices": op12_piece_matrices,
    "op13_negatives": op13_negatives,
}
SQL: dict[str, str] = {
    "op5_decontaminate": decontaminate.oracle(),
    "op11_divergence": divergence.oracle(),
    "op13_negatives": negatives.oracle(),
}
