"""The queries of this subpackage, by name: thin contracts around the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm import oracles
from ferrule.llm.chat import digest, format_windows
from ferrule.llm.fingerprints import next_fingerprints
from ferrule.llm.html_text import extract
from ferrule.llm.near_dup import near_duplicates
from ferrule.llm.packing import pack
from ferrule.llm.piece_encoding import decode, encode
from ferrule.llm.quality import quality_scores
from ferrule.llm.sources import table, vocabulary
from ferrule.llm.suffix_dedup import remove_repeats
from ferrule.llm.token_counts import token_counts
from ferrule.llm.topk import exact_top_k, whole_vectors


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_bagminhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and digests of what they decode to."""
    model = vocabulary("piece_bpe_32k.model")
    texts = decode(encode(table(spark, sf_dir, "documents"), model), model)
    return texts.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_ids"),
        F.xxhash64("ids").alias("ids_xxhash64"),
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("text", 256).alias("text_sha256"),
    )


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op5_lz_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return next_fingerprints(table(spark, sf_dir, "documents"))


def op6_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one more, whose texts are control strings of other templates."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return digest(format_windows(turns.unionByName(odd)))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op10_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole_vectors(table(spark, sf_dir, "embeddings"))
    return exact_top_k(vectors, F.col("vec_id") % 50 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_bagminhash_near_dup, op3_sentencepiece, op4_suffix_dedup, op5_lz_fingerprints, op6_retrieval_packing, op7_chat_windows, op8_html_text, op9_token_counts, op10_threshold_top_k)}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_bagminhash_near_dup": oracles.OP2,
        "op4_suffix_dedup": oracles.OP4,
        "op7_chat_windows": oracles.OP7,
        "op8_html_text": oracles.OP8,
        "op10_threshold_top_k": oracles.OP10,
    }
