"""The registered queries of the operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timelinekit.llm import (
    decontamination, language, mixing, nearest, negatives, pii, quality, resampling, simhash, sql, token_counts, token_output, toxicity, warc,
)
from timelinekit.llm.common import table

END_ID = 2


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf, "pages"), min_revisit_bytes=0)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


def op2_mixing(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return mixing.mix_to_weights(docs, block_docs=16).select("doc_id", "source", "block", "round", "slot", "nth")


def op3_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = decontamination.matches(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "item_id", "covered", "coverage", "slots", "consistency")


def op4_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    scores = token_counts.piece_scores(tokenizer_path("piece_bpe_32k.model"))
    return token_counts.token_counts(table(spark, sf, "documents"), scores)


def op5_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return nearest.nearest(table(spark, sf, "embeddings"), every=20, k=20)


def op6_language(spark: SparkSession, sf: str) -> DataFrame:
    return language.identify(table(spark, sf, "documents"))


def op7_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents"), distance=4, shingle=4, seed=42)


def op8_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    return pii.personal_data(table(spark, sf, "documents"))


def op9_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op10_token_output(spark: SparkSession, sf: str) -> DataFrame:
    folder = token_output.encode(table(spark, sf, "documents"), tokenizer_path("word_bpe_49k.json"), END_ID)
    return token_output.decode(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


def op11_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op12_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, sf, "embeddings"))


def op13_resampling(spark: SparkSession, sf: str) -> DataFrame:
    return resampling.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_mixing": op2_mixing,
    "op3_decontamination": op3_decontamination,
    "op4_token_counts": op4_token_counts,
    "op5_nearest": op5_nearest,
    "op6_language": op6_language,
    "op7_simhash": op7_simhash,
    "op8_personal_data": op8_personal_data,
    "op9_toxicity": op9_toxicity,
    "op10_token_output": op10_token_output,
    "op11_quality": op11_quality,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_resampling": op13_resampling,
}
SQL: dict[str, str] = {
    "op11_quality": sql.quality(quality.BUCKETS, quality.PAIR_FACTOR, quality.LOST),
    "op12_hard_negatives": sql.NEGATIVES,
    "op13_resampling": sql.resampling(),
}
