"""The named queries of this subpackage and the SQL that says the same, where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm import (ctw, decontaminate, exact_dedup, hard_negatives, html_text, licences, mixing, quality, simhash, token_files, toxicity,
                       transcripts, vector_codes)
from tamis.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op2_licences(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(table(spark, folder, "documents"))


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.report(table(spark, folder, "documents"))


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op6_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    return transcripts.recovered(table(spark, folder, "conversations"))


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return quality.judged(docs, keep_text=False).select("doc_id", *quality.MEASURES, "kept", F.round("host_rate", 6).alias("host_rate"))


def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.read_token_files(token_files.write_token_files(table(spark, folder, "documents"), tokenizer_path()))


def op9_html(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extracted(table(spark, folder, "pages"))


def op10_ctw(spark: SparkSession, folder: str) -> DataFrame:
    return ctw.scored(table(spark, folder, "documents"))


def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.compressed(table(spark, folder, "embeddings"))


def op12_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.marked(table(spark, folder, "documents")).drop("row")


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding", F.when(
        F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives.mined(vectors, F.col("vec_id") % 100 == 0)


QUERIES = {f.__name__: f for f in (op1_simhash, op2_licences, op3_decontamination, op4_mixing, op5_toxicity, op6_transcripts, op7_quality,
                                   op8_token_files, op9_html, op10_ctw, op11_vector_codes,
                                   op12_exact_dedup, op13_hard_negatives)}
ORACLES = {"op2_licences": licences.sql(), "op3_decontamination": decontaminate.SQL, "op7_quality": quality.SQL,
           "op11_vector_codes": vector_codes.sql(), "op12_exact_dedup": exact_dedup.SQL,
           "op13_hard_negatives": hard_negatives.SQL}
