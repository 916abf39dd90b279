"""Queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from metaloom.llm import bpe, egojoin, langid, partenum, pfair, quality, sadedup, tokencount, tokenout, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenout.encode_frames(_table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op5_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sadedup.repeated_spans(_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfair.schedule(_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_sections(_table(spark, sf_dir, "documents"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.neighbours(_table(spark, sf_dir, "embeddings"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.similar_documents(_table(spark, sf_dir, "documents"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return egojoin.near_duplicates(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_token_output": op2_token_output,
        "op3_bpe": op3_bpe,
        "op4_language_id": op4_language_id,
        "op5_repeated_spans": op5_repeated_spans,
        "op6_mixing": op6_mixing,
        "op7_token_counts": op7_token_counts,
        "op8_top_k": op8_top_k,
        "op9_ngram_join": op9_ngram_join,
        "op10_near_duplicates": op10_near_duplicates,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_repeated_spans": sadedup.ORACLE_SQL, "op8_top_k": topk.ORACLE_SQL, "op9_ngram_join": partenum.ORACLE_SQL, "op10_near_duplicates": egojoin.ORACLE_SQL}
