"""Queries of the numbered operators over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, bagminhash, chat, decontam, embed_dedup, filter_audit, html_extract, langid, packing, pii, ppm, sharding, token_output


def _table(name: str, operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.with_probe(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return chat.digests(chat.format_chats(turns))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": _table("documents", langid.identify),
        "op2_best_fit_packing": _table("documents", packing.pack_documents),
        "op3_token_output": _table("documents", token_output.materialise),
        "op4_chat_formatting": op4_chat_formatting,
        "op5_personal_data": _table("documents", pii.report),
        "op6_decontamination": op6_decontamination,
        "op7_embedding_dedup": _table("embeddings", embed_dedup.near_duplicates),
        "op8_minhash_dedup": _table("documents", bagminhash.near_duplicates),
        "op9_sharding": _table("documents", sharding.shard),
        "op10_html_extraction": _table("pages", html_extract.extract),
        "op11_lm_scoring": _table("documents", ppm.score),
        "op12_tokenizer_alignment": _table("documents", alignment.report),
        "op13_filter_audit": filter_audit.op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_formatting": chat.ORACLE_SQL, "op6_decontamination": decontam.ORACLE_SQL, "op7_embedding_dedup": embed_dedup.ORACLE_SQL, "op13_filter_audit": filter_audit.ORACLE_SQL}
