"""Queries and DuckDB SQL of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, jaccard, langid, licenses, merkle, pieces, pii, quality, token_counts, toxicity, url_filter, whitening
from .common import documents, remainder


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    learn = docs.where(F.coalesce(remainder("doc_id", 3) != 1, F.lit(True)))
    model = langid.train(learn, "text", "lang", "doc_id")
    out = langid.predict(docs, model, "text", ["doc_id"])
    held = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels.where(remainder("doc_id", 5) != 0), "doc_id", "text", "toxic")
    out = toxicity.predict(docs, model, "text", ["doc_id"])
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": pii.query,
        "op2_url_filter": url_filter.query,
        "op3_decontamination": decontaminate.query,
        "op4_sentencepiece": pieces.query,
        "op5_jaccard_join": jaccard.query,
        "op6_token_counts": token_counts.query,
        "op7_language_id": op7_language_id,
        "op8_toxicity": op8_toxicity,
        "op9_license_scan": licenses.query,
        "op10_quality_rules": quality.query,
        "op11_whitening": whitening.query,
        "op12_chat_format": chat.query,
        "op13_merkle_manifest": merkle.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_pii": pii.SQL,
        "op2_url_filter": url_filter.SQL,
        "op5_jaccard_join": jaccard.SQL,
        "op9_license_scan": licenses.SQL,
        "op10_quality_rules": quality.SQL,
        "op12_chat_format": chat.SQL,
        "op13_merkle_manifest": merkle.SQL,
    }
