"""Queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

import corpus_pipeline

from . import bloomlm, bpe, convrepair, decontaminate, langid, linededup, mixing, perspectives, pii, quality, simhash, sql, toxicity
from .common import Stage, fold, table


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 7) == 2
    model = bloomlm.train(docs.filter(~held_out), Stage(spark, "bloomlm"))
    return bloomlm.score_documents(docs, model).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score"
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(table(spark, sf_dir, "documents").select("doc_id", "text"), **linededup.WHOLE)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components_of(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, mixing.domains_of(table(spark, sf_dir, "labels")), mixing.TARGETS)


def op3_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mask as text: start:end spans, comma-joined."""
    out = perspectives.rotate(table(spark, sf_dir, "conversations"))
    spans = F.transform("mask", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return out.withColumn("mask", F.array_join(spans, ","))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(table(spark, sf_dir, "documents"), pii.train(spark)))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model).select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.predict(docs, langid.train(docs)).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return convrepair.report(turns, convrepair.damage(turns))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe.load(public_tokenizers.path("word_bpe_49k.json"))
    coded = bpe.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary, decoded="decoded")
    return coded.select("doc_id", bpe.count(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_mixing": op2_mixing,
    "op3_chat_perspectives": op3_chat_perspectives,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_line_dedup": op5_line_dedup,
    "op6_simhash": op6_simhash,
    "op7_quality_rules": op7_quality_rules,
    "op8_pii": op8_pii,
    "op9_toxicity": op9_toxicity,
    "op10_language": op10_language,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_bpe": op12_bpe,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {"op3_chat_perspectives": sql.CHAT, "op7_quality_rules": sql.QUALITY}
