"""The registered queries of the operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from eventwatch.llm import hard_negatives, language_id, quality_model, toxicity
from eventwatch.llm.decontaminate import find_leaks
from eventwatch.llm.html_text import main_text
from eventwatch.llm.line_dedup import line_report
from eventwatch.llm.ngram_join import link_components
from eventwatch.llm.quality_rules import quality_rules
from eventwatch.llm.sentencepiece_bpe import encode_decode, public_model
from eventwatch.llm.sharding import shard_documents
from eventwatch.llm.spelling_variants import variants
from eventwatch.llm.suffix_dedup import cut_repeats
from eventwatch.llm.text_arrays import crc_of_id

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = encode_decode(table(spark, sf_dir, "documents"), public_model())
    return done.select(
        "doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents")).drop("row_number")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs)).select(
        "doc_id", (crc_of_id() % 3 == 1).alias("held_out"), "lang_pred", "score")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", (crc_of_id() % 4 == 2).alias("held_out"), "score", "predicted")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


def op11_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"))
    # without an id a row has no label to learn from
    held_out = F.coalesce(crc_of_id() % 5 == 0, F.lit(False))
    return quality_model.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hard_negatives.whole_numbers(table(spark, sf_dir, "embeddings"), 256)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_sharding": op3_sharding,
        "op4_decontamination": op4_decontamination,
        "op5_html_text": op5_html_text,
        "op6_language_id": op6_language_id,
        "op7_quality_rules": op7_quality_rules,
        "op8_toxicity": op8_toxicity,
        "op9_ngram_join": op9_ngram_join,
        "op10_line_dedup": op10_line_dedup,
        "op11_quality_model": op11_quality_model,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_spelling_variants": op13_spelling_variants,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    from eventwatch.llm.oracles import ORACLES

    return dict(ORACLES)
