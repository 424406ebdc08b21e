"""One query for each operator, over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versewise.llm import (exact_dups, fingerprints, language, mixing, near_dups, packing, periodic, quality_knn, quality_rules,
                           repeats, search, token_store, warc)
from versewise.llm.common import documents

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_comparison(documents(spark, sf_dir))


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_ids(documents(spark, sf_dir), BYTE_BPE, end_id=0)


def op3_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.classes(documents(spark, sf_dir))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), BYTE_BPE, end_id=2, capacity=1024)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.judge(quality_rules.ledger(documents(spark, sf_dir)))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       "base_failed", "kept", "fail_bits")


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.ablation(quality_rules.ledger(documents(spark, sf_dir)))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = language.held_out(3, 1)
    return language.predict(docs, language.fit(docs, ~held)).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats(documents(spark, sf_dir))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = language.held_out(5, 0)
    model = quality_knn.fit(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"), ~held)
    return quality_knn.score(docs, model).select("doc_id", held.alias("held_out"), "score",
                                                 (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet")
    return warc.archive(pages, min_bytes=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.summary(periodic.periodic_runs(periodic.with_planted(documents(spark, sf_dir))))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dups.duplicates(documents(spark, sf_dir))


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_fingerprints": (op1_fingerprints, None),
    "op2_token_ids": (op2_token_ids, None),
    "op3_near_dups": (op3_near_dups, None),
    "op4_best_fit_packing": (op4_best_fit_packing, None),
    "op5_quality_rules": (op5_quality_rules, quality_rules.RULES_SQL),
    "quality_ablation": (quality_ablation, quality_rules.ABLATION_SQL),
    "op6_language_id": (op6_language_id, None),
    "op7_suffix_array_dedup": (op7_suffix_array_dedup, None),
    "op8_mixing": (op8_mixing, mixing.MIX_SQL),
    "op9_quality_classifier": (op9_quality_classifier, None),
    "op10_warc": (op10_warc, warc.ARCHIVE_SQL),
    "op11_lexical_search": (op11_lexical_search, search.SEARCH_SQL),
    "op12_periodic_runs": (op12_periodic_runs, None),
    "op13_exact_dedup": (op13_exact_dedup, exact_dups.EXACT_SQL),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in QUERIES.items() if sql}
