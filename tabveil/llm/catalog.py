"""The registered queries of the operators, and the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabveil.llm import (
    chunk_recipes, decontaminate, merkle, mixing, ngram_join, periodic_runs, pii_boost, quality_rules, sentence_spans, statements, suffix_dedup,
    toxicity, url_rules, warc_zip,
)

Build = Callable[[SparkSession, str], DataFrame]

# Rules of the URL query: verdict, host, path.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

# Bytes of the shorter passages that op1 also counts.
SHORT_REPEAT = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), also=(SHORT_REPEAT,))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
                        F.element_at("n_also", 1).alias(f"n_repeated_{SHORT_REPEAT}"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), decontaminate.contaminated().alias("contaminated"))


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), url_rules.rule_table(spark, URL_RULES))


def op4_pii_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_boost.find(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"CAST(size(filter(base, s -> s.kind = {i})) AS long)").alias(f"n_{k}") for i, k in enumerate(pii_boost.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii_boost.listed("base").cast("binary"), 256).alias("base_sha256"),
                        pii_boost.listed("concat(base, added)").alias("spans"), F.size("added").cast("long").alias("n_added"),
                        (F.size("base") + F.size("added")).cast("long").alias("n_spans"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, found = mixing.mix(table(spark, sf_dir, "documents"))
    return rows.withColumns({"exponent": F.lit(found.exponent), "entropy": F.lit(found.entropy),
                             "wanted_entropy": F.lit(found.wanted).cast("double"), "outcome": F.lit(found.outcome)})


def op7_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc_zip.read_packages(spark, warc_zip.store(table(spark, sf_dir, "pages")), with_payload=False)
    return records.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                          F.col("refers_to").cast("long").alias("refers_to"))


def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.dedup(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = toxicity.score(documents, toxicity.fit(documents, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "segments")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.ledger(table(spark, sf_dir, "documents"))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       quality_rules.rejected("base").alias("base_failed"), (~quality_rules.rejected("v1")).alias("kept"), "fail_bits")


def op11_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_recipes.mark(table(spark, sf_dir, "documents"))


def id_checksum() -> Column:
    """The unsigned CRC-32 of the decimal doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Exact also at the largest number of characters.
    one_more = F.col("n_chars").cast("decimal(20, 0)") + F.when(id_checksum() % 7 == 0, 1).otherwise(0).cast("decimal(20, 0)")
    book = merkle.manifest(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id",
                           {"n_chars": one_more})
    proof = F.sha2(F.lower(F.hex("proof")), 256)
    return merkle.proofs(spark, book, "doc_id").select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", "verified")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Every tenth text repeats itself from some word on.
    echo = F.when(id_checksum() % 10 == 0, F.floor(id_checksum() / 10))
    found = periodic_runs.find(table(spark, sf_dir, "documents"), echo=echo).withColumn("best", periodic_runs.strongest())
    milli = F.expr("1000 * best.length div best.period")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                        milli.alias("exponent_milli"), F.sha2(periodic_runs.listing(), 256).alias("runs_sha256"),
                        F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES: dict[str, Build] = {f.__name__: f for f in (
    op1_suffix_dedup, op2_decontaminate, op3_url_rules, op4_pii_boost, op5_ngram_join, op6_mixing, op7_warc_zip, op8_sentence_spans,
    op9_toxicity, op10_quality_rules, op11_chunk_recipes, op12_merkle_manifest, op13_periodic_runs)}

SQL: dict[str, str] = statements.SQL
