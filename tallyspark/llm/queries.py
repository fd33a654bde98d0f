"""Registered queries of the operators: each applies its operator, with
production parameters, to the whole of its table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.session import checkpoint_dir

from . import (bpe, decontaminate, html_extract, langid, lexical_search, license_scan, near_dup, quality_model,
               quality_rules, spelling, substring_dup, token_count, warc)
from .oracle import ORACLE_SQL  # noqa: F401  (with QUERIES, what is registered)
from .tables import drop_folder

BPE_FILE = "byte_bpe_50k.json"
UNIGRAM_FILE = "piece_bpe_32k.model"
LINE_SPACE = "[\\x20\\x09-\\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text")


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(_remainder(3) == 1, F.lit(False))
    model = langid.filters(docs.where(~held_out))
    return langid.predict(docs.select("doc_id", "text", held_out.alias("held_out")), model).select(
        "doc_id", "held_out", "lang_pred", "score")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(BPE_FILE)
    done = bpe.decode(bpe.encode(_documents(spark, sf_dir).withColumn(
        "text", F.coalesce("text", F.lit(""))), path).drop("text"), path)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held_out = F.coalesce(_remainder(5) == 0, F.lit(False))
    model = quality_model.train(docs, read(spark, sf_dir, "labels").where(~held_out))
    return quality_model.score(docs.withColumn("held_out", held_out), model).select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_documents(spark, sf_dir), read(spark, sf_dir, "benchmark")).select(
        "doc_id", "item_id", "n_shared", "n_item", "containment")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(_documents(spark, sf_dir)).drop("text").withColumn(
        "failed_rules", F.array_join(quality_rules.failed_rules(), ","))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.near_duplicates(_documents(spark, sf_dir), shingle=2, percent=80)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id",
                        F.col("component_id").eqNullSafe(F.col("id")).alias("kept"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dup.remove_repeats(_documents(spark, sf_dir), window=35)
    words = F.trim(F.regexp_replace(F.coalesce("kept_text", F.lit("")), LINE_SPACE, " "))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = token_count.zipf_vocabulary(public_tokenizers.path(UNIGRAM_FILE))
    return token_count.count_tokens(_documents(spark, sf_dir), vocabulary).drop("text")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages).withColumn("n_chars", F.length("text").cast("long"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_documents(spark, sf_dir), read(spark, sf_dir, "benchmark"), k=20)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_forms(_documents(spark, sf_dir), least_chars=7, least_n=2, ratio=10, slips_every=31)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    warc.write_archives(read(spark, sf_dir, "pages").select("page_id", "url", "html"), f"{root}/raw")
    warc.normalise(spark, f"{root}/raw", f"{root}/normal")
    drop_folder(spark, f"{root}/raw")
    found = warc.read_records(warc.index_of(spark, f"{root}/normal"))
    return found.select(warc.page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                        warc.page_of("refers_to").alias("refers_to"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_bpe": op2_bpe,
    "op3_quality_model": op3_quality_model,
    "op4_license_scan": op4_license_scan,
    "op5_decontamination": op5_decontamination,
    "op6_quality_rules": op6_quality_rules,
    "op7_minhash_dedup": op7_minhash_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_html_extraction": op10_html_extraction,
    "op11_lexical_search": op11_lexical_search,
    "op12_spelling": op12_spelling,
    "op13_warc": op13_warc,
}
