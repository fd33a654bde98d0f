"""A corpus pipeline of five operators, each stage written as Parquet and read
again as the next one's documents.

Stages: quality rules (rejected documents go), MinHash near-dedup (one
document of each group stays), substring dedup (repeated passages are cut from
the texts), benchmark decontamination (documents with a leaked item go), and
BPE (adds the ids of the whole text and a digest of the text they decode to).
All but the last return the columns of ``documents``; ``n_chars`` is kept in
step with a text that was cut.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import bpe, decontaminate, near_dup, quality_rules, substring_dup
from tallyspark.llm.tables import drop_folder
from tallyspark.session import checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.representatives(docs, shingle=5, percent=80)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = substring_dup.remove_repeats(docs, window=35)
    changed = F.col("n_removed") > 0
    new = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumns(new).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    # The shuffle parts the two: a core's one Python worker first encodes, then
    # decodes, in place of two workers with their tables and batches at a time.
    encoded = bpe.encode(docs, path).repartition("doc_id", "text")
    decoded = bpe.decode(encoded, path, decoded_col="_decoded")
    return decoded.withColumns({"n_tokens": F.size("ids").cast("long"),
                                "decoded_sha256": F.sha2("_decoded", 256)}).drop("_decoded")


STAGES = [("quality_rules", quality), ("minhash_dedup", dedup), ("substring_dedup", passages),
          ("decontamination", decontamination), ("bpe", tokens)]

#: The near-dedup and substring stages and the tokenizer are beyond one SQL
#: statement; ``tests/llm/test_pipeline.py`` holds the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's output is a table in the
    shared folder, so a lost executor costs no earlier stage.  A stage's table
    goes when the next one is written; the last one's stays, as the result
    reads it."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
        if before:
            drop_folder(spark, f"{root}/{before}")
        before = name
    return docs
