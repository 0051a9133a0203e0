"""Corpus pipeline: raw documents to packed token sequences, in five stages.

1. quality rules: rows that fail the rules or the classifier go;
2. n-gram Jaccard join: one document of each group of near copies stays;
3. benchmark decontamination: documents that leak a benchmark item go;
4. secret scans: secrets are replaced by a mark, ``n_chars`` follows;
5. packing: token sequences.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one
before it kept; ``run`` writes each result as Parquet in the cluster's shared
folder and rereads it, so a lost executor costs one stage at most. All stages
but the last return the columns of ``docs``. Null texts have no words and end in
stage 1; an empty table goes through to an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripcast.llm import decontaminate, ngram_join, packing, quality, secrets_scan
from tripcast.llm.common import prepare, read_table
from tripcast.session import app_id, ensure_checkpoint_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets_scan.redact(docs, secrets_scan.train(docs))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(kind))
    return clean.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_leaks),
    ("secret scans", secrets),
    ("packing", pack),
]

#: Fitted models and tokenizer ids are beyond SQL; tests/llm compare with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    prepare(spark)
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{app_id(spark)}-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = f"{root}/{k}-{name.replace(' ', '_')}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
