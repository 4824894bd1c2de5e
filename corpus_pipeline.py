"""A training corpus from raw documents, in five stages.

Each stage takes what its predecessor kept, as a table of its own, and its decisions take
effect: documents without a recognised language go, one document of each near-duplicate
group stays, documents that hold a benchmark item go, secrets are masked in the text, and
what is left is encoded. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperlake.llm.common import documents, remove_folder, shared_folder
from paperlake.llm.decontamination import drop_contaminated
from paperlake.llm.language import keep_known_language
from paperlake.llm.secrets import redact_secrets
from paperlake.llm.sentencepiece_dropout import dropout_ids, model_path
from paperlake.llm.simhash import drop_near_duplicates


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    return keep_known_language(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each near-duplicate group."""
    return drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked and n_chars brought up to date."""
    return redact_secrets(docs)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, lossless and ids of every document."""
    return dropout_ids(docs, model_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("sentencepiece_encoding", sentencepiece_encoding),
]

#: Near-duplicate groups, latent search and merges are beyond SQL; tests hold run() against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; only the last one's folder stays."""
    folder = f"{shared_folder(spark)}/corpus_pipeline_{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}_{name}")
        docs = spark.read.parquet(f"{folder}/{k}_{name}")
        if k:
            remove_folder(spark, f"{folder}/{k - 1}_{STAGES[k - 1][0]}")
    return docs


def queries() -> dict[str, Callable]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
