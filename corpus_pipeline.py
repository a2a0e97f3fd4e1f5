"""A training corpus from raw documents: rules, classifier, near duplicates, repeated passages, packing.

Each stage takes what the one before it kept, and is written as Parquet in the folder all executors share
before the next one reads it, so a lost executor costs a stage's tasks, not the pipeline.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kerbline.llm import bin_slack, kneser_ney, near_dedup, queries, rules, tree_dedup


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.keep(docs, queries.table(spark, sf_dir, "labels"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kneser_ney.keep(docs, queries.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tree_dedup.without_passages(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bin_slack.pack(docs, queries.tokenizer("word_bpe_49k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("best_fit_packing", packing),
]

#: Learned rules, a language model and a packing are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one named by spark.checkpoint.dir; one of this machine only for a local master without it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="kerbline-pipeline-")
    return f"{named.rstrip('/')}/pipeline-{uuid.uuid4().hex}"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    folder = shared_folder(spark)
    for number, (name, stage) in enumerate(STAGES, 1):
        out = stage(spark, docs, sf_dir)
        if number == len(STAGES):
            return out
        out.write.parquet(f"{folder}/{number}-{name}")
        docs = spark.read.parquet(f"{folder}/{number}-{name}")
    return docs


def register(registered: dict[str, Callable[[SparkSession, str], DataFrame]], oracles: dict[str, str]) -> None:
    registered["pipeline"] = run
    if ORACLE_SQL is not None:
        oracles["pipeline"] = ORACLE_SQL
