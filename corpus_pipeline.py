"""A training corpus from ``documents``: five stages, each on all that the one before kept.

Language identification drops texts whose language cannot be told; near-dedup
keeps one document of each class; decontamination drops documents that contain
a benchmark item; the secret scan masks live credentials; the mixture repeats
or leaves out documents until each source has its share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import decontaminate, language_id, mixing, near_dedup, secrets
from loomline.llm._scratch import written
from loomline.session import ship_package

#: Columns of documents, which every stage but the last returns.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return language_id.known_language(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five words a shingle, similarity 0.8."""
    ship_package(spark)
    return near_dedup.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secrets.redact_secrets(docs)
    return masked.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mixture takes of each document; documents that it leaves out are not in it."""
    ship_package(spark)
    taken = mixing.mix(docs).filter("taken > 0")
    return taken.select(F.col("id").alias("doc_id"), F.element_at("members", 1).alias("source"), "size", "source_size", "target", "taken")


STAGES = [
    ("language ID", identify_language),
    ("near-dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("secret scan", mask_secrets),
    ("mixture", mix_sources),
]
#: The stages are models, iterations and sketches, which SQL cannot express; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
