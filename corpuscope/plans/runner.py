"""Runs named queries into a folder, each only if its result isn't there yet, and tells which are."""

from __future__ import annotations

from pyspark.sql import SparkSession

from corpuscope.plans.queries import QUERIES

STEPS = ("corpus_stats", "bigram_profile", "trigram_profile", "cooccurrence_l2", "positional_features", "feature_vector", "form_cosine", "pairwise_distance")


def done(spark: SparkSession, folder: str, step: str) -> bool:
    """Whether a step has committed its result."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{step}/_SUCCESS")
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def status(spark: SparkSession, folder: str, steps: tuple[str, ...] = STEPS) -> dict[str, bool]:
    return {s: done(spark, folder, s) for s in steps}


def run(spark: SparkSession, tables: str, folder: str, steps: tuple[str, ...] = STEPS, force: bool = False) -> list[str]:
    """Returns the steps that ran."""
    ran = []
    for step in steps:
        if force or not done(spark, folder, step):
            QUERIES[step](spark, tables).write.mode("overwrite").parquet(f"{folder}/{step}")
            ran.append(step)
    return ran
