"""Writers: matrices as sparse Parquet, profiles, fingerprint records, previews, CSV tables, and files that are written once."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_matrix(entries: DataFrame, path: str) -> None:
    """Sparse entries, a folder for each corpus."""
    entries.write.mode("overwrite").partitionBy("corpus").parquet(path)


def write_profiles(profiles: DataFrame, path: str) -> None:
    """One JSON object a corpus: gram -> share. Profiles are bounded by their top N."""
    maps = profiles.groupBy("corpus").agg(F.map_from_entries(F.collect_list(F.struct("gram", F.round("p", 12)))).alias("profile"))
    maps.write.mode("overwrite").json(path)


def fingerprint_records(vectors: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """One nested record a corpus: its features as a struct and its scores as a map (null where there are none)."""
    features = F.struct(*[c for c in vectors.columns if c != "corpus"]).alias("features")
    base = vectors.select("corpus", features)
    if scores is None:
        return base.withColumn("scores", F.lit(None).cast("map<string,double>"))
    maps = scores.groupBy("corpus").agg(F.map_from_entries(F.collect_list(F.struct("name", "score"))).alias("scores"))
    return base.join(maps, "corpus", "left")


def write_records(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").json(path)


def read_records(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def preview(seqs: DataFrame, rows: int = 40) -> DataFrame:
    """The first sequences of a corpus as lines."""
    return seqs.orderBy("corpus", "doc_id", "seq").limit(rows).select(F.array_join("tokens", " ").alias("line"))


def write_csv(rows: DataFrame, path: str) -> None:
    """One CSV file with a header; for reports, which are small."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def square(correlations: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """A correlation table as a square, in the order of the features."""
    wide = correlations.groupBy(F.col("feature_a").alias("feature")).pivot("feature_b", list(features)).agg(F.first("rho"))
    place = F.array_position(F.array(*map(F.lit, features)), F.col("feature"))
    return wide.orderBy(place)


def publish_json(value: object, path: str, immutable: bool = False) -> None:
    """Writes a small JSON file whole or not at all; an immutable one only if it isn't there or is equal."""
    body = json.dumps(value, sort_keys=True, indent=1, ensure_ascii=False)
    if immutable and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            if f.read() != body:
                raise FileExistsError(f"{path} holds something else")
        return
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(body)
        f.flush()
        os.fsync(f.fileno())
    os.replace(name, path)
