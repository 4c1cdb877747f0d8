"""Quality rules, near-duplicates, personal data, mixing and encoding, one after the other over documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpuscope.llm import bpe, mixing, near, pii, quality
from corpuscope.llm.common import documents, saved


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule, or lie far from their language's and source's centre, go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five-word shingles, similarity 0.8) stays, that of the least id. Candidates come from
    SimHash fingerprints and, for those further apart than three bits, from bands of least hashes."""
    return near.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Valid personal data become pseudonyms of the same length."""
    return pii.pseudonymise(docs, pii.session_key(docs), counts=False)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; those that it doesn't take go. Null and empty texts have no words, so the
    mix may or may not take them; repeated rows are rows of their own; an empty table stays empty."""
    own = [c for c in docs.columns if c in ("shard", "place")]  # names that the mix uses itself
    taken = mixing.mixed(docs.withColumnsRenamed({c: f"__own_{c}" for c in own}))
    return taken.drop("shard", "place").withColumnsRenamed({f"__own_{c}": c for c in own}).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: number and digest of the ids of each row that is left. Null counts as empty, which has no ids; repeated
    rows give repeated rows; an empty table stays empty."""
    return bpe.encode(docs, keep=("doc_id", "lang", "source"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("simhash_near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("byte_bpe", encoding),
]

#: SQL can express neither the covariance estimates nor the merges; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each but the last is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
