"""Sequestered tables: reads fail until they are unlocked for a stated reason, and the lock closes again by itself."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

LEAST_REASON = 20


class SequestrationError(RuntimeError):
    """A read of a sequestered table while it is locked."""


class Guard:
    def __init__(self, tables: dict[str, str]):
        self.tables, self.reason = tables, None

    @property
    def locked(self) -> bool:
        return self.reason is None

    @contextmanager
    def unlocked(self, reason: str) -> Iterator[Guard]:
        if len(reason.strip()) < LEAST_REASON:
            raise ValueError(f"state a reason of {LEAST_REASON} characters or more")
        self.reason = reason
        try:
            yield self
        finally:
            self.reason = None

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        if name not in self.tables:
            raise KeyError(f"{name} is not sequestered here")
        if self.locked:
            raise SequestrationError(f"{name} is sequestered")
        return spark.read.parquet(self.tables[name])
