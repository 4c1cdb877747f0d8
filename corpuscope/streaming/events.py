"""The live log of a search as a stream: append, tail with running aggregates, last entries, progress."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

SCHEMA = "timestamp_utc timestamp, proposal_index long, candidate_index int, outcome string, operator string, details string, mutation_cost double, stage_id string, backend string, score_delta double, total_score double"
MODES = {"all": None, "selected": ("accepted", "selected"), "accepted_only": ("accepted",), "off": ()}


def append(events: DataFrame, path: str, mode: str = "all") -> None:
    """Adds rows to the log as JSON lines, those that the mode lets through."""
    wanted = MODES[mode]
    rows = events if wanted is None else events.filter(F.col("outcome").isin(*wanted) if wanted else F.lit(False))
    rows.write.mode("append").json(path)


def tail(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).json(path)


def operator_means(events: DataFrame) -> DataFrame:
    """Mean score delta and count of each operator so far."""
    return events.groupBy("operator").agg(F.avg("score_delta").alias("mean_delta"), F.count(F.lit(1)).alias("n"))


def windowed(events: DataFrame, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Accepted and all proposals in windows of event time; rows later than the watermark are left out."""
    return events.withWatermark("timestamp_utc", late).groupBy(F.window("timestamp_utc", size), "operator").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("outcome") == "accepted", 1)).alias("accepted"))


def run_means(spark: SparkSession, path: str, name: str, checkpoint: str) -> StreamingQuery:
    """Keeps operator_means in an in-memory table, exactly once by its checkpoint."""
    return operator_means(tail(spark, path)).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()


def last_entries(spark: SparkSession, path: str, checkpoint: str, show: Callable[[list], None], n: int = 10) -> StreamingQuery:
    """Calls show() with the last n entries of each batch."""

    def each(batch: DataFrame, _: int) -> None:
        show(batch.orderBy(F.col("proposal_index").desc(), F.col("candidate_index").desc()).limit(n).collect())

    return tail(spark, path).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


class Progress(StreamingQueryListener):
    """Calls back with the number of rows of each finished batch."""

    def __init__(self, callback: Callable[[str, int], None]):
        self.callback = callback

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.callback(event.progress.name or "", event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
