"""The chained log as a stream: each run's records are linked in order, exactly once, with the last digest in the state store."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from corpuscope.operators.schedule import link, payload_text

#: What becomes of a record: linked to the chain, or a second version of one that is linked already or waits.
LINKED, CHANGED = "linked", "changed"
OUTPUT = "run string, position long, payload string, sha256 string, previous_sha256 string, outcome string"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Chain(StatefulProcessor):
    """State of a run: its next position with the last digest, the records that came before their turn, and a digest of each
    record's payload, so that repeats are told from changes. It grows by one digest a record and lies in the store, not in memory."""

    def __init__(self, first: int):
        self.first = first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.end = handle.getValueState("end", "position long, sha256 string")
        self.waiting = handle.getMapState("waiting", "position long", "payload string")
        self.known = handle.getMapState("known", "position long", "digest string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        run = key[0]
        turn, last = self.end.get() if self.end.exists() else (self.first, "")
        for frame in rows:
            out = []
            for position, payload in zip(frame["position"].tolist(), frame["payload"].tolist()):
                digest = hashlib.sha256(payload.encode()).hexdigest()
                if self.known.containsKey((position,)):
                    if self.known.getValue((position,))[0] != digest:
                        out.append((run, position, payload, None, None, CHANGED))
                    continue
                self.known.updateValue((position,), (digest,))
                if position != turn:
                    self.waiting.updateValue((position,), (payload,))
                    continue
                while True:
                    before, last = last, link(last, payload)
                    out.append((run, turn, payload, last, before, LINKED))
                    turn += 1
                    if not self.waiting.containsKey((turn,)):
                        break
                    payload = self.waiting.getValue((turn,))[0]
                    self.waiting.removeKey((turn,))
            if out:
                yield pd.DataFrame(out, columns=["run", "position", "payload", "sha256", "previous_sha256", "outcome"])
        self.end.update((turn, last))

    def close(self) -> None:
        pass


def chain_stream(events: DataFrame, run: str, order: str, payload: tuple[str, ...], first: int = 1) -> DataFrame:
    """events: a stream. Its records with the digests of `schedule.chained`, whatever the order they come in: a record waits until
    all before it, from position `first` on, are there. One that comes again unchanged gives no row; one that comes again with other values
    gives a row `changed` without digests and leaves the chain as it is. Records with a null run or position, or a position
    before the first, are left out: no chain holds them."""
    known = events.filter(F.col(run).isNotNull() & (F.col(order) >= first))
    rows = known.select(F.col(run).cast("string").alias("run"), F.col(order).cast("long").alias("position"), payload_text(run, order, payload).alias("payload"))
    return rows.groupBy("run").transformWithStateInPandas(Chain(first), OUTPUT, "Append", "None")


def run_chain(spark: SparkSession, events: DataFrame, out: str, checkpoint: str, run: str, order: str, payload: tuple[str, ...], first: int = 1) -> StreamingQuery:
    """Adds what has come since the last call to the log at `out` (Parquet) and ends. The checkpoint holds offsets and state and the sink
    its own list of finished files, so a call after a failure goes on where the last finished batch ended and writes no row twice."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STORE)  # a query copies the session's settings when it starts
    try:
        chain = chain_stream(events, run, order, payload, first)
        return chain.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before)


def broken_chain(log: DataFrame) -> DataFrame:
    """run, position of the linked rows of a log whose digests don't follow from its payloads, or whose predecessor isn't there."""
    from pyspark.sql import Window as W

    rows = log.filter(F.col("outcome") == LINKED)
    own = F.sha2(F.concat_ws("|", "previous_sha256", "payload"), 256)
    over = W.partitionBy("run").orderBy("position")
    told = rows.withColumn("__before", F.lag("sha256").over(over)).withColumn("__gap", F.col("position") - F.lag("position").over(over))
    good = (F.col("sha256") == own) & (F.col("previous_sha256") == F.coalesce("__before", F.lit(""))) & (F.coalesce("__gap", F.lit(1)) == 1)
    return told.filter(~F.coalesce(good, F.lit(False))).select("run", "position")
