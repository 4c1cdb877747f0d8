"""Reward arithmetic, operator schedules and hash chains of the search log."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Operators with their weights and whether they count as weird (fixed values).
OPERATORS = {
    "token_char_edit": (0.15, False), "suffix_family_rewrite": (0.13, False), "swap_bigram_order": (0.06, False),
    "split_token": (0.07, False), "merge_bigram": (0.06, False), "sequence_span_rewrite": (0.14, True),
    "function_word_burst": (0.13, True), "paradigm_family_rewrite": (0.13, True), "macro_bundle_rewrite": (0.13, True),
}
BETA, FLOOR, CEILING, WEIRD_GAIN, STABLE_GAIN = 8.0, 0.15, 1.0, 1.8, 1.4
GAINS = {"struct_gain": 8.0, "form_gain": 4.0, "suffix_gain": 2.0, "trigram_gain": 2.0}
JOINT, RELIEF, COHERENCE_DROP, COST_WEIGHT = 0.01, 1.0, 0.05, 0.005
FORM_WEIGHT, COHERENCE_WEIGHT = 0.75, 0.05


def total_score(struct: Column, form: Column, margin: Column, cost: Column) -> Column:
    return struct + FORM_WEIGHT * form + COHERENCE_WEIGHT * margin - COST_WEIGHT * cost


def weirdness(alignment: Column) -> Column:
    """From CEILING at no alignment down to FLOOR at a whole one, on a log scale."""
    inside = F.least(F.greatest(alignment, F.lit(0.0)), F.lit(1.0))
    cool = F.log1p(BETA * inside) / F.log1p(F.lit(BETA))
    return F.least(F.greatest(FLOOR + (CEILING - FLOOR) * (1 - cool), F.lit(FLOOR)), F.lit(CEILING))


def scheduled_weights(runs: DataFrame) -> DataFrame:
    """runs: run, alignment. Weight of each operator in each run, adding up to one."""
    table = runs.sparkSession.createDataFrame([(k, w, odd) for k, (w, odd) in OPERATORS.items()], "operator string, base double, odd boolean")
    each = runs.withColumn("weirdness", weirdness(F.col("alignment"))).crossJoin(F.broadcast(table))
    factor = F.when(F.col("odd"), 0.5 + WEIRD_GAIN * F.col("weirdness")).otherwise(0.5 + STABLE_GAIN * (1 - F.col("weirdness")))
    raw = each.withColumn("raw", F.col("base") * factor)
    return raw.select("run", "operator", "weirdness", (F.col("raw") / F.sum("raw").over(W.partitionBy("run"))).alias("weight"))


def amplified(steps: DataFrame) -> DataFrame:
    """Adds bonus, relief and adjusted: positive gains are rewarded, joint ones more."""
    bonus = sum((w * F.greatest(F.lit(0.0), F.col(g)) for g, w in GAINS.items()), F.lit(0.0))
    joint = (F.col("struct_gain") > 0) & (F.col("form_gain") > 0) & (F.col("coherence_gain") >= -COHERENCE_DROP)
    out = steps.withColumn("bonus", bonus + F.when(joint, JOINT).otherwise(0.0)).withColumn("relief", F.when(joint, COST_WEIGHT * RELIEF * F.col("cost")).otherwise(0.0))
    return out.withColumn("adjusted", F.col("total") + F.col("bonus") + F.col("relief"))


def record_hash(*columns: str) -> Column:
    """SHA-256 of the columns, as text and in this order, with bars between them."""
    return F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]), 256)


def link(before: str, payload: str) -> str:
    """The digest of a record: over the digest before it in its run (empty for the first) and its own payload."""
    return hashlib.sha256(f"{before}|{payload}".encode()).hexdigest()


def payload_text(run: str, order: str, payload: tuple[str, ...]) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in (run, order, *payload)])


def _linked(records: DataFrame, run: str, order: str, payload: tuple[str, ...], more: tuple[str, ...] = ()) -> DataFrame:
    """run, order and more columns of each record beside its __digest and __before. A run's records pass one task in order,
    which holds one Arrow batch and one digest, so a run may have any length; runs are spread over the tasks."""
    kept = tuple(dict.fromkeys((run, order, *more)))
    rows = records.select(*kept, F.col(run).cast("string").alias("__run"), payload_text(run, order, payload).alias("__payload"))
    ordered = rows.repartition("__run").sortWithinPartitions("__run", order, "__payload")
    schema = T.StructType([*rows.select(*kept).schema.fields, T.StructField("__digest", T.StringType()), T.StructField("__before", T.StringType())])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = (), ""
        for batch in batches:
            before, after = [], []
            for who, text in zip(batch.column("__run").to_pylist(), batch.column("__payload").to_pylist()):
                if at != (who,):
                    at, last = (who,), ""
                before.append(last)
                last = link(last, text)
                after.append(last)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(after, pa.string()), pa.array(before, pa.string())], [*kept, "__digest", "__before"])

    return ordered.mapInArrow(digests, schema)


def chained(events: DataFrame, run: str, order: str, payload: tuple[str, ...]) -> DataFrame:
    """run, order, sha256 (over the record and the digest before) and previous_sha256: a change of one record changes all
    digests behind it in its run."""
    return _linked(events, run, order, payload).withColumnsRenamed({"__digest": "sha256", "__before": "previous_sha256"})


def broken_links(records: DataFrame, run: str, order: str, payload: tuple[str, ...]) -> DataFrame:
    """records: the payload with the sealed sha256 and previous_sha256. Those whose digest, computed anew along the chain, or
    whose named predecessor differs."""
    good = (F.col("sha256") == F.col("__digest")) & (F.col("previous_sha256") == F.col("__before"))
    return _linked(records, run, order, payload, ("sha256", "previous_sha256")).filter(~F.coalesce(good, F.lit(False))).select(run, order)


def sealed(record: dict) -> bool:
    """Whether a record's sha256 is that of its canonical JSON (sorted keys, no spaces, no NaN) without it."""
    import json

    body = json.dumps({k: v for k, v in record.items() if k != "sha256"}, sort_keys=True, separators=(",", ":"), allow_nan=False)
    return record.get("sha256") == hashlib.sha256(body.encode()).hexdigest()


def operator_weights(alignment: float) -> dict[str, float]:
    """The schedule of one run on the driver: nine numbers."""
    import math

    cool = math.log1p(BETA * min(max(alignment, 0.0), 1.0)) / math.log1p(BETA)
    odd = min(max(FLOOR + (CEILING - FLOOR) * (1 - cool), FLOOR), CEILING)
    raw = {k: w * (0.5 + WEIRD_GAIN * odd if weird else 0.5 + STABLE_GAIN * (1 - odd)) for k, (w, weird) in OPERATORS.items()}
    return {k: w / sum(raw.values()) for k, w in raw.items()}


def in_hours(hour: Column, start: int, end: int) -> Column:
    """Whether an hour lies in a window that may run over midnight."""
    return (hour >= start) & (hour < end) if start <= end else (hour >= start) | (hour < end)


def relative_lift(value: Column, base: Column) -> Column:
    return F.when(base > 0, (value - base) / base * 100)


def as_clock(seconds: Column) -> Column:
    return F.format_string("%d:%02d:%02d", F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), F.floor(seconds % 60))
