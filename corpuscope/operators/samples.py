"""Keyed samples, budgets, ladders. Draws follow from a hash of seed and key, never from call order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuscope.operators.corpus import running_before, sequences

SAMPLE_SEED = 1729
BUDGET = 20_000


def draw(seed: int | str, *parts: str | Column) -> Column:
    """Hex digest that orders rows at random but the same way always."""
    columns = [F.lit(str(seed))] + [F.col(p).cast("string") if isinstance(p, str) else p for p in parts]
    return F.sha2(F.concat_ws(":", *columns), 256)


def stable_seed(seed: int, name: str | Column) -> Column:
    """Whole number below 2**32 that seed and name decide."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(name) if isinstance(name, str) else name), 256)
    return F.conv(F.substring(digest, 9, 8), 16, 10).cast("long")


def within_budget(numbered: DataFrame, budget: int) -> DataFrame:
    """numbered: corpus, tokens, before (tokens that come earlier). Keeps what fits, the last sequence cut."""
    left = F.lit(budget) - F.col("before")
    return numbered.filter(left > 0).withColumn("tokens", F.slice("tokens", F.lit(1), F.least(F.size("tokens"), left.cast("int"))))


def budget_sample(corpora: DataFrame, budget: int = BUDGET, seed: int = SAMPLE_SEED, strict: bool = False) -> DataFrame:
    """Sequences in keyed random order until each corpus has `budget` tokens. The order is by buckets of the digest, then
    inside each bucket, so no task sorts a corpus. strict: raises for a corpus with fewer tokens."""
    rows = sequences(corpora).withColumn("size", F.size("tokens")).withColumn("key", draw(seed, "corpus", "doc_id", "seq"))
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    # A whole-number order: 32 bits of the digest; the buckets hold 2**16 values each.
    ordered = running_before(rows.withColumn("place", place), "corpus", "place", "size", "before", 1 << 16)
    if strict:
        totals = rows.groupBy("corpus").agg(F.sum("size").alias("all"))
        checked = totals.select("corpus", F.when(F.col("all") < budget, F.raise_error(F.concat(F.lit("too few tokens: "), "corpus"))).cast("int").alias("ok"))
        ordered = ordered.join(checked, "corpus").filter("ok is null").drop("ok")
    return within_budget(ordered, budget).select("corpus", "doc_id", "seq", "tokens")


def budget_prefix(corpora: DataFrame, budget: int, strict: bool = False) -> DataFrame:
    """The first `budget` tokens in document order; strict: an error where a corpus has fewer."""
    sized = corpora.withColumn("size", F.aggregate("seqs", F.lit(0).cast("long"), lambda a, s: a + F.size(s)))
    if strict:
        totals = sized.groupBy("corpus").agg(F.sum("size").alias("all"))
        checked = totals.select("corpus", F.when(F.col("all") < budget, F.raise_error(F.concat(F.lit("too few tokens: "), "corpus"))).cast("int").alias("ok"))
        sized = sized.join(checked, "corpus").filter("ok is null").drop("ok")
    first = running_before(sized, "corpus", "doc_id", "size", "start").filter(F.col("start") < budget)
    rows = first.select("corpus", "doc_id", "start", F.posexplode("seqs").alias("seq", "tokens"))
    inner = F.sum(F.size("tokens")).over(W.partitionBy("corpus", "doc_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)) - F.size("tokens")
    return within_budget(rows.withColumn("before", F.col("start") + inner), budget).select("corpus", "doc_id", "seq", "tokens")


def sample(rows: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """n rows without replacement."""
    return rows.orderBy(draw(seed, *key), *key).limit(n)


def head(rows: DataFrame, n: int, order: str) -> DataFrame:
    """Rows whose number is below n."""
    return rows.filter(F.col(order) < n)


def ladder(stages: DataFrame, order: str, by: str) -> DataFrame:
    """First, quarter, half, three quarters, third from the end and last stage of each run."""
    numbered = stages.withColumn("i", F.row_number().over(W.partitionBy(by).orderBy(order)) - 1).withColumn("n", F.count(F.lit(1)).over(W.partitionBy(by)) - 1)
    n = F.col("n")
    wanted = F.array(F.lit(0), F.floor(n / 4), F.floor(n / 2), F.floor(3 * n / 4), F.greatest(n - 3, F.lit(0)), n).cast("array<bigint>")
    return numbered.filter(F.array_contains(wanted, F.col("i").cast("bigint"))).drop("n")


def block_number(name: Column) -> Column:
    """Number at the end of block_0001; 0 if there is none."""
    return F.coalesce(F.element_at(F.split(name, "_"), -1).try_cast("int"), F.lit(0))
