"""Token families and their optimal assignment."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuscope.operators.profiles import CHAR_TOP, char_counts, profile

TOP = 12
AFFIX = 3
SHORT = (2, 4, 3)  # least and most characters, least count
#: Weights of mass, trigrams, suffixes and length, and what a differing kind adds (fixed values).
COSTS = {"mass": 0.20, "c3": 0.45, "s3": 0.25, "length": 0.10, "kind": 0.20}


def members(token_counts: DataFrame, top: int = TOP) -> DataFrame:
    """corpus, family, kind, token, cnt of the top families of each kind: by shared suffix (tokens longer than it), by shared
    prefix (longer by two), with two types or more; and frequent short tokens by themselves."""
    token, cnt = F.col("token"), F.col("cnt")
    groups = {
        "suffix": (token_counts.filter(F.length(token) >= AFFIX + 1), F.substring(token, -AFFIX, AFFIX), 2),
        "prefix": (token_counts.filter(F.length(token) > AFFIX + 1), F.substring(token, 1, AFFIX), 2),
        "short_token": (token_counts.filter(F.length(token).between(*SHORT[:2]) & (cnt >= SHORT[2])), token, 1),
    }
    label = {"suffix": "suffix:", "prefix": "prefix:", "short_token": "short:"}
    parts = []
    for kind, (rows, key, least) in groups.items():
        keyed = rows.withColumn("key", key)
        sums = keyed.groupBy("corpus", "key").agg(F.sum("cnt").alias("mass_cnt"), F.count(F.lit(1)).alias("k")).filter(F.col("k") >= least)
        best = sums.withColumn("rnk", F.row_number().over(W.partitionBy("corpus").orderBy(F.col("mass_cnt").desc(), "key"))).filter(F.col("rnk") <= top)
        parts.append(keyed.join(best.select("corpus", "key"), ["corpus", "key"]).select("corpus", F.concat(F.lit(label[kind]), "key").alias("family"), F.lit(kind).alias("kind"), "token", "cnt"))
    return reduce(lambda a, b: a.union(b), parts)


def inventory(token_counts: DataFrame, top: int = TOP) -> DataFrame:
    whole = token_counts.groupBy("corpus").agg(F.sum("cnt").alias("all"))
    rows = members(token_counts, top).groupBy("corpus", "family", "kind").agg(F.sum("cnt").alias("total_occurrences"), F.count(F.lit(1)).alias("member_token_count"), (F.sum(F.length("token") * F.col("cnt")) / F.sum("cnt")).alias("mean_token_length"))
    return rows.join(whole, "corpus").select("corpus", "family", "kind", (F.col("total_occurrences") / F.col("all")).alias("mass"), "total_occurrences", "member_token_count", "mean_token_length")


def pair_costs(token_counts: DataFrame, left: str, right: str, top: int = TOP) -> DataFrame:
    """Cost of matching each family of one corpus with each of the other: 36 by 36 at most."""
    two = token_counts.filter(F.col("corpus").isin(left, right)).persist()  # read once for each kind and profile
    inv = inventory(two, top)
    each = members(two, top).select(F.concat_ws("\t", "corpus", "family").alias("fam"), "token", "cnt")
    profs = {k: profile(char_counts(each, k, "fam"), CHAR_TOP[k], "gram", "fam").select("fam", "gram", "p") for k in ("c3", "s3")}
    side = lambda name, p: inv.filter(F.col("corpus") == name).select(*(F.col(c).alias(p + c) for c in ("family", "kind", "mass", "mean_token_length")), F.concat_ws("\t", "corpus", "family").alias(p + "fam"))
    pairs = side(left, "a_").crossJoin(side(right, "b_"))
    for k, prof in profs.items():
        norm = prof.groupBy("fam").agg(F.sqrt(F.sum(F.col("p") * F.col("p"))).alias("norm"))
        a = prof.filter(F.col("fam").startswith(left + "\t")).select(F.col("fam").alias("a_fam"), "gram", F.col("p").alias("pa"))
        b = prof.filter(F.col("fam").startswith(right + "\t")).select(F.col("fam").alias("b_fam"), "gram", F.col("p").alias("pb"))
        dots = a.join(b, "gram").groupBy("a_fam", "b_fam").agg(F.sum(F.col("pa") * F.col("pb")).alias("dot"))
        dots = dots.join(norm.select(F.col("fam").alias("a_fam"), F.col("norm").alias("na")), "a_fam").join(norm.select(F.col("fam").alias("b_fam"), F.col("norm").alias("nb")), "b_fam")
        pairs = pairs.join(dots.select("a_fam", "b_fam", (F.col("dot") / (F.col("na") * F.col("nb"))).alias(f"cos_{k}")), ["a_fam", "b_fam"], "left")
    lengths = F.greatest("a_mean_token_length", "b_mean_token_length", F.lit(1.0))
    cost = (
        COSTS["mass"] * F.abs(F.col("a_mass") - F.col("b_mass")) + COSTS["c3"] * (1 - F.coalesce("cos_c3", F.lit(0.0))) + COSTS["s3"] * (1 - F.coalesce("cos_s3", F.lit(0.0)))
        + COSTS["length"] * F.abs(F.col("a_mean_token_length") - F.col("b_mean_token_length")) / lengths + F.when(F.col("a_kind") != F.col("b_kind"), COSTS["kind"]).otherwise(0.0)
    )
    return pairs.select("a_family", "b_family", F.least(F.greatest(cost, F.lit(0.0)), F.lit(1.0)).alias("cost"))


def assignment(cost: np.ndarray) -> np.ndarray:
    """Column of each row (-1: none) in a matching of least total cost, by shortest augmenting paths with potentials."""
    rows, cols = cost.shape
    if rows > cols:
        back = assignment(cost.T)
        out = np.full(rows, -1)
        out[back[back >= 0]] = np.flatnonzero(back >= 0)
        return out
    match, u, v = np.full(cols, -1), np.zeros(rows), np.zeros(cols)
    for start in range(rows):
        way, reach = np.full(cols, -1), np.full(cols, np.inf)
        done = np.zeros(cols, bool)
        row, col = start, -1
        while row >= 0:
            base = reach[col] if col >= 0 else 0.0
            slack = base + cost[row] - u[row] - v
            better = ~done & (slack < reach)
            reach[better], way[better] = slack[better], col
            col = int(np.argmin(np.where(done, np.inf, reach)))
            done[col] = True
            row = int(match[col])
        last = reach[col]
        ends = done.copy()
        ends[col] = False
        u[start] += last
        for j in np.flatnonzero(ends):
            u[match[j]] += last - reach[j]
            v[j] -= last - reach[j]
        while col >= 0:
            before = way[col]
            match[col] = match[before] if before >= 0 else start
            col = before
    out = np.full(rows, -1)
    out[match[match >= 0]] = np.flatnonzero(match >= 0)
    return out


def assign(costs: DataFrame) -> DataFrame:
    """The matched pairs of a cost table (a_family, b_family, cost) of bounded size."""

    def run(table: pa.Table) -> pa.Table:
        a, b = sorted(set(table.column("a_family").to_pylist())), sorted(set(table.column("b_family").to_pylist()))
        matrix = np.zeros((len(a), len(b)))
        at, bt = {x: i for i, x in enumerate(a)}, {x: i for i, x in enumerate(b)}
        for x, y, c in zip(*(table.column(n).to_pylist() for n in ("a_family", "b_family", "cost"))):
            matrix[at[x], bt[y]] = c
        chosen = [(a[i], b[j], matrix[i, j]) for i, j in enumerate(assignment(matrix)) if j >= 0]
        return pa.table({"a_family": [x[0] for x in chosen], "b_family": [x[1] for x in chosen], "cost": pa.array([x[2] for x in chosen], pa.float64())})

    return costs.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(run, "a_family string, b_family string, cost double")


def alignment_of(counts: DataFrame, left: str, right: str) -> DataFrame:
    """score and matched of two corpora of counts (corpus, token, cnt), from their own numbers of families."""
    sizes = {r["corpus"]: r["n"] for r in inventory(counts.filter(F.col("corpus").isin(left, right))).groupBy("corpus").agg(F.count(F.lit(1)).alias("n")).collect()}
    return alignment_score(assign(pair_costs(counts, left, right)), sizes.get(left, 0), sizes.get(right, 0))


def alignment_score(matched: DataFrame, left_count: int, right_count: int, unmatched: float = 1.0) -> DataFrame:
    """1 less the mean cost over the larger side, what is unmatched costing a full unit."""
    total = F.coalesce(F.sum("cost"), F.lit(0.0)) + unmatched * (left_count + right_count - 2 * F.count(F.lit(1)))
    return matched.agg(F.greatest(F.lit(0.0), 1 - total / max(left_count, right_count, 1)).alias("score"), F.count(F.lit(1)).alias("matched"))
