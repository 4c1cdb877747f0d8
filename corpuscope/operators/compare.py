"""Corpora against each other: cosines, form scores, token scores, distances, ranks, nearest references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuscope.functions import text as X
from corpuscope.operators.corpus import ranked, types
from corpuscope.operators.profiles import FORM_WEIGHTS

STRUCT = ("ttr", "bigram_coverage", "trigram_coverage", "log_mean_seq_len")
COHERENT = 1.0
LEAST_SCALE = 1e-9
COLLINEAR = 0.85
#: Features proposed for the loop, in order (fixed values).
IN_LOOP = ("f02_top100_bigram_coverage", "f09_word_length_mean", "f15_suffix_entropy", "f16_heaps_beta", "f17_conditional_char_entropy", "f18_dislegomena_to_hapax", "f19_word_edge_entropy_asymmetry")


def profile_cosines(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("kind",)) -> DataFrame:
    """Cosine of sparse profiles (corpus, keys, gram, p) of every corpus of a with every one of b: dot products from the
    join on the gram, norms from the unjoined sides; 0 where a side is empty."""
    norm = lambda d, c, n: d.groupBy(F.col("corpus").alias(c), *keys).agg(F.sqrt(F.sum(F.col("p") * F.col("p"))).alias(n))
    left = a.select(F.col("corpus").alias("corpus_a"), *keys, "gram", F.col("p").alias("pa"))
    right = b.select(F.col("corpus").alias("corpus_b"), *keys, "gram", F.col("p").alias("pb"))
    dots = left.join(right, [*keys, "gram"]).groupBy("corpus_a", "corpus_b", *keys).agg(F.sum(F.col("pa") * F.col("pb")).alias("dot"))
    whole = norm(a, "corpus_a", "na").join(norm(b, "corpus_b", "nb"), list(keys)).join(dots, ["corpus_a", "corpus_b", *keys], "left")
    return whole.select("corpus_a", "corpus_b", *keys, F.when((F.col("na") > 0) & (F.col("nb") > 0), F.coalesce("dot", F.lit(0.0)) / (F.col("na") * F.col("nb"))).otherwise(0.0).alias("cosine"))


def _weights(weights: dict[str, float]) -> dict[str, float]:
    if any(w < 0 for w in weights.values()) or sum(weights.values()) <= 0:
        raise ValueError("weights must be nonnegative and not all zero")
    return {k: w / sum(weights.values()) for k, w in weights.items()}


def form_scores(cosines: DataFrame, weights: dict[str, float] = FORM_WEIGHTS) -> DataFrame:
    """Weighted cosine of the character profiles of each pair."""
    own = _weights(weights)
    by = {k: F.coalesce(F.max(F.when(F.col("kind") == k, F.col("cosine"))), F.lit(0.0)) for k in own}
    return cosines.groupBy("corpus_a", "corpus_b").agg(*(v.alias(k) for k, v in by.items()), reduce(lambda a, b: a + b, (own[k] * v for k, v in by.items())).alias("form"))


def token_scores(tokens: DataFrame, reference: DataFrame, weights: dict[str, float] = FORM_WEIGHTS) -> DataFrame:
    """Score of each distinct token against one reference's profiles (kind, gram, p). The reference is bounded by the
    profile sizes, so it goes to every task."""
    own = _weights(weights)
    distinct = tokens.select("token").distinct()
    grams = [distinct.select("token", F.lit(k).alias("kind"), F.explode(X.char_grams(F.col("token"), n)).alias("gram")) for k, n in (("c2", 2), ("c3", 3))]
    grams.append(distinct.filter(F.length("token") >= 3).select("token", F.lit("s3"), F.substring("token", -3, 3)))
    counted = reduce(lambda a, b: a.union(b), grams).groupBy("token", "kind", "gram").agg(F.count(F.lit(1)).cast("double").alias("n"))
    norms = reference.groupBy("kind").agg(F.sqrt(F.sum(F.col("p") * F.col("p"))).alias("ref_norm"))
    joined = counted.join(F.broadcast(reference.select("kind", "gram", F.col("p").alias("rp"))), ["kind", "gram"], "left")
    cos = joined.groupBy("token", "kind").agg(F.sum(F.col("n") * F.coalesce("rp", F.lit(0.0))).alias("dot"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm")).join(F.broadcast(norms), "kind")
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in own.items() for x in kv]), F.col("kind"))
    part = F.when(F.col("ref_norm") > 0, weight * F.col("dot") / (F.col("norm") * F.col("ref_norm"))).otherwise(0.0)
    scored = cos.groupBy("token").agg(F.sum(part).alias("score"))
    return distinct.join(scored, "token", "left").select("token", F.coalesce("score", F.lit(0.0)).alias("score"))


def transparency(corpora: DataFrame, reference: DataFrame, top: int = 50) -> DataFrame:
    """How readable each corpus is through the reference's eyes: scores of its most frequent tokens."""
    head = ranked(types(corpora), "token", top)
    scored = head.join(token_scores(head, reference), "token")
    weighted = F.sum(F.col("cnt") * F.col("score")) / F.sum("cnt")
    return scored.groupBy("corpus").agg(F.least(F.greatest(weighted, F.lit(0.0)), F.lit(1.0)).alias("score"), F.avg("score").alias("mean_token_score"), F.avg((F.col("score") >= 0.5).cast("double")).alias("high_score_share"), F.count(F.lit(1)).alias("top_n"))


def long_form(wide: DataFrame, columns: tuple[str, ...], key: str = "corpus") -> DataFrame:
    return wide.unpivot(key, list(columns), "feature", "value")


def z_scores(values: DataFrame, least: float = 0.0) -> DataFrame:
    """Values (corpus, feature, value) less the feature's mean, by its population deviation (1 where it is constant)."""
    over = W.partitionBy("feature")
    sd = F.stddev_pop("value").over(over)
    return values.withColumn("sd", sd).withColumn("mean", F.avg("value").over(over)).select("corpus", "feature", "value", ((F.col("value") - F.col("mean")) / F.when(F.col("sd") > least, F.col("sd")).otherwise(1.0)).alias("z"))


def vector_distances(z: DataFrame, value: str = "z") -> DataFrame:
    """Euclidean distance and cosine of every unordered pair of corpora."""
    a = z.select(F.col("corpus").alias("corpus_a"), "feature", F.col(value).alias("x"))
    b = z.select(F.col("corpus").alias("corpus_b"), "feature", F.col(value).alias("y"))
    pairs = a.join(b, "feature").filter("corpus_a < corpus_b")
    norm = F.sqrt(F.sum(F.col("x") * F.col("x"))) * F.sqrt(F.sum(F.col("y") * F.col("y")))
    return pairs.groupBy("corpus_a", "corpus_b").agg(F.sqrt(F.sum(F.pow(F.col("x") - F.col("y"), F.lit(2.0)))).alias("distance"), F.when(norm > 0, F.sum(F.col("x") * F.col("y")) / norm).otherwise(0.0).alias("cosine"))


def feature_contributions(z: DataFrame) -> DataFrame:
    """Share of each feature in the cosine of each pair."""
    a = z.select(F.col("corpus").alias("corpus_a"), "feature", F.col("z").alias("x"))
    b = z.select(F.col("corpus").alias("corpus_b"), "feature", F.col("z").alias("y"))
    pairs = a.join(b, "feature").filter("corpus_a < corpus_b")
    over = W.partitionBy("corpus_a", "corpus_b")
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(over)) * F.sqrt(F.sum(F.col("y") * F.col("y")).over(over))
    return pairs.select("corpus_a", "corpus_b", "feature", F.when(norm > 0, F.col("x") * F.col("y") / norm).otherwise(0.0).alias("contribution"))


def average_ranks(values: DataFrame) -> DataFrame:
    """Ranks within each feature, equal values sharing their mean rank."""
    order = W.partitionBy("feature").orderBy("value")
    ties = F.count(F.lit(1)).over(W.partitionBy("feature", "value"))
    return values.withColumn("rank", F.rank().over(order) + (ties - 1) / 2.0)


def spearman(values: DataFrame) -> DataFrame:
    """Rank correlation of every pair of features (a constant one has 0)."""
    r = average_ranks(values).select("corpus", "feature", "rank")
    a = r.select("corpus", F.col("feature").alias("feature_a"), F.col("rank").alias("ra"))
    b = r.select("corpus", F.col("feature").alias("feature_b"), F.col("rank").alias("rb"))
    rho = F.try_divide(F.covar_pop("ra", "rb"), F.stddev_pop("ra") * F.stddev_pop("rb"))
    return a.join(b, "corpus").groupBy("feature_a", "feature_b").agg(F.coalesce(rho, F.lit(0.0)).alias("rho"))


def select_tier(correlations: DataFrame, proposed: tuple[str, ...] = IN_LOOP, threshold: float = COLLINEAR) -> DataFrame:
    """Greedy choice in the proposed order: a feature goes if it correlates with one that stays. At most as many rows as
    the square of the proposed features reach the driver."""
    wanted = correlations.filter(F.col("feature_a").isin(*proposed) & F.col("feature_b").isin(*proposed))
    rho = {(r["feature_a"], r["feature_b"]): r["rho"] for r in wanted.collect()}
    kept, rows = [], []
    for i, name in enumerate(proposed):
        against = max(((abs(rho.get((name, k), 0.0)), k) for k in kept), default=(0.0, None))
        stays = against[0] < threshold
        rows.append((i, name, stays, None if stays else against[1]))
        kept += [name] * stays
    return correlations.sparkSession.createDataFrame(rows, "place int, feature string, retained boolean, conflict string")


def _scaled(a: list[Column], b: list[Column], scale: list[Column]) -> Column:
    return F.sqrt(reduce(lambda x, y: x + y, (F.pow((p - q) / F.greatest(s, F.lit(LEAST_SCALE)), F.lit(2.0)) for p, q, s in zip(a, b, scale))))


def coherence(vectors: DataFrame, null_vector: DataFrame, columns: tuple[str, ...] = STRUCT) -> DataFrame:
    """Each corpus against the centre of all of them and a null model's vector (one row), in units of their spread."""
    centre = vectors.agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.greatest(F.stddev_pop(c), F.lit(LEAST_SCALE)).alias(f"s_{c}") for c in columns))
    null = null_vector.select(*(F.col(c).alias(f"n_{c}") for c in columns))
    joined = vectors.crossJoin(F.broadcast(centre)).crossJoin(F.broadcast(null))  # one row each
    get = lambda prefix: [F.col(prefix + c) for c in columns]
    out = joined.select("corpus", _scaled(get(""), get("m_"), get("s_")).alias("distance_real"), _scaled(get(""), get("n_"), get("s_")).alias("distance_null"))
    margin = F.col("distance_null") - F.col("distance_real")
    return out.withColumn("margin", margin).withColumn("label", F.when(margin >= COHERENT, "coherent").when(margin >= 0, "borderline").otherwise("noise_like"))


def bank_distances(states: DataFrame, bank: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Every state with every reference of the bank (a fixed, small list): euclidean distance and reward."""
    named = bank.select(F.col("corpus").alias("reference"), *(F.col(c).alias(f"r_{c}") for c in columns))
    d = F.sqrt(reduce(lambda x, y: x + y, (F.pow(F.col(c) - F.col(f"r_{c}"), F.lit(2.0)) for c in columns)))
    return states.crossJoin(named).select(*states.columns, "reference", d.alias("distance"), (-5.0 * d).alias("reward"))


def nearest(distances: DataFrame, by: str, reference: str = "reference", value: str = "distance") -> DataFrame:
    """The nearest reference of each state, equal distances by name, without a sort."""
    return distances.groupBy(by).agg(F.min(F.struct(value, reference)).alias("x")).select(by, F.col(f"x.{reference}").alias(reference), F.col(f"x.{value}").alias(value))


def first_wins(winners: DataFrame, order: str, winner: str) -> DataFrame:
    """Where each reference was the nearest for the first time."""
    return winners.groupBy(winner).agg(F.min(order).alias(f"first_{order}"), F.count(F.lit(1)).alias("wins"))


def deduped_path(steps: DataFrame, order: str, value: str, by: str | None = None) -> DataFrame:
    """Steps whose value differs from the step before."""
    over = (W.partitionBy(by) if by else W.partitionBy(F.lit(0))).orderBy(order)
    return steps.withColumn("__before", F.lag(value).over(over)).filter(~F.col(value).eqNullSafe(F.col("__before")) | F.col("__before").isNull()).drop("__before")


def rank_shift(values: DataFrame) -> DataFrame:
    """values: corpus, d_small, d_large. Rank of each corpus by either, and the difference."""
    at = lambda c: F.row_number().over(W.partitionBy(F.lit(0)).orderBy(c, "corpus")) - 1
    return values.withColumn("rank_small", at("d_small")).withColumn("rank_large", at("d_large")).withColumn("shift", F.col("rank_large") - F.col("rank_small"))


def principal_variance(z: DataFrame) -> DataFrame:
    """component, share, cumulative: variance along the principal axes of the z-scores. The products of the features, their
    square in number, are summed in Spark; only these reach the driver."""
    import numpy as np

    a = z.select("corpus", F.col("feature").alias("f"), F.col("z").alias("x"))
    b = z.select("corpus", F.col("feature").alias("g"), F.col("z").alias("y"))
    rows = a.join(b, "corpus").groupBy("f", "g").agg(F.sum(F.col("x") * F.col("y")).alias("s")).collect()
    names = sorted({r["f"] for r in rows})
    at = {n: i for i, n in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for r in rows:
        m[at[r["f"]], at[r["g"]]] = r["s"]
    values = np.maximum(np.linalg.eigvalsh(m)[::-1], 0)
    share = values / values.sum() if values.sum() else values
    data = [(i + 1, float(x), float(y)) for i, (x, y) in enumerate(zip(share, np.cumsum(share)))]
    return z.sparkSession.createDataFrame(data, "component int, share double, cumulative double")


def missing_ids(wanted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Ids that are asked for but don't exist; a run with any is an error."""
    return wanted.select(key).distinct().join(known.select(key), key, "left_anti")


def run_deltas(left: DataFrame, right: DataFrame, keys: tuple[str, ...], metrics: tuple[str, ...]) -> DataFrame:
    """Metrics of one run table less those of another, for the runs in both."""
    other = right.select(*keys, *(F.col(m).alias(f"__{m}") for m in metrics))
    return left.join(other, list(keys)).select(*keys, *((F.col(m) - F.col(f"__{m}")).alias(f"delta_{m}") for m in metrics))


def scaled_by_bank(values: DataFrame, bank: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Long values (keys, feature, value) in units of a bank's spread (corpus, feature, value): generated states have no part in
    the means and deviations. A feature that is constant in the bank has the deviation 1."""
    scale = bank.groupBy("feature").agg(F.avg("value").alias("__mean"), F.stddev_pop("value").alias("__sd"))
    z = (F.col("value") - F.col("__mean")) / F.when(F.col("__sd") > LEAST_SCALE, F.col("__sd")).otherwise(1.0)
    return values.join(scale, "feature").select(*keys, "feature", z.alias("z"))


def control_distances(states: DataFrame, bank: DataFrame, controls: tuple[str, ...], keys: tuple[str, ...] = ("run", "state")) -> DataFrame:
    """keys, control, euclidean and cosine distance of each state (keys, feature, value) to each control of the bank (corpus,
    feature, value) over the features of both. A zero vector is at no cosine distance; features that are null count nowhere."""
    z = scaled_by_bank(states, bank, keys)
    named = scaled_by_bank(bank.filter(F.col("corpus").isin(*controls)), bank, ("corpus",)).select(F.col("corpus").alias("control"), "feature", F.col("z").alias("y"))
    norm = F.sqrt(F.sum(F.col("z") * F.col("z"))) * F.sqrt(F.sum(F.col("y") * F.col("y")))
    each = z.join(named, "feature").filter("z IS NOT NULL AND y IS NOT NULL").groupBy(*keys, "control")
    return each.agg(F.sqrt(F.sum(F.pow(F.col("z") - F.col("y"), F.lit(2.0)))).alias("euclidean"), F.when(norm > 0, 1 - F.sum(F.col("z") * F.col("y")) / norm).otherwise(0.0).alias("cosine"))


def control_movement(distances: DataFrame, measures: tuple[str, ...] = ("euclidean", "cosine"), run: tuple[str, ...] = ("run",)) -> DataFrame:
    """run, control and for each measure its value at the state `start`, at `final`, and the difference (below zero: the run came
    nearer to the control). A run that lacks an endpoint has nulls there."""
    at = lambda m, state: F.max(F.when(F.col("state") == state, F.col(m)))  # noqa: E731  one row a run, control and state
    ends = distances.groupBy(*run, "control").agg(*(at(m, s).alias(f"{s}_{m}") for m in measures for s in ("start", "final")))
    return ends.withColumns({f"delta_{m}": F.col(f"final_{m}") - F.col(f"start_{m}") for m in measures})


def nearest_controls(movement: DataFrame, measures: tuple[str, ...] = ("euclidean", "cosine"), run: tuple[str, ...] = ("run",), unless: tuple[str, ...] = ()) -> DataFrame:
    """For each run and measure the control that its final state is nearest to (equal distances by name) and the distance;
    `unless` names controls that don't compete."""
    rows = movement.filter(~F.col("control").isin(*unless)) if unless else movement
    best = lambda m: F.min(F.when(F.col(f"final_{m}").isNotNull(), F.struct(F.col(f"final_{m}").alias("d"), "control")))
    found = rows.groupBy(*run).agg(*(best(m).alias(m) for m in measures))
    return found.select(*run, *(x for m in measures for x in (F.col(f"{m}.control").alias(f"nearest_{m}"), F.col(f"{m}.d").alias(f"nearest_{m}_distance"))))
