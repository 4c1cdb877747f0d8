"""Trajectories, areas, panel contrasts and their exact permutation references, plateaus."""

from __future__ import annotations

from itertools import combinations
from math import comb

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TINY = 1e-12


#: Numbers of one range of a run.
RANGE = 100_000


def deciles(trajectory: DataFrame, keys: tuple[str, ...], step: str = "step", score: str = "score", value: str = "value", feature: str = "feature") -> DataFrame:
    """keys, feature, decile (0 to 10), value: each feature where progress first crosses a tenth of the way from the first
    score to the last, linearly between steps. Series whose last score isn't above the first give no rows."""
    over = W.partitionBy(*keys, feature).orderBy(step)
    whole = over.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first, last = F.first(score).over(whole), F.last(score).over(whole)
    progressed = trajectory.withColumn("progress", F.when(last > first, (F.col(score) - first) / (last - first))).filter("progress is not null")
    steps = progressed.withColumn("p0", F.lag("progress").over(over)).withColumn("v0", F.lag(value).over(over))
    ends = progressed.groupBy(*keys, feature).agg(F.min_by(value, step).alias("a"), F.max_by(value, step).alias("b"))
    marks = F.explode(F.array(*(F.lit(k / 10) for k in range(1, 10)))).alias("mark")
    crossing = steps.filter("p0 is not null").select(*keys, feature, step, "progress", "p0", "v0", F.col(value).alias("v1"), marks).filter("p0 < mark and mark <= progress")
    at = crossing.groupBy(*keys, feature, "mark").agg(F.min_by(F.struct("progress", "p0", "v0", "v1"), step).alias("x"))
    inner = at.select(*keys, feature, F.round(F.col("mark") * 10).cast("int").alias("decile"), (F.col("x.v0") + (F.col("mark") - F.col("x.p0")) / (F.col("x.progress") - F.col("x.p0")) * (F.col("x.v1") - F.col("x.v0"))).alias("value"))
    outer = ends.select(*keys, feature, F.lit(0).alias("decile"), F.col("a").alias("value")).union(ends.select(*keys, feature, F.lit(10), F.col("b")))
    return inner.union(outer)


def pair_curves(points: DataFrame, item: str, keys: tuple[str, ...], at: str = "decile") -> DataFrame:
    """left, right, keys, at, distance and normalised distance of every unordered pair of items."""
    a = points.select(F.col(item).alias("left"), *keys, at, "feature", F.col("value").alias("x"))
    b = points.select(F.col(item).alias("right"), *keys, at, "feature", F.col("value").alias("y"))
    d = a.join(b, [*keys, at, "feature"]).filter("left < right").groupBy("left", "right", *keys, at).agg(F.sqrt(F.sum(F.pow(F.col("x") - F.col("y"), F.lit(2.0)))).alias("distance"))
    start = F.first("distance").over(W.partitionBy("left", "right", *keys).orderBy(at).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return d.withColumn("normalised", F.when(start > 0, F.col("distance") / start))


def area(curves: DataFrame, by: tuple[str, ...], x: str, y: str, scale: float = 1.0, name: str = "auc") -> DataFrame:
    """Trapezoid area of y over x times scale."""
    over = W.partitionBy(*by).orderBy(x)
    part = (F.col(y) + F.lag(y).over(over)) / 2 * (F.col(x) - F.lag(x).over(over)) * scale
    return curves.withColumn("__part", part).groupBy(*by).agg(F.sum("__part").alias(name))


def checked_pairs(pairs: DataFrame, items: tuple[str, ...], seeds: tuple[int, ...]) -> DataFrame:
    """Pairs (seed, left, right, auc) in order; raises where one is missing, doubled, unknown or without a finite value."""
    spark = pairs.sparkSession
    named = pairs.select("seed", F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right"), "auc")
    wanted = spark.createDataFrame([(s, *sorted(p)) for s in seeds for p in combinations(items, 2)], "seed long, left string, right string")
    counted = named.groupBy("seed", "left", "right").agg(F.count(F.lit(1)).alias("n"), F.min("auc").alias("low"))
    odd = wanted.join(counted, ["seed", "left", "right"], "full").join(wanted.withColumn("known", F.lit(True)), ["seed", "left", "right"], "left")
    if odd.filter("n is null or n > 1 or known is null or not (low >= 0) or isnan(low)").limit(1).count():
        raise ValueError("pairs must be complete, single, known and finite")
    return named


def panel_contrast(pairs: DataFrame, focal: tuple[str, ...]) -> DataFrame:
    """Per seed the mean of the other pairs less that of the pairs within the focal group."""
    within = F.col("left").isin(*focal) & F.col("right").isin(*focal)
    rows = pairs.groupBy("seed").agg(F.avg(F.when(within, F.col("auc"))).alias("focal_mean"), F.avg(F.when(~within, F.col("auc"))).alias("other_mean"))
    return rows.withColumn("effect", F.col("other_mean") - F.col("focal_mean")).withColumn("replicates", F.col("effect") > TINY)


def label_allocations(pairs: DataFrame, items: tuple[str, ...], size: int) -> DataFrame:
    """Effect of every way to call `size` of the items focal, as a bit mask over the sorted items."""
    order = sorted(items)
    masks = pairs.sparkSession.range(1 << len(order)).select(F.col("id").alias("mask")).filter(F.bit_count("mask") == size)
    number = pairs.sparkSession.createDataFrame(list(enumerate(order)), "bit int, item string")
    coded = pairs.join(F.broadcast(number.select(F.col("item").alias("left"), F.expr("shiftleft(1L, bit)").alias("lb"))), "left").join(F.broadcast(number.select(F.col("item").alias("right"), F.expr("shiftleft(1L, bit)").alias("rb"))), "right")
    both = F.col("lb").bitwiseOR(F.col("rb"))
    each = coded.crossJoin(F.broadcast(masks)).withColumn("within", F.col("mask").bitwiseAND(both) == both)
    seeds = each.groupBy("mask", "seed").agg((F.avg(F.when(~F.col("within"), F.col("auc"))) - F.avg(F.when(F.col("within"), F.col("auc")))).alias("delta"))
    return seeds.groupBy("mask").agg(F.avg("delta").alias("effect"), F.min((F.col("delta") > TINY).cast("int")).cast("boolean").alias("replicates"))


def allocation_tail(allocations: DataFrame, observed_mask: int) -> DataFrame:
    """How many allocations reach the observed effect."""
    seen = allocations.filter(F.col("mask") == observed_mask).select(F.col("effect").alias("observed"))
    limit = F.col("observed") - TINY * F.greatest(F.lit(1.0), F.abs(F.col("observed")))
    return allocations.crossJoin(F.broadcast(seen)).groupBy("observed").agg(F.count(F.when(F.col("effect") >= limit, 1)).alias("extreme"), F.count(F.lit(1)).alias("allocations")).withColumn("upper_tail", F.col("extreme") / F.col("allocations"))


def leave_one_out(pairs: DataFrame, items: tuple[str, ...], focal: tuple[str, ...]) -> DataFrame:
    """The mean contrast without each of the items."""
    omitted = pairs.sparkSession.createDataFrame([(x,) for x in items], "omitted string")
    left = pairs.crossJoin(F.broadcast(omitted)).filter("left <> omitted and right <> omitted")
    within = F.col("left").isin(*focal) & F.col("right").isin(*focal)
    seeds = left.groupBy("omitted", "seed").agg((F.avg(F.when(~within, F.col("auc"))) - F.avg(F.when(within, F.col("auc")))).alias("effect"))
    return seeds.groupBy("omitted").agg(F.avg("effect").alias("effect"), F.min((F.col("effect") > TINY).cast("int")).cast("boolean").alias("replicates"))


def _rank_sum_share(doubled: list[int], size: int) -> float:
    """Share of the subsets of that size whose sum is at most that of the first `size` ranks."""
    limit = sum(doubled[:size])
    ways = [{0: 1}] + [{} for _ in range(size)]
    for i, rank in enumerate(doubled):
        for k in range(min(i + 1, size), 0, -1):
            for total, n in ways[k - 1].items():
                if total + rank <= limit:
                    ways[k][total + rank] = ways[k].get(total + rank, 0) + n
    return sum(ways[size].values()) / comb(len(doubled), size)


def mann_whitney(values: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """values: by.., side (0 or 1), value; small groups. Exact one-sided share of relabelings with a rank sum as small as that
    of side 0, equal values sharing their mean rank."""
    keys = [F.lit(0).alias("one")] if not by else [F.col(c) for c in by]
    over = W.partitionBy(*(by or ["one"]))
    rows = values.select(*keys, "side", "value")
    doubled = 2 * F.rank().over(over.orderBy("value")) + F.count(F.lit(1)).over(W.partitionBy(*(by or ["one"]), "value")) - 1
    ranks = rows.withColumn("r", doubled.cast("int")).groupBy(*(by or ["one"])).agg(F.transform(F.array_sort(F.collect_list(F.struct("side", "r"))), lambda x: x["r"]).alias("ranks"), F.count(F.when(F.col("side") == 0, 1)).alias("n0"))

    def run(batches):
        for b in batches:
            shares = [_rank_sum_share(r, n) if 0 < n < len(r) else None for r, n in zip(b.column("ranks").to_pylist(), b.column("n0").to_pylist())]
            us = [sum(r[:n]) / 2 - n * (n + 1) / 2 for r, n in zip(b.column("ranks").to_pylist(), b.column("n0").to_pylist())]
            names = [n for n in b.schema.names if n not in ("ranks", "n0")]
            yield pa.RecordBatch.from_pydict({n: b.column(n) for n in names} | {"u": pa.array(us, pa.float64()), "p_less": pa.array(shares, pa.float64())})

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranks.schema.fields if f.name not in ("ranks", "n0"))
    out = ranks.mapInArrow(run, f"{head}, u double, p_less double")
    return out if by else out.drop("one")


def arm_differences(curves: DataFrame, keys: tuple[str, ...], at: str, arms: tuple[str, str] = ("full", "disabled")) -> DataFrame:
    """Value of the first arm less that of the second."""
    wide = curves.groupBy(*keys, at).pivot("arm", list(arms)).agg(F.first("value"))
    return wide.withColumn("difference", F.col(arms[0]) - F.col(arms[1]))


def plateaus(blocks: DataFrame, order: str, metrics: tuple[str, ...], window: int = 10, epsilon: float = 1e-3, by: str | None = None) -> DataFrame:
    """Per block the best of the last `window` blocks and of all before them, and whether none of the metrics improved. Never
    with fewer than window + 1 blocks."""
    over = (W.partitionBy(by) if by else W.partitionBy(F.lit(0))).orderBy(order)
    recent, prior = over.rowsBetween(-(window - 1), 0), over.rowsBetween(W.unboundedPreceding, -window)
    out, flat = blocks, F.row_number().over(over) > window
    for m in metrics:
        out = out.withColumn(f"recent_{m}", F.max(m).over(recent)).withColumn(f"prior_{m}", F.max(m).over(prior))
        flat = flat & ~F.coalesce(F.col(f"recent_{m}") > F.coalesce(F.col(f"prior_{m}"), F.lit(float("-inf"))) + epsilon, F.lit(False))
    return out.withColumn("plateau", flat)


def stability(stages: DataFrame, order: str, value: str, epsilon: float, by: str) -> DataFrame:
    """Change since the stage before, and whether it is small enough to stop."""
    delta = F.col(value) - F.lag(value).over(W.partitionBy(by).orderBy(order))
    return stages.withColumn("delta", delta).withColumn("stable", F.coalesce(F.abs(delta) < epsilon, F.lit(False)))


def stagnation(events: DataFrame, order: str, accepted: str, by: str) -> DataFrame:
    """Cumulative accepted count and proposals since the last accepted one. The order is a whole number: its ranges are
    counted first, so a window holds one range of one run, and only the ranges' totals are summed along the run."""
    placed = events.withColumn("__range", F.floor(F.col(order) / RANGE)).withColumn("__won", F.coalesce(F.col(accepted).cast("long"), F.lit(0)))
    inside = W.partitionBy(by, "__range").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    rows = placed.withColumn("__wins", F.sum("__won").over(inside)).withColumn("__row", F.row_number().over(inside))
    rows = rows.withColumn("__last", F.max(F.when(F.col("__won") == 1, F.col("__row"))).over(inside))
    totals = rows.groupBy(by, "__range").agg(F.count(F.lit(1)).alias("n"), F.sum("__won").alias("wins"), F.max(F.when(F.col("__won") == 1, F.col("__row"))).alias("last"))
    before = W.partitionBy(by).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    sums = totals.withColumn("end", F.coalesce(F.sum("n").over(before), F.lit(0)))
    sums = sums.select(F.col(by).alias("__by"), F.col("__range").alias("__r"), F.coalesce(F.sum("wins").over(before), F.lit(0)).alias("__before"), (F.col("end") - F.coalesce(F.max(F.col("end") + F.col("last")).over(before), F.lit(0))).alias("__open"))
    joined = rows.join(sums, rows[by].eqNullSafe(sums["__by"]) & (rows["__range"] == sums["__r"]))
    out = joined.withColumn("accepted_so_far", F.col("__before") + F.col("__wins")).withColumn("since_accept", F.when(F.col("__last").isNotNull(), F.col("__row") - F.col("__last")).otherwise(F.col("__row") + F.col("__open")))
    return out.drop("__range", "__won", "__wins", "__row", "__last", "__by", "__r", "__before", "__open")


def block_bests(blocks: DataFrame, order: str, metric: str, by: str | None = None) -> DataFrame:
    """The best of a metric so far and its last value that isn't null, at every block of a run."""
    over = (W.partitionBy(by) if by else W.partitionBy(F.lit(0))).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return blocks.withColumn(f"best_{metric}", F.max(metric).over(over)).withColumn(f"last_{metric}", F.last(metric, ignorenulls=True).over(over))


def joint_hit(summaries: DataFrame, targets: dict[str, float]) -> DataFrame:
    """Adds joint_hit: whether every metric has reached its target; a missing one hasn't."""
    hit = F.lit(True)
    for name, least in targets.items():
        hit = hit & F.coalesce(F.col(name) >= least, F.lit(False))
    return summaries.withColumn("joint_hit", hit)


def seed_audit(summaries: DataFrame, requested: str = "requested_seed", engine: str = "engine_seed") -> DataFrame:
    """Adds seeds_match: null where either seed is missing."""
    return summaries.withColumn("seeds_match", F.col(requested) == F.col(engine))


#: Scenarios of the allocation test: nothing but language effects, closer pairs inside the focal group, and focal languages
#: that all differ from the rest for another reason (fixed values: log effects of pair and of language).
SCENARIOS = {"exchangeable_null": (0.0, 0.0), "within_group_alternative": (-0.9, 0.0), "correlated_nuisance": (0.0, -0.65)}


def simulated_panels(spark, items: tuple[str, ...], focal: tuple[str, ...], trials: int, seed: int, seeds: int = 3) -> DataFrame:
    """scenario, trial, seed, left, right, auc: pairs from log effects of languages (deviation 0.2, the same for all seeds)
    and of language and seed (0.03). Normal draws follow from hashes."""

    def normal(*parts) -> Column:
        unit = lambda tag: (F.pmod(F.xxhash64(F.lit(seed), F.lit(tag), *parts), F.lit(1 << 40)) + 0.5) / (1 << 40)
        return F.sqrt(-2 * F.log(unit("r"))) * F.cos(2 * F.pi() * unit("a"))

    table = spark.createDataFrame([(s, p, n) for s, (p, n) in SCENARIOS.items()], "scenario string, pair double, node double")
    pairs = spark.createDataFrame([(a, b) for i, a in enumerate(sorted(items)) for b in sorted(items)[i + 1 :]], "left string, right string")
    grid = spark.range(trials).withColumnRenamed("id", "trial").crossJoin(F.broadcast(table)).crossJoin(F.broadcast(pairs)).crossJoin(F.broadcast(spark.range(seeds).withColumnRenamed("id", "seed")))
    own = lambda c: 0.2 * normal(F.col("scenario"), F.col("trial"), F.col(c)) + 0.03 * normal(F.col("scenario"), F.col("trial"), F.col(c), F.col("seed")) + F.when(F.col(c).isin(*focal), F.col("node")).otherwise(0.0)
    inside = F.col("left").isin(*focal) & F.col("right").isin(*focal)
    return grid.select("scenario", "trial", "seed", "left", "right", F.exp(own("left") + own("right") + F.when(inside, F.col("pair")).otherwise(0.0)).alias("auc"))


def simulated_tails(panels: DataFrame, items: tuple[str, ...], focal: tuple[str, ...]) -> DataFrame:
    """scenario, trial, effect and tail, the share of all label allocations with an effect as large; each trial on its own."""
    names = sorted(items)
    masks = [m for m in range(1 << len(names)) if m.bit_count() == len(focal)]
    table = panels.sparkSession.createDataFrame([(m, [n for i, n in enumerate(names) if m >> i & 1]) for m in masks], "mask int, chosen array<string>")
    mean = panels.groupBy("scenario", "trial", "left", "right").agg(F.avg("auc").alias("auc"))
    marked = mean.crossJoin(F.broadcast(table)).withColumn("inside", F.array_contains("chosen", F.col("left")) & F.array_contains("chosen", F.col("right")))
    effects = marked.groupBy("scenario", "trial", "mask").agg((F.avg(F.when(~F.col("inside"), F.col("auc"))) - F.avg(F.when(F.col("inside"), F.col("auc")))).alias("effect"))
    own = sum(1 << names.index(x) for x in focal)
    observed = effects.filter(F.col("mask") == own).select("scenario", "trial", F.col("effect").alias("observed"))
    slack = 1e-12 * F.greatest(F.lit(1.0), F.abs("observed"))
    return effects.join(observed, ["scenario", "trial"]).groupBy("scenario", "trial").agg(F.first("observed").alias("effect"), F.avg((F.col("effect") >= F.col("observed") - slack).cast("double")).alias("tail"))
