"""Bigram models kept sparse, mixing, null models and sampling."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuscope.operators.cooc import vocabulary
from corpuscope.operators.corpus import sequences


#: Different pairs that a task holds before it hands on their counts.
HELD_PAIRS = 1_000_000


def _added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Different codes and the sums of their counts."""
    codes, at = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
    return codes, np.bincount(at, np.concatenate([n for _, n in held]), len(codes)).astype(np.int64)


def transitions(corpora: DataFrame, top: int = 5000, known: DataFrame | None = None) -> DataFrame:
    """corpus, a, b, cnt, p over in-vocabulary tokens; tokens out of the vocabulary are left out before pairs are
    formed. Tokens without a successor have no rows: their distribution is uniform by definition. Every task counts its own pairs, so
    no token is shuffled; the vocabulary (known, `top` tokens a corpus) goes to all of them."""
    table = (vocabulary(corpora, top) if known is None else known).select("corpus", "token").filter("corpus IS NOT NULL").toArrow()
    names: dict[str, list[str]] = {}
    for corpus, token in zip(table.column("corpus").to_pylist(), table.column("token").to_pylist()):
        names.setdefault(corpus, []).append(token)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def handed(corpus: str) -> pa.RecordBatch:
            codes, counts = held.pop(corpus)[0]
            own = pa.array(names[corpus], pa.string())
            return pa.RecordBatch.from_pydict({"corpus": pa.array([corpus] * len(codes), pa.string()), "a": own.take(pa.array(codes // len(own))), "b": own.take(pa.array(codes % len(own))), "cnt": pa.array(counts)})

        for batch in batches:
            for corpus in pc.unique(batch.column("corpus")).to_pylist():
                if corpus not in names:
                    continue
                seqs = batch.filter(pc.equal(batch.column("corpus"), corpus)).column("seqs").flatten()
                words = seqs.flatten()
                place = pc.fill_null(pc.index_in(words, pa.array(names[corpus], words.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                owner = np.repeat(np.arange(len(seqs)), pc.list_value_length(seqs).to_numpy(zero_copy_only=False))[place >= 0]
                place = place[place >= 0]
                pairs = (place[:-1] * len(names[corpus]) + place[1:])[owner[:-1] == owner[1:]]
                mine = held.setdefault(corpus, [])
                mine.append(np.unique(pairs, return_counts=True))
                if sum(len(c) for c, _ in mine) > HELD_PAIRS:
                    mine[:] = [_added(mine)]
                    if len(mine[0][0]) > HELD_PAIRS // 2:
                        yield handed(corpus)
        for corpus in list(held):
            held[corpus] = [_added(held[corpus])]
            yield handed(corpus)

    each = corpora.select(F.col("corpus").cast("string").alias("corpus"), "seqs").mapInArrow(run, "corpus string, a string, b string, cnt bigint")
    counted = each.groupBy("corpus", "a", "b").agg(F.sum("cnt").alias("cnt"))
    return counted.withColumn("p", F.col("cnt") / F.sum("cnt").over(W.partitionBy("corpus", "a")))


def contexts(corpora: DataFrame, n: int = 3) -> DataFrame:
    """corpus, context (the n - 1 tokens before, joined), next, cnt."""
    size = F.size("tokens")
    at = F.sequence(F.lit(1), size - (n - 1))
    each = F.when(size >= n, F.transform(at, lambda i: F.struct(F.array_join(F.slice("tokens", i, F.lit(n - 1)), " ").alias("context"), F.element_at("tokens", i + (n - 1)).alias("next"))))
    return sequences(corpora).select("corpus", F.explode(each).alias("x")).groupBy("corpus", "x.context", "x.next").agg(F.count(F.lit(1)).alias("cnt"))


def vocabulary_sizes(corpora: DataFrame, top: int = 5000, known: DataFrame | None = None) -> DataFrame:
    return (vocabulary(corpora, top) if known is None else known).groupBy("corpus").agg(F.count(F.lit(1)).alias("v"))


def row_entropy(model: DataFrame, sizes: DataFrame) -> DataFrame:
    """Mean entropy of the model's rows in nats; rows without entries are uniform."""
    rows = model.groupBy("corpus", "a").agg((-F.sum(F.col("p") * F.log("p"))).alias("h"))
    sums = rows.groupBy("corpus").agg(F.sum("h").alias("h"), F.count(F.lit(1)).alias("k"))
    return sizes.join(sums, "corpus", "left").select("corpus", "v", ((F.coalesce("h", F.lit(0.0)) + (F.col("v") - F.coalesce("k", F.lit(0))) * F.log("v")) / F.col("v")).alias("row_entropy"))


def mixed_uniform(model: DataFrame, sizes: DataFrame, alpha: float, steps: int = 1) -> DataFrame:
    """steps times (1 - alpha) T + alpha / V, in closed form on the entries that are there; every other cell of such a row
    holds `rest`."""
    keep = (1 - alpha) ** steps
    return model.join(sizes, "corpus").select("corpus", "a", "b", (F.lit(keep) * F.col("p") + (1 - keep) / F.col("v")).alias("p"), ((1 - keep) / F.col("v")).alias("rest"))


def mixed_toward(source: DataFrame, target: DataFrame, alpha: float) -> DataFrame:
    """(1 - alpha) S + alpha T on the source's rows (a, b, p): target rows reduced to the source's tokens and scaled to
    one; rows that the target lacks stay as they are."""
    tokens_of = source.select("a").union(source.select("b")).distinct()
    aligned = target.join(tokens_of.select("a").distinct(), "a", "left_semi").join(tokens_of.select(F.col("a").alias("b")), "b", "left_semi")
    scaled = aligned.withColumn("q", F.col("p") / F.sum("p").over(W.partitionBy("a"))).select("a", "b", "q")
    has = scaled.select("a").distinct().withColumn("has", F.lit(True))
    both = source.select("a", "b", "p").join(scaled, ["a", "b"], "full").join(has, "a", "left").join(source.select("a").distinct(), "a", "left_semi")
    p, q = F.coalesce("p", F.lit(0.0)), F.coalesce("q", F.lit(0.0))
    return both.select("a", "b", F.when(F.col("has"), (1 - alpha) * p + alpha * q).otherwise(p).alias("p"))


def hash_draw(seed: int, *parts: Column) -> Column:
    """Whole number below 2**32 from a digest; the same in any engine."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]), 256), 1, 8), 16, 10).cast("long")


def uniform_null(spark: SparkSession, n: int = 10_000, length: int = 10, size: int = 500, seed: int = 0) -> DataFrame:
    """corpus, doc_id, seqs: n sequences of uniformly drawn tokens."""
    token = lambda i: F.concat(F.lit("t"), F.pmod(hash_draw(seed, F.col("id"), i), F.lit(size)).cast("string"))
    seq = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), token)
    return spark.range(n).select(F.lit("null").alias("corpus"), F.col("id").alias("doc_id"), F.array(seq).alias("seqs"))


#: Cells of a model that are broadcast at most; a larger one is walked by joins, with the same draws.
MOST_CELLS = 4_000_000
#: Steps of a walk between two checkpoints, and digits of a token's hash that put it into a bucket.
STEPS, DIGITS = 8, 4


def _unit(seed: int, *parts: object) -> float:
    """hash_draw in a task, as a share of one."""
    return int(hashlib.sha256(":".join(map(str, (seed, *parts))).encode()).hexdigest()[:8], 16) / 2**32


def _share(seed: int, *parts: Column) -> Column:
    return hash_draw(seed, *parts) / F.lit(float(2**32))


def _bucket(token: str) -> str:
    return hashlib.sha256(token.encode()).hexdigest()[:DIGITS]


def _observed(lengths: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Distinct lengths and their cumulated counts: as many rows as the longest sequence has tokens at most."""
    observed = lengths.groupBy("length").count().orderBy("length").toArrow()
    if not observed.num_rows:
        return np.array([0]), np.array([1.0])  # without lengths, sequences are empty
    return observed.column("length").to_numpy(), np.cumsum(observed.column("count").to_numpy().astype(float))


def _walks(model: DataFrame, most: int = MOST_CELLS):
    """The model as names, in the order of bucket and token, and rows of successors with their cumulated shares, broadcast; None if it
    has more than `most` cells."""
    table = model.filter("p > 0").select("a", "b", "p").limit(most + 1).toArrow()
    if table.num_rows > most:
        return None
    names = sorted({*table.column("a").to_pylist(), *table.column("b").to_pylist()}, key=lambda t: (_bucket(t), t))
    number = {t: i for i, t in enumerate(names)}
    rows: dict[int, list[tuple[str, float]]] = {}
    for a, b, p in zip(*(table.column(c).to_pylist() for c in "abp")):
        rows.setdefault(number[a], []).append((b, p))
    walk = {}
    for a, cells in rows.items():
        cells.sort()
        summed = np.cumsum([p for _, p in cells])
        walk[a] = (np.array([number[b] for b, _ in cells]), summed / summed[-1])
    return model.sparkSession.sparkContext.broadcast((names, walk))


def sampled(model: DataFrame, lengths: DataFrame, n: int, seed: int, shards: int = 8, uniform: float = 0.0, most: int = MOST_CELLS) -> DataFrame:
    """doc_id, tokens: sequences from a bigram model (a, b, p), lengths as observed (a column of lengths); a token without a
    successor goes on uniformly, and any token does so with probability `uniform`. What a sequence holds follows from its number, the
    seed and the model. A model of at most `most` cells is broadcast; a larger one gives the same sequences by joins.
    An empty model, or no lengths, gives empty sequences; cells whose p is null or not above zero count as absent."""
    shared = _walks(model, most)
    if shared is None:
        return walked(model, lengths, n, seed, uniform)
    sizes, weight = _observed(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, walk = shared.value
        for batch in batches:
            out = []
            for i in batch.column("id").to_pylist():
                size = int(sizes[np.searchsorted(weight, _unit(seed, i, "n") * weight[-1], side="right")])
                at, seq = int(_unit(seed, i, "s") * len(names)), []
                for step in range(size if names else 0):
                    seq.append(names[at])
                    row = None if uniform and _unit(seed, i, f"u{step}") < uniform else walk.get(at)
                    u = _unit(seed, i, step)
                    at = int(u * len(names)) if row is None else int(row[0][np.searchsorted(row[1], u, side="right")])
                out.append(seq)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("id"), "tokens": pa.array(out, pa.list_(pa.string()))})

    return model.sparkSession.range(n, numPartitions=shards).mapInArrow(run, "doc_id bigint, tokens array<string>")


def guide_table(model: DataFrame) -> DataFrame:
    """uniform, a, slot, lo, hi, b, slots: where a step from a goes. The k successors of a token share [0, 1) by their
    probabilities, in order of the token; [0, 1) is also cut into k equal slots, and a successor stands in each slot that it reaches
    into, so at most 2k rows. A draw u looks in the slot floor(uk) and takes the row with lo <= u < hi. Uniform steps (uniform is true, a
    is empty) have one slot a token, its number by bucket and token. slots counts those of b, 0 for a token without successors."""
    cells = model.filter("p > 0").select("a", "b", "p")
    row = W.partitionBy("a").orderBy("b")
    top = F.sum("p").over(row.rowsBetween(W.unboundedPreceding, W.currentRow))
    summed = cells.withColumn("top", top).withColumn("k", F.count(F.lit(1)).over(W.partitionBy("a"))).withColumn("whole", F.max("top").over(W.partitionBy("a")))
    shares = summed.select("a", "b", "k", (F.coalesce(F.lag("top").over(row), F.lit(0.0)) / F.col("whole")).alias("lo"), (F.col("top") / F.col("whole")).alias("hi"))
    slot = lambda c: F.least(F.floor(F.col(c) * F.col("k")), F.col("k") - 1)
    steps = shares.select(F.lit(False).alias("uniform"), "a", F.explode(F.sequence(slot("lo"), slot("hi"))).alias("slot"), "lo", "hi", "b")
    tokens_of = cells.select(F.col("a").alias("b")).union(cells.select("b")).distinct().withColumn("bucket", F.substring(F.sha2("b", 256), 1, DIGITS))
    # Buckets are at most 16 to the power of DIGITS, so their offsets may be summed in one task.
    before = W.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = tokens_of.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    placed = tokens_of.withColumn("i", F.row_number().over(W.partitionBy("bucket").orderBy("b")) - 1).join(offsets, "bucket")
    anywhere = placed.select(F.lit(True).alias("uniform"), F.lit("").alias("a"), (F.col("offset") + F.col("i")).alias("slot"), F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"), "b")
    slots = cells.groupBy(F.col("a").alias("b")).agg(F.count(F.lit(1)).alias("slots"))
    return steps.union(anywhere).join(slots, "b", "left").withColumn("slots", F.coalesce("slots", F.lit(0)))


def walked(model: DataFrame, lengths: DataFrame, n: int, seed: int, uniform: float = 0.0) -> DataFrame:
    """`sampled` for models of any size: each step joins the walks that go on to the guide table by token and slot, so nothing of the
    model reaches the driver and a frequent token's rows are spread over the tasks by slot. As many joins as the longest walk
    has tokens; every STEPS of them lineage is cut in the checkpoint folder and walks that have ended are set aside."""
    spark = model.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        raise ValueError("set spark.checkpoint.dir: walks by joins cut their lineage there")
    sizes, weight = _observed(lengths)
    guide = guide_table(model).repartition("uniform", "a", "slot").checkpoint()
    v = guide.filter("uniform").count()
    i = F.col("doc_id")
    place = F.size(F.filter(F.array(*(F.lit(float(w)) for w in weight)), lambda w: w <= _share(seed, i, F.lit("n")) * float(weight[-1])))
    size = F.element_at(F.array(*(F.lit(int(x)) for x in sizes)), place + 1)
    start = spark.range(n).withColumnRenamed("id", "doc_id").select("doc_id", size.alias("size"), F.array().cast("array<string>").alias("tokens"), F.lit("").alias("at"), F.lit(0).cast("long").alias("slots"))

    def step(walks: DataFrame, number: int) -> DataFrame:
        u = _share(seed, i, F.lit("s") if number == 0 else F.lit(number - 1))
        free = F.col("slots") == 0
        if uniform and number:
            free = free | (_share(seed, i, F.lit(f"u{number - 1}")) < uniform)
        to = F.floor(u * F.when(free, F.lit(v)).otherwise(F.col("slots")))
        # A walk that has ended looks for a slot that isn't there, each for one of its own.
        slot = F.when(F.col("size") > number, to).otherwise(-1 - i)
        drawn = walks.select("doc_id", "size", "tokens", "at", F.col("slots").alias("held"), free.alias("uniform"), F.when(free, "").otherwise(F.col("at")).alias("a"), slot.alias("slot"), u.alias("u"))
        within = (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))
        where = reduce(lambda x, y: x & y, (drawn[c] == guide[c] for c in ("uniform", "a", "slot")))
        found = drawn.join(guide, where & within, "left")
        return found.select("doc_id", "size", F.when(F.col("b").isNull(), F.col("tokens")).otherwise(F.array_append("tokens", F.col("b"))).alias("tokens"), F.coalesce("b", "at").alias("at"), F.coalesce("slots", "held").alias("slots"))

    longest = int(max(sizes)) if v else 0
    ended, walks = [start.filter(F.col("size") == 0) if v else start], start.filter("size > 0")
    for number in range(longest):
        walks = step(walks, number)
        if number % STEPS == STEPS - 1 or number == longest - 1:
            walks = walks.checkpoint()
            ended.append(walks.filter(F.size("tokens") == F.col("size")))
            walks = walks.filter(F.size("tokens") < F.col("size"))
    return reduce(DataFrame.unionByName, ended).select("doc_id", "tokens")


#: What a model's zero entries count as when its logarithms are perturbed.
LEAST_P = 1e-10


def sampled_perturbed(model: DataFrame, lengths: DataFrame, n: int, seed: int, tried: dict[int, tuple[int, ...]], noise: float) -> DataFrame:
    """corpus (the candidate's number), doc_id, tokens: n sequences of each candidate in one job. A candidate is a list of
    seeds: for each, Gaussian noise is added to the logarithms of all rows, which are then scaled to one again. Rows are
    dense, so a task makes only those that its sequences visit."""
    shared = _walks(model)
    if shared is None:
        raise ValueError(f"a model of more than {MOST_CELLS} cells can't be perturbed: noise makes its rows dense")
    sizes, weight = _observed(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, walk = shared.value
        made: dict[tuple[int, int], np.ndarray] = {}

        def row(candidate: int, at: int) -> np.ndarray:
            if (candidate, at) not in made:
                p = np.full(len(names), 0.0 if at in walk else 1.0 / len(names))
                if at in walk:
                    p[walk[at][0]] = np.diff(walk[at][1], prepend=0.0)
                for s in tried[candidate]:
                    x = np.log(p + LEAST_P) + noise * np.random.default_rng([s, at]).standard_normal(len(names))
                    p = np.exp(x - x.max())
                    p /= p.sum()
                made[candidate, at] = np.cumsum(p)
            return made[candidate, at]

        for batch in batches:
            made.clear()
            who, out = [], []
            for i in batch.column("id").to_pylist():
                candidate, rng = i // n, np.random.default_rng([seed, i])
                size = int(sizes[np.searchsorted(weight, rng.random() * weight[-1], side="right")])
                at, seq = int(rng.integers(len(names))), []
                for _ in range(size):
                    seq.append(names[at])
                    steps = row(candidate, at)
                    at = int(min(np.searchsorted(steps, rng.random() * steps[-1], side="right"), len(names) - 1))
                who.append(candidate)
                out.append(seq)
            yield pa.RecordBatch.from_pydict({"corpus": pa.array(who, pa.int32()), "doc_id": batch.column("id"), "tokens": pa.array(out, pa.list_(pa.string()))})

    return model.sparkSession.range(n * len(tried), numPartitions=len(tried)).mapInArrow(run, "corpus int, doc_id bigint, tokens array<string>")


def trained_markov(table: DataFrame, n: int, length: int, seed: int) -> DataFrame:
    """doc_id, tokens: n sequences of a fixed length that follow a context table (context, next, cnt). Each step joins the
    sequences to their contexts, so the table may have any size; a context that wasn't seen goes on as one drawn by hash.
    Starts are contexts of least hash, taken again from the first where there are fewer than n."""
    cell = lambda: F.array_sort(F.collect_list(F.struct("next", "cnt")))  # noqa: E731  at most the words that follow one context
    follow = table.groupBy("context").agg(cell().alias("follow"), F.sum("cnt").alias("total"))
    starts = table.select("context").distinct().orderBy(F.xxhash64("context", F.lit(seed)), "context").limit(n)
    found = [r["context"].split(" ") for r in starts.collect()]  # n rows at most
    if not found:
        return table.sparkSession.createDataFrame([], "doc_id long, tokens array<string>")
    state = table.sparkSession.createDataFrame([(i, found[i % len(found)]) for i in range(n)], "doc_id long, tokens array<string>")
    order = len(found[0])
    for step in range(order, length):
        key = F.array_join(F.slice("tokens", F.lit(-order), F.lit(order)), " ")
        joined = state.withColumn("context", key).join(follow, "context", "left")
        draw = F.pmod(hash_draw(seed, F.col("doc_id"), F.lit(step)), F.col("total"))
        walk = F.aggregate("follow", F.struct(draw.alias("left"), F.lit(None).cast("string").alias("word")), lambda s, x: F.when(s["word"].isNotNull(), s).otherwise(F.struct((s["left"] - x["cnt"]).alias("left"), F.when(s["left"] < x["cnt"], x["next"]).alias("word"))))
        other = F.element_at(F.array(*(F.lit(c[-1]) for c in found[:200])), (F.pmod(hash_draw(seed, F.col("doc_id"), F.lit(-step)), F.lit(min(len(found), 200))) + 1).cast("int"))
        state = joined.select("doc_id", F.array_append("tokens", F.coalesce(walk["word"], other)).alias("tokens"))
    return state.select("doc_id", F.slice("tokens", 1, length).alias("tokens"))
