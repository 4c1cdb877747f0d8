"""Co-occurrence within a window, PPMI, row norms, and where tokens stand in their sequences. Sparse throughout."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuscope.operators.corpus import arrow_limits, ranked, sequences, taken_apart, tokens, types

WINDOW = 2
VOCABULARY = 5000
LOW_FREQUENCY = 5
#: Words of all vocabularies that the driver and every task may hold, and numbers of pairs that a task gathers before it counts them.
MOST_KNOWN, HELD = 1 << 19, 4_000_000


def vocabulary(corpora: DataFrame, top: int = VOCABULARY) -> DataFrame:
    """corpus, token, cnt, rnk: tokens by falling count, equal counts by token."""
    return ranked(types(corpora), "token", top)


def cooccurrence(corpora: DataFrame, window: int = WINDOW, top: int = VOCABULARY) -> DataFrame:
    """corpus, row_tok, col_tok, cnt over in-vocabulary pairs; positions count whether or not what lies between is in the
    vocabulary. Pairs are taken from each sequence's array; only those of the vocabulary are shuffled."""
    n = F.size("tokens")

    def apart(k: int):
        at = F.sequence(F.lit(1), n - k)
        pair = lambda i: F.struct(F.element_at("tokens", i).alias("a"), F.element_at("tokens", i + k).alias("b"))
        return F.when(n > k, F.transform(at, pair)).otherwise(F.array().cast("array<struct<a:string,b:string>>"))

    pairs = taken_apart(sequences(corpora), F.concat(*(apart(k) for k in range(1, window + 1))), "corpus", name="p")
    known = vocabulary(corpora, top).select("corpus", "token").persist()  # at most `top` rows a corpus, for both ends
    pairs = pairs.select("corpus", "p.a", "p.b")
    for c in ("a", "b"):
        pairs = pairs.join(F.broadcast(known.withColumnRenamed("token", c)), ["corpus", c], "left_semi")
    counted = pairs.groupBy("corpus", "a", "b").agg(F.count(F.lit(1)).alias("cnt"))
    both = counted.select("corpus", F.col("a").alias("row_tok"), F.col("b").alias("col_tok"), "cnt").union(counted.select("corpus", F.col("b"), F.col("a"), "cnt"))
    return both.groupBy("corpus", "row_tok", "col_tok").agg(F.sum("cnt").alias("cnt"))


def known_pairs(rows: DataFrame, known: DataFrame, window: int = WINDOW) -> DataFrame | None:
    """corpus, row_tok, col_tok, cnt over pairs of known words (corpus, token), both ways round. rows: corpus, seqs, and d, what
    each pair counts (1, or -1 for what is taken away); pairs that sum to nothing are left out. Pairs are counted inside tasks over
    numbers for words, one way round. None where the vocabularies are too large to be held by every task."""
    if known.limit(MOST_KNOWN + 1).count() > MOST_KNOWN:
        return None
    words: dict[str, list[str]] = {}
    for r in known.filter("corpus IS NOT NULL").select(F.col("corpus").cast("string"), "token").collect():  # at most MOST_KNOWN
        words.setdefault(r["corpus"], []).append(r["token"])
    names = sorted(words)
    held = rows.sparkSession.sparkContext.broadcast([(c, pa.array(words[c], pa.string())) for c in names])
    base = max(map(len, words.values()), default=1)

    def keys(seqs: pa.ListArray, own: pa.Array) -> np.ndarray:
        code = pc.fill_null(pc.index_in(seqs.flatten(), value_set=own), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        of = np.repeat(np.arange(len(seqs)), pc.fill_null(pc.list_value_length(seqs), 0).to_numpy(zero_copy_only=False))
        found = []
        for k in range(1, window + 1):
            a, b = code[:-k], code[k:]
            both = (of[:-k] == of[k:]) & (a >= 0) & (b >= 0)
            found.append(np.minimum(a, b)[both] * base + np.maximum(a, b)[both])
        return np.concatenate(found)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[tuple[int, int], list[np.ndarray]] = {}
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def gather() -> None:
            for (i, d), part in parts.items():
                key, n = np.unique(np.concatenate(part), return_counts=True)
                if i in sums:
                    key, at = np.unique(np.concatenate([sums[i][0], key]), return_inverse=True)
                    total = np.zeros(len(key), np.int64)
                    np.add.at(total, at, np.concatenate([sums[i][1], n * d]))
                    sums[i] = key, total
                else:
                    sums[i] = key, n.astype(np.int64) * d
            parts.clear()

        def out() -> Iterator[pa.RecordBatch]:
            for i, (key, n) in sums.items():
                yield pa.RecordBatch.from_pydict({"corpus": pa.array(np.full(len(key), i, np.int32)), "key": pa.array(key), "cnt": pa.array(n)})
            sums.clear()

        size = 0
        for batch in batches:
            own, sign = batch.column("corpus"), batch.column("d")
            for i, (corpus, vocabulary) in enumerate(held.value):
                mine = pc.equal(own, pa.scalar(corpus, own.type))
                for d in pc.unique(sign.filter(mine)).to_pylist():
                    seqs = batch.column("seqs").filter(pc.and_(mine, pc.equal(sign, d))).flatten()
                    if len(seqs) and len(new := keys(seqs, vocabulary)):
                        parts.setdefault((i, d), []).append(new)
                        size += len(new)
            if size >= HELD:
                gather()
                size = 0
                if sum(len(k) for k, _ in sums.values()) >= HELD:
                    yield from out()
        gather()
        yield from out()

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, key = batch.column("corpus").to_numpy(), batch.column("key").to_numpy()
            for i in np.unique(number).tolist():
                corpus, vocabulary = held.value[i]
                a, b, n = key[number == i] // base, key[number == i] % base, batch.column("cnt").to_numpy()[number == i]
                for x, y, use in ((a, b, a >= 0), (b, a, a != b)):
                    m = np.where(a == b, 2 * n, n)[use]  # a word beside itself counts from both ends
                    if len(m):
                        yield pa.RecordBatch.from_pydict({"corpus": pa.array([corpus] * len(m), pa.string()), "row_tok": vocabulary.take(pa.array(x[use])), "col_tok": vocabulary.take(pa.array(y[use])), "cnt": pa.array(m)})

    arrow_limits(rows.sparkSession)
    counted = rows.select(F.col("corpus").cast("string").alias("corpus"), "seqs", F.col("d").cast("int").alias("d")).mapInArrow(count, "corpus int, key bigint, cnt bigint")
    counted = counted.groupBy("corpus", "key").agg(F.sum("cnt").alias("cnt")).filter("cnt <> 0")
    pairs = counted.mapInArrow(spelled, "corpus string, row_tok string, col_tok string, cnt bigint")
    return pairs.withColumn("corpus", F.col("corpus").cast(rows.schema["corpus"].dataType))


def written_cooccurrence(table: DataFrame, window: int = WINDOW, top: int = VOCABULARY) -> DataFrame:
    """What cooccurrence gives, of a written table of corpora (corpus, seqs), which is read twice."""
    found = known_pairs(table.select("corpus", "seqs", F.lit(1).alias("d")), vocabulary(table, top).select("corpus", "token"), window)
    return cooccurrence(table, window, top) if found is None else found


def ppmi(counts: DataFrame) -> DataFrame:
    """Adds w = max(0, log2(P(row, col) / (P(row) P(col)))); marginals include the diagonal."""
    counts = counts.persist()  # four readers; at most the vocabulary's square a corpus
    rows = counts.groupBy("corpus", "row_tok").agg(F.sum("cnt").alias("r"))
    cols = counts.groupBy("corpus", "col_tok").agg(F.sum("cnt").alias("s"))
    whole = counts.groupBy("corpus").agg(F.sum("cnt").alias("t"))
    joined = counts.join(F.broadcast(rows), ["corpus", "row_tok"]).join(F.broadcast(cols), ["corpus", "col_tok"]).join(F.broadcast(whole), "corpus")  # a row a word
    w = F.greatest(F.lit(0.0), F.log2(F.col("cnt").cast("double") * F.col("t") / (F.col("r").cast("double") * F.col("s"))))
    return joined.select("corpus", "row_tok", "col_tok", "cnt", w.alias("w"))


def normalised(weights: DataFrame, column: str = "w", zero_diagonal: bool = True) -> DataFrame:
    """Rows of length one; zero rows stay zero (and so have no entries). The diagonal goes first, if asked for."""
    kept = weights.filter("row_tok <> col_tok") if zero_diagonal else weights
    norm = F.sqrt(F.sum(F.pow(F.col(column), F.lit(2.0))).over(W.partitionBy("corpus", "row_tok")))
    return kept.withColumn("__norm", norm).select("corpus", "row_tok", "col_tok", F.when(F.col("__norm") > 0, F.col(column) / F.col("__norm")).otherwise(0.0).alias("w")).filter("w > 0")


def positional(corpora: DataFrame, top: int = VOCABULARY) -> DataFrame:
    """Six features of each vocabulary token, and whether it is rare."""
    x = F.when(F.col("n") > 1, F.col("pos") / (F.col("n") - 1)).otherwise(0.0)
    first, last = F.col("pos") == 0, (F.col("pos") == F.col("n") - 1) & (F.col("n") > 1)
    each = tokens(corpora).groupBy("corpus", "token").agg(
        F.count(F.lit(1)).alias("cnt"), F.avg(first.cast("double")).alias("initial_rate"), F.avg(last.cast("double")).alias("final_rate"),
        F.avg((~first & ~last).cast("double")).alias("medial_rate"), F.avg(x).alias("mean_norm_pos"), F.stddev_pop(x).alias("std_norm_pos"),
    )
    kept = ranked(each, "token", top)
    freq = F.log1p("cnt") / F.log1p(F.max("cnt").over(W.partitionBy("corpus")))
    return kept.withColumn("freq_norm", freq).withColumn("low_frequency", F.col("cnt") < LOW_FREQUENCY).drop("rnk")


def symmetric(counts: DataFrame) -> DataFrame:
    """Pairs whose mirror differs: none in a valid table. Both sides of a pair meet in one group."""
    forth = F.col("row_tok") <= F.col("col_tok")
    one = counts.select("corpus", F.least("row_tok", "col_tok").alias("a"), F.greatest("row_tok", "col_tok").alias("b"), forth.alias("forth"), "cnt")
    sides = one.groupBy("corpus", "a", "b").agg(F.max(F.when(F.col("forth"), F.col("cnt"))).alias("x"), F.max(F.when(~F.col("forth"), F.col("cnt"))).alias("y"))
    side = lambda r, c, v, o: F.struct(F.col(r).alias("row_tok"), F.col(c).alias("col_tok"), F.col(v).alias("cnt"), F.col(o).alias("other"))
    differ = sides.filter("a <> b AND NOT (x <=> y)")
    return differ.select("corpus", F.explode(F.array(side("a", "b", "x", "y"), side("b", "a", "y", "x"))).alias("s")).select("corpus", "s.*")


def anchor_aligned(current: DataFrame, reference: DataFrame, anchor: DataFrame, value: str = "w") -> DataFrame:
    """The reference's entries on the anchor's tokens beside the current ones; missing is 0. All without corpus:
    (row_tok, col_tok, value); anchor: token."""
    cells = []
    for name, side in (("cur", current), ("ref", reference)):
        kept = side.join(anchor.select(F.col("token").alias("row_tok")), "row_tok", "left_semi").join(anchor.select(F.col("token").alias("col_tok")), "col_tok", "left_semi")
        cells.append(kept.select("row_tok", "col_tok", F.col(value).alias(name)))
    both = reduce(lambda a, b: a.join(b, ["row_tok", "col_tok"], "full"), cells)
    return both.select("row_tok", "col_tok", F.coalesce("cur", F.lit(0.0)).alias("cur"), F.coalesce("ref", F.lit(0.0)).alias("ref")).withColumn("distance", F.abs(F.col("ref") - F.col("cur")))


def top_adjustments(aligned: DataFrame, component: str, k: int = 512) -> DataFrame:
    """The k entries with the largest distance, equal ones by row and column; a heap in each task, no sort."""
    order = (F.col("distance").desc(), "row_tok", "col_tok")
    return aligned.filter("distance > 0").select(F.lit(component).alias("component"), "row_tok", "col_tok", (F.col("ref") - F.col("cur")).alias("delta"), "distance").orderBy(*order).limit(k)


def hotspots(adjustments: DataFrame, top: int = 48) -> DataFrame:
    """Tokens by the adjustments they take part in: rows in full, columns by half."""
    parts = adjustments.select(F.col("row_tok").alias("token"), F.col("distance").alias("weight")).union(adjustments.filter("component = 'cooccurrence'").select("col_tok", F.col("distance") * 0.5))
    return parts.groupBy("token").agg(F.sum("weight").alias("weight")).orderBy(F.col("weight").desc(), "token").limit(top)


def guided(hot: DataFrame, counts: DataFrame, shortest: int = 2, longest: int = 12) -> DataFrame:
    """Hotspots that a rewrite may take up: tokens of the corpus, within length bounds, with their counts."""
    return hot.join(counts.filter("cnt > 0").select("token", "cnt"), "token").filter(F.length("token").between(shortest, longest))


def frontier(adjustments: DataFrame, most: int = 24) -> DataFrame:
    """A set of adjustments of greatest total distance in which no row and no column occurs twice; at most `most`. The input is a
    top-k list, so one task takes it."""
    import numpy as np
    import pyarrow as pa

    from corpuscope.operators.families import assignment

    best = adjustments.groupBy("row_tok", "component", "col_tok").agg(F.max("distance").alias("distance"))

    def run(table: pa.Table) -> pa.Table:
        rows, cols, d = table.column("row_tok").to_pylist(), [*zip(table.column("component").to_pylist(), table.column("col_tok").to_pylist())], table.column("distance").to_pylist()
        r, c = sorted(set(rows)), sorted(set(cols))
        at, bt = {x: i for i, x in enumerate(r)}, {x: i for i, x in enumerate(c)}
        score = np.zeros((len(r), len(c)))
        for x, y, v in zip(rows, cols, d):
            score[at[x], bt[y]] = v
        match = [(float(score[i, j]), r[i], *c[j]) for i, j in enumerate(assignment(score.max() - score)) if j >= 0 and score[i, j] > 0]
        match.sort(key=lambda x: (-x[0], *x[1:]))
        match = match[:most]
        return pa.table({"row_tok": pa.array([x[1] for x in match], pa.string()), "component": pa.array([x[2] for x in match], pa.string()), "col_tok": pa.array([x[3] for x in match], pa.string()), "distance": pa.array([x[0] for x in match], pa.float64())})

    return best.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(run, "row_tok string, component string, col_tok string, distance double")
