"""Features of many variants of one state, on its first tokens or on all of them, from what each variant changes.

The state is counted once; its aggregates can be retracted: numbers of types that occur once or twice, sums over types and
tokens, power sums of sequence lengths, first grams, and for the growth of the vocabulary how often each type stands between
two of the twelve points, which gives its first occurrence as the least such part. A variant adds and takes away what its
changed sequences hold. A rewrite that changes lengths moves all later sequences, but only those near a point or near the end
of the budget change what they add; these are found by their places and looked at again.

A variant that changes much of a large state is counted anew instead, once and by its frequent grams (`frequent`).
"""

from __future__ import annotations

import math
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuscope.functions import text as X
from corpuscope.operators import features as FE
from corpuscope.operators import profiles as P
from corpuscope.operators import rewrite as RW
from corpuscope.operators import state as S
from corpuscope.operators.corpus import BUCKET, dropped, running_before, stored
from corpuscope.operators.profiles import CHAR_TOP, WORD_TOP

TOP = {"w1": 1000, "w2": WORD_TOP, "w3": WORD_TOP, "s3": CHAR_TOP["s3"]}
POWERS = range(5)
#: What types add to the features besides their number.
SUMS = ("hapax", "dis", "length", "square", "vowels", "consonants")
#: Share of the state's tokens in changed sequences from which counting a variant anew costs less than its changes, if the state
#: has so many tokens that this matters and no budget.
RECOUNT_SHARE, RECOUNT_TOKENS = 0.25, 1 << 17


def points(total: int) -> list[int]:
    """Numbers of tokens at which the vocabulary is looked at; the last is all."""
    low = max(50, total // (2 * FE.HEAPS_POINTS))
    step = (total - low) / (FE.HEAPS_POINTS - 1)
    return [*(math.floor(low + i * step) for i in range(FE.HEAPS_POINTS - 1)), total]


def placed(base: DataFrame) -> DataFrame:
    """KEY, tokens, and start, the number of tokens before the sequence in the order of documents."""
    sized = base.select(*RW.KEY, "tokens", F.size("tokens").cast("long").alias("size"))
    docs = running_before(sized.groupBy("corpus", "doc_id").agg(F.sum("size").alias("n")), "corpus", "doc_id", "n", "first")
    inner = F.sum("size").over(W.partitionBy("corpus", "doc_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    rows = sized.withColumn("inner", inner).join(docs.select("corpus", "doc_id", "first"), ["corpus", "doc_id"])
    return rows.select(*RW.KEY, "tokens", (F.col("first") + F.col("inner")).alias("start"))


def _cut(tokens: Column, start: Column, budget: int | None) -> Column:
    return tokens if budget is None else F.slice(tokens, F.lit(1), F.least(F.size(tokens).cast("long"), F.greatest(F.lit(budget) - start, F.lit(0))).cast("int"))


def _held(start: Column, budget: int | None) -> Column:
    return F.lit(True) if budget is None else start < budget


def _part(place: Column, at: Column) -> Column:
    """How many points lie at a place or before it."""
    return F.size(F.filter(at, lambda p: p <= place))


def _apart(token: Column) -> Column:
    """Last three characters (s3), neighbouring ones (i2), first (e1) and last one (e2)."""
    tagged = lambda grams, kind: F.transform(grams, lambda g: F.struct(F.lit(kind).alias("kind"), g.alias("gram")))
    end = F.when(F.length(token) >= 3, F.array(F.substring(token, -3, 3))).otherwise(F.array().cast("array<string>"))
    return F.concat(tagged(end, "s3"), tagged(X.inner_pairs(token), "i2"), tagged(F.array(F.substring(token, 1, 1)), "e1"), tagged(F.array(F.substring(token, -1, 1)), "e2"))


def _sums(token: Column, cnt: Column) -> list[Column]:
    vowels, rest = FE.letters_of(token)
    size = F.length(token).cast("long")
    return [(cnt == 1).cast("long"), (cnt == 2).cast("long"), size * cnt, size * size * cnt, vowels * cnt, rest * cnt]


def _moments(slot: int, sums: list[int]) -> tuple:
    """Moments of sequence lengths from their exact power sums."""
    n, raw = sums[0], [Fraction(s, sums[0]) for s in sums]
    m = raw[1]
    var = raw[2] - m**2
    third, fourth = raw[3] - 3 * m * raw[2] + 2 * m**3, raw[4] - 4 * m * raw[3] + 6 * m**2 * raw[2] - 3 * m**4
    skew, over = (float(third) / float(var) ** 1.5, float(fourth / var**2) - 3) if var > 0 else (0.0, 0.0)
    return slot, n, sums[1], float(m), float(var), skew, over


def affected(rows: DataFrame, changed: DataFrame, frame: DataFrame, at: list[int], reach: int, budget: int | None) -> DataFrame:
    """slot, old, new, start, shift of the sequences that a variant changes, moves over a point or moves over the budget's end.
    rows: `placed`; frame: slot and its points; reach: how far a sequence moves at most against a point."""
    ends = rows if budget is None else rows.filter(F.col("start") < budget + reach)
    mine = changed.join(ends.select(*RW.KEY, "start"), list(RW.KEY)).select("slot", *RW.KEY, "old", "new", "start")
    if reach:
        close = reduce(lambda a, b: a | b, ((F.col("start") - reach <= p) & (F.col("start") + F.size("tokens") + reach >= p) for p in at))
        near = ends.filter(close).crossJoin(F.broadcast(frame.select("slot"))).join(changed.select("slot", *RW.KEY), ["slot", *RW.KEY], "left_anti")
        mine = mine.unionByName(near.select("slot", *RW.KEY, F.col("tokens").alias("old"), F.col("tokens").alias("new"), "start"))
    # Places are told apart from those of empty sequences, which stand before the next one and don't change.
    order = mine.withColumn("place", 2 * F.col("start") + (F.size("old") > 0).cast("int")).withColumn("longer", (F.size("new") - F.size("old")).cast("long"))
    return running_before(order, "slot", "place", "longer", "shift", max(BUCKET, at[-1] // 1024)).select("slot", "old", "new", "start", "shift")


def recounted(base: DataFrame, changed: DataFrame, slot: int) -> DataFrame:
    """slot and FEATURES of one variant, from its whole corpus."""
    rows = base.select(*RW.KEY, "tokens", F.lit(0).alias("turn")).unionByName(changed.filter(F.col("slot") == slot).select(*RW.KEY, F.col("new").alias("tokens"), F.lit(1).alias("turn")))
    own = rows.repartition("corpus", "doc_id").groupBy(*RW.KEY).agg(F.max_by("tokens", "turn").alias("tokens"))  # one shuffle for both
    seqs = F.transform(F.array_sort(F.collect_list(F.struct("seq", "tokens"))), lambda x: x["tokens"])
    table = stored(own.groupBy("corpus", "doc_id").agg(seqs.alias("seqs")).select(F.lit(str(slot)).alias("corpus"), "doc_id", "seqs"))
    out = FE.feature_vector(table, written=True).select(F.lit(slot).alias("slot"), *FE.FEATURES)
    result = base.sparkSession.createDataFrame(out.collect(), out.schema)  # one row
    dropped(table)
    return result


def features(base: DataFrame, changed: DataFrame, slots: list[int], budget: int | None = None) -> DataFrame:
    """slot and FEATURES of every variant of a state on its first tokens (budget; all without one).

    base: the sequences (KEY, tokens) of one corpus; changed: slot, KEY, old, new of what variants change; a slot without
    changes is the state itself. Raises where a variant has fewer tokens than the budget. The result has one row a variant, made
    from rows that were collected."""
    total = budget is None and base.agg(F.sum(F.size("tokens").cast("long"))).first()[0] or 0
    much = []
    if total >= RECOUNT_TOKENS:
        touched = changed.groupBy("slot").agg(F.sum(F.size("old").cast("long")).alias("n")).collect()  # one row a variant
        much = [r["slot"] for r in touched if r["slot"] in slots and r["n"] > RECOUNT_SHARE * total]
    few = [s for s in slots if s not in much]
    parts = [recounted(base, changed, s) for s in much]
    if few or not slots:
        parts.append(_by_changes(base, changed.filter(~F.col("slot").isin(much)) if much else changed, few, budget))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _by_changes(base: DataFrame, changed: DataFrame, slots: list[int], budget: int | None = None) -> DataFrame:
    """features() from what the variants change."""
    spark = base.sparkSession
    rows = stored(placed(base))
    total = rows.agg(F.sum(F.size("tokens").cast("long"))).first()[0] or 0
    longer = (F.size("new") - F.size("old")).cast("long")
    moved_by = {r["slot"]: r for r in changed.groupBy("slot").agg(F.sum(longer).alias("d"), F.sum(F.abs(longer)).alias("most")).collect()}  # one row a variant
    totals = {s: total + (moved_by[s]["d"] if s in moved_by else 0) for s in slots}
    if budget is not None and min(totals.values()) < budget:
        raise ValueError("a variant has fewer tokens than the budget")
    at = points(budget or total)
    of = {s: points(budget or t) for s, t in totals.items()}
    reach = max((r["most"] for r in moved_by.values()), default=0)
    reach += max(abs(a - b) for ps in of.values() for a, b in zip(ps, at))
    frame = spark.createDataFrame([(s, budget or totals[s], of[s]) for s in slots], "slot int, total long, points array<long>")
    every = F.broadcast(frame.select("slot"))

    # The state, counted once.
    held = rows.filter(_held(F.col("start"), budget)).withColumn("tokens", _cut(F.col("tokens"), F.col("start"), budget))
    fixed = F.array(*(F.lit(p).cast("long") for p in at))
    first = stored(held.select("start", F.posexplode("tokens").alias("i", "token")).groupBy("token", _part(F.col("start") + F.col("i"), fixed).alias("part")).agg(F.count(F.lit(1)).alias("cnt")))
    types = first.groupBy("token").agg(F.sum("cnt").alias("cnt"))
    apart = types.select("cnt", F.explode(_apart(F.col("token"))).alias("x")).groupBy("x.kind", "x.gram").agg(F.sum("cnt").alias("cnt"))
    single = stored(types.select(F.lit("w1").alias("kind"), F.col("token").alias("gram"), "cnt").union(apart))
    grams = lambda n: P.gram_counts(held.select(F.lit("").alias("corpus"), F.array("tokens").alias("seqs")), n).select(F.lit(f"w{n}").alias("kind"), "gram", "cnt")
    twos, threes = stored(grams(2)), stored(grams(3))  # one after the other, so the files of only one shuffle are there at once
    counts = single.union(twos).union(threes)
    power = lambda tokens, k: reduce(lambda a, _: a * F.size(tokens).cast("decimal(10,0)"), range(k), F.lit(1).cast("decimal(1,0)")).cast("decimal(38,0)")

    # What each variant changes.
    seen = affected(rows, changed, frame, at, reach, budget).withColumn("now", F.col("start") + F.col("shift"))
    was, now = _held(F.col("start"), budget), _held(F.col("now"), budget)
    seen = stored(seen.select("slot", _cut(F.col("old"), F.col("start"), budget).alias("old"), _cut(F.col("new"), F.col("now"), budget).alias("new"), "start", "now", was.alias("was"), now.alias("is")))
    deltas = stored(S.word_changes(seen.filter("old <> new").select("slot", "old", "new")))
    each = deltas.filter("kind = 'w1'").select("slot", "d", F.explode(_apart(F.col("gram"))).alias("x"))
    changes = stored(deltas.select("slot", "kind", "gram", "d").union(each.groupBy("slot", "x.kind", "x.gram").agg(F.sum("d").alias("d")).filter("d <> 0")))
    signed = lambda c, start, ps, d: F.transform(c, lambda t, i: F.struct(t.alias("token"), _part(F.col(start) + i, ps).alias("part"), F.lit(d).alias("d")))
    parts = seen.join(F.broadcast(frame), "slot").select("slot", F.explode(F.concat(signed("old", "start", fixed, -1), signed("new", "now", F.col("points"), 1))).alias("x"))
    moved = stored(parts.groupBy("slot", "x.token", "x.part").agg(F.sum("x.d").alias("d")).filter("d <> 0"))

    # Sequence lengths.
    own = held.agg(*(F.coalesce(F.sum(power("tokens", k)), F.lit(0)).alias(f"p{k}") for k in POWERS)).first()
    gain = lambda k: F.sum(F.when(F.col("is"), power("new", k)).otherwise(0) - F.when(F.col("was"), power("old", k)).otherwise(0)).alias(f"p{k}")
    won = {r["slot"]: r for r in seen.groupBy("slot").agg(*map(gain, POWERS)).collect()}  # one row a variant
    lengths = [_moments(s, [int(own[f"p{k}"]) + (int(won[s][f"p{k}"]) if s in won else 0) for k in POWERS]) for s in slots] if own["p0"] else []
    moments = spark.createDataFrame(lengths, "slot int, sequence_count long, total_tokens long, mean_seq_length double, variance double, skewness double, excess_kurtosis double")

    # Types.
    word = counts.filter("kind = 'w1'").select(F.col("gram").alias("token"), "cnt")
    sums = word.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in zip(SUMS, _sums(F.col("token"), F.col("cnt")))))
    differ = changes.filter("kind = 'w1'").select("slot", F.col("gram").alias("token"), "d").join(word, "token", "left").fillna(0, ["cnt"])
    extra = differ.groupBy("slot").agg(*(F.sum(b - a).alias(f"d_{n}") for n, a, b in zip(SUMS, _sums(F.col("token"), F.col("cnt")), _sums(F.col("token"), F.col("cnt") + F.col("d")))))
    sizes, kept = S.variants(counts, changes, slots, TOP)
    known = sizes.crossJoin(F.broadcast(sums)).join(extra, "slot", "left").select("slot", "t", "u", *((F.col(n) + F.coalesce(f"d_{n}", F.lit(0))).alias(n) for n in SUMS))
    mean = F.col("length") / F.col("t")
    stats = known.select("slot", F.col("u").alias("unique_types"), "hapax", "dis", "vowels", "consonants", mean.alias("word_length_mean"), (F.col("square") / F.col("t") - mean * mean).alias("word_length_variance"))

    # First grams.
    kept = stored(kept)
    of_kind = lambda k, value, most=None: F.sum(F.when((F.col("kind") == k) & (F.lit(True) if most is None else F.col("rnk") <= most), value))
    entropy = lambda k: -of_kind(k, F.col("p") * F.log("p"))
    shares = kept.groupBy("slot").agg(
        *(of_kind(k, F.col("p"), most).alias(f"{tag}_{most}") for k, tag in (("w2", "bigram"), ("w3", "trigram")) for most in (100, 500)),
        *(entropy(k).alias(f"{tag}_entropy") for k, tag in (("w2", "bigram"), ("w3", "trigram"), ("s3", "suffix"))), of_kind("w1", F.col("cnt")).alias("head"),
    )
    cover = shares.join(sizes, "slot").withColumn("unigram_coverage", F.col("head") / F.col("t")).drop("t", "u", "head")
    slope = FE.zipf_of(kept.filter("kind = 'w1'"), by="slot")

    # Characters: as many rows a variant as the alphabet has pairs.
    pairs = counts.filter("kind in ('i2', 'e1', 'e2')").crossJoin(every).select("slot", "kind", "gram", "cnt").union(changes.filter("kind in ('i2', 'e1', 'e2')").select("slot", "kind", "gram", "d"))
    pairs = stored(pairs.groupBy("slot", "kind", "gram").agg(F.sum("cnt").alias("c")).filter("c > 0"))
    inner = FE.pair_entropy(pairs.filter("kind = 'i2'").select("slot", F.col("gram").alias("pair"), "c"), "slot")
    edges = FE.edge_entropy(pairs.filter("kind <> 'i2'").select("slot", F.when(F.col("kind") == "e1", -1.0).otherwise(1.0).alias("sign"), F.col("gram").alias("ch"), "c"), "slot")

    # Growth of the vocabulary.
    span = range(FE.HEAPS_POINTS)
    grown = first.groupBy("token").agg(F.min("part").alias("f")).agg(*(F.count(F.when(F.col("f") <= i, 1)).alias(f"b{i}") for i in span))
    both = moved.select("slot", "token").distinct().join(first, "token").select("slot", "token", "part", "cnt", F.lit(0).cast("long").alias("d")).unionByName(moved.select("slot", "token", "part", F.lit(0).cast("long").alias("cnt"), "d"))
    both = both.groupBy("slot", "token", "part").agg(F.sum("cnt").alias("a"), (F.sum("cnt") + F.sum("d")).alias("b"))
    both = both.groupBy("slot", "token").agg(*(F.coalesce(F.min(F.when(F.col(c) > 0, F.col("part"))), F.lit(len(span))).alias(f"{c}f") for c in ("a", "b")))
    steps = both.groupBy("slot").agg(*(F.sum((F.col("bf") <= i).cast("int") - (F.col("af") <= i).cast("int")).alias(f"d{i}") for i in span))
    vocabulary = frame.select("slot").crossJoin(F.broadcast(grown)).join(steps, "slot", "left").select("slot", *((F.col(f"b{i}") + F.coalesce(f"d{i}", F.lit(0))).alias(f"v{i}") for i in span))
    growth = FE.heaps_of(frame, vocabulary, "slot")

    out = FE.from_parts(moments, [stats, cover, slope, inner, edges, growth], "slot")
    result = spark.createDataFrame(out.collect(), out.schema)  # one row a variant
    dropped(rows, first, single, twos, threes, seen, deltas, changes, moved, kept, pairs)
    return result
