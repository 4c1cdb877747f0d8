"""Co-occurrence kept up to date: what changed sequences add and remove, instead of counting the corpus again.

The state is a table of raw pairs, so a new word needs no new axes; the vocabulary is chosen when weights are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.operators.cooc import VOCABULARY, WINDOW, known_pairs
from corpuscope.operators.corpus import ranked, settled, taken_apart

#: Share of changed sequences from which a rebuild costs less than the changes.
REBUILD_SHARE = 0.5
_NO_PAIRS = "array<struct<a:string,b:string>>"


def _pairs(tokens: Column, window: int) -> Column:
    n = F.size(tokens)

    def apart(k: int) -> Column:
        both = lambda i: F.array(F.struct(F.element_at(tokens, i).alias("a"), F.element_at(tokens, i + k).alias("b")), F.struct(F.element_at(tokens, i + k).alias("a"), F.element_at(tokens, i).alias("b")))
        return F.when(n > k, F.flatten(F.transform(F.sequence(F.lit(1), n - k), both))).otherwise(F.array().cast(_NO_PAIRS))

    return F.concat(*(apart(k) for k in range(1, window + 1)))


def raw_pairs(seqs: DataFrame, window: int = WINDOW) -> DataFrame:
    """corpus, row_tok, col_tok, cnt over all words of sequences (corpus, tokens)."""
    return _each_pair(seqs, window).groupBy("corpus", "row_tok", "col_tok").agg(F.count(F.lit(1)).alias("cnt"))


def _each_pair(seqs: DataFrame, window: int) -> DataFrame:
    each = taken_apart(seqs, _pairs(F.col("tokens"), window), "corpus", name="p")
    return each.select("corpus", F.col("p.a").alias("row_tok"), F.col("p.b").alias("col_tok"))


def pair_deltas(changes: DataFrame, window: int = WINDOW) -> DataFrame:
    """changes: corpus, old, new (either may be null). corpus, row_tok, col_tok, delta, without zeros."""
    none = F.array().cast("array<string>")
    side = lambda c, d: F.transform(_pairs(F.coalesce(F.col(c), none), window), lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), F.lit(d).alias("d")))
    each = changes.select("corpus", F.explode(F.concat(side("old", -1), side("new", 1))).alias("p"))
    return each.groupBy("corpus", F.col("p.a").alias("row_tok"), F.col("p.b").alias("col_tok")).agg(F.sum("p.d").alias("delta")).filter("delta <> 0")


def mode(changes: DataFrame, sequences: int, anchor: DataFrame) -> str:
    """What an update has to do: noop, incremental, anchor_extend (words that the anchor lacks) or full_rebuild."""
    changed = changes.count()
    if not changed:
        return "noop"
    if changed > REBUILD_SHARE * sequences:
        return "full_rebuild"
    fresh = changes.select("corpus", F.explode("new").alias("token")).distinct().join(anchor.select("corpus", "token"), ["corpus", "token"], "left_anti")
    return "anchor_extend" if fresh.limit(1).count() else "incremental"


def updated(pairs: DataFrame, changes: DataFrame, window: int = WINDOW) -> DataFrame:
    """The pairs after the changes; what falls to nothing goes."""
    return _sum_of(pairs, pair_deltas(changes, window))


def _sum_of(pairs: DataFrame, deltas: DataFrame) -> DataFrame:
    both = pairs.select("corpus", "row_tok", "col_tok", "cnt").union(deltas.select("corpus", "row_tok", "col_tok", "delta"))
    return both.groupBy("corpus", "row_tok", "col_tok").agg(F.sum("cnt").alias("cnt")).filter("cnt > 0")


def refreshed(pairs: DataFrame, new: DataFrame, changes: DataFrame, sequences: int, anchor: DataFrame, window: int = WINDOW) -> tuple[str, DataFrame]:
    """The mode and the pairs after a step; new: all sequences after it."""
    what = mode(changes, sequences, anchor)
    if what == "noop":
        return what, pairs
    return what, raw_pairs(new, window) if what == "full_rebuild" else updated(pairs, changes, window)


def in_vocabulary(pairs: DataFrame, counts: DataFrame, top: int = VOCABULARY) -> DataFrame:
    """Pairs whose words are both among the most frequent ones of their corpus (counts: corpus, token, cnt)."""
    return _both_known(pairs, ranked(counts, "token", top).select("corpus", "token"))


def _both_known(pairs: DataFrame, known: DataFrame) -> DataFrame:
    for c in ("row_tok", "col_tok"):
        pairs = pairs.join(F.broadcast(known.withColumnRenamed("token", c)), ["corpus", c], "left_semi")  # `top` rows a corpus
    return pairs


def updated_in_vocabulary(seqs: DataFrame, changes: DataFrame, counts: DataFrame, window: int = WINDOW, top: int = VOCABULARY) -> DataFrame:
    """in_vocabulary(updated(raw_pairs(seqs), changes), counts) where nothing else needs the other pairs: those are left out
    before they are shuffled."""
    known = settled(ranked(counts, "token", top).select("corpus", "token"))  # two readers
    none = F.array().cast("array<string>")
    part = lambda rows, c, d: rows.select("corpus", F.array(F.coalesce(F.col(c), none)).alias("seqs"), F.lit(d).alias("d"))
    rows = part(seqs, "tokens", 1).union(part(changes, "old", -1)).union(part(changes, "new", 1))
    if (found := known_pairs(rows, known, window)) is not None:
        return found.filter("cnt > 0")
    pairs = _both_known(_each_pair(seqs, window), known).groupBy("corpus", "row_tok", "col_tok").agg(F.count(F.lit(1)).alias("cnt"))
    return _sum_of(pairs, _both_known(pair_deltas(changes, window), known))
