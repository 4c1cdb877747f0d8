"""Profiles of word bigrams and trigrams without a shuffle of every gram.

No gram occurs more often than a word of it, and no trigram more often than a pair of neighbours in it. So bigrams are counted
among each corpus's most frequent words only, and trigrams among its most frequent pairs. What was left out occurs at most as
often as the first word or pair left out. If the last gram that a profile keeps occurs more often than that, the profile is
that of all grams, exactly; a corpus for which this doesn't hold (flat counts) has all its grams counted. Counts are made
inside tasks over numbers for words; only distinct numbers are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.functions import text as X
from corpuscope.operators import profiles as P
from corpuscope.operators.corpus import arrow_limits, ranked, stored, types

#: Words and grams of a corpus among which longer grams are sought; the driver and every task hold them. With many corpora, fewer.
WORDS, GRAMS = 32_768, 65_536
MOST_WORDS, MOST_GRAMS = 1 << 19, 1 << 20
#: Grams that a task counts at a time.
HELD = 4_000_000


def _counted(table: DataFrame, known: list[tuple[str, pa.Array, np.ndarray | None]]) -> DataFrame:
    """corpus (a number of known), key, cnt. known: corpus, its words, and its pairs of words in order. Without pairs, of two
    words: first * WORDS + second; with them, of three whose pairs are known: the first pair's number * WORDS + third."""
    held = table.sparkSession.sparkContext.broadcast(known)

    def keys(seqs: pa.ListArray, words: pa.Array, pairs: np.ndarray | None) -> np.ndarray:
        code = pc.fill_null(pc.index_in(seqs.flatten(), value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        size = pc.list_value_length(seqs).to_numpy(zero_copy_only=False)
        inside = np.ones(len(code), bool)  # whether the next word is of the same sequence
        inside[np.cumsum(size)[size > 0] - 1] = False
        two = np.where(inside[:-1] & (code[:-1] >= 0) & (code[1:] >= 0), code[:-1] * WORDS + code[1:], -1)
        if pairs is None:
            return two[two >= 0]
        if not len(pairs):
            return two[:0]
        at = np.minimum(np.searchsorted(pairs, two), len(pairs) - 1)
        some = pairs[at] == two
        return (at * WORDS)[:-1][some[:-1] & some[1:]] + code[2:][some[:-1] & some[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = [[] for _ in held.value]
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for i, part in enumerate(parts):
                if part:
                    key, n = np.unique(np.concatenate(part), return_counts=True)
                    yield pa.RecordBatch.from_pydict({"corpus": pa.array(np.full(len(key), i, np.int32)), "key": pa.array(key), "cnt": pa.array(n.astype(np.int64))})
                    part.clear()

        for batch in batches:
            own = batch.column("corpus")
            for i, (corpus, words, pairs) in enumerate(held.value):
                chosen = batch.column("seqs").filter(pc.equal(own, pa.scalar(corpus, own.type)))
                if len(seqs := chosen.flatten()) and len(found := keys(seqs, words, pairs)):  # an empty batch would end the stream
                    parts[i].append(found)
                    size += len(found)
            if size >= HELD:
                yield from rows()
                size = 0
        yield from rows()

    arrow_limits(table.sparkSession)  # rows hold whole texts
    return table.select("corpus", "seqs").mapInArrow(run, "corpus int, key bigint, cnt bigint").groupBy("corpus", "key").agg(F.sum("cnt").alias("cnt"))


def _over(counts: DataFrame, bound: list[int]) -> DataFrame:
    """Those that occur more often than their corpus's bound; others are neither kept nor told from what was left out before."""
    return counts.filter(F.col("cnt") > F.element_at(F.array(*map(F.lit, bound)).cast("array<bigint>"), F.col("corpus") + 1))


def _first(counts: DataFrame, key: str, most: int) -> tuple[dict, dict]:
    """For each corpus its first `most` keys with their counts, and the count of the first key left out (0: none)."""
    rows = ranked(counts, key, most + 1).select("corpus", key, "cnt").orderBy("corpus", "rnk").toArrow()  # bounded by the callers
    corpora = rows.column("corpus").combine_chunks()
    kept, left = {}, {}
    for corpus in pc.unique(corpora).to_pylist():
        own = rows.filter(pc.equal(rows.column("corpus"), pa.scalar(corpus, corpora.type)))
        kept[corpus] = (own.column(key).combine_chunks()[:most], own.column("cnt").to_numpy()[:most])
        left[corpus] = own.column("cnt")[most].as_py() if own.num_rows > most else 0
    return kept, left


def word_profiles(table: DataFrame, token_counts: DataFrame | None = None, sizes: tuple[int, ...] = (2, 3), top: int = P.WORD_TOP) -> DataFrame:
    """What profiles.word_profiles gives of the sizes 2, 3 or both, in any order of rows. table: a written table of corpora
    (corpus, seqs), which is read once or twice; token_counts: its types, if they are known already."""
    spark = table.sparkSession
    known = (token_counts if token_counts is not None else types(table)).select("corpus", "token", "cnt")
    known = known.filter("corpus IS NOT NULL").withColumn("corpus", F.col("corpus").cast("string"))
    texts = table.withColumn("corpus", F.col("corpus").cast("string"))
    heads = stored(ranked(known, "token", WORDS + 1).select("corpus", "token", "cnt"))
    number = max(1, heads.select("corpus").distinct().count())
    n_words, n_grams = min(WORDS, MOST_WORDS // number), min(GRAMS, MOST_GRAMS // number)
    found: list[pa.Table] = []
    sure: dict[int, list[str]] = {n: [] for n in sizes}
    if n_words > 1 and n_grams > top:
        words, rare = _first(heads, "token", n_words)
        names = sorted(words)
        bound = [rare[c] for c in names]  # no gram that isn't counted occurs more often

        def take(n: int, kept: dict, left: dict, spelled) -> None:
            for i, corpus in enumerate(names):
                key, cnt = kept.get(i, (pa.array([], pa.int64()), np.zeros(0, np.int64)))
                last = int(cnt[top - 1]) if len(cnt) >= top else 0
                rest = max(bound[i], left.get(i, 0))
                if last > rest or rest == 0:  # nothing left out occurs as often as the last one kept
                    sure[n].append(corpus)
                    use = cnt >= last  # ties are ranked by their words
                    code = key.to_numpy()[use]
                    gram = pc.binary_join_element_wise(*spelled(i, code), X.GRAM_SEPARATOR)
                    found.append(pa.table({"corpus": pa.array([corpus] * len(code), pa.string()), "n": pa.array(np.full(len(code), n, np.int32)), "gram": gram, "cnt": cnt[use]}))

        two, less = _first(_over(_counted(texts, [(c, words[c][0], None) for c in names]), bound), "key", n_grams)
        pairs = [np.sort(two[i][0].to_numpy()) if i in two else np.zeros(0, np.int64) for i in range(len(names))]
        spell = lambda i, code: (words[names[i]][0].take(pa.array(code // WORDS)), words[names[i]][0].take(pa.array(code % WORDS)))
        if 2 in sizes:
            take(2, two, less, spell)
        if 3 in sizes:
            bound = [max(bound[i], less.get(i, 0)) for i in range(len(names))]
            three, less = _first(_over(_counted(texts, [(c, words[c][0], pairs[i]) for i, c in enumerate(names)]), bound), "key", n_grams)
            take(3, three, less, lambda i, code: (*spell(i, pairs[i][code // WORDS]), words[names[i]][0].take(pa.array(code % WORDS))))
    kind = pa.schema([("corpus", pa.string()), ("n", pa.int32()), ("gram", pa.string()), ("cnt", pa.int64())])
    counts = spark.createDataFrame(pa.concat_tables([kind.empty_table(), *(t.cast(kind) for t in found)]).combine_chunks())  # an empty chunk would hide those behind it
    for n in sizes:
        own = F.col("corpus")
        open_ = texts.filter(own.isNull() | ~own.isin(sure[n])) if sure[n] else texts
        if open_.limit(1).count():
            counts = counts.unionByName(P.each_gram(open_, (n,)).groupBy("corpus", "n", "gram").agg(F.count(F.lit(1)).alias("cnt")))
    kept = P.profile(counts, top, by=["corpus", "n"])
    return kept.withColumn("corpus", F.col("corpus").cast(table.schema["corpus"].dataType))
