"""N-gram counts, profiles (shares of the top N), coverage and entropy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuscope.functions import text as X
from corpuscope.operators.corpus import entropy, limited, ranked, taken_apart, types

WORD_TOP = 5000
#: Kind of character profile -> number kept; c2, c3: character n-grams, s3: last three characters (fixed values).
CHAR_TOP = {"c2": 1500, "c3": 2500, "s3": 800}
FORM_WEIGHTS = {"c2": 0.40, "c3": 0.40, "s3": 0.20}


def _neighbours(corpora: DataFrame, most: int) -> DataFrame:
    """corpus, w0, w1, ...: a row for each place of a sequence: the word there (w0) and those behind it (w1 on; null past the end)."""
    behind = lambda s: F.arrays_zip(*((s if k == 0 else F.slice(s, F.lit(k + 1), F.size(s))).alias(f"w{k}") for k in range(most)))
    rows = taken_apart(corpora, F.flatten(F.transform("seqs", behind)), "corpus", name="x")
    return rows.select("corpus", "x.*")


def _gram(n: int) -> Column:
    """Null where the sequence ends before."""
    return F.concat(*[x for k in range(n) for x in (F.lit(X.GRAM_SEPARATOR), F.col(f"w{k}"))][1:])


def gram_counts(corpora: DataFrame, n: int) -> DataFrame:
    """corpus, gram, cnt of word n-grams; none crosses a sequence."""
    each = _neighbours(corpora, n).select("corpus", _gram(n).alias("gram")).filter("gram IS NOT NULL")
    return each.groupBy("corpus", "gram").agg(F.count(F.lit(1)).alias("cnt"))


def each_gram(corpora: DataFrame, sizes: tuple[int, ...] = (2, 3)) -> DataFrame:
    """corpus, n, gram: every word n-gram of several sizes, in one pass."""
    every = F.array(*(F.struct(F.lit(n).alias("n"), _gram(n).alias("gram")) for n in sizes))
    return _neighbours(corpora, max(sizes)).select("corpus", F.explode(every).alias("x")).filter("x.gram IS NOT NULL").select("corpus", "x.n", "x.gram")


def word_profiles(corpora: DataFrame, sizes: tuple[int, ...] = (2, 3), top: int = WORD_TOP) -> DataFrame:
    """corpus, n, gram, cnt, rnk, p of the word n-grams of several sizes, counted in one pass."""
    counts = each_gram(corpora, sizes).groupBy("corpus", "n", "gram").agg(F.count(F.lit(1)).alias("cnt"))
    return profile(counts, top, by=["corpus", "n"])


def profile(counts: DataFrame, top: int = WORD_TOP, key: str = "gram", by: str | list[str] = "corpus") -> DataFrame:
    """The top grams with p, their share of what is kept."""
    kept = ranked(counts, key, top, by)
    return kept.withColumn("p", F.col("cnt") / F.sum("cnt").over(W.partitionBy(by)))


def coverage(profiles: DataFrame, k: int, name: str, by: str = "corpus") -> DataFrame:
    return profiles.groupBy(by).agg(F.coalesce(F.sum(F.when(F.col("rnk") <= k, F.col("p"))), F.lit(0.0)).alias(name))


def profile_entropy(profiles: DataFrame, name: str, by: str = "corpus") -> DataFrame:
    return profiles.groupBy(by).agg(entropy(F.col("p")).alias(name))


def char_counts(token_counts: DataFrame, kind: str, by: str = "corpus") -> DataFrame:
    """corpus, gram, cnt of one kind. Tokens are counted first, so each type is taken apart once."""
    if kind == "s3":
        ends = token_counts.filter(F.length("token") >= 3).select(by, F.substring("token", -3, 3).alias("gram"), "cnt")
        return ends.groupBy(by, "gram").agg(F.sum("cnt").alias("cnt"))
    each = token_counts.select(by, F.explode(X.char_grams(F.col("token"), int(kind[1]))).alias("gram"), "cnt")
    return each.groupBy(by, "gram").agg(F.sum("cnt").alias("cnt"))


def char_profiles(token_counts: DataFrame, by: str = "corpus") -> DataFrame:
    """corpus, kind, gram, rnk, cnt, p of all three kinds: one pass takes each type apart, one shuffle counts, one ranks."""
    tagged = lambda grams, kind: F.transform(grams, lambda g: F.struct(F.lit(kind).alias("kind"), g.alias("gram")))
    ends = F.when(F.length("token") >= 3, F.array(F.substring("token", -3, 3))).otherwise(F.array().cast("array<string>"))
    every = F.concat(*(tagged(ends if k == "s3" else X.char_grams(F.col("token"), int(k[1])), k) for k in CHAR_TOP))
    counts = token_counts.select(by, "cnt", F.explode(every).alias("x")).groupBy(by, "x.kind", "x.gram").agg(F.sum("cnt").alias("cnt"))
    over = W.partitionBy(by, "kind")
    most = F.lit(0)
    for k, top in CHAR_TOP.items():
        most = F.when(F.col("kind") == k, top).otherwise(most)
    rank = F.row_number().over(over.orderBy(F.col("cnt").desc(), F.col("gram").asc()))
    kept = limited(counts, max(CHAR_TOP.values())).withColumn("rnk", rank).filter((F.col("rnk") <= max(CHAR_TOP.values())) & (F.col("rnk") <= most))
    return kept.withColumn("p", F.col("cnt") / F.sum("cnt").over(over)).select(by, "kind", "gram", "rnk", "cnt", "p")


def profile_sums(profiles: DataFrame, by: str = "corpus") -> DataFrame:
    """Whether each profile adds up to one within a thousandth."""
    return profiles.groupBy(by).agg(F.sum("p").alias("total"), F.count(F.lit(1)).alias("grams"), F.sum("p").between(0.999, 1.001).alias("valid"))


def language_profiles(corpora: DataFrame) -> DataFrame:
    return char_profiles(types(corpora))
