"""Corpus statistics and the typological feature vector."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuscope.functions import text as X
from corpuscope.operators import frequent
from corpuscope.operators import profiles as P
from corpuscope.operators.corpus import ranked, running_before, sequences, stored, taken_apart, types

#: Names of the features in order (fixed values); the last is auxiliary.
FEATURES = (
    "f01_ttr f02_top100_bigram_coverage f03_top100_trigram_coverage f04_log_mean_seq_len f05_top500_bigram_coverage "
    "f06_top500_trigram_coverage f07_top1000_unigram_coverage f08_seq_length_variance f09_word_length_mean "
    "f10_word_length_variance f11_hapax_ratio f12_zipf_slope_10_1000 f13_bigram_entropy f14_trigram_entropy "
    "f15_suffix_entropy f16_heaps_beta f17_conditional_char_entropy f18_dislegomena_to_hapax "
    "f19_word_edge_entropy_asymmetry f20_consonant_vowel_ratio f21_sentence_length_skewness aux_sentence_length_excess_kurtosis"
).split()
HEAPS_POINTS = 12


def _zero(c):
    return F.coalesce(c, F.lit(0.0))


def sequence_moments(corpora: DataFrame) -> DataFrame:
    """Population moments of sequence lengths; constant lengths have none."""
    n = F.size("tokens").cast("double")
    spread = F.var_pop(n)
    return sequences(corpora).groupBy("corpus").agg(
        F.count(F.lit(1)).alias("sequence_count"), F.sum(F.size("tokens")).cast("long").alias("total_tokens"), F.avg(n).alias("mean_seq_length"),
        spread.alias("variance"), F.when(spread > 0, _zero(F.skewness(n))).otherwise(0.0).alias("skewness"), F.when(spread > 0, _zero(F.kurtosis(n))).otherwise(0.0).alias("excess_kurtosis"),
    )


def letters_of(token: Column) -> tuple[Column, Column]:
    """Numbers of vowels and of other letters."""
    letters = F.regexp_replace(token, r"\P{L}", "")
    vowels = F.length(letters) - F.length(F.translate(letters, X.VOWELS, ""))
    return vowels, F.length(letters) - vowels


def type_stats(token_counts: DataFrame) -> DataFrame:
    """What follows from the counts of types: hapaxes, dis legomena, word lengths over occurrences, consonants and vowels."""
    size = F.length("token").cast("double")
    vowels, rest = letters_of(F.col("token"))
    cnt = F.col("cnt")
    mean = F.sum(size * cnt) / F.sum(cnt)
    return token_counts.groupBy("corpus").agg(
        F.count(F.lit(1)).alias("unique_types"), F.count(F.when(cnt == 1, 1)).alias("hapax"), F.count(F.when(cnt == 2, 1)).alias("dis"), F.sum(cnt).alias("tokens"),
        mean.alias("word_length_mean"), (F.sum(size * size * cnt) / F.sum(cnt) - mean * mean).alias("word_length_variance"),
        F.sum(vowels * cnt).alias("vowels"), F.sum(rest * cnt).alias("consonants"),
    )


def unigram_coverage(token_counts: DataFrame, top: int = 1000) -> DataFrame:
    whole = token_counts.groupBy("corpus").agg(F.sum("cnt").alias("all"))
    head = ranked(token_counts, "token", top).groupBy("corpus").agg(F.sum("cnt").alias("head"))
    return whole.join(head, "corpus").select("corpus", (F.col("head") / F.col("all")).alias("unigram_coverage"))


def zipf(token_counts: DataFrame, low: int = 10, high: int = 1000) -> DataFrame:
    """Slope of log count on log rank; 0 with fewer than low + 5 types."""
    return zipf_of(ranked(token_counts, "token", high), low)


def zipf_of(head: DataFrame, low: int = 10, by: str = "corpus") -> DataFrame:
    """The slope from the first types (cnt, rnk)."""
    late = F.col("rnk") >= low
    fit = head.groupBy(by).agg(F.regr_slope(F.when(late, F.log("cnt")), F.when(late, F.log("rnk"))).alias("slope"), F.max("rnk").alias("last"))
    return fit.select(by, F.when(F.col("last") >= low + 5, _zero(F.col("slope"))).otherwise(0.0).alias("zipf_slope"))


def _heaps_points(totals: DataFrame) -> DataFrame:
    """Adds points, the numbers of tokens at which the vocabulary is looked at, to corpora with their total."""
    low = F.greatest(F.lit(50), F.floor(F.col("total") / (2 * HEAPS_POINTS)))
    step = (F.col("total") - low) / float(HEAPS_POINTS - 1)
    at = F.transform(F.sequence(F.lit(0), F.lit(HEAPS_POINTS - 1)), lambda i: F.when(i == HEAPS_POINTS - 1, F.col("total")).otherwise(F.floor(low + i * step)).cast("long"))
    return totals.withColumn("points", F.array_distinct(at))


def placed_types(corpora: DataFrame, written: bool = False) -> DataFrame:
    """corpus, token, cnt, part: how many of the corpus's points lie at the token's first place or before it. Only the sizes of
    documents are put in order; from them each corpus has the documents that hold its points, a dozen at most, and these go
    to every task. Documents with equal ids come in the order of their digests. written: corpora is a written table, and so are the sizes."""
    marked = corpora.withColumn("digest", F.xxhash64("seqs"))
    size = F.aggregate("seqs", F.lit(0).cast("long"), lambda a, s: a + F.size(s))
    sized = marked.select("corpus", "doc_id", "digest", size.alias("size")).groupBy("corpus", "doc_id", "digest").agg(F.sum("size").alias("size"))
    sized = stored(sized) if written else sized.persist()  # three readers; three numbers a document
    totals = _heaps_points(sized.groupBy(F.col("corpus").alias("of")).agg(F.sum("size").alias("total"))).select("of", "points")
    starts = running_before(sized, "corpus", "doc_id", "size", "start", then=("digest",)).join(F.broadcast(totals), F.col("corpus").eqNullSafe(F.col("of")))
    held = F.filter("points", lambda p: (p >= F.col("start")) & (p < F.col("start") + F.col("size")))
    marks = starts.select("of", "doc_id", "digest", "start", F.explode(held).alias("point"))
    marks = marks.groupBy("of").agg(F.collect_list(F.struct("doc_id", "digest", (F.col("point") - F.col("start")).alias("at"))).alias("marks"))
    own = F.struct("doc_id", "digest")
    found = marked.join(F.broadcast(marks), F.col("corpus").eqNullSafe(F.col("of")), "left")
    before = F.size(F.filter("marks", lambda m: F.struct(m["doc_id"].alias("doc_id"), m["digest"].alias("digest")) < own))
    inside = F.transform(F.filter("marks", lambda m: m["doc_id"].eqNullSafe(F.col("doc_id")) & (m["digest"] == F.col("digest"))), lambda m: m["at"])
    places = [F.when(F.col("marks").isNull(), 0).otherwise(before).alias("before"), F.coalesce(inside, F.array().cast("array<bigint>")).alias("inside")]
    known = found.select("corpus", "seqs", *places)  # once a document, below the explode
    each = taken_apart(known, F.flatten("seqs"), "corpus", "before", "inside", name="token", place="p")
    part = F.col("before") + F.when(F.size("inside") > 0, F.size(F.filter("inside", lambda at: at <= F.col("p")))).otherwise(0)
    return each.select("corpus", "token", part.alias("part")).groupBy("corpus", "token").agg(F.count(F.lit(1)).alias("cnt"), F.min("part").alias("part"))


def heaps(placed: DataFrame) -> DataFrame:
    """Slope of log vocabulary on log tokens at twelve points; needs part (placed_types)."""
    seen = [F.count(F.when(F.col("part") <= i, 1)).alias(f"v{i}") for i in range(HEAPS_POINTS)]
    at = _heaps_points(placed.groupBy("corpus").agg(F.sum("cnt").alias("total"), *seen))
    return heaps_of(at.select("corpus", "total", "points"), at.drop("total", "points"))


def heaps_of(at: DataFrame, seen: DataFrame, by: str = "corpus") -> DataFrame:
    """The slope from total and points (at) and the types v0, v1, ... that occur before each point (seen)."""
    pairs = F.explode(F.arrays_zip("points", F.array(*(f"v{i}" for i in range(HEAPS_POINTS))).alias("vs")))
    rows = at.join(seen, by).select(by, "total", pairs.alias("x")).select(by, "total", F.col("x.points").alias("n"), F.col("x.vs").alias("v")).filter("n > 1 and v > 1 and total >= 100")
    fit = rows.groupBy(by).agg(F.regr_slope(F.log("v"), F.log("n")).alias("slope"), F.count(F.lit(1)).alias("k"))
    return at.join(fit, by, "left").select(by, F.when(F.col("k") >= 3, _zero(F.col("slope"))).otherwise(0.0).alias("heaps_beta"))


def conditional_char_entropy(token_counts: DataFrame) -> DataFrame:
    """Entropy of a character given the one before, within tokens."""
    pairs = token_counts.select("corpus", "cnt", F.explode(X.inner_pairs(F.col("token"))).alias("pair"))
    return pair_entropy(pairs.groupBy("corpus", "pair").agg(F.sum("cnt").alias("c")))


def pair_entropy(pairs: DataFrame, by: str = "corpus") -> DataFrame:
    """The entropy from counts c of pairs."""
    counted = pairs.withColumn("first", F.substring("pair", 1, 1))
    share = F.col("c") / F.sum("c").over(W.partitionBy(by, "first"))
    rows = counted.withColumn("q", share).withColumn("all", F.sum("c").over(W.partitionBy(by)))
    return rows.groupBy(by).agg((-F.sum(F.col("c") / F.col("all") * F.log("q"))).alias("conditional_char_entropy"))


def edge_asymmetry(token_counts: DataFrame) -> DataFrame:
    """Entropy of last characters less that of first ones."""
    ends = token_counts.select("corpus", "cnt", F.explode(F.array(F.struct(F.lit(-1.0).alias("sign"), F.substring("token", 1, 1).alias("ch")), F.struct(F.lit(1.0).alias("sign"), F.substring("token", -1, 1).alias("ch")))).alias("e"))
    return edge_entropy(ends.groupBy("corpus", "e.sign", "e.ch").agg(F.sum("cnt").alias("c")))


def edge_entropy(ends: DataFrame, by: str = "corpus") -> DataFrame:
    """The asymmetry from counts c of first (sign -1) and last (1) characters."""
    shared = ends.withColumn("p", F.col("c") / F.sum("c").over(W.partitionBy(by, "sign")))
    return shared.groupBy(by).agg(F.sum(-F.col("sign") * F.col("p") * F.log("p")).alias("edge_asymmetry"))


def corpus_stats(corpora: DataFrame, token_counts: DataFrame | None = None) -> DataFrame:
    """Sequences, tokens, types, type-token ratio and mean length of each corpus."""
    lengths = sequence_moments(corpora).select("corpus", "sequence_count", "total_tokens", "mean_seq_length")
    kinds = (types(corpora) if token_counts is None else token_counts).groupBy("corpus").agg(F.count(F.lit(1)).alias("unique_types"))
    return lengths.join(kinds, "corpus").select("corpus", "sequence_count", "total_tokens", "unique_types", (F.col("unique_types") / F.col("total_tokens")).alias("type_token_ratio"), "mean_seq_length")


def structural_vector(corpora: DataFrame, grams: DataFrame | None = None, token_counts: DataFrame | None = None) -> DataFrame:
    """Type-token ratio, coverage of the top 100 bigrams and trigrams, log of one plus the mean sequence length. grams,
    token_counts: the corpora's word profiles and types, if they are made already."""
    covers = (P.word_profiles(corpora) if grams is None else grams).groupBy("corpus").agg(*(_share(n, 100).alias(name) for n, name in ((2, "bigram_coverage"), (3, "trigram_coverage"))))
    base = corpus_stats(corpora, token_counts).select("corpus", F.col("type_token_ratio").alias("ttr"), F.log1p("mean_seq_length").alias("log_mean_seq_len")).join(covers, "corpus", "left")
    return base.select("corpus", "ttr", *(_zero(F.col(c)).alias(c) for c in ("bigram_coverage", "trigram_coverage")), "log_mean_seq_len")


def _share(n: int, k: int) -> Column:
    """Share of the first k of word_profiles' grams of one size."""
    return _zero(F.sum(F.when((F.col("n") == n) & (F.col("rnk") <= k), F.col("p"))))


def word_entropy(n: int) -> Column:
    """Entropy of word_profiles' grams of one size."""
    p = F.when(F.col("n") == n, F.col("p"))
    return _zero(-F.sum(F.when(p > 0, p * F.log(p))))


def feature_vector(corpora: DataFrame, written: bool = False) -> DataFrame:
    """All features of every corpus: one scan for the sequences, the sizes of documents, types and n-grams each, then joins of
    one row a corpus. written: corpora is a written table, whose frequent grams are found in jobs of their own."""
    placed = placed_types(corpora, written)
    placed = stored(placed) if written else placed.persist()  # six readers; one row a type
    moments = sequence_moments(corpora)
    stats = type_stats(placed)
    tags = ((2, "bigram"), (3, "trigram"))
    grams = frequent.word_profiles(corpora, placed) if written else P.word_profiles(corpora)
    word = grams.groupBy("corpus").agg(*(_share(n, k).alias(f"{tag}_{k}") for n, tag in tags for k in (100, 500)), *(word_entropy(n).alias(f"{tag}_entropy") for n, tag in tags))
    suffix = P.profile_entropy(P.profile(P.char_counts(placed, "s3"), P.CHAR_TOP["s3"]), "suffix_entropy")
    parts = [stats, word, suffix, unigram_coverage(placed), zipf(placed), heaps(placed), conditional_char_entropy(placed), edge_asymmetry(placed)]
    return from_parts(moments, parts)


def from_parts(moments: DataFrame, parts: list[DataFrame], by: str = "corpus") -> DataFrame:
    """The features from tables of one row a corpus that hold what they are made of."""
    whole = reduce(lambda a, b: a.join(b, by, "left"), parts, moments)
    value = dict(zip(FEATURES, (
        F.col("unique_types") / F.col("total_tokens"), F.col("bigram_100"), F.col("trigram_100"), F.log1p("mean_seq_length"), F.col("bigram_500"),
        F.col("trigram_500"), F.col("unigram_coverage"), F.col("variance"), F.col("word_length_mean"),
        F.col("word_length_variance"), F.col("hapax") / F.col("unique_types"), F.col("zipf_slope"), F.col("bigram_entropy"), F.col("trigram_entropy"),
        F.col("suffix_entropy"), F.col("heaps_beta"), F.col("conditional_char_entropy"), F.col("dis") / F.greatest("hapax", F.lit(1)),
        F.col("edge_asymmetry"), F.col("consonants") / F.greatest("vowels", F.lit(1)), F.col("skewness"), F.col("excess_kurtosis"),
    )))
    return whole.select(by, *(_zero(v.cast("double")).alias(name) for name, v in value.items()))


def diversity_bits(corpora: DataFrame) -> DataFrame:
    """Token entropy in bits over all types, their number, and the share of the most frequent one."""
    t = types(corpora).withColumn("p", F.col("cnt") / F.sum("cnt").over(W.partitionBy("corpus")))
    return t.groupBy("corpus").agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy_bits"), F.count(F.lit(1)).alias("vocabulary"), F.max("p").alias("top_share"))
