"""Quality rules by robust multivariate outliers (operator 5).

Each text becomes a vector of transformed statistics. Per language and source the minimum covariance determinant
estimate - centre and scatter of the three quarters of the texts that lie closest together - is found by concentration
steps from a coordinate-wise median and MAD start: all texts are binned by their distance, one aggregation gives the
moments of each bin, and the bins are summed outwards until they hold the wanted share. A text further from its
group's centre than the cut is rejected. Every pass covers all texts; a group's rows are only ever pre-aggregated.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscope.llm.common import modest_batches, salt_of, saved, utf8_column

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 10
WINDOW = 5
#: Base rule: more than this per cent of the words in repeated windows.
MOST_REPEATED = 20
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: The vector: log of a word's mean length, root of the share of symbols, share of repeated lines, share of repeated words.
DIMS = 4
#: Least standard deviation of each coordinate, so that a statistic which is nearly always zero doesn't make
#: outliers of the few texts that have it.
FLOOR = np.array([0.30, 0.30, 2.0, 1.0])
#: Coordinates are scaled by the root of the number of words, which levels their spread, up to this number.
WORDS_FULL = 400
SHARE = 0.75
STEPS = 3
#: Distances beyond which one text in ten million of a normal population would lie (chi-square, 4 degrees of freedom).
CUT = 38.2
#: Groups with fewer texts are taken together within their language, then altogether; a smaller rest is not judged.
LEAST = 60
BIN = 1 / 32
#: Parts into which a group's rows are dealt for joins with what is known of the group.
SALTS = 32


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in windows found twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.uint64)
    windows = np.lib.stride_tricks.sliding_window_view(ids, WINDOW)
    mix = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        mix = mix * np.uint64(0x9E3779B97F4A7C15) + (windows[:, k] + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        mix ^= mix >> np.uint64(29)
    order = np.argsort(mix, kind="stable")
    same = mix[order][1:] == mix[order][:-1]
    if not same.any():
        return 0
    equal = (windows[order[1:]] == windows[order[:-1]]).all(axis=1)
    if (same & ~equal).any():  # two windows share a mixed value: compare them whole
        seen: dict[tuple, list[int]] = {}
        for i, w in enumerate(map(tuple, windows.tolist())):
            seen.setdefault(w, []).append(i)
        found = [i for at in seen.values() if len(at) > 1 for i in at]
    else:
        found = np.concatenate([order[1:][same], order[:-1][same]])
    marks = np.zeros(len(words) + 1, np.int64)
    starts = np.unique(found)
    marks[starts] += 1
    marks[starts + WINDOW] -= 1
    return int((np.cumsum(marks) > 0).sum())


def repeated_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and how many of them equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines), len(lines) - len(set(lines))


def counts_of(text: bytes) -> tuple[int, int, int, int, int, int]:
    """COUNTS and the number of lines with a word."""
    words = text.split()  # bytes: the six ASCII white-space characters
    lines, again = repeated_lines(text)
    return len(words), len(b"".join(words).decode("utf-8", "replace")), len(text) - len(text.translate(None, SYMBOLS)), again, repeated_words(words), lines


def statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, COUNTS, n_lines and text_hash, a digest of the text (null for null). A null text counts as
    empty."""
    src = docs.select(*keep, F.col(text).cast("string").alias("__text"), F.md5(F.col(text).cast("string")).alias("text_hash"))
    fields = [f for f in src.schema.fields if f.name != "__text"]
    own = (*COUNTS, "n_lines")
    schema = T.StructType([*fields, *(T.StructField(n, T.LongType()) for n in own)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([counts_of(t) for t in utf8_column(batch.column("__text"))], np.int64).reshape(-1, len(own))
            yield pa.RecordBatch.from_pydict({f.name: batch.column(f.name) for f in fields} | {n: pa.array(rows[:, i]) for i, n in enumerate(own)})

    return modest_batches(src).mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _dealt(groups: DataFrame) -> DataFrame:
    """A table with a row for each group, once for each part of the group's rows."""
    return groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _grouped(stats: DataFrame, language: str, source: str) -> DataFrame:
    """Adds g: language and source, or the pool of its language's small groups, or the pool of what is left."""
    fit = stats.filter(~F.col("base_failed"))
    sizes = fit.groupBy(language, source).agg(F.count(F.lit(1)).alias("n"))
    small = sizes.filter(F.col("n") < LEAST)
    pools = small.groupBy(language).agg(F.sum("n").alias("pool"))
    named = F.to_json(F.struct(F.col(language).alias("l"), F.col(source).alias("s")))
    keys = sizes.join(pools.withColumnRenamed(language, "__l"), F.col(language).eqNullSafe(F.col("__l")), "left").select(
        F.col(language).alias("__lang"),
        F.col(source).alias("__source"),
        F.when(F.col("n") >= LEAST, named).when(F.col("pool") >= LEAST, F.to_json(F.struct(F.col(language).alias("l"), F.lit(True).alias("pool")))).otherwise(F.lit("pool")).alias("g"),
    )
    keys = _dealt(keys).withColumnRenamed("salt", "__salt")
    same = stats[language].eqNullSafe(keys["__lang"]) & stats[source].eqNullSafe(keys["__source"]) & (stats["salt"] == keys["__salt"])
    return stats.join(keys, same, "left").drop("__lang", "__source", "__salt")


def _raw_vector() -> list[Column]:
    """The unscaled coordinates, to three decimals (so that medians need few different values)."""
    chars, words, lines = F.greatest("word_chars", F.lit(1)), F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return [F.round(x, 3) for x in (F.log(chars / words), F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars") + F.col("n_symbols"), F.lit(1))), F.col("n_dup_lines") / lines, F.col("n_repeat_words") / words)]


def _distance() -> Column:
    """Squared Mahalanobis distance of y from the estimate in mu and inv (upper triangle, row by row)."""
    total, k = F.lit(0.0), 0
    off = [F.col("y")[i] - F.col("mu")[i] for i in range(DIMS)]
    for i in range(DIMS):
        for j in range(i, DIMS):
            total = total + F.col("inv")[k] * off[i] * off[j] * (1 if i == j else 2)
            k += 1
    return total


def _chi2_tail(x: float, dof: int) -> float:
    """P(chi-square > x), even degrees of freedom."""
    return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dof // 2))


def consistency(share: float = SHARE, dims: int = DIMS) -> float:
    """Factor that makes the scatter of the inner share of a normal population that of all of it."""
    low, high = 0.0, 100.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - _chi2_tail(mid, dims) < share else (low, mid)
    return share / (1 - _chi2_tail(low, dims + 2))


def inner_moments(bins: np.ndarray, n: np.ndarray, sums: np.ndarray, squares: np.ndarray, share: float = SHARE) -> tuple[np.ndarray, np.ndarray]:
    """Centre and scatter of the innermost bins that hold the share of the rows."""
    order = np.argsort(bins, kind="stable")
    reached = np.cumsum(n[order])
    inner = order[: int(np.searchsorted(reached, share * reached[-1])) + 1]
    total = n[inner].sum()
    mu = sums[inner].sum(axis=0) / total
    return mu, squares[inner].sum(axis=0) / total - np.outer(mu, mu)


def inverse(scatter: np.ndarray) -> np.ndarray:
    """Inverse of the scatter, made consistent, with the floor added where a coordinate spreads less; upper triangle."""
    s = scatter * consistency()
    missing = np.maximum(FLOOR**2 - np.diag(s), 0)
    return np.linalg.inv(s + np.diag(missing))[np.triu_indices(DIMS)]


ESTIMATE = "g string, mu array<double>, inv array<double>"


def _concentrate(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """One concentration step: the estimate from the texts that lie innermost by the one before."""
    pairs = [(i, j) for i in range(DIMS) for j in range(i, DIMS)]
    binned = rows.join(_dealt(estimate), ["g", "salt"]).withColumn("bin", F.floor(F.log1p(F.greatest(_distance(), F.lit(0.0))) / BIN))
    moments = binned.groupBy("g", "bin").agg(
        F.count(F.lit(1)).alias("n"),
        *(F.sum(F.col("y")[i]).alias(f"s{i}") for i in range(DIMS)),
        *(F.sum(F.col("y")[i] * F.col("y")[j]).alias(f"q{i}{j}") for i, j in pairs),
    )

    def fit(table: pa.Table) -> pa.Table:
        col = {name: table.column(name).to_numpy() for name in table.column_names if name != "g"}
        squares = np.zeros((table.num_rows, DIMS, DIMS))
        for i, j in pairs:
            squares[:, i, j] = squares[:, j, i] = col[f"q{i}{j}"]
        mu, scatter = inner_moments(col["bin"], col["n"], np.stack([col[f"s{i}"] for i in range(DIMS)], 1), squares)
        return pa.table({"g": table.column("g")[:1], "mu": [mu.tolist()], "inv": [inverse(scatter).tolist()]})

    return moments.groupBy("g").applyInArrow(fit, ESTIMATE)


def judge(docs: DataFrame, text: str = "text", language: str = "lang", source: str = "source", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, COUNTS, text_hash, base_failed, distance (squared, null where base_failed or where the group
    is too small to judge) and kept.

    kept is false for texts that fail the base rule and for texts whose distance exceeds CUT. Null and empty texts have
    no words and fail. Null languages and sources are groups like others. Repeated rows count each time and stay.
    Columns besides the kept ones are dropped. An empty table gives an empty result.
    """
    columns = list(dict.fromkeys([*keep, language, source]))
    stats = saved(statistics(docs, text, tuple(columns)).withColumn("base_failed", base_failed()).withColumn("salt", salt_of("text_hash", *columns, n=SALTS)), "quality-counts")
    grouped = _grouped(stats, language, source)
    raw = grouped.withColumn("x", F.array(*_raw_vector())).withColumn("root", F.sqrt(F.least(F.col("n_words"), F.lit(WORDS_FULL)).cast("double")))
    fit = raw.filter(~F.col("base_failed")).select("g", "salt", "x", "root")
    middle = fit.groupBy("g").agg(F.array(*(F.percentile(F.col("x")[i], 0.5) for i in range(DIMS))).alias("middle"), F.count(F.lit(1)).alias("size")).filter(F.col("size") >= LEAST)
    scaled = F.array(*(F.floor((F.col("x")[i] - F.col("middle")[i]) * F.col("root") * 256) / 256 for i in range(DIMS)))
    rows = saved(fit.join(_dealt(middle), ["g", "salt"]).select("g", "salt", scaled.alias("y")), "quality-vectors")
    spread = rows.groupBy("g").agg(*(F.percentile(F.round(F.abs(F.col("y")[i]), 2), 0.5).alias(f"m{i}") for i in range(DIMS)))
    flat = [1 / F.pow(F.greatest(1.4826 * F.col(f"m{i}"), F.lit(float(FLOOR[i]))), F.lit(2)) if i == j else F.lit(0.0) for i in range(DIMS) for j in range(i, DIMS)]
    estimate = spread.select("g", F.array(*[F.lit(0.0)] * DIMS).alias("mu"), F.array(*flat).alias("inv"))
    for _ in range(STEPS):
        estimate = saved(_concentrate(rows, estimate), "quality-estimate")
    final = estimate.join(middle.select("g", "middle"), "g")
    judged = raw.join(_dealt(final), ["g", "salt"], "left").withColumn("y", scaled).withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    return judged.select(*keep, *COUNTS, "text_hash", "base_failed", "distance", (~F.col("base_failed") & F.coalesce(F.col("distance") <= CUT, F.lit(True))).alias("kept"))


def keep_good(docs: DataFrame, text: str = "text", id_col: str = "doc_id", language: str = "lang", source: str = "source") -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns. Equal rows get one verdict, so a semi join by id,
    group and digest of the text keeps or drops them together."""
    verdict = judge(docs, text, language, source, tuple(dict.fromkeys([id_col, language, source]))).filter("kept")
    keys = verdict.select(F.col(id_col).alias("__id"), F.col(language).alias("__l"), F.col(source).alias("__s"), F.col("text_hash").alias("__h"))
    same = docs[id_col].eqNullSafe(keys["__id"]) & docs[language].eqNullSafe(keys["__l"]) & docs[source].eqNullSafe(keys["__s"]) & F.md5(docs[text].cast("string")).eqNullSafe(keys["__h"])
    return docs.join(keys, same, "left_semi")
