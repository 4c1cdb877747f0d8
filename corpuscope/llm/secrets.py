"""Secret scans (operator 10): fixed patterns, and character Markov models for what no pattern names. DataFrame
functions only.

Two first-order character models, one of random strings and one of ordinary identifiers, are trained from labelled
samples; a long string of key characters counts as a secret if its log-likelihood ratio between the two exceeds a
margin. The samples: random strings derived from a hash, and the words of a bounded sample of documents labelled good
(FIT_DOCS, by least hash of the id), beside a fixed list of identifiers. What a model holds is bounded by its alphabet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Base patterns (fixed values).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "random")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=."
STATES = len(ALPHABET) + 1  # 0: any other character, and the start
#: A candidate may follow an equals sign (NAME=secret); within it the sign is padding at the end only.
#: From 16 characters on; under 20 with a letter, as 16 digits are card numbers rather than keys.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{20,}|(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{16,19})={0,2}(?![A-Za-z0-9+/_=-])"
#: A candidate's log-likelihood ratio must exceed this much for each character.
MARGIN = 0.75
FIT_DOCS = 2000
RANDOM_SAMPLES = 4000
#: Ordinary identifiers (fixed values of the labelled sample).
IDENTIFIERS = (
    "getUserName setDefaultValue isEmptyString max_partition_bytes user_account_settings create_or_replace_view "
    "org/apache/commons/lang/StringUtils com/example/project/module/Service application/json text/html content-type "
    "x-forwarded-for access-control-allow-origin window-functions-and-frames DataFrameReader StructuredStreaming "
    "AbstractSingletonProxyFactoryBean InternationalizationConfiguration characteristically internationalization "
    "UPPER_CASE_CONSTANT DEFAULT_BUFFER_SIZE MAX_RETRY_COUNT test_reads_every_row_group utf8_general_ci iso8859-1 "
    "version-1-2-3 release/2024/05/notes http-status-404 src/main/resources/static/index node_modules/package/lib "
    "2024-01-31 192-168-0-1 chapter_12_section_3 part-00000-of-00128 snake_case_identifier_with_many_words"
).split()


def random_strings(spark: SparkSession, n: int = RANDOM_SAMPLES, seed: str = "secret") -> DataFrame:
    """Random strings of five usual makes: hex, base64, letters and digits, capitals and digits, small letters and
    digits."""
    digest = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    b64 = F.base64(F.unhex(digest))
    plain = F.regexp_replace(b64, "[+/=]", "")
    make = F.element_at(F.array(F.substring(digest, 1, 40), F.regexp_replace(b64, "=", ""), plain, F.upper(plain), F.lower(plain)), (F.col("id") % 5 + 1).cast("int"))
    return spark.range(n).select(make.alias("s"), F.lit(1).alias("label"))


def labelled_samples(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", fit_docs: int = FIT_DOCS) -> DataFrame:
    """(s, label): random strings 1; identifiers and words of good documents 0. The words of at most fit_docs documents
    labelled of quality 1 and not toxic, those of least hash of the id; repeated words count once."""
    spark = docs.sparkSession
    good = labels.filter("quality = 1 and toxic = 0").select(F.col(id_col).alias("__id")).distinct()
    chosen = docs.join(good.orderBy(F.xxhash64("__id"), "__id").limit(fit_docs), F.col(id_col) == F.col("__id"), "left_semi")
    words = chosen.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(r"[A-Za-z0-9+/_-]{4,}"), F.lit(0))).alias("s")).distinct()
    fixed = spark.range(1).select(F.explode(F.split(F.lit(" ".join(IDENTIFIERS)), " ")).alias("s"))
    # Strings that the base patterns know as secrets are no identifiers.
    plain = words.union(fixed).filter(~F.col("s").rlike(rf"{HEX[:-1]}{{{LEAST_HEX},}}|{ACCESS[:-1]}{{16,}}"))
    # Shouted words are ordinary as well.
    spoken = plain.select(F.explode(F.array("s", F.upper("s"))).alias("s"), F.lit(0).alias("label"))
    return random_strings(spark).union(spoken)


def _states(s: Column) -> Column:
    return F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))


def _moves(s: Column) -> Column:
    """Numbers of the character pairs of s, the start included."""
    states = F.concat(F.array(F.lit(0)), _states(s))
    return F.zip_with(F.slice(states, F.lit(1), F.size(states) - 1), F.slice(states, F.lit(2), F.size(states) - 1), lambda a, b: a * STATES + b)


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of each character pair, random against ordinary, with half a count added: STATES squared
    numbers, the whole model. samples: s, label (1 random, 0 ordinary); null and empty strings count for nothing."""
    moves = samples.filter(F.length("s") > 0).select("label", F.explode(_moves(F.col("s"))).alias("move"))
    counts = moves.groupBy("move").agg(*(F.count(F.when(F.col("label") == k, 1)).alias(f"c{k}") for k in (0, 1)))
    cells = {r["move"]: (r["c0"], r["c1"]) for r in counts.collect()}  # STATES squared rows at most
    from math import log

    ratio = []
    for a in range(STATES):
        row = [cells.get(a * STATES + b, (0, 0)) for b in range(STATES)]
        whole = [sum(x[k] for x in row) + STATES / 2 for k in (0, 1)]
        ratio += [log((x[1] + 0.5) / whole[1]) - log((x[0] + 0.5) / whole[0]) for x in row]
    return ratio


def log_ratio(s: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a string."""
    table = F.split(F.lit(" ".join(f"{x:.6f}" for x in model)), " ").cast("array<double>")  # folded to a constant
    return F.aggregate(_moves(s), F.lit(0.0), lambda a, m: a + F.get(table, m))


def _spans(text: str, pattern: str, found: str, kind: int, keep) -> Column:
    """Spans of the matches in column `found` that keep() accepts: start, kind, end in code points. The texts between
    the matches give the places."""
    gaps = F.split(F.col(text), pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        a = s["at"] + F.length(x["g"])
        b = a + F.length(x["m"])
        one = F.array(F.struct(a.cast("int").alias("start"), F.lit(kind).alias("kind"), b.cast("int").alias("end")))
        return F.struct(b.cast("int").alias("at"), F.when(keep(x["m"]), F.concat(s["out"], one)).otherwise(s["out"]).alias("out"))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), F.col(found), lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    return F.when(F.size(found) > 0, F.aggregate(pairs, start, step, lambda s: s["out"])).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))


def _written(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", name(x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, model: list[float], text: str = "text", keep: tuple[str, ...] = ("doc_id",), margin: float = MARGIN) -> DataFrame:
    """The kept columns and n_assign, n_access, n_hex, n_random, base_sha256 and spans ("kind:start:end" by start, then
    kind; code points, end exclusive; base_sha256 covers the first three kinds).

    A pattern's matches are found leftmost first, and only then those too short dropped. The models add candidates that
    overlap no base span. Null counts as empty: no spans, the digest of nothing. Rows are independent; other columns
    are dropped; an empty table gives an empty result.
    """
    # Runs of hex digits and access keys are maximal runs, so the length can be part of the pattern.
    hexes, access = rf"{HEX[:-1]}{{{LEAST_HEX},}}", rf"{ACCESS[:-1]}{{{LEAST_ACCESS - 4},}}"
    patterns = {"assign": ASSIGN, "access": access, "hex": hexes, "random": CANDIDATE}
    src = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__t"))
    src = src.select("*", *(F.regexp_extract_all("__t", F.lit(p), F.lit(0)).alias(f"__{k}") for k, p in patterns.items()))
    long_enough = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= LEAST_ASSIGN
    everything = lambda m: F.lit(True)
    looks_random = lambda m: log_ratio(m, model) > margin * F.length(m)
    tests = {"assign": long_enough, "access": everything, "hex": everything, "random": looks_random}
    src = src.select("*", *(_spans("__t", p, f"__{k}", i, tests[k]).alias(f"__s{i}") for i, (k, p) in enumerate(patterns.items())))
    base = F.concat("__s0", "__s1", "__s2")
    src = src.withColumn("__base", base)
    added = F.filter("__s3", lambda x: ~F.exists("__base", lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])))
    src = src.withColumn("__added", added)
    return src.select(*keep, *(F.size(f"__s{i}").cast("long").alias(f"n_{KINDS[i]}") for i in range(3)), F.size("__added").cast("long").alias("n_random"), F.sha2(_written(F.col("__base")), 256).alias("base_sha256"), _written(F.concat("__base", "__added")).alias("spans"))
