"""Audit of sources by how far their terms' shares diverge (operator 11).

Terms are counted inside tasks before they are shuffled. Terms with the same counts in the same sources of a language are one
sparse vector with a multiplicity; each pair of sources is evaluated once for every distinct vector that has both, and sums
grow by the multiplicity. What a pair owes to terms that one or none of its sources has depends on the counts of a single
source, so it comes from histograms of these. The ranked terms are the least of each vector's own, taken back at the end.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuscope.llm.common import modest_batches, saved, spread_join, utf8_column

LEAST_DOCUMENTS, RANKS, SCALE = 10, 10, 1_000_000_000
#: Terms that a task counts before it passes them on.
MOST_TERMS = 600_000
#: Bytes of a text that are cut into terms at a time.
PART_BYTES = 1 << 20
#: Letters of ASCII, lower-cased, and all bytes beyond ASCII make terms; the others are white space between them.
LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def _parts(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a part at a time."""
    text, at = text.translate(LETTERS), 0
    while at < len(text):
        to = text.find(b" ", at + PART_BYTES)
        to = len(text) if to < 0 else to
        yield text[at:to].split()
        at = to


def term_counts(docs: DataFrame, text: str = "text", group: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """lang, source, term, cnt, docs (that hold the term): sums of parts of the table, several rows for a key. An empty term
    stands for each group that occurs."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in zip((*group, text), ("__lang", "__source", "__text"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def passed_on() -> pa.Table:
            parts = []
            for (lang, source), (counts, docs) in held.items():
                terms = pa.array(list(counts), pa.binary()).cast(pa.string())
                columns = [pa.repeat(pa.scalar(x, pa.string()), len(terms)) for x in (lang, source)]
                columns += [terms, pa.array(list(counts.values()), pa.int64()), pa.array(list(map(docs.__getitem__, counts)), pa.int64())]
                parts.append(pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "cnt", "docs"]))
            held.clear()
            return pa.Table.from_batches(parts).combine_chunks()

        for batch in batches:
            for lang, source, raw in zip(batch.column("__lang").to_pylist(), batch.column("__source").to_pylist(), utf8_column(batch.column("__text"))):
                counts, docs = held.setdefault((lang, source), (Counter({b"": 0}), Counter()))
                own: set[bytes] = set()
                for terms in _parts(raw):
                    counts.update(terms)
                    own.update(terms)
                docs.update(own)
            if sum(len(counts) for counts, _ in held.values()) > MOST_TERMS:
                yield from passed_on().to_batches()
        if held:
            yield from passed_on().to_batches()

    return modest_batches(docs.select(*cols)).mapInArrow(run, "lang string, source string, term string, cnt bigint, docs bigint")


def kept_terms(counts: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, term, vec: [(source, cnt)] by source, for every term in at least that many documents of its language, and for the
    empty term. vec is as long as the sources of a language that have the term."""
    each = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("cnt").alias("cnt"), F.sum("docs").alias("docs"))
    terms = each.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("source", "cnt"))).alias("vec"))
    return terms.filter((F.col("docs") >= least) | (F.col("term") == "")).select("lang", "term", "vec")


def _p(count: Column | str, total: Column | str, terms: Column | str, scale: int) -> Column:
    """1 + floor(scale * (count + 2) / (total + 2 * terms)), exactly; without terms it doesn't matter."""
    name = lambda x: F.col(x) if isinstance(x, str) else x
    above = F.lit(scale).cast("decimal(10,0)") * (name(count) + 2).cast("decimal(20,0)")
    below = F.greatest(name(total) + 2 * name(terms), F.lit(1)).cast("decimal(20,0)")
    return 1 + F.call_function("div", above, below)


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, text: str = "text", group: tuple[str, str] = ("lang", "source"), least: int = LEAST_DOCUMENTS, ranks: int = RANKS, scale: int = SCALE) -> DataFrame:
    """lang, source, part, item, value, rank: for every group its divergence from each other source of its language, all of
    them ranked (part pair), and of the terms of which it has a larger share than its language those that diverge most, up to
    `ranks` (part term).

    Null texts, languages and sources are empty strings. Terms are runs of ASCII letters, lower-cased, and characters beyond
    ASCII. Repeated rows count each time. A group without terms has all pairs and no terms. An empty table gives an empty
    result. Shares are whole numbers up to `scale` and one.
    """
    terms = saved(kept_terms(term_counts(docs, text, group), least), "audit-terms")
    groups = terms.filter("term = ''").select("lang", F.explode("vec").alias("x")).select("lang", "x.source")
    terms = terms.filter("term <> ''")
    # One row for each distinct vector, with its multiplicity and as many of its least terms as can have a rank.
    alike = W.partitionBy("lang", "vec").orderBy("term")
    named = terms.withColumn("k", F.row_number().over(alike)).filter(F.col("k") <= ranks).groupBy("lang", "vec").agg(F.collect_list("term").alias("terms"))
    vectors = terms.groupBy("lang", "vec").agg(F.count(F.lit(1)).alias("times")).join(named, ["lang", "vec"])
    vectors = saved(vectors.withColumn("id", F.monotonically_increasing_id()), "audit-vectors")
    entries = vectors.select("id", "lang", "times", F.explode("vec").alias("x")).select("id", "lang", "times", "x.source", "x.cnt")
    sums = entries.groupBy("lang", "source").agg(F.sum(F.col("cnt") * F.col("times")).alias("total"), F.sum("times").alias("own"), F.count(F.lit(1)).alias("rows"))
    langs = vectors.groupBy("lang").agg(F.sum("times").alias("v"), F.sum(F.col("times") * F.aggregate("vec", F.lit(0).cast("bigint"), lambda a, x: a + x["cnt"])).alias("lang_total"))
    sizes = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "own", "rows", "v", "lang_total"])
    sizes = saved(sizes.withColumn("p0", _p(F.lit(0), "total", "v", scale)), "audit-groups")
    shares = spread_join(entries, sizes.drop("own"), ["lang", "source"], "rows").withColumn("p", _p("cnt", "total", "v", scale)).drop("rows")
    shares = saved(shares, "audit-shares")
    # All groups of a language in one array, as the result has a row for each pair of them anyway.
    others = saved(sizes.groupBy("lang").agg(F.collect_list(F.struct("source", "p0", "own")).alias("others"), F.greatest(F.sum("rows"), F.count(F.lit(1))).alias("rows")), "audit-others")
    facing = lambda df: spread_join(df, others, ["lang"], "rows").withColumn("o", F.explode("others")).filter("o.source <> source").drop("others", "rows")
    # As if no term were in both, from the groups and the histograms of their counts ..
    none = facing(sizes.drop("rows")).select("lang", "source", F.col("o.source").alias("item"), ((F.col("v") - F.col("own") - F.col("o.own")) * _f(F.col("p0"), F.col("o.p0"))).alias("value"))
    levels = saved(shares.groupBy("lang", "source", "p").agg(F.sum("times").alias("n")), "audit-levels")
    one = facing(levels).select("lang", "source", F.col("o.source").alias("item"), (F.col("n") * _f(F.col("p"), F.col("o.p0"))).alias("value"))
    one = one.union(one.select("lang", "item", "source", "value"))
    # .. and what terms in both make up for, once for each distinct vector.
    vec = shares.groupBy("id", "lang", "times").agg(F.collect_list(F.struct("source", "p", "p0")).alias("vec"))
    later = vec.select("lang", "times", F.posexplode("vec").alias("i", "a"), "vec").select("lang", "times", "a", F.expr("slice(vec, i + 2, size(vec))").alias("later"))
    both = later.select("lang", "times", "a", F.explode("later").alias("b"))
    change = _f(F.col("a.p"), F.col("b.p")) - _f(F.col("a.p"), F.col("b.p0")) - _f(F.col("a.p0"), F.col("b.p")) + _f(F.col("a.p0"), F.col("b.p0"))
    two = both.select("lang", F.col("a.source").alias("source"), F.col("b.source").alias("item"), (F.col("times") * change).alias("value"))
    two = two.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    two = two.union(two.select("lang", "item", "source", "value"))
    pairs = none.union(one).union(two).groupBy("lang", "source", "item").agg(F.sum("value").cast("bigint").alias("value")).withColumn("part", F.lit("pair"))
    of_lang = vectors.select("id", "terms", F.aggregate("vec", F.lit(0).cast("bigint"), lambda a, x: a + x["cnt"]).alias("lang_cnt"))
    above = shares.join(of_lang, "id").withColumn("q", _p("lang_cnt", "lang_total", "v", scale)).filter("cnt > 0 and p > q")
    ranked = above.select("lang", "source", F.lit("term").alias("part"), F.explode("terms").alias("item"), _f(F.col("p"), F.col("q")).alias("value"))
    order = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    best = ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= ranks)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("rank", F.row_number().over(order)).select(*columns).union(best.select(*columns))
