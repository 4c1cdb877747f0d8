"""Near-duplicates by SimHash fingerprints and the exact similarity of word shingles, for stages (operator 7's three-word
fingerprints bind only its query).

Two texts are near copies if the Jaccard similarity of their sets of five-word shingles is 0.8 or more. Equal sets are
taken together first. Candidates are sets whose fingerprints link at three bits or fewer (`simhash`: segment popcounts). Sets of
similarity 0.8 often lie further apart, some ten bits of 64, so for these candidates also share one of 24 bands of four least
hashes: a pair of similarity 0.8 shares none with a probability of three in a million. What either way brings together counts
only if the exact similarity says so.
Cells of bands by their number of different sets: up to SMALL, all pairs; in larger ones first neighbours of a hashed order,
which joins what is alike throughout; the cells that still hold several classes are cut into blocks, and a local
forest of each pair of blocks finds every link between classes that is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscope.llm import simhash
from corpuscope.llm.common import deal, modest_batches, release, saved, utf8_column
from corpuscope.llm.components import components

SHINGLE, SIMILARITY = 5, 0.8
BANDS, BAND_ROWS = 24, 4
SMALL, BLOCK = 16, 1024
SEED = 42
SLICE = 4096
_MIXED = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * BAND_ROWS), np.uint64)
XORS, FACTORS = _MIXED[0], _MIXED[1] | np.uint64(1)


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the different shingles, ascending. A shorter text is one shingle, a wordless one none."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-shingle].tolist()]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())], np.uint64))


def set_key(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED) - (1 << 63)


def bands(hashes: np.ndarray) -> list[int]:
    """The set's cell in each band; none for an empty set."""
    if not len(hashes):
        return []
    least = np.full(len(XORS), ~np.uint64(0))
    for a in range(0, len(hashes), SLICE):
        np.minimum(least, ((hashes[a : a + SLICE, None] ^ XORS) * FACTORS).min(axis=0), out=least)
    rows = least.reshape(BANDS, BAND_ROWS)
    return [xxhash.xxh64_intdigest(r.tobytes(), SEED) - (1 << 63) for r in rows]


def alike(shared: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    return shared >= similarity * (a + b - shared) - 1e-9


def forest(sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links of similar sets that connect what all such links connect: breadth first, so one link a set."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    kinds, token = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]), return_inverse=True)
    holders = owner[np.argsort(token, kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.bincount(token, minlength=len(kinds)))])
    at = np.concatenate([[0], np.cumsum(size)])
    left, out, queue = np.ones(len(sets), bool), [], []
    for seed in range(len(sets)):
        if not left[seed]:
            continue
        left[seed] = False
        queue = [seed]
        while queue and left.any():
            node = queue.pop()
            mine = token[at[node] : at[node + 1]]
            shared = np.bincount(np.concatenate([np.empty(0, int), *(holders[first[t] : first[t + 1]] for t in mine)]), minlength=len(sets))
            near = np.flatnonzero(left & alike(shared, size, size[node], similarity))
            left[near] = False
            out += [(node, x) for x in near.tolist()]
            queue += near.tolist()
    return out


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """SimHash fingerprints of sets."""
    return simhash.majority(np.concatenate([np.empty(0, np.uint64), *sets]), np.cumsum([0, *map(len, sets)]))


def _sets(docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """k and the set of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t, shingle) for t in utf8_column(batch.column("__text"))]
            yield pa.RecordBatch.from_pydict({"k": pa.array([set_key(s) for s in found], pa.int64()), "set": pa.array([s.tobytes() for s in found], pa.binary())})

    return modest_batches(docs.select(F.col(text).cast("string").alias("__text"))).mapInArrow(run, "k bigint, set binary")


def _marked(docs: DataFrame, text: str, keep: tuple[str, ...], shingle: int) -> DataFrame:
    """The kept columns, t (the text's digest), k (the set's key), n (its size), fp (its fingerprint) and bands."""
    keep = (*keep, "__t")
    src = docs.withColumn("__t", _digest(text)).select(*keep, F.col(text).cast("string").alias("__text"))
    new = [T.StructField("k", T.LongType()), T.StructField("n", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    schema = T.StructType([*(f for f in src.schema.fields if f.name != "__text"), *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t, shingle) for t in utf8_column(batch.column("__text"))]
            own = {"k": pa.array([set_key(s) for s in found], pa.int64()), "n": pa.array([len(s) for s in found], pa.int64()), "fp": pa.array(fingerprints(found), pa.int64()), "bands": pa.array([bands(s) for s in found], pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in keep} | own)

    return modest_batches(src).mapInArrow(run, schema).withColumnRenamed("__t", "t")


def _digest(text: str) -> Column:
    return F.xxhash64(F.col(text).cast("string"))


def by_fingerprints(distinct: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Candidates (a, b, not verified) that connect the sets whose fingerprints link: the first set of a fingerprint with its others,
    and with the first of each fingerprint that links. distinct: k, n, fp."""
    full = distinct.filter("n > 0").select("k", "n", "fp")
    firsts = saved(full.groupBy("fp").agg(F.min(F.struct("k", "n")).alias("x")).select("fp", "x.k", "x.n"), "near-fingerprints")
    a, b = (firsts.select(F.col("fp").alias(f"f{x}"), F.col("k").alias(x), F.col("n").alias(f"n{x}")) for x in ("a", "b"))
    own = full.select(F.col("fp").alias("fa"), F.col("k").alias("b"), F.col("n").alias("nb")).join(a, "fa").filter("a <> b")
    linked = simhash.links(firsts.select("fp")).select(F.col("a").alias("fa"), F.col("b").alias("fb")).join(a, "fa").join(b, "fb")
    return own.select("a", "b", "na", "nb").unionByName(linked.select("a", "b", "na", "nb")).filter(_close(similarity)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _close(similarity: float) -> Column:
    """Not too unlike in size."""
    return F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-9


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ([np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in ("sa", "sb"))
            sizes = [np.array([len(x) for x in s], np.int64) for s in (a, b)]
            shared = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b)], np.int64)
            yield batch.select(["a", "b"]).filter(pa.array(alike(shared, *sizes, similarity)))

    left, right = (sets.select(F.col("k").alias(x), F.col("set").alias(f"s{x}")) for x in ("a", "b"))
    return modest_batches(pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")).mapInArrow(run, "a bigint, b bigint")


def links(docs: DataFrame, distinct: DataFrame, text: str, shingle: int = SHINGLE, similarity: float = SIMILARITY, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """Verified links (a, b) that connect what all links between sets of one cell connect. distinct: t, k, n, fp, bands."""
    rows = distinct.select("k", "n", F.posexplode("bands").alias("band", "cell"))
    sizes = rows.groupBy("band", "cell").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    full = saved(rows.join(sizes, ["band", "cell"]), "near-cells")
    few, many = full.filter(F.col("held") <= small), full.filter(F.col("held") > small)
    a, b = (few.select("band", "cell", F.col("k").alias(x), F.col("n").alias(f"n{x}")) for x in ("a", "b"))
    pairs = a.join(b, ["band", "cell"]).filter((F.col("a") < F.col("b")) & _close(similarity)).select("a", "b")
    # Large cells: neighbours in a hashed order, in blocks that differ from band to band.
    dealt = many.withColumn("part", F.pmod(F.xxhash64("band", "k"), F.ceil(F.col("held") / block)))
    after = W.partitionBy("band", "cell", "part").orderBy(F.xxhash64("k"), "k")
    chain = dealt.select(F.col("k").alias("x"), F.lead("k").over(after).alias("y")).filter("y is not null").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    pairs = saved(pairs.union(chain).union(by_fingerprints(distinct, similarity)).distinct(), "near-pairs")
    # Only texts of sets in a pair are taken apart again, and one text of each such set.
    wanted = pairs.select(F.col("a").alias("k")).union(pairs.select("b")).distinct()
    wanted = distinct.select("k", "t").join(wanted, "k", "left_semi").select(F.col("t").alias("__t")).distinct()
    texts = docs.select(_digest(text).alias("__t"), F.col(text).alias(text)).join(wanted, "__t", "left_semi").dropDuplicates(["__t"])
    sets = saved(_sets(texts, text, shingle), "near-sets")
    found = saved(_verified(pairs, sets, similarity), "near-links")
    if not many.limit(1).count():
        release(docs.sparkSession, full, pairs, sets)
        return found
    # Large cells that still hold several classes: every pair of blocks.
    rooted = many.join(components(found), F.col("k") == F.col("node"), "left").withColumn("root", F.coalesce("root", "k")).drop("node")
    mixed = rooted.groupBy("band", "cell").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("band", "cell")
    open_ = saved(rooted.join(mixed, ["band", "cell"]), "near-open")
    if not open_.limit(1).count():
        return found
    blocks = F.ceil(F.col("held") / block).cast("int")
    mine = open_.withColumn("blocks", blocks).withColumn("i", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
    other = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: (F.col("blocks") == 1) | (j != F.col("i")))
    each = mine.select("band", "cell", "k", "i", F.explode(other).alias("j"))
    each = each.select("band", "cell", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "k").join(sets, "k")

    def run(table: pa.Table) -> pa.Table:
        keys = table.column("k").to_numpy()
        ends = np.array(forest([np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()], similarity), np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(keys[ends[:, 0]], pa.int64()), "b": pa.array(keys[ends[:, 1]], pa.int64())})

    local = each.repartition(deal(docs), "band", "cell", "lo", "hi").groupBy("band", "cell", "lo", "hi").applyInArrow(run, "a bigint, b bigint")
    return found.union(local)


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", keep: tuple[str, ...] = (), shingle: int = SHINGLE, similarity: float = SIMILARITY, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """Class of each document: rows of (id, kept columns, k, root), root the least key of a set that links reach.

    Null, empty and wordless texts are one class of their own, texts of less than shingle words equal each other or
    nothing. Rows with null ids take part; repeated rows stay. An empty table gives an empty result.
    """
    marked = saved(_marked(docs, text, (id_col, *keep), shingle), "near-marked")
    distinct = saved(marked.dropDuplicates(["k"]).select("t", "k", "n", "fp", "bands"), "near-distinct")
    joint = components(links(docs, distinct, text, shingle, similarity, small, block))
    out = marked.drop("t", "n", "fp", "bands").join(joint, F.col("k") == F.col("node"), "left")
    return out.withColumn("root", F.coalesce("root", "k")).drop("node")


def deduplicate(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each class: that of the least id, and of rows with the same id that of the least digest of
    its text; of equal rows one stays. Null ids come last. All columns stay."""
    digest = F.md5(F.col(text).cast("string"))
    keyed = docs.withColumn("__key", F.to_json(F.struct(F.col(id_col).alias("i"), digest.alias("h"))))
    classes = near_duplicates(keyed, text, id_col, ("__key",), shingle, similarity)
    first = F.min_by("__key", F.struct(F.col(id_col).isNull(), F.col(id_col), F.col("__key")))
    chosen = classes.groupBy("root").agg(first.alias("__key")).select("__key")
    return keyed.join(chosen, "__key", "left_semi").dropDuplicates(["__key"]).drop("__key")
