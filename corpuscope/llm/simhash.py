"""SimHash near-duplicates (operator 7) by segment popcounts.

A fingerprint is 32 segments of two bits; its embedding holds the number of one bits of each. Manhattan distance
between two embeddings is at most the Hamming distance of the fingerprints, so a range join of radius 3 over the
embeddings loses no link. The grid: the segments are cut into groups, and of six groups at least three carry no
difference, so fingerprints that link share one of the 20 cells that three groups' counts make. Inside a cell the lower
bound and then the exact distance are tested. Cells by their number of different fingerprints:
up to SMALL, a join that emits verified links only; up to LARGE, a local forest of the links (a row a fingerprint at
most); beyond, the cell's fingerprints are dealt anew by the exact bits of 13 out of 16 groups, which leaves 12 free
bits and so at most 4096 fingerprints in a cell, whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscope.llm.common import deal, in_slices, modest_batches, saved, utf8_column
from corpuscope.llm.components import components

RADIUS = 3
SMALL, LARGE = 64, 4096
SHINGLE = 3
SEED = 42
LOW_BITS = 0x5555555555555555
SLICE_BYTES = 4 << 20


def fingerprints_of(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """Fingerprints of whole texts as signed 64-bit integers."""
    hashes, first = [], np.zeros(len(texts) + 1, np.int64)
    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        words = text.lower().split()  # bytes: A-Z and ASCII white space only
        if len(words) <= shingle:
            if words:
                hashes.append(digest(b" ".join(words), SEED))
        else:
            line = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words])
            starts = [0, *ends[:-shingle].tolist()]
            hashes += [digest(line[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())]
        first[i + 1] = len(hashes)
    return majority(np.array(hashes, np.uint64), first)


def majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Bits set in over half of each text's hashes. Eight bits at a time are summed in the bytes of one word, over
    runs of at most 255 hashes."""
    out = np.zeros(len(first) - 1, np.uint64)
    sizes = np.diff(first)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out.view(np.int64)
    runs = -(-sizes[full] // 255)
    head = np.cumsum(runs) - runs
    at = np.repeat(first[full], runs) + 255 * (np.arange(runs.sum()) - np.repeat(head, runs))
    for s in range(8):
        lanes = (hashes >> np.uint64(s)) & np.uint64(0x0101010101010101)
        counts = np.add.reduceat(lanes, at).view(np.uint8).reshape(-1, 8).astype(np.int64)
        over = np.add.reduceat(counts, head, axis=0) * 2 > sizes[full, None]
        for byte in range(8):
            out[full] |= over[:, byte].astype(np.uint64) << np.uint64(8 * byte + s)
    return out.view(np.int64)


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and fp, the fingerprint as a signed long. A null or wordless text has 0."""
    src = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = T.StructType([*(f for f in src.schema.fields if f.name != "__text"), T.StructField("fp", T.LongType())])
    names = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8_column(batch.column("__text"))
            found = [fingerprints_of(texts[a:b]) for a, b in in_slices(texts, SLICE_BYTES)]
            yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in names} | {"fp": pa.array(np.concatenate(found) if found else [], pa.int64())})

    return modest_batches(src).mapInArrow(run, schema)


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def group_masks(groups: int) -> list[int]:
    """The bits of each group of segments: the 32 segments dealt as evenly as they go."""
    edges = [round(32 * g / groups) for g in range(groups + 1)]
    return [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(edges, edges[1:])]


def embedding(fp: Column) -> Column:
    """One-bit counts of the 32 segments, two bits each, in one long."""
    low = F.lit(LOW_BITS)
    upper = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseXOR(upper).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(upper).bitwiseAND(low), 1))


def manhattan(a: Column, b: Column) -> Column:
    """Distance of two embeddings: fields that differ in their low bit differ by one, in the high bit only by two."""
    apart = a.bitwiseXOR(b)
    odd = apart.bitwiseAND(F.lit(LOW_BITS))
    even = F.shiftrightunsigned(apart, 1).bitwiseAND(F.lit(LOW_BITS)).bitwiseAND(F.bitwise_not(odd))
    return F.bit_count(odd) + 2 * F.bit_count(even)


def cells(fps: DataFrame, groups: int, by: str) -> DataFrame:
    """Every fingerprint with its cells: grid (which groups), cell (their values in column `by`)."""
    masks = group_masks(groups)
    grids = [_signed(sum(masks[g] for g in chosen)) for chosen in combinations(range(groups), groups - RADIUS)]
    return fps.select("fp", "v", F.explode(F.array(*map(F.lit, grids))).alias("grid")).select("fp", "v", "grid", F.col("grid").bitwiseAND(F.col(by)).alias("cell"))


def _joined(rows: DataFrame) -> DataFrame:
    """Verified links within small cells."""
    a = rows.select("grid", "cell", F.col("fp").alias("a"), F.col("v").alias("va"))
    b = rows.select("grid", "cell", F.col("fp").alias("b"), F.col("v").alias("vb"))
    near = (F.col("a") < F.col("b")) & (manhattan(F.col("va"), F.col("vb")) <= RADIUS) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)
    return a.join(b, (a["grid"] == b["grid"]) & (a["cell"] == b["cell"]) & near).select("a", "b")


def forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of at most RADIUS bits that connect what all such links connect: breadth first, so one link a node."""
    left = np.sort(fps.view(np.uint64))
    ends, starts = [], []
    queue: list[np.uint64] = []
    while len(left):
        if not queue:
            queue, left = [left[0]], left[1:]
            continue
        node = queue.pop()
        near = np.bitwise_count(left ^ node) <= RADIUS
        if near.any():
            found = left[near]
            left = left[~near]
            starts.append(np.full(len(found), node, np.uint64))
            ends.append(found)
            queue += list(found)
    none = np.empty(0, np.uint64)
    return np.concatenate([none, *starts]).view(np.int64), np.concatenate([none, *ends]).view(np.int64)


def _local(rows: DataFrame) -> DataFrame:
    """A forest of each cell of at most LARGE fingerprints."""

    def run(table: pa.Table) -> pa.Table:
        a, b = forest(table.column("fp").to_numpy().copy())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.select("grid", "cell", "fp").groupBy("grid", "cell").applyInArrow(run, "a bigint, b bigint")


def links(fps: DataFrame, groups: int = 6, by: str = "v", small: int = SMALL, large: int = LARGE) -> DataFrame:
    """Links (a, b) between different fingerprints (column fp, distinct) that connect all that lie RADIUS bits apart
    or nearer. Every row is a verified link."""
    rows = cells(fps.select("fp", embedding(F.col("fp")).alias("v")), groups, by).repartition(deal(fps), "grid", "cell")
    sizes = rows.groupBy("grid", "cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    full = saved(rows.join(sizes, ["grid", "cell"]), "cells")
    bounded = f" and n <= {large}" if by == "v" else ""  # exact bits bound a cell by themselves
    found = _joined(full.filter(f"n <= {small}")).union(_local(full.filter(f"n > {small}{bounded}")))
    if by == "v" and full.filter(f"n > {large}").limit(1).count():
        hot = saved(full.filter(f"n > {large}").select("fp").distinct(), "hot-fingerprints")
        found = found.union(links(hot, 16, "fp", small, large))
    return found


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", keep: tuple[str, ...] = (), small: int = SMALL, large: int = LARGE) -> DataFrame:
    """Class of each document: rows of (id, kept columns, fp, component_id, root): the least id and the least fingerprint
    that links reach.

    Words are lower-cased in A-Z; a fingerprint bit is set if over half of the 3-word shingles' XXH64 have it; texts
    of one or two words are one shingle; null, empty and wordless texts have fingerprint zero and link like any other.
    Equal fingerprints link, so they are taken together before anything else. Rows with a null id take part and keep
    their row; a class of only null ids has a null component_id. Repeated rows stay. An empty table gives an empty
    result.
    """
    marked = saved(fingerprints(docs, text, (id_col, *keep)), "fingerprints")
    distinct = saved(marked.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct-fingerprints")
    joint = components(links(distinct.select("fp"), small=small, large=large))
    rooted = distinct.join(joint, distinct["fp"] == joint["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(least, "root").select(F.col("fp").alias("__fp"), "component_id", "root")
    return marked.join(classes, marked["fp"] == classes["__fp"]).drop("__fp")


def deduplicate(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with one row of each class: that of the least id, and of rows with the same id that of the least digest of
    its text; of equal rows one stays. Null ids come last. All columns stay."""
    digest = F.md5(F.col(text).cast("string"))
    keyed = docs.withColumn("__key", F.to_json(F.struct(F.col(id_col).alias("i"), digest.alias("h"))))
    classes = near_duplicates(keyed, text, id_col, ("__key",))
    first = F.min_by("__key", F.struct(F.col(id_col).isNull(), F.col(id_col), F.col("__key")))
    chosen = classes.groupBy("root").agg(first.alias("__key")).select("__key")
    return keyed.join(chosen, "__key", "left_semi").dropDuplicates(["__key"]).drop("__key")
