"""Passages of more than fifty words that also stand in another document, counted in words (beside operator 3's bytes).

A passage of 400 bytes has some seventy words, so a repeated passage of just over fifty words can be too short for the byte
rule. Windows of WORDS words are compared here in the same way as the byte strings: each has an anchor, the least-hashed
GRAM words in it, so equal windows meet at equal anchors; contexts of an anchor that are equal as a whole in two documents
need no further look. Where contexts differ, blocks of windows are compared by the words that all windows of the block share,
and single windows, by digest, only within blocks that meet but differ. A document is an id with its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.common import in_slices, modest_batches, powers, release, saved, spread_join, utf8_column

WORDS = 51
GRAM = 12
#: Windows of one block: those that start at the same distances from their anchor.
BLOCK = 8
SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_PLACES = np.uint64(0xFFFFFF)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


class _Rolling:
    """Digests of any range of a sequence of numbers, by prefix sums."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.inverse = np.append(powers(n, pow(_BASE, -1, 1 << 64)), np.uint64(1))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(n, _BASE), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.inverse[start])


def word_digests(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of the buffer starts, and its digest. Long buffers go through in parts of whole words."""
    solid = ~_SPACE[buffer]
    edge = np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE_BYTES, side="right")))
        part = _Rolling(buffer[starts[i] : ends[j - 1]].astype(np.uint64) + np.uint64(1))
        out[i:j] = part.of(starts[i:j] - starts[i], ends[i:j] - starts[i])
        i = j
    return starts, out


def word_anchors(digests: np.ndarray, ends: np.ndarray, words: int = WORDS, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, _Rolling]:
    """Anchors of all windows in texts of words that lie one after the other; ends: where each text ends. Returns place and
    digest of each anchor, the first of the windows that have it and their number."""
    n, window = len(digests), words - gram + 1
    rolling = _Rolling(digests)
    starts = np.concatenate([[0], ends[:-1]])
    full = ends - starts >= words
    if n < words or not full.any():
        none = np.empty(0, np.int64)
        return none, none.astype(np.uint64), none, none, rolling
    grams = np.arange(n - gram + 1)
    h = rolling.of(grams, grams + gram)
    # Leftmost of the least, by running minima over blocks; the place in the low bits tells equal digests apart.
    h_top, order = h & ~_PLACES, grams
    if len(h) <= int(_PLACES):
        keyed = h_top | grams.astype(np.uint64)
    else:  # the same order, by ranks
        order = np.argsort(h_top, kind="stable")
        keyed = np.empty(len(h), np.uint64)
        keyed[order] = grams.astype(np.uint64)
    grid = np.concatenate([keyed, np.full(-len(h) % window + window, ~np.uint64(0), np.uint64)]).reshape(-1, window)
    forth = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[: n - words + 1], forth[window - 1 : n - words + window])
    inside = np.zeros(n + 2, np.int64)
    np.add.at(inside, starts[full], 1)
    np.add.at(inside, ends[full] - words + 1, -1)
    valid = np.flatnonzero(np.cumsum(inside)[: n - words + 1] > 0)
    # The windows of one anchor lie side by side.
    at = order[(least[valid] & (_PLACES if order is grams else ~np.uint64(0))).astype(np.int64)]
    edge = np.flatnonzero(np.diff(at, prepend=-1))
    return at[edge], h[at[edge]], valid[edge], np.diff(np.append(edge, len(at))), rolling


def _key(text: str, id_col: str) -> list:
    body = F.col(text).cast("string")
    return [F.xxhash64(F.col(id_col), body).alias("u"), body.alias("t")]


def anchor_table(docs: DataFrame, text: str, id_col: str, words: int = WORDS, gram: int = GRAM) -> DataFrame:
    """u (document), a (anchor), c (digest of its windows), first (word of the first window), n (windows), l (words from
    there to the anchor)."""
    src = docs.select(*_key(text, id_col)).filter(F.octet_length("t") >= 2 * words - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = utf8_column(batch.column("t")), batch.column("u").to_numpy()
            for x, y in in_slices(texts, SLICE_BYTES):
                part = texts[x:y]
                begin, digests = word_digests(np.frombuffer(b" ".join(part), np.uint8))
                ends = np.searchsorted(begin, np.cumsum([len(t) + 1 for t in part]))
                at, h, first, n, rolling = word_anchors(digests, ends, words, gram)
                doc = np.searchsorted(ends, at, side="right")
                start = np.concatenate([[0], ends[:-1]])[doc]
                digest = _mixed(rolling.of(first, first + n + words - 1) + (at - first).astype(np.uint64))
                yield pa.RecordBatch.from_pydict({
                    "u": pa.array(ids[x:y][doc], pa.int64()), "a": pa.array(h.view(np.int64), pa.int64()), "c": pa.array(digest.view(np.int64), pa.int64()),
                    "first": pa.array((first - start).astype(np.int32), pa.int32()), "n": pa.array(n.astype(np.int16), pa.int16()), "l": pa.array((at - first).astype(np.int16), pa.int16()),
                })

    return modest_batches(src).mapInArrow(run, "u bigint, a bigint, c bigint, first int, n smallint, l smallint")


def _blocks(texts: DataFrame, places: DataFrame, words: int) -> DataFrame:
    """texts: k, body; places: k, u, a, first, n, l. The blocks of windows of each place: k, u, a, core (digest of what any
    window of the block holds), whole (of all that these windows hold), at (first window) and ws (their digests)."""
    lists = places.groupBy("k").agg(F.collect_list(F.struct("u", "a", "first", "n", "l")).alias("xs"))
    source = modest_batches(texts.join(lists, "k").select("k", "body", "xs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, body, xs in zip(batch.column("k").to_pylist(), batch.column("body").to_pylist(), batch.column("xs")):
                u, a, first, n, l = (xs.values.flatten()[i].to_numpy().astype(np.int64) for i in range(5))
                rolling = _Rolling(word_digests(np.frombuffer(body, np.uint8))[1])
                row = np.repeat(np.arange(len(n)), n)
                step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                at, number = first[row] + step, (l[row] - step) // BLOCK
                w = rolling.of(at, at + words)
                edge = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(number, prepend=-1) != 0))
                size = np.diff(np.append(edge, len(row)))
                row, number, at = row[edge], number[edge], at[edge]
                anchor = first[row] + l[row]
                core = _mixed(rolling.of(anchor - number * BLOCK, anchor - number * BLOCK - BLOCK + 1 + words) + number.astype(np.uint64))
                whole = _mixed(rolling.of(at, at + size + words - 1) + (anchor - at).astype(np.uint64))
                yield pa.RecordBatch.from_pydict({
                    "k": pa.array([k] * len(row), pa.binary()), "u": pa.array(u[row], pa.int64()), "a": pa.array(a[row], pa.int64()), "core": pa.array(core.view(np.int64), pa.int64()), "whole": pa.array(whole.view(np.int64), pa.int64()),
                    "at": pa.array(at.astype(np.int32), pa.int32()), "ws": pa.ListArray.from_arrays(pa.array(np.append(edge, len(w)).astype(np.int32), pa.int32()), pa.array(w.view(np.int64), pa.int64())),
                })

    return source.mapInArrow(run, "k binary, u bigint, a bigint, core bigint, whole bigint, at int, ws array<bigint>")


class SharedPassages:
    """Two steps, with the bodies of the texts named by `needed` between them."""

    def __init__(self, docs: DataFrame, text: str = "text", id_col: str = "doc_id", words: int = WORDS, gram: int = GRAM):
        if words - gram < BLOCK:
            raise ValueError("a window holds at least a block's length more words than a gram")
        self.words, self.spark = words, docs.sparkSession
        rows = F.count(F.lit(1)).alias("rows")
        table = saved(anchor_table(docs, text, id_col, words, gram), "passage-anchors")
        shared = saved(table.groupBy("a").agg(rows, (F.min("u") != F.max("u")).alias("many"), (F.min("c") != F.max("c")).alias("mixed")).filter("many").select("a", "rows", "mixed"), "passage-shared")
        met = saved(spread_join(table, shared, ["a"], "rows").drop("rows"), "passage-rows")
        release(self.spark, table, shared)
        cells = saved(met.groupBy("a", "c").agg(rows, F.min("u").alias("lo"), F.max("u").alias("hi")), "passage-cells")
        marked = saved(spread_join(met, cells, ["a", "c"], "rows").drop("rows"), "passage-marked")
        release(self.spark, met, cells)
        names = docs.select(*_key(text, id_col)).select("u", F.unhex(F.md5("t")).alias("k")).filter("k is not null").distinct()
        whole = marked.filter("lo <> hi").select("u", F.col("first").alias("low"), (F.col("first") + F.col("n") + words - 1).alias("high")).distinct()
        # Of a cell in many documents two stand for all: one of them is another document to any.
        places = marked.filter("mixed and (lo = hi or u = lo or u = hi)").select("u", "a", "first", "n", "l").distinct()
        # Copies of a text have the same spans, which meet as one.
        self.spans = saved(whole.join(names, "u").select("k", "low", "high").distinct(), "passage-spans")
        self.places = saved(places.join(names, "u").select("k", "u", "a", "first", "n", "l"), "passage-places")
        release(self.spark, marked)
        self.needed = self.places.select("k").distinct()

    def counts(self, texts: DataFrame) -> DataFrame:
        """k and n_passage_words, the words of the text that windows found in another document cover."""
        rows, many = F.count(F.lit(1)).alias("rows"), (F.min("u") != F.max("u")).alias("many")
        blocks = saved(_blocks(texts.select("k", "body"), self.places, self.words), "passage-blocks")
        met = saved(blocks.groupBy("a", "core").agg(rows, many, (F.min("whole") != F.max("whole")).alias("mixed")).filter("many").select("a", "core", "rows", "mixed"), "passage-met")
        hits = saved(spread_join(blocks, met, ["a", "core"], "rows").drop("rows", "whole", "core"), "passage-hits")
        release(self.spark, blocks)
        same = hits.filter("not mixed").select("k", F.col("at").alias("low"), (F.col("at") + F.size("ws") - 1 + self.words).alias("high"))
        windows = saved(hits.filter("mixed").select("k", "u", "a", "at", F.posexplode("ws").alias("i", "w")).select("k", "u", "a", "w", (F.col("at") + F.col("i")).alias("at")), "passage-windows")
        shared = saved(windows.groupBy("a", "w").agg(rows, many).filter("many").select("a", "w", "rows"), "passage-windows-met")
        single = spread_join(windows, shared, ["a", "w"], "rows").select("k", F.col("at").alias("low"), (F.col("at") + self.words).alias("high"))
        spans = self.spans.union(same).union(single).distinct()
        lists = spans.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias("spans"))
        step = lambda s, x: F.struct((s["n"] + F.greatest(x["high"] - F.greatest(x["low"], s["end"]), F.lit(0))).alias("n"), F.greatest(x["high"], s["end"]).alias("end"))
        covered = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda s: s["n"])
        return lists.select("k", covered.cast("long").alias("n_passage_words"))
