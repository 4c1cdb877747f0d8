"""Packing of documents into sequences of tokens (operator 13).

A document's ids are cut into whole sequences and a rest. The rests' lengths, by class, are a cutting-stock problem that column
generation solves on the driver (`cutting`; its size is that of the classes). Its patterns are dealt to the documents by their
ranks within the classes: a range of ranks takes a range of sequences. A sequence that stays too empty is cut at powers of two,
which need no padding.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuscope.llm.align import byte_letters
from corpuscope.llm.common import data_path, deal, in_slices, modest_batches, saved, utf8_column
from corpuscope.llm.cutting import TOLERANCE, cut
from corpuscope.llm.sharding import ROWS_A_TASK, _numbered

VOCABULARY = "word_bpe_49k.json"
LENGTH, END = 4096, 2
#: Lengths of a class differ by less than this part of them.
CLASS_PART = 96
#: A sequence whose padding is more than this part of it is cut at powers of two.
GAP_PART = 100
#: Pieces of cut sequences, of some 100 bytes each, that are broadcast.
FEW_PARTS = 100_000
#: Bytes of text encoded at a time, and words and bytes of words that a Python worker remembers.
SLICE_BYTES, MOST_WORDS, MOST_BYTES = 4 << 20, 800_000, 32 << 20
#: Units that go to the merges as one line, and new words encoded at a time.
UNITS, PART_WORDS = 64, 16384
#: Whether a byte belongs to a word.
SOLID = ~np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))


class WordEncoder:
    """A tokenizer that never joins anything over white space: words are encoded once and kept. Words of letters up to U+00FF,
    with signs behind them or not, go to the merges directly: normalising only lower-cases them, and the signs are one unit."""

    PLAIN = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([.,;:!?)]*)")
    #: The letters that stand for bytes in the vocabulary; spaces stay between units.
    LETTERS = {b: letter for letter, b in byte_letters().items() if b != 0x20}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        #: Only the merges, for units between spaces; the last token of a unit bears the vocabulary's mark.
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = WhitespaceSplit()
        entries = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(entries.values()) + 1, bool)
        self.last[[i for entry, i in entries.items() if entry.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.held = 0
        self.first = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of plain units, and how many each has."""
        lines = [b" ".join(units[i : i + UNITS]).decode().lower() for i in range(0, len(units), UNITS)]
        lines = [x if x.isascii() else x.encode().decode("latin-1").translate(self.LETTERS) for x in lines]
        ids = np.fromiter(chain.from_iterable(x.ids for x in self.merges.encode_batch_fast(lines, add_special_tokens=False)), np.uint32)
        return ids, np.diff(np.flatnonzero(self.last[ids]), prepend=-1)

    def learn(self, words: list[bytes]) -> None:
        for i in range(0, len(words), PART_WORDS):
            self._learn(words[i : i + PART_WORDS])

    def _learn(self, words: list[bytes]) -> None:
        units: dict[bytes, int] = {}
        parts, n_parts, rest = [], [], []  # units of the words, from the end the words that aren't plain
        for w, m in zip(words, map(self.PLAIN.fullmatch, words)):
            if m is None:
                rest.append(w.decode())
                parts.append(-len(rest))
                n_parts.append(1)
                continue
            letters, signs = m.groups()
            parts.append(units.setdefault(letters, len(units)))
            if signs:
                parts.append(units.setdefault(signs, len(units)))
            n_parts.append(2 if signs else 1)
        ids, n = self._units(list(units))
        other = [x.ids for x in self.tokenizer.encode_batch_fast(rest[::-1], add_special_tokens=False)]
        ids = np.concatenate((ids, np.fromiter(chain.from_iterable(other), np.uint32)))
        n = np.concatenate((n, np.fromiter(map(len, other), np.int64, len(other))))
        at = np.array(parts, np.int64)
        first, size = (np.cumsum(n) - n)[at], n[at]
        total = np.cumsum(size)
        self.index.update(zip(words, range(len(self.index), len(self.index) + len(words))))
        self.held += sum(map(len, words))
        self.first = np.concatenate((self.first, self.first[-1] + total[np.cumsum(n_parts) - 1]))
        self.ids = np.concatenate((self.ids, ids[np.repeat(first - total + size, size) + np.arange(total[-1])]))

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.index) > MOST_WORDS or self.held > MOST_BYTES:
            self.forget()
        # All words of the slice are numbered at once; only different ones become Python objects.
        raw = np.frombuffer(b" ".join(texts), np.uint8)
        solid = SOLID[raw]
        edge = np.flatnonzero(np.diff(solid, prepend=False, append=False))
        begin = edge[::2]
        ends = np.concatenate(([0], np.cumsum(edge[1::2] - begin)))
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(raw[solid])]).dictionary_encode()
        body, at = words.dictionary.buffers()[2], np.frombuffer(words.dictionary.buffers()[1], np.int64)[: len(words.dictionary) + 1].tolist()
        body = body.to_pybytes() if body else b""
        kinds = [body[i:j] for i, j in zip(at, at[1:])]
        if new := [w for w in kinds if w not in self.index]:
            self.learn(new)
        places = np.fromiter(map(self.index.__getitem__, kinds), np.int64, len(kinds))[words.indices.to_numpy()]
        bounds = np.searchsorted(begin, np.cumsum([0, *(len(t) + 1 for t in texts)])).tolist()
        out = []
        for a, b in zip(bounds, bounds[1:]):
            at = places[a:b]
            first = self.first[at]
            n = self.first[at + 1] - first
            total = np.cumsum(n)
            out.append(self.ids[np.repeat(first - total + n, n) + np.arange(total[-1])] if len(at) else self.ids[:0])
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pieces(docs: DataFrame, path: str | None = None, text: str = "text", id_col: str = "doc_id", length: int = LENGTH, end: int = END) -> DataFrame:
    """The ids of every document, the end's behind them, in pieces of `length` and a rest: row (a number of the piece), id, start,
    length, ids_crc32, doc_tokens and ids (little-endian unsigned 32-bit integers)."""
    path = path or data_path(VOCABULARY)
    src = docs.select(F.col(id_col).alias("__id"), F.col(text).cast("string").alias("__text"))
    schema = f"row bigint, __id {src.schema['__id'].dataType.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, row = encoder(path), TaskContext.get().partitionId() << 40
        for batch in batches:
            raw = utf8_column(batch.column("__text"))
            for i, j in in_slices(raw, SLICE_BYTES):
                of, start, held, tokens = [], [], [], []
                for k, ids in enumerate(own.encode(raw[i:j]), i):
                    ids = np.append(ids, np.uint32(end)).astype("<u4")
                    for s in range(0, len(ids), length):
                        of.append(k)
                        start.append(s)
                        held.append(ids[s : s + length].tobytes())
                        tokens.append(len(ids))
                columns = {"row": pa.array(np.arange(row, row + len(of)), pa.int64()), "__id": batch.column("__id").take(pa.array(of, pa.int64())), "start": pa.array(start, pa.int64())}
                columns |= {"length": pa.array([len(x) // 4 for x in held], pa.int64()), "ids_crc32": pa.array([zlib.crc32(x) for x in held], pa.int64()), "doc_tokens": pa.array(tokens, pa.int64()), "ids": pa.array(held, pa.binary())}
                row += len(of)
                yield pa.RecordBatch.from_pydict(columns)

    return modest_batches(src).mapInArrow(run, schema)


def class_ends(length: int, part: int = CLASS_PART) -> list[int]:
    """The longest length of each class; short ones are classes of their own."""
    out = [1]
    while out[-1] < length - 1:
        out.append(min(out[-1] + max(1, out[-1] // part), length - 1))
    return [*out, length]


def _class(length: Column, ends: list[int]) -> Column:
    return (F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e < length))).cast("int")


def plan(rests: DataFrame, length: int, tolerance: float = TOLERANCE) -> tuple[DataFrame, int]:
    """rests: class, length. Ranges of ranks: class, from, upto, per (pieces of the class in each sequence), sequence (the
    first's), slot; and the number of sequences. As many rows as patterns have classes, of which there are a few hundred."""
    counted = sorted(rests.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("longest")).collect())  # one row a class
    found = cut([r["longest"] for r in counted], [r["n"] for r in counted], length, tolerance)
    taken, rows, sequence = [0] * len(counted), [], 0
    for pattern, times in found:
        slot = 0
        for i, per in sorted(pattern.items()):
            rows.append((counted[i]["class"], taken[i], taken[i] + per * times, per, sequence, slot))
            taken[i] += per * times
            slot += per
        sequence += times
    schema = "class int, `from` bigint, upto bigint, per int, sequence bigint, slot int"
    return rests.sparkSession.createDataFrame(rows, schema), sequence


def pack(docs: DataFrame, path: str | None = None, text: str = "text", id_col: str = "doc_id", length: int = LENGTH, end: int = END, ids: bool = False, tolerance: float = TOLERANCE) -> DataFrame:
    """One row for each piece: id, start (its document's ids before it), length, ids_crc32, doc_tokens, sequence_id, offset (in
    the sequence, gapless from 0), and with ids=True its ids as little-endian unsigned 32-bit integers. `length` is a power
    of two.

    A sequence is padded to `length` unless its size is a power of two; those with more than a hundredth of padding are cut so
    that none is left. A null or empty text has the end's id alone. Repeated rows are documents of their own. Columns besides
    these are dropped. An empty table gives an empty result.
    """
    if length < 2 or length & (length - 1):
        raise ValueError("the length of sequences must be a power of two")
    table = saved(pieces(docs, path, text, id_col, length, end), "pack-pieces")
    ends = class_ends(length)
    narrow = table.drop("ids").withColumn("class", _class(F.col("length"), ends))
    buckets = max(4 * deal(docs), -(-table.count() // ROWS_A_TASK))
    ranked = saved(_numbered(narrow, ["class"], ["row"], ["row"], buckets, "rank"), "pack-ranks")
    full = F.col("class") == len(ends) - 1  # a piece as long as a sequence is one
    ranges, packed = plan(ranked.filter(~full), length, tolerance)
    n_whole = ranked.filter(full).count()
    rank = F.col("rank") - F.col("from")
    place = ranked.filter(~full).join(F.broadcast(ranges), "class").filter((F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("upto")))
    place = place.withColumn("sequence_id", F.col("sequence") + F.floor(rank / F.col("per"))).withColumn("slot", F.col("slot") + F.pmod(rank, F.col("per"))).drop("from", "upto", "per", "sequence")
    of = W.partitionBy("sequence_id")
    before = F.sum("length").over(of.orderBy("slot").rowsBetween(W.unboundedPreceding, 0)) - F.col("length")
    place = place.withColumn("offset", before).withColumn("total", F.sum("length").over(of)).drop("slot")
    whole = ranked.filter(full).withColumn("sequence_id", F.lit(packed) + F.col("rank")).withColumn("offset", F.lit(0).cast("bigint")).withColumn("total", F.lit(length).cast("bigint"))
    place = saved(place.unionByName(whole).drop("class", "rank"), "pack-places")
    loose = (F.lit(length) - F.col("total") > length // GAP_PART) & (F.expr("bit_count(total)") > 1)
    kept = place.filter(~loose).drop("total")
    kept = kept.join(table.select("row", "ids"), "row") if ids else kept
    # The powers of two in a sequence's total, the largest first, are sequences of their own; the first keeps its number.
    bits = length.bit_length() - 1
    power = F.explode(F.expr(f"filter(sequence({bits}, 0), b -> getbit(total, b) = 1)"))
    parts = place.filter(loose).withColumn("bit", power).withColumn("first", F.expr("shiftleft(shiftright(total, bit + 1), bit + 1)")).withColumn("last", F.expr("first + shiftleft(1L, bit)"))
    parts = parts.filter((F.col("offset") < F.col("last")) & (F.col("offset") + F.col("length") > F.col("first")))
    skip = F.greatest(F.col("first") - F.col("offset"), F.lit(0))
    own = F.least(F.col("last"), F.col("offset") + F.col("length")) - F.greatest("first", "offset")
    more = F.expr("bit_count(shiftright(total, bit + 1))")  # larger powers
    number = F.when(more == 0, F.col("sequence_id")).otherwise(F.lit(packed + n_whole) + F.col("sequence_id") * bits + more - 1)
    parts = parts.select("row", "__id", (F.col("start") + skip).alias("start"), own.alias("length"), "doc_tokens", number.alias("sequence_id"), F.greatest(F.col("offset") - F.col("first"), F.lit(0)).alias("offset"), skip.alias("skip"))
    bytes_ = F.substring(F.col("ids"), (F.col("skip") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int"))
    if parts.count() <= FEW_PARTS:  # else the ids of all documents would be shuffled for a few
        parts = F.broadcast(parts)
    parts = table.select("row", "ids").join(parts, "row").withColumn("ids", bytes_).withColumn("ids_crc32", F.crc32("ids"))
    columns = [F.col("__id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if ids else [])]
    return kept.select(*columns).unionByName(parts.select(*columns))
