"""Alignment of two tokenizers' tokens (operator 12).

The tokens of B lie on the bytes of a text like closed intervals; the sorted ends are their static index. Two bisections
give each token of A the list of B's tokens that it overlaps, and the gaps between B's tokens that no token of A spans are
the borders of groups. Both tokenizers work inside runs of text that begin with a single space between other characters, so
a run is encoded and aligned once and kept; a text with a run whose bytes don't come back is encoded as a whole.

The links of a batch of documents are kept as its distinct runs and pairs. The counts of pairs over all documents are summed
by Spark, joined to the pairs of each batch (those that stand in many batches by broadcast), and meet the batch's documents
in one bounded group.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuscope.llm.common import data_path, in_slices, modest_batches, saved, spread_join, utf8_column

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text whose distinct runs and pairs are kept together.
BATCH_BYTES = 4 << 20
#: Characters of text cut into runs at a time, and new runs encoded at a time: what the tokenizers return for a run is far larger.
PART_SIZE, PART_RUNS = 256 << 10, 4096
#: Runs and bytes of runs that a Python worker remembers.
MOST_RUNS, MOST_BYTES = 250_000, 16 << 20
#: A space next to other white space; U+180E was white space once.
UNEVEN = re.compile("[\\s᠎] | [\\s᠎]")
CUT = re.compile("(?<=[^\\s᠎])(?= [^\\s᠎])")


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of tokens that follow each other over the same bytes, by their ends: the first and the last token of B that each of A
    overlaps, and whether a group ends with each token of B."""
    starts = np.concatenate(([0], ends_a[:-1]))
    first = np.searchsorted(ends_b, starts, "right")
    last = np.searchsorted(ends_b, ends_a, "left")
    spans = np.cumsum(np.bincount(first, minlength=len(ends_b)) - np.bincount(last, minlength=len(ends_b)))
    return first, last, spans == 0


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, the others in order
    from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def runs_of(text: str) -> list[str]:
    """The text cut before each single space between other characters; what both tokenizers do inside a run doesn't depend
    on its neighbours."""
    if UNEVEN.search(text):
        return CUT.split(text)
    parts = text.split(" ")
    tail = 2 if not parts[0] else 1  # a text that begins with its space
    out = [" ".join(parts[:tail]), *(" " + p for p in parts[tail:])]
    if len(out) > 1 and out[-1] == " ":  # a space at the end belongs to what is before it
        out[-2:] = [out[-2] + " "]
    return out


class Aligner:
    """The two tokenizers, and what they make of each run seen so far."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        entries = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.bytes_a[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        self.n_b = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.n_b)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.len_a, self.len_b = (np.array([len(x) for x in kind], np.int64) for kind in (self.bytes_a, self.bytes_b))
        #: A piece that goes on over a space would tie a run to the next one.
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.held = 0
        self.names: list[str] = []  # each run's groups, empty for a run whose bytes don't come back
        self.sizes = np.zeros((0, 4), np.int64)  # n_a, n_b, n_groups, n_links
        self.first = np.zeros(1, np.int64)  # of each run's pairs
        self.pairs = np.zeros(0, np.int64)  # id of A * n_b + id of B

    def learn(self, runs: list[str]) -> None:
        """Encodes and aligns runs that aren't known yet, in parts."""
        parts = [self._learn(runs[i : i + PART_RUNS]) for i in range(0, len(runs), PART_RUNS)]
        sizes = np.concatenate([x for x, _ in parts])
        self.sizes = np.concatenate((self.sizes, sizes))
        self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(sizes[:, 3])))
        self.pairs = np.concatenate((self.pairs, *(x for _, x in parts)))

    def _learn(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and pairs of runs, all of them as one row of tokens."""
        self.index |= {r: len(self.names) + i for i, r in enumerate(runs)}
        self.held += sum(map(len, runs))
        ids_a = [x.ids for x in self.a.encode_batch_fast(runs, add_special_tokens=False)]
        ids_b = self.b.encode([r[1:] for r in runs], num_threads=1)  # B adds the space itself
        lists, raws, back = [], [r.encode() for r in runs], [True] * len(runs)
        for ids, known in ((ids_a, self.bytes_a), (ids_b, self.bytes_b)):
            n = np.fromiter(map(len, ids), np.int64, len(runs))
            flat = list(chain.from_iterable(ids))
            held = b"".join(map(known.__getitem__, flat))
            size = np.concatenate(([0], np.cumsum(np.fromiter(map(len, map(known.__getitem__, flat)), np.int64, len(flat)))))
            at = size[np.concatenate(([0], np.cumsum(n)))].tolist()
            back = [ok and held[i:j] == raw for ok, i, j, raw in zip(back, at, at[1:], raws)]
            lists.append((np.array(flat, np.int64), n))
        good = np.flatnonzero(back)
        sizes, pairs = np.zeros((len(runs), 4), np.int64), np.zeros(0, np.int64)
        names = [""] * len(runs)
        if len(good):
            (flat_a, n_a), (flat_b, n_b) = ((flat[np.repeat(back, n)], n[good]) for flat, n in lists)
            first, last, ends = overlaps(np.cumsum(self.len_a[flat_a]), np.cumsum(self.len_b[flat_b]))
            times = last - first + 1
            total = np.cumsum(times)
            partner = np.repeat(first - (total - times), times) + np.arange(total[-1])
            pairs = np.repeat(flat_a, times) * self.n_b + flat_b[partner]
            upto = lambda values, n: np.diff(np.concatenate(([0], np.cumsum(values)))[np.concatenate(([0], np.cumsum(n)))])
            sizes[good] = np.stack((n_a, n_b, upto(ends, n_b), upto(times, n_a)), 1)
            group_b = np.cumsum(ends) - ends
            border_a, border_b = np.flatnonzero(np.diff(group_b[first])) + 1, np.flatnonzero(ends)[:-1] + 1
            text_a, text_b = list(map(str, flat_a.tolist())), list(map(str, flat_b.tolist()))
            cut = lambda text, borders: [",".join(text[i:j]) for i, j in zip([0, *borders.tolist()], [*borders.tolist(), len(text)])]
            groups = [f"{x}|{y}" for x, y in zip(cut(text_a, border_a), cut(text_b, border_b))]
            at = np.concatenate(([0], np.cumsum(sizes[good, 2]))).tolist()
            for k, i, j in zip(good.tolist(), at, at[1:]):
                names[k] = ";".join(groups[i:j])
        self.names += names
        return sizes, pairs

    def runs(self, texts: list[str | None]) -> list[np.ndarray]:
        """The numbers of each text's runs, none where it has no tokens."""
        if len(self.index) > MOST_RUNS or self.held > MOST_BYTES:
            self.forget()
        return [x for i, j in in_slices([t or "" for t in texts], PART_SIZE) for x in self._runs(texts[i:j])]

    def _runs(self, texts: list[str | None]) -> list[np.ndarray]:
        cut = [([] if not t else runs_of(f" {t}") if self.cuts else [f" {t}"]) for t in texts]
        for whole in (False, True):  # once more for texts whose bytes don't come back run by run
            if new := list(dict.fromkeys(r for runs in cut for r in runs if r not in self.index)):
                self.learn(new)
            found = [np.fromiter(map(self.index.__getitem__, runs), np.int64, len(runs)) for runs in cut]
            bad = [k for k, at in enumerate(found) if len(at) and not self.sizes[at, 0].all()]
            for k in bad:
                cut[k] = [] if whole or len(cut[k]) == 1 else [f" {texts[k]}"]
            if not bad:
                break
        return [at if len(runs) else at[:0] for at, runs in zip(found, cut)]


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0] .. first[0] + n[0] - 1, and so on."""
    total = np.cumsum(n)
    return np.repeat(first - (total - n), n) + np.arange(total[-1] if len(total) else 0)


def grouped(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, text: str = "text", id_col: str = "doc_id", groups: bool = False) -> DataFrame:
    """A row for each row of docs: its batch, id, sizes and digest of groups (with groups=True also the groups themselves), the
    runs it consists of, and with each batch's first row the runs' pairs."""
    path_a, path_b = path_a or data_path(A_FILE), path_b or data_path(B_FILE)
    src = docs.select(F.col(id_col).alias("__id"), F.col(text).cast("string").alias("__text"))
    kind = src.schema["__id"].dataType.simpleString()
    schema = f"batch bigint, __id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, {'groups string, ' if groups else ''}runs array<int>, pairs array<bigint>, times array<bigint>, run_pairs array<int>, run_first array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number = aligner(path_a, path_b), TaskContext.get().partitionId() << 32
        for batch in batches:
            raw = utf8_column(batch.column("__text"))
            for i, j in in_slices(raw, BATCH_BYTES):
                found = own.runs([x.decode() for x in raw[i:j]])
                flat = np.concatenate(found)
                seen = np.bincount(flat, minlength=len(own.names))
                used = np.flatnonzero(seen)
                local = np.cumsum(seen > 0) - 1
                links = own.sizes[used, 3]
                pairs, at = np.unique(own.pairs[_ranges(own.first[used], links)], return_inverse=True)
                times = np.bincount(at, weights=np.repeat(seen[used], links).astype(np.float64), minlength=len(pairs)).astype(np.int64)
                sizes = np.stack([own.sizes[x].sum(0) for x in found])
                names = (";".join([own.names[k] for k in x.tolist()]) for x in found)
                one = lambda values, t: pa.array([values, *[None] * (j - i - 1)], pa.list_(t))
                columns = {"batch": pa.array([number] * (j - i), pa.int64()), "__id": batch.column("__id").slice(i, j - i)}
                columns |= {n: pa.array(sizes[:, k], pa.int64()) for k, n in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
                names = list(names) if groups else names  # else one at a time
                columns["groups_sha256"] = pa.array([hashlib.sha256(x.encode()).hexdigest() if x else "" for x in names], pa.string())
                if groups:
                    columns["groups"] = pa.array(names)
                columns["runs"] = pa.array([local[x].astype(np.int32) for x in found], pa.list_(pa.int32()))
                columns |= {"pairs": one(pairs, pa.int64()), "times": one(times, pa.int64()), "run_pairs": one(at.reshape(-1).astype(np.int32), pa.int32()), "run_first": one(np.concatenate(([0], np.cumsum(links))).astype(np.int32), pa.int32())}
                yield pa.RecordBatch.from_pydict(columns)
                number += 1

    return modest_batches(src).mapInArrow(run, schema)


def pair_counts(table: DataFrame, n_b: int) -> DataFrame:
    """pair, count of its links over all documents, best (whether no pair of its token of B has more), batches that hold it."""
    each = table.filter("pairs is not null").select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    counted = each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("count"), F.count(F.lit(1)).alias("batches"))
    highest = F.max("count").over(W.partitionBy(F.pmod("pair", F.lit(n_b))))  # at most as many rows as A has tokens
    return counted.withColumn("best", F.col("count") == highest)


def _valued(docs: pa.Table, counts: pa.Table, kept: list[str]) -> pa.Table:
    """Sums of a batch: over the pairs of each run, then over the runs of each document."""
    head = docs.filter(docs.column("pairs").is_valid())
    listed = lambda name: np.asarray(head.column(name)[0].values, np.int64)
    pairs, run_pairs, run_first = listed("pairs"), listed("run_pairs"), listed("run_first")
    order = np.argsort(counts.column("pair").to_numpy())
    if not np.array_equal(counts.column("pair").to_numpy()[order], pairs):
        raise ValueError("a batch's pairs and their counts don't belong together")
    value = np.stack((counts.column("best").to_numpy().astype(np.int64), counts.column("count").to_numpy()), 1)[order]
    upto = np.concatenate((np.zeros((1, 2), np.int64), np.cumsum(value[run_pairs], 0)))
    by_run = upto[run_first[1:]] - upto[run_first[:-1]]
    runs = docs.column("runs").combine_chunks()
    first = np.asarray(runs.offsets, np.int64)
    total = np.concatenate((np.zeros((1, 2), np.int64), np.cumsum(by_run[np.asarray(runs.values, np.int64)], 0)))
    sums = total[first[1:]] - total[first[:-1]]
    return docs.select(kept).append_column("n_best", pa.array(sums[:, 0], pa.int64())).append_column("count_sum", pa.array(sums[:, 1], pa.int64()))


def aligned(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, text: str = "text", id_col: str = "doc_id", groups: bool = False) -> DataFrame:
    """One row for each row of docs: id, n_a, n_b, n_groups, n_links, n_best (links whose pair no other pair of the same token
    of B exceeds over all documents), count_sum (over the links, of their pairs' counts), groups_sha256, and with groups=True
    the groups as `a1,a2|b1;a3|b2`.

    A null or empty text, or one whose bytes a tokenizer doesn't give back, has no tokens: zeros and an empty digest. Repeated
    rows give repeated results and count each time. Columns besides these are dropped. An empty table gives an empty result.
    """
    table = saved(grouped(docs, path_a, path_b, text, id_col, groups), "align-groups")
    n_b = aligner(path_a or data_path(A_FILE), path_b or data_path(B_FILE)).n_b
    counts = saved(pair_counts(table, n_b), "align-counts")
    wanted = table.filter("pairs is not null").select("batch", F.explode("pairs").alias("pair"))
    told = spread_join(wanted, counts, ["pair"], "batches").select("batch", "pair", "count", "best")
    kept = ["__id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *(["groups"] if groups else [])]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in (table.schema[c] for c in kept)) + ", n_best bigint, count_sum bigint"
    told = told.withColumnRenamed("batch", "in_batch")  # both come from one table
    out = table.groupBy("batch").cogroup(told.groupBy("in_batch")).applyInArrow(lambda left, right: _valued(left, right, kept), schema)
    return out.select(F.col("__id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *(["groups"] if groups else []))
