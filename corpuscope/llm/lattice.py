"""Language-model scores by subword lattices (operator 6).

The pieces of a public vocabulary form a trie; every path of pieces through a word is a segmentation. A text's
probability is the product over its words of the sum over all segmentations, times the probability of an end, found
by a forward recursion in log space, for thousands of words of like length at once. The vocabulary's own scores
(ranks of a merge vocabulary, read as Zipf weights) weight the segmentations of the first expectation step; the piece
probabilities are then re-estimated from the training texts' word counts, forward and backward.

Texts are read once: each task turns blocks of texts into a local word list and word numbers. The words of all blocks are
counted, scored once each, and sent back to the blocks that have them; no text is shuffled and no vocabulary of the
corpus is broadcast. Only the piece table, bounded by the vocabulary file, reaches the driver.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscope.llm.common import data_path, gathered, modest_batches, saved, utf8_column

PIECES = "piece_bpe_32k.model"
MARK = "▁"  # a word's start in the vocabulary
BLOCK_BYTES = 24 << 20
HELD_OUT = (7, 2)
ROUNDS = 2
#: Count added to each piece.
ADDED = 0.1
WORDS_AT_ONCE = 8192
#: Words gathered before those of one length are taken together.
WORDS_TOGETHER = 1 << 16
LOG10 = np.log(10)


class Lattice:
    """The trie of all pieces that lower-cased words can use; piece 0 .. n-1, piece n is the end of a text."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ranked: dict[tuple[int, ...], float] = {}
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or piece != piece.translate(_LOWER):
                continue
            symbols = _symbols(piece)
            if 256 not in symbols[1:]:  # no piece spans a word's start
                ranked[symbols] = -model.get_score(i)
        last = max(ranked.values(), default=0.0) + 1
        for symbol in range(257):  # byte fallback: every text has a segmentation
            ranked.setdefault((symbol,), last)
        pieces = sorted(ranked)
        self.n = len(pieces)
        self.longest = max(map(len, pieces))
        weights = 1 / (1 + np.array([ranked[p] for p in pieces]))
        self.start = np.append(np.log(weights / weights.sum() / 2), np.log(0.5))
        rows, piece_of = [[0] * 257, [0] * 257], [-1, -1]  # node 0: nowhere, node 1: root
        for k, p in enumerate(pieces):
            node = 1
            for s in p:
                if not rows[node][s]:
                    rows[node][s] = len(rows)
                    rows.append([0] * 257)
                    piece_of.append(-1)
                node = rows[node][s]
            piece_of[node] = k
        used = np.array(rows, np.int32)
        self.classes = np.zeros(257, np.int64)  # symbols that no deeper node uses share nothing, so only these count
        kept = np.flatnonzero(used.any(axis=0))
        self.classes[kept] = np.arange(len(kept))
        self.width = len(kept)
        self.next = np.ascontiguousarray(used[:, kept]).ravel()
        self.piece_of = np.array(piece_of, np.int64)

    def _edges(self, words: np.ndarray, i: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(end, rows, pieces) of the pieces that start at symbol i."""
        rows = np.arange(len(words))
        node = np.full(len(words), 1, np.int64)
        for j in range(i, min(words.shape[1], i + self.longest)):
            node = self.next[node * self.width + words[rows, j]]
            alive = node > 0
            if not alive.all():
                rows, node = rows[alive], node[alive]
                if not len(rows):
                    return
            piece = self.piece_of[node]
            hit = piece >= 0
            if hit.any():
                yield j + 1, rows[hit], piece[hit]

    def forward(self, words: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """Log probability of reaching each place, words being rows of symbol classes of one length."""
        a = np.full((len(words), words.shape[1] + 1), -np.inf)
        a[:, 0] = 0
        for i in range(words.shape[1]):
            for end, rows, piece in self._edges(words, i):
                a[rows, end] = np.logaddexp(a[rows, end], a[rows, i] + logp[piece])
        return a

    def expected(self, words: np.ndarray, counts: np.ndarray, logp: np.ndarray, into: np.ndarray) -> None:
        """Adds the pieces' expected numbers."""
        a = self.forward(words, logp)
        b = np.full_like(a, -np.inf)
        b[:, -1] = 0
        whole = a[:, -1]
        for i in range(words.shape[1] - 1, -1, -1):
            for end, rows, piece in self._edges(words, i):
                way = logp[piece] + b[rows, end]
                b[rows, i] = np.logaddexp(b[rows, i], way)
                into += np.bincount(piece, np.exp(a[rows, i] + way - whole[rows]) * counts[rows], len(into))

    def by_length(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places in the list, symbol classes) of words of one length, a bounded number of symbols at a time."""
        lens = np.array([len(w) for w in words], np.int64)
        order = np.argsort(lens, kind="stable")
        edges = np.flatnonzero(np.diff(lens[order])) + 1
        for group in np.split(order, edges):
            size = int(lens[group[0]]) if len(group) else 0
            step = max(1, min(WORDS_AT_ONCE, (1 << 20) // (size + 1)))
            for k in range(0, len(group), step):
                at = group[k : k + step]
                flat = np.frombuffer(b"".join([words[x] for x in at.tolist()]), np.uint8).reshape(len(at), size)
                symbols = np.full((len(at), size + 1), 256, np.int64)
                symbols[:, 1:] = flat
                yield at, self.classes[symbols]

    def log10(self, words: list[bytes], logp: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words))
        for at, symbols in self.by_length(words):
            out[at] = self.forward(symbols, logp)[:, -1] / LOG10
        return out


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _symbols(piece: str) -> tuple[int, ...]:
    """A piece's bytes, the mark of a word's start as symbol 256."""
    return tuple(x for c in piece for x in ((256,) if c == MARK else c.encode("utf-8")))


@lru_cache(maxsize=2)
def lattice(path: str) -> Lattice:
    return Lattice(path)


def blocks(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """Blocks of texts: block, ids, held (out), lens (words), numbers (of the words, 24 bits in three planes), words
    (of the block, by number) and known (their occurrences in training texts)."""
    every, rest = HELD_OUT
    held = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(every)) == rest
    src = docs.select(F.col(id_col).alias("id"), held.alias("held"), F.col(text).cast("string").alias("text"))
    id_type = src.schema["id"].dataType
    fixed = T.StructType.fromDDL("block string, held array<boolean>, lens array<int>, numbers binary, words array<string>, known array<bigint>").fields
    schema = T.StructType([*fixed, T.StructField("ids", T.ArrayType(id_type))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from uuid import uuid4

        def flushed() -> pa.RecordBatch:
            flat = np.concatenate([np.empty(0, np.int32), *numbers])
            lens = np.array([len(x) for x in numbers], np.int64)
            train = np.repeat(~np.array(outs, bool), lens)
            planes = flat.astype("<u4").view(np.uint8).reshape(-1, 4).T[:3].tobytes()
            known = np.bincount(flat[train], minlength=len(own))
            return pa.RecordBatch.from_pydict({
                "block": [uuid4().hex], "held": [outs], "lens": pa.array([lens], pa.list_(pa.int32())),
                "numbers": [planes], "words": pa.array([[w.decode("utf-8") for w in own]], pa.list_(pa.string())), "known": pa.array([known], pa.list_(pa.int64())),
                "ids": pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(id_arrow)),
            })

        own: defaultdict = defaultdict()
        own.default_factory = own.__len__
        ids, outs, numbers, size = [], [], [], 0
        id_arrow = None
        for batch in batches:
            id_arrow = batch.column("id").type
            texts, held_out = utf8_column(batch.column("text")), batch.column("held").to_pylist()
            first = 0
            for k, (t, out) in enumerate(zip(texts, held_out)):
                numbers.append(np.fromiter(map(own.__getitem__, t.lower().split()), np.int32))
                outs.append(out)
                size += len(t)
                if size >= BLOCK_BYTES or len(own) >= (1 << 24) - (1 << 20):
                    ids.append(batch.column("id").slice(first, k + 1 - first))
                    yield flushed()
                    own.clear()
                    ids, outs, numbers, size, first = [], [], [], 0, k + 1
            ids.append(batch.column("id").slice(first))
        if outs:
            yield flushed()

    return modest_batches(src).mapInArrow(run, schema)


def train_pieces(words: DataFrame, end_count: int, path: str, rounds: int = ROUNDS) -> np.ndarray:
    """Log probabilities of the pieces and of the end, from word, c (occurrences in training texts)."""
    own = lattice(path)
    logp = own.start
    seen = words.filter("c > 0").select("word", "c")
    for _ in range(rounds):
        now = logp

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, sums = lattice(path), None
            for batch in gathered(batches, WORDS_TOGETHER):
                sums = np.zeros(model.n + 1) if sums is None else sums
                counts = batch.column("c").to_numpy().astype(np.float64)
                for at, symbols in model.by_length(utf8_column(batch.column("word"))):
                    model.expected(symbols, counts[at], now, sums)
            if sums is not None:
                got = np.flatnonzero(sums)
                yield pa.RecordBatch.from_pydict({"piece": pa.array(got, pa.int64()), "n": pa.array(sums[got], pa.float64())})

        expected = np.zeros(own.n + 1)
        for r in seen.mapInArrow(step, "piece bigint, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():
            expected[r["piece"]] = r["n"]  # as many rows as the vocabulary has pieces, at most
        expected[own.n] = end_count
        expected += ADDED
        logp = np.log(expected / expected.sum())
    return logp




def score(docs: DataFrame, text: str = "text", id_col: str = "doc_id", model: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each whole text.

    Texts whose crc32 of the id (as text; null: empty) leaves 2 mod 7 are held out; the others train both models.
    Tokens are the words, lower-cased in A-Z, and one end. base_score: log10 probability by single words with one
    added; score: log10 of the lattice model's probability. A null or empty text is an end alone. Repeated rows train
    and score each. Without a training text all counts are zero. An empty table gives an empty result.
    """
    path = model or data_path(PIECES)
    held = saved(blocks(docs, text, id_col), "lattice-blocks")
    listed = held.select("block", F.posexplode(F.arrays_zip("words", "known")).alias("pos", "x")).select("block", "pos", F.col("x.words").alias("word"), F.col("x.known").alias("known"))
    words = saved(listed.groupBy("word").agg(F.sum("known").alias("c")), "lattice-words")
    ends = held.select(F.aggregate("held", F.lit(0).cast("long"), lambda a, x: a + F.when(x, 0).otherwise(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    total, kinds = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    tokens, kinds = total + ends, kinds + (ends > 0)
    logp = train_pieces(words, ends, path, rounds)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(path)
        for batch in gathered(batches, WORDS_TOGETHER):
            yield pa.RecordBatch.from_pydict({"word": batch.column("word"), "c": batch.column("c"), "lp": pa.array(own.log10(utf8_column(batch.column("word")), logp), pa.float64())})

    rated = words.mapInArrow(scored, "word string, c bigint, lp double")
    back = listed.select("block", "pos", "word").join(rated, "word").select(F.col("block").alias("of"), "pos", "c", "lp")
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), *T.StructType.fromDDL("held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double").fields]
    end_base, end_lp, whole = float(np.log10(ends + 1)), float(logp[-1] / LOG10), float(np.log10(tokens + kinds + 1))

    def finish(block: pa.Table, table: pa.Table) -> pa.Table:
        out = []
        for row in range(block.num_rows):  # one
            lens = block.column("lens")[row].values.to_numpy() if block.num_rows else np.empty(0)
            planes = np.frombuffer(block.column("numbers")[row].as_py(), np.uint8).reshape(3, -1).astype(np.uint32)
            numbers = planes[0] | planes[1] << 8 | planes[2] << 16
            n = table.num_rows
            c, lp = np.zeros(n, np.int64), np.zeros(n)
            pos = table.column("pos").to_numpy()
            c[pos], lp[pos] = table.column("c").to_numpy(), table.column("lp").to_numpy()
            doc = np.repeat(np.arange(len(lens)), lens)
            add = lambda values: np.bincount(doc, values[numbers] if n else None, len(lens)) if len(doc) else np.zeros(len(lens))
            size = lens.astype(np.int64) + 1
            out.append(pa.table({
                id_col: block.column("ids")[row].values, "held_out": block.column("held")[row].values, "n_tokens": size,
                "n_known": np.rint(add((c > 0).astype(float))).astype(np.int64) + int(ends > 0), "train_tokens": np.full(len(lens), tokens, np.int64),
                "base_score": add(np.log10(c + 1)) + end_base - size * whole, "score": add(lp) + end_lp,
            }))
        empty = pa.table({f.name: [] for f in fields})
        return pa.concat_tables(out) if out else empty

    keyed = held.select("block", "ids", "held", "lens", "numbers").groupBy("block")
    return keyed.cogroup(back.groupBy("of")).applyInArrow(finish, T.StructType(fields))
