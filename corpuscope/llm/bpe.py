"""Byte-level BPE encoding and decoding (operator 1).

Pre-tokenisation uses no regex. Every code point gets a class; a small automaton over the classes decides where a
token starts. The transitions of one code point form a function from state to state, and such functions compose
associatively, so a batch of texts is cut into equal blocks, the function of every block is composed column by
column over all blocks at once (numpy), a doubling scan composes the block functions, and a second sweep reads off
the states and the starts. The slices between starts go through a cached pair merge; every token keeps its byte offset,
and decoding puts the token bytes back at these offsets.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.common import data_path, in_slices, modest_batches, utf8_column

RANKS = "byte_bpe_multi_50k.tiktoken"

# Classes of code points. S1 holds the letters that end a contraction by themselves.
SPACE, WHITE, QUOTE, OTHER, NUMBER, LETTER, S1, LET_R, LET_V, LET_E, LET_L, BREAK = range(12)
N_CLASSES = 12
# States: what the text up to here ends in. Q: a quote that starts a token; Q_RV and Q_L: such a quote and r/v or l,
# which a following e or l makes a contraction; DONE: a whole contraction.
START, IN_SPACE, IN_WHITE, IN_LETTER, IN_NUMBER, IN_OTHER, Q, Q_RV, Q_L, DONE = range(10)
N_STATES = 10
# Outputs: a token starts HERE, or at the code point BEFORE this one.
HERE, BEFORE = 1, 2
# White_Space of Unicode (fixed values).
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Class of every code point."""
    first = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((first.get(unicodedata.category(chr(i))[0], OTHER) for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    table[WHITE_SPACE] = WHITE
    for letters, kind in ((" ", SPACE), ("'", QUOTE), ("stmd", S1), ("r", LET_R), ("v", LET_V), ("e", LET_E), ("l", LET_L)):
        for c in letters:
            table[ord(c)] = kind
    return table


def _run(kind: int) -> int:
    """State that a token of this class opens."""
    if kind >= LETTER:
        return IN_LETTER
    return {SPACE: IN_SPACE, WHITE: IN_WHITE, QUOTE: Q, OTHER: IN_OTHER, NUMBER: IN_NUMBER}[kind]


def _step(state: int, kind: int) -> tuple[int, int]:
    """The state after one code point, and what starts."""
    if kind == BREAK:  # a text ends: r, v or l behind a quote was a token of its own
        return START, BEFORE if state in (Q_RV, Q_L) else 0
    white = kind in (SPACE, WHITE)
    fresh = (_run(kind), HERE)
    if state in (IN_SPACE, IN_WHITE):
        if white:
            return _run(kind), 0
        if state == IN_WHITE:  # the last white space stands alone
            return fresh[0], HERE | BEFORE
        return IN_OTHER if kind == QUOTE else fresh[0], BEFORE  # one space leads the token
    if state == Q:
        if kind in (QUOTE, OTHER):
            return IN_OTHER, 0
        if kind == S1:
            return DONE, 0
        if kind in (LET_R, LET_V):
            return Q_RV, 0
        if kind == LET_L:
            return Q_L, 0
        return fresh
    if state in (Q_RV, Q_L):
        if kind == (LET_E if state == Q_RV else LET_L):
            return DONE, 0
        if kind >= LETTER:  # no contraction: a word that starts right behind the quote
            return IN_LETTER, BEFORE
        return fresh[0], HERE | BEFORE
    if state == IN_LETTER and kind >= LETTER or state == IN_NUMBER and kind == NUMBER:
        return state, 0
    if state == IN_OTHER and kind in (QUOTE, OTHER):
        return state, 0
    return fresh


@lru_cache(maxsize=1)
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Next state and output by (state, class); the transition functions closed under composition with one more
    class: a row of states each, and the function that (function, class) gives. Function 0 is the identity."""
    cells = [[_step(s, k) for k in range(N_CLASSES)] for s in range(N_STATES)]
    after = np.array([[c[0] for c in row] for row in cells], np.uint8)
    out = np.array([[c[1] for c in row] for row in cells], np.uint8)
    known = {tuple(range(N_STATES)): 0}
    functions, then = [tuple(range(N_STATES))], []
    for f in functions:  # grows while it is read
        row = []
        for k in range(N_CLASSES):
            g = tuple(int(after[s, k]) for s in f)
            if g not in known:
                known[g] = len(functions)
                functions.append(g)
            row.append(known[g])
        then.append(row)
    return after, out, np.array(functions, np.uint8), np.array(then, np.uint16)


def token_starts(kinds: np.ndarray) -> np.ndarray:
    """Where a token starts, by classes of code points (the texts of a batch, each ended by BREAK)."""
    after, out, functions, then = automaton()
    n = len(kinds)
    width = max(1, min(2048, int(n**0.5)))
    blocks = -(-n // width)
    grid = np.full(blocks * width, BREAK, np.uint8)
    grid[:n] = kinds
    grid = np.ascontiguousarray(grid.reshape(blocks, width).T)  # a row holds one place of all blocks
    flat_then, flat_after, flat_out = then.ravel(), after.ravel(), out.ravel()
    f = np.zeros(blocks, np.intp)
    for row in grid:
        f = flat_then[f * N_CLASSES + row]
        f = f.astype(np.intp)
    whole = functions[f]  # (blocks, states): the function of each block
    reach = 1
    while reach < blocks:  # inclusive scan: compose with the function of the blocks before
        whole[reach:] = np.take_along_axis(whole[reach:], whole[:-reach].astype(np.intp), 1)
        reach *= 2
    state = np.zeros(blocks, np.intp)
    state[1:] = whole[:-1, START]
    said = np.empty((width, blocks), np.uint8)
    for place, row in zip(said, grid):
        cell = state * N_CLASSES + row
        place[:] = flat_out[cell]
        state = flat_after[cell].astype(np.intp)
    said = np.ascontiguousarray(said.T).ravel()[:n]
    starts = (said & HERE).astype(bool)
    starts[:-1] |= (said[1:] & BEFORE) > 0
    return starts


class PairMerger(dict):
    """Maps a slice to a number; ids_of gives the slice's token ids. A missing slice is merged once and kept, up to a
    bound on the kept slices."""

    def __init__(self, ranks: dict[bytes, int], most: int = 400_000):
        super().__init__()
        self.ranks, self.most = ranks, most
        self.clear_all()

    def clear_all(self) -> None:
        self.clear()
        self.ids: list[list[int]] = []

    def __missing__(self, piece: bytes) -> int:
        self[piece] = k = len(self.ids)
        whole = self.ranks.get(piece)
        self.ids.append([whole] if whole is not None else self.merged(piece))
        return k

    def merged(self, piece: bytes) -> list[int]:
        """Merges the pair of least rank, the leftmost first, until no pair has a rank."""
        if len(piece) > 64:
            return self.merged_long(piece)
        get, none = self.ranks.get, len(self.ranks) + 1
        bounds = list(range(len(piece) + 1))
        pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while pairs and (least := min(pairs)) < none:
            i = pairs.index(least)
            del bounds[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = get(piece[bounds[i] : bounds[i + 2]], none)
            if i:
                pairs[i - 1] = get(piece[bounds[i - 1] : bounds[i + 1]], none)
        return [self.ranks[piece[a:b]] for a, b in zip(bounds, bounds[1:])]

    def merged_long(self, piece: bytes) -> list[int]:
        """The same with a heap, which keeps long slices in n log n."""
        ranks, n = self.ranks, len(piece)
        if not n:
            return []
        end = list(range(1, n + 1))  # part i spans i..end[i]
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or (j := end[i]) >= n or end[j] != stop:
                continue  # one of the two parts has changed
            alive[j] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class ByteBPE:
    """Encoder and decoder by a file of ranks."""

    def __init__(self, path: str):
        self.ranks = load_ranks(path)
        self.merger = PairMerger(self.ranks)
        top = max(self.ranks.values()) + 1
        by_id = [b""] * top
        for piece, k in self.ranks.items():
            by_id[k] = piece
        self.by_id = by_id
        self.token_len = np.array([len(x) for x in by_id], np.int64)

    def encode_batch(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, byte offsets) of each text; offsets has one more entry, the text's length."""
        chars = b"\n".join(texts) + b"\n"
        codes = np.frombuffer(chars.decode("utf-8").encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in texts])  # the line feed behind each text, in bytes
        wide = np.frombuffer(chars, np.uint8)
        lead = np.flatnonzero((wide & 0xC0) != 0x80)  # byte offset of each code point
        kinds = class_table()[codes]
        breaks = np.searchsorted(lead, ends - 1)
        kinds[breaks] = BREAK
        starts = token_starts(kinds)
        starts[breaks] = True  # ends the last token of each text
        cuts = lead[starts]
        # The line feeds between texts are slices too; they are left out below.
        bounds = np.append(cuts, len(chars)).tolist()
        mark = np.searchsorted(cuts, ends - 1)
        merger = self.merger
        if len(merger) > merger.most:
            merger.clear_all()
        pieces = [chars[a:b] for a, b in zip(bounds, bounds[1:])]
        numbers = np.array([merger[p] for p in pieces], np.intp)
        used, local = np.unique(numbers, return_inverse=True)
        lists = [merger.ids[k] for k in used.tolist()]
        counts = np.array([len(x) for x in lists], np.int64)
        flat = np.array([y for x in lists for y in x], np.uint32)
        first = np.cumsum(counts) - counts
        per = counts[local]
        per[mark] = 0
        total = np.cumsum(per)
        ids = flat[np.repeat(first[local] - (total - per), per) + np.arange(total[-1])]
        lens = self.token_len[ids]
        out, low, at = [], 0, 0
        for high_piece, text in zip(mark.tolist(), texts):
            high = int(total[high_piece])
            offsets = np.zeros(high - low + 1, np.int64)
            np.cumsum(lens[low:high], out=offsets[1:])
            out.append((ids[low:high], offsets))
            low = high
        return out

    def decode(self, ids: np.ndarray, offsets: np.ndarray | None = None) -> bytes:
        """The bytes of the ids. With offsets, that every token lies where it was cut is checked."""
        by_id = self.by_id
        text = b"".join([by_id[k] for k in ids.tolist()])
        if offsets is not None and (len(text) != offsets[-1] or not np.array_equal(np.diff(offsets), self.token_len[ids])):
            raise ValueError("the offsets don't belong to these ids")
        return text


@lru_cache(maxsize=4)
def codec(path: str) -> ByteBPE:
    return ByteBPE(path)


SLICE_BYTES = 1 << 20


def encoded_texts(texts: list[bytes], path: str) -> Iterator[tuple[np.ndarray, np.ndarray, bytes]]:
    own = codec(path)
    for a, b in in_slices(texts, SLICE_BYTES):
        for ids, offsets in own.encode_batch(texts[a:b]):
            yield ids, offsets, own.decode(ids, offsets)


def encode(docs: DataFrame, ranks: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), full: bool = False) -> DataFrame:
    """Encodes and decodes each whole text.

    Returns the kept columns and n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers) and
    decoded_sha256; with full=True also token_ids, token_offsets (byte offset of each token) and decoded.
    A null text counts as empty: no tokens, the hashes of nothing. Rows stay as they are, so repeated rows give
    repeated results; other columns are dropped unless kept. An empty table gives an empty result.
    """
    path = ranks or data_path(RANKS)
    src = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    fields = [f for f in src.schema.fields if f.name != "__text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["n_tokens bigint", "ids_sha256 string", "decoded_sha256 string"] + (["token_ids array<int>", "token_offsets array<bigint>", "decoded binary"] if full else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8_column(batch.column("__text"))
            counts, id_hash, text_hash, more = [], [], [], []
            for ids, offsets, back in encoded_texts(texts, path):
                counts.append(len(ids))
                id_hash.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                text_hash.append(hashlib.sha256(back).hexdigest())
                if full:
                    more.append((ids.astype(np.int32), offsets[:-1], back))
            columns = {f.name: batch.column(f.name) for f in fields}
            columns |= {"n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(id_hash, pa.string()), "decoded_sha256": pa.array(text_hash, pa.string())}
            if full:
                columns |= {"token_ids": pa.array([x[0] for x in more], pa.list_(pa.int32())), "token_offsets": pa.array([x[1] for x in more], pa.list_(pa.int64())), "decoded": pa.array([x[2] for x in more], pa.binary())}
            yield pa.RecordBatch.from_pydict(columns)

    return modest_batches(src).mapInArrow(run, schema)
