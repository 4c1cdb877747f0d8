"""Removal of repeated passages by suffix arrays (operator 3).

A byte goes if a LIMIT-byte string that covers it also starts anywhere else, in the same text or another. Sorting all
suffixes of a corpus in one place can't scale, so the suffixes are sharded such that equal LIMIT-byte strings always meet:
each such string has an anchor, the least-hashed GRAM-byte string in it (leftmost of equals), which depends on its bytes
alone. Strings with different anchors can't be equal, and an anchor that occurs once has nothing to compare. The
places of one anchor are compared by their contexts, the bytes that strings with this anchor can reach:

- equal contexts are repeats of each other as a whole (128 bits of digest) and count as one from here on;
- different contexts with one anchor go to a shard, where the anchor itself, the same in all of them, becomes one symbol.
  The shard's suffix array is built as far as a string reaches, by sorting ranks of ever more symbols, and suffixes
  that share a whole string's symbols are repeats.
- an anchor with more different contexts than a task should hold is dealt anew by the place of the anchor in the string,
  in ever smaller ranges of places, together with the bytes that all strings of the range share; a range of one place
  leaves single strings, which are counted by their digest.

Nothing is capped: each of the three ways is exact.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.common import deal, in_slices, modest_batches, powers, release, saved, spread_join, utf8_column
from corpuscope.llm.passages import SharedPassages
from corpuscope.llm.suffix_array import bounded_suffix_array

LIMIT = 400
GRAM = 256
#: Different contexts of an anchor that one shard takes; more are dealt anew.
MOST = 2000
#: Symbols of a shard, about.
SHARD_SYMBOLS = 500_000
#: Parts into which the places of a context are taken to narrow them before the suffix array.
PARTS = 5
#: Widths of the ranges of places, level by level.
WIDTHS = (29, 5, 1)
SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_PLACES = np.uint64(0xFFFFFF)


def anchors(buffer: bytes, ends: np.ndarray, limit: int = LIMIT, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors in texts that lie one after the other in the buffer; ends: where each ends."""
    n, window = len(buffer), limit - gram + 1
    starts = np.concatenate([[0], ends[:-1]])
    none = np.empty(0, np.int64), np.empty(0, np.uint64)
    if n < limit or (ends - starts).max() < limit:
        return none
    if n > 2 * SLICE_BYTES and len(ends) == 1:
        return _long_anchors(buffer, limit, gram)
    power, inverse = powers(n, _BASE), powers(n, pow(_BASE, -1, 1 << 64))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((np.frombuffer(buffer, np.uint8).astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    # The place in the low bits makes the least one the leftmost of equals.
    keyed = (h & ~_PLACES) | np.arange(len(h), dtype=np.uint64)
    grid = np.concatenate([keyed, np.full(-len(h) % window + window, ~np.uint64(0), np.uint64)]).reshape(-1, window)
    forth = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[: n - limit + 1], forth[window - 1 : n - limit + window])
    inside = np.zeros(n + 2, np.int64)
    full = ends - starts >= limit
    np.add.at(inside, starts[full], 1)
    np.add.at(inside, ends[full] - limit + 1, -1)
    # From string to string the anchor's place never falls.
    at = (least[np.cumsum(inside)[: n - limit + 1] > 0] & _PLACES).astype(np.int64)
    at = at[np.diff(at, prepend=-1) != 0]
    return at, h[at]


def _long_anchors(buffer: bytes, limit: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of one long text: parts that overlap by what a string reaches."""
    part, found = SLICE_BYTES, {}
    for a in range(0, len(buffer), part):
        piece = buffer[a : a + part + limit]
        at, h = anchors(piece, np.array([len(piece)]), limit, gram)
        found |= dict(zip((at + a).tolist(), h.tolist()))
    at = np.array(sorted(found), np.int64)
    return at, np.array([found[x] for x in at.tolist()], np.uint64)


def anchor_table(docs: DataFrame, text: str, limit: int = LIMIT, gram: int = GRAM) -> DataFrame:
    """k (digest of the text), a (anchor), c (digest of its context), pos (of the anchor), left and size (of the
    context)."""
    src = docs.select(F.col(text).cast("string").alias("t")).filter(F.octet_length("t") >= limit)
    side = limit - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8_column(batch.column("t"))
            for x, y in in_slices(texts, SLICE_BYTES):
                part = texts[x:y]
                buffer = b"".join(part)
                ends = np.cumsum([len(t) for t in part])
                at, h = anchors(buffer, ends, limit, gram)
                doc = np.searchsorted(ends, at, side="right")
                first = np.concatenate([[0], ends[:-1]])[doc]
                low, high = np.maximum(first, at - side), np.minimum(ends[doc], at + limit)
                left = at - low
                digest = xxhash.xxh3_64_intdigest
                digests = np.array([digest(buffer[a:b], n) for a, b, n in zip(low.tolist(), high.tolist(), left.tolist())], np.uint64)
                names = np.frombuffer(b"".join([hashlib.md5(t).digest() for t in part]), np.uint8).reshape(-1, 16)[doc]
                ends16 = np.arange(0, 16 * len(doc) + 1, 16, dtype=np.int32)
                yield pa.RecordBatch.from_pydict({
                    "k": pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(ends16), pa.py_buffer(names.tobytes())]), "a": pa.array(h.view(np.int64), pa.int64()), "c": pa.array(digests.view(np.int64), pa.int64()),
                    "pos": pa.array((at - first).astype(np.int32), pa.int32()), "left": pa.array(left.astype(np.int16), pa.int16()), "size": pa.array((high - low).astype(np.int16), pa.int16()),
                })

    return modest_batches(src).mapInArrow(run, "k binary, a bigint, c bigint, pos int, left smallint, size smallint")


def shard_repeats(contexts: list[bytes], lefts: np.ndarray, low: np.ndarray, high: np.ndarray, limit: int = LIMIT, gram: int = GRAM) -> list[np.ndarray]:
    """For each context the places left of its anchor (0 .. limit - gram) from which a string with this anchor also starts
    in another of the contexts. low, high: the range of places that count for each context."""
    side = limit - gram
    rank: dict[bytes, int] = {}
    symbols, owner, places = [], [], []
    for i, (x, left) in enumerate(zip(contexts, lefts.tolist())):
        group = rank.setdefault(x[left : left + gram], len(rank))
        body = np.frombuffer(x[:left] + b"\0" + x[left + gram :], np.uint8).astype(np.int64) + 3
        body[left] = 2  # the anchor; groups with other anchor bytes are told apart below
        symbols += [body, np.ones(1, np.int64)]
        owner.append((i, group, left, len(x) - left - gram))
    text = np.concatenate([*symbols, np.zeros(1, np.int64)])
    lens = np.array([len(x) for x in symbols[::2]], np.int64) + 1
    start = np.cumsum(lens) - lens
    whose = np.append(np.repeat(np.arange(len(contexts)), lens), 0)
    info = np.array(owner, np.int64).reshape(-1, 4)
    left_of = info[whose, 2] - (np.arange(len(text)) - np.append(np.repeat(start, lens), 0))
    own = np.arange(len(text)) < len(text) - 1
    valid = own & (left_of >= low[whose]) & (left_of <= high[whose]) & (left_of <= side) & (info[whose, 3] >= side - left_of) & (left_of >= 0)
    if not valid.any():
        return [np.empty(0, np.int64)] * len(contexts)
    # A run of the array shares all side + 1 symbols of a string: side bytes and the anchor.
    at, run = bounded_suffix_array(text, side + 1, np.flatnonzero(valid))
    group = info[whose[at], 1]
    order = np.lexsort((group, run))
    at, run, group = at[order], run[order], group[order]
    same = (run[1:] == run[:-1]) & (group[1:] == group[:-1])
    twice = np.zeros(len(at), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hits = at[twice]
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(contexts)
    by = np.argsort(whose[hits], kind="stable")
    hits = hits[by]
    edges = np.searchsorted(whose[hits], np.arange(len(contexts) + 1))
    for i in range(len(contexts)):
        if edges[i] < edges[i + 1]:
            out[i] = np.sort(left_of[hits[edges[i] : edges[i + 1]]])
    return out


def narrowed(contexts: list[bytes], lefts: np.ndarray, low: np.ndarray, high: np.ndarray, limit: int = LIMIT, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Closer bounds of the places at which a string of the context may also start in another one; low exceeds high where
    there is none. The places are taken in PARTS parts: what all strings of a part share must stand in another context
    for any of them to. Digests that collide only leave more to compare."""
    side = limit - gram
    step = -(-(side + 1) // PARTS)
    seen: Counter[int] = Counter()
    cores: list[list[tuple[int, int]]] = []
    for x, left, a0, b0 in zip(contexts, lefts.tolist(), low.tolist(), high.tolist()):
        right, own = len(x) - left - gram, []
        for a in range(0, side + 1, step):
            b = min(a + step - 1, side)
            if a <= b0 and b >= a0 and left >= a and right >= side - b:
                own.append((a, xxhash.xxh3_64_intdigest(x[left - a : left + gram + side - b], a)))
        seen.update(h for _, h in own)
        cores.append(own)
    shared = [[a for a, h in own if seen[h] > 1] for own in cores]
    closer_low = np.array([x[0] if x else 1 for x in shared], np.int64)
    closer_high = np.array([x[-1] + step - 1 if x else 0 for x in shared], np.int64)
    some = np.array([bool(x) for x in shared], bool)
    return np.where(some, np.maximum(low, closer_low), closer_low), np.where(some, np.minimum(high, closer_high), closer_high)


def _load_repeats(contexts: list[bytes], lefts: np.ndarray, low: np.ndarray, high: np.ndarray, limit: int, gram: int) -> list[np.ndarray]:
    """shard_repeats of the contexts cut down to what strings at the narrowed places cover."""
    side = limit - gram
    low, high = narrowed(contexts, lefts, low, high, limit, gram)
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(contexts)
    open_ = np.flatnonzero(low <= high)
    if len(open_):
        begin = np.maximum(lefts - high, 0)
        end = lefts + gram + side - low
        hits = shard_repeats([contexts[i][begin[i] : end[i]] for i in open_.tolist()], (lefts - begin)[open_], low[open_], high[open_], limit, gram)
        for i, hit in zip(open_.tolist(), hits):
            out[i] = hit
    return out


def _ranges(values: np.ndarray) -> list[dict]:
    """Sorted distinct whole numbers as ranges."""
    if not len(values):
        return []
    cut = np.flatnonzero(np.diff(values) > 1)
    return [{"low": int(a), "high": int(b)} for a, b in zip(values[np.concatenate([[0], cut + 1])], values[np.concatenate([cut, [len(values) - 1]])])]


RANGES = "array<struct<low:int,high:int>>"


def _by_suffix_array(units: DataFrame, limit: int, gram: int) -> DataFrame:
    """units: g (group), d (member), ctx, left, low, high, symbols. Returns d and its ranges, groups being spread over
    shards of about SHARD_SYMBOLS."""
    total = units.agg(F.sum("symbols")).first()[0] or 0
    shards = max(deal(units), -(-total // SHARD_SYMBOLS))
    dealt = units.withColumn("shard", F.pmod(F.xxhash64("g"), F.lit(shards)))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        contexts = table.column("ctx").to_pylist()
        lefts, low, high = (table.column(n).to_numpy().astype(np.int64) for n in ("left", "low", "high"))
        groups = table.column("g").to_pylist()
        # Groups don't match each other, so a shard's groups go through in loads of a bounded size.
        order = sorted(range(len(groups)), key=groups.__getitem__)
        found: list[list[dict]] = [[]] * len(groups)
        load: list[int] = []
        size = 0
        for n, i in enumerate(order):
            load.append(i)
            size += len(contexts[i]) - gram + 2
            if n + 1 == len(order) or size >= SHARD_SYMBOLS and groups[order[n + 1]] != groups[i]:
                hits = _load_repeats([contexts[x] for x in load], lefts[load], low[load], high[load], limit, gram)
                for x, hit in zip(load, hits):
                    found[x] = _ranges(hit)
                load, size = [], 0
        kind = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
        return pa.table({"d": table.column("d"), "ranges": pa.array(found, kind)})

    return dealt.groupBy("shard").applyInArrow(run, f"d binary, ranges {RANGES}")


def _bytes(ctx: Column, start: Column, size: Column) -> Column:
    return F.substring(ctx, start + 1, size)


def _hot(members: DataFrame, level: int, limit: int, gram: int, most: int) -> DataFrame:
    """members: m (row), n (its multiplicity), a, ctx, left, low, high, of anchors with more than `most` different
    contexts. Returns m and ranges, exactly."""
    side = limit - gram
    width = WIDTHS[min(level, len(WIDTHS) - 1)]
    steps = F.sequence(F.col("low"), F.col("high"), F.lit(width))
    parts = members.select("m", "n", "a", "ctx", "left", F.explode(steps).alias("low"), F.col("high").alias("__top"))
    parts = parts.withColumn("high", F.least(F.col("low") + width - 1, F.col("__top"))).drop("__top")
    right = F.octet_length("ctx") - F.col("left") - gram
    # Only contexts that hold what all strings of the range share have any of them.
    parts = parts.filter((F.col("left") >= F.col("low")) & (right >= side - F.col("high")))
    inner = _bytes(F.col("ctx"), F.col("left") - F.col("low"), F.col("low") + gram + side - F.col("high"))
    begin = F.greatest(F.col("left") - F.col("high"), F.lit(0))
    end = F.least(F.col("left") + gram + side - F.col("low"), F.octet_length("ctx"))
    parts = parts.withColumn("g", F.unhex(F.md5(F.concat(inner, F.encode(F.concat_ws(":", "a", "low", "high"), "utf-8")))))
    parts = parts.withColumn("sub", _bytes(F.col("ctx"), begin, end - begin)).withColumn("sub_left", (F.col("left") - begin).cast("int"))
    parts = parts.withColumn("d", F.unhex(F.md5(F.concat("g", F.encode(F.col("sub_left").cast("string"), "utf-8"), F.lit(b":"), "sub"))))
    parts = saved(parts.drop("ctx", "left"), "repeat-parts")
    # Of members with equal bytes one, the least, stands for all.
    kinds_of = saved(parts.groupBy("g", "d").agg(F.sum("n").alias("times"), F.count(F.lit(1)).alias("members"), F.min("m").alias("m")), "repeat-kinds")
    sizes = kinds_of.groupBy("g").agg(F.count(F.lit(1)).alias("kinds"), F.count(F.when(F.col("times") == 1, 1)).alias("singles"))
    named = saved(spread_join(kinds_of, saved(sizes, "repeat-sizes"), ["g"], "kinds"), "repeat-named")
    # Near a text's ends a context holds fewer places than the range.
    room = F.octet_length("sub") - F.col("sub_left") - gram
    whole = F.array(F.struct(F.greatest(F.col("low"), side - room).cast("int").alias("low"), F.least("high", "sub_left").cast("int").alias("high")))
    out = spread_join(parts, named.filter("times > 1").select("d", "members"), ["d"], "members").select("m", whole.alias("ranges")).filter("ranges[0].low <= ranges[0].high")
    if width == 1:  # single strings: equal or not
        return out
    # Whether a kind that occurs once repeats in part is open where its group has other kinds.
    rest = parts.join(named.filter("kinds > 1 and singles > 0").select("d", "m", "kinds", "times"), ["d", "m"])
    units = rest.filter(f"kinds <= {most}").select("g", "d", "m", "times", F.col("sub").alias("ctx"), F.col("sub_left").alias("left"), "low", "high", (F.octet_length("sub") - gram + 2).alias("symbols"))
    units = saved(units.dropDuplicates(["d", "m"]), "repeat-units")
    found = _by_suffix_array(units, limit, gram)
    out = out.union(found.join(units.filter("times = 1").select("d", "m"), "d").select("m", "ranges"))
    over = rest.filter(f"kinds > {most}")
    if over.limit(1).count():
        deeper = over.select("m", F.col("times").alias("n"), "a", F.col("sub").alias("ctx"), F.col("sub_left").alias("left"), "low", "high")
        out = out.union(_hot(saved(deeper, "repeat-members"), level + 1, limit, gram, most))
    return out


def repeats(docs: DataFrame, text: str = "text", id_col: str = "doc_id", limit: int = LIMIT, gram: int = GRAM, most: int = MOST, more_texts: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, spans, bodies): texts by k with their body, for those that may be cut; spans (k, low, high) to remove, which
    may overlap. Texts that occur twice or more and reach the limit are removed whole and aren't among the texts. bodies:
    the same with the texts that more_texts names by k."""
    side = limit - gram
    digest = F.unhex(F.md5(F.col(text).cast("string")))
    narrow = docs.select(digest.alias("k"), F.xxhash64(F.col(id_col)).alias("row")).filter("k is not null")
    # Of rows with one text, one stands for all: that of the least hash of the id.
    first = saved(narrow.groupBy("k").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("copies")), "repeat-texts")
    table = saved(anchor_table(docs, text, limit, gram), "repeat-anchors")
    groups = saved(table.groupBy("a").agg(F.count(F.lit(1)).alias("n"), (F.min("c") != F.max("c")).alias("mixed")).filter("n > 1").select("a", "n", "mixed"), "repeat-groups")
    again = saved(spread_join(table, groups, ["a"], "n").drop("n"), "repeat-again")
    release(docs.sparkSession, table, groups)
    member = F.struct("k", "pos", "left", "size")
    cells = saved(again.groupBy("a", "c", "mixed").agg(F.count(F.lit(1)).alias("n"), F.min(member).alias("one")), "repeat-cells")
    whole = spread_join(again, cells.filter("n > 1").select("a", "c", "n"), ["a", "c"], "n").filter(F.col("size") >= limit)
    # Copies of a text have the same spans, which meet as one before anything is dealt by text.
    spans = whole.select("k", (F.col("pos") - F.col("left")).cast("int").alias("low"), (F.col("pos") - F.col("left") + F.col("size")).cast("int").alias("high")).distinct()
    # Contexts of the mixed anchors, one for each cell. A group all of whose contexts occur twice has nothing left to decide.
    sizes = cells.filter("mixed").groupBy("a").agg(F.count(F.lit(1)).alias("kinds"), F.count(F.when(F.col("n") == 1, 1)).alias("singles")).filter("singles > 0").drop("singles")
    mixed = saved(spread_join(cells.filter("mixed"), saved(sizes, "repeat-sizes"), ["a"], "kinds").select(F.col("one.k").alias("k"), F.struct("a", "c", "n", "kinds", "one.pos", "one.left", "one.size").alias("x")), "repeat-mixed")
    once = first.filter("copies = 1")
    needed = mixed.select("k").union(again.select("k").distinct().join(once.select("k"), "k", "left_semi")).union(more_texts if more_texts is not None else mixed.select("k").limit(0)).distinct()
    chosen = needed.join(first, "k").select("k", "row")
    bodies = docs.select(digest.alias("k"), F.xxhash64(F.col(id_col)).alias("row"), F.col(text).cast("string").cast("binary").alias("body"))
    # Copies of a text have different ids, so the pair spreads them; rows that share both are one.
    texts = saved(bodies.join(chosen, ["k", "row"], "left_semi").drop("row"), "repeat-bodies")
    lists = mixed.groupBy("k").agg(F.collect_list("x").alias("xs"))
    cut = lambda x: F.struct(x["a"].alias("a"), x["c"].alias("c"), x["n"].alias("n"), x["kinds"].alias("kinds"), x["pos"].alias("pos"), x["left"].cast("int").alias("left"), F.substring(F.col("body"), x["pos"] - x["left"] + 1, x["size"].cast("int")).alias("ctx"))
    contexts = texts.join(lists, "k").select("k", F.explode(F.transform("xs", cut)).alias("x")).select("k", "x.*")
    name = F.unhex(F.md5(F.concat_ws(":", F.col("a").cast("string"), F.col("c").cast("string"))))
    contexts = saved(contexts.withColumn("d", name), "repeat-contexts")
    release(docs.sparkSession)
    cold = contexts.filter(f"kinds <= {most}").dropDuplicates(["d"])
    units = cold.select(F.col("a").alias("g"), "d", "ctx", "left", F.lit(0).alias("low"), F.lit(side).alias("high"), (F.octet_length("ctx") - gram + 2).alias("symbols"))
    found = _by_suffix_array(units, limit, gram)
    if mixed.filter(f"x.kinds > {most}").limit(1).count():
        hot = contexts.filter(f"kinds > {most}").dropDuplicates(["d"])
        members = hot.select(F.col("d").alias("m"), "n", "a", "ctx", "left", F.lit(0).alias("low"), F.lit(side).alias("high"))
        found = found.union(_hot(saved(members, "repeat-members"), 0, limit, gram, most).select(F.col("m").alias("d"), "ranges"))
    # A string l places left of the anchor covers limit bytes from there.
    alone = contexts.filter("n = 1").select("k", "d", "pos")
    placed = alone.join(found, "d").select("k", "pos", F.explode("ranges").alias("r"))
    spans = spans.union(placed.select("k", (F.col("pos") - F.col("r.high")).cast("int"), (F.col("pos") - F.col("r.low") + limit).cast("int")))
    return texts.join(once.select("k"), "k", "left_semi"), spans, texts


def remove_repeats(docs: DataFrame, text: str = "text", id_col: str = "doc_id", keep: tuple[str, ...] = (), limit: int = LIMIT, gram: int = GRAM, most: int = MOST, full: bool = False, passages: bool = False) -> DataFrame:
    """(id, kept columns, n_bytes, n_removed, n_spans, kept_sha256) of each row; with full=True also kept, the bytes
    that remain; with passages=True also n_passage_words, the words in passages of over fifty words that another document
    holds too (they are counted, not removed, unless the byte rule covers them).

    Texts are bytes of UTF-8; null is empty; matches never cross texts, and are judged on the input. Texts shorter than
    the limit stay whole. Rows with equal texts get equal results, repeated rows included; an empty table gives an
    empty result. A text has memory to its own size. Columns besides these are dropped.
    """
    shared = SharedPassages(docs, text, id_col) if passages else None
    texts, spans, bodies = repeats(docs, text, id_col, limit, gram, most, shared.needed if shared else None)
    by_text = spans.groupBy("k").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    source = modest_batches(texts.join(by_text, "k").select("k", "body", "spans"))
    more = ", kept binary" if full else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, body, found in zip(batch.column("k").to_pylist(), batch.column("body").to_pylist(), batch.column("spans")):
                ranges = found.values.flatten()
                marks = np.zeros(len(body) + 1, np.int64)
                np.add.at(marks, ranges[0].to_numpy(), 1)
                np.add.at(marks, ranges[1].to_numpy(), -1)
                gone = np.cumsum(marks)[:-1] > 0
                edge = np.diff(np.concatenate([[False], gone]).astype(np.int8)) == 1
                left = np.frombuffer(body, np.uint8)[~gone].tobytes()
                rows.append((k, int(gone.sum()), int(edge.sum()), hashlib.sha256(left).hexdigest(), *[left] * full))
            names = ["__k", "__removed", "__spans", "__sha", *["kept"] * full]
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * full]
            yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(names, kinds))})

    parts = source.mapInArrow(run, f"__k binary, __removed bigint, __spans bigint, __sha string{more}")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col), *keep, F.unhex(F.md5(body)).alias("__k"), F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("__whole"), *[body.cast("binary").alias("__body")] * full)
    copied = saved(rows.groupBy("__k", "n_bytes").agg(F.count(F.lit(1)).alias("__n")).filter(f"__n > 1 and n_bytes >= {limit}").select("__k", F.col("n_bytes").alias("__removed"), F.lit(1).cast("long").alias("__spans"), F.sha2(F.lit(""), 256).alias("__sha"), *[F.lit(b"").alias("kept")] * full), "repeat-copies")
    found = saved(parts, "repeat-results").union(copied)
    if shared:
        found = found.join(saved(shared.counts(bodies).withColumnRenamed("k", "__k"), "passage-counts"), "__k", "full")
    result = rows.join(saved(found, "repeat-found"), "__k", "left")
    out = result.select(id_col, *keep, "n_bytes", F.coalesce("__removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("__spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("__sha", "__whole").alias("kept_sha256"), *[F.coalesce("kept", "__body").alias("kept")] * full, *[F.coalesce("n_passage_words", F.lit(0)).cast("long").alias("n_passage_words")] * passages)
    return out
