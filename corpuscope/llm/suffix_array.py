"""Suffix arrays by induced sorting, and permuted common prefixes: plain integers, one process, linear time. Suffix arrays
as far as the order of the first symbols goes, by sorting ranks of ever more of them: a few sorts of whole arrays."""

from __future__ import annotations

import numpy as np


#: With so few symbols, and no run longer than LONG, buckets are dealt at once instead of a place at a time.
FEW, LONG = 1024, 1024


def _longest_run(s: np.ndarray) -> int:
    edges = np.flatnonzero(np.diff(s))
    return int(np.diff(np.concatenate([[-1], edges, [len(s) - 1]])).max())


def suffix_types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one. The last symbol must be the only smallest."""
    n = len(s)
    up = np.empty(n, bool)
    up[-1] = True
    step = np.sign(np.diff(s))
    # In a run of equal symbols the type is that of the run's end.
    moves = np.flatnonzero(step)
    at = np.searchsorted(moves, np.arange(n - 1))
    up[:-1] = step[moves[at]] > 0
    return up


def _induce(s: list[int], smaller: list[bool], first: list[int], sa: list[int]) -> None:
    """From the leftmost-smaller suffixes that sa holds at the ends of their buckets: the greater ones from the left, then
    the smaller ones from the right."""
    head = first[:-1]
    for i in range(len(sa)):
        j = sa[i] - 1
        if j >= 0 and not smaller[j]:
            c = s[j]
            sa[head[c]] = j
            head[c] += 1
    tail = first[1:]
    for i in range(len(sa) - 1, -1, -1):
        j = sa[i] - 1
        if j >= 0 and smaller[j]:
            c = s[j]
            tail[c] -= 1
            sa[tail[c]] = j


def _induce_by_bucket(s: np.ndarray, smaller: np.ndarray, first: np.ndarray, sa: np.ndarray, seeds: np.ndarray) -> None:
    """The same for few symbols, a bucket at a time: what a bucket induces is dealt to the other buckets in one go; what
    falls into the bucket itself (a run of its symbol) is the next round."""
    size = len(first) - 1
    head, tail = first[:-1].copy(), first[1:].copy()

    def deal(j: np.ndarray, up: bool) -> None:
        if not len(j):
            return
        c = s[j]
        order = np.argsort(c, kind="stable")
        n = np.bincount(c, minlength=size)
        place = np.arange(len(j)) - np.repeat(np.cumsum(n) - n, n)
        c = c[order]
        if up:
            sa[head[c] + place] = j[order]
            head[:] += n
        else:
            sa[tail[c] - 1 - place] = j[order]
            tail[:] -= n

    for c in range(size):
        done = first[c]
        while done < head[c]:
            j, done = sa[done : head[c]] - 1, head[c]
            j = j[j >= 0]
            deal(j[~smaller[j]], True)
        j = sa[first[c + 1] - seeds[c] : first[c + 1]] - 1
        deal(j[(j >= 0) & ~smaller[j]], True)
    for c in range(size - 1, -1, -1):
        done = first[c + 1]
        while done > tail[c]:
            j, done = sa[tail[c] : done][::-1] - 1, tail[c]
            j = j[j >= 0]
            deal(j[smaller[j]], False)
        j = sa[first[c] : head[c]][::-1] - 1
        j = j[j >= 0]
        deal(j[smaller[j]], False)


def suffix_array(s: np.ndarray, size: int) -> np.ndarray:
    """Suffix array of symbols 0 .. size-1; the last symbol is 0 and the only 0."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    up = suffix_types(s)
    lms = np.flatnonzero(up[1:] & ~up[:-1]) + 1
    bounds = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=size))])
    by_bucket = size <= FEW and _longest_run(s) <= LONG
    first, symbols, smaller = (None, None, None) if by_bucket else (bounds.tolist(), s.tolist(), up.tolist())

    def sorted_from(starts: np.ndarray) -> np.ndarray:
        if by_bucket:
            sa = np.full(n, -1, np.int64)
            c = s[starts]
            seeds = np.bincount(c, minlength=size)
            order = np.argsort(c, kind="stable")
            sa[bounds[1:][c[order]] - np.repeat(np.cumsum(seeds), seeds) + np.arange(len(starts))] = starts[order]
            _induce_by_bucket(s, up, bounds, sa, seeds)
            return sa
        return np.array(listed_from(starts.tolist()), np.int64)

    def listed_from(starts: list[int]) -> list[int]:
        sa = [-1] * n
        tail = first[1:]
        for j in reversed(starts):
            c = symbols[j]
            tail[c] -= 1
            sa[tail[c]] = j
        _induce(symbols, smaller, first, sa)
        return sa

    order = sorted_from(lms)
    # Name the substrings between leftmost-smaller places, in their order.
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = order[is_lms[order]]
    new = _differ(s, lms, order)
    names = np.full(n, -1, np.int64)
    names[order] = np.cumsum(new) - 1
    reduced = names[lms]
    kinds = int(reduced.max()) + 1
    if kinds < len(lms):
        inner = suffix_array(reduced, kinds)
    else:
        inner = np.empty(len(lms), np.int64)
        inner[reduced] = np.arange(len(lms))
    return sorted_from(lms[inner])


def _differ(s: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Whether each leftmost-smaller substring differs from the one before it in the order. Substrings of one length
    have equal symbols exactly if they are equal, types included."""
    n = len(s)
    length = np.zeros(n, np.int64)
    length[lms[:-1]] = np.diff(lms) + 1
    length[lms[-1]] = 1
    a, b = order[:-1], order[1:]
    new = np.ones(len(order), bool)
    live = np.flatnonzero(length[a] == length[b])
    k = 0
    equal = np.zeros(len(a), bool)
    while len(live):
        same = s[a[live] + k] == s[b[live] + k]
        live = live[same]
        k += 1
        done = length[a[live]] <= k
        equal[live[done]] = True
        live = live[~done]
    new[1:] = ~equal
    return new


def permuted_common_prefixes(s: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each place the common prefix, up to `most`, with the suffix before it in the array (0 for the first). The
    prefix at a place is at least that at the place before, less one; places are done at wide steps first and the
    bounds passed on to the places between."""
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(n, np.int64)
    # Symbols go by words of several, so that one comparison covers them all; past the end stands a symbol of its own.
    width = max(1, int(s.max()) + 1).bit_length()
    span = 62 // width
    padded = np.concatenate([s, np.full(most + span, (1 << width) - 1, np.int64)])
    packed = np.zeros(n + most + 1, np.int64)
    for k in range(span):
        packed |= padded[k : k + len(packed)] << (k * width)
    steps = np.int64(1) << (np.arange(1, span + 1, dtype=np.int64) * width)
    stride = 64
    while stride >= 1:
        at = np.arange(0, n, stride) if stride == 64 else np.arange(stride, n, 2 * stride)
        if stride < 64:
            out[at] = np.maximum(out[at - stride] - stride, 0)
        live = at[before[at] >= 0]
        while len(live):
            apart = packed[live + out[live]] ^ packed[before[live] + out[live]]
            # The lowest bit that differs lies in the first symbol that does.
            equal = np.searchsorted(steps, apart & -apart, side="right")
            equal[apart == 0] = span
            out[live] = np.minimum(out[live] + equal, most)
            live = live[(equal == span) & (out[live] < most)]
        stride //= 2
    return out


def bounded_suffix_array(s: np.ndarray, most: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that begin at `places`, in the order of their first `most` symbols (a suffix that ends is less), and for
    each the number of its run: suffixes of one run share these symbols."""
    n = len(s)
    known = np.cumsum(np.bincount(s) > 0)
    rank, kinds, depth = known[s], int(known[-1]), 1  # 0 stands past the end
    while True:
        # As many ranks as a key has room for, the first one highest.
        width = kinds.bit_length()
        span = min(62 // width, -(-most // depth))
        starts = [min(k * depth, most - depth) for k in range(span)]
        depth = starts[-1] + depth
        at = np.arange(n) if depth < most else places
        padded = np.concatenate((rank, np.zeros(starts[-1], np.int64)))
        key = np.zeros(len(at), np.int64)
        for start in starts:
            key = key << width | (padded[start : start + n] if depth < most else padded[at + start])
        order = np.argsort(key)
        run = np.cumsum(np.diff(key[order], prepend=-1) != 0)
        if depth >= most:
            return at[order], run
        rank, kinds = np.empty(n, np.int64), int(run[-1])
        rank[order] = run
