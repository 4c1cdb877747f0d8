"""Cutting stock by column generation: lengths by class are cut from stock of one size, as little of it as possible.

A pattern says how many pieces of each class one stock holds. The linear program over patterns is solved by the simplex
method on a basis with as many patterns as classes; a knapsack by dynamic programming over the stock's size finds the pattern
that the dual prices value most. It ends when no pattern is worth more than one stock and a tolerance, which bounds the
distance to the optimum by the same share. Whole numbers of each pattern are kept; the few pieces that are left are put where
they fit best. The size of the problem is that of the classes, whatever the number of pieces.
"""

from __future__ import annotations

import numpy as np

#: A solution this near to the linear program's bound is good enough.
TOLERANCE = 0.002
#: The inverse of the basis is computed anew after so many exchanges.
FRESH = 64
#: Patterns that one knapsack offers.
COLUMNS = 48
#: Long pieces are worth a little more than their size when the first patterns are sought.
LONG_FIRST = 1.05
#: Exchanges for each class after which the patterns found so far are taken; they only waste more.
MOST_ROUNDS = 10


def knapsack(sizes: np.ndarray, prices: np.ndarray, stock: int) -> tuple[np.ndarray, np.ndarray]:
    """The highest total price of pieces for every size up to the stock's, any number of each class, and the classes that
    take part, those that cheaper pieces replace left out."""
    worth = np.zeros(stock + 1)
    useful = []
    for i in np.argsort(-prices / sizes, kind="stable").tolist():
        size, price = int(sizes[i]), float(prices[i])
        if price <= worth[size] + 1e-12:
            continue
        useful.append(i)
        step, gain = size, price
        while step <= stock:  # once, twice, four times ..
            worth[step:] = np.maximum(worth[step:], worth[:-step] + gain)
            step, gain = 2 * step, 2 * gain
    return worth, np.array(useful, np.int64)


def traced(worth: np.ndarray, useful: np.ndarray, sizes: np.ndarray, prices: np.ndarray, at: int) -> np.ndarray:
    """The pieces that make up the highest price of the size `at`."""
    pattern, order = np.zeros(len(sizes), np.int64), useful[sizes[useful] <= at]
    while len(order):
        total = worth[at - sizes[order]] + prices[order]
        k = int(np.argmax(total))
        if total[k] < worth[at] - 1e-9:  # the best of this size leaves something unused
            at -= 1
        else:
            pattern[order[k]] += 1
            at -= int(sizes[order[k]])
        order = order[sizes[order] <= at]
    return pattern


def priced(sizes: np.ndarray, prices: np.ndarray, stock: int, tolerance: float) -> np.ndarray:
    """Patterns (rows) worth more than one stock and the tolerance: for each of some classes the best that holds it."""
    worth, useful = knapsack(sizes, prices, stock)
    held = worth[stock - sizes] + prices
    out = []
    for i in np.argsort(-held, kind="stable")[:COLUMNS].tolist():
        if held[i] <= 1.0 + tolerance:
            break
        pattern = traced(worth, useful, sizes, prices, stock - int(sizes[i]))
        pattern[i] += 1
        out.append(pattern)
    return np.unique(np.array(out), axis=0) if out else np.zeros((0, len(sizes)), np.int64)


def exhausting(sizes: np.ndarray, demand: np.ndarray, stock: int) -> tuple[np.ndarray, np.ndarray]:
    """A first basis: the pattern that fills most, of long pieces rather than short ones, is used until one of its classes is
    used up, then the next of the other classes. Ordered by these classes the patterns are a triangle, so they are a basis."""
    m = len(sizes)
    patterns, used, left = np.zeros((m, m), np.int64), np.zeros(m), demand.astype(float)
    worth_of = (sizes / stock) ** LONG_FIRST
    open_ = np.ones(m, bool)
    while open_.any():
        own = np.flatnonzero(open_)
        worth, useful = knapsack(sizes[own], worth_of[own], stock)
        pattern = np.zeros(m, np.int64)
        pattern[own] = traced(worth, useful, sizes[own], worth_of[own], stock)
        has = np.flatnonzero(pattern)
        out = has[int(np.argmin(left[has] / pattern[has]))]
        patterns[out], used[out] = pattern, left[out] / pattern[out]
        left = np.maximum(left - used[out] * pattern, 0.0)
        open_[out] = False
    return patterns, used


def relaxed(sizes: np.ndarray, demand: np.ndarray, stock: int, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and how often each is used, in fractions, so that every class's demand is met."""
    m = len(sizes)
    patterns, used = exhausting(sizes, demand, stock)
    inverse, offered, rounds = np.linalg.inv(patterns.T.astype(float)), np.zeros((0, m), np.int64), 0
    least = float(sizes @ demand) / stock  # no solution needs less
    while used.sum() > least * (1 + tolerance):
        prices = inverse.sum(0)
        values = offered @ prices
        if not (values > 1.0 + tolerance).any():  # those found before are used up
            offered = priced(sizes, prices, stock, tolerance)
            if not len(offered):
                break
            values = offered @ prices
        column = offered[int(np.argmax(values))]
        change = inverse @ column
        ratio = np.where(change > 1e-9, used / np.where(change > 1e-9, change, 1.0), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]) or rounds > MOST_ROUNDS * m:  # any basis meets the demand
            break
        patterns[out] = column
        rounds += 1
        if rounds % FRESH == 0:
            inverse = np.linalg.inv(patterns.T.astype(float))
            used = np.maximum(inverse @ demand, 0.0)
            continue
        step = ratio[out]
        inverse[out] /= change[out]
        change[out] = 0.0
        used = np.maximum(used - change * step, 0.0)
        used[out] = step
        inverse -= np.outer(change, inverse[out])
    return patterns, used


def best_fit(sizes: np.ndarray, counts: np.ndarray, stock: int) -> list[dict[int, int]]:
    """Patterns of the pieces, one a stock: each piece, the longest first, goes where the least room is left."""
    rooms: dict[int, list[dict[int, int]]] = {}
    out: list[dict[int, int]] = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        for _ in range(int(counts[i])):
            room = min((r for r in rooms if r >= size), default=None)
            if room is None:
                room, mine = stock, {}
                out.append(mine)
            else:
                mine = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
            mine[i] = mine.get(i, 0) + 1
            rooms.setdefault(room - size, []).append(mine)
    return out


def cut(sizes: list[int], counts: list[int], stock: int, tolerance: float = TOLERANCE) -> list[tuple[dict[int, int], int]]:
    """(pattern {class: pieces}, times) that use each class exactly as often as it occurs."""
    if not sizes:
        return []
    size, left = np.array(sizes, np.int64), np.array(counts, np.int64)
    if size.min() < 1 or size.max() > stock or left.min() < 0:
        raise ValueError("sizes must lie between 1 and the stock's, and counts must not be negative")
    patterns, used = relaxed(size, left.astype(float), stock, tolerance)
    out: list[tuple[dict[int, int], int]] = []
    for k in np.argsort(-used, kind="stable").tolist():
        has = np.flatnonzero(patterns[k] > 0)
        times = min(int(used[k] + 1e-6), int((left[has] // patterns[k][has]).min()) if len(has) else 0)
        if times > 0:
            left -= times * patterns[k]
            out.append(({int(i): int(patterns[k][i]) for i in has}, times))
    return out + [(pattern, 1) for pattern in best_fit(size, left, stock)]
