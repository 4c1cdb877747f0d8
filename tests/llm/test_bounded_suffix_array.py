"""The suffix array as far as a string reaches, against sorting."""

import numpy as np
import pytest

from corpuscope.llm import repeats
from corpuscope.llm.suffix_array import bounded_suffix_array


@pytest.mark.parametrize(("n", "kinds", "most"), [(1, 1, 1), (1, 1, 9), (500, 2, 1), (500, 2, 7), (500, 1, 145), (4000, 3, 145), (4000, 250, 30), (3000, 40, 3000)])
def test_bounded_suffix_arrays(n, kinds, most):
    rng = np.random.default_rng(n + kinds + most)
    s = rng.integers(0, kinds, n)
    s[n // 2 :] = s[: n - n // 2]
    places = np.flatnonzero(rng.random(n) < 0.7) if n > 1 else np.arange(n)
    at, run = bounded_suffix_array(s, most, places)
    body = {i: s[i : i + most].tolist() for i in places.tolist()}
    assert sorted(at.tolist()) == places.tolist()
    assert [body[i] for i in at.tolist()] == sorted(body.values())
    told = [body[i] for i in at.tolist()]
    assert (np.diff(run) == [x != y for x, y in zip(told, told[1:])]).all()


def test_shards_are_sorted_as_far_as_strings_reach(monkeypatch):
    """op3: the whole suffixes of a shard were sorted, symbol by symbol, though only side + 1 symbols count."""
    asked = []
    monkeypatch.setattr(repeats, "bounded_suffix_array", lambda s, most, places: asked.append((most, len(places))) or bounded_suffix_array(s, most, places))
    anchor, side = b"a" * 20, 40
    contexts = [b"x" * side + anchor + b"y" * side, b"x" * 30 + anchor + b"y" * side, b"z" * side + anchor + b"z" * side]
    hits = repeats.shard_repeats(contexts, np.array([side, 30, side]), np.zeros(3, np.int64), np.full(3, side), 60, 20)
    assert [x.tolist() for x in hits] == [list(range(31)), list(range(31)), []]
    assert asked == [(side + 1, 41 + 31 + 41)]
