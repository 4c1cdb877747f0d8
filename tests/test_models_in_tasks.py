"""Bigram models are counted inside tasks."""

from collections import Counter

import pytest

from corpuscope.operators import lm as L
from corpuscope.operators.cooc import vocabulary


@pytest.mark.parametrize("held", [1_000_000, 3])
def test_transitions_shuffle_no_tokens(spark, monkeypatch, held):
    """all tokens of the vocabulary were shuffled to be put back in order; documents of equal ids were mixed."""
    monkeypatch.setattr(L, "HELD_PAIRS", held)
    docs = [("en", i // 2, [[f"t{(i * j + j * j) % (7 + s)}" for j in range((i + 3 * s) % 9)] for s in range(3)]) for i in range(30)]
    docs += [("fr", 1, [["a", "b", "rare", "a", "c", "c"], []]), (None, 2, [["a", "b"]])]
    c = spark.createDataFrame(docs, "corpus string, doc_id long, seqs array<array<string>>").repartition(3)
    known = {}
    for r in vocabulary(c, 5).collect():
        known.setdefault(r["corpus"], set()).add(r["token"])
    want = Counter()
    for corpus, _, seqs in docs:
        for s in seqs if corpus else []:
            kept = [t for t in s if t in known[corpus]]
            want.update((corpus, a, b) for a, b in zip(kept, kept[1:]))
    model = L.transitions(c, 5)
    assert {(r["corpus"], r["a"], r["b"]): r["cnt"] for r in model.collect()} == want
    assert "collect_list" not in model._jdf.queryExecution().optimizedPlan().toString()
