from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscope.operators import compare as C
from corpuscope.operators import cooc as O
from corpuscope.operators import features as FE
from corpuscope.operators import panels as PN
from corpuscope.operators import profiles as P
from corpuscope.operators import rewrite as RW
from corpuscope.operators import samples as S
from corpuscope.operators.corpus import sequences, types
from corpuscope.operators.families import assignment

THREES = [["olive", "stone", "river"], ["stone", "lamp", "olive"], ["river", "stone", "cedar"], ["moss", "fern", "reed"]]


def corpus(spark, seqs, name="x"):
    return spark.createDataFrame([(name, i, [s]) for i, s in enumerate(seqs)], "corpus string, doc_id long, seqs array<array<string>>")


def test_feature_corpus(spark):
    f = FE.feature_vector(corpus(spark, THREES)).first().asDict()
    assert f["f01_ttr"] == pytest.approx(8 / 12) and f["f11_hapax_ratio"] == pytest.approx(5 / 8) and f["f18_dislegomena_to_hapax"] == pytest.approx(2 / 5)
    assert f["f08_seq_length_variance"] == f["f21_sentence_length_skewness"] == f["aux_sentence_length_excess_kurtosis"] == 0
    assert f["f12_zipf_slope_10_1000"] == f["f16_heaps_beta"] == 0 and f["f04_log_mean_seq_len"] == pytest.approx(np.log(4))


def test_bigrams_and_windows(spark):
    c = corpus(spark, [["a", "b", "c"], ["a", "b"]])
    p = {r["gram"]: r["p"] for r in P.profile(P.gram_counts(c, 2)).collect()}
    assert p == {"a | b": pytest.approx(2 / 3), "b | c": pytest.approx(1 / 3)}
    raw = {(r["row_tok"], r["col_tok"]): r["cnt"] for r in O.cooccurrence(corpus(spark, [["a", "a", "b"]])).collect()}
    assert raw == {("a", "a"): 2, ("a", "b"): 2, ("b", "a"): 2}
    pos = {r["token"]: r for r in O.positional(corpus(spark, [["a", "b", "c"]])).collect()}
    assert pos["b"]["medial_rate"] == 1 and pos["b"]["mean_norm_pos"] == 0.5 and pos["c"]["final_rate"] == 1
    alone = O.positional(corpus(spark, [["a"]])).first()
    assert (alone["initial_rate"], alone["final_rate"]) == (1, 0)


def test_cosine_ends(spark):
    df = spark.createDataFrame([("p", "k", "g", 1.0), ("q", "k", "g", 0.5), ("r", "k", "h", 1.0)], "corpus string, kind string, gram string, p double")
    got = {(r["corpus_a"], r["corpus_b"]): r["cosine"] for r in C.profile_cosines(df, df).collect()}
    assert got["p", "q"] == 1 and got["p", "r"] == 0


def test_spearman_ties(spark):
    rows = [(str(i), f, float(v)) for i, vs in enumerate([(1, 3, 1), (2, 2, 1), (3, 1, 2)]) for f, v in zip("abc", vs)]
    rho = {(r["feature_a"], r["feature_b"]): r["rho"] for r in C.spearman(spark.createDataFrame(rows, "corpus string, feature string, value double")).collect()}
    assert rho["a", "a"] == pytest.approx(1) and rho["a", "b"] == pytest.approx(-1) and rho["a", "c"] == pytest.approx(3**0.5 / 2)


def test_assignment_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n, m = rng.integers(1, 6, 2)
        cost = rng.random((n, m)).round(2)
        got = assignment(cost)
        used = got[got >= 0]
        assert len(set(used)) == len(used) == min(n, m)
        wide = cost if n <= m else cost.T
        best = min(sum(wide[i, j] for i, j in enumerate(p)) for p in permutations(range(wide.shape[1]), wide.shape[0]))
        assert sum(cost[i, j] for i, j in enumerate(got) if j >= 0) == pytest.approx(best)


def test_budgets(spark):
    c = corpus(spark, [["a", "b", "c"], ["d", "e"], ["f", "g", "h", "i"]])
    for f in (lambda b: S.budget_sample(c, b), lambda b: S.budget_prefix(c, b)):
        assert sum(len(r["tokens"]) for r in f(5).collect()) == 5
    with pytest.raises(Exception, match="too few tokens"):
        S.budget_sample(c, 10, strict=True).collect()


def test_ladder(spark):
    got = S.ladder(spark.range(62).withColumn("run", F.lit(1)), "id", "run").select("i").collect()
    assert sorted(r["i"] for r in got) == [0, 15, 30, 45, 58, 61]


def test_rewrites(spark):
    seqs = sequences(corpus(spark, [["a", "b", "a", "b"], ["c"], ["b", "a"]]))
    rows = lambda df: {r["doc_id"]: r["tokens"] for r in df.collect()}
    assert rows(RW.swap_bigram(seqs, "a", "b")) == {0: ["b", "a", "b", "a"]}
    assert rows(RW.merge_bigram(seqs, "a", "b")) == {0: ["ab", "ab"]}
    assert rows(RW.split_token(seqs, "c", "x", "y")) == {1: ["x", "y"]}
    assert rows(RW.rewrite_tokens(seqs, {"c": "d"})) == {1: ["d"]}
    new = RW.overlay(seqs, RW.split_token(seqs, "c", "x", "y"))
    delta = {r["token"]: r["delta"] for r in RW.token_deltas(RW.changed_sequences(seqs, new)).collect()}
    assert delta == {"c": -1, "x": 1, "y": 1}
    counts = {r["token"]: r["cnt"] for r in RW.updated_counts(types(corpus(spark, [["a", "b", "a", "b"], ["c"], ["b", "a"]])), RW.token_deltas(RW.changed_sequences(seqs, new)), "token").collect()}
    assert counts == {"a": 3, "b": 3, "x": 1, "y": 1}


def test_panel(spark):
    items, focal = tuple("abcdefghi"), tuple("abcde")
    rows = [(s, x, y, 0.2 if x in focal and y in focal else 1.0) for s in (1, 2, 3) for i, x in enumerate(items) for y in items[i + 1 :]]
    pairs = PN.checked_pairs(spark.createDataFrame(rows, "seed long, left string, right string, auc double"), items, (1, 2, 3))
    assert all(r["effect"] == pytest.approx(0.8) and r["replicates"] for r in PN.panel_contrast(pairs, focal).collect())
    tail = PN.allocation_tail(PN.label_allocations(pairs, items, 5), 31).first()
    assert (tail["extreme"], tail["allocations"]) == (1, 126)
    with pytest.raises(ValueError):
        PN.checked_pairs(spark.createDataFrame(rows[1:], "seed long, left string, right string, auc double"), items, (1, 2, 3))


def test_plateau_needs_more_than_the_window(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(12)], "b int, m double")
    assert [r["plateau"] for r in PN.plateaus(df, "b", ("m",)).orderBy("b").collect()] == [False] * 10 + [True] * 2


def test_mann_whitney(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (1, 3.0), (1, 4.0)], "side int, value double")
    row = PN.mann_whitney(df).first()
    assert row["u"] == 0 and row["p_less"] == pytest.approx(1 / 6)


def test_frontier(spark):
    rows = [("a", "cooccurrence", "x", 0.9), ("a", "cooccurrence", "y", 0.8), ("b", "cooccurrence", "x", 0.7), ("b", "cooccurrence", "x", 0.1)]
    got = O.frontier(spark.createDataFrame(rows, "row_tok string, component string, col_tok string, distance double")).collect()
    assert sorted((r["row_tok"], r["col_tok"]) for r in got) == [("a", "y"), ("b", "x")]
