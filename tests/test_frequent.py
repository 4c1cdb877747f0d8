"""Profiles of frequent grams are those of all grams."""

import random

import pytest

from corpuscope.operators import frequent as FQ
from corpuscope.operators import profiles as P
from corpuscope.plans import queries as Q


def _rows(df):
    return sorted((str(r["corpus"]), r["n"], r["rnk"], r["gram"], r["cnt"], round(r["p"], 12)) for r in df.collect())


@pytest.mark.parametrize(("words", "grams", "top"), [(32_768, 65_536, 40), (60, 300, 25), (3, 30, 25), (32_768, 65_536, 100_000)])
def test_profiles_are_those_of_all_grams(spark, monkeypatch, words, grams, top):
    """every trigram was shuffled as a text. With few words or grams held, some corpora aren't sure and are counted whole."""
    monkeypatch.setattr(FQ, "WORDS", words)
    monkeypatch.setattr(FQ, "GRAMS", grams)
    monkeypatch.setattr(FQ, "HELD", 50)
    rng = random.Random(5)
    word = lambda k: f"w{min(int(rng.paretovariate(0.9)), k)}"
    docs = [("en" if i % 3 else "fr", i, [[word(200) for _ in range(rng.randrange(1, 15))] for _ in range(rng.randrange(5))]) for i in range(300)]
    docs += [("flat", 900 + i, [[f"x{i}", f"y{i}", f"z{i}"]]) for i in range(60)]  # all equally often
    docs += [(None, 999, [["a", "b", "a", "b", "c"]]), ("none", 1000, []), ("", 1001, [["a"], ["b"], ["a", "é"]]), ("null", 1002, None)]
    c = spark.createDataFrame(docs, "corpus string, doc_id long, seqs array<array<string>>").repartition(3)
    assert _rows(FQ.word_profiles(c, top=top)) == _rows(P.word_profiles(c, top=top))


def test_frequent_grams_alone_are_shuffled(spark, sf_dir, monkeypatch):
    """where the counts decide it, no gram's text is counted."""
    monkeypatch.setattr(P, "each_gram", lambda *a: pytest.fail("all grams were counted"))
    c = spark.createDataFrame([("en", i, [["a", "b", "c", "d"], ["a", "b"]]) for i in range(9)], "corpus string, doc_id long, seqs array<array<string>>")
    assert FQ.word_profiles(c).count() == 5


def test_vectors_read_one_written_table(spark, sf_dir):
    """each reader tokenized all texts again."""
    for name in ("structural_vector", "feature_vector15"):
        assert "regexp_extract_all" not in Q.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
