"""Near-duplicates of the pipeline against all pairs by brute force."""

import random
from collections import defaultdict

import pytest

import corpus_pipeline
from corpuscope.llm import near

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 5 else {tuple(words)} if words else set()


def brute_classes(texts):
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or len(a & b) >= 0.8 * len(a | b):
                parent[root(i)] = root(j)
    out = defaultdict(set)
    for i in range(len(texts)):
        out[root(i)].add(i)
    return {frozenset(v) for v in out.values()}


def copies():
    """Copies with 0 to 6 changed words of 80 to 200, a large group, short and empty texts."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = ["", "  ", "one two", "One  two", "one two three"]
    for size in [1, 3, 5] * 8 + [60]:
        base = [word() for _ in range(rng.randrange(80, 200))]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randrange(0, 7)):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize(("small", "block"), [(16, 1024), (2, 8)])
def test_classes_are_those_of_all_pairs(spark, small, block):
    texts = copies()
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], SCHEMA)
    got = defaultdict(set)
    for r in near.near_duplicates(df, small=small, block=block).collect():
        got[r["root"]].add(r["doc_id"])
    assert {frozenset(v) for v in got.values()} == brute_classes(texts)


def test_pipeline_stage_takes_similar_texts(spark):
    """Fingerprints of these differ in more than three bits."""
    texts = copies()
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], SCHEMA)
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect())
    assert kept == sorted(min(c) for c in brute_classes(texts))


def test_fingerprints_bring_candidates_of_their_own(spark):
    """the stage named after SimHash took candidates from bands only."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(9000)}" for _ in range(3000)]
    other = [*base[:1500], "x", *base[1501:]]
    texts = ["", " ".join(base), " ".join(other), "one two three four five six seven", " ".join(reversed(base))]
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], SCHEMA)
    marked = near._marked(df, "text", ("doc_id",), 5).persist()
    key = {r["doc_id"]: r["k"] for r in marked.collect()}
    assert [tuple(r) for r in near.by_fingerprints(marked).collect()] == [tuple(sorted((key[1], key[2])))]
    assert {r["doc_id"]: r["fp"] for r in marked.collect()}[0] == 0


def test_only_texts_of_candidates_are_taken_apart_again(spark, monkeypatch):
    """Pipeline's disk: the sets of all texts were shuffled for those of a few."""
    seen = []
    whole = near._sets
    monkeypatch.setattr(near, "_sets", lambda docs, *a: seen.append(docs.count()) or whole(docs, *a))
    texts = [f"a{i} b{i} c{i} d{i} e{i} f{i} g{i}" for i in range(40)] + ["p q r s t u v w x y z"] * 5 + ["P q r s t u v w x  y z a"]
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], SCHEMA)
    near.near_duplicates(df).count()
    assert seen == [2]
