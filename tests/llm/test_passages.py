"""Words in passages that another document holds too, against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from corpuscope.llm import common, passages, repeats
from corpuscope.llm.passages import SharedPassages

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows, words):
    where = defaultdict(set)
    cut = [(i, WORD.findall((t or "").encode())) for i, t in rows]
    for i, w in cut:
        for p in range(len(w) - words + 1):
            where[tuple(w[p : p + words])].add(i)
    out = []
    for i, w in cut:
        covered = {q for p in range(len(w) - words + 1) if len(where[tuple(w[p : p + words])]) > 1 for q in range(p, p + words)}
        out.append((i, len(covered)))
    return sorted(out, key=str)


def random_rows(seed, kinds, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(kinds)]
    draw = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    shared = [draw(rng.randrange(5, 40)) for _ in range(12)]
    gap = lambda: rng.choice([" ", "\n", "\t ", "  "])
    rows = [(i, gap().join(rng.choice([draw(rng.randrange(0, 30)), rng.choice(shared), rng.choice(shared)[3:]]) for _ in range(rng.randrange(0, 7)))) for i in range(n)]
    rows += [(1000 + i, shared[0] + " " + shared[1]) for i in range(5)] + [(2000, None), (2001, ""), (2002, "x " * 90), (2003, "x " * 70), (2003, "x " * 70), (3000, "lone " * 80)]
    return rows


@pytest.mark.parametrize("kinds", [3, 300])
def test_shared_passages(spark, monkeypatch, kinds):
    monkeypatch.setattr(common, "COMMON_ROWS", 5)  # the way of common keys as well
    rows = random_rows(kinds, kinds, 120)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = SharedPassages(docs, words=13, gram=3)
    from pyspark.sql import functions as F

    texts = common.saved(docs.select(F.unhex(F.md5("text")).alias("k"), F.col("text").cast("binary").alias("body")).filter("k is not null").dropDuplicates(["k"]).join(found.needed, "k", "left_semi"), "test-bodies")
    counts = found.counts(texts)
    got = docs.select("doc_id", F.unhex(F.md5("text")).alias("k")).join(counts, "k", "left").select("doc_id", F.coalesce("n_passage_words", F.lit(0)).alias("n")).collect()
    assert sorted(((r["doc_id"], r["n"]) for r in got), key=str) == brute(rows, 13)


def test_passages_beside_bytes(spark):
    """Whole sizes: a passage of 51 short words that no 400-byte string can show; a text above two slices."""
    rng = random.Random(3)
    draw = lambda k: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(k))
    passage, short, line = draw(51), draw(50), draw(400)
    long_text = draw(500_000)
    rows = [(1, f"{draw(40)} {passage} {draw(30)}"), (2, f"{draw(10)}\n{passage}\n{draw(70)}"), (3, f"{draw(40)} {short} {draw(3)}"), (4, f"{short} {draw(5)}"), (5, draw(300))]
    rows += [(6, long_text + " " + line), (7, line), (8, line[:399]), (9, "z" * 3_000_000), (10, "z" * 399), (11, None)]
    got = {r["doc_id"]: r for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), passages=True).collect()}
    assert [got[i]["n_passage_words"] for i in range(1, 6)] == [51, 51, 0, 0, 0]
    assert [got[i]["n_removed"] for i in range(1, 6)] == [0] * 5 and len(long_text) > 2 * repeats.SLICE_BYTES
    assert got[6]["n_removed"] == len(line) == got[7]["n_removed"] and got[6]["n_spans"] == 1 and got[6]["n_passage_words"] == 400
    assert got[8]["n_removed"] == 0 and got[8]["n_passage_words"] > 51
    assert got[9]["n_removed"] == 3_000_000 and got[10]["n_removed"] == 0 and got[11]["n_passage_words"] == 0


def test_narrowed_places_lose_none():
    rng = np.random.default_rng(3)
    limit, gram = 60, 20
    side = limit - gram
    anchor = bytes(rng.integers(97, 100, gram, np.uint8))
    base = [bytes(rng.integers(97, 99, side, np.uint8)) for _ in range(2)]
    contexts, lefts = [], []
    for i in range(60):
        left, right = bytearray(base[0]), bytearray(base[1])
        for part in (left, right):
            if i % 3:
                part[int(rng.integers(side))] = 120 + i % 5
        cut = int(rng.integers(0, side)) if i % 4 == 0 else 0
        contexts.append(bytes(left[cut:]) + anchor + bytes(right[: side - cut % 7]))
        lefts.append(side - cut)
    low, high = np.zeros(60, np.int64), np.full(60, side)
    low[:5], high[5:10] = 7, 20
    args = contexts, np.array(lefts), low, high, limit, gram
    whole = repeats.shard_repeats(*args)
    assert [x.tolist() for x in repeats._load_repeats(*args)] == [x.tolist() for x in whole]
    assert 0 < sum(map(len, whole)) < 60 * side


def test_anchors_of_very_many_words_are_those_of_few(monkeypatch):
    digests = np.random.default_rng(1).integers(0, 50, 5000).astype(np.uint64)
    ends = np.array([1000, 1030, 5000])
    few = passages.word_anchors(digests, ends)
    monkeypatch.setattr(passages, "_PLACES", np.uint64(0xFFF))
    many = passages.word_anchors(digests, ends)
    assert all(x.tolist() == y.tolist() for x, y in zip(few[:4], many[:4]))
