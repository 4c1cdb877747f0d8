"""Plans and results of what was made to grow with its input."""

import random

from pyspark.sql import functions as F

from corpuscope.operators import cooc as O
from corpuscope.operators import features as FE
from corpuscope.operators import profiles as P
from corpuscope.operators import tensor as T
from corpuscope.operators.corpus import corpus_documents, sequences, types
from corpuscope.plans import queries as Q


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def made(spark, n=60, seed=3):
    rng = random.Random(seed)
    ids = [None, None, *(rng.randrange(n) for _ in range(n))]  # some twice or more
    rows = [("en" if rng.random() < 0.7 else None, i, ". ".join(" ".join(f"W{'abcdefgh'[rng.randrange(8)]}{'xyzuv'[rng.randrange(5)] * rng.randrange(1, 6)}" for _ in range(rng.randrange(1, 9))) for _ in range(3))) for i in ids]
    return corpus_documents(spark.createDataFrame(rows, "lang string, doc_id long, text string"))


def test_rankings_beyond_a_thousand_cut_each_task(spark, sf_dir):
    """One task sorted a whole corpus."""
    c = Q.corpora(spark, sf_dir)
    assert "WindowGroupLimit" in plan(P.profile(P.gram_counts(c, 3)))
    assert "WindowGroupLimit" in plan(P.char_profiles(types(c)))


def test_texts_are_tokenized_once_a_reader(spark, sf_dir):
    c = Q.corpora(spark, sf_dir)
    one = plan(c.select(F.size("seqs"))).count("regexp_extract_all(")
    for df in (sequences(c), types(c), P.word_profiles(c)):
        assert plan(df).count("regexp_extract_all(") == one


def test_parts_are_those_of_first_places(spark):
    """F16: places follow from documents' sizes alone; equal and null ids too."""
    c = made(spark)
    docs = [(r["corpus"], r["doc_id"], r["digest"], [t for s in r["seqs"] for t in s]) for r in c.withColumn("digest", F.xxhash64("seqs")).collect()]
    docs.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
    want = {}
    for corpus in {d[0] for d in docs}:
        run = [t for d in docs if d[0] == corpus for t in d[3]]
        low = max(50, len(run) // 24)
        points = list(dict.fromkeys([*(int(low + i * (len(run) - low) / 11.0) for i in range(11)), len(run)]))
        for t in set(run):
            want[corpus, t] = (run.count(t), sum(p <= run.index(t) for p in points))
    assert {(r["corpus"], r["token"]): (r["cnt"], r["part"]) for r in FE.placed_types(c).collect()} == want


def test_pairs_outside_the_vocabulary_are_left_out_first(spark):
    """all pairs were shuffled."""
    c = made(spark).filter("corpus IS NOT NULL")
    base = sequences(c)
    changes = base.filter("doc_id % 7 = 0").select("corpus", F.col("tokens").alias("old"), F.reverse("tokens").alias("new"))
    whole = T.in_vocabulary(T.updated(T.raw_pairs(base), changes), types(c), 9)
    got = T.updated_in_vocabulary(base, changes, types(c), top=9)
    rows = lambda df: sorted(map(tuple, df.select("corpus", "row_tok", "col_tok", "cnt").collect()))
    assert rows(got) == rows(whole) and rows(got)
    first = plan(O.cooccurrence(c, top=9)).split("Aggregate")[2]  # the lower one, over the joins
    assert "LeftSemi" in first


def test_source_features_are_worked_out_once(spark, sf_dir):
    """Joins of the features with themselves tokenized again."""
    for name in ("pairwise_distance", "frozen_distances"):
        assert "regexp" not in plan(Q.QUERIES[name](spark, sf_dir)), name


def test_pairs_are_counted_inside_tasks(spark, monkeypatch):
    """every pair was shuffled as two texts. Small buffers make a task count and give out often."""
    from corpuscope.plans.queries import QUERIES

    c = made(spark).filter("corpus IS NOT NULL").union(spark.createDataFrame([("fr", 7, [["a", "a", "a", "b"], [], ["b"]]), ("none", 8, [])], "corpus string, doc_id long, seqs array<array<string>>"))
    rows = lambda df: sorted(map(tuple, df.select("corpus", "row_tok", "col_tok", "cnt").collect()))
    want = rows(O.cooccurrence(c, top=9))
    assert rows(O.written_cooccurrence(c, top=9)) == want and want
    monkeypatch.setattr(O, "HELD", 20)
    assert rows(O.written_cooccurrence(c, top=9)) == want
    monkeypatch.setattr(O, "MOST_KNOWN", 3)
    assert rows(O.written_cooccurrence(c, top=9)) == want


def test_mirrors_that_differ_are_found(spark):
    """the table was joined with itself. A row on each side, as a full join has."""
    table = [("x", "a", "b", 2), ("x", "b", "a", 2), ("x", "a", "a", 4), ("x", "a", "c", 1), ("x", "d", "c", 3), ("x", "c", "d", 5), ("y", "b", "a", 2)]
    df = spark.createDataFrame(table, "corpus string, row_tok string, col_tok string, cnt long")
    assert "Join" not in plan(O.symmetric(df))
    got = {tuple(r) for r in O.symmetric(df).collect()}
    assert got == {("x", "a", "c", 1, None), ("x", "c", "a", None, 1), ("x", "d", "c", 3, 5), ("x", "c", "d", 5, 3), ("y", "b", "a", 2, None), ("y", "a", "b", None, 2)}


def test_an_update_of_pairs_needs_no_join_of_texts(spark, sf_dir):
    """all sequences were joined by their keys to find those that a split changes."""
    made_of = plan(Q.QUERIES["tensor_update"](spark, sf_dir))
    assert "Join" not in made_of and "regexp" not in made_of
