import pytest
from pyspark.sql import functions as F

from corpuscope.operators import features as FE
from corpuscope.operators import measures as M
from corpuscope.operators import rewrite as RW
from corpuscope.operators.corpus import sequences
from corpuscope.operators.objective import REPORTED, FrozenObjective
from corpuscope.operators.search import Candidate, SearchConfig, Step, _pool_corpora, audit, changed_by, load_records, run_search
from corpuscope.plans.queries import corpora

WORDS = "der wind geht uber das land und sturm wasser zieht an ufer wald mann sieht kind".split()
#: Lengths 0 to 11, several sequences a document, words that first occur late.
SEQS = [[[WORDS[(i * j + j * j + s) % (4 + i // 4)] for j in range((i * 5 + s * 7) % 12)] for s in range(3)] for i in range(48)]
POOL = {
    0: Candidate("map", "", 0, (Step("map", (("wind", "sturm"), ("kind", "kinder"))),)), 1: Candidate("split", "", 0, (Step("split", tokens=("geht", "ge", "ht")),)),
    2: Candidate("merge", "", 0, (Step("merge", tokens=("der", "wind")),)), 3: Candidate("rotate", "", 0, (Step("span_rotate", tokens=("3", "40")),)),
    4: Candidate("both", "", 0, (Step("split", tokens=("das", "da", "s")), Step("map", (("land", "wald"),)))), 5: Candidate("none", "", 0, (Step("map", (("fehlt", "x"),)),)),
}


def corpus(spark, docs):
    return spark.createDataFrame([("de", i * 3, s) for i, s in enumerate(docs)], "corpus string, doc_id long, seqs array<array<string>>")


def same(base, pool, budget):
    """Features of every variant against those of the whole corpora, counted anew."""
    got = {r["slot"]: r.asDict() for r in M.features(base, changed_by(base, pool), [-1, *pool], budget).collect()}
    whole = FE.feature_vector(FrozenObjective({}, {}, {}, budget).measured(_pool_corpora(base, pool)))
    want = {int(r["corpus"]): r.asDict() for r in whole.collect()}
    assert sorted(got) == sorted(want) == sorted([-1, *pool])
    for slot, row in got.items():
        assert {n: row[n] for n in FE.FEATURES} == {n: pytest.approx(want[slot][n], abs=1e-9) for n in FE.FEATURES}, slot
    return got


@pytest.mark.parametrize("budget", [None, 500])
def test_features_after_rewrites_equal_a_recount(spark, budget):
    base = sequences(corpus(spark, SEQS)).select(*RW.KEY, "tokens").persist()
    got = same(base, POOL, budget)
    assert len({tuple(round(v, 6) for n, v in r.items() if n != "slot") for r in got.values()}) > 3 and got[-1] == {n: pytest.approx(v) if n != "slot" else -1 for n, v in got[5].items()}


def test_features_of_real_text_equal_a_recount(spark, sf_dir):
    base = sequences(corpora(spark, sf_dir).filter("corpus = 'en'")).select(*RW.KEY, "tokens").persist()
    same(base, {0: Candidate("split", "", 0, (Step("split", tokens=("the", "th", "he")),))}, 3000)


def test_too_few_tokens_and_empty_corpora(spark):
    base = sequences(corpus(spark, SEQS[:6])).select(*RW.KEY, "tokens")
    with pytest.raises(ValueError):
        M.features(base, changed_by(base, {}), [-1], 100_000)
    none = base.limit(0)
    assert M.features(none, changed_by(none, {}), [-1]).collect() == []


def test_a_search_by_the_frozen_objective_audits_clean(spark, tmp_path):
    source, target = sequences(corpus(spark, SEQS)), corpus(spark, SEQS[20:] + SEQS[:9])
    objective = FrozenObjective({n: 0.0 for n in REPORTED}, {n: 1.0 for n in REPORTED}, {n: 0.5 for n in REPORTED}, 400)
    records = run_search(spark, source, target, SearchConfig(proposals=1, candidates=2), str(tmp_path / "run"), objective=objective)
    assert len(records) == 1 and audit(spark, target, str(tmp_path / "run"), objective=objective) == []
    assert load_records(spark, str(tmp_path / "run"))[0]["state"]["struct"] == pytest.approx(objective.rewards(FE.feature_vector(objective.measured(corpus(spark, SEQS)))).first()["struct"], abs=1e-9)


def test_plans_hold_tables_and_not_what_made_them(spark, monkeypatch):
    """cached tables stood in each reader's plan with all that had made them, hundreds of shuffles, which filled the driver."""
    plans = []
    whole = FE.from_parts
    monkeypatch.setattr(M.FE, "from_parts", lambda *a: plans.append(df := whole(*a)) or df)
    base = sequences(corpus(spark, SEQS)).select(*RW.KEY, "tokens")
    M.features(base, changed_by(base, POOL), list(POOL))
    (plan,) = (p._jdf.queryExecution().optimizedPlan().toString() for p in plans)
    assert "InMemoryRelation" not in plan and "seqs" not in plan


def test_stored_tables_are_files_until_dropped(spark, monkeypatch, tmp_path):
    from corpuscope.operators import corpus as C

    monkeypatch.setattr(type(spark.sparkContext), "getCheckpointDir", lambda self: str(tmp_path))
    table = C.stored(spark.range(5).selectExpr("id", "id % 2 AS odd"))
    assert [tuple(r) for r in table.orderBy("id").collect()] == [(i, i % 2) for i in range(5)] and len(list(tmp_path.iterdir())) == 1
    C.dropped(table)
    assert not list(tmp_path.iterdir())


def test_first_grams_where_a_variant_changes_most_of_them(spark):
    """all grams were ranked in one task a kind where as many change; the list now grows only until enough of it stand unchanged."""
    from corpuscope.operators import state as S

    counts = spark.createDataFrame([("w2", f"g{i:03}", 200 - i) for i in range(100)], "kind string, gram string, cnt long")
    changes = spark.createDataFrame([(0, "w2", f"g{i:03}", -(200 - i)) for i in range(37)] + [(1, "w2", "g050", 900)], "slot int, kind string, gram string, d long")
    _, kept = S.variants(counts, changes, [0, 1, 2], {"w2": 5})
    got = {s: [r["gram"] for r in kept.filter(f"slot = {s}").orderBy("rnk").collect()] for s in range(3)}
    assert got == {0: [f"g{i:03}" for i in range(37, 42)], 1: ["g050", "g000", "g001", "g002", "g003"], 2: [f"g{i:03}" for i in range(5)]}


def test_variants_that_change_much_are_counted_anew(spark, monkeypatch):
    """a word split everywhere had all the state's grams counted, and nearly all of its sequences looked at again."""
    base = sequences(corpus(spark, SEQS)).select(*RW.KEY, "tokens").persist()
    by_changes, seen = M._by_changes, []
    monkeypatch.setattr(M, "RECOUNT_TOKENS", 0)
    monkeypatch.setattr(M, "_by_changes", lambda b, c, slots, budget: seen.extend(slots) or by_changes(b, c, slots, budget))
    same(base, {1: POOL[1]}, None)
    assert seen == [-1]


def test_changes_of_single_steps_need_no_join(spark):
    """the old tokens were joined back, so all sequences were shuffled."""
    base = sequences(corpus(spark, SEQS))
    plan = lambda pool: changed_by(base, pool)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan({s: POOL[s] for s in (0, 1, 2)}) and "Join" in plan({4: POOL[4]})


def test_a_pool_counts_each_corpus_once(spark, monkeypatch):
    """counts of the state were made anew by each reader, and the reference counted all its grams."""
    from corpuscope.operators import search as SE

    counted, seen = SE.S.counted, []
    monkeypatch.setattr(SE.S, "counted", lambda *a: pytest.fail("all grams were counted"))
    reference = SE.Reference(corpus(spark, SEQS[:9]))
    monkeypatch.setattr(SE.S, "counted", counted)

    def take(counts, *_):
        seen.append(counts._jdf.queryExecution().optimizedPlan().toString())
        raise KeyError

    monkeypatch.setattr(SE, "scored", take)
    with pytest.raises(KeyError):
        SE.score_pool(sequences(corpus(spark, SEQS[:9])), {0: POOL[0]}, reference)
    assert "Aggregate" not in seen[0] and reference.vector["ttr"] > 0
