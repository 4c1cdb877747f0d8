import datetime

import pytest
from pyspark.sql import functions as F

from corpuscope.operators import lm as L
from corpuscope.operators import schedule as SC
from corpuscope.operators.corpus import sequences
from corpuscope.operators.search import SearchConfig, audit, load_records, reward, run_search
from corpuscope.plans import runner
from corpuscope.streaming import events as EV

SOURCE = [["der", "wind", "geht", "uber", "land"], ["der", "sturm", "geht", "uber", "wasser"], ["wind", "sturm", "wasser"]] * 8
TARGET = [["ventus", "terram", "movet", "aquas", "et"], ["procella", "aquas", "et", "terram", "movet"], ["ventus", "procella"]] * 8


def corpus(spark, seqs, name):
    return spark.createDataFrame([(name, i, [s]) for i, s in enumerate(seqs)], "corpus string, doc_id long, seqs array<array<string>>")


def test_search_resumes_and_chains(spark, tmp_path):
    source, target = sequences(corpus(spark, SOURCE, "fr")), corpus(spark, TARGET, "la")
    folder = str(tmp_path / "run")
    first = run_search(spark, source, target, SearchConfig(proposals=1, candidates=4), folder)
    with pytest.raises(ValueError):
        run_search(spark, source, target, SearchConfig(proposals=2, candidates=4, seed=1), folder)
    again = run_search(spark, source, target, SearchConfig(proposals=1, candidates=4), folder)
    assert again == first == load_records(spark, folder) and audit(spark, target, folder) == []
    name = tmp_path / "run" / "record-000001.json"
    name.write_text(name.read_text().replace('"accepted": true', '"accepted": false') if first[0]["accepted"] else name.read_text().replace('"bomb": false', '"bomb": true'))
    with pytest.raises(ValueError):
        load_records(spark, folder)


def test_stream(spark, tmp_path):
    now = datetime.datetime(2024, 1, 1)
    rows = [(now, i, 0, "accepted" if i % 2 else "noop", "ab"[i % 2], "", 0.1, None, "spark", float(i), 0.0) for i in range(6)]
    EV.append(spark.createDataFrame(rows, EV.SCHEMA), str(tmp_path / "log"))
    query = EV.run_means(spark, str(tmp_path / "log"), "means", str(tmp_path / "cp"))
    query.processAllAvailable()
    EV.append(spark.createDataFrame(rows[:2], EV.SCHEMA), str(tmp_path / "log"), "accepted_only")
    query.processAllAvailable()
    got = {r["operator"]: (r["mean_delta"], r["n"]) for r in spark.sql("SELECT * FROM means").collect()}
    query.stop()
    assert got == {"a": (2.0, 3), "b": (pytest.approx(2.5), 4)}
    seen = []
    last = EV.last_entries(spark, str(tmp_path / "log"), str(tmp_path / "cp2"), lambda r: seen.append(len(r)), 3)
    last.processAllAvailable()
    last.stop()
    assert sum(seen) >= 3
    assert EV.windowed(spark.createDataFrame(rows, EV.SCHEMA)).count() == 2


def test_schedule(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 1.0)], "run int, alignment double")
    rows = SC.scheduled_weights(df).groupBy("run").agg(F.sum("weight").alias("s"), F.max("weirdness").alias("w")).orderBy("run").collect()
    assert [(pytest.approx(r["s"]), pytest.approx(r["w"])) for r in rows] == [(1.0, 1.0), (1.0, 0.15)]
    hours = [r["x"] for r in spark.range(24).select(SC.in_hours(F.col("id"), 22, 6).alias("x")).collect()]
    assert sum(hours) == 8 and hours[23] and hours[0] and not hours[12]


def test_models(spark):
    c = corpus(spark, SOURCE, "fr")
    model = L.transitions(c, 100)
    assert all(r["s"] == pytest.approx(1) for r in model.groupBy("a").agg(F.sum("p").alias("s")).collect())
    draws = L.sampled(model, sequences(c).select(F.size("tokens").alias("length")), 20, 3)
    assert sorted(map(tuple, draws.collect())) == sorted(map(tuple, draws.collect())) and draws.count() == 20
    walk = L.trained_markov(L.contexts(c, 3), 10, 7, 1).collect()
    assert all(len(r["tokens"]) == 7 for r in walk)


@pytest.mark.parametrize("uniform", [0.0, 0.3])
def test_walks_by_joins_are_those_of_the_broadcast_model(spark, tmp_path, uniform):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    model = L.transitions(corpus(spark, SOURCE, "fr"), 100).union(spark.createDataFrame([("fr", "dead", "end", 1, 1.0), ("fr", "x", "y", 1, 0.0), ("fr", "x", "z", 1, None)], "corpus string, a string, b string, cnt long, p double"))
    lengths = spark.createDataFrame([(0,), (1,), (3,), (3,), (11,)], "length int")
    small = L.sampled(model, lengths, 60, 5, uniform=uniform).collect()
    large = L.sampled(model, lengths, 60, 5, uniform=uniform, most=3).collect()
    assert sorted(map(tuple, large)) == sorted(map(tuple, small)) and {len(r["tokens"]) for r in large} == {0, 1, 3, 11}
    for empty in (L.sampled(model.limit(0), lengths, 3, 1), L.walked(model.limit(0), lengths, 3, 1), L.walked(model, lengths.limit(0), 3, 1)):
        assert sorted(map(tuple, empty.collect())) == [(0, []), (1, []), (2, [])]


def test_samples_follow_the_model(spark):
    model = spark.createDataFrame([("a", "a", 0.5), ("a", "b", 0.25), ("a", "c", 0.25), ("b", "a", 1.0), ("c", "a", 1.0)], "a string, b string, p double")
    walks = L.sampled(model, spark.createDataFrame([(50,)], "length int"), 400, 2).collect()
    steps = [(x, y) for r in walks for x, y in zip(r["tokens"], r["tokens"][1:])]
    after = [y for x, y in steps if x == "a"]
    assert abs(after.count("a") / len(after) - 0.5) < 0.02 and abs(after.count("b") / len(after) - 0.25) < 0.02
    assert all(y == "a" for x, y in steps if x != "a")


def test_runner(spark, sf_dir, tmp_path):
    out = str(tmp_path / "out")
    assert runner.run(spark, sf_dir, out, ("corpus_stats",)) == ["corpus_stats"]
    assert runner.run(spark, sf_dir, out, ("corpus_stats",)) == [] and runner.status(spark, out, ("corpus_stats", "form_cosine")) == {"corpus_stats": True, "form_cosine": False}


def test_rewards_follow_the_margin():
    now = {"struct": -1.0, "form": 0.2, "margin": 0.5, "s3": 0.1, "c3": 0.1}
    better = {"struct": -0.9, "form": 0.3, "margin": 0.46, "s3": 0.1, "c3": 0.2}
    plain = -0.9 + 0.75 * 0.3 + 0.05 * 0.46 - 0.005 * 2.0
    gains = 8 * 0.1 + 4 * 0.1 + 2 * 0.1
    assert reward(now, better, 2.0) == pytest.approx(plain + gains + 0.01 + 0.005 * 2.0)
    assert reward(now, better | {"margin": 0.44}, 2.0) == pytest.approx(plain - 0.05 * 0.02 + gains)  # too far towards noise
    assert reward(now, better, 2.0, amplified=False) == pytest.approx(plain)
    assert reward(now, better, 2.0, form_reward=False) == pytest.approx(plain - 0.75 * 0.3 + 8 * 0.1)


def test_pool_scores_are_those_of_whole_corpora(spark):
    from corpuscope.operators import features as FE
    from corpuscope.operators.search import VECTOR, Bank, Candidate, Reference, Step, _pool_corpora, score_pool

    base, target = sequences(corpus(spark, SOURCE, "x")), corpus(spark, TARGET, "y")
    pool = {0: Candidate("token_char_edit", "", 0.25, (Step("map", (("wind", "ventus"),)),)), 3: Candidate("split_token", "", 0.4, (Step("split", tokens=("sturm", "st", "urm")), Step("map", (("st", "et"),))))}
    bank = Bank(corpus(spark, SOURCE, "x").union(target), L.uniform_null(spark, 50))
    got = {r["slot"]: r for r in score_pool(base, pool, Reference(target), bank)}
    want = {int(r["corpus"]): r for r in FE.structural_vector(_pool_corpora(base, pool)).collect()}
    assert set(got) == set(want) == {-1, 0, 3}
    for s, r in got.items():
        assert [r[c] for c in VECTOR] == pytest.approx([want[s][c] for c in VECTOR])
    assert got[0]["form"] > got[-1]["form"] and got[-1]["margin"] != 0


def test_blocks_stop_and_guidance_draws_hotspots(spark, tmp_path):
    from corpuscope.operators.search import BlockConfig, Planner, Reference, joint_hit, joint_plateau, run_blocks

    assert joint_hit({"struct": 0.0, "form": 1.0, "family": 0.5}, (-1.0, 0.9, 0.5)) and not joint_hit({"struct": None, "form": 1.0, "family": 1.0}, (-1.0, 0.9, 0.5))
    flat = [{"struct": 0.0, "form": 0.1, "family": 0.2}] * 3
    assert joint_plateau(flat, 2, 1e-3) and not joint_plateau(flat, 3, 1e-3) and not joint_plateau([*flat, {"struct": 0.1, "form": 0.0, "family": 0.0}], 2, 1e-3)
    source, target = sequences(corpus(spark, SOURCE, "x")), corpus(spark, TARGET, "y")
    folder = tmp_path / "run"
    folder.mkdir()
    (folder / "STOP").touch()
    blocks = run_blocks(spark, source, target, SearchConfig.preset("v4", proposals=4, candidates=2, seed=5), str(folder), BlockConfig(block=1), requested_seed=6)
    assert [(b["proposals"], b["halt_reason"], b["seeds_match"]) for b in blocks] == [(1, "manual_stop", False)]
    planner = Planner([("wind", 100), ("land", 1)], [], Reference(target), SearchConfig(), {"land": 0.5})
    import numpy as np

    assert {planner._token(np.random.default_rng(i), [("wind", 100), ("land", 1)]) for i in range(20)} == {"land"}
    assert planner._token(np.random.default_rng(1), [("wind", 100)]) == "wind"
    assert sum(SC.operator_weights(0.3).values()) == pytest.approx(1)


def test_frozen_objective(spark):
    import random

    from corpuscope.operators.objective import REPORTED, RETAINED, FrozenObjective

    rng = random.Random(3)
    bank = spark.createDataFrame([(name, *(rng.random() for _ in REPORTED)) for name in "pqr"], "corpus string, " + ", ".join(f"{c} double" for c in REPORTED))
    words = corpus(spark, [["a", "b", "c"]] * 60, "p")
    objective = FrozenObjective.of_bank(bank, "p", budget=100)
    scores = {r["corpus"]: r["struct"] for r in objective.rewards(bank).collect()}
    rows = {r["corpus"]: r for r in bank.collect()}
    by_hand = -5 * sum(((rows["q"][c] - rows["p"][c]) / objective.scales[c]) ** 2 for c in RETAINED) ** 0.5
    assert scores["p"] == 0 and scores["q"] == pytest.approx(by_hand) and len(RETAINED) == 6
    near = {(r["corpus"], r["reference"]): r for r in objective.reference_distances(bank, bank).collect()}
    assert near["q", "p"]["distance_6d"] == pytest.approx(-by_hand / 5) and near["q", "p"]["distance_21d"] > near["q", "p"]["distance_6d"]
    assert objective.measured(words).select(F.sum(F.size(F.col("seqs")[0]))).first()[0] == 100
    with pytest.raises(ValueError):
        FrozenObjective.of_bank(bank, "nobody")
    with pytest.raises(Exception, match="too few tokens"):
        objective.measured(corpus(spark, [["a"]], "s")).collect()


def test_loops(spark):
    from corpuscope.operators import loops as LO

    c, t = corpus(spark, SOURCE, "x"), corpus(spark, TARGET, "y")
    model, lengths = L.transitions(c).drop("corpus"), sequences(c).select(F.size("tokens").alias("length"))
    config = LO.LoopConfig(stages=2, sequences=40, candidates=3, alpha=0.5, vector_epsilon=0.0, score_epsilon=0.0)
    blind = LO.blind(model, lengths, config)
    assert [r["alpha_cumulative"] for r in blind] == [0.0, 0.5] and blind[1]["ttr"] != blind[0]["ttr"]
    goal = {"ttr": 0.1, "bigram_coverage": 1.0, "trigram_coverage": 1.0}
    tried = LO.perturbed(model, lengths, goal, config)
    assert len(tried) == 2 and all(r["candidate"] in range(3) for r in tried) and tried == LO.perturbed(model, lengths, goal, config)
    overlap, steps = LO.gradient(model, L.transitions(t).drop("corpus"), lengths, goal, config)
    assert overlap == 0 and len(steps) == 2
    assert LO.blind(model, lengths, LO.LoopConfig(stages=5, sequences=40, alpha=0.0, vector_epsilon=9.0))[-1]["stable"]


def test_tensor_modes(spark):
    from corpuscope.operators import rewrite as RW
    from corpuscope.operators import tensor as T
    from corpuscope.operators.corpus import types

    c = corpus(spark, SOURCE, "x")
    base, anchor, pairs = sequences(c), types(c), T.raw_pairs(sequences(c))
    for mapping, want in (({"nobody": "x"}, "noop"), ({"land": "wind"}, "incremental"), ({"land": "terra"}, "anchor_extend"), ({"wind": "w", "sturm": "s"}, "full_rebuild")):
        new = RW.overlay(base, RW.rewrite_tokens(base, mapping))
        what, got = T.refreshed(pairs, new, RW.changed_sequences(base, new), base.count(), anchor)
        assert what == want
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, T.raw_pairs(new).collect()))


def test_simulated_panels(spark):
    from corpuscope.operators import panels as PN

    items, focal = tuple("abcdefghi"), tuple("abcde")
    rows = PN.simulated_tails(PN.simulated_panels(spark, items, focal, 60, 7), items, focal).groupBy("scenario").agg(F.avg("effect").alias("e"), F.avg((F.col("tail") < 0.05).cast("double")).alias("share")).collect()
    share = {r["scenario"]: (r["e"], r["share"]) for r in rows}
    assert abs(share["exchangeable_null"][0]) < 0.1 and share["exchangeable_null"][1] < 0.2
    assert share["within_group_alternative"][1] > 0.9 and share["correlated_nuisance"][1] > 0.9


def test_chain_tells_changes(spark):
    rows = [(r, i, f"p{i}") for r in (1, 2) for i in range(5)]
    records = spark.createDataFrame(rows, "run int, i int, p string")
    sealed = records.join(SC.chained(records, "run", "i", ("p",)), ["run", "i"])
    assert SC.broken_links(sealed, "run", "i", ("p",)).count() == 0
    changed = sealed.withColumn("p", F.when((F.col("run") == 2) & (F.col("i") == 3), "other").otherwise(F.col("p")))
    assert sorted(map(tuple, SC.broken_links(changed, "run", "i", ("p",)).collect())) == [(2, 3), (2, 4)]
    relinked = sealed.withColumn("previous_sha256", F.when(F.col("i") == 2, "x").otherwise(F.col("previous_sha256")))
    assert sorted(map(tuple, SC.broken_links(relinked, "run", "i", ("p",)).collect())) == [(1, 2), (2, 2)]
    import hashlib
    import json

    record = {"b": 1, "a": [1.5, None]}
    record["sha256"] = hashlib.sha256(json.dumps({"a": [1.5, None], "b": 1}, separators=(",", ":")).encode()).hexdigest()
    assert SC.sealed(record) and not SC.sealed(record | {"b": 2})


def test_stagnation_over_ranges(spark, monkeypatch):
    import random

    from corpuscope.operators import panels as PN

    monkeypatch.setattr(PN, "RANGE", 7)
    rng = random.Random(1)
    rows = [(k, i, rng.random() < 0.1) for k in "ab" for i in sorted(rng.sample(range(200), 120))]
    want, state = {}, {}
    for k, i, won in rows:
        wins, since = state.get(k, (0, 0))
        state[k] = (wins + 1, 0) if won else (wins, since + 1)
        want[k, i] = state[k]
    got = {(r["k"], r["i"]): (r["accepted_so_far"], r["since_accept"]) for r in PN.stagnation(spark.createDataFrame(rows, "k string, i int, won boolean"), "i", "won", "k").collect()}
    assert got == want
