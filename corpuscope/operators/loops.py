"""Loops over bigram models: mixing toward uniform noise, random perturbation, and mixing toward a reference.

A stage is a sample of sequences from the stage's model, measured by its structural vector; a loop ends after its stages or
when the measure hardly moves. Models after any number of steps follow from the first one in closed form (or, perturbed, from
the list of accepted draws), so no stage depends on stored state.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.operators import compare as C
from corpuscope.operators import features as FE
from corpuscope.operators import lm as L
from corpuscope.operators.search import STRUCT_SCALE, VECTOR


@dataclass(frozen=True)
class LoopConfig:
    stages: int = 10
    sequences: int = 1000
    alpha: float = 0.05
    candidates: int = 20
    noise: float = 0.1
    seed: int = 42
    #: Stop below this change: of the vector's length in the blind loop, of the score in the others.
    vector_epsilon: float = 0.005
    score_epsilon: float = 0.002


def _vectors(samples: DataFrame) -> list[dict]:
    """Structural vector of each sampled corpus, in order: as many rows as candidates."""
    corpora = samples.select("corpus", "doc_id", F.array("tokens").alias("seqs"))
    return [r.asDict() for r in FE.structural_vector(corpora).orderBy("corpus").collect()]


def _score(vector: dict, target: dict) -> float:
    return -STRUCT_SCALE * sum((vector[c] - target[c]) ** 2 for c in VECTOR) ** 0.5


def blind(model: DataFrame, lengths: DataFrame, config: LoopConfig = LoopConfig()) -> list[dict]:
    """model: a, b, p; lengths: length. Each stage mixes the model toward uniform once more."""
    records: list[dict] = []
    for stage in range(config.stages):
        mixed = 1 - (1 - config.alpha) ** stage
        sample = L.sampled(model, lengths, config.sequences, config.seed + stage, uniform=mixed).withColumn("corpus", F.lit("stage"))
        record = {"stage": stage, "alpha_cumulative": mixed, **_vectors(sample)[0], "stable": False}
        records.append(record)
        if stage:
            step = sum((record[c] - records[-2][c]) ** 2 for c in C.STRUCT) ** 0.5
            if step < config.vector_epsilon:
                record["stable"] = True
                break
    return records


def _scored_stage(records: list[dict], stage: int, vector: dict, score: float, config: LoopConfig, **more) -> bool:
    still = bool(records) and abs(score - records[-1]["score"]) < config.score_epsilon
    records.append({"stage": stage, **vector, "score": score, "stable": still, **more})
    return still


def perturbed(model: DataFrame, lengths: DataFrame, target: dict, config: LoopConfig = LoopConfig()) -> list[dict]:
    """Each stage tries `candidates` Gaussian perturbations of the model's logarithms, all in one job, and keeps the one whose
    sample scores best against the target vector."""
    records: list[dict] = []
    draws: tuple[int, ...] = ()
    for stage in range(config.stages):
        tried = {i: (*draws, config.seed * 1_000_003 + stage * config.candidates + i) for i in range(config.candidates)}
        samples = L.sampled_perturbed(model, lengths, config.sequences, config.seed + stage, tried, config.noise)
        scored = [(_score(v, target), v) for v in _vectors(samples)]
        best = max(range(len(scored)), key=lambda i: scored[i][0])
        number = int(scored[best][1]["corpus"])
        draws = tried[number]
        if _scored_stage(records, stage, scored[best][1], scored[best][0], config, candidate=number):
            break
    return records


def gradient(model: DataFrame, reference: DataFrame, lengths: DataFrame, target: dict, config: LoopConfig = LoopConfig()) -> tuple[float, list[dict]]:
    """Each stage mixes the model once more toward the reference's (a, b, p). Returns the share of the model's tokens that the
    reference knows (below a tenth the direction says little) and the records."""
    words = lambda m: m.select(F.col("a").alias("t")).union(m.select("b")).distinct()
    own = words(model)
    overlap = own.join(words(reference), "t", "left_semi").count() / max(own.count(), 1)
    records: list[dict] = []
    for stage in range(config.stages):
        mixed = L.mixed_toward(model, reference, 1 - (1 - config.alpha) ** stage).filter("p > 0")
        vector = _vectors(L.sampled(mixed, lengths, config.sequences, config.seed + stage).withColumn("corpus", F.lit("stage")))[0]
        if _scored_stage(records, stage, vector, _score(vector, target), config):
            break
    return overlap, records
