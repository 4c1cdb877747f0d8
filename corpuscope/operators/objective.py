"""The frozen objective: a bank of feature rows fixes scale and target once, and states are measured on a budget of tokens."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.operators import features as FE
from corpuscope.operators import samples as S

#: Features that the search is rewarded on (fixed choice), and all that distances are reported on.
RETAINED = tuple(n for n in FE.FEATURES if n[:3] in ("f02", "f09", "f15", "f17", "f18", "f19"))
REPORTED = tuple(n for n in FE.FEATURES if n[:1] == "f" and n[1:3].isdigit())
SCALE = 5.0


@dataclass(frozen=True)
class FrozenObjective:
    """Means and population deviations of a bank, and its target row: some forty numbers."""

    means: dict[str, float]
    scales: dict[str, float]
    target: dict[str, float]
    budget: int | None = None

    @classmethod
    def of_bank(cls, bank: DataFrame, target: str, budget: int | None = None) -> FrozenObjective:
        """bank: corpus and the reported features, one row a corpus. Constant or missing features are an error."""
        row = bank.agg(*(F.avg(c).alias(f"m_{c}") for c in REPORTED), *(F.stddev_pop(c).alias(f"s_{c}") for c in REPORTED)).first()
        goal = bank.filter(F.col("corpus") == target).limit(2).collect()
        if len(goal) != 1:
            raise ValueError("the bank must hold exactly one target row")
        scales = {c: row[f"s_{c}"] for c in REPORTED}
        if any(s is None or not math.isfinite(s) or s <= 0 for s in scales.values()):
            raise ValueError("the bank has constant or nonfinite features")
        return cls({c: row[f"m_{c}"] for c in REPORTED}, scales, {c: goal[0][c] for c in REPORTED}, budget)

    def z(self, c: str, value: Column) -> Column:
        return (value - self.means[c]) / self.scales[c]

    def _distance(self, columns: tuple[str, ...], other) -> Column:
        parts = (F.pow(self.z(c, F.col(c)) - self.z(c, other(c)), F.lit(2.0)) for c in columns)
        return F.sqrt(reduce(lambda a, b: a + b, parts))

    def rewards(self, vectors: DataFrame) -> DataFrame:
        """corpus, struct: minus SCALE times the distance to the target on the retained features."""
        return vectors.select("corpus", (-SCALE * self._distance(RETAINED, lambda c: F.lit(self.target[c]))).alias("struct"))

    def reference_distances(self, vectors: DataFrame, bank: DataFrame) -> DataFrame:
        """Every state with every row of the bank (a frozen list, so it is broadcast): distances on the retained features and
        on all of them."""
        named = bank.select(F.col("corpus").alias("reference"), *(F.col(c).alias(f"r_{c}") for c in REPORTED))
        other = lambda c: F.col(f"r_{c}")
        joined = vectors.crossJoin(F.broadcast(named))
        return joined.select("corpus", "reference", self._distance(RETAINED, other).alias("distance_6d"), self._distance(REPORTED, other).alias("distance_21d"))

    def measured(self, corpora: DataFrame) -> DataFrame:
        """The first tokens of each corpus up to the budget, as corpora; an error where there are too few."""
        if self.budget is None:
            return corpora
        cut = S.budget_prefix(corpora, self.budget, strict=True)
        return cut.groupBy("corpus", "doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "tokens"))), lambda x: x["tokens"]).alias("seqs"))
