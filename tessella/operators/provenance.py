"""How alternative proofs of one derived tuple combine. A strategy turns (keys, prob) rows, one a proof, into one row a tuple."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Provenance(Protocol):
    def combine(self, proofs: DataFrame, keys: list[str], prob: str = "prob") -> DataFrame: ...


@dataclass(frozen=True)
class ExclusiveSum:
    """Proofs that exclude each other (values of one categorical variable): the sum. Exact for them."""

    def combine(self, proofs: DataFrame, keys: list[str], prob: str = "prob") -> DataFrame:
        return proofs.groupBy(*keys).agg(F.sum(prob).alias(prob))


@dataclass(frozen=True)
class NoisyOr:
    """Independent proofs: one minus the product of complements. Exact if no two proofs share a fact."""

    def combine(self, proofs: DataFrame, keys: list[str], prob: str = "prob") -> DataFrame:
        return proofs.groupBy(*keys).agg((1 - F.product(1 - F.col(prob))).alias(prob))


@dataclass(frozen=True)
class MaxProd:
    """The best proof alone."""

    def combine(self, proofs: DataFrame, keys: list[str], prob: str = "prob") -> DataFrame:
        return proofs.groupBy(*keys).agg(F.max(prob).alias(prob))


@dataclass(frozen=True)
class TopK:
    """The k best proofs, ties by the given columns, combined by another strategy. The rank becomes a group limit
    below the exchange, so k rows a tuple and task are moved, not all proofs."""

    k: int = 3
    inner: Provenance = ExclusiveSum()
    ties: tuple[str, ...] = ()
    score: Column | None = None

    def combine(self, proofs: DataFrame, keys: list[str], prob: str = "prob") -> DataFrame:
        score = F.col(prob) if self.score is None else self.score
        order = Window.partitionBy(*keys).orderBy(score.desc(), *self.ties)
        best = proofs.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= self.k)
        return self.inner.combine(best.drop("__rank"), keys, prob)


def geometric_mean(prob: Column, facts: int) -> Column:
    """Order of proofs for best-first search: the facts' geometric mean."""
    return F.pow(prob, F.lit(1.0 / facts))


def by_name(name: str, k: int = 3, ties: tuple[str, ...] = ()) -> Provenance:
    """`exclusive_sum`, `noisy_or`, `max_prod`, `topk` (of exclusive proofs) or `topk_noisy_or`."""
    made = {"exclusive_sum": ExclusiveSum(), "noisy_or": NoisyOr(), "max_prod": MaxProd(), "topk": TopK(k, ExclusiveSum(), ties), "topk_noisy_or": TopK(k, NoisyOr(), ties)}
    if name not in made:
        raise ValueError(f"no provenance {name!r}; there are {', '.join(made)}")
    return made[name]
