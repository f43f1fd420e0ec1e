"""Logical constraints as predicates over assignments (d0, d1, s), and how far predictions satisfy them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def equals(column: Column, value) -> Column:
    return column == F.lit(value)


def all_of(*parts: Column) -> Column:
    return reduce(lambda a, b: a & b, parts)


def any_of(*parts: Column) -> Column:
    return reduce(lambda a, b: a | b, parts)


def if_then(condition: Column, consequence: Column) -> Column:
    return ~condition | consequence


def count_of(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [f.cast("int") for f in flags])


def exactly(flags: list[Column], n: int = 1) -> Column:
    return count_of(flags) == n


def at_most(flags: list[Column], n: int = 1) -> Column:
    return count_of(flags) <= n


def fixed(column: Column, label: Column, where: Column) -> Column:
    """The column is its label wherever the condition holds."""
    return if_then(where, column == label)


@dataclass(frozen=True)
class Constraint:
    """A named implication; without an antecedent it always applies."""

    name: str
    consequence: Column
    antecedent: Column | None = None

    def holds(self) -> Column:
        return self.consequence if self.antecedent is None else if_then(self.antecedent, self.consequence)


def pairs_of(s: int, top: int = 9) -> list[tuple[int, int]]:
    return [(a, s - a) for a in range(max(0, s - top), min(s, top) + 1)]


def sum_constraints(d0: Column, d1: Column, s: Column, label: Column | None = None, active: Column | None = None) -> list[Constraint]:
    """Exactly one digit each, exactly one sum, the sum fixed to its label where active, and for each sum the digit
    pairs that make it: all 22 of a pair of digits."""
    domain = lambda c, n: exactly([c == i for i in range(n)])
    out = [Constraint("digits", domain(d0, 10) & domain(d1, 10)), Constraint("sums", domain(s, 19))]
    if label is not None:
        out.append(Constraint("fixed", s == label, F.lit(True) if active is None else active))
    for k in range(19):
        out.append(Constraint(f"sum_{k}", any_of(*[(d0 == a) & (d1 == b) for a, b in pairs_of(k)]), s == k))
    return out


def verify(predictions: DataFrame, constraints: list[Constraint], keys: list[str]) -> DataFrame:
    """keys, lc, satisfied (100 or 0), if_satisfied (the same where the antecedent holds, else NaN): one row a
    prediction and constraint, made in place by an explode, without a cross join."""
    checks = [
        F.struct(
            F.lit(c.name).alias("lc"),
            F.when(c.holds(), 100.0).otherwise(0.0).alias("satisfied"),
            (F.when(c.consequence, 100.0).otherwise(0.0) if c.antecedent is None else F.when(c.antecedent, F.when(c.consequence, 100.0).otherwise(0.0)).otherwise(float("nan"))).alias("if_satisfied"),
        )
        for c in constraints
    ]
    return predictions.select(*keys, F.explode(F.array(*checks)).alias("c")).select(*keys, "c.*")


def satisfaction(verified: DataFrame, keys: list[str]) -> DataFrame:
    """keys, satisfied (how many constraints), if_satisfied (mean over those that apply; null if none does)."""
    mean = F.avg(F.when(~F.isnan("if_satisfied"), F.col("if_satisfied")))
    return verified.groupBy(*keys).agg(F.floor(F.sum("satisfied") / 100).cast("long").alias("satisfied"), mean.alias("if_satisfied"))
