"""Rules over probabilistic relations: a conjunction is a join, a head is a projection, proofs combine by provenance.

A literal is a DataFrame with context columns, its arguments, prob, and (where two literals may read the same random
variable) a variable id. Joins always carry the context key, so they are equi-joins; a sum in the head restricts the
other side through a computed key instead of a filter on a product.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import scalars as S
from tessella.operators.provenance import ExclusiveSum, Provenance

#: Random variables that stand in one table of joint assignments at most; exact inference beyond is refused, not
#: approximated.
MOST_VARIABLES = 6


def literal(df: DataFrame, name: str, context: list[str], variable: str | None = None, value: str = "value", prob: str = "prob") -> DataFrame:
    """A relation under a literal's own names: context, {name} (its argument), {name}_p, and {name}_v if it has a variable."""
    out = [*context, F.col(value).alias(name), F.col(prob).alias(f"{name}_p")]
    return df.select(*out, *([F.col(variable).alias(f"{name}_v")] if variable else []))


def conjunction(parts: list[tuple[DataFrame, str]], context: list[str]) -> DataFrame:
    """Literals that hold together: joined on the context, prob the product of their facts'.

    Where two literals read one variable, they must agree on its value, and its fact counts once; multiplying it twice
    would be the plausible wrong number.
    """
    df, first = parts[0]
    out, names = df, [first]
    for other, name in parts[1:]:
        out = out.join(other, context)
        for earlier in names:
            if f"{earlier}_v" in out.columns and f"{name}_v" in out.columns:
                same = F.col(f"{earlier}_v") == F.col(f"{name}_v")
                out = out.filter(~same | (F.col(earlier) == F.col(name))).withColumn(f"{name}_p", F.when(same, 1.0).otherwise(F.col(f"{name}_p")))
        names.append(name)
    return out.withColumn("prob", reduce(lambda a, b: a * b, [F.col(f"{n}_p") for n in names]))


def derive(body: DataFrame, context: list[str], head: dict[str, Column], provenance: Provenance = ExclusiveSum()) -> DataFrame:
    """The derived relation: context, head columns, prob."""
    proofs = body.withColumns(head)
    return provenance.combine(proofs, [*context, *head])


def either(rules: list[DataFrame], keys: list[str], provenance: Provenance = ExclusiveSum()) -> DataFrame:
    """Several rules with one head: all their proofs, then the provenance."""
    return provenance.combine(reduce(DataFrame.unionByName, rules), keys)


def negation(prob: Column) -> Column:
    """Of a ground fact that doesn't hold."""
    return 1 - prob


def absent(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of left for which right has none."""
    return left.join(right, keys, "left_anti")


def noisy(exact: DataFrame, flag: float, values: int, prob: str = "prob") -> DataFrame:
    """A rule that gives any of its values instead, with probability flag: flag / values + (1 - flag) * exact."""
    return exact.withColumn(prob, F.lit(flag / values) + F.lit(1.0 - flag) * F.col(prob))


def sum_of_two(a: str = "p0", b: str = "p1") -> Column:
    """The closed form of the sum rule on arrays: no rows for the 100 proofs."""
    return S.antidiagonal_sums(F.col(a), F.col(b))


def sum_of_many(dist: DataFrame, context: list[str], order: str, count: int) -> DataFrame:
    """Distribution of the sum of count variables: aggregated after each join (19, 28, ... states), as products
    distribute over sums; not valid for noisy-or."""
    out = dist.filter(F.col(order) == 0).select(*context, F.col("value").alias("s"), "prob")
    for i in range(1, count):
        other = dist.filter(F.col(order) == i).select(*context, F.col("value").alias("v"), F.col("prob").alias("p"))
        out = out.join(other, context).groupBy(*context, (F.col("s") + F.col("v")).alias("s")).agg(F.sum(F.col("prob") * F.col("p")).alias("prob"))
    return out


def number(facts: list[DataFrame], context: list[str]) -> DataFrame:
    """Distribution of a number from its digits (most significant first): the recursion over the list, unrolled.
    Each digit is a relation (context, value, prob)."""
    out = facts[0].select(*context, F.col("value").cast("long").alias("number"), "prob")
    for f in facts[1:]:
        digit = f.select(*context, F.col("value").alias("d"), F.col("prob").alias("p"))
        out = out.join(digit, context).select(*context, (F.col("number") * 10 + F.col("d")).alias("number"), (F.col("prob") * F.col("p")).alias("prob"))
    return out


def ground_sum(first: list[Column], second: list[Column], result: Column) -> Column:
    """Probability that two numbers, given by their digits' distributions (most significant first), have a given sum.

    Goes from the last digit up with two states, the carry; 2 * 19 products a digit instead of 100 a digit and number.
    """
    state = [F.lit(1.0), F.lit(0.0)]
    rest = result.cast("long")
    for a, b in zip(reversed(first), reversed(second), strict=True):
        sums = S.antidiagonal_sums(a, b)
        digit = (rest % 10).cast("int")
        at = lambda want, sums=sums: F.when((want >= 0) & (want <= 18), F.get(sums, want)).otherwise(0.0)
        state = [state[0] * at(digit + 10 * up) + state[1] * at(digit - 1 + 10 * up) for up in (0, 1)]
        rest = F.floor(rest / 10)
    return F.when(rest == 0, state[0]).when(rest == 1, state[1]).otherwise(0.0)


def worlds(facts: DataFrame, context: list[str], order: str, variables: int) -> DataFrame:
    """All joint assignments of a bag's variables: context, x0 ..., prob. Refused above MOST_VARIABLES variables."""
    if variables > MOST_VARIABLES:
        raise ValueError(f"all assignments of {variables} variables are refused; {MOST_VARIABLES} at most")
    parts = [(literal(facts.filter(F.col(order) == i), f"x{i}", context), f"x{i}") for i in range(variables)]
    return conjunction(parts, context)


def elimination_order(variables: int, pairs: list[tuple[int, int]]) -> tuple[list[int], int]:
    """Variables, those with the fewest neighbours first (eliminated ones' neighbours become neighbours), and the most
    that one has when its turn comes."""
    near = {i: set() for i in range(variables)}
    for i, j in pairs:
        if i != j:
            near[i].add(j)
            near[j].add(i)
    order, width = [], 0
    while near:
        v = min(near, key=lambda x: (len(near[x]), x))
        own = near.pop(v)
        width = max(width, len(own))
        for u in own:
            near[u] = (near[u] | own) - {u, v}
        order.append(v)
    return order, width


def any_sum(facts: DataFrame, context: list[str], order: str, variables: int, pairs: list[tuple[int, int]], top: int = S.DIGITS - 1) -> DataFrame:
    """Probability that a pair of the bag has a given sum: context, s, prob.

    If no variable is in two pairs, pairs are independent and noisy-or is exact. Else it is one less the probability
    that no pair has the sum, which is found by eliminating one variable after another along the graph of the pairs:
    a chain or a tree of any length costs a table of 19 * 10 * 10 rows a bag and step. What costs is the graph's width
    (variables that one is tied to when its turn comes); beyond MOST_VARIABLES less one it is refused.
    """
    used = [i for p in pairs for i in p]
    if len(set(used)) == len(used):
        rows = []
        for k, (i, j) in enumerate(pairs):
            body = conjunction([(literal(facts.filter(F.col(order) == n), x, context), x) for n, x in ((i, "a"), (j, "b"))], context)
            rows.append(derive(body, context, {"s": F.col("a") + F.col("b"), "pair": F.lit(k)}).drop("pair"))
        from tessella.operators.provenance import NoisyOr

        return either(rows, [*context, "s"], NoisyOr())
    sequence, width = elimination_order(variables, pairs)
    if width >= MOST_VARIABLES:
        raise ValueError(f"pairs that tie {width + 1} variables together are refused; {MOST_VARIABLES} at most")
    whole = facts.filter(F.col(order).isin(sorted(set(used)))).groupBy(*context).agg(F.count_distinct(order).alias("n")).filter(F.col("n") == len(set(used)))
    facts = facts.join(whole.drop("n"), context, "left_semi")
    sums = F.explode(F.sequence(F.lit(0), F.lit(2 * top))).alias("s")
    tables = [({i}, facts.filter(F.col(order) == i).select(*context, F.col("value").alias(f"x{i}"), F.col("prob").alias("w"), sums)) for i in range(variables) if i in set(used)]
    left = {tuple(sorted(p)) for p in pairs}
    for v in (i for i in sequence if i in set(used)):
        own = [t for t in tables if v in t[0]]
        tables = [t for t in tables if v not in t[0]]
        scope, df = own[0]
        for more, other in own[1:]:
            df = df.join(other.withColumnRenamed("w", "w2"), [*context, "s", *(f"x{i}" for i in sorted(scope & more))]).withColumn("w", F.col("w") * F.col("w2")).drop("w2")
            scope = scope | more
        for i, j in sorted(p for p in left if v in p):
            left.discard((i, j))
            for u in {i, j} - scope:
                df = df.withColumn(f"x{u}", F.explode(F.sequence(F.lit(0), F.lit(top))))
                scope = scope | {u}
            df = df.filter(F.col(f"x{i}") + F.col(f"x{j}") != F.col("s"))
        scope = scope - {v}
        tables.append((scope, df.groupBy(*context, "s", *(f"x{i}" for i in sorted(scope))).agg(F.sum("w").alias("w"))))
    # what is left are numbers a bag and sum: one for each connected part; no row means that none is possible
    dense = facts.select(*context).distinct().select(*context, sums)
    for k, (_, df) in enumerate(tables):
        dense = dense.join(df.withColumnRenamed("w", f"w{k}"), [*context, "s"], "left")
    none = reduce(lambda a, b: a * b, [F.coalesce(F.col(f"w{k}"), F.lit(0.0)) for k in range(len(tables))])
    return dense.select(*context, "s", F.greatest(1 - none, F.lit(0.0)).alias("prob")).filter("prob > 0")


def gradients(pairs: DataFrame, context: list[str], a: str = "p0", b: str = "p1") -> DataFrame:
    """Derivative of each sum's probability by each of the first variable's: that of the second's rest. context, s, a,
    grad."""
    rows = pairs.select(*context, F.col(b), F.explode(F.sequence(F.lit(0), F.lit(18))).alias("s"))
    rows = rows.select(*context, F.col(b), "s", F.explode(S.feasible_range(F.col("s"))).alias("a"))
    return rows.select(*context, "s", "a", F.get(F.col(b), F.col("s") - F.col("a")).alias("grad"))
