"""Scalar and array functions as Columns: all run inside the JVM, none needs a shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 10
SUMS = 19


def logits(embedding: Column, n: int = DIGITS) -> Column:
    """The first n values of a vector as doubles."""
    return F.transform(F.slice(embedding, 1, n), lambda x: x.cast("double"))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softmax(z: Column) -> Column:
    """exp(z) over its sum, kept in range by the largest value."""
    share = lambda e: let(total(e), lambda t: F.transform(e, lambda x: x / t))
    return let(z, lambda v: let(F.array_max(v), lambda top: let(F.transform(v, lambda x: F.exp(x - top)), share)))


def log_softmax(z: Column) -> Column:
    """z less the logarithm of the sum of exp(z), kept in range by the largest value."""
    less = lambda v, top: let(top + F.log(total(F.transform(v, lambda y: F.exp(y - top)))), lambda n: F.transform(v, lambda x: x - n))
    return let(z, lambda v: let(F.array_max(v), lambda top: less(v, top)))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def one_hot(i: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.when(k == i, 1.0).otherwise(0.0))


def argmax(values: Column) -> Column:
    """Place (from 0) of the largest value, the first of equal ones."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def outer(a: Column, b: Column) -> Column:
    return F.transform(a, lambda x: F.transform(b, lambda y: x * y))


def antidiagonal_sums(a: Column, b: Column, n: int = DIGITS) -> Column:
    """Distribution of the sum of two independent values 0 to n - 1: sum over i of a[i] * b[s - i]."""

    def one(s: Column) -> Column:
        places = F.sequence(F.greatest(s - (n - 1), F.lit(0)), F.least(s, F.lit(n - 1)))
        return F.aggregate(places, F.lit(0.0), lambda acc, i: acc + F.get(a, i) * F.get(b, s - i))

    return F.transform(F.sequence(F.lit(0), F.lit(2 * n - 2)), one)


def normalise(values: Column, mean: float, deviation: float) -> Column:
    return F.transform(values, lambda x: (x.cast("double") - mean) / deviation)


def digits_to_number(digits: Column) -> Column:
    """Digits, the most significant first, as a number."""
    return F.aggregate(digits, F.lit(0).cast("long"), lambda a, x: a * 10 + x)


def fold(values: Column, operator=lambda a, x: a + x, start: int = 0) -> Column:
    """A two-place operator over an array of longs."""
    return F.aggregate(values, F.lit(start).cast("long"), operator)


def counts_text(counts: Column) -> Column:
    """An array of counts as `i: n || ...`."""
    return F.array_join(F.transform(counts, lambda x, i: F.concat(i.cast("string"), F.lit(": "), x.cast("string"))), " || ")


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def safe_log(p: Column) -> Column:
    """Logarithm, at -100 from below, as binary cross-entropy takes it; log(0) is -100."""
    return F.when(p <= 0, F.lit(-100.0)).otherwise(F.greatest(F.log(p), F.lit(-100.0)))


def feasible_range(s: Column, top: int = 9) -> Column:
    """All first addends 0 to top of a sum of two."""
    return F.sequence(F.greatest(F.lit(0), s - top), F.least(s, F.lit(top)))


def nanmean(x: Column) -> Column:
    """Mean without NaN; null if nothing else is there."""
    return F.avg(F.when(~F.isnan(x), x))


def hash_order(seed: int, key: Column) -> Column:
    """A pseudo-random order that any engine with md5 gives alike."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
