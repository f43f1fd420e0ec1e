"""Losses as Columns over distributions in arrays, one value an example; their mean is the loss of a set."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions import scalars as S


def bce(probs: Column, target: Column, n: int = S.SUMS) -> Column:
    """Binary cross-entropy over a dense vector against the one-hot target; logs stop at -100."""
    truth = S.one_hot(target, n)
    return S.total(F.zip_with(probs, truth, lambda p, y: -(y * S.safe_log(p) + (1 - y) * S.safe_log(1 - p)))) / n


def nll(probs: Column, target: Column) -> Column:
    """Minus the target's probability (not its logarithm)."""
    return -F.get(probs, target)


def cross_entropy(probs: Column, target: Column) -> Column:
    return -F.log(F.get(probs, target))


def soft_cross_entropy(logits: Column, truth: Column, weight: float = 1.0, epsilon: float = 1e-5) -> Column:
    """Against a distribution; logits are kept in [epsilon, 1 - epsilon] before the log-softmax."""
    kept = F.transform(logits, lambda z: S.clamp(z, epsilon, 1 - epsilon))
    return weight * S.total(F.zip_with(S.log_softmax(kept), truth, lambda l, t: -l * t))


def masked_bce(probs: Column, truth: Column, inferred: Column, weight: float = 1.0, n: int = S.DIGITS) -> Column:
    """Binary cross-entropy times a prior weight, counted only where inference disagrees with the prediction."""
    each = F.zip_with(probs, truth, lambda p, y: -(y * S.safe_log(p) + (1 - y) * S.safe_log(1 - p)))
    mask = F.transform(F.zip_with(probs, inferred, lambda p, i: F.abs(p - i)), lambda d: F.when(d > 0.5, 1.0).otherwise(0.0))
    return weight * S.total(F.zip_with(each, mask, lambda x, m: x * m)) / n


def semantic(p0: Column, p1: Column, s: Column) -> Column:
    """Minus the logarithm of the probability that the digits satisfy d0 + d1 = s, over all assignments."""
    return -F.log(F.get(S.antidiagonal_sums(p0, p1), s))


def drawn(probs: Column, u: Column) -> Column:
    """The value whose part of [0, 1) holds u."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("value"))
    end = F.aggregate(probs, start, lambda a, p: F.struct((a["sum"] + p).alias("sum"), F.when(u >= a["sum"] + p, a["value"] + 1).otherwise(a["value"]).alias("value")))
    return F.least(end["value"], F.size(probs) - 1)


def uniform_of(*parts: Column) -> Column:
    """A number in [0, 1) from a hash of the parts that any engine with md5 gives alike."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def sampled(p0: Column, p1: Column, s: Column, key: Column, samples: int = 100) -> Column:
    """Minus the logarithm of the share of hash-seeded draws that satisfy d0 + d1 = s, with half a draw added on either
    side so that no draw gives no infinity."""
    # each draw's number is bound once: drawn() names it in every step over the classes
    draw = lambda probs, tag, k: S.let(uniform_of(F.lit(tag), key, k), lambda u: drawn(probs, u))
    hits = F.aggregate(F.sequence(F.lit(1), F.lit(samples)), F.lit(0), lambda a, k: a + F.when(draw(p0, "a", k) + draw(p1, "b", k) == s, 1).otherwise(0))
    return -F.log((hits + 0.5) / (samples + 1.0))


def primal_dual(loss: Column, violation: Column, multiplier: float) -> Column:
    """The loss plus a multiplier times the constraint's violation."""
    return loss + multiplier * violation
