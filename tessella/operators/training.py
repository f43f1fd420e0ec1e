"""Training from sums alone: a softmax head whose gradients are added up in the cluster and applied on the driver.

An epoch is one pass that returns a gradient of fixed size (parameters, not rows), so nothing about the data reaches
the driver and no lineage grows: each epoch reads the same table with other broadcast parameters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import scalars as S
from tessella.operators import metrics

DIGITS, SUMS = 10, 19


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def sum_distribution(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), SUMS))
    for i in range(DIGITS):
        out[:, i : i + DIGITS] += a[:, i : i + 1] * b
    return out


@dataclass
class Sgd:
    rate: float
    decay: float = 0.0

    def step(self, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        return w - self.rate * (g + self.decay * w)


@dataclass
class Adam:
    rate: float = 1e-3
    decay: float = 0.0
    betas: tuple[float, float] = (0.9, 0.999)
    state: list = field(default_factory=lambda: [0, 0.0, 0.0])

    def step(self, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        g = g + self.decay * w
        b1, b2 = self.betas
        n = self.state[0] + 1
        m, v = b1 * self.state[1] + (1 - b1) * g, b2 * self.state[2] + (1 - b2) * g * g
        self.state[:] = [n, m, v]
        return w - self.rate * (m / (1 - b1**n)) / (np.sqrt(v / (1 - b2**n)) + 1e-8)


@dataclass
class Batch:
    """Some pairs: distributions of both digits, their sum, and, where the table has them, the digits and the pairs'
    numbers; weight is the constraint's multiplier."""

    a: np.ndarray
    b: np.ndarray
    s: np.ndarray
    d0: np.ndarray | None = None
    d1: np.ndarray | None = None
    ex: np.ndarray | None = None
    weight: float = 1.0


#: Derivatives by both distributions, loss and violation (1 - P(d0 + d1 = s)), the last two summed.
Objective = Callable[[Batch], tuple[np.ndarray, np.ndarray, float, float]]


def satisfied(batch: Batch) -> np.ndarray:
    """P(d0 + d1 = s) of each pair."""
    return np.maximum(sum_distribution(batch.a, batch.b)[np.arange(len(batch.s)), batch.s], 1e-12)


def semantic(batch: Batch):
    """Minus log P(d0 + d1 = s)."""
    a, b, s = batch.a, batch.b, batch.s
    p = satisfied(batch)
    ga, gb = np.zeros_like(a), np.zeros_like(b)
    for i in range(DIGITS):
        j = s - i
        ok = np.flatnonzero((j >= 0) & (j < DIGITS))
        ga[ok, i] = -b[ok, j[ok]] / p[ok]
        gb[ok, i] = -a[ok, j[ok]] / p[ok]
    return ga, gb, float(-np.log(p).sum()), float((1 - p).sum())


def violation(batch: Batch):
    """Weight times 1 - P(d0 + d1 = s)."""
    ga, gb, _, violated = semantic(batch)
    p = satisfied(batch)[:, None]
    return batch.weight * ga * p, batch.weight * gb * p, batch.weight * violated, violated


def supervised(batch: Batch):
    """Cross-entropy with the labels of both digits."""
    if batch.d0 is None or batch.d1 is None:
        raise ValueError("supervised training needs columns d0 and d1")
    rows = np.arange(len(batch.s))
    ga, gb, loss = np.zeros_like(batch.a), np.zeros_like(batch.b), 0.0
    for g, p, d in ((ga, batch.a, batch.d0), (gb, batch.b, batch.d1)):
        own = np.maximum(p[rows, d], 1e-12)
        g[rows, d] = -1 / own
        loss -= float(np.log(own).sum())
    return ga, gb, loss, float((1 - satisfied(batch)).sum())


def explicit_sum(batch: Batch):
    """Cross-entropy of the sum, whose exact distribution stands as scores of the 19 classes before a softmax."""
    p = sum_distribution(batch.a, batch.b)
    q = softmax(p)
    rows = np.arange(len(batch.s))
    g = q.copy()
    g[rows, batch.s] -= 1
    ga, gb = (np.stack([(g[:, i : i + DIGITS] * other).sum(axis=1) for i in range(DIGITS)], axis=1) for other in (batch.b, batch.a))
    return ga, gb, float(-np.log(q[rows, batch.s]).sum()), float((1 - satisfied(batch)).sum())


def digit_labels(batch: Batch):
    """Cross-entropy with the weak labels of each digit: even over those that the sum allows."""
    weak = np.zeros((SUMS, DIGITS))
    for t in range(SUMS):
        weak[t, max(0, t - 9) : min(t, 9) + 1] = 1 / (min(t, 9) - max(0, t - 9) + 1)
    t, a, b = weak[batch.s], np.maximum(batch.a, 1e-12), np.maximum(batch.b, 1e-12)
    return -t / a, -t / b, float(-(t * np.log(a)).sum() - (t * np.log(b)).sum()), float((1 - satisfied(batch)).sum())


def primal_dual(task: Objective = digit_labels, prior: float = 1.0) -> Objective:
    """A task's loss, times a prior weight, and the multiplier times the constraint's violation."""

    def objective(batch: Batch):
        ga, gb, loss, _ = task(batch)
        va, vb, more, violated = violation(batch)
        return prior * ga + va, prior * gb + vb, prior * loss + more, violated

    return objective


def drawn_uniforms(ex: np.ndarray, samples: int, tag: int, seed: int) -> np.ndarray:
    """Numbers in [0, 1) from a hash of the pair's number, the draw, a tag and the seed: the same for a pair wherever and
    beside whatever it is computed."""
    with np.errstate(over="ignore"):
        h = ex.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64((tag * 0x8CB92BA72F3D8DD7 + seed * 0x2545F4914F6CDD1D) % 2**64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        h ^= h >> np.uint64(31)
    return (h >> np.uint64(11)).astype(float) / 2.0**53


def sampling(samples: int = 100, seed: int = 0) -> Objective:
    """Score-function estimate of the semantic loss from drawn assignments, seeded by each pair's number."""

    def objective(batch: Batch):
        a, b, s = batch.a, batch.b, batch.s
        if batch.ex is None:
            raise ValueError("drawing needs the pairs' numbers, in a column ex")
        draw = lambda p, tag: (np.cumsum(p, axis=1)[:, None, :] <= drawn_uniforms(batch.ex, samples, tag, seed)[:, :, None]).sum(axis=2).clip(0, DIGITS - 1)
        x, y = draw(a, 1), draw(b, 2)
        hit = (x + y == s[:, None]).astype(float)
        p = (hit.sum(axis=1) + 0.5) / (samples + 1.0)
        ga, gb = np.zeros_like(a), np.zeros_like(b)
        rows = np.repeat(np.arange(len(s)), samples)
        np.add.at(ga, (rows, x.ravel()), (-hit / samples / p[:, None]).ravel() / np.maximum(a[rows, x.ravel()], 1e-12))
        np.add.at(gb, (rows, y.ravel()), (-hit / samples / p[:, None]).ravel() / np.maximum(b[rows, y.ravel()], 1e-12))
        return ga, gb, float(-np.log(p).sum()), float((1 - p).sum())

    return objective


@dataclass(frozen=True)
class Epoch:
    number: int
    loss: float
    violation: float
    multiplier: float


def epoch_gradient(pairs: DataFrame, w: np.ndarray, objective: Objective, weight: float) -> tuple[np.ndarray, float, float, int]:
    """Sum of the gradients over all pairs (x0, x1: vectors, s, and d0, d1, ex if there), with loss, violation and number
    of pairs: one pass, one aggregate."""
    sent = pairs.sparkSession.sparkContext.broadcast(w)
    more = [c for c in ("d0", "d1", "ex") if c in pairs.columns]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, rest = np.zeros(w.shape), np.zeros(3)
        for f in frames:
            if not len(f):
                continue
            x = [np.c_[np.stack(f[c].to_numpy()).astype(float), np.ones(len(f))] for c in ("x0", "x1")]
            p = [softmax(v @ sent.value.T) for v in x]
            *g, loss, violated = objective(Batch(*p, f["s"].to_numpy().astype(int), weight=weight, **{c: f[c].to_numpy().astype(int) for c in more}))
            for x_, p_, g_ in zip(x, p, g, strict=True):
                total += (p_ * (g_ - (g_ * p_).sum(axis=1, keepdims=True))).T @ x_
            rest += loss, violated, len(f)
        yield pd.DataFrame({"g": [np.concatenate([total.ravel(), rest])]})

    parts = pairs.select("x0", "x1", "s", *more).mapInPandas(run, "g array<double>")
    # added up value by value in the cluster: what arrives has the size of the parameters, however many tasks there are
    out = np.zeros(w.size + 3)
    for at, g in parts.select(F.posexplode("g").alias("at", "g")).groupBy("at").agg(F.sum("g")).collect():
        out[at] = g
    return out[: w.size].reshape(w.shape), float(out[-3]), float(out[-2]), int(out[-1])


def head_scores(x: Column, w: np.ndarray) -> Column:
    """A linear head's score of each class for a vector column (array of doubles); w has the biases last."""
    dot = lambda c: F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in w[c, :-1]]), lambda a, b: a * b), F.lit(float(w[c, -1])), lambda a, b: a + b)
    return F.array(*[dot(c) for c in range(len(w))])


def predicted(pairs: DataFrame, w: np.ndarray) -> DataFrame:
    """label and pred of both digits of pairs (x0, x1, d0, d1)."""
    one = F.explode(F.array(*[F.struct(F.col(f"d{i}").cast("int").alias("label"), F.col(f"x{i}").cast("array<double>").alias("x")) for i in (0, 1)])).alias("o")
    return pairs.select(one).select("o.label", S.argmax(head_scores(F.col("o.x"), w)).alias("pred"))


@dataclass
class Evaluation:
    """What is measured after every interval-th epoch: tracked values of the predictions on the training pairs, the
    validation pairs, or both. log: (epoch, which pairs, tracker, value)."""

    interval: int = 1
    train: bool = True
    valid: DataFrame | None = None
    trackers: dict[str, Callable[[DataFrame], float]] = field(default_factory=lambda: {"accuracy": metrics.accuracy_of})
    log: list[tuple[int, str, str, float]] = field(default_factory=list)

    def __call__(self, epoch: int, pairs: DataFrame, w: np.ndarray) -> None:
        if epoch % self.interval:
            return
        for name, rows in (("train", pairs if self.train else None), ("valid", self.valid)):
            if rows is not None:
                found = predicted(rows, w)
                self.log += [(epoch, name, tracker, f(found)) for tracker, f in self.trackers.items()]


def train(pairs: DataFrame, width: int, objective: Objective = semantic, optimizer: Sgd | Adam | None = None, epochs: int = 3, seed: int = 0, multiplier_rate: float = 0.0, after_epoch: Callable[[Epoch, np.ndarray], None] | None = None, evaluation: Evaluation | None = None) -> tuple[np.ndarray, list[Epoch]]:
    """Weights (10, width + 1) and the log of the epochs. Epoch 0 only measures. With a multiplier rate, the
    multiplier starts at 1 and grows with the mean violation (dual ascent); after_epoch sees each epoch, evaluation
    measures those that its interval names. The pairs are read and matched once, not once an epoch."""
    optimizer = optimizer or Adam(0.01)
    w, multiplier, log = np.random.default_rng(seed).normal(0, 0.01, (DIGITS, width + 1)), 1.0, []
    pairs = pairs.persist()
    try:
        for number in range(epochs + 1):
            g, loss, violated, n = epoch_gradient(pairs, w, objective, multiplier)
            log.append(Epoch(number, loss / max(1, n), violated / max(1, n), multiplier))
            if after_epoch:
                after_epoch(log[-1], w)
            if evaluation:
                evaluation(number, pairs, w)
            if number < epochs:
                w = optimizer.step(w, g / max(1, n))
                multiplier += multiplier_rate * violated / max(1, n)
    finally:
        pairs.unpersist()
    return w, log


def few_shot(images: DataFrame, sizes: tuple[int, ...] = (8, 16, 32, 64, 128, 256), epochs: int = 40, rate: float = 1e-3, decay: float = 1e-2, seed: int = 0, batch: int = 4) -> list[tuple[int, float]]:
    """Accuracy over all images (x, label) of linear heads trained on the first n + 1 of them by Adam in shuffled batches,
    for each n: what a sweep of pre-training sizes gives. The training rows are few by definition and go to the driver;
    scoring is in the cluster."""
    out = []
    for n in sizes:
        rows = images.orderBy("vec_id").limit(n + 1).collect()
        x, y = np.c_[np.array([r["x"] for r in rows], float), np.ones(len(rows))], np.array([r["label"] for r in rows])
        rng = np.random.default_rng(seed)
        w, optimizer = rng.normal(0, 0.01, (DIGITS, x.shape[1])), Adam(rate, decay)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for a in range(0, len(y), batch):
                i = order[a : a + batch]
                p = softmax(x[i] @ w.T)
                p[np.arange(len(i)), y[i]] -= 1
                w = optimizer.step(w, p.T @ x[i] / len(i))
        hit = (S.argmax(head_scores(F.col("x"), w)) == F.col("label")).cast("double")
        out.append((n, float(images.agg(F.avg(hit)).first()[0])))
    return out
