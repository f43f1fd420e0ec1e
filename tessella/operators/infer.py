"""Decoding: independent argmax, constrained top-1, and gradient-based refinement of unsatisfied examples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import scalars as S


def argmax_digits(pairs: DataFrame) -> DataFrame:
    """ex, d0, d1 by the largest probability each; equal ones: the smallest digit."""
    return pairs.select("ex", S.argmax(F.col("p0")).alias("d0"), S.argmax(F.col("p1")).alias("d1"))


def best_assignment(p0, p1, feasible, sums=None):
    """The assignment (d0, d1, s, score) with the largest sum of log probabilities that satisfies the constraints, as a
    Column over two distributions.

    All 100 digit pairs of an example stand in one array, so the search is exact and needs neither a join nor an
    exchange. feasible: from columns (d0, d1, s) to a predicate; sums: a distribution of s to add, or none. Of equal
    scores the smallest (d0, d1) wins; without a feasible assignment the result is null.
    """
    log = lambda p: F.log(F.greatest(p, F.lit(1e-300)))
    digits = F.sequence(F.lit(0), F.lit(9))
    score = lambda a, b: log(F.get(p0, a)) + log(F.get(p1, b)) + (log(F.get(sums, a + b)) if sums is not None else F.lit(0.0))
    cells = F.flatten(F.transform(digits, lambda a: F.transform(digits, lambda b: F.struct(a.alias("d0"), b.alias("d1"), (a + b).alias("s")))))
    allowed = F.filter(cells, lambda c: feasible(c["d0"], c["d1"], c["s"]))
    scored = F.transform(allowed, lambda c: F.struct(c["d0"].alias("d0"), c["d1"].alias("d1"), c["s"].alias("s"), score(c["d0"], c["d1"]).alias("score")))
    better = lambda x, c: F.when(x.isNull() | (c["score"] > x["score"]), c).otherwise(x)
    return S.let(scored, lambda v: F.aggregate(F.slice(v, 2, 100), F.get(v, F.lit(0)), better))


def constrained(pairs: DataFrame, feasible, sums=None) -> DataFrame:
    """ex, d0, d1, s, score: each example's best feasible assignment, or nulls."""
    best = best_assignment(F.col("p0"), F.col("p1"), feasible, sums)
    return pairs.withColumn("__b", best).select("ex", F.col("__b.d0").alias("d0"), F.col("__b.d1").alias("d1"), F.col("__b.s").alias("s"), F.col("__b.score").alias("score"))


Params = dict[str, np.ndarray]
#: Examples that are refined side by side, each with a copy of all weights.
TOGETHER = 128


def initial_parameters(width: int, seed: int = 0) -> Params:
    """Weights of a digit head over vectors (digit) and of a learned sum layer over both digits' logits (hidden, out)."""
    rng = np.random.default_rng(seed)
    shapes = {"digit.weight": (10, width), "hidden.weight": (64, 20), "out.weight": (19, 64)}
    out: Params = {}
    for name, (y, x) in shapes.items():
        out[name] = rng.uniform(-1, 1, (y, x)) / np.sqrt(x)
        out[name.replace("weight", "bias")] = np.zeros(y)
    return out


def scores(w: Params, x0: np.ndarray, x1: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Logits of both digits and of the sum, and the hidden layer, where each example has weights of its own (a leading
    axis)."""
    z0, z1 = (np.einsum("ncd,nd->nc", w["digit.weight"], x) + w["digit.bias"] for x in (x0, x1))
    hidden = np.maximum(np.einsum("nhc,nc->nh", w["hidden.weight"], np.concatenate([z0, z1], axis=1)) + w["hidden.bias"], 0)
    return [z0, z1, np.einsum("nsh,nh->ns", w["out.weight"], hidden) + w["out.bias"]], hidden


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def refinement_loss(w: Params, origin: Params, x0: np.ndarray, x1: np.ndarray, open_: np.ndarray, weight: float) -> np.ndarray:
    """Of each example: the mean log probability over all classes of all variables while it is unsatisfied, plus weight
    times the distance of its weights from where they began."""
    z, _ = scores(w, x0, x1)
    return np.concatenate([log_softmax(x) for x in z], axis=1).mean(axis=1) * open_ + weight * distance(w, origin)


def distance(w: Params, origin: Params) -> np.ndarray:
    return np.sqrt(sum(((w[k] - origin[k]) ** 2).reshape(len(w[k]), -1).sum(axis=1) for k in w))


def refinement_gradient(w: Params, origin: Params, x0: np.ndarray, x1: np.ndarray, open_: np.ndarray, weight: float) -> Params:
    """The derivative of refinement_loss by each example's weights."""
    (z0, z1, zs), hidden = scores(w, x0, x1)
    classes = z0.shape[1] + z1.shape[1] + zs.shape[1]
    g0, g1, gs = (open_[:, None] * (1 - z.shape[1] * np.exp(log_softmax(z))) / classes for z in (z0, z1, zs))
    out = {"out.weight": np.einsum("ns,nh->nsh", gs, hidden), "out.bias": gs}
    gh = np.einsum("nsh,ns->nh", w["out.weight"], gs) * (hidden > 0)
    out |= {"hidden.weight": np.einsum("nh,nc->nhc", gh, np.concatenate([z0, z1], axis=1)), "hidden.bias": gh}
    back = np.einsum("nhc,nh->nc", w["hidden.weight"], gh)
    g0, g1 = g0 + back[:, :10], g1 + back[:, 10:]
    out |= {"digit.weight": np.einsum("nc,nd->ncd", g0, x0) + np.einsum("nc,nd->ncd", g1, x1), "digit.bias": g0 + g1}
    far = np.maximum(distance(w, origin), 1e-12)
    for k in out:
        out[k] = out[k] + weight * (w[k] - origin[k]) / far.reshape(-1, *[1] * (w[k].ndim - 1))
    return out


def refined(w: Params, x0: np.ndarray, x1: np.ndarray, weight: float, rate: float, steps: int) -> tuple[Params, list[np.ndarray], np.ndarray]:
    """Each example's weights after refinement, its labels (d0, d1, s), and the steps used. The loss has no lower bound;
    an example whose step would leave the range of numbers stops before it, with all steps counted as used."""
    origin = {k: v.copy() for k, v in w.items()}
    used = np.zeros(len(x0), np.int64)
    while True:
        best = [z.argmax(axis=1) for z in scores(w, x0, x1)[0]]
        open_ = (best[0] + best[1] != best[2]) & (used < steps)
        if not open_.any():
            return w, best, used
        i = np.flatnonzero(open_)
        part, start = {k: v[i] for k, v in w.items()}, {k: v[i] for k, v in origin.items()}
        with np.errstate(all="ignore"):
            step = {k: part[k] - rate * g for k, g in refinement_gradient(part, start, x0[i], x1[i], np.ones(len(i)), weight).items()}
            fine = np.all([(np.abs(v) < 1e100).reshape(len(i), -1).all(axis=1) for v in step.values()], axis=0)
        for k, v in step.items():
            w[k][i[fine]] = v[fine]
        used[i] = np.where(fine, used[i] + 1, steps)


_REFINED = "ex long, d0 int, d1 int, s int, steps long, satisfied boolean"


def _vectors(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.stack(f[c].to_numpy()).astype(float) for c in ("x0", "x1"))


def refine(pairs: DataFrame, params: Params, weight: float = 1.0, rate: float = 0.1, steps: int = 100) -> DataFrame:
    """Gradient-based inference: ex, d0, d1, s, steps, satisfied for rows (ex, x0, x1: vectors of a pair).

    Where the argmax assignment breaks d0 + d1 = s, the example's own copy of all weights takes gradient steps on
    refinement_loss until the constraint holds or the steps are used up; satisfied examples pass as they are. Examples
    don't depend on each other, so any number of them is refined side by side.
    """
    sent = pairs.sparkSession.sparkContext.broadcast(params)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for lo in range(0, len(f), TOGETHER):
                part = f.iloc[lo : lo + TOGETHER]
                w = {k: np.repeat(v[None], len(part), axis=0) for k, v in sent.value.items()}
                _, best, used = refined(w, *_vectors(part), weight, rate, steps)
                yield pd.DataFrame({"ex": part["ex"], "d0": best[0], "d1": best[1], "s": best[2], "steps": used, "satisfied": best[0] + best[1] == best[2]})

    return pairs.select("ex", "x0", "x1").mapInPandas(run, _REFINED)


def _sequence(f: pd.DataFrame, params: Params, weight: float, rate: float, steps: int) -> tuple[pd.DataFrame, Params]:
    f = f.sort_values("ex")
    x0, x1 = _vectors(f)
    w, rows = {k: v[None].copy() for k, v in params.items()}, []
    for k, ex in enumerate(f["ex"].tolist()):
        w, best, used = refined(w, x0[k : k + 1], x1[k : k + 1], weight, rate, steps)
        d0, d1, s = (int(b[0]) for b in best)
        rows.append((ex, d0, d1, s, int(used[0]), d0 + d1 == s))
    return pd.DataFrame(rows, columns=["ex", "d0", "d1", "s", "steps", "satisfied"]), {k: v[0] for k, v in w.items()}


def refine_in_sequence(pairs: DataFrame, params: Params, weight: float = 1.0, rate: float = 0.1, steps: int = 100, group: str = "part") -> DataFrame:
    """As refine, but within a group each example starts with the weights that the one before it (by ex) has ended with:
    sequential by nature, so the group key says how much may run side by side."""
    sent = pairs.sparkSession.sparkContext.broadcast(params)
    return pairs.groupBy(group).applyInPandas(lambda f: _sequence(f, sent.value, weight, rate, steps)[0], _REFINED)


def learn_by_refining(pairs: DataFrame, params: Params, rounds: int = 1, weight: float = 1.0, rate: float = 0.1, steps: int = 100, group: str = "part", interval: int = 0, save: Callable[[int, Params], None] | None = None) -> tuple[Params, list[tuple[int, int, int]]]:
    """Refinement as a way of training: in each round every group goes through its examples in sequence from the same
    weights, and the groups' last weights are averaged by their examples, in the cluster, so that what comes back has
    the size of the parameters. The log holds (round, examples, satisfied). save sees the weights after every
    interval-th round and after the last one."""
    names = list(params)
    pairs = pairs.select(group, "ex", "x0", "x1").persist()
    log = []
    try:
        for number in range(1, rounds + 1):
            sent = pairs.sparkSession.sparkContext.broadcast(params)

            def run(f: pd.DataFrame) -> pd.DataFrame:
                rows, w = _sequence(f, sent.value, weight, rate, steps)  # noqa: B023
                flat = np.concatenate([w[k].ravel() for k in names]) * len(rows)
                return pd.DataFrame({"w": [np.concatenate([flat, [len(rows), rows["satisfied"].sum()]])]})

            sums = pairs.groupBy(group).applyInPandas(run, "w array<double>").select(F.posexplode("w").alias("at", "w")).groupBy("at").agg(F.sum("w").alias("w")).collect()
            flat = np.zeros(sum(params[k].size for k in names) + 2)
            for at, w in sums:
                flat[at] = w
            n, satisfied = int(flat[-2]), int(flat[-1])
            log.append((number, n, satisfied))
            if n:
                cuts = np.cumsum([0, *(params[k].size for k in names)])
                params = {k: (flat[a:z] / n).reshape(params[k].shape) for k, a, z in zip(names, cuts[:-1], cuts[1:], strict=True)}
            if save and (number == rounds or (interval and number % interval == 0)):
                save(number, params)
    finally:
        pairs.unpersist()
    return params, log
