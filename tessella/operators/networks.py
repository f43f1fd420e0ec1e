"""Forward passes of small networks in numpy, run over Arrow batches with broadcast parameters.

A network is a list of layers applied to a batch (rows, channels, height, width) or (rows, features); parameters are
plain arrays by name, as saved by tessella.sources.tables.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Params = dict[str, np.ndarray]
Layer = Callable[[np.ndarray, Params], np.ndarray]


def conv2d(name: str, padding: int = 0) -> Layer:
    """Cross-correlation with {name}.weight (out, in, k, k) and {name}.bias."""

    def run(x: np.ndarray, p: Params) -> np.ndarray:
        w = p[f"{name}.weight"]
        x = np.pad(x, ((0, 0), (0, 0), (padding, padding), (padding, padding))) if padding else x
        windows = np.lib.stride_tricks.sliding_window_view(x, w.shape[2:], axis=(2, 3))
        return np.einsum("nchwij,ocij->nohw", windows, w, optimize=True) + p[f"{name}.bias"][None, :, None, None]

    return run


def max_pool(size: int) -> Layer:
    def run(x: np.ndarray, p: Params) -> np.ndarray:
        n, c, h, w = x.shape
        return x[:, :, : h // size * size, : w // size * size].reshape(n, c, h // size, size, w // size, size).max(axis=(3, 5))

    return run


def linear(name: str) -> Layer:
    return lambda x, p: x @ p[f"{name}.weight"].T + p[f"{name}.bias"]


def layer_norm(name: str, epsilon: float = 1e-5) -> Layer:
    def run(x: np.ndarray, p: Params) -> np.ndarray:
        axes = tuple(range(1, x.ndim))
        mean = x.mean(axis=axes, keepdims=True)
        return (x - mean) / np.sqrt(x.var(axis=axes, keepdims=True) + epsilon) * p[f"{name}.weight"] + p[f"{name}.bias"]

    return run


def relu(x: np.ndarray, p: Params) -> np.ndarray:
    return np.maximum(x, 0)


def sigmoid(x: np.ndarray, p: Params) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def dropout(x: np.ndarray, p: Params) -> np.ndarray:
    """Nothing, outside of training."""
    return x


def flatten(x: np.ndarray, p: Params) -> np.ndarray:
    return x.reshape(len(x), -1)


def softmax(x: np.ndarray, p: Params) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def forward(layers: list[Layer], x: np.ndarray, params: Params) -> np.ndarray:
    for layer in layers:
        x = layer(x, params)
    return x


def plain_cnn(pool: int = 2) -> list[Layer]:
    """Two convolutions with pooling but no rectifier between, a hidden layer, class probabilities."""
    return [conv2d("conv1"), max_pool(pool), conv2d("conv2"), max_pool(pool), flatten, linear("fc1"), relu, dropout, linear("fc2"), softmax]


def lenet_encoder(pool: int = 2) -> list[Layer]:
    """Two convolutions with pooling and rectifiers, to one vector an image."""
    return [conv2d("encoder1"), max_pool(pool), relu, conv2d("encoder2"), max_pool(pool), relu, flatten]


def lenet_classifier(with_softmax: bool = True, one: bool = False) -> list[Layer]:
    """Three linear layers; one output ends in a sigmoid."""
    head = [linear("classifier1"), relu, linear("classifier2"), relu, linear("classifier3")]
    return head + ([sigmoid] if one else [softmax] if with_softmax else [])


def lenet(pool: int = 2, with_softmax: bool = True, one: bool = False) -> list[Layer]:
    """Encoder and classifier together."""
    return lenet_encoder(pool) + lenet_classifier(with_softmax, one)


def pair_cnn(pool: int = 2) -> list[Layer]:
    """Convolutions, the flattened values normalised, a hidden layer, to logits; both images of a pair go through as
    rows."""
    return [conv2d("conv1"), relu, max_pool(pool), conv2d("conv2"), relu, max_pool(pool), flatten, layer_norm("norm"), linear("lin1"), relu, dropout, linear("lin2")]


def canvas_cnn(pool: int = 2) -> list[Layer]:
    """As pair_cnn without normalising, for canvases of several images, to the logits of a digit or of a sum."""
    return [conv2d("conv1"), relu, max_pool(pool), conv2d("conv2"), relu, max_pool(pool), flatten, linear("lin1"), relu, dropout, linear("lin2")]


def perceptron(layers: int = 2) -> list[Layer]:
    out: list[Layer] = [flatten]
    for i in range(1, layers):
        out += [linear(f"fc{i}"), relu]
    return [*out, linear(f"fc{layers}"), softmax]


def sum_layer() -> list[Layer]:
    """A learned sum: the two digits' logits, 20 together, to 19."""
    return [linear("hidden"), relu, linear("out")]


def shapes(kind: str, side: int = 8, pool: int = 2, filters: tuple[int, int] = (4, 8), kernel: int = 2, hidden: int = 16, out: int = 10) -> dict[str, tuple[int, ...]]:
    """Shapes of the parameters of a network over side * side images: plain, lenet, pair, canvas, mlp or sum."""
    a, b = filters
    left = ((side - kernel + 1) // pool - kernel + 1) // pool
    if kind not in ("mlp", "sum") and left < 1:
        raise ValueError(f"nothing is left of images of {side} by {side} after two kernels of {kernel} and pools of {pool}")
    flat = b * left**2
    first, second = ("encoder1", "encoder2") if kind == "lenet" else ("conv1", "conv2")
    convolutions = {f"{first}.weight": (a, 1, kernel, kernel), f"{first}.bias": (a,), f"{second}.weight": (b, a, kernel, kernel), f"{second}.bias": (b,)}
    two = [("lin1", flat, hidden), ("lin2", hidden, out)]
    dense = {"lenet": [("classifier1", flat, hidden), ("classifier2", hidden, hidden), ("classifier3", hidden, out)], "pair": two, "canvas": two, "plain": [("fc1", flat, hidden), ("fc2", hidden, out)], "sum": [("hidden", 20, 64), ("out", 64, 19)], "mlp": [("fc1", side * side, hidden), ("fc2", hidden, out)]}[kind]
    found = {} if kind in ("sum", "mlp") else convolutions
    for name, x, y in dense:
        found |= {f"{name}.weight": (y, x), f"{name}.bias": (y,)}
    return found | ({"norm.weight": (flat,), "norm.bias": (flat,)} if kind == "pair" else {})


def initial(shape: dict[str, tuple[int, ...]], seed: int = 0) -> Params:
    """Even random values within one over the square root of the inputs."""
    rng = np.random.default_rng(seed)
    return {k: np.ones(s) if k == "norm.weight" else rng.uniform(-1, 1, s) / np.sqrt(max(1, int(np.prod(s[1:])))) for k, s in shape.items()}


def predict(df: DataFrame, layers: list[Layer], params: Params, side: int | None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, probs: each distinct vector goes through the network once, many at a time; join the results afterwards."""
    sent = df.sparkSession.sparkContext.broadcast(params)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x = np.stack(f["v"].to_numpy()).astype(float)
                x = x if side is None else x.reshape(len(x), 1, side, side)
                yield pd.DataFrame({"k": f["k"], "probs": list(forward(layers, x, sent.value))})

    return df.select(F.col(key).alias("k"), F.col(vector).alias("v")).mapInPandas(run, "k long, probs array<double>").withColumnRenamed("k", key)


def layer_times(df: DataFrame, layers: list[Layer], params: Params, side: int | None, vector: str = "embedding") -> DataFrame:
    """layer (its number), ms (mean of an Arrow batch's time in it), batches."""
    sent = df.sparkSession.sparkContext.broadcast(params)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x = np.stack(f["v"].to_numpy()).astype(float)
                x, spent = x if side is None else x.reshape(len(x), 1, side, side), []
                for layer in layers:
                    began = time.perf_counter()
                    x = layer(x, sent.value)
                    spent.append((time.perf_counter() - began) * 1000)
                yield pd.DataFrame({"layer": range(len(layers)), "ms": spent})

    each = df.select(F.col(vector).alias("v")).mapInPandas(run, "layer int, ms double")
    return each.groupBy("layer").agg(F.avg("ms").alias("ms"), F.count("*").alias("batches"))
