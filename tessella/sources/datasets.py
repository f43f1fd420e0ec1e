"""Datasets made of labelled vectors: splits, samples, shuffles, pairs, operator examples, balanced sums, batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import scalars as S


def lookup(images: DataFrame, wanted: DataFrame, key: str = "vec_id") -> DataFrame:
    """The vectors that a table of ids names: an equi-join on the id."""
    return wanted.join(images, key)


def in_order(images: DataFrame, ids: list[int]) -> DataFrame:
    """pos and the vectors of a list of ids, in the list's order."""
    spark = images.sparkSession
    wanted = spark.createDataFrame(list(enumerate(ids)), "pos long, vec_id long")
    return wanted.join(images, "vec_id").orderBy("pos")


def split(images: DataFrame, bounds: dict[str, tuple[int, int]], key: str = "vec_id") -> dict[str, DataFrame]:
    """Parts by ranges of the id (first, last): plain ranges reach the Parquet reader."""
    return {name: images.filter(F.col(key).between(a, b)) for name, (a, b) in bounds.items()}


def readers(images: DataFrame, train: int, mini: int, valid: int, test: int) -> dict[str, DataFrame]:
    """train, train_mini (the first of train), valid and test by consecutive ranges of the id. Raises if the table has
    fewer rows than they ask for."""
    if (rows := images.count()) < train + valid + test or mini > train:
        raise ValueError(f"{train} + {valid} + {test} rows, {mini} of the first, asked of a table of {rows}")
    return split(images, {"train": (0, train - 1), "train_mini": (0, mini - 1), "valid": (train, train + valid - 1), "test": (train + valid, train + valid + test - 1)})


def shares(rows: int, train: float = 0.6, mini: float = 0.1, valid: float = 0.2) -> tuple[int, int, int, int]:
    """Sizes of train, its first part, valid and test (the rest) of so many rows."""
    n = int(rows * train)
    return n, int(rows * mini), int(rows * valid), rows - n - int(rows * valid)


def ranked(df: DataFrame, h: Column, name: str, key: str = "vec_id", within: list[str] = ()) -> DataFrame:
    """df with its rank (from 0) in the order of a hexadecimal hash, in each group. Ranks are sums over 4096 prefixes of
    the hash, so no task sorts all rows of a group."""
    rows = df.withColumn("__h", h).withColumn("__b", F.substring("__h", 1, 3))
    sizes = rows.groupBy(*within, "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*within).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*within, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inner = F.row_number().over(Window.partitionBy(*within, "__b").orderBy("__h", key)) - 1
    out = rows.withColumn("__r", inner).join(sizes if within else F.broadcast(sizes), [*within, "__b"])
    return out.withColumn(name, F.col("__base") + F.col("__r")).drop("__h", "__b", "__r", "__base")


def shuffled_rank(df: DataFrame, seed: int, key: str = "vec_id") -> DataFrame:
    """df with rn, from 0 in hash order."""
    return ranked(df, S.hash_order(seed, F.col(key)), "rn", key)


def sample_exact(df: DataFrame, n: int, seed: int, key: str = "vec_id") -> DataFrame:
    """Exactly n rows without replacement (all, if there are fewer)."""
    return df.orderBy(S.hash_order(seed, F.col(key)), key).limit(n)


def subset(df: DataFrame, n: int, allowed: list[int] | None = None, key: str = "vec_id", label: str = "label") -> DataFrame:
    """The first n + 1 rows by id whose label is allowed; n + 1 is what the operator has always returned."""
    rows = df if allowed is None else df.filter(F.col(label).isin(allowed))
    return rows.orderBy(key).limit(n + 1)


def shuffled_pairs(images: DataFrame, seed: int) -> DataFrame:
    """ex, img_a, img_b, target: neighbours in hash order; an odd last vector is left out."""
    ranked = shuffled_rank(images, seed)
    at = lambda i, c: F.max(F.when(F.col("rn") % 2 == i, F.col(c)))
    out = ranked.groupBy(F.expr("rn div 2").alias("ex")).agg(at(0, "vec_id").alias("img_a"), at(1, "vec_id").alias("img_b"), (at(0, "label") + at(1, "label")).alias("target"))
    return out.filter(F.col("img_b").isNotNull())


def batches(ranked: DataFrame, size: int, rank: str = "rn") -> DataFrame:
    """Rows with the number of their batch."""
    return ranked.withColumn("batch", F.expr(f"{rank} div {size}"))


def operator_examples(images: DataFrame, size: int = 1, arity: int = 2, operator: Callable[[Column, Column], Column] = lambda a, x: a + x, seed: int | None = None, of_list: Callable[[list[int]], int] | None = None) -> DataFrame:
    """ex, args (arity numbers of size ids each), digits (their labels), expected (the operator over the numbers).

    operator folds Columns; of_list, any Python function of the list of numbers, takes its place where no fold can say
    it, one Arrow batch at a time. Ids are taken in order, or in hash order with a seed; what doesn't fill an example is
    left out.
    """
    if size < 1 or arity < 1:
        raise ValueError("size and arity must be at least 1")
    width = size * arity
    rows = images.withColumn("rn", F.col("vec_id")) if seed is None else shuffled_rank(images, seed)
    rows = rows.groupBy(F.expr(f"rn div {width}").alias("ex")).agg(F.array_sort(F.collect_list(F.struct((F.col("rn") % width).alias("pos"), "vec_id", "label"))).alias("m"))
    rows = rows.filter(F.size("m") == width)
    cut = lambda c: F.transform(F.sequence(F.lit(0), F.lit(arity - 1)), lambda i: F.transform(F.slice("m", i * size + 1, size), lambda r: r[c]))
    rows = rows.select("ex", cut("vec_id").alias("args"), cut("label").alias("digits"))
    numbers = F.transform("digits", S.digits_to_number)
    if of_list is not None:

        @F.pandas_udf("long")
        def expected(lists: pd.Series) -> pd.Series:
            return lists.map(lambda x: int(of_list([int(v) for v in x]))).astype("int64")

        return rows.withColumn("expected", expected(numbers))
    first = F.get(numbers, F.lit(0))
    return rows.withColumn("expected", F.aggregate(F.slice(numbers, 2, max(1, arity - 1)) if arity > 1 else F.array().cast("array<bigint>"), first, operator))


def addition(images: DataFrame, n: int = 1, seed: int | None = None) -> tuple[str, DataFrame]:
    """The dataset of sums of two n-digit numbers and its name."""
    return "addition" if n == 1 else "multi_addition", operator_examples(images, n, 2, seed=seed)


def queries_of(images: DataFrame) -> DataFrame:
    """One ground query a vector: img, label."""
    return images.select(F.col("vec_id").alias("img"), "label")


def example_json(examples: DataFrame) -> Column:
    """`[args, expected]` of an example."""
    return F.concat(F.lit("["), F.to_json("args"), F.lit(","), F.col("expected").cast("string"), F.lit("]"))


def example_line(examples: DataFrame) -> Column:
    """The digit groups, flattened, as a tuple, and the expected number, with a tab between: `(1, 2)<tab>3`."""
    ids = F.flatten("args")
    inner = F.concat_ws(", ", F.transform(ids, lambda x: x.cast("string")))
    return F.concat(F.lit("("), inner, F.when(F.size(ids) == 1, ",)").otherwise(")"), F.lit("\t"), F.col("expected").cast("string"))


def proposals(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """req, s, d0, d1: n sums, even over 0 to 18, and a first digit even over those that allow the sum."""
    pick = lambda tag: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{tag}:"), F.col("req").cast("string"))), 1, 8), 16, 10).cast("long")
    out = spark.range(n).select(F.col("id").alias("req")).withColumn("s", (pick("s") % 19).cast("int"))
    low, high = F.greatest(F.lit(0), F.col("s") - 9), F.least(F.col("s"), F.lit(9))
    out = out.withColumn("d0", (low + (pick("d") % (high - low + 1)).cast("int")).cast("int"))
    return out.withColumn("d1", F.col("s") - F.col("d0"))


def balanced_pairs(images: DataFrame, requests: DataFrame, seed: int, strict: bool = True) -> DataFrame:
    """req, s, img0, img1, d0, d1: each request's two digits get vectors of those labels, each vector once.

    Ranks within a digit pair requests with vectors, so the matching is one equi-join. If a digit has too few vectors,
    strict raises; else those requests are left out.
    """
    asked = requests.select("req", F.explode(F.array(F.struct(F.lit(0).alias("pos"), F.col("d0").alias("digit")), F.struct(F.lit(1).alias("pos"), F.col("d1").alias("digit")))).alias("a")).select("req", "a.*")
    # in the order of the requests, two levels again: 4096 of them to a window
    chunk = F.expr("req div 4096")
    sizes = asked.groupBy("digit", chunk.alias("chunk")).agg(F.count("*").alias("n"))
    base = F.coalesce(F.sum("n").over(Window.partitionBy("digit").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = F.row_number().over(Window.partitionBy("digit", "chunk").orderBy("req", "pos"))
    asked = asked.withColumn("chunk", chunk).withColumn("inner", inner).join(sizes.select("digit", "chunk", base.alias("base")), ["digit", "chunk"])
    asked = asked.withColumn("k", F.col("base") + F.col("inner")).drop("chunk", "inner", "base")
    pool = ranked(images.select(F.col("label").alias("digit"), "vec_id"), S.hash_order(seed, F.col("vec_id")), "rank", within=["digit"]).select("digit", "vec_id", (F.col("rank") + 1).alias("k"))
    got = asked.join(pool, ["digit", "k"], "left")
    if strict:
        got = got.withColumn("vec_id", F.when(F.col("vec_id").isNull(), F.raise_error(F.lit("a digit has too few vectors")).cast("long")).otherwise(F.col("vec_id")))
    at = lambda i: F.max(F.when(F.col("pos") == i, F.col("vec_id")))
    got = got.groupBy("req").agg(at(0).alias("img0"), at(1).alias("img1")).filter("img0 IS NOT NULL AND img1 IS NOT NULL AND img0 <> img1")
    return requests.join(got, "req").select("req", "s", "img0", "img1", "d0", "d1")


def buckets(images: DataFrame) -> DataFrame:
    """label and the ids that have it, in order."""
    return images.groupBy("label").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def histogram(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """value, n for all values 0 to bins - 1, zeros too."""
    spark = df.sparkSession
    counts = df.groupBy(value.cast("int").alias("value")).agg(F.count("*").alias("n"))
    dense = spark.range(bins).select(F.col("id").cast("int").alias("value"))
    return dense.join(counts, "value", "left").select("value", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@dataclass(frozen=True)
class Canvas:
    """Images of several small ones: a square of `size`, filled with `background`, cells of `cell` a side."""

    size: int = 56
    cell: int = 28
    background: float = -1.0

    def compose(self, parts: list[np.ndarray], places: list[tuple[int, int]]) -> np.ndarray:
        if len(parts) > len(places):
            raise ValueError("more images than places")
        out = np.full((self.size, self.size), self.background, np.float32)
        for part, (r, c) in zip(parts, places, strict=False):
            out[r : r + self.cell, c : c + self.cell] = part
        return out


def canvases(examples: DataFrame, canvas: Canvas = Canvas(16, 8)) -> DataFrame:
    """key, pixels: one canvas for each row (key, parts array<array<float>>), one or two images of cell * cell values
    at the upper left and the lower right."""
    places = [(0, 0), (canvas.size - canvas.cell, canvas.size - canvas.cell)]

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [canvas.compose([np.asarray(p, np.float32).reshape(canvas.cell, canvas.cell) for p in parts], places).ravel() for parts in f["parts"]]
            yield pd.DataFrame({"key": f["key"], "pixels": made})

    return examples.select("key", "parts").mapInPandas(build, "key long, pixels array<float>")
