"""Probabilistic relations as DataFrames: context columns, argument columns, a variable id, and prob."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import scalars as S


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table that stands for labelled images: vec_id, embedding, label."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")


def distributions(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, label, probs: the class distribution of each vector as an array, made in the scan's own stage."""
    return df.select("vec_id", "label", S.softmax(S.logits(F.col(vector))).alias("probs"))


def digits(df: DataFrame) -> DataFrame:
    """vec_id, label, value, prob: one row a class."""
    return distributions(df).select("vec_id", "label", F.posexplode("probs").alias("value", "prob"))


def to_arrays(facts: DataFrame, keys: list[str], value: str = "value", prob: str = "prob") -> DataFrame:
    """Long form back to one array a variable."""
    return facts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(value, prob))), lambda r: r[prob]).alias("probs"))


def groups(dist: DataFrame, n: int) -> DataFrame:
    """ex, and for each of n consecutive vectors (n * ex + i) v{i}, l{i} and p{i}: id, label, distribution. Vectors that
    don't fill a group are left out. One exchange, no self-join."""
    at = F.col("vec_id") % n
    parts = [F.max(F.when(at == i, F.col(c))).alias(f"{a}{i}") for i in range(n) for c, a in (("vec_id", "v"), ("label", "l"))]
    arrays = [F.max(F.when(at == i, F.col("probs"))).alias(f"p{i}") for i in range(n)]
    out = dist.groupBy(F.expr(f"vec_id div {n}").alias("ex")).agg(*parts, *arrays)
    return out.filter(F.col(f"v{n - 1}").isNotNull() & F.col("v0").isNotNull())


def bernoulli(spark: SparkSession, prob: float, name: str = "prob") -> DataFrame:
    """A ground fact that holds with a probability."""
    return spark.range(1).select(F.lit(float(prob)).alias(name))


def uniform(spark: SparkSession, n: int) -> DataFrame:
    """A static annotated disjunction: values 0 to n - 1, each with 1 / n."""
    return spark.range(n).select(F.col("id").cast("int").alias("value"), F.lit(1.0 / n).alias("prob"))


def add_table(spark: SparkSession, top: int = 9) -> DataFrame:
    """a, b, s for all pairs of digits: of fixed size, so that it may be broadcast."""
    rows = spark.range(2 * top + 1).select(F.col("id").cast("int").alias("s"))
    return rows.select(F.explode(S.feasible_range(F.col("s"), top)).alias("a"), "s").select("a", (F.col("s") - F.col("a")).alias("b"), "s")


def frequencies(df: DataFrame, context: list[Column], value: Column) -> DataFrame:
    """Facts from a table: in each context, each value with its share of the rows. value comes out as `value`."""
    counts = df.groupBy(*context, value.alias("value")).agg(F.count("*").alias("n"))
    names = [c for c in counts.columns if c not in ("value", "n")]
    whole = F.sum("n").over(Window.partitionBy(*names))  # over the counts, not the rows
    return counts.select(*names, "value", (F.col("n") / whole).alias("prob"))
