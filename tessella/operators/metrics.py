"""Quality of predictions: accuracy, confusion, per-class reports, averages, rates before and after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accuracy(df: DataFrame, pred: str = "pred", label: str = "label") -> DataFrame:
    return df.agg(F.avg((F.col(pred) == F.col(label)).cast("double")).alias("accuracy"))


def confusion(df: DataFrame, pred: str = "pred", label: str = "label") -> DataFrame:
    """label, pred, n for the pairs that occur."""
    return df.groupBy(F.col(label).alias("label"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, classes: int, pred: str = "pred", label: str = "label") -> DataFrame:
    """A row a label, a column a prediction; zeros where nothing occurs."""
    return df.groupBy(F.col(label).alias("label")).pivot(pred, list(range(classes))).count().fillna(0)


def report(df: DataFrame, pred: str = "pred", label: str = "label") -> DataFrame:
    """class, precision, recall, f1, support for all classes that are predicted or true; undefined ones are 0.

    Each row counts for its label and for its prediction, so one grouping by class, with partial sums, is all.
    """
    p, y = F.col(pred), F.col(label)
    both = F.array(F.struct(y.alias("class"), F.lit(1).alias("t"), F.lit(0).alias("g"), (p == y).cast("int").alias("h")), F.struct(p.alias("class"), F.lit(0).alias("t"), F.lit(1).alias("g"), F.lit(0).alias("h")))
    counts = df.select(F.explode(both).alias("r")).groupBy("r.class").agg(F.sum("r.t").alias("support"), F.sum("r.g").alias("given"), F.sum("r.h").alias("hit"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = counts.select("class", share(F.col("hit"), F.col("given")).alias("precision"), share(F.col("hit"), F.col("support")).alias("recall"), "support")
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return out.withColumn("f1", f1).select("class", "precision", "recall", "f1", "support")


def averages(rep: DataFrame) -> DataFrame:
    """average (macro, weighted), precision, recall, f1."""
    names = ("precision", "recall", "f1")
    macro = [F.avg(c).alias(f"macro_{c}") for c in names]
    weighted = [(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"weighted_{c}") for c in names]
    one = rep.agg(*macro, *weighted)
    rows = F.array(*[F.struct(F.lit(a).alias("average"), *[F.col(f"{a}_{c}").alias(c) for c in names]) for a in ("macro", "weighted")])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def rates(df: DataFrame, correct: Column, satisfied: Column, keys: list[str]) -> DataFrame:
    """keys, incorrect, unsatisfied: shares of the examples."""
    share = lambda c: F.avg((~c).cast("double"))
    return df.groupBy(*keys).agg(share(correct).alias("incorrect"), share(satisfied).alias("unsatisfied"))


def fact_accuracy(df: DataFrame, prob: str = "prob") -> DataFrame:
    """One minus the mean distance of the queries' probabilities from 1."""
    return df.agg((1 - F.avg(F.abs(1 - F.col(prob)))).alias("fact_accuracy"))


def delta_norm(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Length of the difference of two sets of parameters that stand side by side."""
    return pairs.agg(F.sqrt(F.sum(F.pow(F.col(a) - F.col(b), 2))).alias("norm"))


def accuracy_of(predictions: DataFrame) -> float:
    """A tracker: the share of right predictions (label, pred)."""
    return float(accuracy(predictions).first()[0] or 0.0)


def macro_f1_of(predictions: DataFrame) -> float:
    """A tracker: the mean of the classes' F1."""
    return float(report(predictions).agg(F.avg("f1")).first()[0] or 0.0)


def confusion_of(predictions: DataFrame) -> dict[tuple[int, int], int]:
    """A tracker: counts by label and prediction."""
    return {(r["label"], r["pred"]): r["n"] for r in confusion(predictions).collect()}
