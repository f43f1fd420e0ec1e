"""Reading and writing: parameters, checkpoints, exports."""

from __future__ import annotations

import tempfile
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARAMETERS = "name string, shape array<int>, values array<double>"


def scratch(spark: SparkSession, label: str) -> str:
    """A new path that driver and executors share: under spark.checkpoint.dir, or on a local master in a folder of its
    own where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="tessella-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def parameters(spark: SparkSession, path: str, without: list[str] = ()) -> DataFrame:
    """Saved parameters, less those of some names."""
    return drop_named(spark.read.schema(PARAMETERS).parquet(path), list(without))


def drop_named(params: DataFrame, names: list[str]) -> DataFrame:
    return params.filter(~F.col("name").isin(names)) if names else params


def save_parameters(spark: SparkSession, arrays: dict, path: str, mode: str = "overwrite") -> None:
    """Name, shape and values of numpy arrays."""
    rows = [(k, list(v.shape), [float(x) for x in v.ravel()]) for k, v in arrays.items()]
    spark.createDataFrame(rows, PARAMETERS).coalesce(1).write.mode(mode).parquet(path)


def load_arrays(params: DataFrame) -> dict:
    """A model's parameters as numpy arrays; a model is small by nature and belongs on the driver."""
    import numpy as np

    return {r["name"]: np.array(r["values"]).reshape(r["shape"]) for r in params.collect()}


def save_epoch(spark: SparkSession, folder: str, epoch: int, models: dict[str, dict]) -> None:
    """All models of an epoch (the task's, the constraints' and their optimizers') under folder/epoch=N; says so if it
    overwrites."""
    path = f"{folder}/epoch={epoch}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        warnings.warn(f"{path} is overwritten", stacklevel=2)
    for name, arrays in models.items():
        save_parameters(spark, arrays, f"{path}/{name}")


def epochs(spark: SparkSession, folder: str, models: list[str]) -> DataFrame:
    """epoch, model, name, shape, values of all saved epochs of the named models."""
    out = None
    for model in models:
        # the epoch stands in the path, as save_epoch writes it
        one = spark.read.schema(PARAMETERS).parquet(f"{folder}/epoch=*/{model}").withColumn("epoch", F.regexp_extract(F.input_file_name(), r"epoch=(\d+)", 1).cast("int"))
        one = one.select("epoch", F.lit(model).alias("model"), "name", "shape", "values")
        out = one if out is None else out.unionByName(one)
    return out


def best_epoch(log: DataFrame, epoch: str = "epoch", loss: str = "loss") -> DataFrame:
    """The epoch with the least loss (the first of equal ones)."""
    return log.agg(F.min(F.struct(loss, epoch)).alias("b")).select(F.col(f"b.{epoch}").alias(epoch), F.col(f"b.{loss}").alias(loss))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string")).write.mode("overwrite").text(path)
