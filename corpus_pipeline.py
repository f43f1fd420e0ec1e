"""The corpus pipeline: five stages from raw documents to shards.

Each stage takes all that its predecessor kept and returns the columns of documents (the last one adds shard and
slot). Between stages the documents are a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm.common import stage
from tessella.llm.op01_sharding import histogram_shards
from tessella.llm.op02_jaccard_join import keep_one
from tessella.llm.op04_decontamination import without_contaminated
from tessella.llm.op08_language_id import identified
from tessella.llm.op09_mixing import mixed_documents

SHARDS = 8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: those without letters (null and empty texts too), or of no clear language,
    go. Repeated rows stay or go together; other columns pass; no rows give none."""
    return identified(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group of near copies; of rows that repeat that id, one. A null id is
    less than others. Texts without words stay; other columns pass; no rows give none."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts, and all if the benchmark is empty, stay; rows that
    repeat an id are judged each by its own text; other columns pass; no rows give none."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all, once or twice. A null source is a source; texts
    without words aren't taken; rows equal in id, source and size are taken equally often; no rows give none."""
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with shard and slot; shards have nearly equal bytes. A null text counts one byte, a null id comes first,
    equal rows have slots of their own; columns named shard and slot are replaced; no rows give none."""
    return histogram_shards(docs, SHARDS)


STAGES = [("language ID", language_id), ("n-gram Jaccard join", jaccard_join), ("benchmark decontamination", decontamination), ("mixing sources to target weights", mixing), ("sharding", sharding)]

#: SQL can't express the language model, nor the hashes that the mix and the shards go by.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in STAGES[:-1]:
        docs, _ = stage(f(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
