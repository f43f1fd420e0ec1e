"""Sharding by histogram sort.

Rows get a 128-bit key (hash of the text, id): equal texts are neighbours in its order. The driver probes key
boundaries; every partition counts the exact bytes and rows below each probe, and only these sums (a few numbers a
probe) come back. Each round splits the interval around a splitter that is not yet within tolerance. Then the rows
are exchanged once, by key range. A range's first slot is the counted rows below its splitter, so numbering needs no
further pass. A shard consists of as many ranges as keep a task's share bounded.

Boundaries lie between texts where that meets the tolerance; only a group of equal texts too large for that is cut,
at an id, so that no group can overfill a shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop, id_in, stage, tuned, unused

LAW = "bytes"
BIAS = 1 << 63
TOP = 1 << 128
RANGE_BYTES = 32 << 20
RANGE_ROWS = 20_000


def _split(keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit keys as the two signed halves that the rows carry."""
    return np.array([(k >> 64) - BIAS for k in keys], np.int64), np.array([(k & (2**64 - 1)) - BIAS for k in keys], np.int64)


def _bucket(h: np.ndarray, i: np.ndarray, ph: np.ndarray, pi: np.ndarray) -> np.ndarray:
    """How many probes are at or below each key."""
    left, right = np.searchsorted(ph, h, "left"), np.searchsorted(ph, h, "right")
    out = left.copy()
    for a, b in {(a, b) for a, b in zip(left[tie].tolist(), right[tie].tolist(), strict=True)} if (tie := left < right).any() else ():
        own = (left == a) & (right == b)
        out[own] = a + np.searchsorted(pi[a:b], i[own], "right")
    return out


def _histogram(narrow: DataFrame, keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows below each of the sorted keys."""
    ph, pi = _split(keys)

    def count(batches):
        size, rows = np.zeros(len(ph) + 1, np.int64), np.zeros(len(ph) + 1, np.int64)
        for b in batches:
            at = _bucket(b.column("h").to_numpy(), b.column("i").to_numpy(), ph, pi)
            np.add.at(size, at, b.column("size").to_numpy())
            rows += np.bincount(at, minlength=len(rows))
        has = np.flatnonzero(rows)
        yield pa.record_batch([pa.array(has.astype(np.int32)), pa.array(size[has]), pa.array(rows[has])], names=["b", "bytes", "rows"])

    got = narrow.select("h", "i", "size").mapInArrow(count, "b int, bytes long, rows long").groupBy("b").agg(F.sum("bytes"), F.sum("rows")).collect()
    size, rows = np.zeros(len(keys) + 1, np.int64), np.zeros(len(keys) + 1, np.int64)
    for b, x, y in got:
        size[b], rows[b] = x, y
    return np.cumsum(size)[:-1], np.cumsum(rows)[:-1]


def splitters(narrow: DataFrame, ranges: int, tolerance: float, probes: int = 48) -> tuple[list[int], list[int]]:
    """Keys that cut the rows in ranges of nearly equal bytes, and the exact rows below each.

    A splitter is settled when the bytes below it are within tolerance (a part of a range's share) of its target, or
    when no key lies between its bounds; then the nearer bound is taken.
    """
    total, n, least, most = narrow.agg(F.sum("size"), F.count("*"), F.min("i"), F.max("i")).first()
    total, n, least, most = int(total or 0), int(n), int(least or 0) + BIAS, int(most or 0) + BIAS
    goals = [total * j // ranges for j in range(1, ranges)]
    slack = tolerance * total / ranges
    low = [(0, 0, 0)] * len(goals)  # key, bytes below, rows below
    high = [(TOP - 1, total, n)] * len(goals)
    done: dict[int, tuple[int, int, int]] = {}
    while len(done) < len(goals):
        for j, goal in enumerate(goals):
            if j not in done:
                near = min(low[j], high[j], key=lambda x: abs(x[1] - goal))
                if abs(near[1] - goal) <= slack or high[j][2] - low[j][2] <= 1 or high[j][0] - low[j][0] <= 1:
                    done[j] = near
        keys = set()
        for j in range(len(goals)):
            if j not in done:
                a, b = low[j][0], high[j][0]
                cut = {a + (b - a) * k // (probes + 1) for k in range(1, probes + 1)}
                # between texts first, and within one text, by id, only if no key between texts is left
                between = {k >> 64 << 64 for k in cut} | {((a >> 64) + 1) << 64, b >> 64 << 64}
                if not (between := {k for k in between if a < k < b}):
                    text = a >> 64 << 64
                    x, y = max(a, text + least), min(b, text + most + 1)
                    between = {x + (y - x) * k // (probes + 1) for k in range(probes + 2)}
                keys |= {k for k in between if a < k < b}
        if not keys:
            for j in range(len(goals)):
                done.setdefault(j, min(low[j], high[j], key=lambda x: abs(x[1] - goals[j])))
            break
        order = sorted(keys)
        below, rows = _histogram(narrow, order)
        for j, goal in enumerate(goals):
            if j not in done:
                for k, x, r in zip(order, below.tolist(), rows.tolist(), strict=True):
                    if low[j][0] < k < high[j][0]:
                        if x <= goal:
                            low[j] = (k, x, r)
                        else:
                            high[j] = (k, x, r)
                            break
    picked = [done[j] for j in range(len(goals))]
    return [p[0] for p in picked], [p[2] for p in picked]


def keyed(df: DataFrame, names: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with, under the three names, the two halves of the sort key and the size (UTF-8 bytes plus 1; null text: 1)."""
    h, i, size = names
    return df.withColumns({h: F.xxhash64(F.col(text)), i: id_in(key), size: F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1})


def histogram_shards(df: DataFrame, n_shards: int = 8, key: str = "doc_id", text: str = "text", tolerance: float = 0.004, narrow: DataFrame | None = None, halves: tuple[str, str] | None = None) -> DataFrame:
    """df with shard (0 to n_shards - 1) and slot (gapless from 0 in each shard, in key order); sizes near equal.

    Defined cases: a null text has size 1 and forms one group with the other nulls; an empty text forms another. A
    null id sorts first. Rows equal in text and id share a key and may take either of their slots. An empty table
    gives no rows. Other columns pass unchanged, whatever their names; columns named shard or slot are replaced.
    narrow: df's keys and sizes (h, i, size), if already written somewhere; else they are written once here.
    halves: df's columns that hold the sort key already, if any.
    """
    spark = tuned(df.sparkSession)
    path = None
    if narrow is None:
        narrow, path = stage(keyed(df.select(key, text), ["h", "i", "size"], key, text).select("h", "i", "size"), "shard-keys")
    total, n = narrow.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    per = max(1, -(-int(total) // (n_shards * RANGE_BYTES)), -(-int(n) // (n_shards * RANGE_ROWS)))
    keys, below = splitters(narrow, n_shards * per, tolerance / per if per > 1 else tolerance)
    if path:
        drop(spark, path)
    ph, pi = _split(keys)
    base = np.array([0, *below], np.int64)
    first = np.repeat(base[::per], per)

    @F.pandas_udf("at int, base long")
    def place(h: pd.Series, i: pd.Series) -> pd.DataFrame:
        at = _bucket(h.to_numpy(), i.to_numpy(), ph, pi)
        return pd.DataFrame({"at": at.astype(np.int32), "base": base[at] - first[at]})

    h, i, size, found, at, before = unused(df, "__h", "__i", "__size", "__place", "__at", "__base")
    rows = df if halves else keyed(df, [h, i, size], key, text)
    h, i = halves or (h, i)
    rows = rows.withColumn(found, place(h, i))
    rows = rows.withColumns({at: F.col(found)["at"], before: F.col(found)["base"]}).withColumn("shard", F.floor(F.col(at) / per).cast("int"))
    slot = F.col(before) + F.row_number().over(Window.partitionBy(at).orderBy(h, i)) - 1
    kept = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    return rows.withColumn("slot", slot.cast("long")).select(*[F.col(f"`{c}`") for c in kept], "shard", "slot")


def op1_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 by the law `bytes`."""
    tuned(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = keyed(docs, ["h", "i", "size"]).select("doc_id", "h", "i", "size", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    rows, _ = stage(rows, "op1")
    out = histogram_shards(rows, 8, narrow=rows.select("h", "i", "size"), halves=("h", "i"))
    return out.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op1_histogram_sort": op1_histogram_sort}
