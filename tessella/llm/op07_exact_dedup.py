"""Exact dedup by counting quotient filters.

Each partition puts the 64-bit fingerprints of its texts in a counting quotient filter: the upper bits (quotient)
name a slot run, the lower bits (remainder) are kept in order within the run, and each has a counter. A filter is cut
in segments by quotient, so segments of all partitions meet by an exchange of segments, not of texts, and merge
losslessly like sorted lists, adding counters. Fingerprints counted more than once send their texts to verification,
which groups the bytes themselves. Copies collapse within each partition before either exchange, so a group that holds
a third of all rows brings one counter, and one text, a partition.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, id_in, id_out, maybe_broadcast, partitions, stage, tuned

SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
#: Fingerprints that a merged segment holds on average, at most.
SEGMENT_ROWS = 1 << 20
FINGERPRINT_BITS = 64


class CountingQuotientFilter:
    """Fingerprints with counts, for those quotients that start with a segment's bits.

    Kept as the rank-and-select form: `occupied` has a bit for each quotient, `runend` a bit for each entry (set on a
    run's last), `remainder` and `count` a value for each entry, ordered by quotient and remainder.
    """

    def __init__(self, quotient_bits: int, prints: np.ndarray, counts: np.ndarray | None = None):
        self.q, self.r = quotient_bits, FINGERPRINT_BITS - quotient_bits
        prints = np.asarray(prints, np.uint64)
        if counts is None:
            prints, counts = np.unique(prints, return_counts=True)
        quotient = (prints >> np.uint64(self.r)).astype(np.int64) if self.q else np.zeros(len(prints), np.int64)
        self.first = int(quotient[0]) if len(quotient) else 0
        self.span = int(quotient[-1]) - self.first + 1 if len(quotient) else 0
        occupied = np.zeros(self.span, bool)
        occupied[quotient - self.first] = True
        runend = np.ones(len(prints), bool)
        runend[:-1] = quotient[1:] != quotient[:-1]
        self.occupied, self.runend = np.packbits(occupied), np.packbits(runend)
        self.remainder = prints & np.uint64((1 << self.r) - 1) if self.q else prints
        self.count = np.asarray(counts, np.int64)

    def prints(self) -> np.ndarray:
        """All fingerprints in order, rebuilt from quotients and remainders."""
        n = len(self.remainder)
        ends = np.unpackbits(self.runend, count=n).astype(bool)
        run = np.zeros(n, np.int64)
        run[1:] = np.cumsum(ends)[:-1]
        quotients = np.flatnonzero(np.unpackbits(self.occupied, count=self.span)) + self.first
        return (quotients[run].astype(np.uint64) << np.uint64(self.r)) | self.remainder if self.q else self.remainder

    def dump(self) -> bytes:
        wide = self.remainder.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, : -(-self.r // 8)]
        small = np.minimum(self.count, 255).astype(np.uint8)
        head = np.array([self.q, self.first, self.span, len(self.remainder)], np.int64)
        return b"".join(x.tobytes() for x in (head, self.occupied, self.runend, np.ascontiguousarray(wide), small, self.count[self.count >= 255]))

    @classmethod
    def load(cls, data: bytes) -> CountingQuotientFilter:
        q, first, span, n = np.frombuffer(data, np.int64, 4).tolist()
        at, width, self = 32, -(-(FINGERPRINT_BITS - q) // 8), cls.__new__(cls)
        take = lambda size: np.frombuffer(data, np.uint8, size, at)
        self.q, self.r, self.first, self.span = q, FINGERPRINT_BITS - q, first, span
        self.occupied = take(size := -(-span // 8))
        at += size
        self.runend = take(size := -(-n // 8))
        at += size
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = take(n * width).reshape(n, width)
        at += n * width
        self.remainder = wide.view(np.uint64).ravel()
        self.count = take(n).astype(np.int64)
        at += n
        self.count[self.count == 255] = np.frombuffer(data, np.int64, -1, at)
        return self

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """Sorted lists of (quotient, remainder) merge; counters of equal entries add up."""
        prints = np.concatenate([f.prints() for f in filters])
        counts = np.concatenate([f.count for f in filters])
        order = np.argsort(prints, kind="stable")
        prints, counts = prints[order], counts[order]
        new = np.flatnonzero(np.r_[True, prints[1:] != prints[:-1]]) if len(prints) else np.zeros(0, np.int64)
        return cls(filters[0].q, prints[new], np.add.reduceat(counts, new) if len(new) else counts)


def repeated_fingerprints(prints: DataFrame) -> DataFrame:
    """Of a table fp long: each fp that counts more than once, with that count n."""
    spark = prints.sparkSession
    bits = max(4, int(np.ceil(np.log2(max(1, prints.count() / SEGMENT_ROWS)))), int(np.ceil(np.log2(partitions(spark)))))
    quotient = bits + 16

    def build(batches):
        held = [b.column(0).to_numpy().view(np.uint64) for b in batches if b.num_rows]
        if held:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            segment = (values >> np.uint64(64 - bits)).astype(np.int64)
            cut = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1], True])
            for a in range(0, len(cut) - 1, 256):
                own = range(a, min(a + 256, len(cut) - 1))
                yield pa.record_batch([pa.array([int(segment[cut[k]]) for k in own], pa.int32()), pa.array([CountingQuotientFilter(quotient, values[cut[k] : cut[k + 1]], counts[cut[k] : cut[k + 1]]).dump() for k in own], pa.binary())], names=["segment", "filter"])

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        f = CountingQuotientFilter.merge([CountingQuotientFilter.load(x) for x in pdf["filter"]])
        many = f.count > 1
        return pd.DataFrame({"fp": f.prints()[many].view(np.int64), "n": f.count[many]})

    return prints.select("fp").mapInArrow(build, "segment int, filter binary").groupBy("segment").applyInPandas(merged, "fp long, n long")


def without_spaces(text):
    out = F.coalesce(text, F.lit(""))
    for s in SPACES:
        out = F.replace(out, F.lit(s), F.lit(""))
    return out


def exact_dedup(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: doc_id, keep_id, group_size, kept, text_sha256 (of the text without white space).

    Texts are equal when identical without white space; the row with the most code points in its original text, then
    the smallest id stays. Null texts count as empty; an empty text is equal to other empty ones. Null ids come
    before all others, and are null in the result. Rows that repeat an id count each; if such a row stays, all rows
    of that id in the group say kept. No rows give none; other columns are not read.
    """
    spark = tuned(df.sparkSession)
    base = df.select(id_in(key).alias("id"), F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("points"), without_spaces(F.col(text)).alias("norm")).withColumn("fp", F.xxhash64("norm"))
    narrow, _ = stage(base.select("id", "points", "fp", F.unhex(F.sha2("norm", 256)).alias("sha")), "exact-prints")
    many, path = stage(repeated_fingerprints(narrow).select("fp"), "exact-many")
    routed = base.join(maybe_broadcast(many, 16), "fp", "left_semi")
    # the bytes decide: the text itself is a grouping key, and copies collapse before the exchange
    best = F.max(F.struct("points", F.bitwise_not("id").alias("minus")))  # the order of ids turned round
    groups = routed.groupBy("fp", "norm").agg(best.alias("best"), F.count("*").alias("group_size"))
    groups = groups.select("fp", F.unhex(F.sha2("norm", 256)).alias("sha"), F.bitwise_not("best.minus").alias("keep"), "group_size").filter("group_size > 1")
    groups, _ = stage(groups, "exact-groups")
    drop(spark, path)
    found = narrow.join(maybe_broadcast(groups, 72), ["fp", "sha"], "left")
    keep = F.coalesce("keep", "id")
    return found.select(id_out("id").alias("doc_id"), id_out(keep).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), (keep == F.col("id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup of all documents."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op7_exact_dedup": op7_exact_dedup}

SQL = {
    "op7_exact_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
r AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, keep_id = doc_id AS kept, sha256(norm) AS text_sha256 FROM r
"""
}
