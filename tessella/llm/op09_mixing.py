"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only.

Slot i of the mix goes to the source whose part of [0, 1) holds frac((i + 1/2) * golden ratio); the parts are as long
as the sources' targets. Slots are ranked within their source. Each source's documents are shuffled by a hash and laid
end to end; that stream is cut in blocks of equally many words, and the slot of rank r takes block r modulo the number
of blocks, so a source that is taken twice runs through its stream twice. Where the schedule gives a source a few
slots more or less than its target needs, the surplus is left out and the shortage is appended, and the last slot is
cut short: each source is taken to the word.

Ranks and stream positions are sums in two levels (within a chunk, then over chunks), so that no source, however
large, is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_in, id_out, maybe_broadcast, stage, unused

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
BLOCK_WORDS = 2048
#: Slots that one window sorts, and documents of a source that one does, about: the number of shuffle buckets follows
#: from the documents of the largest source, so windows stay small as slots and documents grow.
SLOT_CHUNK = 1 << 14
BUCKET_ROWS = 4096
CELLS = 4096
GOLDEN = 0.6180339887498949


def words_in(text: Column) -> Column:
    """Number of [^ \\t\\n\\v\\f\\r]+ in a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Of a table (k: source or null, size): k, source_size, docs (rows with a size), weight, target.

    Weights go round by the sources' code-point order, null last. Targets share `share` of all sizes by weight, but
    stop at cap times the source's size; resharing the excess by weight until none is above ends where one level,
    times the weight, is the target of all that don't stop. In order of cap * size / weight the stopped sources come
    first, so prefix sums over the sources (a table of one row a source) give the level at once.
    """
    one = Window.orderBy(F.col("k").asc_nulls_last())
    per = sizes.groupBy("k").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("docs"))
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(one) - 1) % len(weights) + 1))
    per = per.withColumn("ratio", cap * F.col("source_size") / F.col("weight"))
    everything = Window.partitionBy()
    upto = Window.orderBy("ratio", F.col("k").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({"goal": share * F.sum("source_size").over(everything), "all_weight": F.sum("weight").over(everything), "size_before": F.coalesce(F.sum("source_size").over(upto), F.lit(0)), "weight_before": F.coalesce(F.sum("weight").over(upto), F.lit(0.0))})
    per = per.withColumn("level", (F.col("goal") - cap * F.col("size_before")) / (F.col("all_weight") - F.col("weight_before")))
    # the level of the first source that doesn't stop is the level of all the others
    per = per.withColumn("level", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(everything)["level"])
    return per.select("k", "source_size", "docs", "weight", F.least(cap * F.col("source_size").cast("double"), F.coalesce(F.col("level") * F.col("weight"), cap * F.col("source_size").cast("double"))).alias("target"))


def _offsets(rows: DataFrame, group: list[str], chunk: str, order: list, value: str, name: str) -> DataFrame:
    """Sum of value over the rows before each row, in order of chunk and order within group, by sums over chunks."""
    sums = rows.groupBy(*group, chunk).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*group, chunk, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy(*group, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inner = rows.withColumn("__here", F.sum(value).over(within))
    return inner.join(sums, [*group, chunk]).withColumn(name, F.col("__base") + F.col("__here") - F.col(value)).drop("__base", "__here")


def mix_plan(narrow: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Of a table (id, k, size): the sources (s, k, source_size, target, quota), and the mix as rows (id, s, k, size,
    slot, words): a document's words in a slot. Documents without words have no such rows."""
    spark = narrow.sparkSession
    src = source_targets(narrow.select("k", "size"))
    numbered = Window.orderBy(F.col("k").asc_nulls_last())
    cum = F.sum("target").over(numbered.rowsBetween(Window.unboundedPreceding, 0)) / F.greatest(F.sum("target").over(Window.partitionBy()), F.lit(1e-9))
    src = src.select((F.row_number().over(numbered) - 1).alias("s"), "k", "source_size", "docs", "target", cum.alias("hi"), F.round("target").cast("long").alias("quota"))
    src = src.withColumn("lo", F.coalesce(F.lag("hi").over(numbered), F.lit(0.0)))
    src = src.withColumn("hi", F.when(F.lead("hi").over(numbered).isNull(), F.lit(2.0)).otherwise(F.col("hi")))
    src = src.withColumn("blocks", F.expr(f"(source_size + {block_words - 1}) div {block_words}"))
    rest = "(quota - quota div source_size * source_size)"
    src = src.withColumn("need", F.when(F.col("source_size") > 0, F.expr(f"quota div source_size * blocks + ({rest} + {block_words - 1}) div {block_words}")).otherwise(0))
    src, _ = stage(src, "mix-sources")

    # slots: to a source by the golden ratio, then their rank in it
    n = int(src.agg(F.coalesce(F.sum("need"), F.lit(0))).first()[0])
    low, high = F.col("slot") % (1 << 20), F.shiftright("slot", 20)
    u = F.pmod(low * F.lit(GOLDEN) + high * F.lit((GOLDEN * (1 << 20)) % 1.0) + F.lit(GOLDEN / 2), F.lit(1.0))
    slots = spark.range(n).select(F.col("id").alias("slot")).withColumn("u", u).withColumn("cell", F.floor(F.col("u") * CELLS))
    cells = src.filter("target > 0").select("s", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    slots = slots.join(cells, "cell").filter("u >= lo AND u < hi").select("slot", "s", F.expr(f"slot div {SLOT_CHUNK}").alias("chunk"), F.lit(1).alias("one"))
    ranked = _offsets(slots, ["s"], "chunk", ["slot"], "one", "rank").select("s", "slot", "rank")
    given = ranked.groupBy("s").agg(F.count("*").alias("given"))
    tail = src.join(given, "s", "left").withColumn("given", F.coalesce("given", F.lit(0))).filter("need > given")
    tail = tail.select("s", F.explode(F.sequence(F.col("given"), F.col("need") - 1)).alias("rank")).select("s", (F.lit(n) + F.col("rank")).alias("slot"), "rank")
    ranked = ranked.unionByName(tail)
    blocks = ranked.join(src.select("s", "source_size", "quota", "blocks", "need"), "s").filter("rank < need")
    blocks = blocks.withColumns({"round": F.expr("rank div blocks"), "block": F.expr("rank % blocks")})
    blocks = blocks.select("s", "slot", "block", (F.col("block") * block_words).alias("from"), F.least((F.col("block") + 1) * block_words, "source_size", F.col("quota") - F.col("round") * F.col("source_size")).alias("to"))

    # each source's shuffled stream: a document covers the words [at, at + size)
    docs = narrow.withColumn("key", _key(F.col("k"))).join(src.select("s", _key(F.col("k")).alias("key")), "key").drop("key")
    hashed = F.xxhash64(F.lit(seed), F.col("id"))
    largest = src.agg(F.max("docs")).first()[0] or 0
    bits = max(1, -(-int(largest) // BUCKET_ROWS)).bit_length()
    docs = docs.filter("size > 0").withColumns({"h": hashed, "bucket": F.shiftrightunsigned(hashed, 64 - bits)})
    docs = _offsets(docs, ["s"], "bucket", ["h", "id", "size"], "size", "at").select("id", "s", "k", "size", "at")
    parts = docs.withColumn("block", F.explode(F.expr(f"sequence(at div {block_words}, (at + size - 1) div {block_words})")))
    words = F.least(F.col("at") + F.col("size"), F.col("to")) - F.greatest("at", "from")
    return src, parts.join(blocks, ["s", "block"]).withColumn("words", words).filter("words > 0").select("id", "s", "k", "size", "at", "slot", "words")


def _key(source: Column) -> Column:
    """A source's name as a join key that null has as well."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def _taken(df: DataFrame, key: str, text: str, source: str, block_words: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows (id, k, size), the sources, and what equal rows (id, key, size) are taken together: all_taken."""
    narrow, _ = stage(df.select(id_in(key).alias("id"), F.col(source).alias("k"), words_in(F.col(text)).alias("size")), "mix-sizes")
    src, mix = mix_plan(narrow, block_words)
    taken = mix.groupBy("id", _key(F.col("k")).alias("key"), "size").agg(F.sum("words").alias("all_taken"))
    return narrow, src, taken


def mix_sources(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of df: doc_id, size, source_size, target (its source's), taken (words that the mix takes).

    A null text has size 0, and size 0 is never taken; a null source is one source, last in order. A source without
    words has target 0. Null ids stay null. Rows that repeat an id lie side by side in the stream and are taken each
    for itself; rows equal in id, source and size share evenly what they are taken together. No rows give none. No
    document is taken beyond twice its size, as no target goes beyond twice its source's. The same input gives the
    same mix.
    """
    narrow, src, taken = _taken(df, key, text, source, block_words)
    rows = narrow.withColumn("key", _key(F.col("k")))
    same = Window.partitionBy("id", "key", "size")
    rows = rows.withColumns({"copy": F.row_number().over(same.orderBy(F.lit(1))) - 1, "copies": F.count("*").over(same)})
    out = rows.join(taken, ["id", "key", "size"], "left").join(src.select(_key(F.col("k")).alias("key"), "source_size", "target"), "key")
    share = F.expr("all_taken div copies + CAST(copy < all_taken % copies AS INT)")
    return out.select(id_out("id").alias("doc_id"), "size", "source_size", "target", F.coalesce(share, F.lit(0)).cast("long").alias("taken"))


def mixed_documents(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", block_words: int = BLOCK_WORDS) -> DataFrame:
    """df's rows as often as the mix takes them: taken words over size, rounded (none, one or two times). Documents
    without words, null texts too, are never taken; a null source is a source, a null id an id. Rows equal in id, source
    and size are taken equally often. Columns are df's, whatever their names. No rows give none."""
    narrow, _, taken = _taken(df, key, text, source, block_words)
    many = narrow.groupBy("id", _key(F.col("k")).alias("key"), "size").agg(F.count("*").alias("copies"))
    times = taken.join(many, ["id", "key", "size"]).withColumn("times", F.floor(F.col("all_taken") / (F.col("copies") * F.col("size")) + 0.5).cast("int")).filter("times > 0")
    at, of, words, again, copy = unused(df, "__id", "__key", "__size", "__times", "__copy")
    times, _ = stage(times.select(F.col("id").alias(at), F.col("key").alias(of), F.col("size").alias(words), F.col("times").alias(again)), "mix-times")
    rows = df.withColumns({at: id_in(key), of: _key(F.col(source)), words: words_in(F.col(text))})
    rows = rows.join(maybe_broadcast(times, 64), [at, of, words])
    return rows.withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.col(again)))).select(*[F.col(f"`{c}`") for c in df.columns])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents, by weights 3, 1, 2 in turn, of 150% of all words."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))


QUERIES = {"op9_mixing": op9_mixing}
