"""Benchmark decontamination by q-gram lemma filtering.

A benchmark item of m bytes that stands in a text with at most e edits shares at least m + 1 - q * (e + 1) of its
q-grams with it, all on e + 1 neighbouring diagonals (place in the text less place in the item). Texts are looked
through for the items' q-grams; hits are counted in diagonal bands of more than e diagonals that overlap by e, so one
band holds all diagonals of a match. Bands with enough hits are verified by an alignment that stays within the band.

Both sides are compared in lower case (A to Z) with each run of white space as one space. The benchmark is the query
set: it goes to all tasks in blocks of bounded size, and every block is held against all documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, id_in, id_out, int64, maybe_broadcast, stage, tuned, unused, utf8

Q = 8
#: Edits allowed, as a part of an item's length.
EDITS = 0.1
BLOCK_BYTES = 2 << 20
#: Bytes of a text that are looked through in one step; a longer one goes in pieces that overlap by an item's length.
PIECE_BYTES = 4 << 20
TABLE_BITS = 20
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[_SPACES] = 0x20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def folded(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in lower case with single spaces between words, a zero byte before each text and one at the end; where
    each text begins there; and the place in raw that each byte comes from."""
    space = _SPACES[raw]
    keep = ~space
    # a space stays if a word is before it: of a run, the first; at a text's start, none
    keep[1:] |= space[1:] & ~space[:-1]
    inner = off[:-1][off[:-1] < len(raw)]
    keep[inner] = ~space[inner]
    # none at a text's end either
    index = np.flatnonzero(keep)
    cut = np.searchsorted(index, off)
    last = cut[1:] - 1
    last = last[cut[1:] > cut[:-1]]
    tail = last[space[index[last]]]
    if len(tail):
        index = np.delete(index, tail)
        cut = np.searchsorted(index, off)
    n = len(off) - 1
    out = np.zeros(len(index) + n + 1, np.uint8)
    where = np.arange(len(index)) + np.repeat(np.arange(1, n + 1), np.diff(cut))
    out[where] = _FOLD[raw[index]]
    origin = np.zeros(len(out), np.int64)
    origin[where] = index
    return out, cut + np.arange(n + 1) + 1, origin


def budget(m: int, q: int = Q, edits: float = EDITS) -> int:
    """Edits allowed to an item of m bytes: its share, but few enough for the lemma to ask for a q-gram at least."""
    return max(0, min(int(m * edits), m // q - 1))


@dataclass
class Items:
    """A block of benchmark items, ready to be looked for."""

    ids: np.ndarray
    texts: list[bytes]
    q: int = Q
    edits: float = EDITS

    def __post_init__(self):
        size = np.array([len(t) for t in self.texts], np.int64)
        self.size = size
        self.budget = np.array([budget(int(m), self.q, self.edits) for m in size], np.int64)
        self.need = np.maximum(1, size + 1 - self.q * (self.budget + 1))
        self.band_bits = max(3, int(self.budget.max(initial=0)).bit_length())
        codes, item, place = [], [], []
        for i, t in enumerate(self.texts):
            if len(t) >= self.q:
                w = windows8(np.frombuffer(t, np.uint8))
                codes.append(w)
                item.append(np.full(len(w), i))
                place.append(np.arange(len(w)))
        code = np.concatenate([np.zeros(0, np.uint64), *codes])
        order = np.argsort(code, kind="stable")
        self.item = np.concatenate([np.zeros(0, np.int64), *item])[order]
        self.place = np.concatenate([np.zeros(0, np.int64), *place])[order]
        self.code, self.start, self.many = np.unique(code[order], return_index=True, return_counts=True)
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self.slot(self.code)] = True
        # too short for a q-gram: by length, their bytes as numbers
        self.short = {m: np.array(sorted((int.from_bytes(t, "little"), i) for i, t in enumerate(self.texts) if len(t) == m), np.uint64).reshape(-1, 2) for m in range(1, self.q)}

    @staticmethod
    def slot(code: np.ndarray) -> np.ndarray:
        return ((code * _MULTIPLIER) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def windows8(data: np.ndarray) -> np.ndarray:
    """Each 8 consecutive bytes as a number."""
    return np.ndarray(max(0, len(data) - 7), "<u8", np.ascontiguousarray(data), strides=(1,)).astype(np.uint64)


def banded(item: np.ndarray, text: np.ndarray, most: int, width: int) -> tuple[int, int]:
    """Least edits that turn item into a part of text that starts at one of its first width places, and that part's
    end; edits above most may be reported as any number above it. Cells stay within the diagonals 0 - most to width +
    most."""
    band = width + 2 * most
    far = most + 1
    padded = np.zeros(len(item) + band + most + 2, np.int16) - 1
    padded[most : most + min(len(text), len(padded) - most)] = text[: len(padded) - most]
    k = np.arange(band, dtype=np.int32)
    # cell k of row j ends at text place j + k - most
    row = np.where((k >= most) & (k < most + width), 0, far).astype(np.int32)
    row = np.minimum.accumulate(row - k) + k
    row = np.where(k < most, far, row)
    for j in range(len(item)):
        step = row + (padded[j : j + band] != item[j])
        step[:-1] = np.minimum(step[:-1], row[1:] + 1)
        row = np.minimum.accumulate(step - k) + k
        if row.min() > most:
            return far, 0
    ends = len(item) + k - most
    row = np.where((ends < 0) | (ends > len(text)), far, row)
    best = int(row.argmin())
    return int(row[best]), int(ends[best])


def _align(item: bytes, text: bytes, most: int, width: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best part of text within most edits of item, its start below width."""
    at = text.find(item, 0, width + len(item) - 1)
    if at >= 0:
        return 0, at, at + len(item)
    a, t = np.frombuffer(item, np.uint8).astype(np.int16), np.frombuffer(text, np.uint8).astype(np.int16)
    got, end = banded(a, t, most, width)
    if got > most:
        return None
    # the same from the end gives the start
    _, length = banded(a[::-1], t[:end][::-1], most, 1)
    return got, end - length, end


def matches(items: Items, raw: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(text, item, edits, lo, hi) for each item that a text holds: the part with the fewest edits, the first of them,
    in bytes of the text."""
    data, begin, origin = folded(raw, off)
    code = windows8(data)
    hit = np.flatnonzero(items.table[Items.slot(code)]) if len(items.code) else np.zeros(0, np.int64)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    if len(hit):
        at = np.minimum(np.searchsorted(items.code, code[hit]), len(items.code) - 1)
        exact = items.code[at] == code[hit]
        hit, at = hit[exact], at[exact]
    if len(hit):
        many = items.many[at]
        index = np.arange(int(many.sum())) + np.repeat(items.start[at] - (np.cumsum(many) - many), many)
        place = np.repeat(hit, many)
        item = items.item[index]
        diagonal = place - items.place[index] + int(items.size.max())
        doc = np.searchsorted(begin, place, "right") - 1
        z = items.band_bits
        band = diagonal >> z
        # a band reaches e diagonals into the next one
        over = (diagonal & ((1 << z) - 1)) < items.budget[item]
        item, doc, band = (np.concatenate([x, y]) for x, y in ((item, item[over]), (doc, doc[over]), (band, band[over] - 1)))
        bands = int(band.max()) + 2
        key, count = np.unique((doc * len(items.texts) + item) * bands + band + 1, return_counts=True)
        band = key % bands - 1
        key //= bands
        item, doc = key % len(items.texts), key // len(items.texts)
        enough = np.flatnonzero(count >= items.need[item])
        for i, d, b in zip(item[enough].tolist(), doc[enough].tolist(), band[enough].tolist(), strict=True):
            e = int(items.budget[i])
            first = (b << z) - int(items.size.max())
            lo = max(int(begin[d]), first)
            width = first + (1 << z) + e - lo
            end = int(begin[d + 1]) - 1
            if width <= 0 or lo >= end:
                continue
            found = _align(items.texts[i], data[lo : min(end, lo + width + len(items.texts[i]) + e)].tobytes(), e, width)
            if found:
                edits, a, zz = found
                new = (edits, lo + a, lo + zz)
                if new < best.get((d, i), (1 << 60, 0, 0)):
                    best[d, i] = new
    out = [(d, i, e, int(origin[a] - off[d]), int(origin[z - 1] + 1 - off[d])) for (d, i), (e, a, z) in best.items()]
    out += short_matches(items, data, begin, code, origin, off)
    return sorted(out)


def pieces(raw: np.ndarray, item: int, limit: int = PIECE_BYTES) -> list[tuple[int, int]]:
    """Bounds of pieces of a long text, each reaching on over so many bytes without white space that a match of an item
    of that many bytes lies within one piece. Pieces begin and end at white space; a text without any stays whole."""
    space = np.flatnonzero(_SPACES[raw])
    solid = space - np.arange(len(space))  # bytes without white space before each white space
    out, a = [], 0
    while len(raw) - a > limit:
        k = int(np.searchsorted(space, a + limit))
        if k >= len(space):
            break
        end = int(np.searchsorted(solid, solid[k] + item + 1))
        out.append((a, int(space[end]) if end < len(space) else len(raw)))
        a = int(space[k])
    return [*out, (a, len(raw))]


def matches_in(items: Items, raw: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """As matches; a single text that is very long goes piece by piece."""
    if len(off) != 2 or len(raw) <= 2 * PIECE_BYTES:
        return matches(items, raw, off)
    best: dict[int, tuple[int, int, int]] = {}
    longest = int((items.size + items.budget).max(initial=0))
    for a, z in pieces(raw, longest):
        for _, i, e, lo, hi in matches(items, raw[a:z], np.array([0, z - a])):
            best[i] = min(best.get(i, (1 << 60, 0, 0)), (e, lo + a, hi + a))
    return sorted((0, i, *x) for i, x in best.items())


def short_matches(items: Items, data: np.ndarray, begin: np.ndarray, code: np.ndarray, origin: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """As matches, of items of less than q bytes: where a text has them as whole words, without edits."""
    out: list[tuple[int, int, int, int, int]] = []
    if not any(len(x) for x in items.short.values()):
        return out
    edge = (data == 0) | (data == 0x20)
    first = np.flatnonzero(edge[:-1] & ~edge[1:]) + 1
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    for m, known in items.short.items():
        if not len(known):
            continue
        at = first[first + m < len(data)]
        at = at[edge[at + m]]
        here = windows8(padded)[at] & np.uint64((1 << (8 * m)) - 1)
        lo, hi = np.searchsorted(known[:, 0], here, "left"), np.searchsorted(known[:, 0], here, "right")
        seen = set()
        for k in np.flatnonzero(lo < hi).tolist():
            a = int(at[k])
            d = int(np.searchsorted(begin, a, "right")) - 1
            for i in known[lo[k] : hi[k], 1].tolist():
                if (d, i) not in seen:
                    seen.add((d, i))
                    out.append((d, int(i), 0, int(origin[a] - off[d]), int(origin[a + m - 1] + 1 - off[d])))
    return out


def _fold_texts(texts: list[str | None]) -> list[bytes]:
    raw, off = utf8(pa.array([t or "" for t in texts], pa.string()))
    data, begin, _ = folded(raw, off)
    return [data[a : z - 1].tobytes() for a, z in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]


def contaminated(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", edits: float = EDITS) -> DataFrame:
    """One row for each document and item that it holds: doc_id, item_id, edits, start_byte, end_byte.

    An item may differ by a tenth of its length in edits (never so many that the lemma asks for no q-gram). Items of
    less than 8 bytes, folded, have no q-gram: they match where a text has them, exactly, as whole words. Null or blank
    items and texts match nothing. Null ids are ids like others. Rows that repeat an id are each reported. No documents
    or no items give no rows.
    """
    out = _found(df, benchmark, key, text, item_key, item_text, edits)
    return out.select(id_out("id").alias("doc_id"), id_out("item").alias("item_id"), "edits", "start_byte", "end_byte")


def _found(df: DataFrame, benchmark: DataFrame, key: str, text: str, item_key: str, item_text: str, edits: float) -> DataFrame:
    """As contaminated, by id and a hash of the text: id, hash, item, edits, start_byte, end_byte."""
    spark = tuned(df.sparkSession)
    docs = df.select(id_in(key).alias("id"), F.xxhash64(F.col(text)).alias("hash"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    asked = benchmark.select(id_in(item_key).alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    total = asked.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    schema = "id long, hash long, item long, edits int, start_byte int, end_byte int"
    out = None
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).orderBy("item", "text").collect()
        sent = spark.sparkContext.broadcast(Items(np.array([r["item"] for r in rows], np.int64), _fold_texts([r["text"] for r in rows]), Q, edits))

        def find(batches, sent=sent):
            items = sent.value
            for batch, raw, off in chunks(batches):
                if got := matches_in(items, raw, off):
                    d, i, e, lo, hi = (np.array(x) for x in zip(*got, strict=True))
                    yield pa.record_batch([pa.array(int64(batch.column("id"))[d]), pa.array(int64(batch.column("hash"))[d]), pa.array(items.ids[i]), pa.array(e, pa.int32()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], names=["id", "hash", "item", "edits", "start_byte", "end_byte"])

        part = docs.mapInArrow(find, schema)
        out = part if out is None else out.unionByName(part)
    return out


def without_contaminated(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df without the documents that hold an item. Of rows that repeat an id those go whose own text holds one; null and
    blank texts stay, and so does everything if there are no items. All columns pass. No rows give none."""
    at, of, i, h = unused(df, "__gone", "__hash", "__id", "__own")
    found = _found(df, benchmark, key, text, "item_id", "text", EDITS).select(F.col("id").alias(at), F.col("hash").alias(of)).distinct()
    found, _ = stage(found, "contaminated")
    rows = df.withColumns({i: id_in(key), h: F.xxhash64(F.col(text))})
    return rows.join(maybe_broadcast(found, 24), (F.col(i) == F.col(at)) & (F.col(h) == F.col(of)), "left_anti").drop(i, h)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, with the items."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op4_decontamination": op4_decontamination}
