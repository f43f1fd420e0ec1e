"""Repeated windows of texts, for the two operators on repeated passages.

A window is so many consecutive symbols (words or bytes) of one text. Each window is named by its least k-gram (by
hash, the leftmost of equal ones), its anchor; equal windows have equal anchors at equal places. Consecutive windows
with one anchor form a run, which is judged where all runs with that anchor meet. So equal windows meet once, without a
row for each of them, and a run whose anchor occurs only once in the corpus isn't sent at all.

Runs are found as names first: a BLAKE2b digest of their bytes. Equal runs are one text to the solver, whatever their
number: a passage that a third of all documents share comes to its place once, with the number of its occurrences and
the first of them. The solver's verdict on that text then goes back to all its occurrences.

An anchor that very many different runs share (a passage's border in very many documents) would make a group without
bound. Its windows are dealt anew, each under its own hash, if that hash occurs twice; of equal windows again one is
judged, so such a group has one text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, chunks, drop, id_in, int64, maybe_broadcast, stage, tuned
from .words import _INVERSE, _SPACE, _power, bounds, grams, inside, mix, prefix, run, word_hashes

#: Bits that name a place in a step; STEP symbols of one text are worked through at a time, with overlap.
PLACE_BITS = 26
STEP = 1 << 20
#: Bits of a map that goes to all tasks, at most: 32 MB. What shares a bit by chance is sent in vain and finds no
#: partner, so the bound costs time, never results; beyond FULL anchors a join takes the map's place.
MAP_BITS = 28
FULL = 1 << 26
#: Different runs that one anchor's group holds at most; beyond, its windows are dealt anew.
GROUP_CONTENTS = 1000
#: Occurrences of one run that one task joins, about.
SHARE = 8192
#: Names of runs that a task remembers as sent.
SEEN_RUNS = 1 << 18
#: Bytes of runs that a solver gets at once, about.
SOLVED_BYTES = 1 << 18


@dataclass
class Read:
    """Texts as symbols: before[i] of them stand before text i; symbols s to e are the bytes lo[s] to hi[e - 1]."""

    symbols: np.ndarray
    before: np.ndarray
    data: bytes
    lo: np.ndarray | None = None
    hi: np.ndarray | None = None

    def bytes_of(self, start: np.ndarray, end: np.ndarray) -> Iterator[bytes]:
        a, z = (start, end) if self.lo is None else (self.lo[start], self.hi[end - 1])
        data = self.data
        return (data[x:y] for x, y in zip(a.tolist(), z.tolist(), strict=True))


class Words:
    """Texts as words; windows of size words."""

    def __init__(self, size: int, gram: int):
        self.size, self.gram, self.reach, self.units = size, gram, size, (size,)

    def read(self, raw: np.ndarray, off: np.ndarray) -> Read:
        symbols, before = word_hashes(raw, off)
        first, last, _ = bounds(raw, off)
        # the words with one space between those of a text
        keep = ~_SPACE[raw]
        gap = last[last < len(raw)]
        gap = gap[~keep[gap]]
        keep[gap] = True
        flat = raw.copy()
        flat[gap] = 0x20
        size = last - first
        wide = size.copy()
        wide[np.searchsorted(last, gap)] += 1
        hi = np.cumsum(wide) - wide + size
        return Read(symbols, before, flat[keep].tobytes(), hi - size, hi)

    def grams(self, symbols: np.ndarray) -> np.ndarray:
        return grams(symbols, self.gram)

    def hashes(self, symbols: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
        return mix(grams(symbols, size)[start] + np.uint64(size))


class Bytes:
    """Texts as UTF-8 bytes; windows of size bytes, and runs that reach on to windows of reach bytes."""

    def __init__(self, size: int, gram: int, reach: int | None = None):
        self.size, self.gram, self.reach = size, gram, reach or size
        self.units = (size,) if self.reach == size else (size, self.reach)

    def read(self, raw: np.ndarray, off: np.ndarray) -> Read:
        return Read(raw, off, raw.tobytes())

    def grams(self, symbols: np.ndarray) -> np.ndarray:
        k = self.gram
        if len(symbols) < k:
            return np.zeros(0, np.uint64)
        sums = prefix(symbols)
        h = sums[k:] - sums[:-k]
        h *= _power(_INVERSE, len(h))
        return mix(h)

    def hashes(self, symbols: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
        return mix(run(prefix(symbols), start, start + size) + np.uint64(size))


Form = Words | Bytes


def sliding_min(x: np.ndarray, m: int) -> np.ndarray:
    """Least of each m consecutive values, by doubling."""
    have = 1
    while have * 2 <= m:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (m - have)], x[m - have :]) if m > have else x


def runs(form: Form, symbols: np.ndarray, before: np.ndarray, limit: int | None = None) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: the first window's start, how many windows, the anchor's hash and its place.
    limit: only windows that start below it."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(symbols) < form.size:
        return none
    h = form.grams(symbols)
    low = np.uint64((1 << PLACE_BITS) - 1)
    wide = form.size - form.gram + 1
    step = (1 << PLACE_BITS) - wide + 1
    places = []
    for a in range(0, len(h) - wide + 1, step):
        part = h[a : a + step + wide - 1]
        least = sliding_min((part & ~low) | np.arange(len(part), dtype=np.uint64), wide)
        places.append((least & low).astype(np.int64) + a)
    place = np.concatenate(places)
    ok = np.flatnonzero(inside(before, form.size)[:limit])
    if not len(ok):
        return none
    place = place[ok]
    new = np.ones(len(ok), bool)
    new[1:] = (place[1:] != place[:-1]) | (ok[1:] != ok[:-1] + 1)
    first = np.flatnonzero(new)
    # an anchor is a least value, so it is spread anew over all values
    return ok[first], np.diff(np.append(first, len(ok))), mix(h[place[first]] + np.uint64(1)), place[first]


def steps(form: Form, read: Read) -> Iterator[tuple[int, np.ndarray, np.ndarray, int | None]]:
    """The symbols in steps that hold all windows starting among STEP symbols: offset, symbols, before, limit."""
    if len(read.symbols) <= STEP + form.reach:
        yield 0, read.symbols, read.before, None
        return
    for a in range(0, len(read.symbols), STEP):
        part = read.symbols[a : a + STEP + form.reach - 1]
        yield a, part, np.clip(read.before - a, 0, len(part)), STEP


def bit_map(prints: DataFrame) -> tuple[Broadcast, int]:
    """A bit map, by the upper bits, of a written table of well-mixed 64-bit numbers (its only column). What the driver
    gets are the map's own pieces, 32 MB at most, each about once, as the numbers are dealt by ranges."""
    spark = prints.sparkSession
    n = prints.count()
    bits = min(MAP_BITS, max(16, int(np.ceil(np.log2(max(1, n) * 16)))))
    piece = 13

    def pieces(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            at = b.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)
            at.sort()
            part = (at >> np.uint64(piece)).astype(np.int64)
            cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else []
            for a, z in zip(cut[:-1], cut[1:], strict=True):
                bit = held.setdefault(int(part[a]), np.zeros(1 << piece, bool))
                bit[(at[a:z] & np.uint64((1 << piece) - 1)).astype(np.int64)] = True
        if held:
            yield pa.record_batch([pa.array(list(held), pa.int32()), pa.array([np.packbits(x).tobytes() for x in held.values()], pa.binary())], names=["piece", "bits"])

    full = np.zeros(1 << (bits - 3), np.uint8)
    name = prints.columns[0]
    spread = prints.repartitionByRange(max(1, min(64, n // 50_000)), name) if n else prints
    for p, x in spread.mapInArrow(pieces, "piece int, bits binary").collect():
        full[p << (piece - 3) : (p + 1) << (piece - 3)] |= np.frombuffer(x, np.uint8)
    return spark.sparkContext.broadcast(full), bits


def marked(known: tuple[Broadcast, int], values: np.ndarray) -> np.ndarray:
    marks, bits = known[0].value, known[1]
    at = values >> np.uint64(64 - bits)
    return (marks[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1


def holding(docs: DataFrame, rows: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """The texts of docs (id, key, text) that rows (id, and a column or expression for key) name, told by a bit map, with
    some others by chance; and all the others."""
    names, path = stage(rows.select(F.xxhash64("id", F.expr(key)).alias("name")), "text-names")
    known = bit_map(names)
    drop(docs.sparkSession, path)

    @F.arrow_udf("boolean")
    def has(column: pa.Array) -> pa.Array:
        return pa.array(marked(known, int64(column).view(np.uint64)))

    name = F.xxhash64("id", "key")
    return docs.filter(has(name)), docs.filter(~has(name))


#: Hashes that a task holds before it hands them on, and bytes of them that one task counts, about.
HELD_HASHES, COUNTED_BYTES = 1 << 19, 8 << 20


def repeated(docs: DataFrame, hashes: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], total: int) -> DataFrame:
    """h: those of about total well-mixed 64-bit hashes of docs that occur twice. They travel as arrays, one for each part
    of their range and so many hashes, not as rows."""
    bits = max(1, int(np.ceil(np.log2(max(1, total * 8 / COUNTED_BYTES)))))

    def send(batches):
        held: list[np.ndarray] = []

        def flush():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            values = np.sort(np.concatenate([values, values[counts > 1]]))  # twice is enough
            part = (values >> np.uint64(64 - bits)).astype(np.int64)
            cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
            return pa.record_batch([pa.array(part[cut[:-1]].astype(np.int32)), pa.array([values[a:z].tobytes() for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.binary())], names=["part", "data"])

        for h in hashes(batches):
            if len(h):
                held.append(h)
            if sum(map(len, held)) >= HELD_HASHES:
                yield flush()
                held = []
        if held:
            yield flush()

    def count(batches):
        last, held = None, []

        def twice():
            values = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in held]))
            return pa.record_batch([pa.array(np.unique(values[1:][values[1:] == values[:-1]]).view(np.int64))], names=["h"])

        for b in batches:
            for part, data in zip(b.column("part").to_pylist(), b.column("data").to_pylist(), strict=True):
                if part != last:
                    if held:
                        yield twice()
                    last, held = part, []
                held.append(data)
        if held:
            yield twice()

    sent = docs.mapInArrow(send, "part int, data binary")
    return sent.repartition("part").sortWithinPartitions("part").mapInArrow(count, "h long")


def digests(read: Read, start: np.ndarray, end: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of runs: 64 and 32 bits of a digest of their bytes and their number of windows."""
    made = b"".join([blake2b(x, digest_size=12, salt=k.to_bytes(8, "little")).digest() for x, k in zip(read.bytes_of(start, end), n.tolist(), strict=True)])
    both = np.frombuffer(made, np.uint8).reshape(-1, 12)
    return np.ascontiguousarray(both[:, :8]).view(np.int64).ravel(), np.ascontiguousarray(both[:, 8:]).view(np.int32).ravel()


def _occurrence(anchor: np.ndarray, ids: np.ndarray, place: np.ndarray) -> np.ndarray:
    return mix(anchor.view(np.uint64) + mix(ids.view(np.uint64) + place.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


FOUND = "anchor long, content long, check int, id long, place long, n int"


@dataclass
class _Maps:
    """What tasks need to tell which runs matter: repeated anchors, crowded anchors, repeated windows of these."""

    anchors: tuple[Broadcast, int] | None = None
    crowded: tuple[Broadcast, int] | None = None
    windows: tuple[Broadcast, int] | None = None


def _candidates(form: Form, maps: _Maps, batches: Iterator[pa.RecordBatch], cold: bool, units: bool) -> Iterator[tuple]:
    """Of each step: Read, and of its runs start, end, n, anchor, at (the anchor's place in the run), id, place (32 bits
    that tell texts of one id apart, 32 bits of the start). cold: runs whose anchor isn't crowded; units: the
    repeated windows of the others, each a run of its own."""
    for batch, raw, off in chunks(batches):
        read = form.read(raw, off)
        ids, keys = int64(batch.column("id")), int64(batch.column("key"))
        for a, symbols, before, limit in steps(form, read):
            start, n, anchor, place = runs(form, symbols, before, limit)
            if maps.anchors is not None:
                keep = marked(maps.anchors, anchor)
                start, n, anchor, place = start[keep], n[keep], anchor[keep], place[keep]
            hot = marked(maps.crowded, anchor) if maps.crowded else np.zeros(len(start), bool)
            rows = []
            if cold:
                own = ~hot
                doc = np.searchsorted(before, start[own], "right") - 1
                end = np.minimum(start[own] + n[own] - 1 + form.reach, before[doc + 1])
                rows.append((start[own], end, n[own], anchor[own], place[own] - start[own]))
            if units and hot.any():
                each = np.arange(int(n[hot].sum())) + np.repeat(start[hot] - (np.cumsum(n[hot]) - n[hot]), n[hot])
                limits = before[np.searchsorted(before, each, "right")]
                for size in form.units:
                    s = each[each + size <= limits]
                    h = form.hashes(symbols, s, size)
                    if maps.windows:
                        keep = marked(maps.windows, h)
                        s, h = s[keep], h[keep]
                    rows.append((s, s + size, np.ones(len(s), np.int64), h, np.zeros(len(s), np.int64)))
            if rows:
                start, end, n, anchor, at = (np.concatenate(x) for x in zip(*rows, strict=True))
                doc = np.searchsorted(before, start, "right") - 1
                here = (keys[doc] << 32) | (start + a - read.before[doc])
                yield read, start + a, end + a, n, anchor.view(np.int64), at, ids[doc], here


def _distinct(found: DataFrame) -> DataFrame:
    first = F.min(F.struct("id", "place")).alias("first")
    out = found.groupBy("anchor", "content", "check").agg(first, F.first("n").alias("n"), F.count("*").alias("occurs"))
    return out.select("anchor", "content", "check", "first.id", "first.place", "n", "occurs")


class Runs:
    """All runs whose anchor occurs more than once, by name: found (FOUND), and needed: the different ones of those that
    occur twice or share their anchor, with their first occurrence and the number of all."""

    def __init__(self, docs: DataFrame, form: Form):
        self.docs, self.form, self.maps = docs, form, _Maps()
        spark, maps = docs.sparkSession, self.maps

        def anchors(batches):
            for _, raw, off in chunks(batches):
                read = form.read(raw, off)
                for _, symbols, before, limit in steps(form, read):
                    values, counts = np.unique(runs(form, symbols, before, limit)[2], return_counts=True)
                    yield pa.record_batch([pa.array(values.view(np.int64)), pa.array(counts.astype(np.int32))], names=["anchor", "n"])

        many = docs.select("text").mapInArrow(anchors, "anchor long, n int").groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor")
        many, many_path = stage(many, "anchors")
        if joined := many.count() > FULL:
            found = docs.mapInArrow(self._find(True, False), FOUND).join(many, "anchor", "left_semi")
        else:
            maps.anchors = bit_map(many)
            found = docs.mapInArrow(self._find(True, False), FOUND)
        self.found, _ = stage(found, "runs")
        if not joined:
            drop(spark, many_path)
        distinct, _ = stage(_distinct(self.found), "distinct-runs")
        crowded = distinct.groupBy("anchor").count().filter(F.col("count") > GROUP_CONTENTS).select("anchor")
        crowded, _ = stage(crowded, "crowded-anchors")
        if crowded.head(1):
            maps.crowded = bit_map(crowded)
            # only the texts that hold such runs are read again
            rows = self.found.join(maybe_broadcast(crowded, 16), "anchor", "left_semi").select("id", "place", "n")
            rows, rows_path = stage(rows, "crowded-runs")
            total = rows.agg(F.sum("n")).first()[0] * len(form.units)
            some, _ = holding(docs, rows, "shiftright(place, 32)")
            windows, path = stage(repeated(some, self._window_hashes, total), "repeated-windows")
            maps.windows = bit_map(windows)
            single, _ = stage(some.mapInArrow(self._find(False, True), FOUND), "windows")
            drop(spark, path, rows_path)
            self.found = self._cold(self.found).unionByName(single)
            distinct, _ = stage(self._cold(distinct).unionByName(_distinct(single)), "distinct-runs")
        several = distinct.groupBy("anchor").agg(F.count("*").alias("contents")).filter("contents > 1").select("anchor", F.lit(True).alias("several"))
        several, _ = stage(several, "shared-anchors")
        needed = distinct.join(maybe_broadcast(several, 16), "anchor", "left").filter("several OR occurs > 1").drop("several")
        self.needed, _ = stage(needed, "needed-runs")

    def _find(self, cold: bool, units: bool):
        form, maps = self.form, self.maps

        def find(batches):
            for read, start, end, n, anchor, _, ids, place in _candidates(form, maps, batches, cold, units):
                for lo in range(0, len(start), 1 << 16):
                    i = slice(lo, lo + (1 << 16))
                    content, check = digests(read, start[i], end[i], n[i])
                    yield pa.record_batch([pa.array(anchor[i]), pa.array(content), pa.array(check), pa.array(ids[i]), pa.array(place[i]), pa.array(n[i].astype(np.int32))], names=["anchor", "content", "check", "id", "place", "n"])

        return find

    @property
    def _window_hashes(self):
        form, maps = self.form, self.maps

        return lambda batches: (anchor.view(np.uint64) for _, _, _, _, anchor, _, _, _ in _candidates(form, maps, batches, False, True))

    def _cold(self, rows: DataFrame) -> DataFrame:
        """Rows whose anchor isn't crowded."""
        crowded = self.maps.crowded

        def cold(batches):
            for b in batches:
                yield b.filter(pa.array(~marked(crowded, int64(b.column("anchor")).view(np.uint64))))

        return rows.mapInArrow(cold, rows.schema)

    def texts(self) -> DataFrame:
        """Needed runs with their bytes (anchor, content, check, at, data). Their first occurrences are marked by a bit
        map and cut out of the texts in one more reading; a run that the map lets through by chance does no harm."""
        form, maps = self.form, self.maps

        def names(batches):
            for b in batches:
                yield pa.record_batch([pa.array(_occurrence(*(int64(b.column(c)) for c in ("anchor", "id", "place"))).view(np.int64))], names=["name"])

        wanted, path = stage(self.needed.select("anchor", "id", "place").mapInArrow(names, "name long"), "run-names")
        marks = bit_map(wanted)
        drop(self.docs.sparkSession, path)

        def cut(batches):
            seen: set[int] = set()
            for read, start, end, n, anchor, at, ids, place in _candidates(form, maps, batches, True, maps.crowded is not None):
                keep = np.flatnonzero(marked(marks, _occurrence(anchor, ids, place)))
                for lo in range(0, len(keep), 4096):
                    k = keep[lo : lo + 4096]
                    content, check = digests(read, start[k], end[k], n[k])
                    # a frequent run comes by chance many times: once a task will do
                    new = [i for i, c in enumerate(content.tolist()) if c not in seen and not seen.add(c)]
                    k, content, check = k[new], content[new], check[new]
                    if len(seen) > SEEN_RUNS:
                        seen.clear()
                    data = pa.array(list(read.bytes_of(start[k], end[k])), pa.binary())
                    yield pa.record_batch([pa.array(anchor[k]), pa.array(content), pa.array(check), pa.array(at[k].astype(np.int32)), data], names=["anchor", "content", "check", "at", "data"])

        some, _ = holding(self.docs, self.needed, "shiftright(place, 32)")
        return some.mapInArrow(cut, "anchor long, content long, check int, at int, data binary")


@dataclass
class Block:
    """Some anchors' groups, each whole: of every different run its group's number, name, first occurrence, number of
    windows and of occurrences, its anchor's place in it, and its bytes."""

    group: np.ndarray
    content: np.ndarray
    check: np.ndarray
    id: np.ndarray
    place: np.ndarray
    n: np.ndarray
    occurs: np.ndarray
    at: np.ndarray
    data: list[bytes]


#: Spans in windows of a run: which run of the block, the first symbol and the one behind the last.
Spans = tuple[np.ndarray, np.ndarray, np.ndarray]
#: removed (in all occurrences), later (in the first occurrence), copied (in the other occurrences).
Solver = Callable[[Block], tuple[Spans, Spans, Spans]]


def flagged(owner: np.ndarray, place: np.ndarray, hit: np.ndarray, size: int) -> Spans:
    """Maximal spans of the windows of size symbols that are hit; owner and place name each window, in order."""
    found = np.flatnonzero(hit)
    if not len(found):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1] + 1) | (owner[found[1:]] != owner[found[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(found)) - 1
    return owner[found[first]], place[found[first]], place[found[last]] + size


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Rows come sorted by anchor; those with bytes and those with counts meet by name."""
    held: list[pa.RecordBatch] = []
    size = 0

    def whole(rows: list[pa.RecordBatch]) -> Iterator[Block]:
        b = pa.Table.from_batches(rows).combine_chunks().to_batches()
        if not b:
            return
        b = b[0]
        anchor, content = (b.column(c).to_numpy() for c in ("anchor", "content"))
        check = b.column("check").to_numpy()
        text = b.column("data").is_valid().to_numpy(zero_copy_only=False)
        order = np.lexsort((text, check, content, anchor))
        same = np.zeros(len(order), bool)
        x, y = order[:-1], order[1:]
        same[:-1] = (anchor[x] == anchor[y]) & (content[x] == content[y]) & (check[x] == check[y]) & ~text[x] & text[y]
        about, own = order[same], order[np.flatnonzero(same) + 1]
        if not len(about):
            return
        _, group = np.unique(anchor[about], return_inverse=True)
        at = lambda c, i: int64(b.column(c).take(pa.array(i)).fill_null(0))
        yield Block(group, content[about], check[about], at("id", about), at("place", about), at("n", about), at("occurs", about), at("at", own), b.column("data").take(pa.array(own)).to_pylist())

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.column("data").nbytes
        if size < SOLVED_BYTES:
            continue
        last = b.column("anchor").to_numpy()
        cut = int(np.searchsorted(last, last[-1], "left"))
        if cut:
            yield from whole([*held[:-1], b.slice(0, cut)])
            held = [b.slice(cut)]
            size = held[0].column("data").nbytes
    if held:
        yield from whole(held)


def _lists(spans: Spans, rows: int) -> pa.Array:
    owner, lo, hi = spans
    order = np.lexsort((lo, owner))
    cut = np.searchsorted(owner[order], np.arange(rows + 1)).astype(np.int32)
    values = pa.StructArray.from_arrays([pa.array(lo[order].astype(np.int32)), pa.array(hi[order].astype(np.int32))], names=["lo", "hi"])
    return pa.ListArray.from_arrays(pa.array(cut), values)


def solve(found: Runs, solver: Solver) -> DataFrame:
    """Spans (id, key, kind, lo, hi) in symbols: kind 0 of what a solver removes, kind 1 of what starts earlier, too."""

    def work(batches):
        for block in _blocks(batches):
            rows = len(block.n)
            lists = [_lists(x, rows) for x in solver(block)]
            some = np.flatnonzero(sum(np.diff(x.offsets.to_numpy()) for x in lists))
            if len(some):
                columns = [pa.array(x) for x in (block.content, block.check, block.id, block.place, block.occurs)]
                yield pa.record_batch([*columns, *lists], names=["content", "check", "first_id", "first_place", "occurs", "removed", "later", "copied"]).take(pa.array(some))

    about = found.needed.withColumns({"at": F.lit(None).cast("int"), "data": F.lit(None).cast("binary")})
    texts = found.texts().withColumns({"id": F.lit(None).cast("long"), "place": F.lit(None).cast("long"), "n": F.lit(None).cast("int"), "occurs": F.lit(None).cast("long")})
    ready = about.unionByName(texts).repartition("anchor").sortWithinPartitions("anchor")
    spans = "array<struct<lo:int,hi:int>>"
    verdict = ready.mapInArrow(work, f"content long, check int, first_id long, first_place long, occurs long, removed {spans}, later {spans}, copied {spans}")
    verdict, _ = stage(verdict, "verdicts")
    rows = found.found.select("content", "check", "id", "place")
    # a run of very many occurrences is joined by several tasks
    often = verdict.filter(F.col("occurs") > SHARE).select("content", "check", F.ceil(F.col("occurs") / SHARE).alias("parts"))
    count = often.count()
    if count and count * 40 <= BROADCAST_BYTES:
        rows = rows.join(F.broadcast(often), ["content", "check"], "left").withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("id", "place"), "parts"))).drop("parts")
        verdict = verdict.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("occurs") / SHARE), F.lit(1)) - 1)))
        both = rows.join(verdict, ["content", "check", "part"])
    else:
        both = rows.join(verdict, ["content", "check"])
    first = (F.col("id") == F.col("first_id")) & (F.col("place") == F.col("first_place"))
    of = lambda kind, c: F.transform(c, lambda s: F.struct(F.lit(kind).alias("kind"), s["lo"].alias("lo"), s["hi"].alias("hi")))
    each = F.explode(F.concat(of(0, F.col("removed")), of(1, F.when(first, F.col("later")).otherwise(F.col("copied")))))
    pos = F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    out = both.select("id", F.shiftright("place", 32).alias("key"), pos.alias("pos"), each.alias("s"))
    return out.select("id", "key", F.col("s.kind"), (F.col("s.lo") + F.col("pos")).alias("lo"), (F.col("s.hi") + F.col("pos")).alias("hi"))


def join_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans (id, key, kind, lo, hi), sorted, with those that touch made one; a batch's last may stay apart from the
    next's first."""
    for b in batches:
        if not b.num_rows:
            continue
        ids, keys, kind, lo, hi = (int64(b.column(c)) for c in ("id", "key", "kind", "lo", "hi"))
        # documents as numbers from 0, above the places, so that one running maximum serves all of them
        base = np.cumsum(np.r_[0, (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]) | (kind[1:] != kind[:-1])]) << 40
        reach = np.maximum.accumulate(base + hi)
        first = np.flatnonzero(np.r_[True, (base + lo)[1:] > reach[:-1]])
        last = np.r_[first[1:], len(ids)] - 1
        yield pa.record_batch([pa.array(ids[first]), pa.array(keys[first]), pa.array(kind[first].astype(np.int32)), pa.array(lo[first].astype(np.int32)), pa.array((reach - base)[last].astype(np.int32))], names=["id", "key", "kind", "lo", "hi"])


def spans_by_row(spans: DataFrame) -> DataFrame:
    """id, key, spans, later: a text's spans of both kinds as lists, those that touch made one."""
    joined = spans.repartition("id", "key").sortWithinPartitions("id", "key", "kind", "lo").mapInArrow(join_spans, "id long, key long, kind int, lo int, hi int")
    of = lambda k: F.collect_list(F.when(F.col("kind") == k, F.struct("lo", "hi")))
    return joined.groupBy("id", "key").agg(of(0).alias("spans"), of(1).alias("later"))


def documents(df: DataFrame, key: str, text: str) -> DataFrame:
    """id, key (31 bits of a hash of the text, by which texts that share an id are told apart), text (null: empty)."""
    tuned(df.sparkSession)
    rows = df.select(id_in(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.select("id", F.shiftrightunsigned(F.xxhash64("text"), 33).alias("key"), "text")


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs (id, key, text) with their lists spans and later, or null. Where the lists are too many to be broadcast, only
    the texts that have some are moved to meet them; a bit map tells these."""
    lists, _ = stage(spans_by_row(spans), "spans")
    size = lists.agg(F.count("*"), F.sum(F.size("spans") + F.size("later"))).first()
    if 48 * size[0] + 16 * int(size[1] or 0) <= BROADCAST_BYTES:
        return docs.join(F.broadcast(lists), ["id", "key"], "left")
    some, others = holding(docs, lists)
    kind = lists.schema["spans"].dataType
    return some.join(lists, ["id", "key"], "left").unionByName(others.withColumns({"spans": F.lit(None).cast(kind), "later": F.lit(None).cast(kind)}))


def merged(spans, offset: int = 0) -> list[tuple[int, int]]:
    """Maximal runs that the spans cover."""
    out: list[list[int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a + offset, b + offset) for a, b in out]
