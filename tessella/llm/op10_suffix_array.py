"""Suffix-array dedup by deep-shallow sorting.

Bytes covered by a string of 400 bytes that occurs elsewhere are removed. The candidate suffixes are those at the starts
of windows of NEAR bytes whose anchor occurs twice (see windows); equal runs of windows are one text with a count.
Suffixes can only be equal where their anchor stands at the same distance, so a group is an anchor and a distance.

Shallow sorting is multikey quicksort, of all groups side by side: eight bytes are a character, each group is parted in
less, equal and more than its pivot, and the equal part goes on with the next character, down to SHALLOW bytes. What is
alone by then equals nothing. Each group that still ties is ordered by a blind trie, which keeps only the places where
its strings differ, so that a new string costs one comparison with one leaf, however long the common prefix. Strings of
400 bytes that share a leaf are equal; those below a branching at NEAR bytes or later share that many, which is told, not
removed: where such a string starts earlier too, its bytes count as `later`, what a dedup that keeps first occurrences
would take out of passages that are repeated but shorter than 400 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_out
from .windows import Block, Bytes, Runs, Spans, documents, flagged, merged, solve, with_spans

LENGTH = 400
#: Bytes from which on a repeated string is told: forty words or so.
NEAR = 256
GRAM = 64
SHALLOW = 64


class BlindTrie:
    """Strings of one length in order. An inner node is [place, children by the byte there]; a leaf is [string, its
    numbers]. Bytes between places aren't looked at on the way down."""

    __slots__ = ("root", "size")

    def __init__(self, size: int):
        self.size, self.root = size, None

    def add(self, text: bytes, number: int) -> None:
        node = self.root
        if node is None:
            self.root = [text, [number]]
            return
        while type(node[0]) is int:
            node = node[1].get(text[node[0]]) or next(iter(node[1].values()))
        if node[0] == text:
            node[1].append(number)
            return
        differ = int.from_bytes(node[0], "big") ^ int.from_bytes(text, "big")
        place = self.size - (differ.bit_length() + 7) // 8
        other = node[0][place]
        above, node = None, self.root
        while type(node[0]) is int and node[0] < place:
            above, node = node, node[1][text[node[0]]]
        if type(node[0]) is int and node[0] == place:
            node[1][text[place]] = [text, [number]]
            return
        new = [place, {other: node, text[place]: [text, [number]]}]
        if above is None:
            self.root = new
        else:
            above[1][text[above[0]]] = new

    def alike(self, depth: int) -> Iterator[list[list[int]]]:
        """Strings that share their first depth bytes, in order: of each such group, the numbers of equal strings."""
        held = [(self.root, None)] if self.root else []
        while held:
            node, group = held.pop()
            inner = type(node[0]) is int
            if group is None and not (inner and node[0] < depth):
                group = []
                below, own = [node], group
                while below:
                    x = below.pop()
                    if type(x[0]) is int:
                        below += [x[1][c] for c in sorted(x[1], reverse=True)]
                    else:
                        own.append(x[1])
                yield own
            elif inner:
                held += [(node[1][c], None) for c in sorted(node[1], reverse=True)]


def shallow_groups(data: np.ndarray, starts: np.ndarray, group: np.ndarray, depth: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the suffixes that share their first depth bytes (a multiple of 8) with another of their group, in
    order, and the group that each is in then. group: numbers in ascending order.

    Multikey quicksort: blocks are parted in place, all at once; a block of one suffix is done.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray(len(padded) - 7, ">u8", padded, strides=(1,))
    item = np.arange(len(starts))
    at = np.arange(len(starts))  # where in the order each stands
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(group)))
    deep = np.zeros(len(first), np.int64)
    done: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    while True:
        # blocks of one are in place; those at full depth tie
        tied = (size > 1) & (deep >= depth)
        live = (size > 1) & (deep < depth)
        block = np.repeat(np.arange(len(size)), size)
        if tied.any():
            out = tied[block]
            done.append((item[out], at[out] - (np.arange(len(block)) - (np.cumsum(size) - size)[block])[out]))
        if not live.any():
            break
        keep = live[block]
        item, at = item[keep], at[keep]
        size, deep = size[live], deep[live]
        lead = np.cumsum(size) - size
        block = np.repeat(np.arange(len(size)), size)
        key = words[starts[item] + deep[block]].astype(np.uint64)
        pivot = key[lead + size // 2][block]
        part = block * 3 + (key >= pivot) + (key > pivot)
        count = np.bincount(part, minlength=3 * len(size))
        place = np.empty(len(item), np.int64)
        base = np.cumsum(count) - count
        for c in range(3):
            own = np.flatnonzero(part % 3 == c)
            b = part[own]
            place[own] = base[b] + np.arange(len(own)) - (np.cumsum(np.bincount(block[own], minlength=len(size))) - np.bincount(block[own], minlength=len(size)))[block[own]]
        moved = np.empty_like(item)
        moved[place] = item
        item = moved  # at stays: places are those of the block as a whole
        some = np.flatnonzero(count)
        size, deep = count[some], (deep[some // 3] + 8 * (some % 3 == 1))
    item, start = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(start, kind="stable")
    return item[order], start[order]


def alike(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, group: np.ndarray, size: int = LENGTH, near: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the suffixes from starts to ends, cut at size bytes, those that share their first near bytes with another: their
    numbers, in order, the number of each one's group, and of each one's string. Strings of less than size bytes equal
    others only beyond their ends."""
    near = near or size
    live, tied = shallow_groups(data, starts, group, min(SHALLOW, near // 8 * 8))
    cut = np.flatnonzero(np.r_[True, tied[1:] != tied[:-1], True]) if len(tied) else np.zeros(1, np.int64)
    raw = data.tobytes()
    lo, hi = starts[live].tolist(), np.minimum(starts[live] + size, ends[live]).tolist()
    live = live.tolist()
    items: list[int] = []
    groups: list[int] = []
    strings: list[int] = []
    g = e = 0
    cut = cut.tolist()
    for a, z in zip(cut[:-1], cut[1:], strict=True):
        if z - a == 2:  # a trie of two leaves
            x, y = raw[lo[a] : hi[a]].ljust(size, b"\0"), raw[lo[a + 1] : hi[a + 1]].ljust(size, b"\0")
            if x == y:
                strings += (e, e)
            else:
                differ = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
                if size - (differ.bit_length() + 7) // 8 < near:
                    continue
                strings += (e, e + 1) if x < y else (e + 1, e)
                e += 1
            items += live[a:z]
            groups += (g, g)
            g, e = g + 1, e + 1
            continue
        trie = BlindTrie(size)
        for k in range(a, z):
            trie.add(raw[lo[k] : hi[k]].ljust(size, b"\0"), live[k])
        for some in trie.alike(near):
            if len(some) == 1 and len(some[0]) == 1:
                continue
            for equal in some:
                items += equal
                strings += [e] * len(equal)
                groups += [g] * len(equal)
                e += 1
            g += 1
    return np.array(items, np.int64), np.array(groups, np.int64), np.array(strings, np.int64)


def deep_shallow(data: np.ndarray, starts: np.ndarray, group: np.ndarray, size: int = LENGTH) -> Iterator[list[int]]:
    """Numbers of suffixes with equal first size bytes, two or more at a time, in order of group and string."""
    items, _, strings = alike(data, starts, np.full(len(starts), len(data)), group, size)
    order = np.argsort(strings, kind="stable")
    cut = np.flatnonzero(np.r_[True, np.diff(strings[order]) > 0, True]) if len(items) else np.zeros(1, np.int64)
    yield from (x for x in (items[order[a:z]].tolist() for a, z in zip(cut[:-1], cut[1:], strict=True)) if len(x) > 1)


def repeated_spans(block: Block, size: int = LENGTH, near: int = NEAR) -> tuple[Spans, Spans, Spans]:
    """Spans of each run: of strings of size bytes that occur elsewhere; of strings of near bytes that start earlier, for
    its first occurrence, and for the others."""
    data = np.frombuffer(b"".join(block.data), np.uint8)
    length = np.array([len(x) for x in block.data])
    count = block.n
    owner = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    ends = np.cumsum(length)[owner]
    starts = (np.cumsum(length) - length)[owner] + place
    full = starts + size <= ends
    # equal windows have their anchor at the same distance, so these part the groups
    key = block.group[owner] * (near + 1) + block.at[owner] - place
    order = np.argsort(key, kind="stable")
    gone = full & (block.occurs[owner] > 1)
    later = np.zeros(len(owner), bool)
    items, group, string = alike(data, starts[order], ends[order], key[order], size, near)
    if len(items):
        own = order[items]
        whole = full[own]
        gone[own[whole]] |= np.bincount(string[whole], minlength=string.max() + 1)[string[whole]] > 1
        # in each group all but the first occurrence are later
        o = owner[own]
        sorted_ = np.lexsort((block.place[o] + place[own], block.id[o], group))
        follows = np.r_[False, np.diff(group[sorted_]) == 0]
        later[own[sorted_[follows]]] = True
    many = (block.occurs > 1)[owner]
    return flagged(owner, place, gone, size), flagged(owner, place, later, near), flagged(owner, place, many, near)


def repeated_byte_spans(docs: DataFrame, size: int = LENGTH, gram: int = GRAM, near: int = NEAR) -> DataFrame:
    """Of docs (id, key, text): id, key, kind, lo, hi, spans of UTF-8 bytes: kind 0 covered by strings of size bytes that
    occur elsewhere too, kind 1 by strings of near bytes that also start earlier."""
    return solve(Runs(docs, Bytes(near, gram, size)), lambda block: repeated_spans(block, size, near))


def suffix_array_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = LENGTH, near: int = NEAR) -> DataFrame:
    """One row per row of df: doc_id, n_bytes, n_removed, spans (lo, hi of each maximal removed run), kept (bytes), and
    n_later (bytes of strings of near bytes that start earlier as well; these are told only).

    Bytes are of the UTF-8 text; matches never cross documents; every occurrence goes, the first one too. A null text
    is empty; texts shorter than size lose nothing. Rows equal in id and text are one document to the order that n_later
    goes by, but each other's repetition; of texts that share an id, that with the smaller hash comes first. A null id
    comes before others. A text of any length is worked through in steps. No rows give none.
    """
    docs = documents(df, key, text)
    both = with_spans(docs, repeated_byte_spans(docs, size, min(GRAM, near), near))
    kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))

    def cut(batches):
        for b in batches:
            total, gone, runs, kept, later = [], [], [], [], []
            for t, spans, told in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), b.column("later").to_pylist(), strict=True):
                raw, own = t.encode(), merged(spans)
                rest, at = [], 0
                for lo, hi in own:
                    rest.append(raw[at:lo])
                    at = hi
                kept.append(b"".join([*rest, raw[at:]]) if own else raw)
                total.append(len(raw))
                gone.append(len(raw) - len(kept[-1]))
                runs.append([{"lo": lo, "hi": hi} for lo, hi in own])
                later.append(sum(hi - lo for lo, hi in merged(told)))
            yield pa.record_batch([b.column("id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, kind), pa.array(kept, pa.binary()), pa.array(later, pa.int64())], names=["id", "n_bytes", "n_removed", "spans", "kept", "n_later"])

    out = both.select("id", "text", "spans", "later").mapInArrow(cut, "id long, n_bytes long, n_removed long, spans array<struct<lo:int,hi:int>>, kept binary, n_later long")
    return out.select(id_out("id").alias("doc_id"), "n_bytes", "n_removed", "spans", "kept", "n_later")


def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes that occur twice and more, over all documents."""
    out = suffix_array_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_later")


QUERIES = {"op10_suffix_array": op10_suffix_array}

SQL = {
    "op10_suffix_array": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
x AS (SELECT doc_id, h, length(h) // 2 AS n FROM d),
long_ AS (SELECT doc_id, p, md5(substring(h, 2 * p + 1, 800)) AS m FROM (SELECT doc_id, h, unnest(range(0, n - 399)) AS p FROM x WHERE n >= 400)),
near_ AS (SELECT doc_id, p, md5(substring(h, 2 * p + 1, 512)) AS m FROM (SELECT doc_id, h, unnest(range(0, n - 255)) AS p FROM x WHERE n >= 256)),
hits AS (
  SELECT 0 AS kind, doc_id, p, p + 400 AS z FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY m) AS c FROM long_) WHERE c > 1
  UNION ALL SELECT 1, doc_id, p, p + 256 FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY m ORDER BY doc_id, p) AS nth FROM near_) WHERE nth > 1),
starts AS (SELECT *, coalesce(p > lag(z) OVER (PARTITION BY kind, doc_id ORDER BY p), true) AS new FROM hits),
numbered AS (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY kind, doc_id ORDER BY p) AS g FROM starts),
spans AS (SELECT kind, doc_id, g, min(p) AS lo, max(z) AS hi FROM numbered GROUP BY kind, doc_id, g),
ends AS (SELECT doc_id, lo, hi FROM spans WHERE kind = 0 UNION ALL SELECT doc_id, n, n FROM x),
rest AS (SELECT doc_id, lo AS z, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo, hi), 0) AS a FROM ends),
kept AS (SELECT doc_id, string_agg(substring(h, 2 * a + 1, 2 * (z - a)), '' ORDER BY a, z) AS t FROM rest JOIN x USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(hi - lo) FILTER (kind = 0) AS gone, count(*) FILTER (kind = 0) AS spans, sum(hi - lo) FILTER (kind = 1) AS later FROM spans GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(t)) AS kept_sha256, CAST(coalesce(later, 0) AS BIGINT) AS n_later
FROM x JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)
"""
}
__all__ = ["QUERIES", "SQL", "BlindTrie", "deep_shallow", "repeated_byte_spans", "shallow_groups", "suffix_array_dedup"]
