"""N-gram Jaccard join by vertical partitioning.

The global order of the n-grams (by hash) is cut into fragments. A document's set is cut with it: each fragment meets,
in one task, that fragment's piece of every set, counts there, and sends back counts only, which are summed over the
fragments. This is done three times:

1. Each fragment counts in how many different sets its n-grams occur. A set can be similar to another only if at
   least 80% of its n-grams occur in another set too; the sum over fragments tells. So documents that share no more
   than common passages with others end here, whatever those passages' frequency.
2. For the sets that remain, the fragments count exactly, and tell of each n-gram which sizes the other sets have that
   it occurs in. The counts order each set's n-grams, rarest first; similar sets share one of the first few of those
   that sets of the other's size have (see heads).
3. For candidate pairs, each fragment counts the partial overlap of the two pieces; their sum is the overlap.

Equal sets are one node throughout. Pairs within a group of similar sets are not all made: first every set that has
an n-gram in its head pairs with two of those that share it, and verified links give components; then all candidate
pairs of different components are verified, without a cap. So every link either joins two components or lies within
one, and components are exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, drop, id_in, id_out, int64, maybe_broadcast, stage, tuned, unused
from .components import components
from .words import grams, mix, word_hashes

WORDS = 5
PERCENT = 80
#: Ratio of neighbouring bins of set sizes.
BIN = 1.02
#: Candidate pairs that go through the fragments together.
PAIR_CHUNK = 16_384
#: Bytes of text, or of sets of n-grams, that one fragment gets, about: their number follows from the data.
FRAGMENT_BYTES = 16 << 20
#: Sets in one cell of an n-gram's pairs; a longer list is cut in blocks, and each two blocks make a cell.
LIST = 512


def shingle_sets(raw: np.ndarray, off: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct k-word shingles as sorted hashes, one text after another, and where each begins. Words are
    lower-cased from A to Z; of fewer words than k all make one shingle; without words there is none."""
    h, before = word_hashes(raw, off, lower=True)
    words = np.diff(before)
    size = np.where(words >= k, words - k + 1, np.minimum(words, 1))
    cut = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(int(cut[-1]), np.uint64)
    full = grams(h, k)
    for i in np.flatnonzero(words >= k).tolist():
        piece = out[cut[i] : cut[i + 1]]
        piece[:] = full[before[i] : before[i + 1] - k + 1]
        piece.sort()
    for m in range(1, k):
        own = np.flatnonzero(words == m)
        if len(own):
            out[cut[own]] = mix(grams(h, m)[before[own]] + np.uint64(m))
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    first = cut[:-1][size > 0]
    new[first] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return out[new], kept[cut]


def set_keys(sets: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """A hash of each whole set; 0 for the empty one."""
    n = np.diff(cut)
    sums = np.zeros(len(sets) + 1, np.uint64)
    np.cumsum(mix(sets.copy()), out=sums[1:])
    key = mix((sums[cut[1:]] - sums[cut[:-1]]) + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    key[n == 0] = 0
    return key


class Fragments:
    """The hash order, cut into 2**bits parts of equal width."""

    def __init__(self, bits: int):
        self.bits, self.count = bits, 1 << bits

    def cut(self, sets: np.ndarray, cut: np.ndarray):
        """(fragment, which sets, sizes of their pieces, the pieces) for each fragment that has any."""
        part = (sets >> np.uint64(64 - self.bits)).astype(np.uint16 if self.bits <= 16 else np.int64)
        owner = np.repeat(np.arange(len(cut) - 1, dtype=np.int32), np.diff(cut))
        order = np.argsort(part, kind="stable")
        part, owner, sets = part[order], owner[order], sets[order]
        ends = np.searchsorted(part, np.arange(self.count + 1))
        for f in range(self.count):
            a, z = int(ends[f]), int(ends[f + 1])
            if a < z:
                new = np.flatnonzero(np.r_[True, owner[a + 1 : z] != owner[a : z - 1]])
                yield f, owner[a:z][new], np.diff(np.append(new, z - a)).astype(np.int32), sets[a:z]


def _bits(size: int) -> int:
    """Bits of the fragments' numbers, for so many bytes in all."""
    return min(24, max(3, int(np.ceil(np.log2(max(1, size / FRAGMENT_BYTES))))))


def _chunk_ids():
    """Numbers that no other chunk of this run of the stage has, and that are the same if the task runs again."""
    part, k = TaskContext.get().partitionId() << 32, 0
    while True:
        yield part | k
        k += 1


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_PIECE = pa.schema([("fragment", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), ("x", pa.binary()), ("y", pa.binary()), ("z", pa.binary()), ("w", pa.binary())])
_PIECE_SQL = "fragment int, chunk long, kind int, x binary, y binary, z binary, w binary"
PIECES, ABOUT = 0, 1


def _arrays(column: pd.Series, kind) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in column]


def shared_counts(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """Of docs (id, hash, text): id, hash, n (set size), key (of the set), m (how many of its n-grams another set has
    too).

    N-grams are told apart within a fragment by their next 32 bits, so m may be too large by chance (in about one of
    4 billion comparisons times a fragment's n-grams), never too small.
    """
    fragments = Fragments(_bits(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]))
    shift = np.uint64(32 - fragments.bits)

    def send(batches):
        number = _chunk_ids()
        for batch, raw, off in chunks(batches):
            sets, cut = shingle_sets(raw, off, k)
            key, chunk = set_keys(sets, cut), next(number)
            rows = [(chunk % fragments.count, chunk, ABOUT, int64(batch.column("id")).tobytes(), np.diff(cut).astype(np.int64).tobytes(), key.tobytes(), int64(batch.column("hash")).tobytes())]
            for f, owner, size, piece in fragments.cut(sets, cut):
                rows.append((f, chunk, PIECES, owner.tobytes(), size.tobytes(), key[owner].tobytes(), (piece >> shift).astype(np.uint32).tobytes()))
            yield _batch(rows, _PIECE)

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        about = pdf[pdf["kind"] == ABOUT]
        pdf = pdf[pdf["kind"] == PIECES].sort_values("chunk", kind="stable")
        out = [about[["chunk", "kind", "x", "y", "z", "w"]]]
        if len(pdf):
            size = np.concatenate(_arrays(pdf["y"], np.int32))
            key = np.concatenate(_arrays(pdf["z"], np.uint64))
            grams_ = np.concatenate(_arrays(pdf["w"], np.uint32))
            once = np.zeros(len(key), bool)
            once[np.unique(key, return_index=True)[1]] = True  # equal sets count as one
            ordered = np.sort(grams_[np.repeat(once, size)])
            shared = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
            hit = np.zeros(len(grams_), np.int32)
            if len(shared):
                hit = (shared[np.minimum(np.searchsorted(shared, grams_), len(shared) - 1)] == grams_).astype(np.int32)
            per = np.add.reduceat(hit, np.cumsum(size) - size).astype(np.int32)
            lengths = pdf["x"].map(len).to_numpy() // 4
            cuts = np.concatenate([[0], np.cumsum(lengths)])
            out.append(pd.DataFrame({"chunk": pdf["chunk"], "kind": PIECES, "x": pdf["x"], "y": [per[a:z].tobytes() for a, z in zip(cuts[:-1], cuts[1:], strict=True)], "z": b"", "w": b""}))
        return pd.concat(out)

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        about = pdf[pdf["kind"] == ABOUT].iloc[0]
        ids = np.frombuffer(about["x"], np.int64)
        m = np.zeros(len(ids), np.int64)
        pdf = pdf[pdf["kind"] == PIECES]
        for x, y in zip(pdf["x"], pdf["y"], strict=True):
            m[np.frombuffer(x, np.int32)] += np.frombuffer(y, np.int32)
        return pd.DataFrame({"id": ids, "hash": np.frombuffer(about["w"], np.int64), "n": np.frombuffer(about["y"], np.int64), "key": np.frombuffer(about["z"], np.int64), "m": m})

    counted = docs.mapInArrow(send, _PIECE_SQL).groupBy("fragment").applyInPandas(count, "chunk long, kind int, x binary, y binary, z binary, w binary")
    return counted.groupBy("chunk").applyInPandas(total, "id long, hash long, n long, key long, m long")


def size_bin(n: np.ndarray) -> np.ndarray:
    """Sizes in bins, each BIN times as wide as the one before."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(BIN) + 1e-9).astype(np.int64)


def bins_apart(percent: int) -> int:
    """How many bins apart the sizes of similar sets can be."""
    return int(np.ceil(np.log(100 / percent) / np.log(BIN))) + 1


def overlap_needed(n: np.ndarray, bin_: np.ndarray, percent: int) -> np.ndarray:
    """A bound below the overlap that sets of n with sets of a bin need: percent of the union, and of the set itself."""
    other = np.power(BIN, bin_) - 1e-6
    return np.ceil(np.maximum(percent * n / 100, percent / (100 + percent) * (n + other)) - 1e-6).astype(np.int64)


def _set_bytes(sets: DataFrame) -> int:
    return int(sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) * 8


def heads(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of sets (key, n, grams): gram, key, n, weight for those n-grams by which similar sets must meet.

    For each bin of sizes that similar sets can have, a set's n-grams that another set of that bin has too, m of them,
    come in order, the rarest first; if the overlap must be o, similar sets share one of the first m - o + 1. With less
    than o the set has no partner there. gram is a hash of the n-gram and both bins; weight is larger for sets of
    frequent n-grams, which stand in the middle of their group.
    """
    fragments = Fragments(_bits(_set_bytes(sets)))
    apart = bins_apart(percent)

    def send(batches):
        number = _chunk_ids()
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                pieces = [np.frombuffer(x, np.uint64) for x in part.column("grams").to_pylist()]
                chunk = next(number)
                n = int64(part.column("n"))
                cut = np.concatenate([[0], np.cumsum([len(x) for x in pieces])])
                rows = [(chunk % fragments.count, chunk, ABOUT, int64(part.column("key")).tobytes(), n.tobytes(), b"", b"")]
                rows += [(f, chunk, PIECES, owner.tobytes(), size.tobytes(), piece.tobytes(), n[owner].tobytes()) for f, owner, size, piece in fragments.cut(np.concatenate(pieces), cut)]
                yield _batch(rows, _PIECE)

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        about = pdf[pdf["kind"] == ABOUT][["chunk", "kind", "x", "y"]].assign(z=b"", w=b"")
        out, pdf = [about], pdf[pdf["kind"] == PIECES]
        if len(pdf):
            values = np.concatenate(_arrays(pdf["z"], np.uint64))
            size = np.concatenate(_arrays(pdf["y"], np.int32))
            owner = np.repeat(np.concatenate(_arrays(pdf["x"], np.int32)), size)
            own = np.repeat(size_bin(np.concatenate(_arrays(pdf["w"], np.int64))), size) + apart
            chunk = np.repeat(np.arange(len(pdf)), pdf["z"].map(len).to_numpy() // 8)
            _, which, often = np.unique(values, return_inverse=True, return_counts=True)
            many = np.flatnonzero(often[which] > 1)
            values, owner, own, chunk, which = values[many], owner[many], own[many], chunk[many], which[many]
            often = often[which]
            wide = int(own.max(initial=0)) + apart + 1
            pairs, count_ = np.unique(which * wide + own, return_counts=True)
            mask = np.zeros(len(values), np.int64)
            for d in range(-apart, apart + 1) if len(values) else ():
                ask = which * wide + own + d
                at = np.minimum(np.searchsorted(pairs, ask), len(pairs) - 1)
                mask |= ((pairs[at] == ask) & (count_[at] > (d == 0))).astype(np.int64) << (d + apart)
            some = np.flatnonzero(mask)
            values, owner, often, mask, chunk = values[some], owner[some], often[some], mask[some], chunk[some]
            cuts = np.searchsorted(chunk, np.arange(len(pdf) + 1))
            rows = [(c, PIECES, owner[a:z].tobytes(), np.minimum(often[a:z], 2**31 - 1).astype(np.int32).tobytes(), values[a:z].tobytes(), mask[a:z].tobytes()) for c, a, z in zip(pdf["chunk"], cuts[:-1], cuts[1:], strict=True) if a < z]
            out.append(pd.DataFrame(rows, columns=["chunk", "kind", "x", "y", "z", "w"]))
        return pd.concat(out)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        about = pdf[pdf["kind"] == ABOUT].iloc[0]
        key, n = np.frombuffer(about["x"], np.int64), np.frombuffer(about["y"], np.int64)
        pdf = pdf[pdf["kind"] == PIECES]
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        weight = np.zeros(len(key), np.int64)
        if len(pdf):
            owner, often, values, mask = (np.concatenate(_arrays(pdf[c], t)) for c, t in (("x", np.int32), ("y", np.int32), ("z", np.uint64), ("w", np.int64)))
            order = np.lexsort((values, often, owner))
            owner, values, mask, often = owner[order], values[order], mask[order], often[order]
            weight = (np.bincount(owner, often, len(key)) / np.maximum(n, 1) * 1000).astype(np.int64)
            own = size_bin(n)
            for d in range(-apart, apart + 1):
                here = np.flatnonzero(mask >> (d + apart) & 1)
                m = np.bincount(owner[here], minlength=len(key))
                head = m - overlap_needed(n, own + d, percent) + 1
                rank = np.arange(len(here)) - (np.cumsum(m) - m)[owner[here]]
                here = here[rank < head[owner[here]]]
                o = owner[here]
                both = np.minimum(own[o], own[o] + d) * 4096 + abs(d)
                found.append((o, mix(values[here] + both.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)))
        o, gram = (np.concatenate(x) for x in zip(*found, strict=True))
        return pd.DataFrame({"gram": gram, "key": key[o], "n": n[o], "weight": weight[o]})

    counted = sets.select("key", "n", "grams").mapInArrow(send, _PIECE_SQL).groupBy("fragment").applyInPandas(count, "chunk long, kind int, x binary, y binary, z binary, w binary")
    return counted.groupBy("chunk").applyInPandas(pick, "gram long, key long, n long, weight long")


def similar(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of pairs (a, an, b, bn): a, b of those whose overlap is at least percent of their union.

    Each fragment counts the partial overlaps of all pairs on its pieces; the counts of a pair are summed.
    """
    fragments = Fragments(_bits(_set_bytes(sets)))

    def pieces(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                part = b.slice(lo, 2048)
                own = [np.frombuffer(x, np.uint64) for x in part.column("grams").to_pylist()]
                cut = np.concatenate([[0], np.cumsum([len(x) for x in own])])
                key = int64(part.column("key"))
                rows = [(f, -1, PIECES, key[owner].tobytes(), size.tobytes(), piece.tobytes(), b"") for f, owner, size, piece in fragments.cut(np.concatenate(own), cut)]
                if rows:
                    yield _batch(rows, _PIECE)

    def asked(batches):
        number = _chunk_ids()
        for b in batches:
            for lo in range(0, b.num_rows, PAIR_CHUNK):
                part = b.slice(lo, PAIR_CHUNK)
                a, an, z, zn = (int64(part.column(c)) for c in ("a", "an", "b", "bn"))
                chunk = next(number)
                yield _batch([(f, chunk, ABOUT, a.tobytes(), z.tobytes(), an.tobytes() if f == 0 else b"", zn.tobytes() if f == 0 else b"") for f in range(fragments.count)], _PIECE)

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        asks, pdf = pdf[pdf["kind"] == ABOUT], pdf[pdf["kind"] == PIECES]
        if not len(asks):
            return pd.DataFrame({c: [] for c in ("chunk", "x", "y", "z", "w", "c")})
        key = np.concatenate([np.zeros(0, np.int64), *_arrays(pdf["x"], np.int64)])
        size = np.concatenate([np.zeros(0, np.int32), *_arrays(pdf["y"], np.int32)]).astype(np.int64)
        values = np.concatenate([np.zeros(0, np.uint64), *_arrays(pdf["z"], np.uint64)])
        known, gram = np.unique(values, return_inverse=True)
        start = np.cumsum(size) - size
        order = np.argsort(key, kind="stable")
        key, size, start = key[order], size[order], start[order]
        wide = max(1, len(known))
        index = np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)
        have = np.sort(np.repeat(np.arange(len(key)), size) * wide + gram[index])
        out = []
        for chunk, x, y, z, w in zip(asks["chunk"], asks["x"], asks["y"], asks["z"], asks["w"], strict=True):
            a, b = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
            got = np.zeros(len(a), np.int32)
            if len(key):
                ia, ib = (np.minimum(np.searchsorted(key, v), len(key) - 1) for v in (a, b))
                ok = np.flatnonzero((key[ia] == a) & (key[ib] == b))
                ia, ib = ia[ok], ib[ok]
                n = size[ia]
                index = np.arange(int(n.sum())) + np.repeat(start[ia] - (np.cumsum(n) - n), n)
                want = np.repeat(ib, n) * wide + gram[index]
                at = np.minimum(np.searchsorted(have, want), len(have) - 1)
                got[ok] = np.bincount(np.repeat(np.arange(len(ok)), n), weights=have[at] == want, minlength=len(ok))
            out.append((chunk, x if z else b"", y if z else b"", z, w, got.tobytes()))
        return pd.DataFrame(out, columns=["chunk", "x", "y", "z", "w", "c"])

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf[pdf["x"].map(len) > 0].iloc[0]
        a, b, an, bn = (np.frombuffer(one[c], np.int64) for c in "xyzw")
        both = sum(np.frombuffer(c, np.int32).astype(np.int64) for c in pdf["c"])
        ok = 100 * both >= percent * (an + bn - both)
        return pd.DataFrame({"a": a[ok], "b": b[ok]})

    rows = sets.select("key", "grams").mapInArrow(pieces, _PIECE_SQL).union(pairs.select("a", "an", "b", "bn").mapInArrow(asked, _PIECE_SQL))
    counted = rows.groupBy("fragment").applyInPandas(count, "chunk long, x binary, y binary, z binary, w binary, c binary")
    return counted.groupBy("chunk").applyInPandas(total, "a long, b long")


def _pairs(one, one_n, two, two_n, percent: int):
    """Columns a, an, b, bn of a pair in order, if the sizes allow similarity."""
    first = one < two
    small, large = F.least(one_n, two_n), F.greatest(one_n, two_n)
    return (one != two) & (100 * small >= percent * large), [F.when(first, one).otherwise(two).alias("a"), F.when(first, one_n).otherwise(two_n).alias("an"), F.when(first, two).otherwise(one).alias("b"), F.when(first, two_n).otherwise(one_n).alias("bn")]


def star_pairs(head: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Each set with the lightest and the heaviest of those that share an n-gram with it in their heads."""
    place = F.struct("weight", "key", "n")
    ends = head.groupBy("gram").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).filter("lo.key != hi.key")
    near = head.join(ends, "gram").select("key", "n", F.explode(F.array("lo", "hi")).alias("e"))
    ok, columns = _pairs(F.col("key"), F.col("n"), F.col("e.key"), F.col("e.n"), percent)
    return near.filter(ok).select(*columns).distinct()


def cross_pairs(head: DataFrame, labels: DataFrame, percent: int = PERCENT) -> DataFrame:
    """All pairs of sets of different components that share an n-gram in their heads."""
    named = head.join(labels.select(F.col("node").alias("key"), "component"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    named, _ = stage(named, "heads-named")
    mixed = named.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.ceil(F.count("*") / LIST).alias("blocks")).filter("lo < hi").select("gram", "blocks")
    mixed, _ = stage(mixed, "heads-mixed")
    rows = named.join(maybe_broadcast(mixed, 24), "gram").withColumn("own", F.pmod(F.xxhash64("key"), "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")})
    rows = rows.select("gram", "x", "y", "key", "n", "component", "own").repartition("gram", "x", "y").sortWithinPartitions("gram", "x", "y")

    def pairs(batches):
        seen: dict[bytes, None] = {}
        for inner, key, n, label, own in _lists(batches):
            for lo in range(0, len(key), 256):
                i = slice(lo, lo + 256)
                ok = (label[i, None] != label[None]) & (key[i, None] < key[None])
                if not inner:
                    ok &= own[i, None] != own[None]
                ok &= 100 * np.minimum(n[i, None], n[None]) >= percent * np.maximum(n[i, None], n[None])
                a, b = np.nonzero(ok)
                if len(a):
                    a += lo
                    seen |= dict.fromkeys(zip(key[a].tolist(), n[a].tolist(), key[b].tolist(), n[b].tolist(), strict=True))
                if len(seen) > 100_000:  # what is handed on early may come again; distinct() follows
                    yield _pair_batch(seen)
                    seen = {}
        if seen:
            yield _pair_batch(seen)

    return rows.mapInArrow(pairs, "a long, an long, b long, bn long").distinct()


def _pair_batch(seen: dict) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*seen, strict=True)], names=["a", "an", "b", "bn"])


def _lists(batches):
    """Of each cell (an n-gram and two blocks of its sets): whether the blocks are one, and key, n, component, own
    arrays; rows come sorted by cell."""
    last, held = None, []

    def cell():
        return last[1] == last[2], *(np.concatenate(x) for x in zip(*held, strict=True))

    for b in batches:
        *at, key, n, component, own = (int64(b.column(c)) for c in ("gram", "x", "y", "key", "n", "component", "own"))
        cut = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in at], axis=0), True]) if len(key) else []
        for a, z in zip(cut[:-1], cut[1:], strict=True):
            name = tuple(int(c[a]) for c in at)
            if name != last:
                if held:
                    yield cell()
                last, held = name, []
            held.append([x[a:z] for x in (key, n, component, own)])
    if held:
        yield cell()


def jaccard_components(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of df: doc_id, n_shingles, component_id (least id reachable by links, its own included).

    Sets are linked when their overlap is at least percent of their union. A null or blank text has no shingles, no
    links and its own id as component; a null id counts as less than all others and is null in the result. Rows that
    repeat an id and a text are equal sets, so linked. A text of any length is read whole. No rows give none. Other
    columns are not read.
    """
    out = _components(df, key, text, k, percent)
    return out.select(id_out("id").alias("doc_id"), "n_shingles", id_out("component_id").alias("component_id"))


def _components(df: DataFrame, key: str, text: str, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """As jaccard_components: id, hash (of the text), n_shingles, component_id, and cluster, which tells components apart
    whose least id is one that rows of different texts share."""
    spark = tuned(df.sparkSession)
    docs = df.select(id_in(key).alias("id"), F.xxhash64(F.col(text)).alias("hash"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counted, _ = stage(shared_counts(docs, k), "set-sizes")
    live = counted.filter((F.col("n") > 0) & (100 * F.col("m") >= percent * F.col("n"))).groupBy("key").agg(F.min("id").alias("id"))
    live, live_path = stage(live, "sets-live")
    live_n = live.count()
    wanted = docs.join(maybe_broadcast(live, 24, live_n), "id")

    def again(batches):
        for batch, raw, off in chunks(batches):
            sets, cut = shingle_sets(raw, off, k)
            own = set_keys(sets, cut).view(np.int64)
            right = np.flatnonzero(own == int64(batch.column("key")))
            if len(right):
                yield pa.record_batch([pa.array(own[right]), pa.array(np.diff(cut)[right]), pa.array([sets[a:z].tobytes() for a, z in zip(cut[right].tolist(), cut[right + 1].tolist(), strict=True)], pa.binary())], names=["key", "n", "grams"])

    sets = wanted.select("id", "text", "key").mapInArrow(again, "key long, n long, grams binary")
    sets, sets_path = stage(sets, "sets")
    if sets.count() > live_n:  # only where ids repeat
        sets = sets.dropDuplicates(["key"])
    head, head_path = stage(heads(sets, percent), "heads")
    first, first_path = stage(star_pairs(head, percent), "pairs")
    links, _ = stage(similar(first, sets, percent), "similar")
    rest = cross_pairs(head, components(links), percent).join(first.select("a", "b"), ["a", "b"], "left_anti")
    rest, rest_path = stage(rest.select("a", "an", "b", "bn"), "pairs")
    more, _ = stage(similar(rest, sets, percent), "similar")
    labels, _ = stage(components(links.union(more)), "labels")
    drop(spark, live_path, sets_path, head_path, first_path, rest_path)

    groups = counted.groupBy("key").agg(F.min("id").alias("least")).join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    groups, _ = stage(groups, "set-groups")
    named = groups.filter("key != 0").groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("sets"))
    many = counted.groupBy("key").agg(F.count("*").alias("docs")).filter("docs > 1").select("key")
    # most documents are alone: only those in groups need a join
    grouped = groups.join(named, "component").join(many.withColumn("copied", F.lit(True)), "key", "left").filter("sets > 1 OR copied").select("key", "component", "component_id")
    grouped, _ = stage(grouped, "set-components")
    out = counted.join(maybe_broadcast(grouped, 24), "key", "left")
    return out.select("id", "hash", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), F.coalesce("component", "key").alias("cluster"))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with one row of each group of similar documents: that with the least id; of rows that repeat it, that whose
    text has the least hash, and one of rows that are equal in both.

    Documents without shingles, null texts too, stay, each for itself, as they are linked with nothing. All columns
    pass. No rows give none.
    """
    at, of, i, h, nth = unused(df, "__gone", "__hash", "__id", "__own", "__nth")
    found, _ = stage(_components(df, key, text).filter("n_shingles > 0"), "similar-rows")
    least = found.filter("id = component_id").groupBy("cluster", "component_id").agg(F.min("hash").alias("least"), F.count("*").alias("rows"))
    several, _ = stage(least.filter("rows > 1"), "repeated-ids")
    gone = found.filter("id <> component_id").select("id", "hash")
    repeated = several.count()
    if repeated:  # a group's least id has several rows, of which one text stays
        gone = gone.union(found.join(maybe_broadcast(several, 32, repeated), ["cluster", "component_id"]).filter("id = component_id AND hash <> least").select("id", "hash"))
    gone, _ = stage(gone.distinct().toDF(at, of), "near-copies")
    rows = df.withColumns({i: id_in(key), h: F.xxhash64(F.col(text))})
    out = rows.join(maybe_broadcast(gone, 24), (F.col(i) == F.col(at)) & (F.col(h) == F.col(of)), "left_anti")
    if repeated:
        several = several.select(F.col("component_id").alias(at), F.col("least").alias(of))
        match = (F.col(i) == F.col(at)) & (F.col(h) == F.col(of))
        some = out.join(maybe_broadcast(several, 24, repeated), match, "left_semi").withColumn(nth, F.row_number().over(Window.partitionBy(i, h).orderBy(F.lit(1))))
        out = out.join(maybe_broadcast(several, 24, repeated), match, "left_anti").unionByName(some.filter(F.col(nth) == 1).drop(nth))
    return out.drop(i, h)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by five-word shingles and a similarity of 80%."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op2_jaccard_join": op2_jaccard_join}

SQL = {
    "op2_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p + 4], ' '))) AS g FROM d WHERE len(w) >= 5
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = d.doc_id
"""
}
