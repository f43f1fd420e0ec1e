"""Token ids in Parquet list columns.

Texts are cut into pre-tokens for many texts at once; each distinct pre-token is encoded by the tokenizers library
once and remembered, as byte-level BPE encodes every pre-token by itself. Texts with characters outside the ranges
whose classes are certain go to the library whole, and so do texts that hold an added token (such as <|endoftext|>),
which the library matches before it cuts. Documents are exchanged once, by ranges of their id, and each range
becomes one file: ids are dictionary-encoded list values, doc_id, start and n_tokens are delta-encoded, row groups
hold a bounded number of documents, and pages have an index. So a reader gets metadata without the ids, or some
documents' ids without the others.
"""

from __future__ import annotations

import os
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NULL_ID, id_in, shared_path, stage, tuned, utf8
from .files import new_file, open_file
from .words import prefix, run

END_ID = 2
ROW_GROUP = 2048
PAGE_BYTES = 1 << 16
#: Text bytes a file is made of, about.
FILE_BYTES = 24 << 20
#: Slots of the memory of pre-tokens; beyond MEMORY_IDS ids it starts anew.
SLOT_BITS, MEMORY_IDS = 21, 16 << 20
#: So many words of letters after a space go to the library as one text, each with a line feed behind it: a pre-token
#: of its own, and never an id of such a word.
JOINED = 64
#: Bytes of a text that are encoded in one step; a longer one is cut where a pre-token begins in any case.
PIECE_BYTES = 2 << 20
OTHER, LETTER, NUMBER, SPACE = range(4)
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
#: Blocks of code points (first, last) whose classes no Unicode version has changed for long.
CERTAIN = ((0x00, 0x24F), (0x370, 0x3FF), (0x400, 0x481), (0x2000, 0x205F), (0x20AC, 0x20AC))
_LIMIT = 0x2100


def _classes() -> np.ndarray:
    """Class of each code point below _LIMIT, 255 where it isn't certain."""
    out = np.full(_LIMIT, 255, np.uint8)
    spaces = {0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F}
    for a, b in CERTAIN:
        for c in range(a, b + 1):
            kind = unicodedata.category(chr(c))
            if kind != "Cn":
                out[c] = SPACE if c in spaces else {"L": LETTER, "N": NUMBER}.get(kind[0], OTHER)
    return out


_CLASS = _classes()


def certain(points: np.ndarray) -> np.ndarray:
    ok = points < _LIMIT
    ok[ok] = _CLASS[points[ok]] != 255
    return ok


def pretokens(points: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts (in code points) of the pre-tokens of texts whose code points are all certain: contractions, letters,
    numbers and others with at most one space before them, and what is left of white space."""
    n = len(points)
    kind = _CLASS[points]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    start |= edge[:-1]
    space = kind == SPACE
    # the last white space before something else stands alone, or joins what follows if it is a space
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~edge[1:-1]
    start |= last
    joined = np.flatnonzero(last & (points == 0x20)) + 1
    start[joined] = False
    quote = np.flatnonzero((points == 0x27) & start)
    if len(quote):
        padded = np.concatenate([points, np.zeros(3, points.dtype)])
        room = np.concatenate([edge[:n], np.ones(4, bool)])
        a, b = padded[quote + 1], padded[quote + 2]
        one = ~room[quote + 1] & np.isin(a, [ord(c) for c in "stmd"])
        two = ~room[quote + 1] & ~room[quote + 2] & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        for at, size in ((quote[one], 2), (quote[two & ~one], 3)):
            start[at + 1] = False
            rest = at + size
            start[rest[rest < n]] = True
            # a text's own start or a joined space behind it stays as it was: the rest begins there in any case
    return np.flatnonzero(start)


class Encoder:
    """Encodes many texts; remembers pre-tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(1 << SLOT_BITS, np.uint64)
        self.at = np.zeros(1 << SLOT_BITS, np.int64)
        self.size = np.zeros(1 << SLOT_BITS, np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0

    def library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter((i for x in got for i in x), np.int32, int(size.sum())), size

    def words(self, texts: list[str], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As library, for single pre-tokens; those marked plain are a space and letters, and go in joined."""
        own = np.flatnonzero(plain)
        if len(own) < JOINED:
            return self.library(texts)
        feed = self.library(["\n"])[0][0]
        joined = ["\n".join(map(texts.__getitem__, own[i : i + JOINED].tolist())) + "\n" for i in range(0, len(own), JOINED)]
        ids, _ = self.library(joined)
        end = np.flatnonzero(ids == feed)
        if len(end) != len(own):
            return self.library(texts)
        size = np.zeros(len(texts), np.int64)
        size[own] = np.diff(end, prepend=-1) - 1
        if len(own) == len(texts):
            return ids[ids != feed], size
        rest = np.flatnonzero(~plain)
        other, size[rest] = self.library([texts[i] for i in rest.tolist()])
        which = np.repeat(plain, size)
        out = np.empty(int(size.sum()), np.int32)
        out[which], out[~which] = ids[ids != feed], other
        return out, size

    def remember(self, ids: np.ndarray) -> int:
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(len(self.flat), len(ids)), np.int32)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def encode(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has."""
        text = raw.tobytes().decode("utf-8")
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((raw & 0xC0) != 0x80)
        cut = np.searchsorted(lead, off)
        ok, own = certain(points), self.with_added(text, cut)
        if own.any() or not ok.all():
            return self.mixed(text, raw, off, cut, ok, own)
        if self.used > MEMORY_IDS:
            self.forget()
        first = pretokens(points, cut)
        if not len(first):
            return np.zeros(0, np.int32), np.zeros(len(off) - 1, np.int64)
        lead = np.append(lead, len(raw))
        end = np.append(first[1:], len(points))
        h = run(prefix(raw), lead[first], lead[end])
        h |= np.uint64(h.size == 0)  # 0 marks an empty slot; no hash is made 0 but by chance
        slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        at, size = self.at[slot], self.size[slot].astype(np.int64)
        missing = np.flatnonzero(self.keys[slot] != h)
        if len(missing):
            _, one, which = np.unique(h[missing], return_index=True, return_inverse=True)
            own = missing[one]
            kind = _CLASS[points]
            plain = (points[first[own]] == 0x20) & (end[own] - first[own] > 1) & (kind[end[own] - 1] == LETTER)
            ids, sizes = self.words([text[a:b] for a, b in zip(first[own].tolist(), end[own].tolist(), strict=True)], plain)
            place = self.remember(ids) + np.concatenate([[0], np.cumsum(sizes)[:-1]])
            at[missing], size[missing] = place[which], sizes[which]
            free = self.keys[slot[own]] == 0
            s = slot[own][free]
            self.keys[s], self.at[s], self.size[s] = h[own][free], place[free], sizes[free]
        total = int(size.sum())
        ends = np.cumsum(size)
        index = np.arange(total) + np.repeat(at - (ends - size), size)
        before = np.concatenate([[0], ends])[np.searchsorted(first, cut)]
        return self.flat[index], np.diff(before)

    def with_added(self, text: str, cut: np.ndarray) -> np.ndarray:
        """Which texts hold an added token; cut has their bounds in code points."""
        out = np.zeros(len(cut) - 1, bool)
        for token in self.added:
            at = text.find(token)
            while at >= 0:
                k = int(np.searchsorted(cut, at, "right")) - 1
                inside = at + len(token) <= cut[k + 1]
                out[k] |= inside
                at = text.find(token, int(cut[k + 1]) if inside else at + 1)
        return out

    def mixed(self, text, raw, off, cut, ok, own) -> tuple[np.ndarray, np.ndarray]:
        """Texts with uncertain characters or added tokens by the library, the runs of others between them as usual."""
        good = np.add.reduceat(np.concatenate([(~ok).astype(np.int64), [0]]), cut[:-1]) == 0
        good |= np.diff(cut) == 0
        good &= ~own
        ids, sizes, lo = [], [], 0
        while lo < len(good):
            hi = lo + 1
            while hi < len(good) and good[hi] == good[lo]:
                hi += 1
            if good[lo]:
                x, y = self.encode(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            else:
                x, y = self.library([text[a:b] for a, b in zip(cut[lo:hi].tolist(), cut[lo + 1 : hi + 1].tolist(), strict=True)])
            ids.append(x)
            sizes.append(y)
            lo = hi
        return np.concatenate(ids), np.concatenate(sizes)


def cuts(raw: np.ndarray, limit: int = PIECE_BYTES) -> list[int]:
    """Bounds of pieces of about limit bytes whose ids, one after another, are the whole text's: before single spaces
    between ASCII letters or digits, where a pre-token begins and no added token stands. A text without such places
    stays whole."""
    out, a = [0], 0
    while len(raw) - a > limit:
        lo, step, found = a + limit // 2, limit, None
        while found is None and lo + 2 < len(raw):
            part = raw[lo : lo + step]
            ok = np.flatnonzero((part[1:-1] == 0x20) & _PLAIN[part[:-2]] & _PLAIN[part[2:]])
            found = lo + 1 + int(ok[-1 if lo == a + limit // 2 else 0]) if len(ok) else None
            lo += step - 2
        if found is None:
            break
        out.append(found)
        a = found
    return [*out, len(raw)]


def with_end(ids: np.ndarray, sizes: np.ndarray, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """Each document's ids with end_id behind them."""
    out = np.full(len(ids) + len(sizes), end_id, np.int32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes)] = ids
    return out, sizes + 1


_encoders: dict[str, Encoder] = {}

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])


def write_token_ids(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", folder: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes the ids of all texts, in files by ranges of the id; returns the manifest: part, path, docs, tokens.

    A null text is empty, so it has the end id alone; so has an empty one. A text of any length is encoded whole, very
    long ones piece by piece. A null id comes first. Rows that repeat an id follow each other. No rows make no file. tokenizer: a path of a byte-level BPE file that executors can read.
    """
    spark = tuned(df.sparkSession)
    folder = folder or shared_path(spark, "token-ids")
    rows = df.select(id_in(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = df.select(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-total // FILE_BYTES))

    def write(batches):
        encoder = _encoders.get(tokenizer) or _encoders.setdefault(tokenizer, Encoder(tokenizer))
        part = TaskContext.get().partitionId()
        batch = next((b for b in batches if b.num_rows), None)
        if batch is None:
            return
        docs = tokens = 0
        with new_file(folder, f"ids{part:06d}.parquet") as (out, path):
            with pq.ParquetWriter(out, _SCHEMA, version="2.6", data_page_version="2.0", compression="zstd", compression_level=1, use_dictionary=["ids.list.element"], column_encoding={"doc_id": "DELTA_BINARY_PACKED", "n_tokens": "DELTA_BINARY_PACKED"}, data_page_size=PAGE_BYTES, write_page_index=True, write_statistics=True) as writer:
                while batch is not None:
                    raw, off = utf8(batch.column("text"))
                    lo = 0
                    while lo < batch.num_rows:
                        hi = int(np.searchsorted(off, off[lo] + (2 << 20), "right")) - 1
                        hi = min(max(hi, lo + 1), lo + ROW_GROUP, batch.num_rows)
                        own, at = raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                        if hi == lo + 1 and len(own) > PIECE_BYTES:
                            places = cuts(own)
                            found = [encoder.encode(own[x:y], np.array([0, y - x]))[0] for x, y in zip(places[:-1], places[1:], strict=True)]
                            ids = np.concatenate(found)
                            ids, sizes = with_end(ids, np.array([len(ids)]), end_id)
                        else:
                            ids, sizes = with_end(*encoder.encode(own, at), end_id)
                        cut = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                        lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(ids))
                        writer.write_table(pa.Table.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(sizes), lists], schema=_SCHEMA), row_group_size=ROW_GROUP)
                        docs, tokens, lo = docs + hi - lo, tokens + len(ids), hi
                    batch = next((b for b in batches if b.num_rows), None)
        yield pa.record_batch([pa.array([part], pa.int32()), pa.array([path]), pa.array([docs], pa.int64()), pa.array([tokens], pa.int64())], names=["part", "path", "docs", "tokens"])

    ranged = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    manifest, _ = stage(ranged.mapInArrow(write, "part int, path string, docs long, tokens long"), "token-manifest")
    return manifest


def read_token_ids(manifest: DataFrame, ids: bool = True) -> DataFrame:
    """Per document, read from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and
    with ids the ids themselves. A file is one task's work; the ids before a file are a sum over the manifest."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    count = max(1, manifest.count())

    def read(batches):
        for b in batches:
            for path, base, said in zip(*(b.column(c).to_pylist() for c in ("path", "base", "tokens")), strict=True):
                at = base
                with open_file(path) as f, pq.ParquetFile(f) as table:
                    for got in table.iter_batches(batch_size=ROW_GROUP, columns=["doc_id", "ids"]):
                        lists = got.column("ids")
                        cut = lists.offsets.to_numpy().astype(np.int64)
                        values = lists.values.to_numpy().astype("<u4", copy=False)
                        sizes = np.diff(cut)
                        starts = at + cut[:-1] - cut[0]
                        crc = np.fromiter((zlib.crc32(values[a:z]) for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)), np.int64, len(sizes))
                        at += int(sizes.sum())
                        key = got.column("doc_id").to_numpy()
                        out = [pa.array(key, mask=key == NULL_ID), pa.array(starts), pa.array(sizes), pa.array(crc)]
                        yield pa.record_batch(out + [lists] * ids, names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * ids)
                if at - base != said:
                    raise ValueError(f"{path} has {at - base} ids, not {said}")

    return files.select("path", "base", "tokens").repartition(count).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)


def tokens_of(manifest: DataFrame, doc_ids: list[int]) -> dict[int, list[int]]:
    """Ids of some documents. Files are looked into by tasks, a file each; row-group statistics and the page index leave
    out all pages that can't hold them. Documents that aren't there are left out; of rows that repeat an id one is
    given; None asks for nothing. The answer is as large as the documents asked for."""
    wanted = sorted({int(i) for i in doc_ids if i is not None})

    def read(batches):
        import pyarrow.dataset as ds

        for b in batches:
            for path in b.column("path").to_pylist():
                with open_file(path) as f, pq.ParquetFile(f) as table:
                    bounds = [(g, table.metadata.row_group(g).column(0).statistics) for g in range(table.num_row_groups)]
                    groups = [g for g, s in bounds if s is None or not s.has_min_max or any(s.min <= i <= s.max for i in wanted)]
                    if groups:
                        rows = table.read_row_groups(groups, columns=["doc_id", "ids"]).filter(ds.field("doc_id").isin(wanted))
                        yield from rows.to_batches()

    rows = manifest.select("path").repartition(max(1, manifest.count())).mapInArrow(read, "doc_id long, ids array<int>")
    return {r["doc_id"]: list(r["ids"]) for r in rows.toLocalIterator()}


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of all documents and reads them back."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read_token_ids(write_token_ids(docs, public_tokenizers.path("byte_bpe_50k.json")), ids=False)


QUERIES = {"op3_token_ids": op3_token_ids}
