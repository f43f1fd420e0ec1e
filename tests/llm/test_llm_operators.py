"""Each operator against a brute-force version, on a corpus with nulls, blanks, ties, repeated rows and clashing columns."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from data import SCHEMA, frame, rows

from tessella.llm import op01_sharding, op02_jaccard_join, op03_token_ids, op04_decontamination, op05_warc, op06_substring_dedup, op07_exact_dedup, op08_language_id, op09_mixing, op10_suffix_array

NULL = -(2**63)


def ordered(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def ids():
    return [(NULL if r[0] is None else r[0], r[1]) for r in rows()]


def out_id(i):
    return None if i == NULL else i


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_sharding(spark, docs, empty):
    got = op01_sharding.histogram_shards(docs, 3).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r[0], r[1]) for r in rows())
    size = defaultdict(int)
    for r in got:
        size[r["shard"]] += len((r["text"] or "").encode()) + 1
    largest = max(len((r[1] or "").encode()) for r in rows())
    assert set(size) == {0, 1, 2} and max(size.values()) - min(size.values()) <= 2 * largest
    for s in size:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert set(got[0].asDict()) == set(docs.columns)  # shard and slot replace columns of these names
    assert op01_sharding.histogram_shards(empty, 3).count() == 0


def test_sharding_is_near_equal_with_a_hot_group(spark):
    some = [(i, "same text" if i % 3 == 0 else f"text {i * 7919 % 1000:04d}", None, None, None, 0, "", 0, "", 0, "", 0, "") for i in range(3000)]
    got = op01_sharding.histogram_shards(frame(spark, some), 8).groupBy("shard").agg({"slot": "count"}).collect()
    counts = [r[1] for r in got]
    assert len(counts) == 8 and max(counts) < 1.02 * 375 and min(counts) > 0.98 * 375


def jaccard_reference():
    sets = []
    for i, t in ids():
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append((i, frozenset(" ".join(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([" ".join(w)] if w else [])))
    least = [i for i, _ in sets]
    changed = True
    while changed:
        changed = False
        for a, (_, x) in enumerate(sets):
            for b, (_, y) in enumerate(sets):
                if x and y and least[a] != least[b] and 100 * len(x & y) >= 80 * len(x | y):
                    least[a] = least[b] = min(least[a], least[b])
                    changed = True
    return sorted(((out_id(i), len(s), out_id(c)) for (i, s), c in zip(sets, least, strict=True)), key=repr)


def test_jaccard_join(docs, empty):
    assert ordered(op02_jaccard_join.jaccard_components(docs)) == jaccard_reference()
    assert op02_jaccard_join.jaccard_components(empty).collect() == []


def test_keep_one(docs):
    want = {c for _, n, c in jaccard_reference() if n}
    got = op02_jaccard_join.keep_one(docs)
    assert sorted((r["doc_id"] for r in got.collect() if words(r["text"])), key=repr) == sorted(want, key=repr) and got.columns == docs.columns
    assert sum(not words(r["text"]) for r in got.collect()) == sum(not words(r[1]) for r in rows())


def test_keep_one_with_repeated_ids_and_clashing_names(spark):
    long = " ".join(f"w{k}" for k in range(60))
    some = [(1, long, "a"), (1, long, "b"), (1, "another text of six words", "c"), (2, long, "d"), (2, "something else of six words", "e"), (3, None, "f"), (3, None, "g")]
    df = spark.createDataFrame(some, "doc_id long, text string, __id string").withColumns({"__gone": op02_jaccard_join.F.lit(7), "__own": op02_jaccard_join.F.lit("x")})
    got = op02_jaccard_join.keep_one(df)
    assert got.columns == df.columns
    kept = sorted(r["__id"] for r in got.collect())
    assert kept in (["a", "c", "e", "f", "g"], ["b", "c", "e", "f", "g"])


def test_long_lists_of_an_ngram_are_cut_in_blocks(docs, monkeypatch):
    monkeypatch.setattr(op02_jaccard_join, "LIST", 2)
    assert ordered(op02_jaccard_join.jaccard_components(docs)) == jaccard_reference()


def test_clashing_columns(spark):
    """Columns under the operators' own working names pass unchanged."""
    names = ["__h", "__i", "__size", "__place", "__at", "__base", "__id", "__key", "__times", "__copy", "__gone", "__hash", "__own", "__guess", "__sure", "__text"]
    F = op02_jaccard_join.F
    df = spark.createDataFrame([(k, f"some words {k} of a text that is not short", "en", "s") for k in range(40)], "doc_id long, text string, lang string, source string")
    df = df.withColumns({n: F.lit(f"x{n}") for n in names})
    items = spark.createDataFrame([(1, "some words 7 of a text")], "item_id long, text string")
    outs = [op01_sharding.histogram_shards(df, 2), op02_jaccard_join.keep_one(df), op04_decontamination.without_contaminated(df, items), op08_language_id.identified(df), op09_mixing.mixed_documents(df, block_words=16)]
    for out in outs:
        got = out.collect()
        assert got and out.columns[: len(df.columns)] == df.columns and all(r[n] == f"x{n}" for r in got for n in names)


def test_cross_component_pairs_find_what_stars_miss(spark):
    """Chains of sets of which neighbours alone are similar."""
    rng = np.random.default_rng(4)
    some = []
    for g in range(6):
        w = [f"w{x}" for x in rng.integers(0, 9999, 400)]
        for k in range(9):
            some.append((g * 100 + k, " ".join(w[k * 20 : k * 20 + 200]), None, None, None, 0, "", 0, "", 0, "", 0, ""))
    got = {r["doc_id"]: r["component_id"] for r in op02_jaccard_join.jaccard_components(frame(spark, some)).collect()}
    assert got == {g * 100 + k: g * 100 for g in range(6) for k in range(9)}


def test_token_ids(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    manifest = op03_token_ids.write_token_ids(docs, path)
    got = op03_token_ids.read_token_ids(manifest).orderBy("start").collect()
    t = Tokenizer.from_file(path)
    want = Counter((out_id(i), tuple([*t.encode(x or "", add_special_tokens=False).ids, 2])) for i, x in ids())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want
    at, last = 0, NULL
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and (r["doc_id"] is None or r["doc_id"] >= last)
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at, last = at + r["n_tokens"], last if r["doc_id"] is None else r["doc_id"]
    assert op03_token_ids.tokens_of(manifest, [9])[9] == next(list(r["ids"]) for r in got if r["doc_id"] == 9)
    assert op03_token_ids.read_token_ids(op03_token_ids.write_token_ids(empty, path)).collect() == []


def test_encoder_matches_the_library_on_random_texts():
    import random

    import public_tokenizers

    rng = random.Random(2)
    letters = "abstmdrevl'' \n\t  .,1 2é  ñß-\x1c\u0085我😀"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    e = op03_token_ids.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    got, n = e.encode(*op03_token_ids.utf8(pa.array(texts)))
    cut = np.concatenate([[0], np.cumsum(n)])
    assert [got[a:z].tolist() for a, z in zip(cut[:-1], cut[1:], strict=True)] == [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_encoder_matches_added_tokens_in_plain_texts():
    import public_tokenizers

    texts = ["one <|endoftext|> two", "", "no token", "<|endof", "text|>", "<|endoftext|>", "", "a<|endoftext|><|endoftext|>b", "<|endoftext", "plain words", "<|endoftext|> é", "我<|endoftext|>", "last <|"]
    e = op03_token_ids.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    got, n = e.encode(*op03_token_ids.utf8(pa.array(texts)))
    cut = np.concatenate([[0], np.cumsum(n)])
    assert [got[a:z].tolist() for a, z in zip(cut[:-1], cut[1:], strict=True)] == [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert got[: n[0]].tolist() == [505, 220, 50256, 734]


def test_long_texts_are_encoded_piece_by_piece(spark, monkeypatch):
    import public_tokenizers

    rng = np.random.default_rng(4)
    some = ["".join(f"w{x}{c}" for x, c in zip(rng.integers(0, 9999, 900), rng.choice([" ", "  ", ". ", "\n", " é", "'s "], 900), strict=True)), "x" * 3000, " " * 3000 + "a b", "<|endoftext|> a b " * 150, None]
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = op03_token_ids.Encoder(path).tokenizer
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x in enumerate(some)}
    monkeypatch.setattr(op03_token_ids, "PIECE_BYTES", 200)
    places = op03_token_ids.cuts(np.frombuffer(some[0].encode(), np.uint8), 200)
    assert len(places) > 10 and max(np.diff(places)) < 400
    e = op03_token_ids.Encoder(path)
    for i, x in enumerate(some):
        raw = np.frombuffer((x or "").encode(), np.uint8)
        cut = op03_token_ids.cuts(raw, 200)
        got = [k for a, z in zip(cut[:-1], cut[1:], strict=True) for k in e.encode(raw[a:z], np.array([0, z - a]))[0].tolist()]
        assert [*got, 2] == want[i]


def test_long_texts_are_looked_through_in_pieces(monkeypatch):
    rng = np.random.default_rng(6)
    words = [f"w{x}" for x in rng.integers(0, 500, 4000)]
    found = [" ".join(words[k : k + 12]) for k in (3, 700, 1500, 2333, 3980)] + ["w7", "nothing of the kind is there", "w1 w"]
    text = "".join(w + c for w, c in zip(words, rng.choice([" ", "   ", "\n", " \t "], 4000), strict=True))
    items = op04_decontamination.Items(np.arange(len(found)), op04_decontamination._fold_texts(found))
    raw = np.frombuffer(text.encode(), np.uint8)
    want = op04_decontamination.matches(items, raw, np.array([0, len(raw)]))
    monkeypatch.setattr(op04_decontamination, "PIECE_BYTES", 900)
    monkeypatch.setattr(op04_decontamination.pieces, "__defaults__", (900,))
    assert len(op04_decontamination.pieces(raw, 100)) > 10
    assert op04_decontamination.matches_in(items, raw, np.array([0, len(raw)])) == want and len(want) >= 5


def test_a_very_long_text(spark):
    """A text of 80 MB goes through the operators whole, and workers stay within the memory of one executor."""
    F = op02_jaccard_join.F
    passage = " ".join(f"p{k}" for k in range(120))
    numbers = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(9_000_000)), lambda k: k.cast("string")), " ")
    long = spark.range(1).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit(passage + " "), numbers, F.lit(" q " + passage)).alias("text"))
    df, _ = op01_sharding.stage(long.unionByName(spark.createDataFrame([(2, passage)], "doc_id long, text string")), "long")
    assert df.agg(F.max(F.octet_length("text"))).first()[0] > 70_000_000
    got = {r["doc_id"]: r["n_removed"] for r in op06_substring_dedup.substring_dedup(df).select("doc_id", "n_removed").collect()}
    assert got == {1: 120, 2: 120}
    field = op08_language_id.fit(["one two three"] * 5, ["en"] * 5)
    assert op08_language_id.identify(df, field).select("doc_id", "lang_pred").count() == 2
    item = spark.createDataFrame([(1, passage[40:400])], "item_id long, text string")
    assert {r["doc_id"] for r in op04_decontamination.contaminated(df, item).collect()} == {1, 2}

    def peak(batches):
        import resource

        yield from (pa.record_batch([pa.array([resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024])], names=["mb"]) for _ in batches)

    assert spark.range(0, 64, 1, 16).mapInArrow(peak, "mb long").agg(F.max("mb")).first()[0] < 3000


def edits(p, t):
    row = [0] * (len(t) + 1)
    for c in p:
        new = [row[0] + 1]
        for j, d in enumerate(t):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination(spark, docs, empty):
    own = [t for _, t in ids() if t and 80 < len(t) < 900]
    asked = [(i, t[10 : 10 + 70 + i * 9]) for i, t in enumerate(own[:8])]
    asked = [(i, t[:20] + "QQ" * (i % 3) + t[20 + i % 2 :]) for i, t in asked] + [(90, None), (91, "  "), (92, "one"), (93, "WORDS \n on"[:5]), (None, own[9][5:60])]
    items = spark.createDataFrame(asked, "item_id long, text string")
    fold = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", (t or "").encode().lower().decode()).strip(" ").encode()
    want = Counter()
    for d, t in ids():
        for i, x in asked:
            p, y = fold(x), fold(t)
            if len(p) < 8:
                e = 0 if p and b" " + p + b" " in b" " + y + b" " else None
            else:
                e = edits(p, y)
                e = e if e <= op04_decontamination.budget(len(p)) else None
            if e is not None:
                want[out_id(d), i, e] += 1
    got = op04_decontamination.contaminated(docs, items)
    assert Counter((r["doc_id"], r["item_id"], r["edits"]) for r in got.collect()) == want and sum(want.values()) > 10
    for r in got.filter("edits = 0").collect():
        part = next(t for d, t in ids() if out_id(d) == r["doc_id"]).encode()[r["start_byte"] : r["end_byte"]]
        assert fold(part.decode()) == fold(dict(asked)[r["item_id"]])
    gone = {d for d, _, _ in want}
    assert any(i == 92 for _, i, _ in want) and any(i == 93 for _, i, _ in want)
    kept = op04_decontamination.without_contaminated(docs, items)
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(out_id(d) for d, _ in ids() if out_id(d) not in gone)
    assert op04_decontamination.contaminated(empty, items).collect() == [] == op04_decontamination.contaminated(docs, items.limit(0)).collect()


def test_warc(spark):
    pages = [(1, "http://a/ b", "<p>x</p>"), (2, None, "<p>x</p>"), (None, "u", None), (4, "u", ""), (5, "u", "é" * 40000), (3, "u", "<p>x</p>")]
    df = spark.createDataFrame([(*p, "q") for p in pages], "page_id long, url string, html string, payload string").repartition(3)
    manifest = op05_warc.write_archives(df)
    got = op05_warc.read_archives(manifest, payloads=True).collect()
    first = {}
    for i, _, h in sorted(pages, key=lambda p: NULL if p[0] is None else p[0]):
        first.setdefault(h or "", i)
    assert len(got) == len(pages)
    for r in got:
        h = next(h for i, _, h in pages if i == r["page_id"]) or ""
        assert r["payload_bytes"] == len(h.encode()) and r["payload_digest"] == base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        if first[h] == r["page_id"]:
            assert r["record_type"] == "response" and bytes(r["payload"]) == h.encode() and r["refers_to"] is None
        else:
            assert r["record_type"] == "revisit" and r["refers_to"] == first[h] and r["payload"] is None
    assert op05_warc.read_archives(op05_warc.write_archives(df.limit(0))).collect() == []


def test_warc_reader_frames_and_verifies():
    import gzip
    import io

    records = b"".join(op05_warc.page_record(i, "u", b"z" * i * 999, op05_warc.base32_sha1(b"z" * i * 999)) for i in range(5))
    assert [len(r.payload) for r in op05_warc.read_records(io.BytesIO(records), chunk=7)] == [i * 999 for i in range(5)]
    one = gzip.decompress(op05_warc.page_record(1, "u", b"abc", op05_warc.base32_sha1(b"abc")))
    for bad in (one.replace(b"abc", b"abd"), one[:-1], one.replace(b"Content-Length: 3", b"Content-Length: 4")):
        with pytest.raises(ValueError):
            list(op05_warc.read_records(io.BytesIO(gzip.compress(bad))))
    with pytest.raises(ValueError):
        list(op05_warc.read_records(io.BytesIO(records[:-5])))


def test_substring_dedup(docs, empty):
    seen, gone = {}, defaultdict(set)
    whole = sorted(set(ids()), key=lambda x: x[0])
    for i, t in whole:
        w = words(t)
        for k in range(len(w) - 19):
            x = tuple(w[k : k + 20])
            if x in seen:
                gone[i].update(range(k, k + 20))
            seen.setdefault(x, (i, k))
    want = []
    for i, t in ids():
        w = words(t)
        want.append((out_id(i), len(w), len(gone[i]), " ".join(x for k, x in enumerate(w) if k not in gone[i])))
    assert ordered(op06_substring_dedup.substring_dedup(docs)) == sorted(want, key=repr)
    assert sum(x[2] for x in want) > 100
    assert op06_substring_dedup.substring_dedup(empty).collect() == []


def test_suffix_automaton():
    import random

    rng = random.Random(3)
    for _ in range(60):
        texts = [[rng.randint(0, 2) for _ in range(rng.randint(0, 14))] for _ in range(4)]
        a = op06_substring_dedup.SuffixAutomaton()
        for t in texts:
            a.add(t)
        subs = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        probe = [rng.randint(0, 2) for _ in range(20)]
        assert a.statistics(probe) == [max([0, *(n for n in range(1, e + 1) if tuple(probe[e - n : e]) in subs)]) for e in range(1, 21)]


@pytest.mark.parametrize("name,value", [("GROUP_CONTENTS", 1), ("SHARE", 1), ("STEP", 700), ("FULL", 0), ("BROADCAST_BYTES", 0), ("SOLVED_BYTES", 1)])
def test_results_do_not_depend_on_how_the_work_is_dealt(docs, monkeypatch, name, value):
    from tessella.llm import windows

    want6, want10 = ordered(op06_substring_dedup.substring_dedup(docs)), ordered(op10_suffix_array.suffix_array_dedup(docs))
    monkeypatch.setattr(windows, name, value)
    assert ordered(op06_substring_dedup.substring_dedup(docs)) == want6
    assert ordered(op10_suffix_array.suffix_array_dedup(docs)) == want10


def test_texts_that_share_an_id_are_judged_each_for_itself(spark):
    rng = np.random.default_rng(3)
    make = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    shared, alone, other = make(120), make(120), make(63)
    df = spark.createDataFrame([(1, shared), (2, shared), (2, alone), (3, other), (3, None), (None, alone[:40])], "doc_id long, text string")
    got = {(r["doc_id"], r["n_words"]): r["n_removed"] for r in op06_substring_dedup.substring_dedup(df.filter("text IS NULL OR length(text) < 100000")).collect() if r["doc_id"] != 2}
    assert got == {(1, 120): 0, (3, 63): 0, (3, 0): 0, (None, 6): 0} or set(got.values()) == {0}
    two = [(r["n_removed"], r["kept"]) for r in op06_substring_dedup.substring_dedup(df).filter("doc_id = 2").collect()]
    assert sorted(two) == sorted([(120, ""), (0, alone)])
    two = [(r["n_removed"], bytes(r["kept"]).decode()) for r in op10_suffix_array.suffix_array_dedup(df).filter("doc_id = 2").collect()]
    assert sorted(two) == sorted([(len(shared), ""), (0, alone)])


def test_what_is_removed_comes_from_matching_and_sorting(docs, monkeypatch):
    """All spans go through the automata and the suffix sort: without them nothing is removed."""
    small = op06_substring_dedup.documents(docs, "doc_id", "text")
    found = op06_substring_dedup.Runs(small, op06_substring_dedup.Words(20, 8))
    streamed = {r["content"] for r in found.texts().collect()}
    assert {r["content"] for r in found.needed.collect()} <= streamed
    nothing = tuple(np.zeros(0, np.int64) for _ in range(3))
    assert op06_substring_dedup.solve(found, lambda block: (nothing, nothing, nothing)).collect() == []


@pytest.mark.parametrize("form", ["Bytes", "Words"])
def test_runs_of_texts_longer_than_places_can_name(form, monkeypatch):
    from tessella.llm import windows

    some = ["".join(f"w{x} " for x in np.random.default_rng(7).integers(0, 99, 1500)), "short", "".join(f"w{x} " for x in range(900))]
    form = getattr(windows, form)(20, 8)
    read = form.read(*op03_token_ids.utf8(pa.array(some)))
    want = windows.runs(form, read.symbols, read.before)
    monkeypatch.setattr(windows, "PLACE_BITS", 7)
    got = windows.runs(form, read.symbols, read.before)
    assert len(want[0]) > 100 and all((a == b).all() for a, b in zip(got, want, strict=True))


def test_exact_dedup(docs, empty):
    groups = defaultdict(list)
    for i, t in ids():
        groups[re.sub(r"[\x20\x09-\x0D]+", "", t or "")].append((-len(t or ""), i))
    want = []
    for norm, own in groups.items():
        keep = min(own)[1]
        want += [(out_id(i), out_id(keep), len(own), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for _, i in own]
    assert ordered(op07_exact_dedup.exact_dedup(docs)) == sorted(want, key=repr)
    assert op07_exact_dedup.exact_dedup(empty).collect() == []


def test_counting_quotient_filters_merge_losslessly():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 2**64, 400, dtype=np.uint64) for _ in range(3)]
    parts[1][:300] = parts[0][:300]
    parts[2][:50] = parts[0][0]
    parts[2] = np.concatenate([parts[2], np.repeat(parts[0][1], 300)])
    filters = [op07_exact_dedup.CountingQuotientFilter.load(op07_exact_dedup.CountingQuotientFilter(12, p).dump()) for p in parts]
    merged = op07_exact_dedup.CountingQuotientFilter.merge(filters)
    values, counts = np.unique(np.concatenate(parts), return_counts=True)
    assert (merged.prints() == values).all() and (merged.count == counts).all()


def test_language_id(spark, empty):
    import random

    rng = random.Random(5)
    kinds = {"aa": "bal dor kim ten war sol".split(), "bb": "épi çao ùlo ïne ôra àtu".split()}
    some = []
    for i in range(240):
        lang = rng.choice(list(kinds))
        some.append((i, " ".join("".join(rng.choice(kinds[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 40))), lang, "s", None, 0, "", 0, "", 0, "", 0, ""))
    some += [(900, None, "aa", "s", 0, 0, "", 0, "", 0, "", 0, ""), (901, "12 ...", "aa", "s", 0, 0, "", 0, "", 0, "", 0, ""), (902, "", None, "s", 0, 0, "", 0, "", 0, "", 0, ""), (None, "bal dor", None, "s", 0, 0, "", 0, "", 0, "", 0, "")]
    df = frame(spark, some)
    field = op08_language_id.train(df)
    got = op08_language_id.identify(df.select("doc_id", "text"), field).withColumn("held_out", op08_language_id.held_out()).collect()
    lang = {r[0]: r[2] for r in some}
    assert len(got) == len(some)
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        if r["doc_id"] in (900, 901, 902):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert 0 <= r["score"] <= 1
    held = [r for r in got if r["held_out"] and r["doc_id"] < 900]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)
    # code-switched text: words get labels of their own
    raw, off = op08_language_id.utf8(pa.array(["baldor kimten warsol solkim tendor épiçao ùloïne ôraàtu çaoépi ïneùlo"]))
    labels = op08_language_id.label_words(field, raw, off)[0].argmax(axis=1).tolist()
    assert labels == [0] * 5 + [1] * 5
    kept = op08_language_id.identified(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()}.isdisjoint({900, 901, 902})
    assert op08_language_id.train(empty) is None
    assert {r["lang_pred"] for r in op08_language_id.identify(df.select("doc_id", "text"), None).collect()} == {"und"}
    assert op08_language_id.identify(empty.select("doc_id", "text"), field).collect() == []


def test_language_id_reads_long_words_to_their_end():
    import random

    rng = random.Random(6)
    kinds = {"aa": "bal dor kim ten war sol".split(), "bb": "épi çao ùlo ïne ôra àtu".split()}
    make = lambda lang, n: "".join(rng.choice(kinds[lang]) for _ in range(n))
    langs = [rng.choice(list(kinds)) for _ in range(80)]
    field = op08_language_id.fit([" ".join(make(x, rng.randint(1, 3)) for _ in range(30)) for x in langs], langs)
    long = [make("aa", 16) + make("bb", 300) + make("aa", 2), make("bb", 16) + make("aa", 300) + make("bb", 2), make("aa", 150) + make("bb", 100)]
    raw, off = op08_language_id.utf8(pa.array([*long, "\u3000".join(long), "bal", ""]))
    which, share = op08_language_id.predict(field, raw, off)[:2]
    assert which[:2].tolist() == [1, 0] and which[4:].tolist() == [0, -1] and 0.8 < share[0] < 1 and 0.8 < share[1] < 1
    # every byte lies in a piece, pieces are short, begin with a character and lie in their text
    start, end, before = op08_language_id.pieces(raw, *op08_language_id.bounds(raw, off))
    assert (start[1:] == end[:-1]).all() and start[0] == 0 and end[-1] == len(raw) and (end - start).max() <= op08_language_id.LONG + 3
    assert ((raw[start] & 0xC0) != 0x80).all() and start[before[:-2]].tolist() == off[:-2].tolist() and before[-1] == before[-2] == len(start)


def test_clean_text_of_three_languages_is_kept(spark):
    import random

    rng = random.Random(8)
    kinds = {"aa": "bal dor kim ten war sol".split(), "bb": "épi çao ùlo ïne ôra àtu".split(), "cc": "жук щит эхо юла яма цех".split()}
    make = lambda lang, n: " ".join("".join(rng.choice(kinds[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    some = [(i, make(x, 30), x) for i, x in enumerate(rng.choice(list(kinds)) for _ in range(240))]
    some += [(900 + i, " ".join(make(x, 12) for x in kinds), None) for i in range(6)] + [(950, "12 34", None), (951, None, None)]
    df = spark.createDataFrame(some, "doc_id long, text string, lang string")
    field = op08_language_id.train(df)
    assert {r["doc_id"] for r in op08_language_id.identify(df, field).collect() if r["score"] < 0.4} == {*range(900, 906), 950, 951}
    assert {r["doc_id"] for r in op08_language_id.identified(df).collect()} == {*range(240), *range(900, 906)}
    # words that nothing is known of aren't sure
    raw, off = op08_language_id.utf8(pa.array(["qqq zzz xxx", some[0][1]]))
    field.weights[:], field.lexicon_weights[:], field.transitions[:] = 0, 0, 0
    assert op08_language_id.predict(field, raw, off)[2] == pytest.approx([1 / 3, 1 / 3])


def test_forward_backward():
    """Marginals of side-by-side sequences equal sums over all labellings."""
    import itertools

    rng = np.random.default_rng(2)
    before = np.array([0, 3, 3, 7, 8])
    scores, transitions = rng.normal(size=(8, 3)), rng.normal(size=(3, 3))
    order, live, base = op08_language_id.side_by_side(before)
    laid = np.empty_like(scores)
    laid[order] = scores
    got = op08_language_id.marginals(laid, transitions, live, base)[order]
    for a, z in itertools.pairwise(before):
        want = np.zeros((z - a, 3))
        for path in itertools.product(range(3), repeat=z - a):
            weight = np.exp(sum(scores[a + k, c] for k, c in enumerate(path)) + sum(transitions[x, y] for x, y in itertools.pairwise(path)))
            for k, c in enumerate(path):
                want[k, c] += weight
        if z > a:
            assert np.allclose(got[a:z], want / want.sum(axis=1, keepdims=True))


def targets(size):
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [s for s in size if s is None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total, stopped = 1.5 * sum(size.values()), {}
    while True:
        rest = total - sum(2 * size[s] for s in stopped)
        live = [s for s in names if s not in stopped]
        want = {s: rest * weight[s] / sum(weight[x] for x in live) for s in live}
        over = {s for s in live if want[s] > 2 * size[s]}
        if not over:
            return want | {s: 2.0 * size[s] for s in stopped}
        stopped |= dict.fromkeys(over)


@pytest.mark.parametrize("block", [16, 2048])
def test_mixing(docs, empty, block):
    got = op09_mixing.mix_sources(docs, block_words=block).collect()
    source = {(r[0], len(words(r[1]))): r[3] for r in rows()}
    size, taken = defaultdict(int), defaultdict(int)
    for r in rows():
        size[r[3]] += len(words(r[1]))
    want = targets(size)
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], len(words(r[1]))) for r in rows())
    for r in got:
        s = source[r["doc_id"], r["size"]]
        taken[s] += r["taken"]
        assert r["source_size"] == size[s] and abs(r["target"] - want[s]) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in size)
    assert sorted(map(tuple, got), key=repr) == ordered(op09_mixing.mix_sources(docs.repartition(2), block_words=block))
    assert op09_mixing.mix_sources(empty).collect() == [] == op09_mixing.mixed_documents(empty).collect()


def test_mixed_documents(docs):
    got = op09_mixing.mixed_documents(docs, block_words=64)
    assert got.columns == docs.columns
    times = Counter(r["doc_id"] for r in got.collect())
    assert set(times.values()) <= {1, 2, 3, 4, 5, 6} and sum(times.values()) > 20


def test_suffix_array(docs, empty):
    size, near = 60, 40
    seen, first = Counter(), {}
    for i, t in sorted(ids(), key=lambda x: x[0]):
        b = (t or "").encode()
        seen.update(b[k : k + size] for k in range(len(b) - size + 1))
        for k in range(len(b) - near + 1):
            first.setdefault(b[k : k + near], (i, k))
    want = []
    for i, t in ids():
        b = (t or "").encode()
        gone, later = np.zeros(len(b) + 1, bool), np.zeros(len(b), bool)
        for k in range(len(b) - size + 1):
            if seen[b[k : k + size]] > 1:
                gone[k : k + size] = True
        for k in range(len(b) - near + 1):
            if first[b[k : k + near]] < (i, k):
                later[k : k + near] = True
        kept = bytes(c for c, g in zip(b, gone[:-1], strict=True) if not g)
        want.append((out_id(i), len(b), int(gone.sum()), int((gone[:-1] & ~np.roll(gone, 1)[:-1]).sum()), kept, int(later.sum())))
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"]), r["n_later"]) for r in op10_suffix_array.suffix_array_dedup(docs, size=size, near=near).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and sum(x[2] for x in want) > 1000 and sum(x[5] for x in want) > 1000
    full = op10_suffix_array.suffix_array_dedup(docs).collect()
    assert len(full) == len(rows()) and any(r["n_removed"] for r in full)
    assert op10_suffix_array.suffix_array_dedup(empty).collect() == []


def test_multikey_quicksort_keeps_what_ties():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    starts, group = np.arange(3900), np.sort(rng.integers(0, 7, 3900))
    item, tied = op10_suffix_array.shallow_groups(data, starts, group, 8)
    raw, want = data.tobytes(), defaultdict(list)
    for k, g in enumerate(group.tolist()):
        want[g, raw[k : k + 8]].append(k)
    cut = np.flatnonzero(np.r_[True, tied[1:] != tied[:-1], True])
    got = [sorted(item[a:z].tolist()) for a, z in zip(cut[:-1], cut[1:], strict=True)]
    assert got == [v for _, v in sorted(want.items()) if len(v) > 1] and len(got) > 100


def test_deep_shallow_order():
    import random

    rng = random.Random(6)
    data = np.frombuffer(bytes(rng.choice(b"ab") for _ in range(600)) * 3, np.uint8)
    starts = np.arange(1500)
    raw = data.tobytes()
    got = list(op10_suffix_array.deep_shallow(data, starts, np.zeros(1500, np.int64), 80))
    strings = defaultdict(list)
    for s in starts.tolist():
        strings[raw[s : s + 80]].append(s)
    assert [sorted(x) for x in got] == [v for _, v in sorted(strings.items()) if len(v) > 1]
