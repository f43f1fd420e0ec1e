"""The pipeline's stages, each on what the one before it kept, against brute force."""

import re
from collections import Counter

import pytest
from test_llm_operators import edits, words

import corpus_pipeline
from tessella.llm import op04_decontamination, op08_language_id, op09_mixing, registry

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    import random

    rng = random.Random(9)
    kinds = {"aa": "bal dor kim ten war sol".split(), "bb": "épi çao ùlo ïne ôra àtu".split()}
    text = lambda lang, n: " ".join("".join(rng.choice(kinds[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    items = [text("aa", 20), text("bb", 25)]
    rows = []
    for i in range(120):
        lang = rng.choice(["aa", "bb"])
        rows.append((i, text(lang, rng.randint(8, 60)), lang, f"s{rng.randint(0, 3)}", 0))
    for i in range(12):  # near copies
        w = rows[i][1].split()
        w[len(w) // 2] = "zzz"
        rows.append((200 + i, " ".join(w) if len(w) > 50 else rows[i][1], rows[i][2], "s0", 0))
    for i in range(8):
        rows.append((300 + i, text("aa", 5) + " " + items[i % 2].replace("a", "a" * (1 + i % 3 // 2), 1) + " " + text("bb", 9), "aa", "s1", None))
    rows += [(400, None, None, None, None), (401, "12 34 ...", "aa", "s0", 0), (402, "", "bb", None, 0)]
    at = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), items


def test_stages(spark, folder):
    at, items = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    kept = [docs]
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, kept[-1], at).write.parquet(f"{at}/stage{k}")
        kept.append(spark.read.parquet(f"{at}/stage{k}"))
        assert kept[-1].columns == NAMES + ["shard", "slot"] * (k == 4)
    rows = [{(r["doc_id"], r["text"]): r for r in x.collect()} for x in kept]

    gone = {i for i, _ in rows[0]} - {i for i, _ in rows[1]}
    assert {400, 401, 402} <= gone and all(not re.search(r"[^\W\d_]", t or "") for i, t in rows[0] if i in gone)
    assert op08_language_id.train(docs) is not None

    sets = {}
    for i, t in rows[1]:
        w = words(t.lower())
        sets[i] = {tuple(w[a : a + 5]) for a in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    least = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if least[a] != least[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
    assert {i for i, _ in rows[2]} == set(least.values()) and len(rows[2]) < len(rows[1])

    fold = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t).strip(" ").encode()
    clean = {i for i, t in rows[2] if all(edits(fold(x), fold(t)) > op04_decontamination.budget(len(fold(x))) for x in items)}
    assert {i for i, _ in rows[3]} == clean and len(clean) <= len(rows[2]) - 6

    taken = {r["doc_id"]: r for r in op09_mixing.mix_sources(kept[3]).collect()}
    times = Counter(r["doc_id"] for r in kept[4].collect())
    assert all(times[i] == int(r["taken"] / r["size"] + 0.5) for i, r in taken.items() if r["size"])

    last = kept[5].collect()
    assert Counter(r["doc_id"] for r in last) == times
    for s in range(8):
        own = sorted(r["slot"] for r in last if r["shard"] == s)
        assert own == list(range(len(own)))


def test_empty_tables(spark, folder, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    # an empty benchmark keeps everything
    some = spark.read.parquet(f"{folder[0]}/documents.parquet")
    assert corpus_pipeline.decontamination(spark, some, str(tmp_path)).count() == some.count()


def test_run_and_registry(spark, folder):
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
    out = corpus_pipeline.run(spark, folder[0])
    assert out.columns == [*NAMES, "shard", "slot"] and out.count() > 100
    names = registry.queries()
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 11))
    assert set(registry.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_sql(spark, name):
    import os

    from oracle_check import compare, database

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    assert compare(spark, database(sf), name, registry.queries()[name], registry.oracle_sql()[name], sf) is None
