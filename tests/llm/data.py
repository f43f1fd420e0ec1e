"""A small corpus with the awkward cases: nulls, blanks, ties, repeated rows, copies, a long text, clashing columns."""

import random

WORDS = "alpha beta gamma delta the of and to tion ère straße naïve 12 x, zed. quick brown fox over lazy dog".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, size string, n int, key string, slot int, shard string, h long, label string"


def text(rng, n):
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", "\n", "  ", "\t"]) for _ in range(n))


def rows(seed=1):
    rng = random.Random(seed)
    base = [text(rng, rng.randint(0, 120)) for _ in range(24)]
    passage = text(rng, 90)
    texts = list(base)
    for t in base[:8]:
        texts += [t, t.replace(" ", "  ").upper() if rng.random() < 0.4 else t]
    for t in base[8:14]:
        w = t.split()
        for _ in range(2):
            v = list(w)
            for _ in range(rng.randint(0, 3)):
                if v:
                    v[rng.randrange(len(v))] = rng.choice(WORDS)
            texts.append(" ".join(v))
    for _ in range(4):
        texts.append(text(rng, 10) + passage + text(rng, rng.randint(0, 20)))
    texts += [None, None, "", " \n\t", "12 34", "...", "one", "One", "one two", "three words only", "a" * 900, "ab" * 700, text(rng, 3000), passage, "<|endoftext|> 你好 😀 it's we'll\r\n\x0b\x0c end"]
    out = []
    for i, t in enumerate(texts):
        out.append((None if i == 5 else i * 3 % 1009, t, None if i % 11 == 0 else ["en", "fr"][i % 2], None if i % 13 == 0 else f"s{i % 3}", None, 7, "x", 1, None, 5, "y", 9, "z"))
    out += [out[2], out[2]]  # whole rows repeated
    return out


def frame(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA).repartition(5)
