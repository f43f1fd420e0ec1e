"""Language identification by a linear-chain conditional random field.

Words are labelled with languages. A word's score for a language sums learned weights of its features: the word itself
if it is in the lexicon (words seen several times in the sample), its first 1 to 3 and last 1 to 4 bytes, and its
3-byte n-grams; transitions between the languages of neighbouring words are learned too. A word is a run without
ASCII white space; one of more than LONG bytes, as in text written without spaces, is cut between characters into
pieces of about equal size, and each piece stands as a word of its own. Forward-backward gives each word's
distribution over languages, in code-switched text as well, and a document's language is that with the largest sum
over its words with letters. A text of more than SIDE_BY_SIDE bytes is labelled in parts, each a chain of its own, and
the sums run over all of them.

Training cuts a bounded sample of labelled documents into phrases in the cluster; the driver gets these, and joins
phrases of several languages to sequences, so that transitions are learned from both kinds of neighbours. Stochastic
gradients of the sequences' log-likelihood come from the same forward-backward.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop, lean, maybe_broadcast, stage, tuned, unused, utf8
from .words import _SPACE, bounds, mix, prefix, run

#: The bounds of the training sample: documents of a language, documents in all (one of each language at least), phrases
#: of a document, and words and bytes of a phrase. All languages take part, however many there are.
SAMPLE_DOCS, SAMPLE_ALL, SAMPLE_PHRASES = 250, 8000, 60
PHRASE, PHRASE_BYTES = 12, 1024
LEXICON_TIMES = 3
#: Bytes of a word; longer ones are cut into pieces (of up to 3 bytes more, as characters stay whole).
LONG = 42
#: Bits of a hashed feature, fewer where the weights of all languages would not fit in WEIGHTS numbers.
BITS, WEIGHTS = 17, 1 << 24
STEPS, SEQUENCES, RATE, DECAY = 160, 96, 0.25, 1e-6
#: Bytes of text whose sequences are labelled side by side.
SIDE_BY_SIDE = 1 << 19
_LETTER = np.zeros(256, np.int8)
_LETTER[65:91] = _LETTER[97:123] = 1
_LETTER[128:] = 1


@dataclass
class Words:
    """Words of several texts: which distinct word each is, where texts begin, and the distinct words' features."""

    which: np.ndarray
    before: np.ndarray
    hashes: np.ndarray
    letters: np.ndarray
    features: np.ndarray
    cuts: np.ndarray


def pieces(raw: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of words (as from bounds) with those of more than LONG bytes cut into consecutive pieces."""
    size = end - start
    if size.max(initial=0) <= LONG:
        return start, end, before
    count = -(-size // LONG)
    word = np.repeat(np.arange(len(size)), count)
    ends = np.cumsum(count)
    nth = np.arange(len(word)) - (ends - count)[word]
    cut = start[word] + nth * size[word] // count[word]
    for _ in range(3):
        cut -= (nth > 0) & ((raw[cut] & 0xC0) == 0x80)
    until = np.append(cut[1:], 0)
    until[ends - 1] = end
    return cut, until, np.append(0, ends)[before]


def read_words(raw: np.ndarray, off: np.ndarray, bits: int = BITS) -> Words:
    start, end, before = pieces(raw, *bounds(raw, off))
    sums = prefix(raw, lower=True)
    h = run(sums, start, end)
    known, one, which = np.unique(h, return_index=True, return_inverse=True)
    start, end = start[one], end[one]
    has = np.zeros(len(raw) + 1, np.int32)
    np.cumsum(_LETTER[raw], out=has[1:])
    size = end - start
    parts, owners = [], []

    def add(kind: int, rows: np.ndarray, a: np.ndarray, z: np.ndarray) -> None:
        parts.append(((mix(run(sums, a, z) + np.uint64(kind * 0x1000193))) >> np.uint64(64 - bits)).astype(np.int32))
        owners.append(rows)

    everyone = np.arange(len(known))
    for n in (1, 2, 3):
        rows = everyone[size >= n]
        add(n, rows, start[rows], start[rows] + n)
    for n in (1, 2, 3, 4):
        rows = everyone[size >= n]
        add(10 + n, rows, end[rows] - n, end[rows])
    n = np.maximum(size - 2, 0)
    rows = np.repeat(everyone, n)
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + start[rows]
    add(20, rows, at, at + 3)
    owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    order = np.argsort(owner, kind="stable")
    return Words(which, before, known, has[end] > has[start], np.concatenate(parts)[order], np.searchsorted(owner[order], np.arange(len(known) + 1)))


@dataclass
class Field:
    """The model: weights of hashed features, the lexicon's words and weights, transitions; and the languages."""

    languages: list[str]
    weights: np.ndarray
    lexicon: np.ndarray
    lexicon_weights: np.ndarray
    transitions: np.ndarray
    bits: int = BITS

    def in_lexicon(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each word in the lexicon; the last place, of weight 0, for others."""
        if not len(self.lexicon):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == hashes, at, len(self.lexicon))

    def scores(self, words: Words) -> np.ndarray:
        """Each distinct word's score for each language; words without letters score 0."""
        k = len(self.languages)
        # every word has a first and a last byte, so no word is without features
        out = np.add.reduceat(self.weights[words.features], words.cuts[:-1], axis=0) if len(words.hashes) else np.zeros((0, k), self.weights.dtype)
        out += self.lexicon_weights[self.in_lexicon(words.hashes)]
        out[~words.letters] = 0
        return out


def side_by_side(before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of words in which the words at one place of all texts lie together, longest text first: for each word
    its place in that order, how many texts have a word at each place, and where each place begins."""
    size = np.diff(before)
    rank = np.empty(len(size), np.int64)
    rank[np.argsort(-size, kind="stable")] = np.arange(len(size))
    longest = int(size.max(initial=0))
    live = len(size) - np.searchsorted(np.sort(size), np.arange(longest), "right")
    base = np.concatenate([[0], np.cumsum(live)])
    place = np.arange(int(before[-1])) - np.repeat(before[:-1], size)
    return base[place] + np.repeat(rank, size), live, base


def marginals(scores: np.ndarray, transitions: np.ndarray, live: np.ndarray, base: np.ndarray, pairs: bool = False):
    """Forward-backward over sequences that lie side by side; scores in that order. Each word's distribution, and with
    pairs the expected number of each transition."""
    k = scores.shape[1]
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    t = np.exp(transitions - transitions.max()).astype(e.dtype)
    a = np.empty_like(e)
    for s, n in enumerate(live.tolist()):
        lo = base[s]
        now = e[lo : lo + n]
        if s:
            now = now * (a[base[s - 1] : base[s - 1] + n] @ t)
        a[lo : lo + n] = now / now.sum(axis=1, keepdims=True)
    out = a.copy()
    expected = np.zeros((k, k))
    back = np.ones((int(live[0]) if len(live) else 0, k), e.dtype)
    for s in range(len(live) - 2, -1, -1):
        n, lo, after = int(live[s + 1]), base[s], base[s + 1]
        message = e[after : after + n] * back[:n]
        if pairs:
            joint = a[lo : lo + n, :, None] * t[None] * message[:, None, :]
            expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        message = message @ t.T
        back[:n] = message / message.sum(axis=1, keepdims=True)
        out[lo : lo + n] *= back[:n]
    out /= out.sum(axis=1, keepdims=True)
    return (out, expected) if pairs else out


def fit(texts: list[str], labels: list[str], seed: int = 5) -> Field | None:
    """A field fitted to labelled texts; None without any."""
    if not texts:
        return None
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    k = len(languages)
    number = {x: i for i, x in enumerate(languages)}
    label = np.array([number[x] for x in labels])
    bits = max(8, min(BITS, int(np.log2(WEIGHTS / k))))
    words = read_words(*utf8(pa.array(texts)), bits)
    times = np.bincount(words.which, minlength=len(words.hashes))
    lexicon = words.hashes[(times >= LEXICON_TIMES) & words.letters]
    field = Field(languages, np.zeros((1 << bits, k)), lexicon, np.zeros((len(lexicon) + 1, k)), np.zeros((k, k)), bits)
    phrases: list[list[tuple[int, int]]] = [[] for _ in languages]
    for d, (a, z) in enumerate(zip(words.before[:-1].tolist(), words.before[1:].tolist(), strict=True)):
        own = list(range(a, z, PHRASE))
        if len(own) > SAMPLE_PHRASES:
            own = rng.choice(own, SAMPLE_PHRASES, replace=False).tolist()
        phrases[label[d]] += [(p, min(p + PHRASE, z)) for p in own]
    full = [c for c in range(k) if phrases[c]]
    if not full:
        return None
    lexical = field.in_lexicon(words.hashes)
    seen = [np.full(x.shape, 1e-8) for x in (field.weights, field.lexicon_weights, field.transitions)]
    for _ in range(STEPS):
        which, truth, sizes = [], [], []
        for _ in range(SEQUENCES):
            language, n = full[rng.integers(len(full))], 0
            for _ in range(int(rng.integers(2, 6))):
                if rng.random() < 0.3:
                    language = full[rng.integers(len(full))]
                a, z = phrases[language][rng.integers(len(phrases[language]))]
                which.append(words.which[a:z])
                truth.append(np.full(z - a, language))
                n += z - a
            sizes.append(n)
        chosen, truth = np.concatenate(which), np.concatenate(truth)
        one, local = np.unique(chosen, return_inverse=True)
        count = words.cuts[one + 1] - words.cuts[one]
        features = words.features[np.arange(int(count.sum())) + np.repeat(words.cuts[one] - (np.cumsum(count) - count), count)]
        sub = Words(local, np.concatenate([[0], np.cumsum(sizes)]), words.hashes[one], words.letters[one], features, np.concatenate([[0], np.cumsum(count)]))
        order, live, base = side_by_side(sub.before)
        scores = field.scores(sub)
        laid = np.empty((len(chosen), k))
        laid[order] = scores[local]
        got, expected = marginals(laid, field.transitions, live, base, pairs=True)
        wrong = -got[order]
        wrong[np.arange(len(truth)), truth] += 1
        wrong[~sub.letters[local]] = 0
        per = np.stack([np.bincount(local, wrong[:, c], len(one)) for c in range(k)], axis=1)
        own, at = np.unique(features, return_inverse=True)
        spread = np.repeat(per, count, axis=0)
        gradient = np.stack([np.bincount(at, spread[:, c], len(own)) for c in range(k)], axis=1)
        step(field.weights, seen[0], own, gradient / SEQUENCES)
        rows = lexical[one]
        inside = rows < len(lexicon)
        step(field.lexicon_weights, seen[1], rows[inside], per[inside] / SEQUENCES)
        begins = np.zeros(len(truth), bool)
        begins[sub.before[:-1]] = True
        pair = np.flatnonzero(~begins)
        actual = np.bincount(truth[pair - 1] * k + truth[pair], minlength=k * k).reshape(k, k)
        step(field.transitions, seen[2], np.arange(k), (actual - expected) / SEQUENCES)
    field.weights, field.lexicon_weights = field.weights.astype(np.float32), field.lexicon_weights.astype(np.float32)
    return field


def step(weights: np.ndarray, seen: np.ndarray, rows: np.ndarray, gradient: np.ndarray) -> None:
    """One adaptive gradient step on some rows."""
    gradient = gradient - DECAY * weights[rows]
    seen[rows] += gradient**2
    weights[rows] += RATE * gradient / np.sqrt(seen[rows])


def label_words(field: Field, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, Words]:
    """Each word's distribution over the languages, for all words of all texts in order."""
    words = read_words(raw, off, field.bits)
    order, live, base = side_by_side(words.before)
    laid = np.empty((len(words.which), len(field.languages)), field.weights.dtype)
    laid[order] = field.scores(words)[words.which]
    return marginals(laid, field.transitions, live, base)[order], words


def parts_of(raw: np.ndarray, off: np.ndarray, limit: int = SIDE_BY_SIDE) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the texts, those of more than limit bytes cut into parts (at white space in a part's second half, or
    else between characters), and the text that each part is of."""
    if np.diff(off).max(initial=0) <= limit:
        return off, np.arange(len(off) - 1)
    cuts, owner = [0], []
    for i, (a, z) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
        while z - a > limit:
            space = np.flatnonzero(_SPACE[raw[a + limit // 2 : a + limit]])
            cut = a + limit // 2 + int(space[-1]) if len(space) else a + limit
            while cut > a + 4 and raw[cut] & 0xC0 == 0x80:
                cut -= 1
            cuts.append(cut)
            owner.append(i)
            a = cut
        cuts.append(z)
        owner.append(i)
    return np.array(cuts), np.array(owner)


def predict(field: Field, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's language (its number), that language's part of the words with letters, and how surely these are
    labelled: the mean of each one's largest marginal; -1, 0 and 0 without any.

    Parts of about equal length are labelled together, so that few steps have few texts beside each other."""
    cut, owner = parts_of(raw, off)
    size = np.diff(cut)
    mass, largest = np.zeros((len(off) - 1, len(field.languages))), np.zeros(len(off) - 1)
    order = np.argsort(size, kind="stable")
    ends = np.cumsum(size[order])
    lo = 0
    while lo < len(order):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - size[order[lo]] + SIDE_BY_SIDE, "right")))
        some = order[lo:hi]
        part = np.concatenate([raw[cut[i] : cut[i + 1]] for i in some.tolist()])
        got, words = label_words(field, part, np.concatenate([[0], np.cumsum(size[some])]))
        got[~words.letters[words.which]] = 0
        has = np.diff(words.before) > 0
        if has.any():
            at = words.before[:-1][has]
            np.add.at(mass, owner[some[has]], np.add.reduceat(got, at, axis=0, dtype=np.float64))
            np.add.at(largest, owner[some[has]], np.add.reduceat(got.max(axis=1), at, dtype=np.float64))
        lo = hi
    total = mass.sum(axis=1)
    best = mass.argmax(axis=1)
    share = mass[np.arange(len(mass)), best] / np.maximum(total, 1e-9)
    sure = largest / np.maximum(total, 1e-9)
    return np.where(total > 1e-9, best, -1), *(np.where(total > 1e-9, np.clip(x, 0, 1), 0.0) for x in (share, sure))


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def phrases_of(text: str, most: int = SAMPLE_PHRASES) -> list[str]:
    """Phrases of PHRASE words, at most so many (drawn by a hash of the text), each of PHRASE_BYTES bytes at most."""
    words = text.encode().split()
    starts = list(range(0, len(words), PHRASE))
    if len(starts) > most:
        starts = sorted(random.Random(zlib.crc32(text.encode())).sample(starts, most))
    return [b" ".join(words[a : a + PHRASE])[:PHRASE_BYTES].decode("utf-8", "ignore") for a in starts]


def train(df: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", docs: int = SAMPLE_DOCS) -> Field | None:
    """A field fitted to a sample of df's rows that aren't held out: of each language at most `docs` documents, those
    that come first by a hash of their id and text among the ones below a bound that about twice as many meet (fewer
    where there are very many languages, see SAMPLE_ALL). Their phrases are cut in the cluster, so what reaches the driver is bounded in bytes, however large
    df is. Null labels and texts take no part; rows equal in id, text and label count once. None without any."""
    rows = df.filter(~held_out(key) & F.col(label).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(label).alias("language"), F.xxhash64(F.col(key), F.col(text)).alias("h"), F.col(text).alias("t"))
    counts, path = stage(rows.groupBy("language").agg(F.count("*").alias("n")), "languages")
    languages = counts.count()
    most = max(1, min(docs, SAMPLE_ALL // max(1, languages)))
    first = Window.partitionBy("language").orderBy("h")
    part = F.shiftrightunsigned("h", 11) * F.lit(2.0**-53)
    few = rows.select("language", "h").join(maybe_broadcast(counts, 64, languages), "language").filter(part * F.col("n") < 2 * most + 8).select("language", "h").distinct()
    picked = few.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= most).select("language", "h")
    sample = rows.join(maybe_broadcast(picked, 64, most * languages), ["language", "h"], "left_semi").groupBy("language", "h").agg(F.first("t").alias("t"))

    def cut(batches):
        for b in batches:
            for language, h, t in zip(*(b.column(c).to_pylist() for c in ("language", "h", "t")), strict=True):
                if own := phrases_of(t):
                    yield pa.record_batch([pa.array([language]), pa.array([h], pa.int64()), pa.array([own])], names=["language", "h", "phrases"])

    got = sorted((r["language"], r["h"], r["phrases"]) for r in sample.mapInArrow(cut, "language string, h long, phrases array<string>").collect())
    drop(df.sparkSession, path)
    return fit([p for _, _, own in got for p in own], [x for x, _, own in got for _ in own])


def identify(df: DataFrame, field: Field | None, text: str = "text", sure: str | None = None) -> DataFrame:
    """df with lang_pred (one of the field's languages, or `und`) and score (0 to 1); with sure, also a column of that
    name that says how surely the words are labelled (0 to 1), in whichever languages.

    `und` with score 0 for null texts, texts without a letter, and all texts if there is no field. Columns of these
    names are replaced; all others pass unchanged. No rows give none.
    """
    spark = tuned(df.sparkSession)
    sent = spark.sparkContext.broadcast(field)

    @F.arrow_udf("struct<language:string,score:double,sure:double>")
    def guess(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lean()
        for t in texts:
            raw, off = utf8(t)
            names, score, certainty = np.full(len(t), "und", object), np.zeros(len(t)), np.zeros(len(t))
            if sent.value is not None:
                which, score, certainty = predict(sent.value, raw, off)
                names = np.append(np.array(sent.value.languages, object), "und")[which]
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score), pa.array(certainty)], names=["language", "score", "sure"])
        lean(done=True)

    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    (made,) = unused(df, "__guess")
    out = df.withColumn(made, guess(F.coalesce(F.col(text), F.lit(""))))
    names = {"lang_pred": F.when(letters, F.col(made)["language"]).otherwise("und"), "score": F.when(letters, F.col(made)["score"]).otherwise(0.0)}
    if sure:
        names[sure] = F.when(letters, F.col(made)["sure"]).otherwise(0.0)
    return out.withColumns(names).drop(made)


def identified(df: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", least: float = 0.4) -> DataFrame:
    """df without the rows whose language can't be told: `und`, or words whose largest marginals have a mean below
    least. Text of several languages stays if its words are labelled surely, however small each language's share. Null
    and empty texts go, repeated rows each for itself; all columns pass. No rows give none."""
    text_in, sure = unused(df, "__text", "__sure")
    rows = df.select(F.struct(*df.columns).alias("row"), F.col(text).alias(text_in))
    found = identify(rows, train(df, key, text, label), text_in, sure)
    return found.filter((F.col("lang_pred") != "und") & (F.col(sure) >= least)).select("row.*")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = identify(docs.select("doc_id", "text"), train(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op8_language_id": op8_language_id}
