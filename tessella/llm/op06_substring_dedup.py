"""Substring dedup by suffix automata.

Windows of 20 words whose words occur earlier (in a document with a smaller id, or earlier in the same one) are
removed. Candidate runs of windows meet by their anchors (see windows); so many anchors' runs as SOLVED_BYTES hold are
the reference shard of one suffix automaton. The different runs of a shard are streamed through it in the order of
their first occurrence, which gives at each word the longest match that ends there (the matching statistics); matches
as long as a window are removed as maximal spans; then the run joins the automaton, and is streamed once more for its
copies, which are all later. So what is removed, of first occurrences and of copies, are the spans that matching finds.

Shards aren't broadcast to all documents: with all documents as reference their number grows with the corpus, and so
would the passes over it. A text is streamed past the shards that hold its anchors; others can't match it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_out
from .windows import Block, Runs, Spans, Words, documents, merged, solve, with_spans

WINDOW = 20
GRAM = 8


class SuffixAutomaton:
    """Of several sequences; states are sets of substrings with the same ends."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, sequence: list[int]) -> None:
        follow, link, length = self.next, self.link, self.length
        last = 0
        for c in sequence:
            had = follow[last].get(c)
            if had is not None:  # another sequence went this way already
                if length[had] == length[last] + 1:
                    last = had
                else:
                    last = self._split(last, c, had)
                continue
            state = len(follow)
            follow.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in follow[p]:
                follow[p][c] = state
                p = link[p]
            if p >= 0:
                q = follow[p][c]
                link[state] = q if length[q] == length[p] + 1 else self._split(p, c, q)
            last = state

    def _split(self, p: int, c: int, q: int) -> int:
        """The state of those of q's substrings that also follow p."""
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def statistics(self, sequence: list[int]) -> list[int]:
        """At each place, the length of the longest substring of the automaton that ends there."""
        follow, link, length = self.next, self.link, self.length
        state = have = 0
        out = []
        for c in sequence:
            while state and c not in follow[state]:
                state = link[state]
                have = length[state]
            if c in follow[state]:
                state = follow[state][c]
                have += 1
            else:
                have = 0
            out.append(have)
        return out


def matched(statistics: list[int], size: int) -> Iterator[tuple[int, int]]:
    """Maximal spans of the matches of size and more."""
    lo = hi = -1
    for end, have in enumerate(statistics, 1):
        if have >= size:
            if end - size > hi:
                if hi >= 0:
                    yield lo, hi
                lo = end - size
            hi = end
    if hi >= 0:
        yield lo, hi


def earlier_spans(block: Block, size: int = WINDOW) -> tuple[Spans, Spans, Spans]:
    """Spans of each run that start earlier: none that go everywhere; of its first occurrence; of its copies."""
    automaton, numbers = SuffixAutomaton(), {}
    later, copied = [], []
    for i in np.lexsort((block.place, block.id)).tolist():
        sequence = [numbers.setdefault(w, len(numbers)) for w in block.data[i].split()]
        later += [(i, lo, hi) for lo, hi in matched(automaton.statistics(sequence), size)]
        automaton.add(sequence)
        if block.occurs[i] > 1:
            copied += [(i, lo, hi) for lo, hi in matched(automaton.statistics(sequence), size)]
    return tuple(tuple(np.array(x, np.int64).reshape(-1, 3).T) for x in ([], later, copied))


def repeated_word_spans(docs: DataFrame, size: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Of docs (id, key, text): id, key, kind (1), lo, hi, spans of words covered by windows that also start earlier."""
    return solve(Runs(docs, Words(size, gram)), lambda block: earlier_spans(block, size))


def substring_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """One row per row of df: doc_id, n_words, n_removed, kept (the kept words joined by one space).

    A null text has no words, and kept is empty as for an empty one. A null id comes before all others. Rows equal in
    id and text are the same document: none is earlier than the other. Of texts that share an id, that with the smaller
    hash is the earlier one. A text of any length is worked through in steps. No rows give none. Windows are judged on
    the input, not on what is left.
    """
    docs = documents(df, key, text)
    both = with_spans(docs, repeated_word_spans(docs, size, min(GRAM, size)))

    def cut(batches):
        for b in batches:
            total, gone, kept = [], [], []
            for t, spans in zip(b.column("text").to_pylist(), b.column("later").to_pylist(), strict=True):
                words = t.encode().split()
                total.append(len(words))
                for lo, hi in reversed(merged(spans)):
                    del words[lo:hi]
                gone.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.record_batch([b.column("id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["id", "n_words", "n_removed", "kept"])

    out = both.select("id", "text", "later").mapInArrow(cut, "id long, n_words long, n_removed long, kept string")
    return out.select(id_out("id").alias("doc_id"), "n_words", "n_removed", "kept")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of 20 words and more, over all documents."""
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op6_substring_dedup": op6_substring_dedup}
__all__ = ["QUERIES", "SuffixAutomaton", "earlier_spans", "repeated_word_spans", "substring_dedup"]

SQL = {
    "op6_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d WHERE len(w) >= 20),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY array_to_string(w[p:p + 19], ' ') ORDER BY doc_id, p) AS nth FROM windows) WHERE nth > 1),
gone AS (SELECT doc_id, list(DISTINCT i) AS g FROM (SELECT doc_id, unnest(range(p, p + 20)) AS i FROM later) GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
flat AS (SELECT doc_id, unnest(g) AS i FROM gone),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN flat USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gone ON d.doc_id = gone.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
}
