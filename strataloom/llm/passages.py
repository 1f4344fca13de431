"""Passages that repeat inside longer paragraphs, which whole paragraphs can't show.

Of the hashes of all runs of RUN words in a text, winnowing (Schleimer et al.) keeps the least of every SPREAD that
follow each other; a passage of RUN + SPREAD - 1 = 49 words or more that stands twice, in one document or in two, leaves
the same hash at both places, whatever stands around it. Shorter runs with more spread would find shorter passages by
chance, but leave up to SPREAD - 1 words standing at each end of every passage that has to be found. Runs are equal where
96 bits of two hashes of their words are. One exchange counts the hashes; a document's repeated runs are merged.

Places are in order of doc_id, the text's digest and the word. The first place of a run stays, every other one goes, also
where the run overlaps one that is the first of its kind: each word that goes stands at a place before.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .words import U64, Words

RUN, SPREAD = 40, 10


def winnow(h: np.ndarray, owner: np.ndarray, spread: int = SPREAD) -> np.ndarray:
    """Places of the hashes that are the least, the last of equals, of some `spread` neighbours of their text."""
    n = len(h)
    least, top = h.copy(), np.iinfo(np.uint64).max
    whole = np.ones(n, dtype=bool)
    whole[1:] = owner[1:] != owner[:-1]  # a text's first neighbourhood counts even if it is short
    if n >= spread:
        whole[: n - spread + 1] |= owner[spread - 1 :] == owner[: n - spread + 1]
    for t in range(1, min(spread, n)):
        np.minimum(least[: n - t], np.where(owner[t:] == owner[: n - t], h[t:], top), out=least[: n - t])
    chosen, open_ = np.zeros(n, dtype=bool), whole
    for t in reversed(range(min(spread, n))):
        hit = open_[: n - t] & (h[t:] == least[: n - t]) & (owner[t:] == owner[: n - t])
        chosen[t:] |= hit
        open_[: n - t] &= ~hit
    return np.flatnonzero(chosen)


def places(h: np.ndarray, at: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first run, and the first word of the last, of each place of a hash; runs of one hash that overlap are one place."""
    order = np.lexsort((at, h, owner))
    h, at, owner = h[order], at[order], owner[order]
    first = np.ones(len(h), dtype=bool)
    first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]) | (at[1:] - at[:-1] >= RUN)
    begin = np.flatnonzero(first)
    last = at[np.append(begin, len(h))[1:] - 1]
    back = np.argsort(order[begin])
    return order[begin][back], last[back]


def blanked(texts: pa.Array, gone) -> pa.Array:
    """The texts with blanks for the lines whose places are gone; every other byte stays where it is."""
    out = texts.cast(pa.binary()).to_pylist()
    for k, lines in enumerate(gone):
        if lines:
            some = set(lines)
            out[k] = b"\n".join(b" " * len(x) if i in some else x for i, x in enumerate(out[k].split(b"\n")))
    return pa.array(out, pa.binary())


def fingerprints(docs: DataFrame) -> DataFrame:
    """(h, g, doc_id, digest, word, words): the winnowed runs of docs(doc_id, digest, text, gone) at all their places."""
    common.small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            keys, texts, gone = batch.columns[:2], common.text_column(batch.column(2)), batch.column(3)
            for a, b in common.chunks(texts):
                words = Words(blanked(texts[a:b], gone[a:b].to_pylist()), lower=True)
                h, at = words.windows(RUN)
                owner = np.searchsorted(words.word_at, at, side="right") - 1
                pick = winnow(h, owner)
                if not len(pick):
                    continue
                h, at, owner = h[pick], at[pick], owner[pick]
                first, last = places(h, at, owner)
                at, owner, rows = at[first], owner[first], pa.array(owner[first])
                ints = [at - words.word_at[owner], last - at + RUN]
                yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(words.run_marks(at, RUN).view(np.int32)), *[k[a:b].take(rows) for k in keys], *[pa.array(x.astype(np.int32)) for x in ints]], ["h", "g", "doc_id", "digest", "word", "words"])

    return docs.select("doc_id", "digest", "text", "gone").mapInArrow(common.trimmed(run), "h bigint, g int, doc_id bigint, digest bigint, word int, words int")


def repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, runs): each document's runs with more than one place; runs of (word, words, lead_id, first)."""
    keys = common.durable(fingerprints(docs))
    many = common.durable(keys.groupBy("h", "g").agg(F.count("*").alias("n")).where("n > 1"))
    few = F.broadcast(many.select("h", "g")) if many.count() <= common.BROADCAST_IDS // 2 else many
    some = common.durable(keys.join(few, ["h", "g"], "left_semi"))
    place = F.struct("doc_id", "digest", "word")
    first = some.groupBy("h", "g").agg(F.min(place).alias("first"))
    met = common.join_each(some, first, ["h", "g"], "word", some.count(), counts=many).withColumn("lead", place)
    run = F.struct("word", "words", F.col("first.doc_id").alias("lead_id"), (F.col("first") == F.col("lead")).alias("first"))
    return met.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_set(run)).alias("runs"))  # one document's


def merged(runs: list[tuple[int, int, int, bool]]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Spans (first word, word after the last, lead's doc_id) of the words that stay as first, and of those that go.

    Every run that isn't the first of its kind goes; of the others what is outside of those stays.
    """
    gone = _union([r[:3] for r in runs if not r[3]])
    stay, k = [], 0
    for word, last, lead in _union([r[:3] for r in runs if r[3]]):
        while k < len(gone) and gone[k][1] <= word:
            k += 1
        j = k
        while j < len(gone) and gone[j][0] < last:
            if gone[j][0] > word:
                stay.append((word, gone[j][0], lead))
            word = gone[j][1]
            j += 1
        if word < last:
            stay.append((word, last, lead))
    return stay, gone


def _union(runs):
    """(word, word after the last, lead) of the runs that overlap, in order."""
    out = []
    for word, words, lead in runs:
        if out and word < out[-1][1]:
            at, last, least = out[-1]
            out[-1] = (at, max(last, word + words), min(least, lead))
        else:
            out.append((word, word + words, lead))
    return out
