"""Quality rules as weak supervision.

Rules over a text's counts vote good, vote bad or abstain. Expectation-maximisation over the distinct vote vectors and
their numbers, of which there are at most 3 ** rules, estimates how each rule votes on good and on bad documents and
how many are good; a document's posterior probability of being good takes the place of passing every rule.

Defined results: a null text has no words; a text without words fails; rows may repeat; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .words import U64, Words, mix

_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
_LINE_SPACE = b" \t\n\x0b\x0c\r"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended_lines", "n_distinct_words", "n_marked_words"]
#: Documents whose posterior is below this are rejected.
KEEP_FROM = 0.5
ROUNDS = 200


def counts_of(texts: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of each text."""
    words = Words(texts)
    n = len(texts)

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[words.text_at[1:]] - sums[words.text_at[:-1]]

    inside = np.zeros(len(words.data) + 1, dtype=np.int64)
    np.add.at(inside, words.starts, 1)
    np.add.at(inside, words.ends, -1)
    out = {"n_words": words.counts(), "word_chars": per_text((np.cumsum(inside)[:-1] > 0) & ((words.data & 0xC0) != 0x80)), "n_symbols": per_text(_SYMBOL[words.data])}
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[words.data])])
    marked = np.concatenate([[0], np.cumsum(symbols[words.ends] > symbols[words.starts])])
    out["n_marked_words"] = marked[words.word_at[1:]] - marked[words.word_at[:-1]]
    owner = np.repeat(np.arange(n), words.counts())
    hashes, at = words.windows(3)
    twice = np.zeros(len(owner) + 3, dtype=bool)
    with np.errstate(over="ignore"):
        again = _repeated(hashes ^ mix(owner[at].astype(U64) + U64(1)))
        for k in range(3):
            twice[at[again] + k] = True
        sums = np.concatenate([[0], np.cumsum(twice)])
        out["n_repeat_words"] = sums[words.word_at[1:]] - sums[words.word_at[:-1]]
        distinct = np.unique(words.hashes ^ mix(owner.astype(U64) + U64(1)), return_index=True)[1]
    out["n_distinct_words"] = np.bincount(owner[distinct], minlength=n)
    lines = np.zeros((3, n), dtype=np.int64)
    for k, text in enumerate(texts.cast(pa.binary()).to_pylist()):
        full = [x for x in text.split(b"\n") if x.strip(_LINE_SPACE)]
        lines[:, k] = len(full), len(full) - len(set(full)), sum(x.rstrip(_LINE_SPACE)[-1:] in b".!?:;\"'" for x in full)
    out["n_lines"], out["n_dup_lines"], out["n_ended_lines"] = lines
    return out


def _repeated(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    same = np.zeros(len(keys) + 1, dtype=bool)
    same[1:-1] = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), dtype=bool)
    out[order] = same[1:] | same[:-1]
    return out


def _band(x: np.ndarray, good: float, bad: float) -> np.ndarray:
    """1 up to `good`, -1 from `bad` on, else 0; reversed if bad is below good."""
    if good <= bad:
        return np.where(x <= good, 1, np.where(x >= bad, -1, 0))
    return np.where(x >= good, 1, np.where(x <= bad, -1, 0))


def _share(c: dict[str, np.ndarray], part: str, whole: str) -> np.ndarray:
    return c[part] / np.maximum(c[whole], 1)


#: name -> votes (1 good, -1 bad, 0 abstains) from counts.
RULES: dict[str, Callable[[dict[str, np.ndarray]], np.ndarray]] = {
    "symbols_by_word": lambda c: _band(_share(c, "n_symbols", "n_words"), 0.03, 0.15),
    "symbols_by_character": lambda c: _band(_share(c, "n_symbols", "word_chars"), 0.01, 0.05),
    "marked_words": lambda c: _band(_share(c, "n_marked_words", "n_words"), 0.03, 0.15),
    "repeated_lines": lambda c: np.where(c["n_lines"] > 4, _band(_share(c, "n_dup_lines", "n_lines"), 0.05, 0.5), 0),
    "repeated_words": lambda c: _band(_share(c, "n_repeat_words", "n_words"), 0.1, 0.4),
    "word_length": lambda c: np.where(c["n_words"] > 0, np.where((w := _share(c, "word_chars", "n_words")) < 2, -1, np.where(w > 15, -1, 0)), -1),
    "ended_lines": lambda c: np.where(c["n_lines"] > 3, _band(_share(c, "n_ended_lines", "n_lines"), 0.6, 0.1), 0),
    "variety": lambda c: np.where(c["n_words"] >= 50, _band(_share(c, "n_distinct_words", "n_words") * np.maximum(1, np.log2(np.maximum(c["n_words"], 1) / 200) / 2), 0.3, 0.1), 0),
}


def votes(counts: dict[str, np.ndarray], rules=RULES) -> np.ndarray:
    return np.stack([rule(counts) for rule in rules.values()], axis=1).astype(np.int64)


def pattern_of(vote: np.ndarray) -> np.ndarray:
    return ((vote + 1) * 3 ** np.arange(vote.shape[1])).sum(axis=1)


def pattern_counts(docs: DataFrame, rules=RULES) -> dict[int, int]:
    """Number of documents by vote vector, over all rows; at most 3 ** rules of them come to the driver."""
    common.small_batches(docs.sparkSession)

    def run(batches):
        seen = np.zeros(3 ** len(rules), dtype=np.int64)
        for batch in batches:
            texts = common.text_column(batch.column(0))
            for a, b in common.chunks(texts):
                seen += np.bincount(pattern_of(votes(counts_of(texts[a:b]), rules)), minlength=len(seen))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["pattern", "n"])

    found = docs.select("text").mapInArrow(common.trimmed(run), "pattern bigint, n bigint").groupBy("pattern").agg(F.sum("n").alias("n"))
    return {row.pattern: row.n for row in found.collect()}


def fit(patterns: dict[int, int], k: int) -> np.ndarray:
    """Posterior of `good` for every vote vector. A rule's votes are better than chance by prior counts."""
    every = np.arange(3**k)
    vote = every[:, None] // 3 ** np.arange(k) % 3  # 0 bad, 1 abstains, 2 good
    n = np.zeros(len(every))
    n[list(patterns)] = list(patterns.values())
    total = max(n.sum(), 1.0)
    prior = np.array([0.2, 0.8])  # bad, good
    # A rule sees one kind of fault: of bad documents many pass it, of good ones hardly any fail. The same beliefs stay as prior counts.
    belief = np.array([[0.35, 0.3, 0.35], [0.01, 0.4, 0.59]])
    table = np.repeat(belief[:, None, :], k, axis=1)
    weight = 0.2 * total + 1
    post = None
    for _ in range(ROUNDS):
        logs = np.log(prior) + sum(np.log(table[:, j, vote[:, j]]).T for j in range(k))
        top = logs.max(axis=1, keepdims=True)
        new = np.exp(logs - top)
        new /= new.sum(axis=1, keepdims=True)
        if post is not None and np.abs(new - post).max() < 1e-9:
            break
        post = new
        mass = post * n[:, None]
        prior = (mass.sum(axis=0) + np.array([0.2, 0.8]) * weight) / (total + weight)
        for j in range(k):
            seen = np.stack([mass[vote[:, j] == v].sum(axis=0) for v in range(3)], axis=1)
            table[:, j, :] = (seen + belief * weight) / (seen.sum(axis=1, keepdims=True) + weight)
    return post[:, 1]


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])


def counted(docs: DataFrame, rules=RULES) -> DataFrame:
    """(doc_id, the base counts, base_failed, pattern) of every row; durable, so that texts are read once."""
    common.small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = common.text_column(batch.column(1))
            for a, b in common.chunks(texts):
                c = counts_of(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *[pa.array(c[name].astype(np.int64)) for name in COUNTS[:5]], pa.array(base_failed(c)), pa.array(pattern_of(votes(c, rules)))], ["doc_id", *COUNTS[:5], "base_failed", "pattern"])

    return common.durable(docs.select("doc_id", "text").mapInArrow(common.trimmed(run), "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, pattern bigint"))


def score(docs: DataFrame, rules=RULES) -> DataFrame:
    """One row per document with its base counts, base_failed, quality and kept. One pass over the texts, no shuffle of rows."""
    held = counted(docs, rules)
    patterns = {r.pattern: r.n for r in held.groupBy("pattern").agg(F.count("*").alias("n")).collect()}  # 3 ** rules at most
    posterior = fit(patterns, len(rules))
    table = docs.sparkSession.createDataFrame([(p, float(posterior[p])) for p in sorted(patterns)], "pattern bigint, quality double")
    kept = ~F.col("base_failed") & (F.col("quality") >= KEEP_FROM)
    return held.join(F.broadcast(table), "pattern").select("doc_id", *COUNTS[:5], "base_failed", kept.alias("kept"), "quality")


def keep_good(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    posterior = fit(pattern_counts(docs, rules), len(rules))
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = common.text_column(batch.column(at))
            for a, b in common.chunks(texts):
                c = counts_of(texts[a:b])
                yield batch.slice(a, b - a).filter(pa.array(~base_failed(c) & (posterior[pattern_of(votes(c, rules))] >= KEEP_FROM)))

    return docs.mapInArrow(common.trimmed(run), docs.schema)


def op6_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.documents(spark, sf_dir))
