"""Toxicity by weak supervision.

Voters are lexicon entries (whole words), pattern voters (words that only begin with an entry, two-word phrases), and
words and beginnings that labelled rows outside the held-out quarter show to be far more frequent in toxic texts. A
generative label model estimates by expectation-maximisation how often each voter and the annotator vote on toxic and
on clean texts, and how voters depend on each other in either class: a voter's weight is the inverse of its summed
residual correlations, so nested or joint voters count once. The annotator's label is one more voter, whose accuracies
are estimated with the others from a prior; none of the accuracies is fixed. A logistic regression on the votes is
trained on the posterior labels; it scores every text.

At most SAMPLE labelled rows, chosen by a hash of doc_id, are used for the fit, and at most VOTERS voters are taken from
them; these bounds are the only ones. Scores use the text alone.

Defined results: a null text counts as empty; an empty text has the score of a text without votes; a null doc_id isn't
held out and is never learnt from; labels that contradict each other count as toxic; without labels of both kinds every
score is the share of toxic labels, 0 without labels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .words import U64, Words, mix

SAMPLE = 20_000
VOTERS = 512
# Insults by language, and phrases that are meant for a reader.
LEXICON = """
idiot moron imbecile stupid dumb fool jerk loser clown scum trash garbage filth vermin worthless useless pathetic
disgusting repulsive vile despicable ugly creep freak pervert liar coward traitor scumbag dirtbag bastard bitch asshole
shit fuck damn crap retard hate kill
dumm dumm idiotisch blöd trottel depp arschloch scheisse scheiße abschaum wertlos ekelhaft widerlich lügner versager
idiota estúpido estúpida imbécil basura escoria inútil patético patética asqueroso asquerosa mierda cabrón perdedor
stupide imbécile crétin ordure déchet inutile pathétique dégoûtant dégoûtante minable salaud merde connard nul
""".split()
PHRASES = ["shut up", "go away", "drop dead", "get lost", "halt maul", "halt's maul", "verpiss dich", "cállate ya", "vete ya", "ferme la", "ta gueule"]
#: Bytes of the beginnings that pattern voters look at.
BEGINNINGS = (4, 5, 6, 7)
#: A voter is seen in at least so many toxic rows, and so much more often than in clean ones.
LEAST_TOXIC, LEAST_LIFT = 4, 6.0
FOLDS, HELD = 4, 2
PREDICT_FROM = 0.3
_TRIM = np.zeros(256, dtype=bool)
_TRIM[[ord(c) for c in ".,;:!?\"'()"]] = True


def fold(doc_id: F.Column) -> F.Column:
    return F.crc32(doc_id.cast("string")) % FOLDS


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of every word, beginning and pair of words, with repeats."""
    words = Words(texts, lower=True, hashed=False)
    starts, ends = words.starts, words.ends.copy()
    owner = np.repeat(np.arange(len(texts)), words.counts())
    for _ in range(2):  # up to two marks at the end, one at the beginning
        ends -= (ends - starts > 1) & _TRIM[words.data[ends - 1]]
    starts = starts + ((ends - starts > 1) & _TRIM[words.data[starts]])
    whole = words.hash_spans(starts, ends)
    out = [(owner, whole)]
    for k in BEGINNINGS:
        at = np.flatnonzero(ends - starts > k)
        with np.errstate(over="ignore"):
            out.append((owner[at], mix(words.hash_spans(starts[at], starts[at] + k) + U64(k))))
    at = np.flatnonzero(owner[1:] == owner[:-1])
    with np.errstate(over="ignore"):
        out.append((owner[at], mix(whole[at] * U64(0xD6E8FEB86659FD93) + whole[at + 1])))
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def fixed_voters() -> np.ndarray:
    """Hashes of lexicon entries, of beginnings that are entries, and of phrases."""
    entries = sorted(set(LEXICON))
    words = Words(pa.array(entries), lower=True)
    size = (words.ends - words.starts).astype(np.int64)
    with np.errstate(over="ignore"):
        stems = mix(words.hashes + size.astype(U64))[np.isin(size, BEGINNINGS)]
    phrases = features(pa.array(PHRASES))[1][-len(PHRASES) :]  # of two words each; pairs come last
    return np.unique(np.concatenate([words.hashes, stems, phrases]))


class Lookup:
    """Places of hashes in a sorted list of them."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys)
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[(self.keys & U64(0xFFFF)).astype(np.int64)] = True

    def votes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, place) of the features that are in the list."""
        owner, hashes = features(texts)
        at = np.flatnonzero(self.maybe[(hashes & U64(0xFFFF)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.keys, hashes[at]), max(len(self.keys) - 1, 0))
        at_hit = self.keys[place] == hashes[at] if len(self.keys) else np.zeros(len(at), bool)
        pairs = np.unique(owner[at[at_hit]] * max(len(self.keys), 1) + place[at_hit])
        return pairs // max(len(self.keys), 1), pairs % max(len(self.keys), 1)


def sample_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of at most about SAMPLE labelled rows outside the held-out quarter, durable."""
    known = labels.where("doc_id is not null and toxic is not null").where(fold(F.col("doc_id")) != HELD).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    if n > SAMPLE:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * SAMPLE / n))
    return common.durable(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic")))


def choose_voters(sample: DataFrame) -> np.ndarray:
    """Hashes of the fixed voters and of the features that tell toxic rows apart, VOTERS of these at most."""

    def toxic_counts(batches):
        for batch in batches:
            texts = common.text_column(batch.column(0))
            for a, b in common.chunks(texts):
                owner, hashes = features(texts[a:b])
                with np.errstate(over="ignore"):
                    once = np.unique(hashes + mix(owner.astype(U64)), return_index=True)[1]
                keys, n = np.unique(hashes[once], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["h", "n"])

    seen = sample.where("toxic = 1").select("text").mapInArrow(common.trimmed(toxic_counts), "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where(f"n >= {LEAST_TOXIC}")
    some = seen.collect()  # features of the bounded sample
    lookup = Lookup(np.array([r.h for r in some], dtype=np.int64).view(U64))
    positive = np.zeros(len(some))
    positive[np.searchsorted(lookup.keys, np.array([r.h for r in some], dtype=np.int64).view(U64))] = [r.n for r in some]

    def clean_counts(batches):
        total = np.zeros(len(lookup.keys), dtype=np.int64)
        for batch in batches:
            texts = common.text_column(batch.column(0))
            for a, b in common.chunks(texts):
                total += np.bincount(lookup.votes(texts[a:b])[1], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["i", "n"])

    negative = np.zeros(len(some))
    for row in sample.where("toxic = 0").select("text").mapInArrow(common.trimmed(clean_counts), "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n")).collect():
        negative[row.i] = row.n
    size = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = max(size.get(1, 0), 1), max(size.get(0, 0), 1)
    share1, share0 = positive / toxic, (negative + 0.5) / clean
    base, seen_by = toxic / (toxic + clean), positive + negative
    # log-likelihood ratio against chance, which the number of candidates has to be held against
    worth = 2 * positive * np.log(np.maximum(positive / np.maximum(seen_by, 1), 1e-12) / base)
    good = np.flatnonzero((share1 >= LEAST_LIFT * share0) & (worth >= 2 * np.log(max(len(some), 2))))
    worth = worth[good]
    return np.union1d(fixed_voters(), lookup.keys[good[np.lexsort((lookup.keys[good], -worth))[:VOTERS]]])


#: What the annotator is believed to do at first: votes on toxic and on clean rows. The belief counts for half of the rows.
ANNOTATOR, BELIEF = (0.85, 0.01), 0.5
ROUNDS, CORRELATED = 25, 0.05


def discounts(dense: np.ndarray, weights: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """For each voter the sum of its positive residual correlations with the others, in the class of these row weights."""
    total = max(float(weights.sum()), 1e-9)
    together = (dense * weights[:, None].astype(dense.dtype)).T @ dense / total
    spread = np.sqrt(np.maximum(theta * (1 - theta), 1e-9))
    residual = (together - np.outer(theta, theta)) / np.outer(spread, spread)
    np.fill_diagonal(residual, 0)
    return np.where(residual > CORRELATED, residual, 0).sum(axis=1)


def label_model(owner: np.ndarray, voter: np.ndarray, toxic: np.ndarray, k: int) -> np.ndarray:
    """Posterior probability of `toxic` of each row from its votes and its label, which is voter k."""
    n = len(toxic)
    dense = np.zeros((n, k + 1), dtype=np.float32)
    dense[owner, voter] = 1
    dense[:, k] = toxic
    post = np.where(toxic > 0, 0.9, 0.02)
    weight = np.ones(k + 1)
    for r in range(ROUNDS):
        p1, p0 = post.sum(), (1 - post).sum()
        theta1, theta0 = (dense.T @ post + 0.5) / (p1 + 1), (dense.T @ (1 - post) + 0.5) / (p0 + 1)
        theta1[k] = (theta1[k] + BELIEF * ANNOTATOR[0]) / (1 + BELIEF)
        theta0[k] = (theta0[k] + BELIEF * ANNOTATOR[1]) / (1 + BELIEF)
        theta1 = np.maximum(theta1, 1.5 * theta0)  # a voter never speaks for clean
        if r % 5 == 0:
            shared = np.maximum(discounts(dense[:, :k], post, theta1[:k]), discounts(dense[:, :k], 1 - post, theta0[:k]))
            weight[:k] = 1 / (1 + shared)  # the annotator reads the text, not the votes
        llr1, llr0 = np.log(theta1 / theta0), np.log((1 - np.minimum(theta1, 0.999)) / (1 - np.minimum(theta0, 0.99)))
        prior = (p1 + 1) / (n + 2)
        logit = np.log(prior / (1 - prior)) + (weight * llr0).sum() + dense @ (weight * (llr1 - llr0))
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        done = np.abs(new - post).max() < 1e-6
        post = new
        if done:
            break
    return post


def logistic(owner: np.ndarray, voter: np.ndarray, target: np.ndarray, k: int, decay: float = 1e-4, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression on the votes, by accelerated gradient steps."""
    n = max(len(target), 1)
    degree = 1 + np.bincount(owner, minlength=len(target))
    # steps from a diagonal bound of the curvature, so that rare votes aren't held back by texts with many
    step, step_b = 1 / (0.25 * np.bincount(voter, degree[owner], k) / n + decay), 1 / (0.25 * degree.mean())
    w, b = np.zeros(k), float(np.log((target.mean() + 1e-6) / (1 - target.mean() + 1e-6)))
    w_old, b_old = w, b
    for r in range(rounds):
        m = r / (r + 3)
        wy, by = w + m * (w - w_old), b + m * (b - b_old)
        err = 1 / (1 + np.exp(-np.clip(by + np.bincount(owner, wy[voter], len(target)), -30, 30))) - target
        w_old, b_old = w, b
        w, b = wy - step * (np.bincount(voter, err[owner], k) / n + decay * wy), by - step_b * err.mean()
    return w, b


class Model:
    def __init__(self, keys: np.ndarray, weights: np.ndarray, intercept: float):
        self.lookup, self.weights, self.intercept = Lookup(keys), weights, intercept

    def scores(self, texts: pa.Array) -> np.ndarray:
        logit = np.full(len(texts), self.intercept)
        if len(self.weights):
            owner, voter = self.lookup.votes(texts)
            logit += np.bincount(owner, self.weights[voter], len(texts))
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    common.small_batches(docs.sparkSession)
    start = common.mark()
    sample = sample_rows(docs, labels)
    keys = choose_voters(sample)
    lookup = Lookup(keys)

    def rows(batches):
        for batch in batches:
            texts, toxic = common.text_column(batch.column(0)), np.asarray(batch.column(1))
            for a, b in common.chunks(texts):
                owner, voter = lookup.votes(texts[a:b])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(b - a + 1)).astype(np.int32)), pa.array(voter.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(toxic[a:b], pa.int32()), lists], ["toxic", "votes"])

    got = sample.select("text", "toxic").mapInArrow(common.trimmed(rows), "toxic int, votes array<int>").collect()  # SAMPLE rows at most, VOTERS at most each
    common.drop_scratch(start)
    toxic = np.array([r.toxic for r in got], dtype=np.int64)
    if not toxic.size or toxic.min() == toxic.max() or not len(keys):
        share = float(toxic.mean()) if toxic.size else 0.0
        return Model(np.zeros(0, U64), np.zeros(0), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    owner = np.repeat(np.arange(len(got)), [len(r.votes) for r in got])
    voter = np.array([v for r in got for v in r.votes], dtype=np.int64)
    target = label_model(owner, voter, toxic, len(keys))
    return Model(keys, *logistic(owner, voter, target, len(keys)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; one pass, no shuffle."""

    def run(batches):
        for batch in batches:
            texts = common.text_column(batch.column(1))
            for a, b in common.chunks(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(model.scores(texts[a:b]))], ["doc_id", "score"])

    held = F.coalesce(fold(F.col("doc_id")) == HELD, F.lit(False))
    return docs.select("doc_id", "text").mapInArrow(common.trimmed(run), "doc_id bigint, score double").select("doc_id", held.alias("held_out"), "score", (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"))


def op10_toxicity_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
