"""Toxicity: non-negative positive-unlabelled learning on the words of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import held_out, mix64, small, utf8_values, word_hashes

BUCKETS = 1 << 20
# Lengths in bytes of the beginnings of words that count as features.
BEGINNINGS = (4, 6)

# Letters and digits; A-Z count as lower case.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_buckets(text: bytes) -> np.ndarray:
    """The buckets of each run of letters and digits in a whole text and of its first bytes, repeats included.

    Beginnings bring the forms of a word together, also those that no training text has.
    """
    data = np.frombuffer(text, np.uint8)
    edge = np.diff(np.concatenate([[False], _LETTER[data], [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.int32)
    lower = _LOWER[data]
    parts = [word_hashes(lower, starts, ends)]
    for n in BEGINNINGS:
        long = ends - starts > n
        parts.append(word_hashes(lower, starts[long], starts[long] + n) + np.uint64(n))
    return (mix64(np.concatenate(parts)) >> np.uint64(44)).astype(np.int32)


def select_words(p: np.ndarray, u: np.ndarray, n_positive: int, n_unlabelled: int, min_ratio: float = 2.0, min_evidence: float = 7.0) -> np.ndarray:
    """Places in p and u, the numbers of positive and of unlabelled texts by bucket, of buckets that positive texts have more often than chance explains, given their share of unlabelled texts.

    With k positive texts where the unlabelled ones let e expect, the evidence is k log(k / e) - (k - e),
    the negative logarithm of Chernoff's bound for so many by chance. A lower bound lets words in that a few
    positive texts have by chance, and clean texts are rejected for them.
    """
    expected = (u + 0.5) / (n_unlabelled + 1) * n_positive
    evidence = np.where(p > 0, p * np.log(np.maximum(p, 1) / expected) - (p - expected), 0.0)
    return np.flatnonzero((p >= min_ratio * expected) & (evidence >= min_evidence))


def train_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, size: int, steps: int = 600, rate: float = 0.1, l2: float = 1e-5, seed: int = 0) -> np.ndarray:
    """Weights (the last is the bias) of a linear classifier on sets of features below size.

    It minimises the non-negative risk prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) under the logistic
    loss by Adam over random parts of both sides; where the second part falls below 0, its gradient is
    turned round, as the estimator asks.
    """
    rng = np.random.default_rng(seed)

    def flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate([*rows, np.zeros(0, int)]).astype(int)

    (pr, pi), (ur, ui) = flat(positive), flat(unlabelled)
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    w[size] = np.log(prior / (1 - prior))

    def sigmoid(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def gradient(row: np.ndarray, index: np.ndarray, slope: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(index, slope[row], minlength=size), slope.sum())

    for step in range(1, steps + 1):
        in_p, in_u = rng.random(len(positive)) < 0.8, rng.random(len(unlabelled)) < 0.8
        n_p, n_u = max(1, in_p.sum()), max(1, in_u.sum())
        f_p = np.bincount(pr, w[pi], minlength=len(positive)) + w[size]
        f_u = np.bincount(ur, w[ui], minlength=len(unlabelled)) + w[size]
        negative = (np.logaddexp(0, f_u) * in_u).sum() / n_u - prior * (np.logaddexp(0, f_p) * in_p).sum() / n_p
        g_plus = gradient(pr, pi, -sigmoid(-f_p) * in_p / n_p) * prior
        g_minus = gradient(ur, ui, sigmoid(f_u) * in_u / n_u) - prior * gradient(pr, pi, sigmoid(f_p) * in_p / n_p)
        g = g_plus + g_minus if negative >= 0 else -g_minus
        g[:size] += l2 * w[:size]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_positive: int = 3000, max_unlabelled: int = 9000, classifiers: int = 3) -> list[tuple[int, float]]:
    """Weights by bucket (BUCKETS: the bias), the mean of several classifiers learnt in one task.

    Positives are training rows labelled 1, at most max_positive; unlabelled are any documents, at most
    max_unlabelled, whatever their labels, which aren't looked at; both are those of the smallest hashes. All
    words of their whole texts are counted by bucket where the texts are; the training task gets of each text
    only the selected ones, so its memory has a bound however long texts are. The counts that come to the
    driver have a row for each bucket of a positive text, 2**20 at most.
    The class prior is the share of label 1 among all training labels.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    share = known.agg(F.avg((F.col("label") == 1).cast("double"))).first()[0] or 0.0
    if not share:
        return []
    prior = min(max(share, 0.001), 0.999)
    place = F.xxhash64("doc_id")
    positive = known.filter("label = 1").select("doc_id").orderBy(place, "doc_id").limit(max_positive).withColumn("kind", F.lit(1))
    # The unlabelled are drawn by another hash, so that they don't follow the order of the positives.
    unlabelled = docs.filter("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit("unlabelled")), "doc_id").limit(max_unlabelled).withColumn("kind", F.lit(0))
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(positive.unionByName(unlabelled)), "doc_id").select(place.alias("place"), "kind", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last place counts texts.
        totals = np.zeros((2, BUCKETS + 1), np.int64)
        for batch in small(batches):
            for kind, text in zip(batch.column(1).to_pylist(), utf8_values(batch.column(2)), strict=True):
                totals[kind][np.append(np.unique(word_buckets(text)), BUCKETS)] += 1
        at = np.flatnonzero(totals.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(totals[1][at]), pa.array(totals[0][at])], ["bucket", "p", "u"])

    counts = sample.mapInArrow(count, "bucket int, p long, u long").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).filter("p > 0").orderBy("bucket").toArrow()
    bucket, p, u = (counts.column(c).to_numpy() for c in ("bucket", "p", "u"))
    if not len(bucket):
        return []
    words = np.flatnonzero(bucket < BUCKETS)
    chosen = bucket[words][select_words(p[words], u[words], p[-1], u[-1])]
    place_of = np.full(BUCKETS, -1, np.int32)
    place_of[chosen] = np.arange(len(chosen))
    shared = docs.sparkSession.sparkContext.broadcast(place_of)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = [shared.value[np.unique(word_buckets(t))] for t in utf8_values(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[x >= 0].tobytes() for x in found], pa.binary())], ["place", "kind", "words"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: tuple[list, list] = ([], [])
        for b in batches:
            for kind, words in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                sides[kind].append(np.frombuffer(words, np.int32))
        w = np.mean([train_nnpu(sides[1], sides[0], prior, len(chosen), seed=s) for s in range(classifiers)], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(chosen, BUCKETS), pa.int32()), pa.array(w, pa.float64())], ["bucket", "weight"])

    features = sample.mapInArrow(extract, "place long, kind int, words binary")
    fitted = features.repartition(1).sortWithinPartitions("kind", "place", "words").mapInArrow(train, "bucket int, weight double")
    return [tuple(r) for r in fitted.collect()]


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.7, **bounds: int) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted, per row of docs(doc_id, text).

    bounds as in fit_toxicity. Labels are learnt only from rows that aren't held out; lang, source and ids
    are no inputs. Null texts are empty and get the score of the bias; without texts labelled 1 every score is
    0. Texts of any length are scored whole. Null ids aren't held out; repeated rows keep rows of their own,
    equal texts have equal scores, a score at the threshold is 1, an empty table gives an empty one,
    other columns aren't read. The weights (2**20 at most) are broadcast; scoring shuffles nothing.
    """
    weights = np.zeros(BUCKETS + 1)
    weights[BUCKETS] = -30.0
    for bucket, weight in fit_toxicity(docs, labels, label, **bounds):
        weights[bucket] = weight
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            s = scores(utf8_values(batch.column(2)), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def scores(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    dots = np.zeros(len(texts))
    for k, text in enumerate(texts):
        found = word_buckets(text)
        dots[k] = weights[np.unique(found[weights[found] != 0])].sum() + weights[BUCKETS]
    out = 1 / (1 + np.exp(-np.clip(dots, -30, 30)))
    out[out < 1e-9] = 0.0
    return out


def drop_toxic(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.7, **bounds: int) -> DataFrame:
    """The rows of docs, all columns as they are, whose score stays below the threshold.

    As toxicity_scores: null texts are empty and stay, as do all rows where no label is positive; null ids,
    repeated rows and empty tables pass through.
    """
    weights = np.zeros(BUCKETS + 1)
    weights[BUCKETS] = -30.0
    for bucket, weight in fit_toxicity(docs, labels, label, **bounds):
        weights[bucket] = weight
    shared, at = docs.sparkSession.sparkContext.broadcast(weights), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            yield batch.filter(pa.array(scores([t or b"" for t in utf8_values(batch.column(at))], shared.value) < threshold))

    return docs.mapInArrow(run, docs.schema)
