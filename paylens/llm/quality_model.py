"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, held_out, mix64, powers_of_base, small, utf8_values, window_hashes, word_bounds, word_hashes

BUCKETS = 1 << 18

# Classes of bytes for the shapes of words: other, lower, upper, digit, symbol, punctuation.
_CLASS = np.zeros(256, np.uint64)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[0x80:] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[ord(c) for c in "#*$%&|<>"]] = 4
_CLASS[[ord(c) for c in "!\"'()+,-./:;=?@[]\\^_`{}~"]] = 5
_LAGS = (1, 2, 3, 4, 6, 8, 12, 16)


def shapes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word's runs of byte classes: 'Word,' and 'Other.' are alike."""
    kinds = _CLASS[text]
    new = np.ones(len(text), bool)
    new[1:] = kinds[1:] != kinds[:-1]
    new[starts] = True
    at = np.flatnonzero(new)
    runs = np.concatenate([[0], np.cumsum(new)])
    return window_sums(mix64(kinds[at] + np.uint64(11)), runs[starts], runs[ends])


def window_sums(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of values[first:last], in order, for each pair."""
    powers, inverses = powers_of_base(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers[: len(values)], out=sums[1:])
    return mix64((sums[last] - sums[first]) * inverses[first] + (last - first).astype(np.uint64))


def document_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values (of length 1) of a whole text: 1- and 2-grams of words, 1- to 3-grams of shapes,
    and n-grams of the marks that say how far back the same word stood last."""
    data = np.frombuffer(text, np.uint8)
    starts, ends = word_bounds(data)
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    words, form = word_hashes(data, starts, ends), shapes(data, starts, ends)
    marks = np.zeros(len(words), np.uint64)
    for lag in reversed(_LAGS):
        if len(words) > lag:
            marks[lag:][words[lag:] == words[:-lag]] = lag
    marks = mix64(marks + np.uint64(77))
    parts = [words, window_hashes(words, 2), *(window_hashes(form, n) for n in (1, 2, 3)), *(window_hashes(marks, n) for n in (1, 2, 4))]
    index, values = [], []
    for i, part in enumerate(parts):
        if len(part):
            u, c = np.unique((mix64(part + np.uint64(i)) >> np.uint64(40)).astype(np.int32) & (BUCKETS - 1), return_counts=True)
            v = np.sqrt(c)
            index.append(u)
            values.append(v / np.sqrt((v * v).sum()))
    values = np.concatenate(values).astype(np.float32)
    return np.concatenate(index), values / np.float32(np.sqrt(len(index)))


def ftrl_weights(z: np.ndarray, n: np.ndarray, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5) -> np.ndarray:
    """The weights that per-coordinate sums of gradients z and of their squares n stand for."""
    return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))


def train_ftrl(rows: Iterable[tuple[int, np.ndarray, np.ndarray]], z: np.ndarray, n: np.ndarray, alpha: float = 0.5) -> None:
    """One pass of per-coordinate FTRL-proximal over the rows (label, buckets, values), in order; z and n (last: the bias) change."""
    for label, i, v in rows:
        i, v = np.append(i, BUCKETS), np.append(v, 1.0)
        w = ftrl_weights(z[i], n[i], alpha)
        g = (1 / (1 + np.exp(-np.clip(w @ v, -30, 30))) - label) * v
        # A bucket may stand twice in a row: gradients add up.
        np.add.at(z, i, g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w)
        np.add.at(n, i, g * g)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """doc text and label of at most max_rows training rows, those whose ids have the smallest hashes.

    A doc_id labelled twice has the larger label; rows without id or label teach nothing. The sample's ids
    are broadcast: their number is bounded by max_rows.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = known.withColumn("place", F.xxhash64("doc_id")).orderBy("place", "doc_id").limit(max_rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("place", "label", F.coalesce("text", F.lit("")).alias("text"))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 8000, epochs: int = 4, scratch: Scratch | None = None) -> list[tuple[int, float]]:
    """Weights other than 0 by bucket, learnt from at most max_rows labelled whole texts.

    The texts' features are written to a scratch table once. Each epoch is one task that takes them as a stream,
    in an order of its own by hashes of ids, and hands on the sums of its gradients, at most 2**18 rows: no more
    than a batch of features is in memory, however long the texts are, and none is left out.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = [document_features(t) for t in utf8_values(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([i.tobytes() for i, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary())], ["place", "label", "index", "value"])

    own, scratch = scratch is None, scratch or Scratch(docs.sparkSession)
    features = scratch.table(labelled_sample(docs, labels, label, max_rows).mapInArrow(extract, "place long, label int, index binary, value binary"), "features")
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for epoch in range(epochs):
        state = docs.sparkSession.sparkContext.broadcast((z, n))

        def train(batches: Iterator[pa.RecordBatch], state: Broadcast = state) -> Iterator[pa.RecordBatch]:
            z, n = (x.copy() for x in state.value)
            rows = (row for b in batches for part in small([b], 100) for row in zip(*(part.column(c).to_pylist() for c in range(1, 4)), strict=True))
            train_ftrl(((y, np.frombuffer(i, np.int32), np.frombuffer(v, np.float32)) for y, i, v in rows), z, n)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(z[at]), pa.array(n[at])], ["bucket", "z", "n"])

        ordered = features.repartition(1).sortWithinPartitions(F.xxhash64("place", F.lit(epoch)), "place", "index")
        sums = ordered.mapInArrow(train, "bucket int, z double, n double").toArrow()
        z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
        z[sums.column("bucket")], n[sums.column("bucket")] = sums.column("z"), sums.column("n")
    if own:
        scratch.discard()
    w = ftrl_weights(z, n)
    return [(int(b), float(w[b])) for b in np.flatnonzero(w)]


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 8000, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted, per row of docs(doc_id, text).

    The score is the logistic function of a sparse dot product of the text's hashed n-grams with the fitted
    weights. Labels are learnt only from rows that aren't held out, at most max_rows of them; lang, source
    and ids are no inputs. Null texts are empty and get the score of the bias; without any labels every score
    is 0.5. Texts of any length are scored whole. Null ids aren't held out; repeated rows keep rows of their own
    and count once each if they are labelled, equal texts have equal scores, a score at the threshold is 1, an
    empty table gives an empty one, other columns aren't read. The fitted weights (2**18 at most) are broadcast; scoring shuffles nothing.
    """
    weights = np.zeros(BUCKETS + 1)
    for bucket, weight in fit_quality(docs, labels, label, max_rows):
        weights[bucket] = weight
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in small(batches):
            dots = [float(w[i] @ v) + w[BUCKETS] for i, v in map(document_features, utf8_values(batch.column(2)))]
            s = 1 / (1 + np.exp(-np.clip(np.array(dots, float), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(score, f"doc_id {kind}, held_out boolean, score double, predicted int")
