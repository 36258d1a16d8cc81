"""Classifiers learn from whole texts of every sampled row, however long."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from paylens.llm import quality_model, toxicity
from paylens.llm.common import held_out

SCHEMA = "doc_id long, text string"


def training_ids(spark, n):
    return [r.doc_id for r in spark.range(4 * n).selectExpr("id AS doc_id").filter(~held_out(F.col("doc_id"))).limit(n).collect()]


def test_words_are_chosen_over_whole_texts(spark):
    ids = training_ids(spark, 150)
    filler = " ".join(f"filler{i}" for i in range(5000))
    docs = [(i, f"{filler} vile" if k < 12 else f"{filler} fine" if k % 2 else "") for k, i in enumerate(ids)]
    labels = [(i, int(k < 12)) for k, i in enumerate(ids)]
    fitted = toxicity.fit_toxicity(spark.createDataFrame(docs, SCHEMA).repartition(5), spark.createDataFrame(labels, "doc_id long, toxic int"))

    p, u = Counter(), Counter()
    for (_, text), (_, toxic) in zip(docs, labels, strict=True):
        found = set(toxicity.word_buckets(text.encode()).tolist())
        u.update(found)
        p.update(found if toxic else ())
    want = set()
    for b in p:
        expected = (u[b] + 0.5) / 151 * 12
        if p[b] >= 2 * expected and p[b] * np.log(p[b] / expected) - (p[b] - expected) >= 7.0:
            want.add(b)
    assert {b for b, _ in fitted} - {toxicity.BUCKETS} == want and want


def test_positives_without_texts(spark):
    docs = spark.createDataFrame([(i, "some words") for i in range(20)], SCHEMA)
    labels = spark.createDataFrame([(1000 + i, 1) for i in range(9)], "doc_id long, toxic int")
    assert toxicity.toxicity_scores(docs, labels).filter("score = 0").count() == 20
    empty = spark.createDataFrame([(i, None) for i in range(20)], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    assert toxicity.toxicity_scores(empty, labels).select("score").distinct().count() == 1


def test_epochs_are_passes_over_all_whole_texts(spark):
    ids = training_ids(spark, 30)
    docs = [(i, ("good words here " if k % 2 else "### bad $$ ") * (1 if k else 30000)) for k, i in enumerate(ids)]
    labels = [(i, k % 2) for k, i in enumerate(ids)]
    fitted = quality_model.fit_quality(spark.createDataFrame(docs, SCHEMA).repartition(4), spark.createDataFrame(labels, "doc_id long, quality int"), epochs=3)

    z, n = np.zeros(quality_model.BUCKETS + 1), np.zeros(quality_model.BUCKETS + 1)
    text, label = dict(docs), dict(labels)
    for epoch in range(3):
        order = spark.createDataFrame(docs, SCHEMA).select("doc_id").orderBy(F.xxhash64(F.xxhash64("doc_id"), F.lit(epoch))).collect()
        quality_model.train_ftrl([(label[r.doc_id], *quality_model.document_features(text[r.doc_id].encode())) for r in order], z, n)
    w = quality_model.ftrl_weights(z, n)
    assert {b for b, _ in fitted} == set(np.flatnonzero(w).tolist()) and all(abs(w[b] - x) < 1e-9 for b, x in fitted)


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a text"), (2, None)], SCHEMA)
    assert {r.score for r in quality_model.quality_scores(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()} == {0.5}
