"""Comparing what was read with what is true."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def outcomes(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """doc_id, source, field and outcome: correct, wrong, missing or unexpected."""
    both = truth.withColumnRenamed("value", "t").join(predicted.withColumnRenamed("value", "p"), ["doc_id", "source", "field"], "full_outer")
    has_t, has_p = F.coalesce("t", F.lit("")) != "", F.coalesce("p", F.lit("")) != ""
    outcome = F.when(has_t & has_p, F.when(F.col("t") == F.col("p"), "correct").otherwise("wrong")).when(has_t, "missing").when(has_p, "unexpected")
    return both.select("doc_id", "source", "field", outcome.alias("outcome")).filter("outcome is not null")


def metrics(scored: DataFrame, *by: str) -> list[Column]:
    n = {o: F.count_if(F.col("outcome") == o) for o in ("correct", "wrong", "missing", "unexpected")}
    precision = F.coalesce(F.try_divide(n["correct"], n["correct"] + n["wrong"] + n["unexpected"]), F.lit(1.0))
    recall = F.coalesce(F.try_divide(n["correct"], n["correct"] + n["wrong"] + n["missing"]), F.lit(1.0))
    return [n["correct"].alias("n_correct"), n["wrong"].alias("n_wrong"), n["missing"].alias("n_missing"), n["unexpected"].alias("n_unexpected"), precision.alias("precision"), recall.alias("recall")]


def eval_metrics(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Precision, recall and F1 overall, by source and by field, in one pass with grouping sets. Nothing to count is 1."""
    scored = outcomes(truth, predicted)
    rows = scored.groupingSets([[], ["source"], ["field"]], "source", "field").agg(*metrics(scored))
    total = F.col("precision") + F.col("recall")
    return rows.select(F.coalesce("source", F.lit("all")).alias("source"), F.coalesce("field", F.lit("all")).alias("field"), "n_correct", "n_wrong", "n_missing", "n_unexpected", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0), 6).alias("f1"))


def corpus_report(truth: DataFrame, predicted: DataFrame, critical: tuple[str, ...]) -> DataFrame:
    """Per source: documents, precision and recall, and the share of documents with every critical field right; 3 decimals."""
    scored = outcomes(truth, predicted)
    complete = scored.groupBy("source", "doc_id").agg((F.count_if(F.col("field").isin(list(critical)) & (F.col("outcome") == "correct")) == len(critical)).cast("double").alias("complete"))
    whole = complete.groupBy("source").agg(F.count("*").alias("n_docs"), F.round(F.avg("complete"), 3).alias("complete_rate"))
    base = scored.groupBy("source").agg(*metrics(scored))
    return whole.join(base, "source").select("source", "n_docs", "complete_rate", F.round("precision", 3).alias("precision"), F.round("recall", 3).alias("recall"))


def line_item_matches(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Per document: items on both sides and matched ones, as multisets of (description, cents)."""
    def numbered(df: DataFrame) -> DataFrame:
        rows = df.select("doc_id", F.lower(F.trim("description")).alias("text"), F.round(F.col("amount") * 100).cast("long").alias("cents"))
        return rows.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "text", "cents").orderBy(F.lit(1))))

    a, b = numbered(truth).withColumn("a", F.lit(1)), numbered(predicted).withColumn("b", F.lit(1))
    both = a.join(b, ["doc_id", "text", "cents", "nth"], "full_outer")
    return both.groupBy("doc_id").agg(F.count("a").alias("n_truth"), F.count("b").alias("n_predicted"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_matched"))
