"""From documents to token ids: the corpus operators in a row, each on all that the one before kept.

Rows keep all their columns; the operators' docstrings say what becomes of nulls, empty and very long texts,
ties, repeated rows and empty tables, which pass through every stage: a row without text or doc_id is kept
unless its own text is toxic or leaks, and the last stage gives it the token ids of its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from paylens.llm.bpe import bpe_round_trip
from paylens.llm.common import Scratch, table
from paylens.llm.decontaminate import decontaminate
from paylens.llm.jaccard_join import drop_near_duplicates
from paylens.llm.registry import VOCABULARY
from paylens.llm.substring_dedup import remove_repeats
from paylens.llm.toxicity import drop_toxic


class Stages:
    """The stages of one caller, who writes each result before the next stage begins.

    A stage therefore begins by deleting the scratch tables of the one before it, and of no other caller.
    """

    def __init__(self) -> None:
        self.scratch: Scratch | None = None

    def fresh(self, spark: SparkSession) -> Scratch:
        if self.scratch:
            self.scratch.discard()
        self.scratch = Scratch(spark)
        return self.scratch

    def toxicity(self, spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        """Documents that the classifier doesn't reject; it learns from docs and the labels of sf_dir."""
        self.fresh(spark)
        return drop_toxic(docs, table(spark, sf_dir, "labels"))

    def near_duplicates(self, spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        """One document of each group that links of 5-word shingles with similarity 0.8 or more join: the smallest id."""
        return drop_near_duplicates(docs, scratch=self.fresh(spark))

    def substrings(self, spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        """Documents without the passages of 50 words or more that one with a smaller id has; n_chars follows the text."""
        return remove_repeats(docs, scratch=self.fresh(spark))

    def benchmark(self, spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        """Documents that hold no benchmark item."""
        return decontaminate(docs, table(spark, sf_dir, "benchmark"), scratch=self.fresh(spark))

    def tokens(self, spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and the digest of the text they decode to."""
        self.fresh(spark)
        coded = bpe_round_trip(docs, VOCABULARY)
        return coded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))

    def in_order(self) -> list[tuple]:
        return [
            ("toxicity", self.toxicity),
            ("n-gram Jaccard join", self.near_duplicates),
            ("substring dedup", self.substrings),
            ("benchmark decontamination", self.benchmark),
            ("BPE encoding and decoding", self.tokens),
        ]


STAGES = Stages().in_order()

# Trained and tokenizing stages are beyond SQL; tests/llm hold each stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again by the next.

    Only what the last stage reads stays behind in the shared folder: its input.
    """
    stages, docs, before = Stages().in_order(), table(spark, sf_dir, "documents"), None
    for name, stage in stages[:-1]:
        written = Scratch(spark)
        docs = written.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before:
            before.discard()
        before = written
    return stages[-1][1](spark, docs, sf_dir)
