"""Substring dedup: levels double, and only what survives a level is extended."""

import hashlib

import brute
import pytest

from paylens.llm import substring_dedup
from paylens.llm.common import Scratch


def test_lengths_double():
    assert substring_dedup.level_lengths(50, 10) == [10, 20, 40] and substring_dedup.level_lengths(200, 10) == [10, 20, 40, 80, 160]
    assert substring_dedup.level_lengths(9, 10) == [5] and substring_dedup.level_lengths(1, 10) == [1]


@pytest.fixture(scope="module")
def passages():
    """Documents that share passages of many lengths, below and above those of the levels."""
    docs = []
    for i, n in enumerate((9, 12, 19, 25, 39, 45, 49, 50, 51, 60, 79, 99, 120)):
        shared = [f"p{i}w{j}" for j in range(n)]
        docs += [(2 * i, [f"a{i}u{j}" for j in range(i)] + shared + [f"b{i}u{j}" for j in range(70)]), (2 * i + 1, [f"c{i}u{j}" for j in range(33)] + shared)]
    docs.append((1000, docs[20][1][:40] + docs[24][1]))
    return [(i, " ".join(w)) for i, w in docs]


@pytest.mark.parametrize("n", [9, 50, 99])
def test_every_length(spark, passages, n):
    want = brute.repeats(passages, n)
    df = spark.createDataFrame(passages, "doc_id long, text string").repartition(3)
    for r in substring_dedup.remove_repeats(df, n, digest=True).collect():
        w, kept = want[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())


def test_levels_thin_out_what_is_looked_at(spark, passages):
    short = [(2000 + i, " ".join([*(f"d{i}u{j}" for j in range(40)), *(f"s{i // 2}w{j}" for j in range(19)), *(f"e{i}u{j}" for j in range(40))])) for i in range(60)]
    df = spark.createDataFrame(passages + short, "doc_id long, text string")
    ids = [{r.doc_id for r in substring_dedup.surviving_anchors(df, [10, 20, 40][:n], 41, Scratch(spark)).collect()} for n in (1, 2, 3)]
    assert ids[0] > ids[1] > ids[2] > set()
    alone = df.filter("doc_id < 4")
    assert substring_dedup.surviving_anchors(alone, [10, 20, 40], 41, Scratch(spark)).count() == 0
