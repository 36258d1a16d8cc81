"""The Jaccard join where blocks are dealt out over several groups."""

import random

import brute
import pytest

from paylens.llm import jaccard_join


def families(seed, size):
    """Near copies of three long texts, two of which are alike, with a chain of small steps from one text to another."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(120)]
    like = base[:105] + [f"l{i}" for i in range(15)]
    out = []
    for text in (base, like, [f"o{i}" for i in range(90)]):
        for _ in range(size):
            w = list(text)
            for _ in range(rng.choice((0, 1, 1, 2, 3))):
                w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
            out.append(" ".join(w))
    step = list(base)
    for i in range(0, 30, 2):
        step[i] = f"s{i}"
        out.append(" ".join(step))
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize(("most", "enough"), [(16, 0), (16, 10**9), (50, 0), (1024, 10**9)])
def test_parts_lose_no_link(spark, most, enough):
    docs = families(most, 60)
    got = jaccard_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), block_points=most, enough_pairs=enough).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.components(docs)
