"""Collocations against a plain count in Python, and the filters that count them."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from paylens.llm.collocations import CHUNK, Words, collocations, from_planes, numbered, planes, runs_of_ids
from paylens.llm.quotient_filter import CountingQuotientFilter, Layout, summed


def brute(rows, least, top=2000, longest=5):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    key = lang, tuple(words[i : i + k])
                    counts[key] = counts.get(key, 0) + 1
    some = {key: f for key, f in counts.items() if f >= least and len(key[1]) > 1}
    inside = lambda a, b: any(b[i : i + len(a)] == a for i in range(len(b) - len(a) + 1))
    out = {}
    for (lang, words), a in some.items():
        if any(m == lang and len(w) > len(words) and 100 * b >= 100 * a and inside(words, w) for (m, w), b in some.items()):
            continue
        cuts = [(1000 * a * totals[lang] // (counts[lang, words[:c]] * counts[lang, words[c:]]), c, counts[lang, words[:c]], counts[lang, words[c:]]) for c in range(1, len(words))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return sorted((lang, i, p.decode(), -a, x, y, totals[lang], -s) for lang, found in out.items() for i, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1))


def rows_of(df):
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def made(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "of", "a", "ñandú", "x-1", "größe", "#", "b", "of the", "one two three four five", "one two three", "a a a a"]
    seps = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", ";", "!?", "\x0b", " "]
    return [(rng.choice(["en", "en", "fr", None, "und"]), "".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randrange(60)))) for _ in range(n)]


@pytest.mark.parametrize("broadcast_words", [10**6, 3])
def test_counts_ranks_and_cuts(spark, broadcast_words):
    rows = [*made(1, 150), ("en", None), ("en", ""), (None, None), ("de", "..,;  \n"), ("de", "allein"), ("en", "the of " * 900)]
    df = spark.createDataFrame(rows, "lang string, text string").withColumns({"word": F.lit("x"), "row": F.lit(1), "f": F.lit(2), "hash": F.lit(3)}).repartition(5)
    got = rows_of(collocations(df, least=6, broadcast_words=broadcast_words, bitmap_bits=15, words_per_shard=300))
    assert got == brute(rows, 6) and len(got) > 50


def test_the_first_ones_of_each_language(spark):
    rows = made(2, 120)
    got = rows_of(collocations(spark.createDataFrame(rows, "lang string, text string").repartition(3), least=4, top=7, longest=3))
    assert got == brute(rows, 4, 7, 3)


def test_tables_without_phrases(spark):
    for rows in ([], [(None, None)], [("en", "a b c")]):
        assert collocations(spark.createDataFrame(rows, "lang string, text string")).collect() == []


def test_repeated_rows_and_very_long_texts(spark):
    long = "left right, " * (CHUNK // 4) + "tail end"
    df = spark.createDataFrame([("en", long), ("en", long), ("en", "left right")], "lang string, text string")
    assert [(r.phrase, r.a) for r in collocations(df).collect()] == [("left right", CHUNK // 2 + 1)]


@pytest.mark.parametrize("k, bits", [(2, 3), (2, 16), (3, 20), (4, 16), (5, 12), (5, 13), (5, 16), (5, 25), (5, 32), (4, 40)])
def test_filters_lose_nothing(k, bits):
    rng = np.random.default_rng(k * 100 + bits)
    layout, ids = Layout(k, bits), rng.integers(0, min(1 << bits, 1 << 32), 4000).astype(np.uint64)
    ids[1000:2000] = ids[:1000]
    ids[2000:2600] = ids[7]
    at = np.arange(len(ids) - k + 1)
    packed = layout.pack(ids, at)
    assert (np.array(layout.restore(layout.permute(packed))) == np.array(packed)).all()
    assert (layout.unpack(packed) == np.stack([ids[at + i] for i in range(k)], axis=1)).all()
    want = Counter(map(tuple, layout.unpack(packed).tolist()))
    parts = [CountingQuotientFilter(layout, pending=700) for _ in range(3)]
    for i in range(0, len(at), 500):
        parts[i // 500 % 3].add([lane[i : i + 500] for lane in packed])
    merged, sent = {}, 0
    for part in parts:
        for shard, raw in part.shards(3):
            sent += len(raw)
            merged.setdefault(shard, CountingQuotientFilter(layout)).add_bytes(raw, shard, 3)
    got = Counter()
    for one in merged.values():
        keys, counts = one.frequent(1)
        assert (np.lexsort(one.keys[::-1]) == np.arange(len(counts))).all()
        got.update(dict(zip(map(tuple, keys.tolist()), counts.tolist(), strict=True)))
    assert got == want
    assert sent < sum(len(p.counts) for p in parts) * (k * bits / 8 + 3) + 400


def test_equal_first_lanes_are_told_apart():
    keys = [np.array([5, 5, 5, 1], np.uint64), np.array([2, 1, 2, 9], np.uint64)]
    sorted_keys, counts = summed(keys)
    assert [k.tolist() for k in sorted_keys] == [[1, 5, 5], [9, 1, 2]] and counts.tolist() == [1, 1, 2]


def test_runs_end_where_pieces_and_texts_do():
    words = Words(["en", "en"], [b"A b, b a rare a b", b"a b"])
    hashes = Words(["en", "en"], [b"a", b"b"]).hashes
    order = np.argsort(hashes)
    assert runs_of_ids(words, hashes[order], order, 9).tolist() == [0, 1, 9, 1, 0, 9, 0, 1, 9, 0, 1, 9]
    for size in (1, 2, 3, 4):
        x = np.array([0, 1, 200, 255], np.uint64)
        assert from_planes(planes(x, size), size).tolist() == x.tolist()


def test_numbers_have_no_gap(spark):
    words = spark.createDataFrame([("en", f"w{i}") for i in range(700)] + [("fr", "w1")], "lang string, word string")
    assert sorted(r.id for r in numbered(words).collect()) == list(range(701))
