"""Decontamination over all windows: reordered, short and repeated items, rows without an id."""

import random

import brute

from paylens.llm import decontaminate

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def plain(word, n):
    return [f"{word}{i}" for i in range(n)]


def found(spark, docs, items, **options):
    got = decontaminate.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), **options).collect()
    return {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got}


def test_halves_swapped(spark):
    item, around = plain("a", 80), plain("x", 300)
    docs = [(1, " ".join(around + item[40:] + item[:40] + around)), (2, " ".join(around)), (3, " ".join(item[::-1]))]
    items = [(1, " ".join(item)), (2, " ".join(plain("b", 80)))]
    want = brute.leaks(docs, items)
    assert set(want) == {(1, 1)} and found(spark, docs, items) == {k: round(v, 9) for k, v in want.items()}
    # Beyond the broadcast bound the joins are shuffles.
    assert found(spark, docs, items, broadcast_rows=1) == found(spark, docs, items)


def test_short_items_are_one_shingle(spark):
    docs = [(1, "it says Alpha Beta gamma delta here"), (2, "alpha beta gamma"), (3, "alpha beta x gamma delta"), (4, "one"), (5, None), (6, " ")]
    items = [(1, "alpha beta gamma delta"), (2, "alpha beta"), (3, "ONE"), (4, ""), (5, None)]
    assert found(spark, docs, items) == brute.leaks(docs, items) == {(1, 1): 1.0, (1, 2): 1.0, (2, 2): 1.0, (3, 2): 1.0, (4, 3): 1.0}


def test_edits_at_random(spark):
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice(plain("w", 40)) for _ in range(rng.choice((6, 12, 30, 30, 61))))) for i in range(25)]
    docs = []
    for i, t in items:
        for n in range(4):
            w = t.split()
            for _ in range(n):
                at = rng.randrange(len(w))
                w[at : at + rng.choice((0, 1))] = [f"new{rng.randrange(9)}"]
            docs.append((10 * i + n, " ".join(plain("p", rng.choice((0, 3, 200))) + w + plain("q", rng.choice((0, 90))))))
    want = brute.leaks(docs, items)
    assert len(want) > 30 and found(spark, docs, items) == {k: round(v, 9) for k, v in want.items()}


def test_rows_of_one_id_are_judged_by_their_own_text(spark):
    item = " ".join(plain("a", 20))
    docs = spark.createDataFrame([(None, item, 1), (None, "clean words", 2), (None, None, 3), (7, item + " more", 4), (7, "clean", 5), (7, item + " more", 6)], "doc_id long, text string, start int")
    items = spark.createDataFrame([(1, item), (1, item), (None, "other words than these here")], ITEMS)
    kept = decontaminate.decontaminate(docs, items)
    assert kept.columns == docs.columns and sorted(r.start for r in kept.collect()) == [2, 3, 5]
    assert decontaminate.decontaminate(docs, items.limit(0)).count() == 6 and decontaminate.decontaminate(docs.limit(0), items).count() == 0
    assert decontaminate.decontaminate(docs, docs.selectExpr("doc_id AS item_id", "text")).filter("text is not null").count() == 0
