"""Documents that begin inside an item."""

import brute

from paylens.llm import decontaminate


def test_a_cut_item_beside_another_of_its_size(spark):
    a = [f"a{i}" for i in range(24)]
    b = [f"b{i}" for i in range(24)]
    b[2:7] = a[5:10]  # stands at the same words of the document, so that a whole window begins there too
    items = [(1, " ".join(a)), (2, " ".join(b))]
    docs = [(1, " ".join(a[3:] + [f"x{i}" for i in range(30)])), (2, " ".join(a[9:] + [f"x{i}" for i in range(30)])), (3, " ".join(a))]
    got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): r.similarity for r in got} == brute.leaks(docs, items) == {(1, 1): 0.85, (3, 1): 1.0}
    assert {(r.doc_id, r.first_word, r.last_word) for r in got} == {(1, 0, 20), (3, 0, 23)}
