"""Columns named like the operators' helpers pass through."""

from pyspark.sql import functions as F

from paylens.llm.decontaminate import decontaminate
from paylens.llm.jaccard_join import drop_near_duplicates
from paylens.llm.substring_dedup import remove_repeats


def test_helper_names_are_free(spark):
    long = " ".join(f"w{i}" for i in range(70))
    names = ["lost_at", "lost_id", "lost_id_", "gone", "GONE_", "leaking_id", "leaking_key", "__at", "__id", "__gone", "__leaking_id"]
    docs = spark.createDataFrame([(1, long), (2, "x " + long), (3, "another text of its own here")], "doc_id long, text string").withColumns({n: F.lit(n) for n in names})
    items = spark.createDataFrame([(1, "another text of its own here")], "item_id long, text string")
    kept = [drop_near_duplicates(docs), decontaminate(docs, items), remove_repeats(docs)]
    assert [sorted(r.doc_id for r in df.collect()) for df in kept] == [[1, 3], [1, 2], [1, 2, 3]]
    assert all(df.columns == docs.columns and {r[n] for r in df.collect() for n in names} == set(names) for df in kept)
    assert {r.doc_id: r.text for r in kept[2].collect()}[2] == "x"
