"""Quality rules: documents of languages without a reference, and references that are given."""

from pyspark.sql import functions as F

from paylens.llm import quality_rules

SF = "/root/testdata/sf0.001"


def test_a_language_without_reference_is_left_to_the_base_rules(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    russian = " ".join(f"слово{chr(1072 + i % 32)}{chr(1072 + i // 32)} речь" for i in range(160))
    other = [(10**6, russian, "ru"), (10**6 + 1, "слово " * 200, "ru"), (10**6 + 2, russian, None), (10**6 + 3, None, "ru")]
    got = quality_rules.quality_rules(documents.unionByName(spark.createDataFrame(other, documents.schema)))
    assert {r.doc_id: r.kept for r in got.filter("doc_id >= 1000000").collect()} == {10**6: True, 10**6 + 1: False, 10**6 + 2: False, 10**6 + 3: False}


def test_references_can_be_given(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    rows = quality_rules.document_histograms(quality_rules.document_counts(documents), 20, 30)
    references = quality_rules.language_references(rows)
    whole = quality_rules.quality_rules(documents)
    part = quality_rules.quality_rules(documents.filter("doc_id % 7 = 0"), references=references)
    assert sorted(part.collect()) == sorted(whole.filter("doc_id % 7 = 0").collect())
    assert references.select(F.transform("refs", lambda r: r.lang)).first()[0] == sorted(quality_rules.COMMON_WORDS)
