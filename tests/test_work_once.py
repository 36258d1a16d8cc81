"""Queries that read a derived table several times derive it once; derived views have the rows of their text."""

import re

import pytest
from compare import canonical

from paylens.plans.registry import QUERIES
from paylens.plans.views import DERIVED, VIEWS, Data

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", sorted(DERIVED))
def test_derived_views_have_the_rows_of_their_text(spark, name):
    d = Data(spark, SMALL)
    text = VIEWS[name]
    parts = {n: getattr(d, n) for n in set(re.findall(r"\bv_\w+\b", text))}
    for n in parts:
        text = re.sub(rf"\b{n}\b", "{" + n + "}", text)
    given = spark.sql(text, **parts).drop("part")
    mine = getattr(d, name).select(*given.columns)
    assert canonical(mine.columns, [tuple(r) for r in mine.collect()]) == canonical(given.columns, [tuple(r) for r in given.collect()])


@pytest.mark.parametrize("name", ["po_match_2way", "po_match_3way", "po_match_summary", "approval_gate", "approval_verdict"])
def test_lines_are_derived_once(spark, name):
    assert "l_orderkey" not in plan(QUERIES[name](spark, SMALL))


def test_lines_without_an_order_meet_nothing(spark):
    from paylens.operators import matching

    lines = spark.createDataFrame([(1, 1, None, "a", 1.0, 1.0), (2, 1, "po-2", "a", 1.0, 1.0), (3, 1, "po-3", "a", 1.0, 1.0)], "invoice_id long, line_no long, po_id string, description string, quantity double, unit_price double")
    orders = spark.createDataFrame([("po-2", 1, "po-2-1", "a", 1.0, 1.0), (None, 1, "x", "a", 1.0, 1.0)], "po_id string, pos long, po_line_id string, description string, quantity double, unit_price double")
    got = matching.po_match(lines, orders)
    assert sorted(tuple(r) for r in got.select("invoice_id", "status", "matched_by").collect()) == [(1, "no_po", "auto"), (2, "matched", "auto"), (3, "no_po", "auto")]
    tree = got._jdf.queryExecution().executedPlan().toString()
    assert tree.count("Filter isnotnull(po_id") >= 2


def test_buckets_hold_their_invoices(spark):
    from paylens.operators import spend

    df = spark.createDataFrame([(i, i, "Acme" if i % 2 else "acme", "", "IT", "", None, "EUR", 1.0) for i in range(300)], "id long, ord long, vendor string, category string, department string, entity string, issue_date date, currency string, total double")
    got = {(r.dimension, r.key): r for r in spend.spend_buckets(df).collect()}
    assert got["vendor", "acme"].invoice_ids == list(range(300)) and got["vendor", "acme"].label == "acme" and got["period", "unknown period"].n == 300


def test_vendor_vectors_count_every_word(spark):
    import hashlib

    from paylens.operators import documents

    texts = [None, "", "a", "acme", "acme acme beta", " ".join(f"w{i}" for i in range(900))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in documents.vendor_embedding(df).collect():
        counts = [0] * 256
        for w in (texts[r.doc_id] or "").split():
            counts[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 256] += len(w) > 1
        norm = sum(c * c for c in counts) ** 0.5
        assert r.embedding == [c / norm if norm else 0.0 for c in counts]
    tree = documents.vendor_embedding(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(0, 255" not in tree


def test_no_run_with_a_value_fails_the_cheap_test(spark):
    from pyspark.sql import functions as F

    from paylens.operators import words as W

    runs = ["1.234,50", "EUR 1 234.5", "$1234.50", "5 maart 1998", "05-03-98", "March 5, 2098", "1998-03-05", "nl91 abna 0417 1643 00", "NL91ABNA0417164300", "(NL91-ABNA0417164300)", "ACME B.V.", "acme-holding", "Straße 5", "x"]
    values = [(k, v) for k in ("money", "date", "iban", "text") for v in runs]
    df = spark.createDataFrame(values, "kind string, value string").select("kind", W.value_key(F.col("kind"), F.col("value")).alias("wanted")).filter("wanted is not null")
    met = df.crossJoin(spark.createDataFrame([(r,) for r in runs], "run string")).withColumn("printed", W.value_key(F.col("kind"), F.col("run")))
    near = (F.col("kind") == "text") & W.within(F.split("wanted", " "), F.split("printed", " "))
    taken = met.filter((F.col("printed") == F.col("wanted")) | near)
    assert taken.count() > 20
    assert taken.filter(~W.may_be(F.col("kind"), F.col("run"), F.lower("run"), F.col("wanted"))).count() == 0
    line = F.concat(F.lit("Total 7: "), F.col("run"), F.lit(" thanks"))
    packed = F.upper(F.regexp_replace(line, "[^A-Za-z0-9]", ""))
    assert taken.filter(~W.may_hold(F.col("kind"), line, F.lower(line), packed, F.col("wanted"))).count() == 0


def test_vendors_meet_words_that_they_hold_only(spark):
    from paylens.operators import matching

    names = [(f"customer#{i:09d}",) for i in range(400)]
    found = matching.vendors_with(spark.createDataFrame(names, "word string"), spark.createDataFrame([(n + " b.v.",) for (n,) in names], "po_vendor string"))
    assert sorted(tuple(r) for r in found.collect()) == [(n, n + " b.v.") for (n,) in names]
    long = "x" * 40
    assert matching.vendors_with(spark.createDataFrame([(long,), ("x" * 33,)], "word string"), spark.createDataFrame([("a" + long,), ("x" * 33,)], "po_vendor string")).count() == 3
    assert matching.HEAD > 18


def test_words_beyond_all_bands_go_before_they_are_shuffled(spark):
    from paylens.operators import words as W

    df = spark.createDataFrame([(1, 1, i, f"w{i}", i / 100, 0.0) for i in range(9)], "doc_id long, page int, pos int, text string, x double, y double")
    bands = spark.createDataFrame([("a", 0.0, 0.02), ("b", 0.02, 0.04)], "field string, x_from double, x_to double")
    out = W.table_rows(W.line_cluster(df), bands)
    assert sorted((r.field, r.value) for r in out.collect()) == [("a", "w0 w1"), ("b", "w2 w3")]
    assert "< 0.04)" in plan(out)
    assert W.table_rows(W.line_cluster(df), bands.limit(0)).count() == 0


def test_a_batch_finds_its_peers_once(spark):
    from paylens.operators.lookups import vendor_resolve
    from paylens.streaming import checks

    d = Data(spark, SMALL)
    corpus = vendor_resolve(d.v_invoices, d.v_profiles)
    assert "levenshtein" not in plan(checks.monitored(corpus.filter("id % 7 = 0"), corpus, "2001-08-01"))
