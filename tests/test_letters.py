"""Patterns are tried once and only where they can match; lines without money and invoices' copies cost no pass of their own."""

import pytest
from pyspark.sql import functions as F

from paylens.functions.text import first_match
from paylens.operators import documents as D
from paylens.plans.registry import QUERIES
from paylens.plans.views import Data

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_pattern_is_tried_once(spark):
    df = spark.range(1).selectExpr("cast(id as string) AS t")
    assert plan(df.select(F.when(F.length("t") > 0, first_match(F.col("t"), r"(\d)")).alias("x"))).count("regexp_extract(") == 1


def test_invoices_and_copies_come_from_one_pass(spark):
    assert plan(Data(spark, SMALL).v_invoices).count("o_orderkey#") and plan(Data(spark, SMALL).v_invoices).count("Relation [o_orderkey") == 1


def test_only_lines_with_money_are_sent(spark):
    tree = plan(QUERIES["doc_line_items"](spark, SMALL))
    assert "lag(" not in tree


def test_every_address_is_found(spark):
    texts = ["a@b.co-x@y.com z", "..@@a@b.cc", "one@two.org,two@three.net", "x" * 3000, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.email) for r in D.doc_emails(df).collect()}
    assert got == {(0, "a@b.co"), (0, "-x@y.com"), (1, "a@b.cc"), (2, "one@two.org"), (2, "two@three.net")}


@pytest.mark.parametrize("text,number,locale", [("FACTURE NO 12", "12", "FR"), ("ınvoice no 7", "7", "EN"), ("order nr: A-9", "A-9", "NL"), ("ref AB-1234", "AB-1234", "NL"), ("", None, "NL"), (None, None, "NL")])
def test_a_label_is_found_in_any_case(spark, text, number, locale):
    df = spark.createDataFrame([(text,)], "t string")
    assert tuple(df.select(D.doc_invoice_number(F.col("t")), D.doc_locale(F.col("t"))).first()) == (number, locale)


def test_fields_asked_for_are_the_only_ones_read(spark):
    pages = spark.createDataFrame([(1, 1, "Supplier: Acme\nSIREN 123456789\nTotal due 12.50")], "doc_id long, page int, text string")
    assert {r.field for r in D.document_fields(pages, fields=["total"]).collect()} == {"total"}
    assert "siren" not in plan(D.document_fields(pages, fields=["total"]))
