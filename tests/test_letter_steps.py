"""Letters are what their SQL says, and steps over them are taken once, where something can be found."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from paylens.operators import documents as D
from paylens.plans.registry import QUERIES
from paylens.plans.views import Data

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_that_are_tables_names_stay(spark):
    assert Data(spark, SMALL).v_letters.filter("lang = 'EN'").filter(~F.col("text").startswith("INVOICE - invoice, supplier, tax\n")).count() == 0


@pytest.mark.parametrize("name", ["doc_emails", "doc_line_items", "doc_registration"])
def test_letters_are_compiled(spark, name):
    out, df = io.StringIO(), QUERIES[name](spark, SMALL)
    df.collect()  # the plan is final then
    with contextlib.redirect_stdout(out):
        df.explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", out.getvalue())]
    assert sizes and max(sizes) < 8000


def test_addresses_are_scored_a_page_at_a_time(spark):
    texts = ["E-mail\n \n\ta@b.co", "ſupplier: c@d.co", "e-mail\nplain\ne@f.co", "info\nx@y.co z\ng@h.co", "no address"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.email, r.score) for r in D.doc_emails(df).collect()}
    assert got == {(0, "a@b.co", 0.3), (1, "c@d.co", 0.3), (2, "e@f.co", 0.0), (3, "x@y.co", 0.3), (3, "g@h.co", 0.0)}
    assert "Generate inline" in plan(D.doc_emails(df))


def test_an_amount_is_read_once(spark):
    texts = ["Box of wood 1.234,50\n2 pcs 0,99", "Chairs and tables\n3 x 30.00", "SUBTOTAL 5.00\nſubtotal 5.00\nTotal 6.00", "Odd wood 1,23,456.00 7,00"]
    df = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "doc_id long, page int, text string")
    got = sorted((r.doc_id, r.line, r.description, r.quantity, r.amount) for r in D.doc_line_items(df).collect())
    assert got[:2] == [(0, 0, "Box of wood", 1.0, 1234.5), (1, 1, "Chairs and tables", 3.0, 30.0)]
    assert plan(D.doc_line_items(df)).count("regexp_extract_all(") == 1


def test_a_word_of_many_labels_is_no_sign_of_a_register(spark):
    df = spark.createDataFrame([("VAT number 1234567\nkvk\nnummer: 12345678",), ("ſiret 123 456 789",), ("number 12345678",)], "text string")
    assert [r[0] for r in df.select(D.doc_registration(F.col("text"))).collect()] == ["12345678", "123456789", None]
    assert not re.search(r"Contains\([^,]*, number\)", plan(df.select(D.doc_registration(F.col("text")))))
