"""Values are located where a page is: pages meet values as they are, and lines that hold none make no runs."""

from pyspark.sql import functions as F

from paylens.operators import words as W
from paylens.plans.registry import QUERIES

SMALL = "/root/testdata/sf0.001"
TEXT = "Acme Tools shipped by AcmeTools for Acme\n\n   \nInvoice  date: 5 March 2001 due 05-04-2001\nIBAN NL91 ABNA 0417 1643 00\nTotal EUR 1.234,50 or 9,999 or 1 e3\n\tx"
VALUES = [("vendor", "Acme Tools"), ("memo", "acme"), ("issue_date", "2001-03-05"), ("due_date", "2001-04-05"), ("iban", "nl91abna0417164300"), ("total", "1234.50"), ("subtotal", "10.00"), ("tax", "1000"), ("note", "no such"), ("empty", " ")]


def placed(spark, texts):
    rows = []
    for doc, text in texts:
        for y, line in enumerate((text or "").split("\n")):
            rows += [(doc, 1, y * 1000 + p, w, p / 100, y / 1000) for p, w in enumerate(w for w in line.split(" ") if w)]
    return spark.createDataFrame(rows, "doc_id long, page int, pos int, text string, x double, y double")


def test_text_and_placed_words_give_the_same(spark):
    texts = [(1, TEXT), (2, TEXT), (3, ""), (4, None), (5, TEXT * 3), (6, "acme")]
    values = spark.createDataFrame([(i, f, v) for i, _ in texts for f, v in VALUES if not (i == 2 and f == "total")] + [(7, "memo", "acme"), (1, "total", "1,234.5")], "doc_id long, field string, value string")
    pages = spark.createDataFrame([(i, 1, t) for i, t in texts], "doc_id long, page int, text string")
    inside = sorted(tuple(r) for r in W.value_locate_in_text(pages, values).collect())
    apart = sorted(tuple(r) for r in W.value_locate(W.line_cluster(placed(spark, texts)), values).collect())
    assert inside == apart
    first = {(f, line, i, n, exact) for d, f, _, line, i, n, exact in inside if d == 1}
    assert {("vendor", 0, 1, 2, True), ("issue_date", 1, 3, 3, True), ("due_date", 1, 7, 1, True), ("iban", 2, 2, 5, True), ("total", 3, 2, 3, True), ("subtotal", 3, 4, 3, True), ("tax", 3, 6, 3, True)} <= first
    assert not any(d == 2 and f == "total" for d, f, *_ in inside)


def test_no_amount_fails_the_cheap_tests(spark):  # one of them is beyond whole numbers, and no value
    runs = ["9,999", "9.995", "1e3", "1 e3", "1 EUR e 3", "1.e3", "-12,00", "0,05", ",5", "12345678901234567890", "1 000 EUR", "€ 7", "1.234.567,89", "99,999"]
    df = spark.createDataFrame([(v,) for v in runs], "v string").select(W.value_key(F.lit("money"), F.col("v")).alias("wanted")).filter("wanted is not null").distinct()
    met = df.crossJoin(spark.createDataFrame([(r,) for r in runs], "run string")).withColumn("kind", F.lit("money")).filter(W.value_key(F.col("kind"), F.col("run")) == F.col("wanted"))
    assert met.count() >= 13
    line = F.concat(F.lit("E-mail 3: "), F.col("run"), F.lit(" thanks"))
    assert met.filter(~W.may_be(F.col("kind"), F.col("run"), F.lower("run"), F.col("wanted")) | ~W.may_hold(F.col("kind"), line, F.lower(line), F.upper(line), F.col("wanted"))).count() == 0
    # A line with other digits holds no such amount.
    other = F.lit("Invoice 77 of 5 March")
    assert df.filter((F.length("wanted") > 4) & (F.length("wanted") < 16) & W.may_hold(F.lit("money"), other, F.lower(other), other, F.col("wanted"))).count() == 0


def test_words_of_letters_are_sent_nowhere(spark):
    tree = QUERIES["value_locate"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert tree.count("Exchange hashpartitioning(doc_id") == 2  # the text and the values
