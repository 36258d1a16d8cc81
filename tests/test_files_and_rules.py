"""Cases of the hand-off file, identifiers, word runs, line items and the lifecycle that the derived tables don't hold."""

import pytest
from pyspark.sql import functions as F

from paylens.functions.text import date_value
from paylens.operators import checks, documents, governance, queue, words


def test_the_hand_off_file_is_one_file_with_a_mark(spark, tmp_path):
    columns = queue.HANDOFF_COLUMNS
    rows = [{c: "" for c in columns} | x for x in ({"invoice_number": "2", "invoice_date": "2001-01-02", "memo": 'a "b", c'}, {"invoice_number": "1", "invoice_date": "2001-01-02"}, {"invoice_number": "9", "invoice_date": "2000-01-01"})]
    queue.write_bookkeeping_csv(spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], ", ".join(f"{c} string" for c in columns)), str(tmp_path / "out"))
    parts = list((tmp_path / "out").glob("part-*"))
    data = parts[0].read_bytes()
    assert len(parts) == 1 and data.startswith(b"\xef\xbb\xbf" + ",".join(columns).encode() + b"\r\n") and data.endswith(b"\r\n")
    assert [x.split(b",")[0] for x in data.split(b"\r\n")[1:-1]] == [b"9", b"1", b"2"] and b'"a ""b"", c"' in data


def test_check_digits(spark):
    df = spark.createDataFrame([("NL000000097B00", True), ("NL000000098B00", False), ("NL000000009B07", True), ("DE123456789", False), (None, None)], "v string, want boolean")
    assert all(r[0] == r[1] for r in df.select(checks.dutch_vat_checked(F.col("v")), "want").collect())
    good = "1234567" + str(sum(int(c) * i for i, c in enumerate("1234567", 1)) % 11)
    df = spark.createDataFrame([(good, True), ("00" + good, True), (good[:7] + str((int(good[7]) + 1) % 10), False), ("1234", False), ("x", False)], "v string, want boolean")
    assert all(r[0] == r[1] for r in df.select(checks.kvk_checked(F.col("v")), "want").collect())


def test_dates_in_both_orders(spark):
    df = spark.createDataFrame([("March 5, 2001", "2001-03-05"), ("5 mars 2001", "2001-03-05"), ("5/3/01", "2001-03-05"), ("31.02.2001", None), ("2001-3-5", "2001-03-05"), ("juin 5 2001", "2001-06-05"), ("5 juillet 2001", "2001-07-05"), ("", None), (None, None)], "v string, want string")
    assert all(r[0] == r[1] for r in df.select(date_value(F.col("v")).cast("string"), "want").collect())
    month_first = df.limit(1).select(date_value(F.lit("03/05/2001"), F.lit(True)).cast("string"), date_value(F.lit("13/05/2001"), F.lit(True)).cast("string")).first()
    assert tuple(month_first) == ("2001-03-05", "2001-05-13")


def test_overlapping_runs(spark):
    text = "Acme Tools shipped by AcmeTools for Acme"
    df = spark.createDataFrame([(1, 1, i, w, i / 100, 0.1) for i, w in enumerate(text.split())], "doc_id long, page int, pos int, text string, x double, y double")
    values = spark.createDataFrame([(1, "vendor", "Acme Tools"), (1, "memo", "acme"), (1, "total", "12"), (1, "iban", ""), (2, "vendor", "Acme")], "doc_id long, field string, value string")
    got = sorted(tuple(r) for r in words.value_locate(words.line_cluster(df), values).drop("page", "line").collect())
    # Exact runs first: one word, twice; AcmeTools only holds it.
    assert [x for x in got if x[1] == "memo" and x[4]] == [(1, "memo", 1, 1, True), (1, "memo", 7, 1, True)]
    assert [x for x in got if x[1] == "vendor" and x[4]] == [(1, "vendor", 1, 2, True)]
    assert {x[1] for x in got} == {"memo", "vendor"}


def test_lines_begin_where_the_first_word_says(spark):
    # Each word is a little lower than the one before: the third is too low for the first, though not for the second.
    df = spark.createDataFrame([(1, 1, i, "w", float(i), y) for i, y in enumerate((0.1000, 0.1004, 0.1008, 0.1012))] + [(1, 1, 9, "w", 0.0, None)], "doc_id long, page int, pos int, text string, x double, y double")
    assert [r.line for r in words.line_cluster(df).orderBy("pos").collect()] == [0, 0, 1, 1, -1]


def test_unknown_transitions_are_illegal(spark):
    rows = [(1, 1, "2001-01-01", "no-such", "a", "processor", ""), (1, 2, "2001-01-02", None, "a", "processor", ""), (1, 3, "2001-01-03", "register-profile", "a", "system", ""), (1, 4, "2001-01-04", "confirm", "a", "processor", "")]
    got = governance.lifecycle_replay(spark.createDataFrame(rows, "invoice_id long, event_id long, event_at string, transition string, actor string, role string, note string"))
    assert [r.outcome for r in got.orderBy("event_id").collect()] == ["illegal", "illegal", "illegal", "accepted"]


def test_long_labels_are_whole(spark):
    label = "a label of more than two hundred characters " * 6
    entries = spark.createDataFrame([(1, 1, f"Corrected {label}")], "invoice_id long, seq long, action string")
    assert governance.corrected_fields(entries, spark.createDataFrame([(label, "memo")], "label string, field string")).count() == 1


@pytest.mark.parametrize(("text", "want"), [("Prijs betaald via iDEAL op 3 mei", True), ("Nog te betalen", False), ("BEREITS BEZAHLT", True), ("unpaid", False)])
def test_prepaid(spark, text, want):
    assert (spark.range(1).select(documents.doc_prepaid(F.lit(text))).first()[0] is not None) == want


def test_nearest_register_number_and_address(spark):
    text = "KvK 1111 1111\n" + "x " * 60 + "\nmail info@b.example\nKamer van Koophandel nr. 2222.2222\nPostbus 12\n1234 AB Utrecht"
    row = spark.createDataFrame([(text,)], "t string").select(documents.doc_registration(F.col("t")), documents.doc_registration(F.col("t"), F.lit("info@b.example")), documents.doc_address(F.col("t"))).first()
    assert tuple(row) == ("11111111", "22222222", "Postbus 12, 1234 AB Utrecht")
