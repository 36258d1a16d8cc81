"""Hand-made rows for cases that the derived views don't reach."""

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from paylens.functions.money import iban_valid
from paylens.functions.text import date_value, money_value
from paylens.operators import anomalies, documents, duplicates, governance, lookups, matching, queue, spend
from paylens.sources.invoices import file_hashes, invoice_lines, invoice_load, truth_load
from paylens.streaming import checks as streams

D = dt.date


def rows(df, *order):
    return sorted(tuple(r) for r in df.select(*order).collect())


def invoices(spark, *items):
    base = {"id": 0, "ord": 0, "vendor": "Acme", "vendor_key": "acme", "invoice_number": "", "issue_date": D(2001, 1, 1), "due_date": D(2001, 1, 31), "currency": "EUR", "total": 100.0, "status": "review", "engine": "text", "memo": "", "iban": "", "category": "", "department": "", "entity": "", "gl_account": "", "created_at": dt.datetime(2001, 1, 1)}
    full = [{**base, "id": i + 1, "ord": i + 1, **x} for i, x in enumerate(items)]
    schema = "id long, ord long, vendor string, vendor_key string, invoice_number string, issue_date date, due_date date, currency string, total double, status string, engine string, memo string, iban string, category string, department string, entity string, gl_account string, created_at timestamp"
    return spark.createDataFrame([tuple(x[c.split()[0]] for c in schema.split(", ")) for x in full], schema)


def test_duplicates(spark):
    df = invoices(
        spark,
        {"invoice_number": "INV-001"}, {"invoice_number": "inv 001"},  # separators
        {"invoice_number": "INV-002"},  # the next number is another invoice
        {"invoice_number": "A1234567", "total": 500.0}, {"invoice_number": "B1234567", "total": 504.0},  # one misread character
        {"total": 900.0}, {"total": 900.0, "issue_date": D(2001, 1, 7)}, {"total": 900.0, "issue_date": D(2001, 2, 7)},  # unnumbered: a week
        {"total": 900.0, "invoice_number": "X-77"},  # a number on one side
        {"total": 0.0, "invoice_number": "Z-9999"}, {"total": 0.0, "invoice_number": "Z9999"},
        {"invoice_number": "INV-001", "currency": "USD"},
    )
    assert rows(duplicates.duplicate_pairs(df), "a", "b") == [(1, 2), (2, 1), (4, 5), (5, 4), (6, 7), (7, 6), (10, 11), (11, 10)]
    chain = invoices(spark, *[{"invoice_number": "N-100"}] * 3)
    assert rows(duplicates.duplicate_peers(chain), "id", "peer") == [(1, 2), (2, 1), (3, 1)]


def test_duplicates_do_not_depend_on_order_or_partitions(spark):
    items = [{"invoice_number": f"N-{random.Random(i).randrange(30)}", "total": 100.0 + i % 3} for i in range(120)]
    df = invoices(spark, *items)
    assert rows(duplicates.duplicate_peers(df), "id", "peer") == rows(duplicates.duplicate_peers(df.repartition(7, "total").orderBy(F.rand(3))), "id", "peer")


def lines(spark, *items):
    return spark.createDataFrame(items, "invoice_id long, line_no int, po_id string, description string, quantity double, unit_price double")


def test_po_matching(spark):
    po = spark.createDataFrame([("p", 1, "p-1", "Widget", 10.0, 80.0), ("p", 2, "p-2", "Widget", 10.0, 80.0), ("p", 3, "p-3", "Free", 1.0, 0.0), ("q", 1, "q-1", "Gone", 1.0, 0.0)], "po_id string, pos int, po_line_id string, description string, quantity double, unit_price double")
    mine = lines(spark, (1, 1, "p", "widget ", 10.0, 81.0), (1, 2, "p", "Widget", 9.0, 80.0), (1, 3, "p", "Widget", 10.0, 90.0), (1, 4, "p", "Free", 1.0, 0.0), (2, 1, "q", "Gone", 1.0, 5.0), (3, 1, None, "x", 1.0, 1.0))
    got = rows(matching.po_match(mine, po), "invoice_id", "line_no", "po_line_id", "status")
    assert got == [(1, 1, "p-1", "matched"), (1, 2, "p-1", "qty_mismatch"), (1, 3, "p-1", "price_mismatch"), (1, 4, "p-3", "matched"), (2, 1, None, "no_po"), (3, 1, None, "no_po")]
    links = spark.createDataFrame([(1, 1, "p-2"), (1, 2, "elsewhere")], "invoice_id long, line_no int, po_line_id string")
    linked = rows(matching.po_match(mine.filter("invoice_id = 1 and line_no < 3"), po, links=links), "line_no", "po_line_id", "status", "matched_by")
    assert linked == [(1, "p-2", "matched", "explicit"), (2, "p-1", "qty_mismatch", "explicit")]
    receipts = spark.createDataFrame([("p-1", 4.0), ("p-1", 6.0), ("p-3", 0.5)], "po_line_id string, quantity_received double")
    three = matching.po_match(mine.filter("invoice_id = 1"), po, receipts)
    assert rows(three, "line_no", "status") == [(1, "matched"), (2, "qty_mismatch"), (3, "price_mismatch"), (4, "receipt_short")]
    assert rows(matching.po_match_summary(three, True), "mode", "n_matched", "n_exceptions") == [("three_way", 1, 3)]


def test_rates(spark):
    fx = spark.createDataFrame([("USD", "EUR", 0.9, "2001-01-01"), ("USD", "EUR", 0.8, "2001-02-01"), ("USD", "EUR", -1.0, "2001-03-01"), ("EUR", "GBP", 0.5, "2001-01-01")], "base string, quote string, rate double, rate_at string")
    pairs = spark.createDataFrame([("USD", "EUR"), ("GBP", "EUR"), ("JPY", "EUR"), ("EUR", "EUR")], "base string, quote string")
    assert rows(lookups.fx_resolve(fx, pairs), "base", "rate") == [("EUR", 1.0), ("GBP", 2.0), ("JPY", None), ("USD", 0.8)]


def test_buckets_share_labels_whatever_their_case(spark):
    df = invoices(spark, {"vendor": "Acme", "status": "paid"}, {"vendor": "ACME", "status": "paid", "total": 50.0}, {"vendor": " ", "status": "paid"})
    buckets = spend.spend_buckets(df).filter("dimension = 'vendor'")
    assert rows(buckets, "label", "total", "n", "first_id", "last_id") == [("Acme", 150.0, 2, 1, 2), ("Unassigned vendor", 100.0, 1, 3, 3)]
    assert rows(spend.drilldown(df, buckets.filter("label = 'Acme'")), "id") == [(1,), (2,)]
    assert rows(spend.drilldown(df, spend.spend_buckets(df).filter("key in ('acme', 'unassigned department')")), "id") == [(1,), (2,), (3,)]
    parts = [spend.spend_buckets(df.filter(c)) for c in ("id = 2", "id = 1", "id = 3")]
    merged = spend.merge_buckets(spend.merge_buckets(parts[0].unionByName(parts[1])).unionByName(parts[2]))
    assert rows(merged, *sorted(merged.columns)) == rows(spend.spend_buckets(df), *sorted(merged.columns))
    undated = invoices(spark, {"issue_date": None}, {})
    assert spend.spend_filter(undated, end="2002-01-01").count() == 2
    assert spend.spend_filter(undated, start="2000-01-01").count() == 1


def test_anomalies_need_four_earlier_invoices(spark):
    flat = [{"issue_date": D(2001, m, 15), "due_date": D(2001, m, 28), "total": 101.0, "invoice_number": f"S-{m:04}"} for m in range(1, 6)]
    odd = {"issue_date": D(2001, 6, 15), "due_date": D(2001, 6, 28), "total": 401.0, "invoice_number": "S-0009"}
    stats = anomalies.prior_stats(invoices(spark, *flat, odd))
    assert rows(anomalies.anomaly_amount(stats), "id", "severity") == [(6, "high")]
    assert rows(anomalies.anomaly_number_gap(stats), "id") == [(6,)]
    assert rows(anomalies.anomaly_amount(anomalies.prior_stats(invoices(spark, *flat[:3], odd))), "id") == []
    other = {**odd, "invoice_number": "T-0900", "total": 101.0}
    assert rows(anomalies.anomaly_number_gap(anomalies.prior_stats(invoices(spark, *flat, other))), "id") == []
    stepped = [{**x, "invoice_number": f"S-{10 * (i + 1):04}"} for i, x in enumerate(flat)]
    assert rows(anomalies.anomaly_number_gap(anomalies.prior_stats(invoices(spark, *stepped, {**odd, "invoice_number": "S-0060"}))), "id") == []


def test_number_series(spark):
    df = spark.createDataFrame([("2026",), ("A-7",), ("A-07",), ("x",), ("20260",)], "n string").select("n", anomalies.parsed_number(F.col("n")).alias("p"))
    assert rows(df.filter("p is not null"), "n") == [("20260",), ("A-07",)]


def test_identifiers_and_values(spark):
    df = spark.createDataFrame([("nl91 abna 0417 1643 00",), ("NL91ABNA0417164301",), ("DE89370400440532013000",), ("",)], "v string")
    assert rows(df.filter(iban_valid("v")), "v") == [("DE89370400440532013000",), ("nl91 abna 0417 1643 00",)]
    money = spark.createDataFrame([("1.234,56", 1234.56), ("€ 12,5", 12.5), ("1,234.50", 1234.5), ("1.234", 1234.0), ("12", 12.0), ("-", None)], "v string, e double")
    assert all(r[0] == r[1] for r in money.select(money_value(F.col("v")), "e").collect())
    dates = spark.createDataFrame([("04-03-2026", D(2026, 3, 4)), ("2026/3/4", D(2026, 3, 4)), ("31-02-2026", None), ("3 mei 2026", D(2026, 5, 3)), ("x", None)], "v string, e date")
    assert all(r[0] == r[1] for r in dates.select(date_value(F.col("v")), "e").collect())


def test_payment_terms(spark):
    df = spark.createDataFrame([("net 14", D(2026, 4, 26)), ("Betalingstermijn: 30 dagen", D(2026, 5, 12)), ("14 dagen einde van de maand", D(2026, 6, 14)), ("geen", None)], "t string, e date")
    assert all(r[0] == r[1] for r in df.select(documents.doc_due_from_terms(F.col("t"), F.lit(D(2026, 4, 12))), "e").collect())


def test_document_text(spark):
    text = "Foo Services B.V.\nHoofdstraat 12\n1234 AB Stad\nKvK: 12345678\nLeverancier email: billing@foo.example\nReeds betaald via Mollie\n2 uur advies 1.250,00\nTotaal 1.512,50"
    df = spark.createDataFrame([(1, 1, text)], "doc_id long, page int, text string")
    got = dict(rows(documents.document_fields(df), "field", "value"))
    assert got["vendor"] == "Foo Services B.V." and got["registration"] == "12345678" and got["address"] == "Hoofdstraat 12, 1234 AB Stad" and got["total"] == "1512.5" and got["locale"] == "NL"
    assert "Reeds betaald via Mollie" in got["prepaid"]
    assert rows(documents.doc_line_items(df), "description", "quantity", "amount") == [("2 uur advies", 2.0, 1250.0)]
    xml = spark.createDataFrame([('<?xml version="1.0"?><Invoice xmlns="urn:oasis:names:specification:ubl:schema:xsd:Invoice-2"/>', "ubl"), ("<html/>", None)], "t string, k string")
    assert all(r[0] == r[1] for r in xml.select(documents.doc_structured_kind(F.col("t")), "k").collect())


REQUESTS = [
    (1, 1, "confirm", "ann", "processor", ""), (1, 2, "approve", "ann", "approver", ""), (1, 3, "approve", "bob", "treasury", ""), (1, 4, "query", "bob", "approver", " "),
    (1, 5, "approve", "bob", "approver", ""), (1, 6, "release", "bob", "treasury", ""), (1, 7, "release", "cid", "treasury", ""), (1, 8, "confirm", "cid", "processor", ""), (1, 9, "re-open", "bob", "approver", "why"),
]
OUTCOMES = ["accepted", "sod", "role", "reason-required", "accepted", "sod", "accepted", "illegal", "accepted"]


def requests(spark):
    schema = "invoice_id long, event_id long, transition string, actor string, role string, note string"
    return spark.createDataFrame(REQUESTS, schema).withColumn("event_at", F.timestamp_seconds("event_id"))


def test_lifecycle(spark):
    batch = rows(governance.lifecycle_replay(requests(spark)), "event_id", "outcome", "status")
    assert [r[1] for r in batch] == OUTCOMES and batch[-1][2] == "review"
    stream = streams.drained(streams.lifecycle(streams.folder_stream(spark, requests(spark), "requests", 1)), "lifecycle")
    assert rows(stream, "event_id", "outcome", "status") == batch
    paid = governance.lifecycle_replay(requests(spark).filter("event_id >= 8"), "paid")
    assert [r[1] for r in rows(paid, "event_id", "outcome")] == ["immutable", "accepted"]


def test_streams_give_what_their_batch_twins_give(spark):
    files = spark.createDataFrame([(i, f"h{i % 7}") for i in range(40)], "file_id long, file_hash string")
    assert streams.drained(streams.first_seen(streams.folder_stream(spark, files, "files")), "seen").count() == 7


def test_audit_chain(spark):
    entries = spark.createDataFrame([(1, i, "ann", "edit", f"n{i}") for i in range(1, 6)], "invoice_id long, seq long, actor string, action string, note string")
    out, before = [], None
    for r in entries.orderBy("seq").collect():
        one = spark.createDataFrame([(*r, before)], "invoice_id long, seq long, actor string, action string, note string, previous_hash string")
        h = one.select(governance.entry_hash(F.col("previous_hash"), governance.AUDIT_FIELDS)).first()[0]
        out.append((*r, before, h))
        before = h
    schema = "invoice_id long, seq long, actor string, action string, note string, previous_hash string, hash string"
    assert rows(governance.audit_chain_verify(spark.createDataFrame(out, schema)), "valid", "first_break") == [(True, None)]
    altered = [(*r[:4], "changed", *r[5:]) if r[1] == 3 else r for r in out]
    assert rows(governance.audit_chain_verify(spark.createDataFrame(altered, schema)), "valid", "first_break") == [(False, 3)]


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps([{"id": "1", "vendor": "Acme", "issueDate": "2001-02-30", "total": 5, "lineItems": [{"description": "x", "quantity": 1, "unitPrice": 5, "amount": 5}]}, {"id": "2", "issueDate": "2001-02-03"}]))
    df = invoice_load(spark, str(tmp_path / "in"))
    assert rows(df, "id", "issue_date") == [("1", None), ("2", D(2001, 2, 3))]
    assert [r[0] for r in df.select("field_evidence").collect()] == [{}, {}]
    assert rows(invoice_lines(df), "invoice_id", "line_no", "amount") == [("1", 1, 5.0)]
    assert file_hashes(spark, str(tmp_path / "in")).count() == 1
    for name, skip in (("one", False), ("two", True)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "expected.json").write_text(json.dumps({"_skip": skip, "fields": {"total": "5"}}))
    assert rows(truth_load(spark, str(tmp_path)), "producer", "field", "value") == [("one", "total", "5")]


def test_handoff_file(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", "2001-01-01", 'say "hi", ok'), ("x", "2000-01-01", "")], "invoice_number string, invoice_date string, memo string")
    guarded = df.withColumn("invoice_number", queue.guarded(F.col("invoice_number")))
    queue.write_bookkeeping_csv(guarded.coalesce(1), str(tmp_path / "out"))
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*")))
    assert data.split(b"\r\n")[:3] == [b"\xef\xbb\xbfinvoice_number,invoice_date,memo", b"x,2000-01-01,", b'\'=1+1,2001-01-01,"say ""hi"", ok"']


def test_empty_inputs(spark):
    none = invoices(spark).limit(0)
    assert spend.totals_by_currency(none).count() == 0
    assert duplicates.duplicate_peers(none).count() == 0
    assert anomalies.anomaly_findings(none, duplicates.duplicate_peers(none)).count() == 0
