"""Queries on document text and its evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documents as D, evaluation as E


def of(expression, name):
    """A field of the letters, read from their text."""
    return lambda d: d.v_letters.select("doc_id", expression(F.col("text")).alias(name))


def reads(d):
    """Fields of conversations: a role's text by turn; labelled where the turn is even."""
    return d.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.col("role").alias("field"), F.col("text").alias("value"), (F.col("turn") % 2 == 0).alias("labelled"))


def long(d, name, drop=7):
    return getattr(d, name).select("doc_id", "field", "value").filter(F.col("doc_id") % drop != 0)


def read_by(d, name, drop, page, provenance):
    return long(d, name, drop).withColumns({"page": F.lit(page), "provenance": F.lit(provenance)})


def days(d, wrong):
    """Issue dates as a reader prints them, a day late where wrong says so."""
    day = F.date_add("issue_date", F.when(wrong, 1).otherwise(0))
    return d.v_invoices.select(F.col("id").alias("doc_id"), F.lit("issue_date").alias("field"), day.alias("day"))


OUT = """o AS (SELECT coalesce(t.doc_id, p.doc_id) AS doc_id, coalesce(t.source, p.source) AS source, coalesce(t.field, p.field) AS field,
CASE WHEN coalesce(t.value, '') <> '' AND coalesce(p.value, '') <> '' THEN CASE WHEN t.value = p.value THEN 'correct' ELSE 'wrong' END WHEN coalesce(t.value, '') <> '' THEN 'missing' WHEN coalesce(p.value, '') <> '' THEN 'unexpected' END AS outcome
FROM v_truth t FULL JOIN v_predicted p ON t.doc_id = p.doc_id AND t.source = p.source AND t.field = p.field),
c AS (SELECT coalesce(source, 'all') AS source, coalesce(field, 'all') AS field, count(*) FILTER (WHERE outcome = 'correct') AS n_correct, count(*) FILTER (WHERE outcome = 'wrong') AS n_wrong, count(*) FILTER (WHERE outcome = 'missing') AS n_missing, count(*) FILTER (WHERE outcome = 'unexpected') AS n_unexpected
FROM o WHERE outcome IS NOT NULL GROUP BY GROUPING SETS ((), (source), (field))),
m AS (SELECT *, n_correct / (n_correct + n_wrong + n_unexpected) AS p, n_correct / (n_correct + n_wrong + n_missing) AS r FROM c)"""
OWN_VAT = "NL999999999B99"
# The fields of letters but registration and prepaid, which have queries of their own.
READ_FIELDS = ["vendor", "invoice_number", "issue_date", "due_date", "currency", "subtotal", "tax", "total", "iban", "vat_number", "address", "locale"]


QUERIES = {
    # The letters say in columns of their own what they are to be read as: the SQL doesn't read the text.
    "doc_locale": (of(D.doc_locale, "locale"), "SELECT doc_id, lang AS locale FROM v_letters"),
    "doc_currency": (of(D.doc_currency, "currency"), "SELECT doc_id, currency FROM v_letters"),
    "doc_amounts": (
        lambda d: d.v_letters.select("doc_id", *[D.doc_amount(F.col("text"), f).alias(f) for f in ("subtotal", "tax", "total")]),
        "SELECT doc_id, subtotal, tax, total FROM v_letters",
    ),
    "doc_dates": (
        lambda d: d.v_letters.select("doc_id", D.doc_date(F.col("text"), "issue_date").alias("issue_date"), D.doc_date(F.col("text"), "due_date").alias("due_date")),
        "SELECT doc_id, issue_date, CASE WHEN doc_id % 6 <> 0 THEN due_date END AS due_date FROM v_letters",
    ),
    "doc_due_from_terms": (
        lambda d: d.v_letters.select("doc_id", D.doc_due_from_terms(F.col("text"), D.doc_date(F.col("text"), "issue_date")).alias("due_date")),
        "SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN due_date END AS due_date FROM v_letters",
    ),
    "doc_invoice_number": (of(D.doc_invoice_number, "invoice_number"), "SELECT doc_id, invoice_number FROM v_letters"),
    "doc_emails": (
        lambda d: D.doc_emails(d.v_letters),
        """SELECT doc_id, email, 1.3 AS score, 1 AS rank FROM v_letters UNION ALL SELECT doc_id, 'noreply@carrier.example', 0.0, 2 FROM v_letters WHERE doc_id % 2 = 0""",
    ),
    "doc_iban": (of(D.doc_iban, "iban"), "SELECT id AS doc_id, nullif(iban, '') AS iban FROM v_invoices"),
    "doc_vat": (
        lambda d: d.v_letters.select("doc_id", D.doc_vat(F.col("text"), OWN_VAT).alias("vat_number")),
        "SELECT id AS doc_id, CASE WHEN vat_number IN ('NL123456789B01', 'DE123456789') THEN vat_number END AS vat_number FROM v_invoices",
    ),
    "doc_registration": (
        lambda d: d.v_letters.select("doc_id", D.doc_registration(F.col("text"), F.col("email")).alias("registration")),
        "SELECT doc_id, CASE lang WHEN 'FR' THEN concat('7', digits) WHEN 'ES' THEN CASE WHEN doc_id % 2 = 0 THEN '99999999' END ELSE digits END AS registration FROM v_letters",
    ),
    "doc_address": (of(D.doc_address, "address"), "SELECT doc_id, address FROM v_letters"),
    "doc_vendor": (of(D.doc_vendor, "vendor"), "SELECT doc_id, vendor FROM v_letters"),
    "doc_line_items": (
        lambda d: D.doc_line_items(d.v_letters),
        """WITH n AS (SELECT doc_id, 11 + CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN doc_id % 4 IN (1, 2) THEN 1 ELSE 0 END AS base FROM v_letters)
        SELECT doc_id, 1 AS page, base + 1 AS line, 'Storage box of 12' AS description, 3.0 AS quantity, 30.0 AS amount FROM n
        UNION ALL SELECT doc_id, 1, base + 2, 'Yearly support 2 days', 2.0, 250.0 FROM n""",
    ),
    "doc_prepaid": (
        of(D.doc_prepaid, "prepaid"),
        """WITH p AS (SELECT doc_id, text, CASE WHEN paid <> '' THEN instr(text, concat('was ', paid)) + 4 END AS pos FROM v_letters)
        SELECT doc_id, trim(regexp_replace(substring(text, cast(pos AS int) - 40, 80), '\\s+', ' ', 'g')) AS prepaid FROM p""",
    ),
    "doc_relevant_pages": (
        lambda d: D.doc_relevant_pages(reads(d).select("doc_id", "page", F.col("value").alias("text"))),
        f"""WITH x AS (SELECT conv_id, turn, text, count(*) OVER w AS n, min(turn) OVER w AS a, max(turn) OVER w AS z FROM conversations WINDOW w AS (PARTITION BY conv_id)) SELECT conv_id AS doc_id, turn AS page FROM x
        WHERE n <= 2 OR turn = a OR turn = z OR regexp_matches(lower(text), '(^|[^\\p{{L}}])({"|".join(w.replace(".", chr(92) + ".").replace(" ", "[ -]?") for w in D.SIGNAL_WORDS)})($|[^\\p{{L}}])')""",
    ),
    "doc_structured_kind": (
        lambda d: d.v_xml.select("doc_id", D.doc_structured_kind(F.col("text")).alias("kind")),
        "SELECT id AS doc_id, CASE id % 3 WHEN 0 THEN 'ubl' WHEN 1 THEN 'cii' END AS kind FROM v_invoices",
    ),
    "document_fields": (
        lambda d: D.document_fields(d.v_letters, own_vat=OWN_VAT, fields=READ_FIELDS),
        """WITH i AS (SELECT l.*, nullif(i.iban, '') AS iban, CASE WHEN i.vat_number IN ('NL123456789B01', 'DE123456789') THEN i.vat_number END AS vat_number FROM v_letters l JOIN v_invoices i ON i.id = l.doc_id),
        f AS (SELECT doc_id, 1 AS page, unnest([{'f': 'vendor', 'v': vendor}, {'f': 'invoice_number', 'v': invoice_number}, {'f': 'issue_date', 'v': cast(issue_date AS string)}, {'f': 'due_date', 'v': cast(due_date AS string)},
          {'f': 'currency', 'v': currency}, {'f': 'iban', 'v': iban}, {'f': 'vat_number', 'v': vat_number}, {'f': 'address', 'v': address}, {'f': 'locale', 'v': lang},
          {'f': 'subtotal', 'v': cast(subtotal AS string)}, {'f': 'tax', 'v': cast(tax AS string)}, {'f': 'total', 'v': cast(total AS string)}]) AS p FROM i)
        SELECT doc_id, page, p.f AS field, p.v AS value FROM f WHERE p.v IS NOT NULL""",
    ),
    "page_first_value": (
        lambda d: D.page_first_value(reads(d)),
        "SELECT conv_id AS doc_id, role AS field, text AS value, turn AS page FROM conversations WHERE coalesce(text, '') <> '' QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn % 2, turn, text) = 1",
    ),
    "extraction_assemble": (
        lambda d: D.extraction_assemble(
            D.document_fields(d.v_letters, own_vat=OWN_VAT, fields=D.HEADER).filter("not (field in ('total', 'subtotal') and doc_id % 3 = 0) and not (field = 'subtotal' and doc_id % 5 = 0) and not (field = 'due_date' and doc_id % 7 = 0) and not (field = 'vendor' and doc_id % 11 = 0)"),
            D.doc_line_items(d.v_letters), d.v_letters.select("doc_id", F.concat(F.lit("/in/"), F.translate("vendor", " #", "__"), F.lit("_scan.pdf")).alias("file_name"), F.lit(30).alias("terms_days")),
        ).withColumn("n_original", F.size("original")).drop("original", "line_items"),
        """SELECT l.doc_id, CASE WHEN l.doc_id % 11 = 0 THEN replace(replace(vendor, ' ', '_'), '#', '_') ELSE vendor END AS vendor, invoice_number, issue_date, CASE WHEN l.doc_id % 7 = 0 THEN cast(issue_date + INTERVAL 30 DAY AS date) ELSE due_date END AS due_date,
        currency, CASE WHEN l.doc_id % 3 <> 0 AND l.doc_id % 5 <> 0 THEN subtotal END AS subtotal, tax, CASE WHEN l.doc_id % 3 <> 0 THEN total ELSE 280.0 END AS total, CASE WHEN l.doc_id % 3 <> 0 THEN 'read' ELSE 'lines' END AS total_from,
        cast(2 + (invoice_number IS NOT NULL)::int + 1 + (currency IS NOT NULL)::int + 1 - (l.doc_id % 11 = 0)::int - (l.doc_id % 7 = 0)::int + CASE WHEN l.doc_id % 3 = 0 THEN 0 WHEN l.doc_id % 5 = 0 THEN 1 ELSE 2 END AS int) AS n_original FROM v_letters l""",
    ),
    "fill_gaps": (
        lambda d: D.fill_gaps(read_by(d, "v_predicted", 7, 2, "read"), read_by(d, "v_truth", 11, 1, "exact")),
        """SELECT coalesce(p.doc_id, t.doc_id) AS doc_id, coalesce(p.field, t.field) AS field, coalesce(nullif(p.value, ''), t.value) AS value,
        CASE WHEN coalesce(p.value, '') <> '' THEN 2 ELSE 1 END AS page, CASE WHEN coalesce(p.value, '') <> '' THEN 'read' ELSE 'exact' END AS provenance, CASE WHEN coalesce(p.value, '') <> '' THEN 'primary' ELSE 'secondary' END AS source
        FROM (SELECT * FROM v_predicted WHERE doc_id % 7 <> 0) p FULL JOIN (SELECT * FROM v_truth WHERE doc_id % 11 <> 0) t ON p.doc_id = t.doc_id AND p.field = t.field WHERE coalesce(nullif(p.value, ''), nullif(t.value, '')) IS NOT NULL""",
    ),
    "template_drift": (
        lambda d: D.template_drift(d.v_truth.select("doc_id", "field"), d.v_predicted.select("doc_id", "field", "value")),
        "SELECT doc_id, field FROM v_truth t WHERE NOT EXISTS (SELECT 1 FROM v_predicted p WHERE p.doc_id = t.doc_id AND p.field = t.field AND p.value <> '')",
    ),
    "reader_crosscheck": (
        lambda d: D.reader_crosscheck(
            long(d, "v_truth").unionByName(days(d, F.lit(False)).select("doc_id", "field", F.col("day").cast("string").alias("value"))),
            long(d, "v_predicted", 11).unionByName(days(d, F.col("id") % 10 == 1).select("doc_id", "field", F.date_format("day", "d-MM-yyyy").alias("value"))),
        ),
        """WITH x AS (SELECT coalesce(t.doc_id, p.doc_id) AS doc_id, coalesce(t.field, p.field) AS field, t.value AS a, p.value AS b FROM (SELECT * FROM v_truth WHERE doc_id % 7 <> 0) t FULL JOIN (SELECT * FROM v_predicted WHERE doc_id % 11 <> 0) p ON p.doc_id = t.doc_id AND p.field = t.field)
        SELECT doc_id, field, CASE WHEN coalesce(a, '') = '' OR coalesce(b, '') = '' THEN 'unverified' WHEN field = 'total' THEN CASE WHEN coalesce(abs(try_cast(a AS double) - try_cast(b AS double)) <= 0.02, false) THEN 'agree' ELSE 'disagree' END
        WHEN contains(regexp_replace(lower(a), '[^\\p{L}\\p{N}]', '', 'g'), regexp_replace(lower(b), '[^\\p{L}\\p{N}]', '', 'g')) OR contains(regexp_replace(lower(b), '[^\\p{L}\\p{N}]', '', 'g'), regexp_replace(lower(a), '[^\\p{L}\\p{N}]', '', 'g')) THEN 'agree' ELSE 'disagree' END AS verdict FROM x
        UNION ALL SELECT id, 'issue_date', CASE WHEN id % 10 = 1 THEN 'disagree' ELSE 'agree' END FROM v_invoices""",
    ),
    "field_triage": (
        lambda d: D.field_triage(d.v_truth.select(F.col("doc_id").alias("id"), "field", "value", F.when(F.col("doc_id") % 5 == 0, "derived").otherwise("read").alias("provenance")), ("invoiceNumber", "currency", "total")),
        """WITH x AS (SELECT doc_id AS id, field, CASE WHEN value = '' THEN 'missing' WHEN doc_id % 5 = 0 THEN 'derived' END AS reason FROM v_truth)
        SELECT id, field, CASE WHEN reason IS NULL THEN 'green' ELSE 'amber' END AS colour, reason, cast(row_number() OVER (PARTITION BY id ORDER BY CASE WHEN reason IS NULL THEN 1 ELSE 0 END, list_position(['invoiceNumber', 'currency', 'total'], field)) AS int) AS place FROM x""",
    ),
    "page_confidence": (
        lambda d: D.page_confidence(d.documents.select("doc_id", (F.col("n_chars") % 100 / 100).alias("confidence"))),
        "SELECT doc_id, avg(n_chars % 100 / 100) AS confidence FROM documents GROUP BY 1",
    ),
    "producer_signals": (
        lambda d: D.producer_signals(d.documents),
        "WITH s AS (SELECT source, doc_id, sum(length(text)) AS c FROM documents GROUP BY 1, 2) SELECT source, CASE WHEN c >= 400 THEN 'text-layer' WHEN c >= 100 THEN 'mixed' ELSE 'image-only' END AS kind, count(*) AS n FROM s GROUP BY 1, 2",
    ),
    "vendor_embedding": (
        lambda d: D.vendor_embedding(d.v_invoices.select(F.col("id").alias("doc_id"), F.col("vendor").alias("text"))),
        """WITH w AS (SELECT id AS doc_id, list_filter(string_split_regex(lower(vendor), '[^a-z0-9]+'), lambda x: length(x) > 1) AS w FROM v_invoices),
        b AS (SELECT doc_id, w, list_transform(w, lambda x: cast('0x' || substring(md5(x), 1, 8) AS bigint) % 256) AS b FROM w),
        n AS (SELECT doc_id, w, list_transform(range(256), lambda i: cast(len(list_filter(b, lambda x: x = i)) AS double)) AS n FROM b)
        SELECT doc_id, sha256(array_to_string(list_sort(list_distinct(w)), ' ')) AS fingerprint, list_transform(n, lambda x: x / sqrt(list_sum(list_transform(n, lambda y: y * y)))) AS embedding FROM n""",
    ),
    "eval_metrics": (
        lambda d: E.eval_metrics(d.v_truth, d.v_predicted),
        f"WITH {OUT} SELECT source, field, n_correct, n_wrong, n_missing, n_unexpected, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM m",
    ),
    "corpus_report": (
        lambda d: E.corpus_report(d.v_truth, d.v_predicted, ("total", "currency")),
        f"""WITH {OUT}, w AS (SELECT source, doc_id, CASE WHEN count(*) FILTER (WHERE field IN ('total', 'currency') AND outcome = 'correct') = 2 THEN 1.0 ELSE 0.0 END AS k FROM o WHERE outcome IS NOT NULL GROUP BY 1, 2),
        z AS (SELECT source, count(*) AS n_docs, round(avg(k), 3) AS complete_rate FROM w GROUP BY 1) SELECT source, n_docs, complete_rate, round(p, 3) AS precision, round(r, 3) AS recall FROM z JOIN (SELECT * FROM m WHERE source <> 'all' AND field = 'all') USING (source)""",
    ),
    "line_item_matches": (
        lambda d: E.line_item_matches(d.v_lines.select(F.col("invoice_id").alias("doc_id"), "description", "amount"), d.v_lines.filter("line_no % 3 <> 0").select(F.col("invoice_id").alias("doc_id"), "description", (F.col("amount") + F.when(F.col("line_no") % 5 == 0, 1).otherwise(0)).alias("amount"))),
        """WITH a AS (SELECT invoice_id AS doc_id, lower(trim(description)) AS t, cast(round(amount * 100) AS bigint) AS c, row_number() OVER (PARTITION BY invoice_id, lower(trim(description)), cast(round(amount * 100) AS bigint)) AS n FROM v_lines),
        b0 AS (SELECT invoice_id AS doc_id, lower(trim(description)) AS t, cast(round((amount + CASE WHEN line_no % 5 = 0 THEN 1 ELSE 0 END) * 100) AS bigint) AS c FROM v_lines WHERE line_no % 3 <> 0), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, t, c) AS n FROM b0)
        SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, count(a.doc_id) AS n_truth, count(b.doc_id) AS n_predicted, count(*) FILTER (WHERE a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL) AS n_matched FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.t = b.t AND a.c = b.c AND a.n = b.n GROUP BY 1""",
    ),
}
