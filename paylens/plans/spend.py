"""Queries on spend, queue and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lookups, queue, spend
from ..sources.scratch import scratch_path
from .views import AS_OF

CUR = "coalesce(nullif(currency, ''), 'EUR')"
SUM = "cast(sum(cast(total AS decimal(18,2))) AS double)"
BUCKETS = f"""WITH paid AS (SELECT *, {CUR} AS cur FROM v_invoices WHERE status = 'paid'),
d AS (SELECT id, ord, total, cur, 'vendor' AS dimension, coalesce(nullif(trim(vendor), ''), 'Unassigned vendor') AS label FROM paid
UNION ALL SELECT id, ord, total, cur, 'category', coalesce(nullif(trim(category), ''), 'Uncategorized') FROM paid
UNION ALL SELECT id, ord, total, cur, 'department', coalesce(nullif(trim(department), ''), 'Unassigned department') FROM paid
UNION ALL SELECT id, ord, total, cur, 'entity', coalesce(nullif(trim(entity), ''), 'Unassigned entity') FROM paid
UNION ALL SELECT id, ord, total, cur, 'period', coalesce(strftime(issue_date, '%Y-%m'), 'Unknown period') FROM paid),
buckets AS (SELECT dimension, lower(label) AS k, cur AS currency, min_by(label, ord) AS label, {SUM} AS total, count(*) AS n, min(id) AS first_id, max(id) AS last_id, min(ord) AS first_ord, list_sort(list(DISTINCT id)) AS invoice_ids FROM d GROUP BY 1, 2, 3)"""


def paid(d):
    return d.v_invoices.filter("status = 'paid'")


# Rows that one task sorts and writes of the hand-off file.
ROWS_A_FILE = 100_000


def bookkeeping_file(d):
    """The lines of the hand-off file as they are read back; the reader takes the byte order mark off. Many rows are written as parts that follow each other."""
    path = scratch_path(d.spark, "handoff")
    marked = d.v_invoices.withColumns({"vendor": F.concat("vendor", F.lit(', "Dept"')), "memo": F.concat(F.lit("="), "memo")})
    numbers = d.v_po_lines.select("po_id").distinct().withColumn("number", F.upper("po_id"))
    files = max(1, -(-queue.handoff_filter(d.v_invoices).count() // ROWS_A_FILE))
    queue.write_bookkeeping_csv(queue.bookkeeping_rows(marked, numbers), path, files)
    return d.spark.read.option("lineSep", "\r\n").text(path).select(F.col("value").alias("line"))


QUERIES = {
    "totals_by_currency": (lambda d: spend.totals_by_currency(d.v_invoices), f"SELECT {CUR} AS currency, {SUM} AS total, count(*) AS n FROM v_invoices GROUP BY 1"),
    "spend_filter": (
        lambda d: spend.spend_filter(d.v_invoices, "1995-01-01", "1996-12-31", "EUR").select("id", "issue_date", "total"),
        f"SELECT id, issue_date, total FROM v_invoices WHERE issue_date BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' AND {CUR} = 'EUR'",
    ),
    "spend_buckets": (lambda d: spend.spend_buckets(paid(d)), f"{BUCKETS} SELECT dimension, k AS key, currency, label, total, n, first_id, last_id, first_ord, invoice_ids FROM buckets"),
    "top_buckets": (
        lambda d: spend.top_buckets(spend.spend_buckets(paid(d)), "vendor").drop("key", "first_id", "last_id", "first_ord", "invoice_ids"),
        f"{BUCKETS} SELECT dimension, currency, label, total, n FROM buckets WHERE dimension = 'vendor' ORDER BY total DESC, label, currency LIMIT 12",
    ),
    "open_pipeline": (lambda d: spend.open_pipeline(d.v_invoices), f"SELECT {CUR} AS currency, {SUM} AS total, count(*) AS n FROM v_invoices WHERE status NOT IN ('rejected', 'archived', 'paid') GROUP BY 1"),
    "unassigned_groups": (
        lambda d: spend.unassigned_groups(spend.spend_buckets(paid(d))),
        f"{BUCKETS} SELECT dimension, count(*) FILTER (WHERE label LIKE 'Unassigned%' OR label = 'Uncategorized') AS n_unassigned FROM buckets GROUP BY 1",
    ),
    "drilldown": (
        lambda d: spend.drilldown(paid(d), spend.spend_buckets(paid(d)).filter("dimension = 'department' and label = 'HIGH'")).select("id", "department", "total"),
        "SELECT id, department, total FROM v_invoices WHERE status = 'paid' AND department = 'HIGH'",
    ),
    "vendor_rollup": (
        lambda d: spend.vendor_rollup(d.v_invoices),
        f"""WITH x AS (SELECT lower(trim(vendor)) AS vendor_key, {CUR} AS currency, status NOT IN ('paid', 'rejected', 'archived') AS o, status = 'paid' AS p, cast(total AS decimal(18,2)) AS t FROM v_invoices)
        SELECT vendor_key, currency, count(*) FILTER (WHERE o) AS n_open, coalesce(cast(sum(t) FILTER (WHERE o) AS double), 0) AS open_total,
        count(*) FILTER (WHERE p) AS n_paid, coalesce(cast(sum(t) FILTER (WHERE p) AS double), 0) AS paid_total FROM x GROUP BY 1, 2""",
    ),
    "phase_classify": (
        lambda d: queue.phase_classify(d.v_invoices),
        "SELECT id, status, CASE WHEN status = 'vendor_profile' THEN 'profiling' WHEN status IN ('failed', 'draft', 'rejected', 'processing') THEN 'draft' WHEN status = 'review' THEN 'approval' WHEN status = 'scheduled' THEN 'payment' ELSE 'history' END AS phase FROM v_invoices",
    ),
    "phase_counts": (
        lambda d: queue.phase_counts(d.v_invoices),
        "SELECT CASE WHEN status = 'vendor_profile' THEN 'profiling' WHEN status IN ('failed', 'draft', 'rejected', 'processing') THEN 'draft' WHEN status = 'review' THEN 'approval' WHEN status = 'scheduled' THEN 'payment' ELSE 'history' END AS phase, count(*) AS n FROM v_invoices GROUP BY 1",
    ),
    "late_flag": (lambda d: queue.late_flag(d.v_invoices, AS_OF), f"SELECT id, due_date < DATE '{AS_OF}' AND status NOT IN ('paid', 'rejected', 'archived') AS late FROM v_invoices"),
    "inbox_rows": (
        lambda d: queue.inbox_rows(d.v_invoices, "draft", "high").select("id", "status", "rank", "day"),
        "SELECT id, status, cast(list_position(['failed', 'draft', 'rejected', 'processing'], status) AS bigint) AS rank, issue_date AS day FROM v_invoices WHERE status IN ('failed', 'draft', 'rejected') AND contains(lower(concat(vendor, chr(10), invoice_number, chr(10), department)), 'high')",
    ),
    "handoff_filter": (lambda d: queue.handoff_filter(d.v_invoices).select("id", "status", "source"), "SELECT id, status, source FROM v_invoices WHERE status = 'scheduled' AND source <> 'sample'"),
    "bookkeeping_csv": (
        lambda d: queue.bookkeeping_rows(d.v_invoices, d.v_po_lines.select("po_id").distinct().withColumn("number", F.upper("po_id"))),
        """SELECT i.invoice_number, cast(issue_date AS string) AS invoice_date, cast(due_date AS string) AS due_date, vendor, vat_number, iban, currency,
        cast(cast(round(subtotal, 2) AS decimal(18,2)) AS string) AS subtotal, cast(cast(round(tax, 2) AS decimal(18,2)) AS string) AS vat_amount, cast(cast(round(total, 2) AS decimal(18,2)) AS string) AS total,
        gl_account, department, category, '' AS cost_center, '' AS project, '' AS location, coalesce(p.number, '') AS po_number, memo
        FROM v_invoices i LEFT JOIN (SELECT DISTINCT po_id, upper(po_id) AS number FROM v_po_lines) p USING (po_id) WHERE status = 'scheduled' AND source <> 'sample'""",
    ),
    "bookkeeping_file": (
        lambda d: bookkeeping_file(d),
        """WITH r AS (SELECT i.invoice_number, cast(issue_date AS string) AS a, cast(due_date AS string) AS b, concat(chr(34), vendor, ', ', chr(34), chr(34), 'Dept', chr(34), chr(34), chr(34)) AS vendor, vat_number, iban, currency,
        cast(cast(round(subtotal, 2) AS decimal(18,2)) AS string) AS s, cast(cast(round(tax, 2) AS decimal(18,2)) AS string) AS x, cast(cast(round(total, 2) AS decimal(18,2)) AS string) AS t,
        gl_account, department, category, '' AS c, '' AS p, '' AS l, coalesce(p.number, '') AS po_number, concat(chr(39), '=', memo) AS m
        FROM v_invoices i LEFT JOIN (SELECT DISTINCT po_id, upper(po_id) AS number FROM v_po_lines) p USING (po_id) WHERE status = 'scheduled' AND source <> 'sample')
        SELECT 'invoice_number,invoice_date,due_date,vendor,vat_number,iban,currency,subtotal,vat_amount,total,gl_account,department,category,cost_center,project,location,po_number,memo' AS line
        UNION ALL SELECT concat_ws(',', invoice_number, a, b, vendor, vat_number, iban, currency, s, x, t, gl_account, department, category, c, p, l, po_number, m) FROM r""",
    ),
    "queue_split": (
        lambda d: queue.queue_split(d.v_invoices.filter("id % 3 <> 0"), d.v_invoices.filter("id % 3 <> 1").withColumn("status", F.lit("archived"))).select("id", "status", "place"),
        "SELECT id, CASE WHEN id % 3 = 0 THEN 'archived' ELSE status END AS status, CASE WHEN id % 3 = 0 THEN 'removed' WHEN status = 'paid' THEN 'history' ELSE 'active' END AS place FROM v_invoices",
    ),
    "keyed_upsert": (
        lambda d: queue.keyed_upsert(d.v_po_lines.filter("pos <= 2"), d.v_po_lines.filter("pos >= 2").withColumn("quantity", F.col("quantity") + 100), ["po_line_id"], d.v_po_lines.filter("pos = 4").select("po_line_id")).select("po_line_id", "quantity"),
        "SELECT po_line_id, CASE WHEN pos >= 2 THEN quantity + 100 ELSE quantity END AS quantity FROM v_po_lines WHERE pos <> 4",
    ),
    "field_evidence": (
        lambda d: queue.field_evidence(d.v_invoices, ["vendor", "invoice_number", "iban", "vat_number", "department"]),
        " UNION ALL ".join(f"SELECT id, '{f}' AS field, {f} AS value, engine, CASE WHEN engine = 'template' THEN 'exact' ELSE 'read' END AS provenance FROM v_invoices WHERE trim({f}) <> ''" for f in ("vendor", "invoice_number", "iban", "vat_number", "department")),
    ),
    "currencies": (lambda d: queue.currencies(d.v_invoices), f"SELECT DISTINCT {CUR} AS currency FROM v_invoices"),
    "vendor_resolve": (
        lambda d: lookups.vendor_resolve(d.v_invoices, d.v_profiles).select("id", "vendor_key"),
        "SELECT id, coalesce(p.vendor_key, lower(trim(vendor))) AS vendor_key FROM v_invoices LEFT JOIN (SELECT lower(alias) AS s, min(vendor_key) AS vendor_key FROM v_profiles GROUP BY 1) p ON p.s = lower(trim(vendor))",
    ),
    "vendor_routing": (
        lambda d: lookups.vendor_routing(d.v_invoices, d.customer.filter("c_custkey % 4 <> 0").select(F.col("c_name").alias("name"))),
        "SELECT id, CASE WHEN vendor IN (SELECT c_name FROM customer WHERE c_custkey % 4 <> 0) THEN 'draft' ELSE 'vendor_profile' END AS first_status FROM v_invoices",
    ),
    "fx_resolve": (
        lambda d: lookups.fx_resolve(d.v_fx, d.v_invoices.select(F.when(F.col("currency") == "", "EUR").otherwise(F.col("currency")).alias("base")).distinct().crossJoin(d.v_invoices.filter("currency <> ''").select(F.col("currency").alias("quote")).distinct())),
        f"""WITH c AS (SELECT DISTINCT {CUR} AS c FROM v_invoices), n AS (SELECT base, quote, arg_max(rate, rate_at) AS r FROM v_fx WHERE rate > 0 GROUP BY 1, 2)
        SELECT a.c AS base, b.c AS quote, CASE WHEN a.c = b.c THEN 1.0 ELSE coalesce(x.r, 1 / y.r) END AS rate FROM c a CROSS JOIN c b LEFT JOIN n x ON x.base = a.c AND x.quote = b.c LEFT JOIN n y ON y.base = b.c AND y.quote = a.c""",
    ),
    "entity_assign": (
        lambda d: lookups.entity_assign(d.v_invoices, d.v_entities).select("id", "assigned_entity"),
        "SELECT id, CASE WHEN entity IN (SELECT entity_id FROM v_entities) THEN entity ELSE 'ent-0' END AS assigned_entity FROM v_invoices",
    ),
    "consolidated_report": (
        lambda d: lookups.consolidated_report(d.v_invoices, d.v_entities, d.v_fx),
        f"""WITH s AS (SELECT CASE WHEN entity IN (SELECT entity_id FROM v_entities) THEN entity ELSE 'ent-0' END AS e, {CUR} AS c, {SUM} AS amount, count(*) AS n FROM v_invoices GROUP BY 1, 2),
        r AS (SELECT base, quote, arg_max(rate, rate_at) AS r FROM v_fx WHERE rate > 0 GROUP BY 1, 2),
        f AS (SELECT s.*, CASE WHEN c = 'EUR' THEN 1.0 ELSE coalesce(x.r, 1 / y.r) END AS rate FROM s LEFT JOIN r x ON x.base = c AND x.quote = 'EUR' LEFT JOIN r y ON y.base = 'EUR' AND y.quote = c),
        g AS (SELECT e, sum(n) AS n, count(*) FILTER (WHERE rate IS NULL) AS miss, sum(amount * rate) AS t, coalesce(string_agg(CASE WHEN rate IS NULL THEN c END, ',' ORDER BY c), '') AS missing FROM f GROUP BY 1),
        o AS (SELECT entity_id, entity_name, cast(coalesce(n, 0) AS bigint) AS n, coalesce(missing, '') AS missing, CASE WHEN miss = 0 THEN round(t, 2) END AS total FROM v_entities LEFT JOIN g ON e = entity_id)
        SELECT *, CASE WHEN (SELECT count(*) FROM o WHERE n > 0 AND total IS NULL) = 0 THEN round((SELECT sum(total) FROM o), 2) END AS consolidated FROM o""",
    ),
    "missing_rates": (
        lambda d: lookups.missing_rates(d.v_invoices, d.v_fx),
        f"SELECT DISTINCT {CUR} AS currency FROM v_invoices WHERE {CUR} <> 'EUR' AND {CUR} NOT IN (SELECT base FROM v_fx WHERE quote = 'EUR' AND rate > 0 UNION ALL SELECT quote FROM v_fx WHERE base = 'EUR' AND rate > 0)",
    ),
    "latest_sync": (
        lambda d: lookups.latest_sync(d.v_sync),
        "SELECT invoice_id, max(event_at) AS event_at, arg_max(event_id, event_at) AS event_id, arg_max(kind, event_at) AS kind, arg_max(status, event_at) AS status FROM v_sync GROUP BY 1",
    ),
    "sync_attempts": (
        lambda d: lookups.sync_attempts(d.v_sync),
        """WITH x AS (SELECT *, row_number() OVER w AS attempt, coalesce(max(CASE WHEN status = 'synced' THEN 1 ELSE 0 END) OVER (PARTITION BY invoice_id, kind ORDER BY event_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done
        FROM v_sync WINDOW w AS (PARTITION BY invoice_id, kind ORDER BY event_at, event_id)) SELECT event_id, invoice_id, kind, status, cast(attempt AS int) AS attempt FROM x WHERE done = 0""",
    ),
}
