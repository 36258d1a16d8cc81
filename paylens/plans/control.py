"""Queries on baselines, anomalies, audit and the lifecycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anomalies, checks, documents, duplicates, governance, lookups, matching, vendors
from ..sources.scratch import written
from ..streaming import checks as streams
from .lines import COVER, CROSS, ISSUES, KEYED, MATCH, PEERS, QUERIES as LINE_QUERIES, keyed, matched
from .vendors import QUERIES as VENDOR_QUERIES, printed, proposed
from .views import AS_OF

OPEN = "status IN ('vendor_profile', 'processing', 'failed', 'draft', 'review', 'scheduled')"
STATS = f"""{PEERS},
r0 AS (SELECT *, date_diff('day', issue_date, due_date) AS term, date_diff('day', lag(issue_date) OVER w, issue_date) AS gap,
  regexp_extract(trim(invoice_number), '^(.*?)(\\d+)$', 1) AS px, regexp_extract(trim(invoice_number), '^(.*?)(\\d+)$', 2) AS dg FROM k WINDOW w AS (PARTITION BY vendor_key ORDER BY issue_date, created_at, id)),
r1 AS (SELECT *, CASE WHEN length(dg) >= 2 AND NOT (px = '' AND length(dg) = 4) THEN {{'value': cast(dg AS bigint), 'prefix': px}} END AS num FROM r0),
st AS (SELECT id, vendor_key, total, issue_date, due_date, status, term, gap, num, count(*) OVER w AS n_prior,
  quantile_cont(CASE WHEN total > 0 THEN total END, 0.5) OVER w AS median_total, list(CASE WHEN total > 0 THEN total END) OVER w AS am,
  count(CASE WHEN gap > 0 THEN 1 END) OVER w AS n_gaps, quantile_cont(CASE WHEN gap > 0 THEN gap END, 0.5) OVER w AS mi,
  count(CASE WHEN term >= 0 THEN 1 END) OVER w AS n_terms, quantile_cont(CASE WHEN term >= 0 THEN term END, 0.5) OVER w AS mt,
  avg(CASE WHEN total > 0 THEN CASE WHEN total % 100 = 0 THEN 1.0 ELSE 0.0 END END) OVER w AS rs, max(num) OVER w AS ln, list(num) OVER w AS nums
  FROM r1 WINDOW w AS (PARTITION BY vendor_key ORDER BY issue_date, created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
sm AS (SELECT *, coalesce(list_median(list_transform(list_filter(am, lambda x: x IS NOT NULL), lambda x: abs(x - median_total))), 0) AS mad,
  coalesce(list_max(list_transform(list_filter(am, lambda x: x IS NOT NULL), lambda x: len(list_filter(am, lambda y: y = x)))), 0) AS rep FROM st),
kn4 AS (SELECT * FROM sm WHERE n_prior >= 4),
f_amount AS (SELECT id, 'amount_outlier' AS kind, CASE WHEN total / median_total >= 3 THEN 'high' ELSE 'warn' END AS severity FROM kn4 WHERE median_total > 0 AND abs(total - median_total) / CASE WHEN mad > 0 THEN mad ELSE median_total * 0.5 END >= 3.5),
ser AS (SELECT id, num, ln, list_sort(list_transform(list_filter(nums, lambda x: x IS NOT NULL AND x.prefix = num.prefix), lambda x: x.value)) AS s FROM kn4 WHERE num.prefix = ln.prefix),
stp AS (SELECT *, list_filter(list_transform(range(1, len(s)), lambda i: s[i + 1] - s[i]), lambda x: x > 0) AS d FROM ser),
f_gap AS (SELECT id, 'number_gap' AS kind, 'warn' AS severity FROM stp WHERE num.value < ln.value OR num.value - ln.value - CASE WHEN len(d) = 0 THEN 1 ELSE greatest(floor(list_median(d) + 0.5), 1) END >= 1),
tm AS (SELECT id, coalesce(n_terms >= 2 AND mt > 0 AND abs(term - mt) >= 7, false) AS a, coalesce(n_gaps >= 2 AND gap > 0 AND mi >= 3 AND (gap < mi * 0.5 OR gap > mi * 2), false) AS b FROM kn4),
f_time AS (SELECT id, 'timing_change' AS kind, CASE WHEN a THEN 'high' ELSE 'warn' END AS severity FROM tm WHERE a OR b),
f_round AS (SELECT id, 'round_amount' AS kind, 'warn' AS severity FROM kn4 WHERE total > 0 AND total % 100 = 0 AND coalesce(rs, 0) < 0.25),
f_benign AS (SELECT id, 'benign_duplicate' AS kind, 'info' AS severity FROM kn4 JOIN peers USING (id) WHERE median_total > 0 AND rep >= 3 AND abs(total - median_total) / greatest(total, median_total) <= 0.01
  AND (coalesce(mi, 0) <= 0 OR abs(date_diff('day', peer_issue_date, issue_date) - mi) <= greatest(3, mi * 0.34))),
found AS (SELECT f.* FROM (SELECT * FROM f_amount UNION ALL SELECT * FROM f_gap UNION ALL SELECT * FROM f_time UNION ALL SELECT * FROM f_round UNION ALL SELECT * FROM f_benign) f JOIN v_invoices i USING (id) WHERE i.{OPEN})"""
COVER_ALONE = COVER.replace("c AS (", "cov_c AS (", 1).replace("LEFT JOIN c USING", "LEFT JOIN cov_c c USING").replace("r AS (SELECT i.id", "cov_r AS (SELECT i.id", 1).replace("LEFT JOIN r USING", "LEFT JOIN cov_r r USING")
APPROVE_ISSUES = ISSUES.replace("SEVERITY", "error")
LATEST = "latest AS (SELECT invoice_id AS id, arg_max(status, event_at) AS sync FROM v_sync GROUP BY 1)"
ATTENTION = f"""{LATEST}, att AS (SELECT i.id, CASE WHEN sync = 'failed' THEN 'sync_failed' WHEN contains(memo, 'held:') THEN 'held' WHEN i.status = 'review' AND po_id IS NULL AND coalesce(cover.status, 'unmatched') <> 'matched' THEN 'no_po' END AS kind,
  cover.status AS cs, memo FROM v_invoices i LEFT JOIN latest USING (id) LEFT JOIN cover USING (id))"""


def stats(d):
    return anomalies.prior_stats(keyed(d))


def peers(d):
    return duplicates.duplicate_peers(keyed(d))


def coverage(d):
    return matching.no_po_coverage(d.v_invoices, d.v_contracts, d.v_flex_receipts, d.v_rules)


def attention(d):
    return governance.attention(d.v_invoices, lookups.latest_sync(d.v_sync), coverage(d))


def audit(d):
    """Requests as an audit trail, each entry with a hash over itself and the one before.

    One entry in 89 has no hash, and the chain starts anew after it. Later one in 97 was altered and one in
    101 was taken out.
    """
    entry = F.struct(F.col("event_id").alias("seq"), "actor", F.col("transition").alias("action"), "note")
    trails = d.v_requests.groupBy("invoice_id").agg(F.sort_array(F.collect_list(entry)).alias("entries"))

    def chained(so_far, e):
        known = F.when(e.seq % 89 != 0, governance.entry_hash(so_far.last, [F.col("invoice_id"), e.seq, e.actor, e.action, e.note]))
        link = F.struct(so_far.last.alias("previous"), known.alias("hash"))
        return F.struct(F.coalesce(known, F.lit("")).alias("last"), F.array_append(so_far.links, link).alias("links"))

    start = F.struct(F.lit("").alias("last"), F.array().cast("array<struct<previous:string,hash:string>>").alias("links"))
    rows = trails.select("invoice_id", F.explode(F.arrays_zip("entries", F.aggregate("entries", start, chained).links.alias("links"))).alias("z"))
    rows = rows.select("invoice_id", "z.entries.*", F.nullif("z.links.previous", F.lit("")).alias("previous_hash"), "z.links.hash")
    return rows.filter("seq % 101 <> 0").withColumn("note", F.when(F.col("seq") % 97 == 0, "altered").otherwise(F.col("note")))


def events(d):
    return d.v_requests.select("invoice_id", F.col("event_id").alias("seq"), "actor", F.col("transition").alias("action"))


def approval_checks(d):
    """Everything that an approval is judged by, from the invoices, their orders, vendors' records, tags and letters."""
    d.keep("v_invoices", "v_lines")
    matches = matched(d).withColumn("mode", F.lit("three_way"))
    tags = duplicates.auto_tags(d.v_invoices, duplicates.duplicate_peers(keyed(d), lambda rows: written(rows, "alike")), AS_OF).select("id", F.explode("tags").alias("tag"))
    prepaid = d.v_letters.filter(documents.doc_prepaid(F.col("text")).isNotNull()).select(F.col("doc_id").alias("id"))
    identity = vendors.vendor_record_compare(printed(d), proposed(d).filter("k % 9 <> 0"))
    issues = checks.validation_issues(d.v_invoices, d.v_lines, "approve")
    return governance.approval_checks(d.v_invoices, issues, identity, checks.tax_findings(d.v_invoices, "NL123456789B01"), matches, coverage(d), tags, prepaid)


SPECS = ", ".join(f"('{t}', {starts or ['']}, '{to}', {roles}, {str(reason).lower()}, '{governance.DUTIES.get(t, '')}')" for t, (starts, to, roles, reason) in governance.TRANSITIONS.items())
LAST = "SELECT invoice_id, event_id, outcome, status FROM f WHERE n > 0"
# One request after the other, invoice by invoice: the state after each is that of the next.
REPLAY = f"""WITH RECURSIVE t(transition, starts, target, roles, reason, duty) AS (VALUES {SPECS}),
q AS (SELECT *, row_number() OVER (PARTITION BY invoice_id ORDER BY event_at, event_id) AS n FROM v_requests),
x AS (SELECT q.*, t.starts, t.target, t.roles, t.reason, t.duty FROM q LEFT JOIN t USING (transition)),
f AS (SELECT invoice_id, cast(0 AS bigint) AS n, cast(NULL AS bigint) AS event_id, '' AS outcome, 'draft' AS status, cast(NULL AS varchar) AS confirmed, cast(NULL AS varchar) AS approved, cast(NULL AS varchar) AS released FROM (SELECT DISTINCT invoice_id FROM q)
UNION ALL SELECT invoice_id, n, event_id, o, CASE o WHEN 'accepted' THEN target ELSE was END, CASE WHEN o = 'accepted' AND duty = 'confirmed' THEN actor ELSE confirmed END,
  CASE WHEN o = 'accepted' AND duty = 'approved' THEN actor ELSE approved END, CASE WHEN o = 'accepted' AND duty = 'released' THEN actor ELSE released END FROM (
  SELECT x.invoice_id, x.n, x.event_id, x.actor, x.target, x.duty, f.status AS was, f.confirmed, f.approved, f.released,
    CASE WHEN f.status = 'paid' AND x.transition <> 're-open' THEN 'immutable' WHEN x.target IS NULL OR NOT list_contains(x.starts, f.status) THEN 'illegal' WHEN NOT list_contains(x.roles, x.role) THEN 'role'
      WHEN x.reason AND trim(coalesce(x.note, '')) = '' THEN 'reason-required' WHEN x.role <> 'system' AND coalesce(x.duty = 'confirmed' AND x.actor = f.confirmed
        OR x.duty = 'approved' AND (x.actor = f.confirmed OR x.actor = f.approved) OR x.duty = 'released' AND (x.actor = f.approved OR x.actor = f.released), false) THEN 'sod' ELSE 'accepted' END AS o
  FROM f JOIN x ON x.invoice_id = f.invoice_id AND x.n = f.n + 1))
{LAST}"""


QUERIES = {
    "vendor_baseline": (
        lambda d: anomalies.vendor_baseline(keyed(d)),
        f"""WITH {KEYED}, r0 AS (SELECT *, date_diff('day', issue_date, due_date) AS term, date_diff('day', lag(issue_date) OVER w, issue_date) AS gap, regexp_extract(trim(invoice_number), '^(.*?)(\\d+)$', 1) AS px, regexp_extract(trim(invoice_number), '^(.*?)(\\d+)$', 2) AS dg FROM k WINDOW w AS (PARTITION BY vendor_key ORDER BY issue_date, created_at, id)),
        m AS (SELECT vendor_key, quantile_cont(total, 0.5) FILTER (WHERE total > 0) AS med FROM r0 GROUP BY 1),
        c AS (SELECT vendor_key, max(n) AS repeated FROM (SELECT vendor_key, total, count(*) AS n FROM r0 WHERE total > 0 GROUP BY 1, 2) GROUP BY 1)
        SELECT vendor_key, count(*) AS sample_size, any_value(med) AS median_total, min(total) FILTER (WHERE total > 0) AS min_total, max(total) FILTER (WHERE total > 0) AS max_total,
        quantile_cont(gap, 0.5) FILTER (WHERE gap > 0) AS median_interval, quantile_cont(term, 0.5) FILTER (WHERE term >= 0) AS median_term, max(issue_date) AS last_issue_date,
        max(CASE WHEN length(dg) >= 2 AND NOT (px = '' AND length(dg) = 4) THEN cast(dg AS bigint) END) AS last_number, avg(CASE WHEN total % 100 = 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE total > 0) AS round_share,
        quantile_cont(abs(total - med), 0.5) FILTER (WHERE total > 0) AS amount_mad, any_value(repeated) AS repeated FROM r0 JOIN m USING (vendor_key) LEFT JOIN c USING (vendor_key) GROUP BY 1""",
    ),
    "anomaly_prior_stats": (
        lambda d: stats(d).select("id", "n_prior", "median_total", "n_gaps", "median_interval", "n_terms", "median_term", "round_share", "amount_mad", "repeated", F.col("last_number.value").alias("last_number")),
        f"WITH {STATS} SELECT id, n_prior, median_total, n_gaps, mi AS median_interval, n_terms, mt AS median_term, rs AS round_share, mad AS amount_mad, cast(rep AS int) AS repeated, ln.value AS last_number FROM sm",
    ),
    "anomaly_amount": (lambda d: anomalies.anomaly_amount(stats(d)), f"WITH {STATS} SELECT * FROM f_amount"),
    "anomaly_number_gap": (lambda d: anomalies.anomaly_number_gap(stats(d)), f"WITH {STATS} SELECT * FROM f_gap"),
    "anomaly_timing": (lambda d: anomalies.anomaly_timing(stats(d)), f"WITH {STATS} SELECT * FROM f_time"),
    "anomaly_round": (lambda d: anomalies.anomaly_round(stats(d)), f"WITH {STATS} SELECT * FROM f_round"),
    "anomaly_benign_dup": (
        lambda d: anomalies.anomaly_benign_dup(anomalies.prior_stats(d.v_weekly), duplicates.duplicate_peers(d.v_weekly)),
        "SELECT id, 'benign_duplicate' AS kind, 'info' AS severity FROM v_weekly WHERE id % 10 = 5 OR id % 10 = 7 AND total = 100.5",
    ),
    "anomaly_findings": (lambda d: anomalies.anomaly_findings(keyed(d.keep("v_invoices")), duplicates.duplicate_peers), f"WITH {STATS} SELECT * FROM found"),
    "attention": (
        lambda d: attention(d),
        f"WITH {COVER}, {ATTENTION} SELECT id, kind, CASE WHEN kind = 'held' THEN coalesce(nullif(trim(split_part(memo, 'held:', 2)), ''), 'Held') WHEN kind = 'no_po' THEN coalesce(cs, 'no order') ELSE 'sync failed' END AS detail FROM att WHERE kind IS NOT NULL",
    ),
    "exception_queue": (
        lambda d: governance.exception_queue(attention(d.keep("v_invoices")), anomalies.anomaly_findings(keyed(d), duplicates.duplicate_peers), d.v_invoices),
        f"""WITH {COVER_ALONE}, {ATTENTION}, {STATS},
        q AS (SELECT id, kind, 'high' AS severity FROM att WHERE kind IS NOT NULL UNION ALL SELECT * FROM found)
        SELECT q.*, cast(list_position(['sync_failed', 'held', 'no_po', 'amount_outlier', 'timing_change', 'number_gap', 'round_amount', 'benign_duplicate'], kind) - 1 AS int) AS kind_rank, cast(list_position(['high', 'warn', 'info'], severity) - 1 AS int) AS severity_rank
        FROM q JOIN v_invoices i USING (id) WHERE i.status NOT IN ('paid', 'rejected', 'archived')""",
    ),
    "standing": (
        lambda d: governance.standing(d.v_invoices, AS_OF),
        f"""SELECT coalesce(nullif(currency, ''), 'EUR') AS currency, count(*) AS n, cast(sum(cast(total AS decimal(18,2))) AS double) AS amount, count(*) FILTER (WHERE status <> 'scheduled' AND status <> 'processing') AS needs_person,
        count(*) FILTER (WHERE due_date < DATE '{AS_OF}') AS n_late FROM v_invoices WHERE {OPEN} GROUP BY 1""",
    ),
    "blocked_groups": (lambda d: governance.blocked_groups(attention(d)), f"WITH {COVER}, {ATTENTION} SELECT kind, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM att WHERE kind IS NOT NULL GROUP BY 1"),
    "audit_chain_verify": (
        lambda d: governance.audit_chain_verify(audit(d)),
        """WITH p AS (SELECT invoice_id, event_id AS seq, CASE WHEN event_id % 89 <> 0 THEN event_id END AS own FROM v_requests),
        c AS (SELECT *, lag(own) OVER (PARTITION BY invoice_id ORDER BY seq) AS written FROM p),
        l AS (SELECT *, lag(own) OVER (PARTITION BY invoice_id ORDER BY seq) AS found FROM c WHERE seq % 101 <> 0),
        b AS (SELECT *, own IS NOT NULL AND (written IS DISTINCT FROM found OR seq % 97 = 0) AS broken FROM l)
        SELECT invoice_id, count(*) AS n_entries, count(*) FILTER (WHERE broken) = 0 AS valid, min(seq) FILTER (WHERE broken) AS first_break FROM b GROUP BY 1""",
    ),
    "audit_diff": (
        lambda d: governance.audit_diff(d.v_invoices, d.v_invoices.withColumn("department", F.when(F.col("id") % 9 == 0, "CHANGED").otherwise(F.col("department"))).withColumn("po_id", F.when(F.col("id") % 6 == 0, "po-x").otherwise(F.col("po_id"))), ["department", "po_id", "iban"]),
        "SELECT id, 'department' AS field, department AS before, 'CHANGED' AS after FROM v_invoices WHERE id % 9 = 0 UNION ALL SELECT id, 'po_id', po_id, 'po-x' FROM v_invoices WHERE id % 6 = 0",
    ),
    "correction_log": (
        lambda d: governance.correction_log(d.v_invoices, d.v_invoices.withColumn("memo", F.when(F.col("id") % 9 == 0, "new").otherwise(F.col("memo"))).withColumn("total", F.col("total") + 1), ["memo", "total", "iban"]),
        "SELECT 'memo' AS field, count(*) AS n_corrected FROM v_invoices WHERE id % 9 = 0 UNION ALL SELECT 'total', count(*) FROM v_invoices",
    ),
    "corrected_fields": (
        lambda d: governance.corrected_fields(events(d).withColumn("action", F.when(F.col("seq") % 5 == 0, "Corrected Total").when(F.col("seq") % 5 == 1, "Corrected Vendor").otherwise(F.col("action"))), d.spark.createDataFrame([("Total", "total"), ("Vendor", "vendor")], "label string, field string")),
        "SELECT DISTINCT invoice_id, CASE WHEN event_id % 5 = 0 THEN 'total' ELSE 'vendor' END AS field FROM v_requests WHERE event_id % 5 < 2",
    ),
    "sod_state": (
        lambda d: governance.sod_state(events(d)),
        "SELECT invoice_id, arg_max(actor, event_id) FILTER (WHERE transition = 'confirm') AS confirmed, arg_max(actor, event_id) FILTER (WHERE transition = 'approve') AS approved, arg_max(actor, event_id) FILTER (WHERE transition = 'release') AS released FROM v_requests GROUP BY 1",
    ),
    "last_decision": (
        lambda d: governance.last_decision(events(d)),
        "SELECT invoice_id, transition AS action, actor, event_id AS seq FROM v_requests WHERE transition IN ('approve', 'reject') QUALIFY row_number() OVER (PARTITION BY invoice_id ORDER BY event_id DESC) = 1",
    ),
    "lifecycle_replay": (lambda d: governance.lifecycle_replay(d.v_requests), REPLAY),
    "approval_gate": (
        lambda d: governance.approval_gate(d.keep("v_invoices", "v_lines").v_invoices.filter("status in ('draft', 'review')").select("id", "po_id"), checks.validation_issues(d.v_invoices, d.v_lines, "approve"), matching.po_match_summary(matched(d), True), coverage(d)),
        f"""WITH {MATCH[5:]}, {COVER_ALONE}, bad AS (SELECT DISTINCT id FROM ({APPROVE_ISSUES}) WHERE severity = 'error'), orderless AS (SELECT invoice_id AS id FROM m3 GROUP BY 1 HAVING bool_and(status = 'no_po')), short AS (SELECT DISTINCT invoice_id AS id FROM m3 WHERE status <> 'matched')
        SELECT i.id, CASE WHEN i.id IN (SELECT id FROM bad) THEN 'validation' WHEN po_id IS NOT NULL AND i.id IN (SELECT id FROM short) AND i.id NOT IN (SELECT id FROM orderless) THEN 'order_match' WHEN c.status = 'exception' THEN 'coverage' ELSE 'pass' END AS verdict
        FROM v_invoices i LEFT JOIN cover c USING (id) WHERE i.status IN ('draft', 'review')""",
    ),
    "approval_verdict": (
        lambda d: governance.approval_verdict(d.keep("v_invoices").v_invoices, approval_checks(d)),
        f"""WITH {MATCH[5:]}, {COVER_ALONE}, ol AS (SELECT invoice_id, count(*) FILTER (WHERE status <> 'matched') AS n_off FROM m3 GROUP BY 1 HAVING NOT bool_and(status = 'no_po')),
        f AS (SELECT id, 'blocking' AS s FROM ({APPROVE_ISSUES}) WHERE severity = 'error'
          UNION ALL SELECT id, CASE verdict WHEN 'ok' THEN 'ok' ELSE 'attention' END FROM ({VENDOR_QUERIES["vendor_record_compare"][1]})
          UNION ALL SELECT id, CASE severity WHEN 'ok' THEN 'ok' ELSE 'attention' END FROM ({LINE_QUERIES["tax_findings"][1]})
          UNION ALL SELECT invoice_id, CASE status WHEN 'matched' THEN 'ok' ELSE 'blocking' END FROM m3 WHERE invoice_id IN (SELECT invoice_id FROM ol)
          UNION ALL SELECT i.id, CASE c.status WHEN 'exception' THEN 'blocking' WHEN 'matched' THEN 'ok' ELSE 'attention' END FROM v_invoices i LEFT JOIN cover c USING (id) WHERE i.id NOT IN (SELECT invoice_id FROM ol)
          UNION ALL SELECT invoice_id, CASE n_off WHEN 0 THEN 'ok' ELSE 'attention' END FROM ol
          UNION ALL SELECT id, CASE WHEN tag IN ('Duplicate risk', 'First-time vendor', 'Late') THEN 'attention' ELSE 'ok' END FROM (SELECT id, unnest(tags) AS tag FROM ({LINE_QUERIES["auto_tags"][1]}))
          UNION ALL SELECT id, 'ok' FROM v_invoices WHERE gl_account <> '' OR department <> ''
          UNION ALL SELECT id, 'attention' FROM v_invoices WHERE id % 9 = 0 AND total > 0),
        n AS (SELECT id, count(*) FILTER (WHERE s = 'blocking') AS b, count(*) FILTER (WHERE s = 'attention') AS a, count(*) FILTER (WHERE s = 'ok') AS o FROM f GROUP BY 1)
        SELECT i.id, coalesce(b, 0) AS n_blocking, coalesce(a, 0) AS n_attention, coalesce(o, 0) AS n_ok, coalesce(b, 0) = 0 AS approvable FROM v_invoices i LEFT JOIN n USING (id)""",
    ),
    "lifecycle_outcomes": (lambda d: governance.lifecycle_replay(d.v_requests).groupBy("outcome").agg(F.count("*").alias("n")), f"{REPLAY.removesuffix(LAST)} SELECT outcome, count(*) AS n FROM f WHERE n > 0 GROUP BY 1"),
    "stream_lifecycle": (lambda d: streams.drained(streams.lifecycle(streams.folder_stream(d.spark, d.v_requests, "requests", key="invoice_id")), "lifecycle"), REPLAY),
    "stream_invoice_monitor": (
        lambda d: streams.drained(streams.folder_stream(d.spark, keyed(d), "arrivals", 2), "monitor", each=lambda b: streams.monitored(b, keyed(d), AS_OF)),
        f"""WITH {STATS} SELECT id, 'tag' AS source, unnest(tags) AS finding FROM ({LINE_QUERIES["auto_tags"][1]})
        UNION ALL SELECT id, 'duplicate', cast(peer AS varchar) FROM peers UNION ALL SELECT id, 'anomaly', kind FROM found""",
    ),
}
