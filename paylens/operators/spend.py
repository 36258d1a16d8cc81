"""Spend: currency-safe totals, buckets and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.money import currency_of, exact_sum, key_of, label_of


def totals_by_currency(invoices: DataFrame) -> DataFrame:
    """currency, total, n: money is never added up across currencies."""
    return invoices.groupBy(currency_of().alias("currency")).agg(exact_sum("total").alias("total"), F.count("*").alias("n"))


def spend_filter(invoices: DataFrame, start: str | None = None, end: str | None = None, currency: str | None = None) -> DataFrame:
    """Invoices issued between two days, both included, in one currency; undated ones go only if a start is given."""
    kept = F.lit(True)
    if start:
        kept = kept & F.coalesce(F.col("issue_date") >= F.to_date(F.lit(start)), F.lit(False))
    if end:
        kept = kept & F.coalesce(F.col("issue_date") <= F.to_date(F.lit(end)), F.lit(True))
    if currency:
        kept = kept & (currency_of() == currency)
    return invoices.filter(kept)


def period_of(day: str, period: str) -> Column:
    quarter = F.concat(F.year(day), F.lit("-Q"), F.quarter(day))
    return F.coalesce(quarter if period == "quarter" else F.date_format(day, "yyyy-MM"), F.lit("Unknown period"))


DIMENSIONS = {"vendor": "Unassigned vendor", "category": "Uncategorized", "department": "Unassigned department", "entity": "Unassigned entity"}


def bucket_rows(invoices: DataFrame, period: str = "month") -> DataFrame:
    """id, ord, total, dimension, key, currency and label: which bucket an invoice belongs to, for five dimensions. Nothing is shuffled."""
    labels = {d: label_of(d, empty) for d, empty in DIMENSIONS.items()} | {"period": period_of("issue_date", period)}
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.lower(v).alias("key"), v.alias("label")) for d, v in labels.items()]))
    return invoices.select("id", "ord", "total", currency_of().alias("currency"), each.alias("d")).select("id", "ord", "total", "currency", "d.*")


BUCKET = ["dimension", "key", "currency"]


# Ids of a bucket are first listed by so many shares, so that no task holds a large bucket's invoices one by one.
SHARES = 64


def spend_buckets(invoices: DataFrame, period: str = "month") -> DataFrame:
    """dimension, key, currency, label, total, n, first_id, last_id, first_ord and the sorted invoice_ids over five dimensions at once.

    Labels that differ in case only share a bucket, under the spelling that came first (smallest ord). One
    pass: the rows are expanded to the dimensions, summed and listed by shares of the ids, and the shares put together as whole arrays.
    drilldown gives a bucket's invoices themselves.
    """
    share = F.pmod(F.xxhash64("id"), F.lit(SHARES)).alias("share")
    ends = [F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.min("ord").alias("first_ord")]
    ids = F.collect_set("id").alias("invoice_ids")
    parts = bucket_rows(invoices, period).groupBy(*BUCKET, share).agg(F.min_by("label", "ord").alias("label"), exact_sum("total").alias("total"), F.count("*").alias("n"), *ends, ids)
    return merge_buckets(parts)


def merge_buckets(parts: DataFrame) -> DataFrame:
    """Buckets of several parts of the invoices (kept ones and those of a new day, say) as those of all, from the buckets alone."""
    ends = [F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"), F.min("first_ord").alias("first_ord")]
    ids = F.sort_array(F.flatten(F.collect_list("invoice_ids"))).alias("invoice_ids")
    return parts.groupBy(*BUCKET).agg(F.min_by("label", "first_ord").alias("label"), exact_sum("total").alias("total"), F.sum("n").alias("n"), *ends, ids)


def top_buckets(buckets: DataFrame, dimension: str, limit: int = 12) -> DataFrame:
    """The largest buckets of a dimension, by total, then label and currency."""
    return buckets.filter(F.col("dimension") == dimension).orderBy(F.desc("total"), "label", "currency").limit(limit)


def open_pipeline(invoices: DataFrame) -> DataFrame:
    """Totals of what is neither rejected, archived nor paid."""
    return totals_by_currency(invoices.filter(~F.col("status").isin("rejected", "archived", "paid")))


def unassigned_groups(buckets: DataFrame) -> DataFrame:
    """dimension and how many of its buckets have no real value."""
    return buckets.groupBy("dimension").agg(F.count_if(F.col("label").startswith("Unassigned") | (F.col("label") == "Uncategorized")).alias("n_unassigned"))


def drilldown(invoices: DataFrame, buckets: DataFrame, period: str = "month") -> DataFrame:
    """The invoices behind the given buckets(dimension, key, currency): those that have one of their keys, each once."""
    wanted = buckets.select(*BUCKET).distinct()
    ids = bucket_rows(invoices, period).join(wanted, BUCKET, "left_semi").select("id").distinct()
    return invoices.join(ids, "id", "left_semi")


def vendor_rollup(invoices: DataFrame) -> DataFrame:
    """Open and paid counts and totals per vendor and currency."""
    paid, still = F.col("status") == "paid", ~F.col("status").isin("paid", "rejected", "archived")
    return invoices.groupBy(key_of("vendor").alias("vendor_key"), currency_of().alias("currency")).agg(
        F.count_if(still).alias("n_open"), F.coalesce(exact_sum(F.when(still, F.col("total"))), F.lit(0.0)).alias("open_total"),
        F.count_if(paid).alias("n_paid"), F.coalesce(exact_sum(F.when(paid, F.col("total"))), F.lit(0.0)).alias("paid_total"),
    )
