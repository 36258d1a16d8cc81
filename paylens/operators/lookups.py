"""Lookups: vendors, rates, entities and the newest events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.money import currency_of, exact_sum, key_of


def vendor_keys(profiles: DataFrame) -> DataFrame:
    """spelling and vendor_key, one row a spelling: a profile's key and its aliases; the smallest key wins."""
    spellings = profiles.select("vendor_key", key_of("alias").alias("spelling")).unionByName(profiles.select("vendor_key", F.col("vendor_key").alias("spelling")))
    return spellings.groupBy("spelling").agg(F.min("vendor_key").alias("vendor_key"))


def vendor_resolve(invoices: DataFrame, profiles: DataFrame) -> DataFrame:
    """invoices with vendor_key: the profile that has the spelling, else the spelling itself."""
    known = vendor_keys(profiles).withColumnRenamed("vendor_key", "__known")
    rows = invoices.withColumn("spelling", key_of("vendor")).join(known, "spelling", "left")
    return rows.withColumn("vendor_key", F.coalesce("__known", "spelling")).drop("__known", "spelling")


def vendor_routing(invoices: DataFrame, vendor_master: DataFrame) -> DataFrame:
    """id and first status: draft where the vendor is on file, else the profiling stage."""
    known = vendor_master.select(F.trim("name").alias("name")).distinct().withColumn("known", F.lit(True))
    rows = invoices.select("id", F.trim("vendor").alias("name")).join(known, "name", "left")
    return rows.select("id", F.when(F.col("known") & (F.col("name") != ""), "draft").otherwise("vendor_profile").alias("first_status"))


def fx_resolve(rates: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(base, quote) with rate: the newest positive rate, else the inverse of the newest the other way, else null; 1 within a currency."""
    newest = rates.filter("rate > 0").groupBy("base", "quote").agg(F.max_by("rate", F.struct("rate_at", "rate")).alias("rate"))
    direct = newest.withColumnRenamed("rate", "direct")
    inverse = newest.select(F.col("quote").alias("base"), F.col("base").alias("quote"), (1 / F.col("rate")).alias("inverse"))
    rows = pairs.join(direct, ["base", "quote"], "left").join(inverse, ["base", "quote"], "left")
    return rows.select("base", "quote", F.when(F.col("base") == F.col("quote"), 1.0).otherwise(F.coalesce("direct", "inverse")).alias("rate"))


def entity_assign(invoices: DataFrame, entities: DataFrame) -> DataFrame:
    """invoices with assigned_entity: the entity of the invoice, else the first one."""
    first = entities.agg(F.min_by("entity_id", "pos").alias("first_entity"))
    rows = invoices.join(entities.select(F.col("entity_id").alias("entity"), F.col("entity_id").alias("known")), "entity", "left").crossJoin(F.broadcast(first))
    return rows.withColumn("assigned_entity", F.coalesce("known", "first_entity")).drop("known", "first_entity")


def entity_totals(invoices: DataFrame, entities: DataFrame, rates: DataFrame, reporting: str) -> DataFrame:
    """assigned_entity, currency, amount, n, rate and converted: null rates where none is known."""
    sums = entity_assign(invoices, entities).groupBy("assigned_entity", currency_of(default=reporting).alias("currency")).agg(exact_sum("total").alias("amount"), F.count("*").alias("n"))
    pairs = sums.select(F.col("currency").alias("base"), F.lit(reporting).alias("quote")).distinct()
    found = fx_resolve(rates, pairs).select(F.col("base").alias("currency"), "rate")
    return sums.join(found, "currency", "left").withColumn("converted", F.col("amount") * F.col("rate"))


def consolidated_report(invoices: DataFrame, entities: DataFrame, rates: DataFrame, reporting: str = "EUR") -> DataFrame:
    """Per entity: invoices, missing currencies, total (null if a rate is missing), and the grand total over all (likewise)."""
    sums = entity_totals(invoices, entities, rates, reporting)
    by_entity = sums.groupBy(F.col("assigned_entity").alias("entity_id")).agg(F.sum("n").alias("n"), F.count_if(F.col("rate").isNull()).alias("n_missing"), F.sum("converted").alias("converted"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("rate").isNull(), F.col("currency")))), ",").alias("missing"))
    rows = entities.select("entity_id", "entity_name").join(by_entity, "entity_id", "left")
    rows = rows.select("entity_id", "entity_name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("missing", F.lit("")).alias("missing"), F.when(F.col("n_missing") == 0, F.round("converted", 2)).alias("total"))
    # There are as many rows as entities, a list people keep by hand.
    everything = rows.agg(F.count_if((F.col("n") > 0) & F.col("total").isNull()).alias("open"), F.sum("total").alias("sum"))
    return rows.crossJoin(F.broadcast(everything)).withColumn("consolidated", F.when(F.col("open") == 0, F.round(F.coalesce("sum", F.lit(0.0)), 2))).drop("open", "sum")


def missing_rates(invoices: DataFrame, rates: DataFrame, reporting: str = "EUR") -> DataFrame:
    pairs = invoices.select(currency_of(default=reporting).alias("base"), F.lit(reporting).alias("quote")).distinct()
    return fx_resolve(rates, pairs).filter("rate is null").select(F.col("base").alias("currency"))


def latest_sync(events: DataFrame, keys: tuple[str, ...] = ("invoice_id",)) -> DataFrame:
    """The newest event per invoice (and kind, if asked); the later id settles equal times."""
    newest = events.groupBy(*keys).agg(F.max(F.struct("event_at", "event_id", *[c for c in ("kind", "status") if c not in keys])).alias("e"))
    return newest.select(*keys, "e.*")


def sync_attempts(events: DataFrame) -> DataFrame:
    """Events with their attempt number per invoice and kind; what follows a success is no attempt and goes."""
    order = Window.partitionBy("invoice_id", "kind").orderBy("event_at", "event_id")
    done = F.max(F.when(F.col("status") == "synced", 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = events.withColumn("attempt", F.row_number().over(order)).withColumn("done", F.coalesce(done, F.lit(0)))
    return rows.filter("done = 0").select("event_id", "invoice_id", "kind", "status", "attempt")
