"""Per-vendor baselines and anomalies against what came before."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from ..functions.money import is_round, same_amount
from ..functions.running import PrefixOrder, earlier_in_group, running_most
from ..sources.scratch import scratch_path
from .duplicates import amount_bucket

# Thresholds of the detectors.
MIN_PRIOR, OUTLIER_SCALE, RELATIVE_FLOOR, HIGH_MULTIPLE, TERM_SHIFT, ROUND_CEILING, REPEAT_MIN = 4, 3.5, 0.5, 3, 7, 0.25, 3


def parsed_number(number: Column) -> Column:
    """prefix and value of a number with a countable series: two last digits or more, and not a bare year."""
    trimmed = F.trim(number)
    prefix, digits = F.regexp_extract(trimmed, r"^(.*?)(\d+)$", 1), F.regexp_extract(trimmed, r"^(.*?)(\d+)$", 2)
    good = (F.length(digits) >= 2) & ~((prefix == "") & (F.length(digits) == 4))
    return F.when(good, F.struct(prefix.alias("prefix"), digits.try_cast("long").alias("value")))


def with_rhythm(invoices: DataFrame) -> DataFrame:
    """invoices with term (days to pay), gap (days since the vendor's previous invoice) and the parsed number."""
    order = Window.partitionBy("vendor_key").orderBy("issue_date", "created_at", "id")
    gap = F.datediff("issue_date", F.lag("issue_date").over(order))
    return invoices.withColumns({"term": F.datediff("due_date", "issue_date"), "gap": gap, "parsed": parsed_number(F.col("invoice_number"))})


def vendor_baseline(invoices: DataFrame) -> DataFrame:
    """Per vendor_key: sample, median, MAD, least and largest total, rhythm, terms, highest number, round share, repeats.

    Only totals above 0 are amounts, but all rows count as the sample. The median is joined back for the
    deviations; repeats are counted by (vendor, total) first, so no vendor's list is ever held whole.
    """
    rows = with_rhythm(invoices).withColumn("amount", F.when(F.col("total") > 0, F.col("total")))
    base = rows.groupBy("vendor_key").agg(
        F.count("*").alias("sample_size"), F.percentile("amount", 0.5).alias("median_total"), F.min("amount").alias("min_total"), F.max("amount").alias("max_total"),
        F.percentile(F.when(F.col("gap") > 0, F.col("gap")), 0.5).alias("median_interval"), F.percentile(F.when(F.col("term") >= 0, F.col("term")), 0.5).alias("median_term"),
        F.max("issue_date").alias("last_issue_date"), F.max("parsed.value").alias("last_number"), F.avg(F.when(F.col("amount").isNotNull(), is_round("total").cast("double"))).alias("round_share"),
    )
    deviation = rows.select("vendor_key", "amount").join(base.select("vendor_key", "median_total"), "vendor_key")
    mad = deviation.groupBy("vendor_key").agg(F.percentile(F.abs(F.col("amount") - F.col("median_total")), 0.5).alias("amount_mad"))
    repeats = rows.filter("amount is not null").groupBy("vendor_key", "amount").agg(F.count("*").alias("n")).groupBy("vendor_key").agg(F.max("n").alias("repeated"))
    return base.join(mad, "vendor_key").join(repeats, "vendor_key", "left")


LEARNED = "gap int, n_prior long, n_gaps long, n_terms long, round_share double, last_number struct<value:long,prefix:string>, median_total double, median_interval double, median_term double, amount_mad double, repeated int, usual_step long"
# What earlier blocks say of a vendor: values of a kind with their counts. Rows, round and last are one value a block.
AMOUNT, GAP, TERM, NUMBER, ROWS, ROUND = range(6)
BLOCK_ROWS = 20_000
HELPERS = ["created_at", "amount", "is_round", "vk", "block"]


# Time's order within a vendor; a null vendor_key counts as an empty one.
IN_TIME = ["vk", "issue_date", "created_at", "id"]


def in_blocks(invoices: DataFrame, block_rows: int) -> DataFrame:
    """Invoices dealt by ranges of vendor and time into blocks of about block_rows, written to the shared folder."""
    amount = F.when((F.col("total") > 0) & ~F.isnan("total"), F.col("total"))
    rows = invoices.select(
        "id", "vendor_key", "vendor", "currency", "total", "issue_date", "due_date", F.datediff("due_date", "issue_date").alias("term"), parsed_number(F.col("invoice_number")).alias("parsed"),
        "status", "created_at", amount.alias("amount"), is_round("total").alias("is_round"), F.coalesce("vendor_key", F.lit("")).alias("vk"),
    )

    def written(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(invoices.sparkSession, name)
        df.write.parquet(path)
        return invoices.sparkSession.read.schema(df.schema).parquet(path)

    # Rows are derived once, then counted, sampled for the ranges and dealt out from what was written.
    rows = written(rows, "invoices")
    return written(rows.repartitionByRange(max(1, -(-rows.count() // block_rows)), *IN_TIME).withColumn("block", F.spark_partition_id()), "invoices-in-time")


def prior_stats(invoices: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every invoice with statistics over all earlier ones of its vendor.

    A large vendor's invoices run through many blocks. Each block is summed up by itself: distinct amounts, gaps, terms and numbers
    with counts. A vendor's earlier blocks meet in each later one as sorted lists, and a block's rows are looked up in those
    lists and among the rows before them, all at once (PrefixOrder). Equal moments are told apart by id. A block's task
    holds its rows and the distinct values of its first vendor's earlier blocks; no other vendor of the block has any.
    """
    rows = in_blocks(invoices, block_rows)

    # The last day of the block before is where the first gap begins.
    ends = rows.groupBy("vk", "block").agg(F.max(F.struct(*IN_TIME[1:])).alias("last"), F.min(F.struct(*IN_TIME[1:])).alias("first"))
    ends = ends.withColumn("before", F.lag("last.issue_date").over(Window.partitionBy("vk").orderBy("block")))
    several = ends.groupBy("vk").agg(F.sort_array(F.collect_list("block")).alias("blocks")).filter(F.size("blocks") > 1)
    first_gaps = ends.filter("before is not null").select("block", F.col("vk").alias("first_vendor"), "before")

    # Values of vendors with several blocks, for each block after their own.
    parts = rows.join(several, "vk").join(first_gaps, "block", "left").withColumn("before", F.when(F.col("first_vendor") == F.col("vk"), F.col("before")))
    within = Window.partitionBy("vk", "block").orderBy(*IN_TIME[1:])
    parts = parts.withColumn("gap", F.datediff("issue_date", F.coalesce(F.lag("issue_date").over(within), F.when(F.row_number().over(within) == 1, F.col("before")))))
    value = lambda kind, when, real=None, whole=None, prefix=None: F.when(when, F.struct(
        F.lit(kind).alias("kind"), (F.lit(None).cast("double") if real is None else real.cast("double")).alias("real"), (F.lit(None).cast("long") if whole is None else whole).alias("whole"), (F.lit(None).cast("string") if prefix is None else prefix).alias("prefix")))
    kinds = [
        value(AMOUNT, F.col("amount").isNotNull(), real=F.col("amount")), value(GAP, F.col("gap") > 0, real=F.col("gap")), value(TERM, F.col("term") >= 0, real=F.col("term")),
        value(NUMBER, F.col("parsed").isNotNull(), whole=F.col("parsed.value"), prefix=F.col("parsed.prefix")), value(ROWS, F.lit(True)), value(ROUND, F.col("amount").isNotNull() & F.col("is_round")),
    ]
    said = parts.select("vk", "block", "blocks", F.explode(F.array_compact(F.array(*kinds))).alias("v")).groupBy("vk", "block", "blocks", "v").agg(F.count("*").alias("n"))
    later = said.select("vk", F.explode(F.filter("blocks", lambda b: b > F.col("block"))).alias("into"), "v.*", "n")
    old = later.groupBy("into", "vk", "kind", "real", "whole", "prefix").agg(F.sum("n").alias("n"))
    old = old.unionByName(first_gaps.select(F.col("block").alias("into"), F.col("first_vendor").alias("vk"), F.lit(-1).alias("kind"), F.datediff("before", F.to_date(F.lit("1970-01-01"))).cast("double").alias("real"), F.lit(None).cast("long").alias("whole"), F.lit(None).cast("string").alias("prefix"), F.lit(1).cast("long").alias("n")))
    kept = [f for f in rows.schema.fields if f.name not in HELPERS]
    schema = StructType(kept + StructType.fromDDL(LEARNED).fields)
    return rows.groupBy("block").cogroup(old.drop("vk").groupBy("into")).applyInArrow(learn, schema)


def learn(rows: pa.Table, old: pa.Table) -> pa.Table:
    """Rows of one block, each with what the rows of its vendor before it say; old: values of the first vendor's earlier blocks."""
    keys = [(c, "ascending") for c in IN_TIME]
    rows = rows.take(pc.sort_indices(rows, sort_keys=keys, null_placement="at_start")).combine_chunks()
    n = rows.num_rows
    floats = lambda c, t=rows: t.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)  # noqa: E731  nulls are NaN
    vendor = np.array(pc.dictionary_encode(rows.column("vk").combine_chunks()).indices) if n else np.zeros(0, np.int64)
    group, groups = vendor.astype(np.int64), int(vendor.max()) + 1 if n else 0
    past = {kind: old.filter(pc.equal(old.column("kind"), kind)) for kind in range(-1, 6)}
    counted = lambda kind: int(pc.sum(past[kind].column("n")).as_py() or 0)  # noqa: E731  all of them are the first vendor's
    first = np.arange(groups) == 0

    day = floats("issue_date", pa.table({"issue_date": rows.column("issue_date").cast(pa.int32())}))
    previous = np.concatenate([[np.nan], day[:-1]])[:n]
    previous[np.diff(group, prepend=-1) != 0] = np.nan
    if past[-1].num_rows:
        previous[0] = past[-1].column("real")[0].as_py()
    gap, term, amount = day - previous, floats("term"), floats("amount")

    def series(value: np.ndarray, kind: int, good: np.ndarray) -> tuple[PrefixOrder, np.ndarray]:
        real, count = past[kind].column("real").to_numpy(), past[kind].column("n").to_numpy()
        order = PrefixOrder(group[good], value[good], np.ones(int(good.sum()), np.int64), np.zeros(len(real), np.int64), real, count, groups)
        return order, earlier_in_group(group, good)

    is_amount = ~np.isnan(amount)
    amounts, n_amounts = series(amount, AMOUNT, is_amount)
    gaps, gaps_so_far = series(gap, GAP, gap > 0)
    terms, terms_so_far = series(term, TERM, term >= 0)
    middle = amounts.median(group, n_amounts)
    n_round = earlier_in_group(group, is_amount & rows.column("is_round").to_numpy(zero_copy_only=False).astype(bool)) + np.where(group == 0, counted(ROUND), 0)
    size = amounts.count(group, n_amounts)

    # How often a row's amount has come up, itself included; the most of that so far.
    known = dict(zip(past[AMOUNT].column("real").to_pylist(), past[AMOUNT].column("n").to_pylist(), strict=True))
    code = np.unique(np.stack([group.astype(float), amount]), axis=1, return_inverse=True)[1].ravel() if n else group
    by_code = np.argsort(code, kind="stable")
    times = np.empty(n, np.int64)
    times[by_code] = earlier_in_group(code[by_code], np.ones(n, bool)) + 1
    if known:
        times += np.where(group == 0, np.array([known.get(a, 0) for a in amount.tolist()], np.int64), 0)
    repeated = running_most(group, np.where(is_amount, times, 0), np.where(first, max(known.values(), default=0), 0))

    parsed = rows.column("parsed").combine_chunks()
    has_number = pc.is_valid(parsed).to_numpy(zero_copy_only=False)
    whole, prefix = pc.struct_field(parsed, "value"), pc.struct_field(parsed, "prefix")
    step, last = numbers(group, groups, has_number, whole, prefix, past[NUMBER])
    columns = {
        "gap": pa.array(gap, pa.float64(), from_pandas=True).cast(pa.int32()), "n_prior": pa.array(earlier_in_group(group, np.ones(n, bool)) + np.where(group == 0, counted(ROWS), 0)),
        "n_gaps": pa.array(gaps.count(group, gaps_so_far)), "n_terms": pa.array(terms.count(group, terms_so_far)),
        "round_share": pa.array(np.where(size > 0, n_round / np.maximum(size, 1), np.nan), from_pandas=True), "last_number": last,
        "median_total": pa.array(middle, from_pandas=True), "median_interval": pa.array(gaps.median(group, gaps_so_far), from_pandas=True), "median_term": pa.array(terms.median(group, terms_so_far), from_pandas=True),
        "amount_mad": pa.array(amounts.deviation(group, n_amounts, middle)), "repeated": pa.array(repeated.astype(np.int32)), "usual_step": pa.array(step),
    }
    out = rows.drop_columns(HELPERS)
    for name, column in columns.items():
        out = out.append_column(name, column)
    return out


def numbers(group: np.ndarray, groups: int, has: np.ndarray, whole: pa.Array, prefix: pa.Array, old: pa.Table) -> tuple[np.ndarray, pa.Array]:
    """The usual step of each row's series before it, and the vendor's highest number so far.

    A series is a vendor's numbers with one prefix. A new number between two others takes their step away and adds two, so
    the steps so far are a row of values with weights.
    """
    n, n_old = len(group), old.num_rows
    # Numbers of the first vendor's earlier blocks, then the rows' own; prefixes as their ranks.
    every = pa.concat_arrays([*old.column("whole").cast(pa.int64()).chunks, whole.cast(pa.int64())])
    prefixes = pa.concat_arrays([*old.column("prefix").cast(pa.string()).chunks, prefix.cast(pa.string())])
    coded = prefixes.fill_null("").dictionary_encode()
    ranks = np.empty(len(coded.dictionary), np.int64)
    ranks[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(ranks))
    mark = ranks[coded.indices.to_numpy()]
    there, real, value_of = np.concatenate([np.ones(n_old, bool), has]), pc.is_valid(every).to_numpy(zero_copy_only=False), every.fill_null(0).to_numpy()
    names, series = np.unique((np.concatenate([np.zeros(n_old, np.int64), group]) * max(len(ranks), 1) + mark)[there], return_inverse=True)
    count, own = len(names), np.full(n_old + n, -1, np.int64)
    own[there] = series.ravel()
    of_old, own = own[:n_old], own[n_old:]
    valued, number = real[n_old:] & has, value_of[n_old:]
    at = np.flatnonzero(valued)
    at = at[np.argsort(own[at], kind="stable")]  # by series, in time
    old_series, old_number = of_old[real[:n_old]], value_of[:n_old][real[:n_old]]
    known = old_number
    everything = np.lexsort((np.concatenate([np.full(len(known), -1), np.arange(len(at))]), np.concatenate([old_number, number[at]]), np.concatenate([old_series, own[at]])))
    s, v = np.concatenate([old_series, own[at]])[everything], np.concatenate([old_number, number[at]])[everything]
    fresh = np.ones(len(s), bool)
    fresh[1:] = (s[1:] != s[:-1]) | (v[1:] != v[:-1])
    distinct = np.sort(everything[fresh & (everything >= len(known))] - len(known))  # first of each number that no earlier block has
    where, of, value = at[distinct], own[at][distinct], number[at][distinct]
    so_far = earlier_in_group(of, np.ones(len(of), bool))
    order = PrefixOrder(of, value, np.ones(len(of), np.int64), old_series, old_number, np.ones(len(known), np.int64), count)
    place, size = order.below(of, so_far, value), order.count(of, so_far)
    below, above = place > 0, place < size
    left = order.kth(of, so_far, np.maximum(place - 1, 0)).astype(np.int64)
    right = order.kth(of, so_far, np.minimum(place, np.maximum(size - 1, 0))).astype(np.int64)
    steps = np.stack([np.where(below & above, right - left, 0), np.where(below, value - left, 0), np.where(above, right - value, 0)], axis=1).ravel()
    weights = np.stack([-(below & above).astype(np.int64), below.astype(np.int64), above.astype(np.int64)], axis=1).ravel()
    by_value = np.lexsort((old_number, old_series))
    same = np.diff(old_series[by_value]) == 0
    old_steps = np.diff(old_number[by_value])[same]
    changes = PrefixOrder(np.repeat(of, 3), steps, weights, old_series[by_value][1:][same], old_steps, np.ones(len(old_steps), np.int64), count)

    # Distinct numbers of its series before each row.
    is_first = np.zeros(n, bool)
    is_first[where] = True
    rows = np.flatnonzero(own >= 0)
    rows = rows[np.argsort(own[rows], kind="stable")]
    n_steps = 3 * earlier_in_group(own[rows], is_first[rows])
    total = changes.count(own[rows], n_steps)
    low, high = (changes.kth(own[rows], n_steps, np.maximum(k, 0)).astype(np.int64) for k in ((total - 1) // 2, total // 2))
    usual = np.ones(n, np.int64)
    usual[rows] = np.where(total > 0, np.maximum((low + high + 1) // 2, 1), 1)

    # The highest so far, by value (none is lowest), then prefix.
    held = np.flatnonzero(there)
    order = held[np.lexsort((mark[held], value_of[held], real[held]))]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (mark[order][1:] != mark[order][:-1]) | (value_of[order][1:] != value_of[order][:-1]) | (real[order][1:] != real[order][:-1])
    rank, stands = np.zeros(n_old + n, np.int64), order[fresh]
    rank[order] = np.cumsum(fresh)
    start = np.zeros(groups, np.int64)
    if groups and n_old:
        start[0] = rank[:n_old].max()
    most = running_most(group, rank[n_old:], start)
    none = most == 0
    chosen = pa.array(stands[np.maximum(most, 1) - 1] if len(stands) else np.zeros(n, np.int64), mask=none)
    return usual, pa.StructArray.from_arrays([every.take(chosen), prefixes.take(chosen)], fields=[pa.field("value", pa.int64()), pa.field("prefix", pa.string())], mask=pa.array(none))


def anomaly_amount(stats: DataFrame) -> DataFrame:
    """id, kind, severity: a total that many deviations away from the median; three times the median is high."""
    scale = F.when(F.col("amount_mad") > 0, F.col("amount_mad")).otherwise(F.col("median_total") * RELATIVE_FLOOR)
    found = known(stats).filter((F.col("median_total") > 0) & (F.abs(F.col("total") - F.col("median_total")) / scale >= OUTLIER_SCALE))
    return finding(found, "amount_outlier", F.when(F.col("total") / F.col("median_total") >= HIGH_MULTIPLE, "high").otherwise("warn"))


def anomaly_number_gap(stats: DataFrame) -> DataFrame:
    """A number behind the vendor's highest, or further ahead than its usual step; other prefixes say nothing."""
    number, last = F.col("parsed.value"), F.col("last_number.value")
    missing = number - last - F.col("usual_step")
    found = known(stats).filter((F.col("parsed.prefix") == F.col("last_number.prefix")) & ((number < last) | (missing >= 1)))
    return finding(found, "number_gap", F.lit("warn"))


def anomaly_timing(stats: DataFrame) -> DataFrame:
    """Other terms than usual (high), else an arrival off the vendor's rhythm (warn)."""
    shifted = (F.col("n_terms") >= 2) & (F.col("median_term") > 0) & (F.abs(F.col("term") - F.col("median_term")) >= TERM_SHIFT)
    usual = F.col("median_interval")
    off = (F.col("n_gaps") >= 2) & (F.col("gap") > 0) & (usual >= 3) & ((F.col("gap") < usual * 0.5) | (F.col("gap") > usual * 2))
    shifted, off = F.coalesce(shifted, F.lit(False)), F.coalesce(off, F.lit(False))
    return finding(known(stats).filter(shifted | off), "timing_change", F.when(shifted, "high").otherwise("warn"))


def anomaly_round(stats: DataFrame) -> DataFrame:
    """A round total from a vendor whose totals seldom are."""
    return finding(known(stats).filter(is_round("total") & (F.coalesce("round_share", F.lit(0.0)) < ROUND_CEILING)), "round_amount", F.lit("warn"))


def anomaly_benign_dup(stats: DataFrame, peers: DataFrame) -> DataFrame:
    """A duplicate that a standing charge explains: repeated often, near the median, at the usual interval."""
    gap, usual = F.datediff("issue_date", "peer_issue_date"), F.coalesce("median_interval", F.lit(0.0))
    paced = (usual <= 0) | (F.abs(gap - usual) <= F.greatest(F.lit(3.0), usual * 0.34))
    return finding(standing_charges(stats).join(peers, "id").filter(paced), "benign_duplicate", F.lit("info"))


def standing_charges(stats: DataFrame) -> DataFrame:
    """Invoices near the median of a vendor that repeats an amount: the only ones whose peers matter."""
    return known(stats).filter((F.col("median_total") > 0) & (F.col("repeated") >= REPEAT_MIN) & same_amount(F.col("total"), F.col("median_total")))


def may_be_peers(invoices: DataFrame, asking: DataFrame) -> DataFrame:
    """Invoices of the vendors and about the amounts of those asking: all that duplicate_peers compares them with, and what is equal to one of these."""
    near = asking.select("vendor_key", F.explode(F.array(*[amount_bucket(F.col("total")) + i for i in (-1, 0, 1)])).alias("bucket")).distinct()
    return invoices.withColumn("bucket", amount_bucket(F.col("total"))).join(near, ["vendor_key", "bucket"], "left_semi").drop("bucket")


def known(stats: DataFrame) -> DataFrame:
    return stats.filter((F.col("n_prior") >= MIN_PRIOR))


def finding(rows: DataFrame, kind: str, severity: Column) -> DataFrame:
    return rows.select("id", F.lit(kind).alias("kind"), severity.alias("severity"))


OPEN = ["vendor_profile", "processing", "failed", "draft", "review", "scheduled"]


def anomaly_findings(invoices: DataFrame, peers: DataFrame | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All findings on open invoices; callers order them by severity, then id.

    The statistics are computed once and read five times, so they are written to the shared folder first. Where peers is how to find them
    (duplicate_peers), that is asked for what standing charges can have as peers alone.
    """
    learnt = prior_stats(invoices).filter(F.col("status").isin(OPEN) & (F.col("n_prior") >= MIN_PRIOR))
    path = scratch_path(invoices.sparkSession, "stats")
    learnt.write.parquet(path)
    stats = invoices.sparkSession.read.schema(learnt.schema).parquet(path)
    out = anomaly_amount(stats).unionByName(anomaly_number_gap(stats)).unionByName(anomaly_timing(stats)).unionByName(anomaly_round(stats))
    found = peers(may_be_peers(invoices, standing_charges(stats))) if callable(peers) else peers
    return out.unionByName(anomaly_benign_dup(stats, found))
