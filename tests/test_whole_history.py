"""Vendors with more than 500 invoices: all of them count."""

import datetime as dt
import random
from collections import Counter
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import invoices

from paylens.functions.nearest import NearestRows
from paylens.functions.running import PrefixOrder
from paylens.operators import anomalies, duplicates


@pytest.mark.parametrize("block_rows", [20_000, 90])
def test_prior_stats_see_all_earlier_invoices(spark, block_rows):
    rng = random.Random(5)
    n, day = 1300, dt.date(1995, 1, 1)
    items = []
    for i in range(n):
        day += dt.timedelta(rng.choice([0, 1, 3]))
        total = float(rng.choice([100, 250, 900])) if i < 600 else float(rng.randrange(1, 4000)) / 8
        number = {0: "", 1: f"B-{i:05}"}.get(rng.randrange(9), f"A-{rng.randrange(90000):05}")
        items.append({"issue_date": day, "due_date": day + dt.timedelta(rng.randrange(-3, 40)), "total": total if i % 17 else 0.0, "invoice_number": number})
    df = invoices(spark, *items, {"vendor_key": "b"}, {"vendor_key": "b"}).repartition(5)
    if block_rows == 90:
        assert anomalies.in_blocks(df, block_rows).filter("vendor_key = 'acme'").select("block").distinct().count() >= 8
    got = {r.id: r for r in anomalies.prior_stats(df, block_rows).collect()}
    middle = lambda v: median(v) if v else None
    for i in [0, 1, 2, 5, 499, 500, 501, 700, 1001, *range(3, n, 41), n - 1]:
        past, r = items[:i], got[i + 1]
        amounts = [x["total"] for x in past if x["total"] > 0]
        gaps = [g for a, b in zip(past, past[1:], strict=False) if (g := (b["issue_date"] - a["issue_date"]).days) > 0]
        terms = [t for x in past if (t := (x["due_date"] - x["issue_date"]).days) >= 0]
        numbers = [(int(x["invoice_number"][2:]), x["invoice_number"][0] + "-") for x in past if x["invoice_number"]]
        mad = median(abs(x - median(amounts)) for x in amounts) if amounts else 0.0
        assert (r.n_prior, r.n_gaps, r.n_terms) == (i, len(gaps), len(terms))
        assert (r.median_total, r.median_interval, r.median_term, r.amount_mad) == (middle(amounts), middle(gaps), middle(terms), mad)
        assert r.repeated == max(Counter(amounts).values(), default=0)
        assert r.round_share == (sum(x % 100 == 0 for x in amounts) / len(amounts) if amounts else None)
        assert (tuple(r.last_number) if numbers else r.last_number) == max(numbers, default=None)
        if items[i]["invoice_number"]:
            series = sorted(v for v, p in numbers if p == items[i]["invoice_number"][:2])
            steps = [b - a for a, b in zip(series, series[1:], strict=False) if b > a]
            assert r.usual_step == (max(int(median(steps) + 0.5), 1) if steps else 1)
    assert [got[n + k].n_prior for k in (1, 2)] == [0, 1]


def test_prefix_order_as_sorting_does(spark):
    rng = np.random.default_rng(2)
    for _ in range(40):
        groups, n = int(rng.integers(1, 5)), int(rng.integers(0, 60))
        group, value = np.sort(rng.integers(0, groups, n)), rng.integers(0, 12, n) / 4
        old_group, old_value, old_count = rng.integers(0, groups, 5), rng.integers(0, 14, 5) / 4, rng.integers(1, 4, 5)
        order = PrefixOrder(group, value, np.ones(n, np.int64), old_group, old_value, old_count, groups)
        for g in range(groups):
            own = value[group == g]
            for k in range(len(own) + 1):
                have = sorted([*own[:k].tolist(), *np.repeat(old_value, old_count)[np.repeat(old_group, old_count) == g].tolist()])
                ask = np.full(max(len(have), 1), g), np.full(max(len(have), 1), k)
                assert order.count(*ask)[0] == len(have)
                for y in (-1.0, 0.25, 1.1, 9.0):
                    assert order.below(*ask, np.full(len(ask[0]), y))[0] == sum(x < y for x in have)
                if have:
                    assert order.kth(*ask, np.arange(len(have))).tolist() == have
                    middle = order.median(*ask)
                    assert middle[0] == median(have) and order.deviation(*ask, middle)[0] == median(abs(x - median(have)) for x in have)


def test_a_number_far_behind_is_still_a_gap(spark):
    start = dt.date(1995, 1, 1)
    items = [{"issue_date": start + dt.timedelta(i), "invoice_number": "S-9000" if i == 0 else f"S-{i:04}"} for i in range(700)]
    found = {r.id for r in anomalies.anomaly_number_gap(anomalies.prior_stats(invoices(spark, *items))).collect()}
    assert found == set(range(5, 701))


def test_gl_suggest_remembers_old_invoices(spark):
    lines = spark.createDataFrame([(i, f"item{i % 7} common") for i in range(1, 1402)], "invoice_id long, description string")
    old = [{"category": "Travel", "gl_account": "6100", "department": f"d{i % 3}", "issue_date": dt.date(1999, 1, 1)} for i in range(20)]
    new = [{"category": "Office", "gl_account": "6200", "department": "x", "issue_date": dt.date(2001, 1, 1) + dt.timedelta(i % 90)} for i in range(1380)]
    asked = {"category": "Travel", "gl_account": "", "department": "", "issue_date": dt.date(2001, 7, 1)}
    df = invoices(spark, *old, *new, asked)
    got = {r.field: (r.value, r.confidence) for r in duplicates.gl_suggest(df, lines, "2001-08-01").filter("id = 1401").collect()}
    assert got["gl_account"] == ("6100", 0.98) and got["category"] == ("Travel", 0.98)


def test_gl_suggest_ranks_as_all_pairs_do(spark):
    rng = random.Random(9)
    words = [f"word{i}" for i in range(12)]
    text = {i: " ".join(rng.sample(words, rng.randrange(1, 4))) for i in range(1, 1301)}
    lines = spark.createDataFrame(list(text.items()), "invoice_id long, description string")
    items = [{"category": rng.choice(["A", "b", "B", ""]), "gl_account": rng.choice(["1", "2", "3"]), "department": rng.choice(["", "d"]), "issue_date": dt.date(2000, 1, 1) + dt.timedelta(rng.randrange(570)), "status": rng.choice(["review", "failed"])} for _ in text]
    got = {(r.id, r.field): (r.value, round(r.weight, 6)) for r in duplicates.gl_suggest(invoices(spark, *items), lines, "2001-08-01").collect()}
    for i in rng.sample(sorted(text), 40):
        mine, ranked = items[i - 1], []
        for j, past in enumerate(items, 1):
            if j == i or past["status"] == "failed":
                continue
            a, b = set(text[i].split()), set(text[j].split())
            score = 0.55 + len(a & b) / min(len(a), len(b)) * 0.15
            if mine["category"] and past["category"]:
                score += 0.2 if mine["category"].lower() == past["category"].lower() else -0.2
            days = (dt.date(2001, 8, 1) - past["issue_date"]).days
            score += 0.05 * (1 - days / 365) if days <= 365 else 0
            if round(score, 9) >= 0.4:
                ranked.append((round(score, 9), j))
        weights = Counter()
        for score, j in sorted(ranked, reverse=True)[:8]:
            weights[items[j - 1]["gl_account"]] += score
        best = max((round(w, 6), v) for v, w in weights.items())
        assert got[i, "gl_account"] == (best[1], best[0])


def test_nearest_rows_as_all_pairs(spark):
    rng = random.Random(3)
    for case in range(60):
        words = [f"w{i}" for i in range(rng.choice([3, 8, 40]))]
        rows = [(rng.choice(["", "a", "b"]), frozenset(rng.sample(words, rng.randrange(min(6, len(words) + 1)))), rng.choice([0.0, 0.01, 0.02, 0.05]), i) for i in range(rng.randrange(120))]
        index = NearestRows(rows, 0.15)
        for _ in range(20):
            asked = frozenset(rng.sample(words, rng.randrange(min(6, len(words) + 1))))
            bases = rng.choice([{"": 0.55, "a": 0.75, "b": 0.35}, {"": 0.55, "a": 0.55, "b": 0.55}])
            score = lambda r: int((bases[r[0]] + 0.15 * len(asked & r[1]) / max(min(len(asked), len(r[1])), 1) + r[2]) * 1e9 + 0.5) / 1e9  # noqa: B023, E731
            want = sorted(((score(r), r[3]) for r in rows if score(r) >= 0.4), reverse=True)[:5]
            assert index.best(asked, bases, 5, 0.4) == want


def test_a_vendor_of_a_hundred_thousand_invoices_is_looked_up_not_compared(spark):
    n = 100_000
    day = F.date_add(F.to_date(F.lit("1999-01-01")), (F.col("id") % 900).cast("int"))
    word = lambda salt, size: F.concat(F.lit(f"{salt}w"), F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(size)).cast("string"))
    blank = {c: F.lit("") for c in ("department", "memo")}
    df = spark.range(1, n + 1, numPartitions=8).withColumns({"ord": F.col("id"), "vendor_key": F.lit("v"), "status": F.lit("paid"), "issue_date": day, "category": word("c", 20), "gl_account": word("g", 9), **blank})
    lines = df.select(F.col("id").alias("invoice_id"), F.concat_ws(" ", word("a", 5000), word("b", 300), word("d", 40), word("e", 4)).alias("description"))
    asking, past = duplicates.coding_history(df, lines, "2001-08-01")
    found = duplicates.similar_past(asking.filter("id % 50 = 0"), past)
    compared, asked = found.agg(F.sum("compared")).first()[0], 2000
    assert found.groupBy("vendor_key", "own", "tokens").count().filter("count = 9").count() == asked
    assert compared < asked * n * 0.05
