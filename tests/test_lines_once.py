"""Lines are sent once, under their own names, and po_suggest's are derived and met once."""

import re

import pytest
from compare import canonical

from paylens.operators import matching
from paylens.plans.registry import QUERIES
from paylens.plans.views import TABLES, VIEWS, WRITTEN, Data

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_sent_under_their_own_names(spark):
    tree = plan(Data(spark, SMALL).view("v_lines", WRITTEN["v_lines"]))
    sent = re.search(r"Exchange hashpartitioning\(l_orderkey.*\n[^\n]*Project \[([^\n]*)\]", tree).group(1)
    assert " AS " not in sent and "l_shipdate" not in tree and "l_linestatus" not in tree
    assert tree.count("Exchange hashpartitioning(l_orderkey") == 1


def test_lines_of_an_order_that_tie_are_numbered_as_their_text_says(spark, tmp_path):
    for t in TABLES:
        df = spark.read.parquet(f"{SMALL}/{t}.parquet")
        if t == "lineitem":
            some = df.filter("l_orderkey < 40")
            copies = some.selectExpr(*[{"l_linestatus": "'Z' AS l_linestatus", "l_returnflag": "CASE WHEN l_partkey % 2 = 0 THEN 'R' ELSE l_returnflag END AS l_returnflag"}.get(c, c) for c in df.columns])
            stray = some.limit(3).selectExpr(*[{"l_partkey": "cast(-1 AS bigint) AS l_partkey"}.get(c, c) for c in df.columns])
            df = some.unionByName(copies).unionByName(stray)
        df.write.parquet(f"{tmp_path}/{t}.parquet")
    d = Data(spark, str(tmp_path))
    given = d.view("v_lines", VIEWS["v_lines"])
    mine = d.view("v_lines", WRITTEN["v_lines"]).select(*given.columns)
    assert mine.count() > 200
    assert canonical(mine.columns, [tuple(r) for r in mine.collect()]) == canonical(given.columns, [tuple(r) for r in given.collect()])


def test_suggestions_derive_and_meet_lines_once(spark):
    assert "l_orderkey" not in plan(QUERIES["po_suggest"](spark, SMALL))


@pytest.mark.parametrize("common", [0, 1, 200])
def test_suggestions_of_shared_and_repeated_lines(spark, common):
    invoices = spark.createDataFrame([(1, "Acme BV"), (2, "acme"), (3, "Beta"), (4, " "), (5, None)], "id long, vendor string")
    lines = spark.createDataFrame([(1, 1, "Bolt", 2.0), (1, 2, " bolt", 2.0), (1, 3, "Nut", -0.0), (2, 1, "nut", 0.0), (3, 1, "bolt", 2.0), (4, 1, "bolt", 2.0), (2, 2, None, 1.0)], "invoice_id long, line_no long, description string, quantity double")
    orders = spark.createDataFrame([("b", "ACME Tools", "open"), ("a", "Acme", "open"), ("c", "Acme", "closed"), ("d", "Other", "open")], "po_id string, vendor string, status string")
    po = spark.createDataFrame([("b", "bolt", 2.0), ("b", "BOLT", 2.0), ("a", "nut", 0.0), ("c", "bolt", 2.0), ("d", "bolt", 2.0), ("a", None, 1.0)], "po_id string, description string, quantity double")
    got = {r.id: (r.po_id, r.score) for r in matching.po_suggest(invoices, lines, orders, po, common).collect()}
    assert got == {1: ("b", 2), 2: ("a", 1)}
