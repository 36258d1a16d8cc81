"""Peers are looked for among what standing charges can have as peers; a vendor's contracts that can't be first meet no invoice."""

import pytest

from paylens.operators import anomalies, duplicates, matching
from paylens.plans.registry import QUERIES
from paylens.plans.views import Data

SMALL = "/root/testdata/sf0.001"


def test_peers_of_standing_charges_are_those_of_all(spark):
    d = Data(spark, SMALL)
    weekly = d.v_weekly
    asked = []

    def peers(rows):
        asked.append(rows.count())
        return duplicates.duplicate_peers(rows)

    got = anomalies.anomaly_findings(weekly, peers)
    want = anomalies.anomaly_findings(weekly, duplicates.duplicate_peers(weekly))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.filter("kind = 'benign_duplicate'").count() > 0
    assert 0 < asked[0] < weekly.count()  # amounts far from a vendor's usual one are left out


@pytest.mark.parametrize("name", ["exception_queue", "anomaly_findings"])
def test_invoices_are_derived_once(spark, name):
    assert "o_orderkey" not in QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()


def test_contracts_that_allow_no_more_meet_nothing(spark):
    invoices = spark.createDataFrame([(1, "Acme", 50.0), (2, "acme ", 150.0), (3, "Acme", 9e9), (4, "Other", 1.0)], "id long, vendor string, total double").selectExpr("*", "date'2001-05-05' AS issue_date")
    rows = [(i, f"c{i}", "ACME", 100.0, True) for i in range(1, 60)] + [(60, "c60", "acme", 200.0, True), (61, "c61", "acme", None, False), (62, "c62", "acme", None, True)]
    contracts = spark.createDataFrame(rows, "pos long, contract_id string, vendor string, max_amount double, active boolean").selectExpr("*", "date'2001-01-01' AS valid_from", "date'2001-12-31' AS valid_to", "false AS requires_receipt")
    found = matching.first_contract(invoices, contracts)
    assert sorted((r.id, r.c.contract_id) for r in found.collect()) == [(1, "c1"), (2, "c60"), (3, "c62")]
    assert "before" in found._jdf.queryExecution().optimizedPlan().toString()
