"""All registered queries of the library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import control, documents, lines, spend, vendors
from .views import Data, oracle

PLANS = {**spend.QUERIES, **lines.QUERIES, **control.QUERIES, **documents.QUERIES, **vendors.QUERIES}


def _query(build: Callable[[Data], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(Data(spark, sf_dir))


QUERIES = {name: _query(build) for name, (build, _) in PLANS.items()}
SQL = {name: oracle(sql) for name, (_, sql) in PLANS.items() if sql}
