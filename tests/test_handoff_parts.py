"""The hand-off file of many rows is written by several tasks."""

from pathlib import Path

from paylens.operators import queue
from paylens.plans import spend
from paylens.plans.views import Data

SMALL = "/root/testdata/sf0.001"


def text_of(folder):
    return b"".join(p.read_bytes() for p in sorted(Path(folder).glob("part-*"))).decode()


def test_parts_make_one_text(spark, tmp_path):
    rows = spark.range(300).selectExpr("'2001-01-01' AS invoice_date", "'' AS invoice_number", "concat('v', id) AS vendor")
    for files in (1, 4):
        queue.write_bookkeeping_csv(rows, f"{tmp_path}/{files}", files)
    assert text_of(tmp_path / "4") == text_of(tmp_path / "1")
    # One day and number for all rows doesn't bring them together.
    assert len([p for p in (tmp_path / "4").glob("part-*") if p.stat().st_size > 500]) == 4


def test_the_query_writes_parts_by_rows(spark, monkeypatch):
    whole = sorted(r.line for r in spend.bookkeeping_file(Data(spark, SMALL)).collect())
    monkeypatch.setattr(spend, "ROWS_A_FILE", 20)
    parts = spend.bookkeeping_file(Data(spark, SMALL))
    assert sorted(r.line for r in parts.collect()) == whole
    assert len(parts.inputFiles()) >= len(whole) // 20
