"""Segments in what the query writes and reads, and archives with a gzip member for each record."""

import gzip
import time

import pytest
from pyspark.sql import functions as F

from paylens.llm import warc
from paylens.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_usual_pages_are_segmented(spark, tmp_path, monkeypatch):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    warc.write_archives(pages, f"{tmp_path}/archives")
    heads = spark.read.text(f"{tmp_path}/archives").filter("value like 'WARC-Type:%'").groupBy(F.trim("value").alias("t")).count().collect()
    kinds = {r.t.strip().removeprefix("WARC-Type: "): r["count"] for r in heads}
    assert kinds["continuation"] > 0.2 * pages.count()
    # Without reassembly the query has nothing for those pages.
    monkeypatch.setattr(warc, "reassembled", lambda origin, parts: b"")
    whole = {r.page_id: r.payload_bytes for r in warc.read_archives(spark, f"{tmp_path}/archives").collect()}
    real = {r.page_id: r.n for r in pages.select("page_id", F.octet_length("html").alias("n")).collect()}
    assert sum(real[int(p)] > 4096 for p, n in whole.items() if p) > 0.2 * len(real)


@pytest.mark.parametrize("size", [200, 4096])
def test_segments_of_any_size_come_back(spark, tmp_path, size):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    back = warc.warc_round_trip(pages, f"{tmp_path}/a", payloads=True, segment_bytes=size, chunk_bytes=size // 3)
    lost = back.filter("record_type = 'response'").join(pages, "page_id").filter(F.col("payload") != F.encode(F.coalesce("html", F.lit("")), "utf-8"))
    assert back.count() == pages.count() and lost.count() == 0
    assert sorted(back.drop("payload").collect()) == sorted(QUERIES["op2_warc"](spark, SF).collect())


def test_a_member_for_each_record(spark, tmp_path):
    path = tmp_path / "archives"
    path.mkdir()
    body = b"<p>text</p>" * 30
    every = [next(iter(warc.records(str(i), "u", body, "d", str(i), None, "2024-01-01T00:00:00Z", 64, 4096))) for i in range(20000)]
    (path / "part-0.gz").write_bytes(b"".join(gzip.compress(x, 1) for x in every))
    began = time.time()
    assert warc.read_archives(spark, str(path)).filter(F.col("payload_bytes") == len(body)).count() == 20000
    assert time.time() - began < 60
