import duckdb
import pytest

DATA = "/root/testdata/sf0.001"

TEXTS = [
    None, "", "   \n\t ", "one", "a b c d", "The quick brown fox jumps over the lazy dog and runs away from the bear in the wood",
    "The quick brown fox jumps over the lazy dog and runs away from the bear in the wood", "All rights reserved. Licensed under CC BY 4.0",
    "x " * 30000, "ÉCOLE Größe straße 日本語 <|endoftext|> don't  42%", " ".join(f"w{i}" for i in range(400)),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Rows that are null, empty, very long, repeated or tied, with further columns whose names operators use."""
    rows = [(i, t, "en", "s", None if t is None else len(t), 0.5, 1, "x", 9) for i, t in enumerate(TEXTS)]
    rows += [rows[5], (None, "the text of no id " * 3, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, at int, window string, set_key int").repartition(3)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con
