"""What the corpus operators share: reading tables, durable intermediates, Arrow helpers, hashing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, spark.checkpoint.dir. Only where Spark runs in one process and it is unset, as in tests, a temporary one is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^,]*(,\d+)?\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="paylens-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Scratch:
    """Tables that one caller writes to the shared folder on the way to a result.

    They cut lineage with files that outlive any executor. A lazy result reads them, so they stay until their
    caller discards them, once the result is written itself, or until the folder is cleared.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def path(self, name: str) -> str:
        self.paths.append(scratch_path(self.spark, name))
        return self.paths[-1]

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table and read it back."""
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def discard(self) -> None:
        while self.paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(name: str, df: DataFrame) -> str:
    """The name, with as many underscores behind it as make it none of df's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches in parts of so many rows, so that what is made of them is let go before the next part."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def utf8_values(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding them."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


# Multipliers of the 64-bit mixers below; odd, with well spread bits.
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
_S29, _S32, _S31 = np.uint64(29), np.uint64(32), np.uint64(31)


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S32)) * _Q
    x = (x ^ (x >> _S29)) * _P
    return x ^ (x >> _S32)


_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64))
_BASE = np.uint64(0x5851F42D4C957F2D)
_BASE_INVERSE = np.uint64(pow(0x5851F42D4C957F2D, -1, 2**64))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def powers_of_base(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the polynomials' base from 0 to n at least, and their inverses modulo 2**64."""
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = max(n, 1 << 16)
        _POWERS = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _BASE)]))
        _INVERSES = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _BASE_INVERSE)]))
    return _POWERS, _INVERSES


def word_bounds(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of bytes that are not white space (20, 09-0D)."""
    edge = np.diff(np.concatenate([[True], SPACE[text], [True]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: differences of prefix sums of a polynomial, shifted to the word's start."""
    powers, inverses = powers_of_base(len(text) + 1)
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(_BYTES[text] * powers[: len(text)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n word hashes, in order; none where there are fewer."""
    if len(words) < n:
        return words[:0]
    powers, inverses = powers_of_base(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers[: len(words)], out=sums[1:])
    count = len(words) - n + 1
    return mix64((sums[n : n + count] - sums[:count]) * inverses[:count])


def held_out(doc_id) -> "F.Column":
    """The rows whose labels no classifier may learn from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
