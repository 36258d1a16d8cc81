"""Column expressions that the DataFrame-only operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it, also from inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column, separators: str) -> Column:
    """The parts of a text (null: none) between runs of separators, a Java character class."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators + "+"), "")


def runs_hashed(hashes: Column, k: int) -> Column:
    """64-bit hashes of each k consecutive elements of a hash array; none where there are fewer.

    Windows of 2, 4, 8 ... are made of two halves each; those that add up to k are joined.
    """

    def pairs(a: Column, b: Column, shift: int, size: Column) -> Column:
        return F.zip_with(F.slice(a, F.lit(1), size), F.slice(b, F.lit(1 + shift), size), lambda x, y: F.xxhash64(x, y))

    def take(h: Column, power: Column, width: int, joined: Column | None, length: int) -> Column:
        if not k & width:
            return double(h, power, width, joined, length)
        if joined is None:
            return double(h, power, width, power, width)
        return let(pairs(joined, power, length, F.size(h) - (length + width) + 1), lambda j: double(h, power, width, j, length + width))

    def double(h: Column, power: Column, width: int, joined: Column | None, length: int) -> Column:
        if length == k:
            return joined
        return let(pairs(power, power, width, F.size(h) - 2 * width + 1), lambda p: take(h, p, 2 * width, joined, length))

    empty = F.array().cast("array<bigint>")
    return let(hashes, lambda h: F.when(F.size(h) < k, empty).otherwise(take(h, h, 1, None, 0)))
