"""Money, dates and identity expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def currency_of(c: str | Column = "currency", default: str = "EUR") -> Column:
    """A missing or empty currency reads as the default."""
    return F.coalesce(F.nullif(col(c), F.lit("")), F.lit(default))


def exact_sum(c: str | Column) -> Column:
    """A sum of money in cents, so that its order doesn't matter; as double."""
    return F.sum(col(c).cast("decimal(18,2)")).cast("double")


def label_of(c: str | Column, fallback: str) -> Column:
    return F.coalesce(F.nullif(F.trim(col(c)), F.lit("")), F.lit(fallback))


def key_of(c: str | Column) -> Column:
    return F.lower(F.trim(col(c)))


def filled(c: str | Column) -> Column:
    return F.coalesce(F.trim(col(c)), F.lit("")) != ""


def normal_number(c: str | Column) -> Column:
    """An invoice number without anything but letters and digits, in upper case."""
    return F.regexp_replace(F.upper(col(c)), "[^A-Z0-9]", "")


def normal_id(c: str | Column) -> Column:
    """IBAN or registration: without white space, upper case."""
    return F.upper(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\s+", ""))


def iban_valid(c: str | Column) -> Column:
    """Mod-97 checksum: the first four characters go to the end, letters count from 10."""
    iban = normal_id(c)
    turned = F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4))
    digits = F.transform(F.split(turned, ""), lambda x: F.when(x.between("A", "Z"), (F.ascii(x) - 55).cast("string")).otherwise(x))
    rest = F.aggregate(F.split(F.array_join(digits, ""), ""), F.lit(0), lambda r, x: (r * 10 + F.coalesce(x.try_cast("int"), F.lit(0))) % 97)
    return iban.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (rest == 1)


def is_round(total: str | Column) -> Column:
    return (col(total) > 0) & (col(total) % 100 == 0)


def same_amount(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    """Within a share of the larger; amounts of 0 or less must be equal."""
    return F.when((a <= 0) | (b <= 0), a == b).otherwise(F.abs(a - b) / F.greatest(a, b) <= tolerance)
