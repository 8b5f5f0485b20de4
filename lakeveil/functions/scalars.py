"""Scalar expressions that several operators use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_size(size: Column) -> Column:
    """``1.5 KB``: base 1024, one decimal, B to GB; nothing is ``0 B``."""
    step = F.least(F.lit(3), F.floor(F.log(1024.0, F.greatest(size, F.lit(1)).cast("double")) + 1e-12).cast("int"))
    unit = F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB"))), step + 1)
    value = F.regexp_replace(F.bround(size / F.pow(F.lit(1024.0), step), 1).cast("string"), r"\.0$", "")
    return F.when(size <= 0, "0 B").otherwise(F.concat(value, F.lit(" "), unit))


def any_time(text: Column) -> Column:
    """A timestamp from seconds since 1970 or from ISO text, without a zone taken as the session's; else null."""
    return F.when(text.rlike(r"^\d+(\.\d+)?$"), F.timestamp_micros((text.try_cast("double") * 1_000_000).cast("bigint"))).otherwise(F.try_to_timestamp(text))


def luhn_digit(digits: Column) -> Column:
    """The check digit that makes ``digits`` and it pass the Luhn test."""
    reversed_ = F.split(F.reverse(digits), "")
    parts = F.transform(F.filter(reversed_, lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, F.when(c.cast("int") * 2 > 9, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    return ((10 - F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10) % 10).cast("string")


def signed(*columns: str) -> Column:
    """SHA-256 of the row's values as JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)


def first_of(values: Column, n: int) -> Column:
    """The first n values, and ``+k more`` if there are more."""
    some = F.array_join(F.slice(values, 1, n), ", ")
    return F.when(F.size(values) > n, F.concat(some, F.lit(" +"), (F.size(values) - n).cast("string"), F.lit(" more"))).otherwise(some)
