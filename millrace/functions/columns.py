"""Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_year(ts: Column, year: int) -> Column:
    """A half-open range, which reaches the scan."""
    return (ts >= F.lit(f"{year}-01-01").cast("timestamp_ntz")) & (ts < F.lit(f"{year + 1}-01-01").cast("timestamp_ntz"))


def short_date(date: Column) -> Column:
    """M/D/YYYY to M/D/YY."""
    return F.concat(F.substring(date, F.lit(1), F.length(date) - 4), F.right(date, F.lit(2)))


def strip_zeros(s: Column) -> Column:
    return F.ltrim(s, F.lit("0"))


def noise_level(v: Column) -> Column:
    return F.when(v.isNull(), 0).when(v == "quiet", 1).when(v == "average", 2).when(v == "loud", 3).otherwise(4)


def flag(v: Column) -> Column:
    return F.when(F.lower(v) == "true", 1).otherwise(0)


def number(v: Column) -> Column:
    return F.coalesce(v.try_cast("double"), F.lit(0.0))


def map_sum(m: Column) -> Column:
    return F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda a, x: a + x)


def bytes_mod(s: Column, m: int) -> Column:
    """The UTF-8 bytes of s as one big-endian number, modulo m (under 2^54)."""
    b = s.cast("binary")
    return F.aggregate(F.sequence(F.lit(1), F.octet_length(s)), F.lit(0).cast("long"), lambda h, i: F.pmod(h * 256 + F.conv(F.hex(F.substring(b, i, F.lit(1))), 16, 10).cast("long"), F.lit(m)))


def affine(x: Column, a: Column, b: Column, m: int) -> Column:
    return F.pmod(a * x + b, F.lit(m))


def trailing_zeros(h: Column) -> Column:
    """Of the binary form; 1 for zero, whose form is one digit 0."""
    return F.when(h == 0, 1).otherwise(F.bit_count(h.bitwiseAND(-h) - 1))


def coefficients(i: Column) -> tuple[Column, Column]:
    """The i-th fixed pair of an affine hash family."""
    return F.pmod(i * 7919 + 104729, F.lit(99991)) + 1, F.pmod(i * 15485863 + 32452843, F.lit(98387)) + 1
