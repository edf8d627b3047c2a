"""Amounts as whole cents, rates, buckets and their written forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cents(amount: str | Column) -> Column:
    """Whole cents of a decimal string, half to even; null where it is not a number."""
    return F.bround(_col(amount).try_cast("decimal(20,6)") * 100, 0).cast("bigint")


def cents_of_double(amount: str | Column) -> Column:
    return F.round(_col(amount) * 100, 0).cast("bigint")


def within(a: Column, b: Column, tolerance: int = 1) -> Column:
    return F.abs(a - b) <= tolerance


#: Tolerances by name: cents that an amount may differ by, or parts per million of the statement's amount.
TOLERANCES = (("exact", 0, 0), ("c1", 1, 0), ("c100", 100, 0), ("r01", 0, 1000), ("r1", 0, 10_000), ("r5", 0, 50_000))


def tolerated(a: Column, b: Column, abs_cents: int, ppm: int) -> Column:
    """Whether a is within a tolerance of b, in whole numbers."""
    return F.abs(a - b) * 1_000_000 <= abs_cents * 1_000_000 + F.abs(b) * ppm if ppm else F.abs(a - b) <= abs_cents


def fee_band(a: Column, b: Column, tolerance: int = 1) -> Column:
    """Exact, or of the same sign and 95 to 100 % of the statement's amount."""
    return within(a, b, tolerance) | ((F.signum(a) == F.signum(b)) & (F.abs(a) * 100 >= F.abs(b) * 95) & (F.abs(a) <= F.abs(b)))


def rate(num: Column, den: Column, digits: int = 6) -> Column:
    """num / den rounded; null where undefined, never 0."""
    return F.round(F.try_divide(num.cast("double"), den.cast("double")), digits)


def percent(num: Column, den: Column, digits: int = 3) -> Column:
    return F.round(F.try_divide(num.cast("double") * 100, den.cast("double")), digits)


def money(c: str | Column, trillions: bool = False) -> Column:
    """Cents as text: B, M or K with two decimals (T where asked for), a sign in front if negative."""
    c = _col(c)
    v = F.abs(c) / 100
    sign = F.when(c < 0, "-").otherwise("")
    short = lambda by, suffix: F.concat(F.format_number(v / by, 2), F.lit(suffix))
    out = F.when(v >= 1e9, short(1e9, "B")).when(v >= 1e6, short(1e6, "M")).when(v >= 1e3, short(1e3, "K")).otherwise(F.format_number(v, 2))
    if trillions:
        out = F.when(v >= 1e12, short(1e12, "T")).otherwise(out)
    return F.concat(sign, out)


def plain(c: str | Column) -> Column:
    """Cents as '0.00'."""
    c = _col(c)
    return F.concat(F.when(c < 0, "-").otherwise(""), F.floor(F.abs(c) / 100).cast("string"), F.lit("."), F.lpad((F.abs(c) % 100).cast("string"), 2, "0"))


def magnitude(c: str | Column) -> Column:
    """floor(log10) of the amount in units, by comparing whole cents; -3 for zero."""
    v = F.abs(_col(c))
    out = F.when(v == 0, -3).when(v < 10, -2).when(v < 100, -1)
    for k in range(0, 14):
        out = out.when(v < 10 ** (k + 3), k)
    return out.otherwise(14)


def magnitude_label(k: str | Column) -> Column:
    k = _col(k)
    low = F.concat(F.lit("< $1"), F.when(k > -3, F.concat(F.lit("  (1e"), k.cast("string"), F.lit(")"))).otherwise(""))
    small = F.concat(F.lit("$"), F.format_number(F.pow(F.lit(10.0), k), 0), F.lit(" – $"), F.format_number(F.pow(F.lit(10.0), k + 1), 0))
    big = F.concat(F.lit("$1e"), k.cast("string"), F.lit(" – 1e"), (k + 1).cast("string"))
    return F.when(k < 0, low).when(k >= 3, big).otherwise(small)


#: Upper ends of the amount buckets, in cents, with their labels; half open, the last has no end.
AMOUNT_BUCKETS = ((1_000_00, "< 1K"), (10_000_00, "1K - 10K"), (100_000_00, "10K - 100K"), (1_000_000_00, "100K - 1M"), (10_000_000_00, "1M - 10M"), (100_000_000_00, "10M - 100M"), (None, ">= 100M"))


def amount_bucket(c: str | Column) -> tuple[Column, Column]:
    """(number from 0, label) of the fixed bucket of an amount."""
    v = F.abs(_col(c))
    number, label = F.lit(len(AMOUNT_BUCKETS) - 1), F.lit(AMOUNT_BUCKETS[-1][1])
    for i, (end, name) in reversed(list(enumerate(AMOUNT_BUCKETS[:-1]))):
        number, label = F.when(v < end, i).otherwise(number), F.when(v < end, name).otherwise(label)
    return number, label
