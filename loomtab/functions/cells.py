"""Rules for raw cells: missing tokens, numbers, dates, and the codes of a fitted column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cells that count as missing, in lower case.
MISSING = ["", "na", "n/a", "nan", "null", "none", "?", "-", "#n/a"]


def is_missing(cell: Column) -> Column:
    return cell.isNull() | F.lower(F.trim(cell)).isin(MISSING)


def parse_number(cell: Column) -> Column:
    """A finite number, thousands separators allowed, else null."""
    plain = F.trim(cell)
    number = F.coalesce(plain.try_cast("double"), F.regexp_replace(plain, ",", "").try_cast("double"))
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def present_number(cell: Column) -> Column:
    return F.when(~is_missing(cell), parse_number(cell))


def days(moment: Column) -> Column:
    """Days, with their fraction, since 1970-01-01."""
    return F.unix_micros(moment.cast("timestamp")) / F.lit(86400e6)


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def unit(x: Column, lo: Column, hi: Column) -> Column:
    """x on the scale where lo is 0 and hi is 1, cut off at both; one half where they agree."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(x.isNotNull(), F.coalesce(F.try_divide(x - lo, hi - lo), F.lit(0.5)))))


def from_unit(u: Column, lo: Column, hi: Column, logged: Column | None = None, whole: bool = False) -> Column:
    """The inverse of unit, of the logarithm where logged, to whole numbers if asked."""
    x = lo + u * (hi - lo)
    if logged is not None:
        x = F.when(logged, F.expm1(x)).otherwise(x)
    return F.round(x) if whole else x


def format_number(x: Column) -> Column:
    """A whole number without a point, any other with six digits after it at most and no zeros at the end."""
    plain = F.regexp_replace(F.regexp_replace(F.format_number(x, 6), ",", ""), r"\.?0+$", "")
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("decimal(20,0)").cast("string")).otherwise(F.when(plain == "-0", "0").otherwise(plain))


def parse_date(cell: Column) -> Column:
    """Days since 1970-01-01, with their fraction, of an ISO date with or without a time; null for anything else."""
    plain = F.trim(cell)
    day = F.when(plain.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(plain, F.lit("yyyy-MM-dd")))
    moment = F.when(plain.rlike(r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}$"), F.try_to_timestamp(F.regexp_replace(plain, "T", " "), F.lit("yyyy-MM-dd HH:mm:ss")))
    return days(F.coalesce(day, moment))


def format_date(x: Column, timed: bool = False) -> Column:
    return F.date_format(F.timestamp_micros(F.round(x * F.lit(86400e6)).cast("long")), "yyyy-MM-dd HH:mm:ss" if timed else "yyyy-MM-dd")


def decimals_of(cell: Column) -> Column:
    """Digits after the point in a cell's text, 0 without one."""
    return F.length(F.regexp_extract(F.trim(cell), r"\.(\d*)$", 1))


def winsorized(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def power(x: Column, exponent: float) -> Column:
    """x to a power, the sign kept."""
    return F.signum(x) * F.pow(F.abs(x), F.lit(exponent))


def logit(u: Column, edge: float = 1e-6) -> Column:
    v = winsorized(u, edge, 1 - edge)
    return F.ln(v / (1 - v))


def hashed(key: Column, seed: str = "") -> Column:
    """The first 32 bits of the MD5 of a key's text, a hash that other engines share."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), key.cast("string"))), 1, 8), 16, 10).cast("long")


def code256(u: Column) -> Column:
    """The nearest of 256 levels of a unit value."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(u * 255 + 0.5))).cast("int")
