"""Dates, numbers and spreadsheet coordinates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def business_date(value: Column, zone: str) -> Column:
    """Calendar date of an instant in a zone; a bare date passes; what is neither is empty."""
    bare = F.when(F.try_to_date(value, "yyyy-MM-dd").isNotNull() & value.rlike(r"^\d{4}-\d{2}-\d{2}$"), value)
    local = F.date_format(F.from_utc_timestamp(F.try_to_timestamp(value), zone), "yyyy-MM-dd")
    return F.coalesce(bare, local, F.lit(""))


def local_date_time(value: Column, zone: str) -> Column:
    return F.coalesce(F.date_format(F.from_utc_timestamp(F.try_to_timestamp(value), zone), "yyyy-MM-dd HH:mm:ss"), F.lit(""))


def iso_instant(value: Column) -> Column:
    return F.date_format(F.try_to_timestamp(value), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def clamp(value: Column, low: float, high: float, otherwise: float) -> Column:
    number = value.try_cast("double")
    return F.when(number.isNull() | F.isnan(number) | (F.abs(number) == float("inf")), F.lit(float(otherwise))).otherwise(F.least(F.greatest(number, F.lit(float(low))), F.lit(float(high))))


def clamp_int(value: Column, low: int, high: int, otherwise: int) -> Column:
    return clamp(F.floor(value.try_cast("double") + 0.5), low, high, otherwise).cast("long")


def ratio(part: Column, whole: Column, otherwise: float) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(otherwise))


def rotation(value: Column) -> Column:
    return F.pmod(F.coalesce(value.try_cast("double"), F.lit(0.0)), F.lit(360.0))


def column_number(letters: Column) -> Column:
    """1 for A, 27 for AA."""
    return F.aggregate(F.split(F.upper(F.coalesce(letters, F.lit(""))), ""), F.lit(0).cast("int"), lambda n, c: F.when(c == "", n).otherwise(n * 26 + F.ascii(c) - 64))


def column_letters(number: Column) -> Column:
    """A for 1, AA for 27; up to three letters, the limit of spreadsheets."""
    one = lambda n: F.char(n % 26 + 65)
    n = number - 1
    a, b = F.floor(n / 26) - 1, F.floor(F.floor(n / 26 - 1) / 26) - 1
    return F.when(number <= 26, one(n)).when(number <= 702, F.concat(one(a), one(n))).otherwise(F.concat(one(b), one(a), one(n)))


def is_date_format(code: Column) -> Column:
    bare = F.regexp_replace(F.coalesce(code, F.lit("")), r'"[^"]*"', "")
    return (bare == "builtin-date") | bare.rlike(r"(?i)(^|[^\\])[ymdhis]")


def backoff_ms(attempt: Column, base: int = 1000, most: int = 60_000) -> Column:
    """base x 2^(attempt - 1), capped; 0 before the first failure."""
    return F.when(attempt <= 0, F.lit(0)).otherwise(F.least(F.lit(base) * F.pow(F.lit(2.0), F.least(attempt, F.lit(40)) - 1), F.lit(float(most)))).cast("long")


def retry_after_ms(value: Column) -> Column:
    return (value.try_cast("double") * 1000).cast("long")


def corrupt_shares(text: Column) -> Column:
    """struct of shares: replacement, control and readable characters, mojibake pairs."""
    size = F.greatest(F.char_length(text), F.lit(1))
    share = lambda pattern: F.regexp_count(text, F.lit(pattern)) / size
    return F.struct(share("\ufffd").alias("replacement"), share(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]").alias("control"), share("[\u00c3\u00c2][\u0080-\u00bf]|\u00e2\u20ac").alias("mojibake"), share(r"[\p{L}\p{N}\p{P}\p{Zs}\s]").alias("readable"))


def looks_like_gibberish(text: Column) -> Column:
    """U+FFFD over 2 %, control characters over 3 %, mojibake pairs over 5 % or readable under 62 %."""
    s = corrupt_shares(text)
    return (F.char_length(text) > 0) & ((s["replacement"] > 0.02) | (s["control"] > 0.03) | (s["mojibake"] > 0.05) | (s["readable"] < 0.62))
