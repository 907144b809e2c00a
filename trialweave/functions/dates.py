"""Dates, ages and numbers out of free-form strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col

_FORMATS = ("yyyy-MM-dd", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "MM/dd/yyyy", "yyyy/MM/dd", "yyyyMMdd")


def parse_date(value) -> Column:
    """A date from an ISO date or time, a year and month or a year (the first day then), or null."""
    v = F.trim(col(value))
    whole = F.try_to_date(F.regexp_extract(v, r"^(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")
    month = F.try_to_date(F.concat(F.nullif(F.regexp_extract(v, r"^(\d{4}-\d{2})$", 1), F.lit("")), F.lit("-01")), "yyyy-MM-dd")
    year = F.try_to_date(F.concat(F.nullif(F.regexp_extract(v, r"^(\d{4})$", 1), F.lit("")), F.lit("-01-01")), "yyyy-MM-dd")
    return F.coalesce(whole, month, year)


def to_iso_date(value) -> Column:
    """An ISO date string by a ladder of formats; missing parts are those of 1 January 1900."""
    v = F.trim(col(value))
    ladder = [F.try_to_date(v, f) for f in _FORMATS]
    month = [F.try_to_date(F.concat(F.lit("1 "), v), f"d {f}") for f in ("MMMM yyyy", "MMM yyyy")]
    return F.date_format(F.coalesce(parse_date(v), *ladder, *month), "yyyy-MM-dd")


def age_years(birth, today) -> Column:
    """Whole years from a birth date to a given day; null if it lies ahead."""
    years = F.floor(F.months_between(col(today), col(birth)) / 12).cast("int")
    return F.when(years >= 0, years)


def iso_age_years(value) -> Column:
    """Years of an ISO 8601 age (PnYnMnWnD), to 2 places; null if it isn't one."""
    v = F.upper(F.trim(col(value)))
    part = lambda unit: F.coalesce(F.regexp_extract(v, rf"(\d+(?:\.\d+)?){unit}", 1).try_cast("double"), F.lit(0.0))
    years = part("Y") + part("M") / 12 + part("W") / 52 + part("D") / 365
    return F.when(v.rlike(r"^P(?=\d)(\d+(\.\d+)?Y)?(\d+(\.\d+)?M)?(\d+(\.\d+)?W)?(\d+(\.\d+)?D)?$"), F.bround(years, 2))


def age_to_years(value) -> Column:
    """Years of an age with a unit, as "18 Months"; null if number or unit is missing."""
    v = F.lower(col(value))
    n = F.regexp_extract(v, r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    unit = F.when(v.contains("year"), n).when(v.contains("month"), n / 12).when(v.contains("week"), n / 52).when(v.contains("day"), n / 365)
    return F.bround(unit, 2)


def parse_age_input(value, today) -> Column:
    """Whole years of a patient's age: a number up to 150, "N years", or a date of birth."""
    v = F.trim(col(value).cast("string"))
    number = F.regexp_extract(v, r"^(\d{1,3})(?:\.0+)?$", 1).try_cast("int")
    unit = F.regexp_extract(F.lower(v), r"^(\d{1,3})\s*(?:years?|yrs?|yr)\b", 1).try_cast("int")
    plain = F.when(F.coalesce(number, unit).between(0, 150), F.coalesce(number, unit))
    return F.coalesce(plain, age_years(F.to_date(to_iso_date(v)), today))


def parse_numeric(value) -> Column:
    """struct(value, unit): the first signed number, thousands separated by commas or not, and the token after it."""
    pattern = r"([-+]?\d+(?:,\d{3})*(?:\.\d+)?)\s*([A-Za-z/%][^\s,;]*)?"
    number = F.replace(F.regexp_extract(col(value), pattern, 1), F.lit(","), F.lit("")).try_cast("double")
    return F.struct(number.alias("value"), F.nullif(F.regexp_extract(col(value), pattern, 2), F.lit("")).alias("unit"))
