"""Date codes printed on parts, as column expressions: structs of year, month, week and format, null if none fits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: month letters, January to December; I is not used.
MONTHS = "ABCDEFGHJKLM"


def _code(year: Column, month: Column, week: Column, kind: str, fits: Column) -> Column:
    return F.when(fits, F.struct(year.cast("int").alias("year"), month.cast("int").alias("month"), week.cast("int").alias("week"), F.lit(kind).alias("format")))


def week_month(week: Column) -> Column:
    return F.least(F.lit(12), F.floor((week - 1) / 4) + 1)


def year_of_digit(digit: Column, context: int) -> Column:
    """The year that ends in the digit: in the context's decade, or the one before if over five years ahead."""
    if context <= 0:
        return digit + 1990
    year = digit + context // 10 * 10
    return F.when(year > context + 5, year - 10).otherwise(year)


def year_of_two(digits: Column, context: int) -> Column:
    if context <= 0:
        return F.when(digits <= 30, digits + 2000).otherwise(digits + 1900)
    year = digits + context // 100 * 100
    return F.when(year > context + 20, year - 100).otherwise(year)


def yyww(code: Column, context: int) -> Column:
    week = F.substring(code, 3, 2).try_cast("int")
    return _code(year_of_two(F.substring(code, 1, 2).try_cast("int"), context), week_month(week), week, "YYWW", code.rlike(r"^[0-9]{4}$") & week.between(1, 53))


def ymw(code: Column, context: int) -> Column:
    return _code(year_of_digit(F.substring(code, 1, 1).try_cast("int"), context), F.position(F.substring(code, 2, 1), F.lit(MONTHS)), F.substring(code, 3, 1).try_cast("int"), "YMW", code.rlike(rf"^[0-9][{MONTHS}][1-5]$"))


def yww(code: Column, context: int) -> Column:
    week = F.substring(code, 2, 2).try_cast("int")
    return _code(year_of_digit(F.substring(code, 1, 1).try_cast("int"), context), week_month(week), week, "YWW", code.rlike(r"^[0-9]{3}$") & week.between(1, 53))


def decode(code: Column, context: int = 0) -> Column:
    """A whole code: YYWW, then year digit with month letter, then YWW."""
    return F.coalesce(yyww(code, context), ymw(code, context), yww(code, context))


def extract(text: Column, context: int = 0) -> Column:
    """The first code in a text by kind: year digit with month letter, then YYWW, then YWW."""
    upper = F.upper(text)
    find = lambda pattern: F.regexp_extract(upper, rf"(?<![0-9A-Z_])({pattern})(?![0-9A-Z_])", 1)
    return F.coalesce(ymw(find("[0-9][A-HJ-M][1-5]"), context), yyww(find("[0-9]{2}(?:0[1-9]|[1-4][0-9]|5[0-3])"), context), yww(find("[0-9](?:0[1-9]|[1-4][0-9]|5[0-3])"), context))
