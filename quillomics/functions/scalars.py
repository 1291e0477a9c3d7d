"""Small scalar expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .predicates import col

P_FLOOR = 1e-300


def neg_log10(name: str | Column) -> Column:
    """-log10 with very small probabilities held at a floor."""
    return -F.log10(F.greatest(col(name), F.lit(P_FLOOR)))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def or_default(name: str | Column, default) -> Column:
    """The value, or the default when it is missing, empty or zero."""
    c = col(name)
    empty = F.lit("") if isinstance(default, str) else F.lit(type(default)(0))
    return F.coalesce(F.nullif(c, empty), F.lit(default))


def text_or_null(name: str | Column) -> Column:
    """Trimmed text, NULL when nothing is left."""
    return F.nullif(F.trim(col(name)), F.lit(""))


def null_text_to_null(name: str | Column) -> Column:
    """The texts 'None' and 'nan' stand for a missing value."""
    c = col(name)
    return F.when(~c.isin("None", "nan"), c)


def capitalize(name: str | Column) -> Column:
    """First letter upper, all others lower."""
    c = col(name)
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substring(c, 2, 2147483647)))


def cut(name: str | Column, length: int, marker: str = "") -> Column:
    c = col(name)
    short = F.left(c, F.lit(length))
    return F.when(F.length(c) > length, F.concat(short, F.lit(marker)) if marker else short).otherwise(c)


def parse_double(name: str | Column) -> Column:
    """Number in text; NULL when it is not one, and for NaN."""
    number = col(name).try_cast("double")
    return F.when(~F.isnan(number), number)


def first_match(name: str | Column, pattern: str, group: int = 1) -> Column:
    """Regex group, NULL (not an empty string) when nothing matches."""
    return F.nullif(F.regexp_extract(col(name), pattern, group), F.lit(""))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator, denominator)


def utc_minute(name: str | Column) -> Column:
    return F.date_trunc("minute", col(name))
