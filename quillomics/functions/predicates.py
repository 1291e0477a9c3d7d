"""Filter building: every helper returns a Column, or None when the filter is not asked for."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL_TARGET = "non-targeting"


def col(name: str | Column) -> Column:
    return F.col(name) if isinstance(name, str) else name


def equals(name: str, value) -> Column | None:
    return None if value in (None, "") else col(name) == F.lit(value)


def equals_ignore_case(name: str, value: str | None) -> Column | None:
    return F.upper(col(name)) == F.lit(value.upper()) if value else None


def with_keys(df: DataFrame, *names: str) -> DataFrame:
    """Adds the upper-case key column of each name, for tables to be stored: filters on it prune files."""
    return df.withColumns({f"{name}_key": F.upper(name) for name in names})


def key_of(df: DataFrame, name: str) -> Column:
    """The stored key column of a name, or its upper-case form where the table has none."""
    return F.col(f"{name}_key") if f"{name}_key" in df.columns else F.upper(name)


def equals_key(df: DataFrame, name: str, value: str | None) -> Column | None:
    """Equality that ignores case; reaches the file scan where the table has the key column."""
    return key_of(df, name) == F.lit(value.upper()) if value else None


def has_text(name: str, text: str | None) -> Column | None:
    """Case-sensitive substring; the text is taken literally, not as a pattern."""
    return col(name).contains(F.lit(text)) if text else None


def has_text_ignore_case(name: str | Column, text: str | None) -> Column | None:
    return F.lower(col(name)).contains(F.lit(text.lower())) if text else None


def any_has_text(names: Iterable[str], text: str | None) -> Column | None:
    return any_of(has_text_ignore_case(n, text) for n in names) if text else None


def is_target(name: str = "gene_target") -> Column:
    """A real perturbation: neither missing nor the control key."""
    return col(name).isNotNull() & (col(name) != CONTROL_TARGET)


def is_flagged(name: str) -> Column:
    """Text or boolean flag that means yes."""
    return F.lower(col(name).cast("string")).isin("true", "1", "yes")


def all_of(*conditions: Column | None) -> Column | None:
    given = [c for c in conditions if c is not None]
    return reduce(lambda a, b: a & b, given) if given else None


def any_of(conditions: Iterable[Column | None]) -> Column | None:
    given = [c for c in conditions if c is not None]
    return reduce(lambda a, b: a | b, given) if given else None


def where(df: DataFrame, *conditions: Column | None) -> DataFrame:
    combined = all_of(*conditions)
    return df if combined is None else df.filter(combined)


def require_one(message: str, *conditions: Column | None) -> None:
    if all(c is None for c in conditions):
        raise ValueError(message)
