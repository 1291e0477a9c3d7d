"""Columns of a caller's table that bear names used inside."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterable, Sequence
from functools import wraps

from pyspark.sql import DataFrame


def hidden_names(columns: Sequence[str], hide: Iterable[str]) -> dict[str, str]:
    """Other names, free in ``columns``, for those to be hidden."""
    taken = {c.lower() for c in columns}
    out, i = {}, 0
    for c in hide:
        while f"own_{i}" in taken:
            i += 1
        out[c] = f"own_{i}"
        taken.add(out[c])
    return out


def guarded(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For functions of ``docs`` (and ``keep``) that return columns of it: names that begin with two underscores, which
    are those used inside, bear other names meanwhile."""
    accepts_keep = "keep" in inspect.signature(fn).parameters

    @wraps(fn)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        other = hidden_names(docs.columns, [c for c in docs.columns if c.startswith("__")])
        if not other:
            return fn(docs, *args, **kwargs)
        if accepts_keep and kwargs.get("keep") is not None:
            kwargs["keep"] = [other.get(c, c) for c in kwargs["keep"]]
        found = fn(docs.withColumnsRenamed(other), *args, **kwargs)
        return found.withColumnsRenamed({v: k for k, v in other.items()})

    return run


def only(docs: DataFrame, needed: Iterable[str]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with all columns but the needed ones under other names, and how to get their names back."""
    needed = {c.lower() for c in needed}
    other = hidden_names(docs.columns, [c for c in docs.columns if c.lower() not in needed])
    return docs.withColumnsRenamed(other), {v: k for k, v in other.items()}
