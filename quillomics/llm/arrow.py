"""Columns computed from text in Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import uuid
import zipfile
from collections.abc import Callable, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DataType, StructField, StructType

from . import tokens
from .words import slices


def ship(spark: SparkSession) -> None:
    """Gives this package to the executors of the session, once; they need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_shipped_llm", False):
        return
    package = Path(__file__).resolve().parents[1]
    if package.is_dir():  # else it was itself imported from a file that was shipped
        file = os.path.join(context._temp_dir, f"{package.name}.zip")
        with zipfile.ZipFile(file, "w") as archive:
            for module in sorted(package.rglob("*.py")):
                archive.write(module, module.relative_to(package.parent))
        context.addPyFile(file)
    context._shipped_llm = True


def map_arrow(df: DataFrame, run: Callable, schema: StructType | str) -> DataFrame:
    """``df.mapInArrow`` with this package at hand on the executors.

    Workers live on from one job to the next. One that comes to work of another kind first gives back what the last
    left in it: encoders with their caches, and memory that is free but held.
    """
    ship(df.sparkSession)
    kind = uuid.uuid4().hex

    def begun(batches):
        turn_to(kind)
        yield from run(batches)

    return df.mapInArrow(begun, schema)


_AT_WORK = [""]


def turn_to(kind: str) -> None:
    """Gives back memory if this worker did other work before."""
    if _AT_WORK[0] == kind:
        return
    _AT_WORK[0] = kind
    tokens.forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def with_text_columns(
    df: DataFrame, added: Sequence[tuple[str, DataType]], work: Callable[[pa.RecordBatch], Sequence[pa.Array]], keep: Sequence[str] | None = None,
    also: Sequence[str] = (), text: str = "text",
) -> DataFrame:
    """Rows with new columns that ``work`` gives for slices of rows of bounded text size.

    ``keep`` names the columns that stay (all, if None); those in ``also`` are read but not returned. A new column
    replaces a kept one of its name.
    """
    names = [n for n, _ in added]
    keep = [c for c in (df.columns if keep is None else keep) if c not in names]
    read = list(dict.fromkeys([*keep, text, *also]))
    schema = StructType([df.schema[c] for c in keep] + [StructField(n, t) for n, t in added])

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *work(part)], names=[*keep, *names])

    return map_arrow(df.select(*[f"`{c}`" for c in read]), run, schema)
