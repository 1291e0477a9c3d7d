"""Runnable queries: each name has a Spark callable and, where one exists, checking SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from ..sources import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BUILDERS: dict[str, Callable] = {}

MODULES = (
    "perturbation", "pharmacology", "expression", "records", "analytics", "aggregates", "joins", "normalizers",
    "tables", "streams", "spot_checks",
)


def query(name: str, oracle: str | None = None):
    """Register ``fn(load)``, where ``load(name)`` gives a view or a raw table."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query name: {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Loader(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        BUILDERS[name] = fn
        if oracle:
            ORACLES[name] = views.with_views(oracle)
        return fn

    return register


class Loader:
    """Gives views and tables by name. Views stored under ``prepared`` are read instead of computed."""

    def __init__(self, spark: SparkSession, sf_dir: str, prepared: str | None = None):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.prepared = prepared

    def __call__(self, name: str) -> DataFrame:
        if name not in views.VIEWS:
            return views.read(self.spark, self.sf_dir, name)
        if self.prepared:
            return self.spark.read.parquet(f"{self.prepared}/{name}")
        return views.load(self.spark, self.sf_dir, name)

    def prepare(self, folder: str) -> None:
        """Store every view as a table, the form in which a user holds this data."""
        for name in views.VIEWS:
            views.load(self.spark, self.sf_dir, name).repartition(8).write.parquet(f"{folder}/{name}")


def load_all() -> None:
    for module in MODULES:
        import_module(f"{__name__}.{module}")
