"""Typed reads from VARIANT payloads, including paths that differ between writers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def field(path: str, kind: str = "string", payload: str = "payload") -> Column:
    return F.try_variant_get(F.col(payload), f"$.{path}", kind)


def first_field(paths: list[str], kind: str = "string", payload: str = "payload") -> Column:
    """First non-null of several paths."""
    return F.coalesce(*[field(p, kind, payload) for p in paths])


# Payload paths of the source records.
SCORE = "score"
THERAPEUTIC_AREA_PATHS = ["disease.therapeuticAreas[0].name", "therapeuticAreas[0].name"]
LAB_PATHS = ["lab_name", "labname", "offerer"]
LOCATION_PATHS = ["subcellular_location", "locations[0]"]
CONSTRAINT_FIELDS = {
    "pLI": "double",
    "oe_lof": "double",
    "oe_lof_upper": "double",
    "oe_mis": "double",
    "mis_z": "double",
    "lof_z": "double",
    "obs_lof": "int",
    "exp_lof": "double",
    "obs_mis": "int",
    "exp_mis": "double",
}


def constraint(*names: str) -> list[Column]:
    return [field(f"constraint.{n}", CONSTRAINT_FIELDS[n]).alias(n) for n in names]
