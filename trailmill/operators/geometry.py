"""Uncertainty geometry of each record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmill.functions.geodesic import destination
from trailmill.options import GEOMETRY_COLUMNS

# The two kinds of geometry.
CIRCLE, POINT = "CIRCLE", "POINT"


def empty_geometry() -> dict[str, Column]:
    return {name: F.lit(None).cast(kind) for name, kind in GEOMETRY_COLUMNS}


def geometry_of(radius: Column, lat: Column, lon: Column) -> dict[str, Column]:
    """A full circle for a positive radius, a point for zero or less, nothing for null."""
    known, circle = radius.isNotNull(), radius > 0
    return empty_geometry() | {
        "geometryType": F.when(circle, CIRCLE).when(known, POINT),
        "geometryLatitude": F.when(known, lat),
        "geometryLongitude": F.when(known, lon),
        "outerSemiMajorRadius": F.when(circle, radius).cast("float"),
        "outerSemiMinorRadius": F.when(circle, radius).cast("float"),
        "startAngle": F.when(circle, 0).cast("float"),
        "stopAngle": F.when(circle, 360).cast("float"),
    }


def add_geometry(
    df: DataFrame, radius: str | None, randomize: bool = False, seed: int = 0
) -> DataFrame:
    """Add the ten geometry columns from a column of whole metres (null: no geometry).

    With ``randomize`` the record's own lat and lon become a random point whose distance from
    the centre is uniform below radius + 1 metres, in a uniform direction.
    """
    if radius is None:
        return df.withColumns(empty_geometry())
    r = F.col(radius)
    df = df.withColumns(geometry_of(r, F.col("lat"), F.col("lon")))
    if not randomize:
        return df
    moved = df.withColumns(
        {
            "__metres": F.rand(seed) * (F.greatest(r, F.lit(0)) + 1),
            "__azimuth": F.rand(seed + 1) * 360 - 180,
        }
    ).withColumn("__to", destination("lat", "lon", "__azimuth", "__metres"))
    return moved.withColumns(
        {
            "lat": F.when(r.isNotNull(), F.col("__to.lat")).otherwise(F.col("lat")),
            "lon": F.when(r.isNotNull(), F.col("__to.lon")).otherwise(F.col("lon")),
        }
    ).drop("__metres", "__azimuth", "__to")
