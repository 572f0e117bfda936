"""The attribute catalogue: how each output column is shown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmill.functions.names import display_name
from trailmill.operators.schema import OutputColumn
from trailmill.options import PrepOptions

# Groups, names, units and texts of the catalogue.
GENERIC = "Generic"
LOCATION = "Geographic Location"
COORDINATE_NAMES = {"lat": "Latitude", "lon": "Longitude"}
COORDINATE_UNIT = "degrees"
COORDINATE_TOOLTIP = (
    "Refined location of the record, used by heatmapping and optionally by trajectory "
    "visualisation function\nGeographic WGS84 coordinate in decimal degrees.\n"
    "In the current version equals to "
)
TIME_NAME = "Time"
DATE_TIME, ID, TRAJECTORY = "dateTime", "ID", "trajectory"
TRAJECTORY_ENTRY = {
    "attributeId": "trajectory_1",
    "attributeName": "Trajectory",
    "group": "trajectories",
    "guiType": TRAJECTORY,
    "lonAttributeId": "lon",
    "latAttributeId": "lat",
    "infoAttributes": [],
}

_SCHEMA = (
    "position int, attributeId string, attributeName string, attributeTooltip string, "
    "`group` string, unit string, guiType string, hidden boolean, "
    "idField string, lonAttributeId string, latAttributeId string, infoAttributes array<string>"
)


def attribute_catalogue(
    spark: SparkSession,
    columns: Sequence[OutputColumn],
    options: PrepOptions,
    profiled: DataFrame | None = None,
) -> DataFrame:
    """One row per entry, in output order; with a profile, its counts are added.

    Geometry entries appear only if a radius or a site identifier is set, the trajectory entry
    only if there is a trajectory identifier.
    """
    rows = []

    def entry(**values):
        rows.append({"position": len(rows) + 1} | values)

    shown_last = []
    for column in columns:
        if column.role == "geometry":
            shown_last.append(column.name)
            continue
        values = {"attributeId": column.name, "group": GENERIC, "hidden": False}
        if column.role in COORDINATE_NAMES:
            values |= {
                "attributeName": COORDINATE_NAMES[column.role],
                "attributeTooltip": COORDINATE_TOOLTIP + column.source,
                "group": LOCATION,
                "unit": COORDINATE_UNIT,
            }
        elif column.role == "time":
            values |= {"attributeName": TIME_NAME, "guiType": DATE_TIME}
        elif column.role == "moment":
            values |= {"guiType": DATE_TIME}
        elif column.role in ("encoded", "ids"):
            values |= {"guiType": ID}
        entry(**values)
    if options.radius or options.site_id:
        for name in shown_last:
            entry(attributeId=name, attributeName=name, attributeTooltip=name, group=LOCATION, hidden=False)
    if options.trajectory_id:
        entry(**TRAJECTORY_ENTRY, hidden=True, idField=options.output_name(options.trajectory_id))
    names = [part.split()[0].strip("`") for part in _SCHEMA.split(", ")]
    catalogue = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], _SCHEMA)
    shown = display_name(F.col("attributeId"))
    plain = F.col("guiType").isNull() | (F.col("guiType") != TRAJECTORY)
    catalogue = catalogue.withColumns(
        {
            "attributeName": F.coalesce("attributeName", shown),
            "attributeTooltip": F.coalesce("attributeTooltip", F.when(plain, shown)),
        }
    )
    if profiled is None:
        return catalogue
    # one row per output column
    counts = F.broadcast(
        profiled.select(F.col("column").alias("attributeId"), "non_null", "nulls", "n_distinct")
    )
    return catalogue.join(counts, "attributeId", "left")


def catalogue_document(catalogue: DataFrame) -> DataFrame:
    """The catalogue as one JSON document in a column ``value``."""
    entry = F.struct(*[c for c in catalogue.columns if c != "position"])
    return catalogue.agg(
        F.to_json(
            F.struct(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("position", entry.alias("entry")))),
                    lambda e: e["entry"],
                ).alias("data")
            )
        ).alias("value")
    )
