"""Which output columns there are and of which kind."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmill.functions.casts import quoted, to_float
from trailmill.functions.times import BY_FILE, FORMAT_COLUMN, STORED_TYPES, TimeReader
from trailmill.options import GEOMETRY_COLUMNS, IDS_SUFFIX, PrepOptions
from trailmill.sources.files import FILE_COLUMN, PLACE_COLUMN
from trailmill.sources.lookups import LookupTable

_SPARK_TYPES = {
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "long": T.LongType(),
    "string": T.StringType(),
}


@dataclass(frozen=True)
class OutputColumn:
    """``role``: geometry, lat, lon, time, radius, value, moment (a time column), encoded,
    ids (of a retained column) or lookup. ``source`` is the input column."""

    name: str
    kind: str
    role: str = "value"
    source: str | None = None

    @property
    def field(self) -> T.StructField:
        required = self.role in ("lat", "lon", "time")
        return T.StructField(self.name, _SPARK_TYPES[self.kind], not required)


def struct_type(columns: Sequence[OutputColumn]) -> T.StructType:
    return T.StructType([c.field for c in columns])


# Columns that hold numbers or times already keep their kind.
_STORED_KINDS = {
    "tinyint": "long", "smallint": "long", "int": "long", "bigint": "long",
    "float": "float", "double": "double",
} | dict.fromkeys(STORED_TYPES, "time")


def stored_kind(raw_type: str) -> str | None:
    return "double" if raw_type.startswith("decimal") else _STORED_KINDS.get(raw_type)


def infer_kinds(
    records: DataFrame, columns: Sequence[str], times: TimeReader, default_type: str = "string"
) -> dict[str, str]:
    """Kind of each column that all its values fit: time, float, or else the default; string if
    there is no value.

    One aggregate over all records, turned into one row per value first, so that the plan stays
    small for wide inputs; one row of counts per column comes back.
    """
    if not columns:
        return {}
    # every written time has a dash and a colon; trying the formats on other text is slow
    dated = "v LIKE '%-%:%' OR try_cast(v AS BIGINT) IS NOT NULL"
    cells = ", ".join(
        f"struct({i} AS place, CAST({quoted(name)} AS STRING) AS v)" for i, name in enumerate(columns)
    )
    counts = (
        records.selectExpr(*([FORMAT_COLUMN] if times.fmt == BY_FILE else []), f"inline(array({cells}))")
        .groupBy("place")
        .agg(
            F.count("v").alias("n"),
            F.expr(f"count(CASE WHEN {dated} THEN {times.of('string').millis('v')} END)").alias("times"),
            F.expr(f"count({to_float('v')})").alias("floats"),
        )
    )
    kinds = dict.fromkeys(columns, "string")
    for row in counts.where("n > 0").collect():
        kind = default_type
        if row["times"] == row["n"]:
            kind = "time"
        elif row["floats"] == row["n"]:
            kind = "float"
        kinds[columns[row["place"]]] = kind
    return kinds


def resolve_schema(
    records: DataFrame,
    options: PrepOptions,
    times: TimeReader,
    lookups: Sequence[LookupTable] = (),
) -> list[OutputColumn]:
    """Output columns in order: geometry, input columns, retained ids, lookup columns."""
    types = dict(records.dtypes)
    names = [c for c in records.columns if c not in (FILE_COLUMN, FORMAT_COLUMN, PLACE_COLUMN)]
    main, declared = options.main_columns, options.declared_types
    free = [
        c for c in names
        if c not in main and c not in declared and c not in options.encoded_columns
        and c not in options.excluded
    ]
    inferred = {c: kind for c in free if (kind := stored_kind(types[c]))}
    unknown = [c for c in free if c not in inferred]
    inferred |= infer_kinds(records, unknown, times, options.default_type)
    columns = [OutputColumn(name, kind, "geometry") for name, kind in GEOMETRY_COLUMNS]
    main_kinds = {"lat": "double", "lon": "double", "time": "long", "radius": "float"}
    for source in names:
        if source in options.excluded:
            continue
        name = source.strip()
        if source in main:
            columns.append(OutputColumn(main[source], main_kinds[main[source]], main[source], source))
        elif source in options.encoded_columns:
            columns.append(OutputColumn(name, "long", "encoded", source))
        else:
            kind = declared.get(source) or inferred[source]
            role = "moment" if kind == "time" else "value"
            columns.append(OutputColumn(name, "long" if kind == "time" else kind, role, source))
    for source in options.retained_id_columns:
        columns.append(OutputColumn(source + IDS_SUFFIX, "long", "ids", source))
    for lookup in lookups:
        columns.append(OutputColumn(lookup.target, lookup.kind, "lookup", lookup.source))
    doubled = sorted({c.name for c in columns if [d.name for d in columns].count(c.name) > 1})
    if doubled:
        raise ValueError(f"output columns named twice: {', '.join(doubled)}")
    return columns
