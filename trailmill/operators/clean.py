"""Typed values with a status each, and the accept or reject decision per record.

Everything here works on one record at a time: no shuffle, and the same on a stream.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from trailmill.functions.casts import (
    CASTS, SQL_TYPES, is_marker, literal, quoted, radius_text, to_double, to_float, to_long, to_text,
)
from trailmill.functions.times import BY_FILE, FORMAT_COLUMN, STORED_TYPES, TimeReader, time_text
from trailmill.operators.schema import OutputColumn
from trailmill.options import PrepOptions
from trailmill.sources.files import FILE_COLUMN, PLACE_COLUMN

# Status of a value. A null-marker counts as null.
OK, NULL, INVALID, OUT_OF_RANGE = "ok", "null", "invalid", "out_of_range"

# Coordinate ranges in degrees.
RANGES = {"lat": (-90.0, 90.0), "lon": (-180.0, 180.0)}

DAY = "__day"
ACCEPTED = "__accepted"
REASON = "reject_reason"

_WHOLE = {"int", "bigint", "smallint", "tinyint"}
_NUMERIC = _WHOLE | {"float", "double"}


def status_of(name: str) -> str:
    return f"__status_{name}"


def raw_of(source: str) -> str:
    """Text of an input column that later steps (lookups, ids) still need."""
    return f"__raw_{source}"


@dataclass(frozen=True)
class NullMarkers:
    """Values that mean "missing": per type, or per output column, which takes precedence."""

    by_type: Mapping[str, Sequence] = field(default_factory=dict)
    by_column: Mapping[str, Sequence[str]] = field(default_factory=dict)

    @classmethod
    def of(cls, options: PrepOptions) -> NullMarkers:
        return cls(
            {
                "long": options.long_null_values,
                "double": options.double_null_values,
                "float": options.float_null_values,
                "string": options.string_null_values,
            },
            options.column_null_values,
        )

    def hit(self, name: str, kind: str, value: str) -> str:
        return is_marker(value, self.by_column.get(name, self.by_type.get(kind, ())), kind)


def judge(text: str, parsed: str, marked: str, allowed: str | None = None) -> tuple[str, str]:
    """(value, status) of one conversion: what is not text is null, what does not parse is
    invalid, what is a null-marker is null, what is not allowed is out of range."""
    good = f"NOT ({marked})" + (f" AND {allowed}" if allowed else "")
    outside = f" WHEN NOT ({allowed}) THEN '{OUT_OF_RANGE}'" if allowed else ""
    value = parsed if good == "NOT (false)" else f"CASE WHEN {good} THEN {parsed} END"
    status = (
        f"CASE WHEN {text} IS NULL THEN '{NULL}' WHEN {parsed} IS NULL THEN '{INVALID}'"
        f" WHEN {marked} THEN '{NULL}'{outside} ELSE '{OK}' END"
    )
    return value, status


def parse(column: OutputColumn, raw_type: str, times: TimeReader) -> tuple[str, str]:
    """(given text, parsed value) of one column.

    A stored number that already fits its target is used as it is; anything else goes through
    its text.
    """
    raw = quoted(column.source)
    text = raw if raw_type == "string" else f"CAST({raw} AS STRING)"
    number = raw_type in _NUMERIC
    if column.role in ("lat", "lon"):
        return (raw, f"CAST({raw} AS DOUBLE)") if number else (to_text(text), to_double(text))
    if column.role in ("time", "moment"):
        given, reader = time_text(raw, raw_type), times.of(raw_type)
        return (raw if raw_type in STORED_TYPES else to_text(given)), reader.millis(given)
    if column.role == "radius":
        given = radius_text(text)
        return (raw, f"CAST({raw} AS FLOAT)") if number else (given, to_float(given))
    if column.role in ("encoded", "ids") or column.kind == "string":
        return to_text(text), to_text(text)
    if column.kind == "long":
        if raw_type in _WHOLE:
            return raw, f"CAST({raw} AS BIGINT)"
        return text, f"coalesce({to_long(text)}, {times.of('string').millis(text)})"
    if number:
        return raw, f"CAST({raw} AS {SQL_TYPES[column.kind]})"
    return text, CASTS[column.kind](text)


def clean(
    raw: DataFrame,
    columns: Sequence[OutputColumn],
    options: PrepOptions,
    times: TimeReader,
) -> DataFrame:
    """One typed column and one status column per output column that comes from the input.

    Two projections: the first parses every value once, the second judges it. Id columns hold
    their text until they are encoded; the text of lookup sources is carried along. The
    calendar day of each record is added as ``DAY``.
    """
    types = dict(raw.dtypes)
    markers = NullMarkers.of(options)
    parsed: dict[str, str] = {}
    judged: dict[str, str] = {}
    for i, column in enumerate(columns):
        if column.role in ("geometry", "lookup"):
            continue
        text, value = f"__t{i}", f"__p{i}"
        parsed[text], parsed[value] = parse(column, types[column.source], times)
        allowed = None
        if column.role in RANGES:
            low, high = RANGES[column.role]
            allowed = f"{value} BETWEEN {low}D AND {high}D"
        marked = (
            "false" if column.role in ("encoded", "ids")
            else markers.hit(column.name, column.kind, value)
        )
        judged[column.name], judged[status_of(column.name)] = judge(text, value, marked, allowed)
        if column.role == "time":
            raw_type = types[column.source]
            parsed["__time_text"] = time_text(quoted(column.source), raw_type)
            judged[DAY] = times.of(raw_type).day("__time_text", value)
    carried = {c.source for c in columns if c.role == "lookup"}
    for source in sorted(carried):
        parsed[raw_of(source)] = f"CAST({quoted(source)} AS STRING)"
    if options.site_id:
        parsed[raw_of(options.site_id)] = to_text(f"CAST({quoted(options.site_id)} AS STRING)")
        carried.add(options.site_id)
    for name in sorted(map(raw_of, carried)):
        judged[name] = quoted(name)
    if times.fmt == BY_FILE:
        parsed[FORMAT_COLUMN] = FORMAT_COLUMN
    for carried_on in (FILE_COLUMN, PLACE_COLUMN):
        if carried_on in raw.columns:
            parsed[carried_on] = judged[carried_on] = carried_on
    return raw.selectExpr(*[f"{e} AS {quoted(n)}" for n, e in parsed.items()]).selectExpr(
        *[f"{e} AS {quoted(n)}" for n, e in judged.items()]
    )


def gate_bounds(raw: DataFrame, options: PrepOptions, times: TimeReader) -> tuple[int | None, int | None]:
    """Start and end in epoch milliseconds, read like the data's own time text."""
    bounds = []
    times = times.of(dict(raw.dtypes)[options.time]).of("string").alone()
    for text in (options.start_time, options.end_time):
        if not text:
            bounds.append(None)
            continue
        value = raw.sparkSession.range(1).selectExpr(times.millis(literal(text))).first()[0]
        if value is None:
            raise ValueError(f"time bound {text!r} is not in the format of the data ({times.fmt})")
        bounds.append(value)
    return tuple(bounds)


def decide(cleaned: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Add ``ACCEPTED`` and ``reject_reason`` (null for accepted records)."""
    tests = [
        f"WHEN {status_of(name)} <> '{OK}' THEN '{name}_' || {status_of(name)}"
        for name in ("lon", "lat", "time")
    ]
    if start is not None:
        tests.append(f"WHEN time < {start}L THEN 'before_start'")
    if end is not None:
        tests.append(f"WHEN time > {end}L THEN 'after_end'")
    return cleaned.selectExpr("*", f"CASE {' '.join(tests)} END AS {REASON}").selectExpr(
        "*", f"{REASON} IS NULL AS {ACCEPTED}"
    )


def accept_condition(
    raw: DataFrame, options: PrepOptions, times: TimeReader, start: int | None, end: int | None
) -> str:
    """The accept decision as a condition on the input columns; never null.

    Same outcome as ``decide``, for filtering before anything is parsed into columns. A filter
    on the parsed columns would be moved below their projection and would repeat the parsing
    once per mention; here each value is parsed once. Conditions on stored numbers reach
    Parquet files.
    """
    types = dict(raw.dtypes)
    markers = NullMarkers.of(options)
    tests = []
    for name, source in (("lat", options.latitude), ("lon", options.longitude)):
        low, high = RANGES[name]
        column = quoted(source)
        if types[source] in _NUMERIC:
            value = f"CAST({column} AS DOUBLE)"
            tests.append(f"{column} BETWEEN {low}D AND {high}D")
        else:
            # the ranges are symmetric, and not-a-number is beyond every bound
            value = f"try_cast(CAST({column} AS STRING) AS DOUBLE)"
            tests.append(f"abs({value}) <= {high}D")
        marked = markers.hit(name, "double", value)
        if marked != "false":
            tests.append(f"NOT {marked}")
    column, raw_type = quoted(options.time), types[options.time]
    millis = times.of(raw_type).millis(time_text(column, raw_type))
    scale = {"epoch_ms": 1, "epoch_s": 1000}.get(times.fmt)
    if raw_type == "timestamp":
        # compared as stored, so that the bounds reach the files
        if start is not None:
            tests.append(f"{column} >= timestamp_millis({start}L)")
        if end is not None:
            tests.append(f"{column} < timestamp_millis({end + 1}L)")
        tests.append(f"{column} IS NOT NULL")
    elif raw_type in ("bigint", "int") and scale:
        if start is not None:
            tests.append(f"{column} >= {-(-start // scale)}L")
        if end is not None:
            tests.append(f"{column} <= {end // scale}L")
        tests.append(f"{millis} IS NOT NULL")
    elif start is None and end is None:
        tests.append(f"{millis} IS NOT NULL")
    else:
        if start is not None:
            tests.append(f"{millis} >= {start}L")
        if end is not None:
            tests.append(f"{millis} <= {end}L")
    marked = markers.hit("time", "long", millis)
    if marked != "false":
        tests.append(f"NOT {marked}")
    return " AND ".join(f"({test})" for test in tests)
