"""Options of one preparation run, checked on the driver before any plan is built."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, fields

# The ten derived columns, first in every output, in this order, with their types.
GEOMETRY_COLUMNS = (
    ("geometryType", "string"),
    ("geometryLatitude", "double"),
    ("geometryLongitude", "double"),
    ("orientationMajorAxis", "float"),
    ("innerSemiMajorRadius", "float"),
    ("innerSemiMinorRadius", "float"),
    ("outerSemiMajorRadius", "float"),
    ("outerSemiMinorRadius", "float"),
    ("startAngle", "float"),
    ("stopAngle", "float"),
)

# Suffix of the column that holds the ids of a retained column.
IDS_SUFFIX = "_IDs"

# A separator or quote that is found from the input.
AUTO = "auto"

VALUE_TYPES = ("long", "float", "double", "string")


class OptionsError(ValueError):
    """The options contradict each other or the input."""


@dataclass(frozen=True)
class Lookup:
    """One lookup file: ``source,target,type`` header, then ``key,value`` rows."""

    path: str
    sep: str | None = None


@dataclass(frozen=True)
class PrepOptions:
    longitude: str
    latitude: str
    time: str

    # input
    input_path: str | Sequence[str] | None = None
    headers: Sequence[str] | None = None
    multiline: bool = False
    quote: str = '"'
    sep: str = ","
    # ids and output files follow the order of the input: by name of the file, then by place in it
    reading_order: bool = False

    # output
    output_path: str | None = None
    report_path: str | None = None
    catalogue_path: str | None = None
    # ids that later runs continue
    dictionary_path: str | None = None
    records_per_file: int = 0
    row_group_bytes: int | None = None
    page_bytes: int | None = None

    # columns and types
    excluded: Sequence[str] = ()
    default_type: str = "string"
    time_columns: Sequence[str] = ()
    long_columns: Sequence[str] = ()
    float_columns: Sequence[str] = ()
    double_columns: Sequence[str] = ()
    string_columns: Sequence[str] = ()
    # types and time format come from all records, unless a number of rows is given here
    sample_rows: int | None = None

    # null markers; a per-column list replaces the per-type list for that (output) column
    long_null_values: Sequence[int] = ()
    double_null_values: Sequence[float] = ()
    float_null_values: Sequence[float] = ()
    string_null_values: Sequence[str] = ()
    column_null_values: Mapping[str, Sequence[str]] = field(default_factory=dict)

    # time
    timezone: str = "Z"
    time_format: str | None = None
    start_time: str | None = None
    end_time: str | None = None

    # enrichment
    lookups: Sequence[Lookup | str] = ()
    encoded_columns: Sequence[str] = ()
    retained_id_columns: Sequence[str] = ()
    first_seen_by: Sequence[str] | None = None

    # uncertainty geometry
    radius: str | None = None
    site_id: str | None = None
    site_tolerance: float | None = None
    distinct_site_coordinates: bool = False
    randomize: bool = False
    seed: int = 0

    # report
    unique_strings: int | None = None
    # values beyond the unique_strings most frequent ones of a column become this class
    rare_class: str | None = None
    approximate_distinct: bool = False
    trajectory_id: str | None = None

    def __post_init__(self):
        # every name is trimmed; only string null markers are kept as written
        for f in fields(self):
            value = getattr(self, f.name)
            if f.name in ("string_null_values", "column_null_values", "lookups", "input_path"):
                continue
            if isinstance(value, str):
                if f.name not in ("quote", "sep"):
                    object.__setattr__(self, f.name, value.strip())
            elif isinstance(value, (list, tuple)):
                object.__setattr__(
                    self, f.name, tuple(v.strip() if isinstance(v, str) else v for v in value)
                )
        object.__setattr__(
            self, "lookups", tuple(Lookup(x) if isinstance(x, str) else x for x in self.lookups)
        )
        self._check_alone()

    # -- checks ---------------------------------------------------------------------------

    @property
    def main_columns(self) -> dict[str, str]:
        """Input name -> output name of the renamed attributes."""
        renamed = {self.longitude: "lon", self.latitude: "lat", self.time: "time"}
        if self.radius:
            renamed[self.radius] = "radius"
        return renamed

    @property
    def declared_types(self) -> dict[str, str]:
        """Input name -> declared kind; an earlier list wins over a later one."""
        declared: dict[str, str] = {}
        for kind in ("string", "double", "float", "long", "time"):
            for name in getattr(self, f"{kind}_columns"):
                if name:
                    declared[name] = kind
        return declared

    def output_name(self, column: str) -> str:
        return self.main_columns.get(column, column)

    def _check_alone(self):
        for name in ("longitude", "latitude", "time"):
            if not getattr(self, name):
                raise OptionsError(f"{name} names no column")
        if len({self.longitude, self.latitude, self.time}) != 3:
            raise OptionsError("longitude, latitude and time must be three different columns")
        if self.default_type not in ("string", "float", "double"):
            raise OptionsError(f"default_type must be string, float or double, not {self.default_type!r}")
        if self.records_per_file < 0 or (self.sample_rows is not None and self.sample_rows < 1):
            raise OptionsError("records_per_file must not be negative and sample_rows must be positive")
        for name in (self.longitude, self.latitude, self.time):
            if name in self.excluded:
                raise OptionsError(f"main column {name!r} cannot be excluded")
            if name in self.declared_types or name in self.encoded_columns:
                raise OptionsError(f"main column {name!r} cannot be given another type")
        for name in self.retained_id_columns:
            if name in self.encoded_columns:
                raise OptionsError(f"{name!r} is both encoded in place and retained")
        for name in self.encoded_columns:
            if name in self.declared_types:
                raise OptionsError(f"encoded column {name!r} cannot also have a declared type")

    def check_against(self, columns: Sequence[str], lookup_targets: Sequence[str] = ()):
        """Every named column must exist in the input; every marker key in the output."""
        known = set(columns)
        named = [self.longitude, self.latitude, self.time]
        named += [c for c in (self.radius, self.site_id, self.trajectory_id) if c]
        named += list(self.excluded) + list(self.encoded_columns) + list(self.retained_id_columns)
        named += list(self.declared_types)
        missing = sorted({n for n in named if n and n not in known})
        if missing:
            raise OptionsError(f"columns not in the input: {', '.join(missing)}")
        lost = sorted(set(self.first_seen_by or ()) - (known - set(self.excluded)))
        if lost:
            raise OptionsError(f"ids cannot be ordered by columns that are not kept: {', '.join(lost)}")
        outputs = {self.output_name(c) for c in columns} | set(lookup_targets)
        outputs |= {c + IDS_SUFFIX for c in self.retained_id_columns}
        unknown = sorted(set(self.column_null_values) - outputs)
        if unknown:
            raise OptionsError(f"null markers for columns not in the output: {', '.join(unknown)}")
