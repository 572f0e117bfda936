"""A whole run: records, rejects, profile, days, catalogue and report from one set of options."""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import cached_property

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from trailmill.functions.casts import quoted
from trailmill.functions.times import BY_FILE, FORMAT_COLUMN, STORED_TYPES, TimeReader, detect_format, formats_by_file
from trailmill.operators import catalogue as catalogues
from trailmill.operators import profile as profiles
from trailmill.operators.clean import (
    ACCEPTED, REASON, NullMarkers, accept_condition, clean, decide, gate_bounds, raw_of,
)
from trailmill.operators.closeness import joined_sites
from trailmill.operators.dictionary import build_dictionary, encode, store_dictionary, stored_dictionary
from trailmill.operators.folding import fold_rare
from trailmill.operators.geometry import add_geometry
from trailmill.operators.joins import left_join_unique, spread_column
from trailmill.operators.lookup import add_lookup
from trailmill.operators.report import ordered_text, report_lines
from trailmill.operators.schema import OutputColumn, resolve_schema, struct_type
from trailmill.operators.sites import distinct_sites, radius_per_site
from trailmill.options import OptionsError, PrepOptions
from trailmill.plans.sinks import write_records, write_rolled, write_text
from trailmill.session import discard, written
from trailmill.sources.files import FILE_COLUMN, PLACE_COLUMN, read_for_run, read_in_order
from trailmill.sources.lookups import LookupTable, read_lookup

# Size bounds of a broadcast, forwarded to every join of the run.
Bounds = dict[str, int]


@dataclass(frozen=True)
class Preparation:
    """Results are lazy: each method returns a DataFrame over the same input."""

    raw: DataFrame
    bare: DataFrame  # the same records, without the file where nothing needs it
    options: PrepOptions
    times: TimeReader
    columns: list[OutputColumn]
    lookups: tuple[LookupTable, ...]
    start: int | None
    end: int | None
    bounds: Bounds

    @property
    def schema(self):
        return struct_type(self.columns)

    @property
    def profiled_columns(self) -> list[OutputColumn]:
        return [c for c in self.columns if c.role != "geometry"]

    def _cleaned(self, raw: DataFrame) -> DataFrame:
        df = clean(raw, self.columns, self.options, self.times)
        if self.options.site_id or any(c.role in ("encoded", "ids", "lookup") for c in self.columns):
            # numbered here, before any shuffle; dropped from the plan if every join is a broadcast
            df = spread_column(df)
        markers = NullMarkers.of(self.options)
        for lookup in self.lookups:
            df = add_lookup(df, lookup, raw_of(lookup.source), markers, True, **self.bounds)
        return decide(df, self.start, self.end)

    @cached_property
    def decided(self) -> DataFrame:
        """Every record: typed values, statuses, and whether it is accepted."""
        return self._cleaned(self.raw)

    @property
    def _condition(self) -> str:
        return accept_condition(self.bare, self.options, self.times, self.start, self.end)

    @cached_property
    def accepted(self) -> DataFrame:
        """Accepted records before ids and geometry, filtered in the scan."""
        return self._cleaned(self.bare.where(self._condition))

    @cached_property
    def rejected(self) -> DataFrame:
        return self._cleaned(self.bare.where(f"NOT coalesce({self._condition}, false)"))

    @property
    def typed(self) -> DataFrame:
        """Every record with typed values, before lookups."""
        return clean(self.bare, self.columns, self.options, self.times)

    @cached_property
    def dictionary(self) -> DataFrame | None:
        """(column, value, id, n) over all records, rejected ones too."""
        encoded = [c for c in self.columns if c.role in ("encoded", "ids")]
        if not encoded:
            return None
        # first seen by time, then by value, unless the input has an order or a column that orders it
        order = [self.options.output_name(c) for c in self.options.first_seen_by or ("time",)]
        if self.options.reading_order and not self.options.first_seen_by:
            order = [PLACE_COLUMN]
        return build_dictionary(self.typed, [c.name for c in encoded], order, self.known_ids)

    @cached_property
    def known_ids(self) -> DataFrame | None:
        """(column, value, id) of earlier runs, where they are kept."""
        path = self.options.dictionary_path
        return stored_dictionary(self.raw.sparkSession, path) if path else None

    @cached_property
    def site_radius(self) -> DataFrame:
        """(site, site_radius) from the accepted records."""
        radius = F.col("radius") if self.options.radius else F.lit(None).cast("float")
        sites = self.accepted.select(
            F.col(quoted(raw_of(self.options.site_id))).alias("site"), "lat", "lon",
            radius.alias("radius"), "time",
        )
        tolerance = self.options.site_tolerance
        stored = joined_sites(sites, tolerance) if tolerance else written(distinct_sites(sites), "sites")
        radii = radius_per_site(stored, self.options.distinct_site_coordinates, **self.bounds)
        return written(radii, "radius")

    def records(self, *more: str) -> DataFrame:
        """The finished records, in output order and types; then the columns named in ``more``."""
        df, o = self.accepted, self.options
        if o.rare_class is not None and o.unique_strings is not None:
            texts = [c.name for c in self.columns if c.kind == "string" and c.role == "value"]
            df = fold_rare(df, texts, o.unique_strings, o.rare_class, **self.bounds)
        for column in self.columns:
            if column.role in ("encoded", "ids"):
                df = encode(df, self.dictionary, column.name, "__id", **self.bounds)
                df = df.withColumn(column.name, F.col("__id")).drop("__id")
        radius = None
        if self.options.site_id:
            df = df.withColumn("__site", F.col(quoted(raw_of(self.options.site_id))))
            table = self.site_radius.withColumnRenamed("site", "__site")
            df = left_join_unique(df, table, "__site", **self.bounds)
            radius = "site_radius"
        elif self.options.radius:
            df = df.withColumn("site_radius", F.col("radius").try_cast("int"))
            radius = "site_radius"
        df = add_geometry(df, radius, self.options.randomize, self.options.seed)
        return df.select(*[quoted(c.name) for c in self.columns], *map(quoted, more))

    def rejects(self) -> DataFrame:
        """Rejected records with the reason and the typed values, encoded columns as text."""
        names = [quoted(c.name) for c in self.profiled_columns if c.role != "ids"]
        return self.rejected.select(REASON, *names)

    def profile(self) -> DataFrame:
        return profiles.profile(self.decided, self.profiled_columns, self.options.approximate_distinct)

    def totals(self) -> DataFrame:
        return profiles.run_totals(self.decided, self.start, self.end)

    def daily(self) -> DataFrame:
        return profiles.rows_per_day(self.accepted)

    def reject_reasons(self) -> DataFrame:
        return profiles.reject_reasons(self.rejected)

    def catalogue(self, with_counts: bool = False) -> DataFrame:
        return catalogues.attribute_catalogue(
            self.raw.sparkSession, self.columns, self.options, self.profile() if with_counts else None
        )

    @cached_property
    def observed(self) -> ObservedRun:
        """The run over its decided records, written as a table in one pass over the input.

        The totals are observed while the table is written; everything else reads the table's
        columns, not the input.
        """
        observation = Observation()
        measures = profiles.total_measures(self.start, self.end)
        watched = self.decided.observe(observation, *[F.expr(v).alias(n) for n, v in measures.items()])
        table = written(watched, "decided")
        held = {f.name: getattr(self, f.name) for f in fields(self)}
        return ObservedRun(**held, table=table, measured=observation.get)

    def report(self) -> DataFrame:
        """The report as lines of text, in order."""
        return self.observed.report()

    def write(self, mode: str = "errorifexists") -> ObservedRun:
        """Write the records and, where paths are given, the report and the catalogue.

        The input is read once; the run over the table of that pass is handed back.
        """
        o, run = self.options, self.observed
        if not o.output_path:
            raise OptionsError("output_path is not set")
        layout = (o.records_per_file, o.row_group_bytes, o.page_bytes, mode)
        if o.reading_order:
            write_rolled(run.records(PLACE_COLUMN), o.output_path, [PLACE_COLUMN], *layout, drop=[PLACE_COLUMN])
        else:
            write_records(run.records(), o.output_path, *layout)
        if o.dictionary_path and run.dictionary is not None:
            store_dictionary(run.dictionary, o.dictionary_path, run.known_ids)
        if o.report_path:
            write_text(run.report(), o.report_path, mode)
        if o.catalogue_path:
            write_text(catalogues.catalogue_document(run.catalogue()), o.catalogue_path, mode)
        return run


@dataclass(frozen=True)
class ObservedRun(Preparation):
    """The same results from a stored table of decided records; ``close`` removes it."""

    table: DataFrame
    measured: dict[str, int]

    @property
    def decided(self) -> DataFrame:
        return self.table

    @property
    def typed(self) -> DataFrame:
        return self.table

    @property
    def accepted(self) -> DataFrame:
        return self.table.where(ACCEPTED)

    @property
    def rejected(self) -> DataFrame:
        return self.table.where(f"NOT {ACCEPTED}")

    @property
    def observed(self) -> ObservedRun:
        return self

    @cached_property
    def _days(self) -> DataFrame:
        return written(profiles.days_and_reasons(self.table), "days")

    @cached_property
    def _profiled(self) -> DataFrame:
        return written(super().profile(), "profile")

    def profile(self) -> DataFrame:
        return self._profiled

    def totals(self) -> DataFrame:
        spark = self.table.sparkSession
        totals = spark.createDataFrame([self.measured], ", ".join(f"{name} long" for name in self.measured))
        if FILE_COLUMN not in self.table.columns:
            return totals
        # one row on both sides
        return totals.join(F.broadcast(self._days.agg(F.count_distinct("file").alias("files"))))

    def daily(self) -> DataFrame:
        return (
            self._days.where(f"{REASON} IS NULL").groupBy("day").agg(F.sum("n").alias("n")).orderBy("day")
        )

    def reject_reasons(self) -> DataFrame:
        return self._days.where(f"{REASON} IS NOT NULL").groupBy(REASON).agg(F.sum("n").alias("n"))

    def report(self) -> DataFrame:
        o = self.options
        return ordered_text(
            report_lines(
                self.totals(), self.profile(), self.daily(), self.reject_reasons(),
                o.start_time, o.end_time, o.unique_strings,
            )
        )

    def close(self) -> None:
        """Remove the tables of this run; results that are not written yet would miss them."""
        held = [self.table, *(vars(self).get(name) for name in ("_days", "_profiled", "site_radius"))]
        discard(*[table for table in held if table is not None])


def _time_reader(
    records: DataFrame, seen: DataFrame, options: PrepOptions
) -> tuple[TimeReader, DataFrame]:
    """How times are read, and the records with the format of their file where files differ."""
    zone = options.timezone
    stored = dict(records.dtypes)[options.time] in STORED_TYPES
    if options.time_format or stored or FILE_COLUMN not in records.columns or options.sample_rows:
        return TimeReader(options.time_format or detect_format(seen, options.time), zone), records
    table = written(formats_by_file(records, options.time, FILE_COLUMN), "formats")
    # at most one row per known format
    formats = sorted(row[0] for row in table.select(FORMAT_COLUMN).distinct().collect() if row[0])
    if len(formats) > 1:
        return TimeReader(BY_FILE, zone, tuple(formats)), left_join_unique(records, table, FILE_COLUMN)
    return TimeReader(formats[0] if formats else detect_format(seen, options.time), zone), records


def prepare(
    spark: SparkSession,
    options: PrepOptions,
    records: DataFrame | None = None,
    lookups: tuple[LookupTable, ...] | None = None,
    **bounds: int,
) -> Preparation:
    """Check the options, find the time format and the types, and set up the run.

    Both come from all records, by one aggregate each; none is run for what is declared or
    stored with its type.

    ``records`` and ``lookups`` stand in for files that are already DataFrames. ``bounds``
    (max_rows, max_bytes) limit what may be broadcast.
    """
    bare = records
    if records is None:
        if not options.input_path:
            raise OptionsError("input_path is not set")
        o = options
        if o.reading_order:
            records = bare = read_in_order(spark, o.input_path, o.headers, o.quote, o.sep)
        else:
            records, bare = read_for_run(spark, o.input_path, o.headers, o.multiline, o.quote, o.sep)
    if lookups is None:
        lookups = tuple(read_lookup(spark, lookup) for lookup in options.lookups)
    names = [c for c in records.columns if c not in (FILE_COLUMN, PLACE_COLUMN)]
    options.check_against(names, [lookup.target for lookup in lookups])
    missing = sorted({lookup.source for lookup in lookups} - set(names))
    if missing:
        raise OptionsError(f"lookup sources not in the input: {', '.join(missing)}")
    seen = records if options.sample_rows is None else records.limit(options.sample_rows)
    times, records = _time_reader(records, seen, options)
    if times.fmt == BY_FILE:
        bare = seen = records
    columns = resolve_schema(seen, options, times, lookups)
    start, end = gate_bounds(records, options, times)
    return Preparation(records, bare, options, times, columns, tuple(lookups), start, end, bounds)
