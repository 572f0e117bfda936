"""Runs that read once, go on where earlier runs ended, and keep the order of the input."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.inputs import derived, table, with_inputs
from suite.profiles import END, START, _FIRST, over_trips, trip_options, trips
from suite.registry import query
from trailmill.operators import profile as profiles
from trailmill.operators.closeness import joined_sites
from trailmill.operators.sketches import (
    distinct_sketches, estimated_distinct, relative_error, store_sketches, stored_sketches,
)
from trailmill.options import PrepOptions
from trailmill.plans.preparation import prepare
from trailmill.plans.sinks import write_rolled
from trailmill.session import scratch_path
from trailmill.sources.files import FILE_COLUMN, read_in_order, read_parquet

_CSV_SCAN = "FileScan csv"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _trip_files(spark, sf_dir, where: str = "true") -> str:
    """The trips as CSV files in order of id and person: file by file, and within each."""
    path = scratch_path(spark, "trips")
    frame = derived(spark, sf_dir, "trips").where(where)
    ordered = frame.repartitionByRange("trip_id").sortWithinPartitions("trip_id", "person")
    ordered.write.options(header=True, maxRecordsPerFile=7000).csv(path)
    return path


@query(
    "run_observed",
    over_trips(f"""
        , judged AS (SELECT *, lat IS NOT NULL AND lon IS NOT NULL AND time IS NOT NULL AS good FROM typed)
        , kept AS (SELECT * FROM judged WHERE good AND time BETWEEN {START}000 AND {END}000)
        SELECT day, n, total, written, total - written AS rejected, time_gated, read_again
        FROM (SELECT strftime(make_timestamp(time * 1000), '%Y-%m-%d') AS day, count(*) AS n FROM kept GROUP BY ALL) d,
            (SELECT count(*) AS total, count(*) FILTER (WHERE time NOT BETWEEN {START}000 AND {END}000) AS time_gated,
                FALSE AS read_again FROM judged) t,
            (SELECT count(*) AS written FROM kept) w"""),
)
def run_observed(spark, sf_dir):
    """A run over CSV files with declared types: totals observed in the one pass, days from its table."""
    options = trip_options(
        start_time=str(START), end_time=str(END), input_path=_trip_files(spark, sf_dir),
    )
    run = prepare(spark, options).observed
    results = (run.records(), run.daily(), run.profile(), run.reject_reasons(), run.report())
    again = any(_CSV_SCAN in _plan(result) for result in results)
    totals = run.totals().select("total", "written", "rejected", "time_gated")
    # one row on the right
    return run.daily().join(F.broadcast(totals)).withColumn("read_again", F.lit(again))


_WIDE = {f"n{i}": f"CASE WHEN c_custkey % {i + 5} = 1 THEN 'x' WHEN c_custkey % {i + 5} = 2 THEN NULL"
                  f" ELSE CAST(c_custkey % {i + 3} AS STRING) END" for i in range(90)}


@query(
    "profile_wide",
    "WITH wide AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _WIDE.items()) + " FROM customer) "
    + " UNION ALL ".join(
        f"""SELECT '{n}' AS "column", count({n}) AS non_null, count(*) FILTER (WHERE {n} = 'x') AS invalid,
            count(*) - count({n}) AS nulls, count(*) FILTER (WHERE {n} = '0') AS zeros,
            CAST(min(TRY_CAST({n} AS FLOAT)) AS DOUBLE) AS min, CAST(max(TRY_CAST({n} AS FLOAT)) AS DOUBLE) AS max
            FROM wide""" for n in _WIDE
    ),
)
def profile_wide(spark, sf_dir):
    """Ninety columns of numbers, some malformed, some empty, in one aggregate of constant size."""
    raw = table(spark, sf_dir, "customer").selectExpr(
        "'1' AS y", "'2' AS x", "'1700000000' AS at", *[f"{e} AS {n}" for n, e in _WIDE.items()]
    )
    options = PrepOptions(longitude="x", latitude="y", time="at", time_format="epoch_s", float_columns=list(_WIDE))
    run = prepare(spark, options, records=raw)
    counts = profiles.profile_counts(run.decided, run.profiled_columns)
    return counts.where("column LIKE 'n%'").select("column", "non_null", "invalid", "nulls", "zeros", "min", "max")


@query(
    "distinct_sketch",
    over_trips("""
        , named AS (SELECT 'cell' AS "column", cell AS v FROM typed UNION ALL
                    SELECT 'person', NULLIF(person, '') FROM typed UNION ALL SELECT 'flag', flag FROM typed)
        SELECT "column", count(v) AS n, count(DISTINCT v) AS n_distinct, TRUE AS within_error
        FROM named GROUP BY "column" """),
)
def distinct_sketch(spark, sf_dir):
    """Sketches of two runs, stored one after the other and united, against the exact counts."""
    path = scratch_path(spark, "sketches")
    whole = trips(spark, sf_dir)
    for part in ("trip_id % 16 < 8", "trip_id % 16 >= 8"):
        store_sketches(distinct_sketches(whole.decided.where(part), whole.profiled_columns), path)
    estimated = estimated_distinct(stored_sketches(spark, path)).withColumnRenamed("n_distinct", "estimate")
    exact = profiles.profile_distinct(whole.decided, whole.profiled_columns)
    off = F.abs(F.col("estimate") - F.col("n_distinct")) <= F.ceil(relative_error() * F.col("n_distinct"))
    return exact.join(estimated, "column").select("column", "n", "n_distinct", off.alias("within_error"))


@query(
    "strings_folded",
    over_trips("""
        , persons AS (SELECT NULLIF(person, '') AS v FROM accepted)
        , places AS (SELECT v, row_number() OVER (ORDER BY count(*) DESC, v) AS place FROM persons
            WHERE v IS NOT NULL GROUP BY v)
        SELECT CASE WHEN place > 25 THEN 'other' ELSE v END AS person, flag, count(*) AS n
        FROM (SELECT NULLIF(person, '') AS v, flag FROM accepted) t LEFT JOIN places USING (v) GROUP BY ALL"""),
)
def strings_folded(spark, sf_dir):
    """The 25 most frequent persons stay, all others become one class; flags are few and stay."""
    run = trips(spark, sf_dir, unique_strings=25, rare_class="other")
    return run.records().groupBy("person", "flag").agg(F.count(F.lit(1)).alias("n"))


@query("dictionary_file_order", with_inputs(_FIRST.format("person") + "SELECT v AS value, id FROM ids", "trips"))
def dictionary_file_order(spark, sf_dir):
    """Ids in the order in which a reader of the files, one after the other, would meet the values."""
    options = trip_options(
        string_columns=["cell", "flag"], encoded_columns=["person"], reading_order=True,
        input_path=_trip_files(spark, sf_dir),
    )
    return prepare(spark, options).dictionary.select("value", "id")


@query(
    "dictionary_continued",
    with_inputs("""
        , firsts AS (SELECT v, min(trip_id % 5 >= 3) AS late, min(trip_id) FILTER (trip_id % 5 < 3) AS early_first,
            min(trip_id) FILTER (trip_id % 5 >= 3) AS late_first
            FROM (SELECT trip_id, NULLIF(person, '') AS v FROM trips) t WHERE v IS NOT NULL GROUP BY v)
        SELECT v AS value, row_number() OVER (ORDER BY late, CASE WHEN late THEN late_first ELSE early_first END, v) AS id
        FROM firsts""", "trips"),
)
def dictionary_continued(spark, sf_dir):
    """A second run keeps the stored ids and goes on after the largest."""
    kept = scratch_path(spark, "ids")
    for part in ("trip_id % 5 < 3", "trip_id % 5 >= 3"):
        options = trip_options(
            string_columns=["cell", "flag"], encoded_columns=["person"], reading_order=True,
            input_path=_trip_files(spark, sf_dir, part), dictionary_path=kept,
            output_path=scratch_path(spark, "out"),
        )
        prepare(spark, options).write()
    return spark.read.parquet(kept).select("value", "id")


@query(
    "parquet_rolled_exact",
    with_inputs("""
        , placed AS (SELECT trip_id, row_number() OVER (ORDER BY trip_id) - 1 AS pos FROM trips)
        SELECT 'exact' AS layout, pos // 4999 AS file, count(*) AS n, min(trip_id) AS first, max(trip_id) AS last
        FROM placed GROUP BY pos // 4999
        UNION ALL SELECT 'one', 0, count(*), min(trip_id), max(trip_id) FROM placed""", "trips"),
)
def parquet_rolled_exact(spark, sf_dir):
    """Every file but the last holds exactly 4999 records, in the order they were read; 0 gives one file."""
    records = read_in_order(spark, _trip_files(spark, sf_dir)).withColumn("trip_id", F.col("trip_id").cast("long"))
    whole = None
    for layout, size in (("exact", 4999), ("one", 0)):
        path = scratch_path(spark, "exact")
        write_rolled(records.drop(FILE_COLUMN), path, ["__place"], size, drop=["__place"])
        number = F.regexp_extract(F.col(FILE_COLUMN), r"part-(\d+)", 1).cast("long")
        part = read_parquet(spark, path).groupBy(number.alias("file")).agg(
            F.count(F.lit(1)).alias("n"), F.min("trip_id").alias("first"), F.max("trip_id").alias("last")
        ).select(F.lit(layout).alias("layout"), "file", "n", "first", "last")
        whole = part if whole is None else whole.unionByName(part)
    return whole


# Sites of a few identifiers, in clusters: steps of 0.003 degrees on a coarse grid of 0.1.
_CLOSE = {
    "site": "'s' || CAST(c_custkey % 11 AS STRING)",
    "lat": "((c_custkey * 7919) % 2) / CAST(10 AS DOUBLE) + ((c_custkey * 31) % 23) * CAST(0.003 AS DOUBLE)",
    "lon": "((c_custkey * 10473) % 3) / CAST(10 AS DOUBLE) + ((c_custkey * 17) % 29) * CAST(0.003 AS DOUBLE)",
    "time": "c_custkey",
}


@query(
    "sites_within_tolerance",
    f"""WITH RECURSIVE p AS (SELECT {", ".join(f"{e} AS {n}" for n, e in _CLOSE.items())} FROM customer),
        c AS (SELECT site, lat, lon, max(time) AS seen FROM p GROUP BY ALL),
        near AS (SELECT x.seen AS a, y.seen AS b FROM c x JOIN c y ON x.site = y.site
            AND abs(x.lat - y.lat) <= 0.0100001 AND abs(x.lon - y.lon) <= 0.0100001),
        reach(a, b) AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a),
        comp AS (SELECT a, max(b) AS latest FROM reach GROUP BY a)
        SELECT site, lat, lon, seen AS last_seen FROM c WHERE seen IN (SELECT latest FROM comp)""",
)
def sites_within_tolerance(spark, sf_dir):
    """Chains of coordinates within a hundredth of a degree are one site, across borders of cells too."""
    points = table(spark, sf_dir, "customer").selectExpr(*[f"{e} AS {n}" for n, e in _CLOSE.items()])
    found = joined_sites(points.withColumn("radius", F.lit(None).cast("float")), 0.0100001)
    return found.select("site", "lat", "lon", "last_seen")
