"""Casts, null markers, schema, record filters, lookups and time formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.inputs import LOOKUPS, NATION_KEY, derived, lookup_rows, table, with_inputs
from suite.registry import query
from trailmill.functions import casts, times
from trailmill.functions.names import display_name
from trailmill.operators.clean import status_of
from trailmill.operators.lookup import add_lookup
from trailmill.operators.preview import column_preview, search_columns
from trailmill.options import PrepOptions
from trailmill.plans.preparation import prepare
from trailmill.sources.lookups import LookupTable

GEO = dict(longitude="raw_lon", latitude="raw_lat", time="raw_time", time_format="epoch_s")

# What the oracle calls a whole number: DuckDB would also round fractions and powers of ten.
LONG = "CASE WHEN regexp_full_match({0}, '[+-]?[0-9]+') THEN TRY_CAST({0} AS BIGINT) END"
LAT = "TRY_CAST(raw_lat AS DOUBLE)"
LON = "TRY_CAST(raw_lon AS DOUBLE)"
TIME = "CASE WHEN length(raw_time) >= 10 THEN TRY_CAST(raw_time AS BIGINT) * 1000 END"
LAT_OK, LON_OK = f"{LAT} BETWEEN -90 AND 90", f"{LON} BETWEEN -180 AND 180"
TYPED = f"""
    , typed AS (SELECT *,
        CASE WHEN {LAT_OK} THEN {LAT} END AS lat,
        CASE WHEN {LON_OK} THEN {LON} END AS lon,
        {TIME} AS time,
        CASE WHEN raw_lat = '' THEN 'null' WHEN {LAT} IS NULL THEN 'invalid'
             WHEN NOT ({LAT_OK}) THEN 'out_of_range' ELSE 'ok' END AS lat_status,
        CASE WHEN raw_lon = '' THEN 'null' WHEN {LON} IS NULL THEN 'invalid'
             WHEN NOT ({LON_OK}) THEN 'out_of_range' ELSE 'ok' END AS lon_status,
        CASE WHEN raw_time = '' THEN 'null' WHEN {TIME} IS NULL THEN 'invalid' ELSE 'ok' END AS time_status
        FROM {{0}})
    , accepted AS (SELECT * FROM typed WHERE lat IS NOT NULL AND lon IS NOT NULL AND time IS NOT NULL)
"""


def over_geo(body: str) -> str:
    return with_inputs(TYPED.format("geo_raw") + body, "geo_raw")


def geo_options(**changes) -> PrepOptions:
    defaults = GEO | dict(
        string_columns=["cell_id", "raw_radius", "segment", "unused"],
        float_columns=["amount", "broken"],
        long_columns=["visits", "row_id"],
    )
    return PrepOptions(**(defaults | changes))


def prepared(spark, sf_dir, **changes):
    return prepare(spark, geo_options(**changes), records=derived(spark, sf_dir, "geo_raw"))


# -- casts ------------------------------------------------------------------------------------


def _cast_query(name, column, cast, sql_value, out_type):
    sql = with_inputs(
        f"SELECT row_id, {sql_value} AS value,"
        f" CAST({column} IS NOT NULL AND {sql_value.replace('ROUND', '')} IS NULL AS BOOLEAN) AS invalid"
        " FROM geo_raw",
        "geo_raw",
    )

    @query(name, sql)
    def run(spark, sf_dir):
        value = F.expr(cast(column))
        return derived(spark, sf_dir, "geo_raw").select(
            "row_id", value.cast(out_type).alias("value"),
            (F.col(column).isNotNull() & value.isNull()).alias("invalid"),
        )


_cast_query("safe_cast_float", "amount", casts.to_float, "CAST(TRY_CAST(amount AS FLOAT) AS DOUBLE)", "double")
_cast_query("safe_cast_double", "raw_lat", casts.to_double, "TRY_CAST(raw_lat AS DOUBLE)", "double")
_cast_query("safe_cast_long", "visits", casts.to_long, LONG.format("visits"), "bigint")


@query(
    "string_empty_to_null",
    with_inputs("SELECT row_id, NULLIF(segment, '') AS segment FROM geo_raw", "geo_raw"),
)
def string_empty_to_null(spark, sf_dir):
    return derived(spark, sf_dir, "geo_raw").select(
        "row_id", F.expr(casts.to_text("segment")).alias("segment")
    )


@query(
    "radius_clean",
    with_inputs(
        "SELECT row_id, CAST(TRY_CAST(NULLIF(NULLIF(raw_radius, ''), 'null') AS FLOAT) AS DOUBLE)"
        " AS radius FROM geo_raw",
        "geo_raw",
    ),
)
def radius_clean(spark, sf_dir):
    radius = F.expr(casts.to_float(casts.radius_text("raw_radius")))
    return derived(spark, sf_dir, "geo_raw").select("row_id", radius.cast("double").alias("radius"))


# -- columns and schema -----------------------------------------------------------------------


@query("rename_exclude", over_geo("SELECT row_id, lat, lon, time, cell_id FROM accepted").replace(
    "cell_id FROM accepted", "NULLIF(cell_id, '') AS cell_id FROM accepted"))
def rename_exclude(spark, sf_dir):
    run = prepared(
        spark, sf_dir, string_columns=["cell_id"], float_columns=[], long_columns=["row_id"],
        excluded=["raw_radius", "amount", "visits", "segment", "unused", "broken"],
    )
    names = [c.name for c in run.columns if c.role != "geometry"]
    return run.records().select(*sorted(names))


@query(
    "declared_types",
    over_geo(f"""
        SELECT row_id, CAST(TRY_CAST(amount AS FLOAT) AS DOUBLE) AS amount,
               TRY_CAST(raw_radius AS DOUBLE) AS raw_radius, {LONG.format('visits')} AS visits,
               NULLIF(segment, '') AS segment, time + 1000 AS seen
        FROM accepted"""),
)
def declared_types(spark, sf_dir):
    raw = derived(spark, sf_dir, "geo_raw").withColumn(
        "seen", (F.col("raw_time").try_cast("bigint") + 1).cast("string")
    )
    options = geo_options(
        double_columns=["raw_radius"], string_columns=["segment", "cell_id", "unused"],
        time_columns=["seen"],
    )
    return prepare(spark, options, records=raw).records().select(
        "row_id", F.col("amount").cast("double").alias("amount"), "raw_radius", "visits",
        "segment", "seen",
    )


@query(
    "default_type",
    over_geo("SELECT row_id, TRY_CAST(segment AS DOUBLE) AS segment,"
             " TRY_CAST(broken AS DOUBLE) AS broken FROM accepted"),
)
def default_type(spark, sf_dir):
    raw = derived(spark, sf_dir, "geo_raw").select(
        "row_id", "raw_lat", "raw_lon", "raw_time", "segment", "broken"
    )
    options = PrepOptions(**GEO, long_columns=["row_id"], default_type="double")
    return prepare(spark, options, records=raw).records().select("row_id", "segment", "broken")


@query(
    "schema_inferred",
    with_inputs("""
        , counted AS (
            SELECT 'cell_id' AS name, cell_id AS v FROM geo_raw UNION ALL
            SELECT 'amount', amount FROM geo_raw UNION ALL
            SELECT 'visits', visits FROM geo_raw UNION ALL
            SELECT 'raw_time', NULLIF(raw_time, '') FROM geo_raw UNION ALL
            SELECT 'segment', segment FROM geo_raw UNION ALL
            SELECT 'unused', unused FROM geo_raw UNION ALL
            SELECT 'fixed', CAST(1700000000 + row_id AS STRING) FROM geo_raw UNION ALL
            SELECT 'share', CAST(row_id AS STRING) || '.5' FROM geo_raw)
        SELECT name, CASE
            WHEN count(v) = 0 THEN 'string'
            WHEN count(v) = count(CASE WHEN length(v) >= 10 THEN TRY_CAST(v AS BIGINT) END) THEN 'long'
            WHEN count(v) = count(TRY_CAST(v AS FLOAT)) THEN 'float'
            ELSE 'string' END AS type
        FROM counted WHERE name <> 'raw_time' GROUP BY name""", "geo_raw"),
)
def schema_inferred(spark, sf_dir):
    """Types that fit every value of the table, from one aggregate over all of it."""
    raw = derived(spark, sf_dir, "geo_raw").select(
        "raw_lat", "raw_lon", "raw_time", "cell_id", "amount", "visits", "segment", "unused",
        (F.lit(1700000000) + F.col("row_id")).cast("string").alias("fixed"),
        F.concat(F.col("row_id").cast("string"), F.lit(".5")).alias("share"),
    )
    run = prepare(spark, PrepOptions(**GEO), records=raw)
    rows = [(c.name, c.kind) for c in run.columns if c.role in ("value", "moment")]
    return spark.createDataFrame(rows, "name string, type string")


@query(
    "schema_whole_input",
    over_geo("""
        SELECT row_id, time, visits, NULLIF(segment, '') AS segment, CAST(1700000000 + row_id AS BIGINT) * 1000 AS fixed,
            CAST(row_id AS BIGINT) * 1000003 + 123456789 AS big, row_id / CAST(8 AS DOUBLE) + 900000 AS stored
        FROM accepted"""),
)
def schema_whole_input(spark, sf_dir):
    """Nothing declared: no value is lost in a column of numbers and text, stored numbers stay."""
    raw = derived(spark, sf_dir, "geo_raw").selectExpr(
        "CAST(row_id AS BIGINT) AS row_id", "raw_lat", "raw_lon", "raw_time", "visits", "segment",
        "CAST(1700000000 + row_id AS STRING) AS fixed",
        "CAST(row_id AS BIGINT) * 1000003 + 123456789 AS big",
        "row_id / CAST(8 AS DOUBLE) + 900000 AS stored",
    )
    options = PrepOptions(longitude="raw_lon", latitude="raw_lat", time="raw_time")
    return prepare(spark, options, records=raw).records().select(
        "row_id", "time", "visits", "segment", "fixed", "big", "stored"
    )


_PREVIEW_COLUMNS = ("raw_time", "cell_id", "visits", "segment", "unused", "broken")
_PREVIEW_SQL = with_inputs(
    ", first AS (SELECT * FROM geo_raw ORDER BY row_id LIMIT 3), shown AS ("
    + " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS name, row_id, CAST({c} AS STRING) AS v FROM first"
        for i, c in enumerate(_PREVIEW_COLUMNS, 1)
    )
    + """)
    SELECT CAST(position AS INTEGER) AS position, name AS "column",
        CASE WHEN COALESCE(min_by(COALESCE(v, ''), row_id), '') = '' THEN 'Undetermined'
             WHEN TRY_CAST(min_by(COALESCE(v, ''), row_id) AS FLOAT) IS NOT NULL THEN 'Float'
             ELSE 'String' END AS type,
        string_agg(COALESCE(v, 'null') || '; ', '' ORDER BY row_id) AS examples
    FROM shown {where} GROUP BY position, name""",
    "geo_raw",
)


@query("column_preview", _PREVIEW_SQL.replace("{where}", ""))
def preview(spark, sf_dir):
    raw = derived(spark, sf_dir, "geo_raw").select("row_id", *_PREVIEW_COLUMNS)
    return column_preview(raw, order_by="row_id")


@query("preview_search", _PREVIEW_SQL.replace("{where}", "WHERE contains(lower(name), 'se')"))
def preview_search(spark, sf_dir):
    return search_columns(preview(spark, sf_dir), " SE ")


_NAME_PARTS = "event_type || '_idOfUser' || CAST(user_id AS STRING) || '_lastSeenAt_' || 'aBcDe'"


@query(
    "display_names",
    f"""SELECT event_id, regexp_replace(regexp_replace(replace({_NAME_PARTS}, '_', ' '),
        '([a-z])([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z])([A-Z][a-z])', '\\1 \\2', 'g') AS name
        FROM events""",
)
def display_names(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", display_name(F.expr(_NAME_PARTS)).alias("name")
    )


# -- null markers -----------------------------------------------------------------------------


@query(
    "null_by_type",
    over_geo(f"""
        SELECT row_id,
            CAST(CASE WHEN TRY_CAST(amount AS FLOAT) <> CAST(2147483647 AS FLOAT)
                 THEN TRY_CAST(amount AS FLOAT) END AS DOUBLE) AS amount,
            CASE WHEN {LONG.format('visits')} NOT IN (-1, 0) THEN {LONG.format('visits')} END AS visits,
            CASE WHEN segment NOT IN ('', 'n/a') THEN segment END AS segment
        FROM accepted"""),
)
def null_by_type(spark, sf_dir):
    run = prepared(
        spark, sf_dir, float_null_values=[2147483647], long_null_values=[-1, 0],
        string_null_values=["n/a"],
    )
    return run.records().select(
        "row_id", F.col("amount").cast("double").alias("amount"), "visits", "segment"
    )


@query(
    "null_by_column",
    over_geo(f"""
        SELECT row_id,
            CAST(CASE WHEN TRY_CAST(amount AS FLOAT) <> 0 THEN TRY_CAST(amount AS FLOAT) END AS DOUBLE) AS amount,
            CASE WHEN {LONG.format('visits')} <> -1 THEN {LONG.format('visits')} END AS visits,
            CASE WHEN segment NOT IN ('', 'BUILDING', 'MACHINERY') THEN segment END AS segment
        FROM accepted"""),
)
def null_by_column(spark, sf_dir):
    """A list for a column replaces the list of its type."""
    run = prepared(
        spark, sf_dir, float_null_values=[2147483647], long_null_values=[-1],
        string_null_values=["n/a"],
        column_null_values={"amount": ["0"], "segment": ["BUILDING", "MACHINERY"]},
    )
    return run.records().select(
        "row_id", F.col("amount").cast("double").alias("amount"), "visits", "segment"
    )


@query(
    "null_rejects_row",
    over_geo("SELECT row_id, lat, lon, time FROM accepted"
             " WHERE lat NOT IN (58.25, -10.5) AND time <> 1700000037000"),
)
def null_rejects_row(spark, sf_dir):
    run = prepared(
        spark, sf_dir, column_null_values={"lat": ["58.25", "-10.5"], "time": ["1700000037000"]}
    )
    return run.records().select("row_id", "lat", "lon", "time")


# -- filters ----------------------------------------------------------------------------------


def _filter_query(name, column):
    @query(name, over_geo(f"SELECT row_id, {column} FROM typed WHERE {column}_status = 'ok'"))
    def run(spark, sf_dir):
        decided = prepared(spark, sf_dir).decided
        return decided.where(F.col(status_of(column)) == "ok").select("row_id", column)


for _name in ("lon", "lat", "time"):
    _filter_query(f"filter_{_name}", _name)


@query(
    "time_gate",
    over_geo("SELECT row_id, time FROM accepted WHERE time BETWEEN 1700005000000 AND 1700040000000"),
)
def time_gate(spark, sf_dir):
    run = prepared(spark, sf_dir, start_time="1700005000", end_time="1700040000")
    return run.records().select("row_id", "time")


@query(
    "accept_reject",
    over_geo("""
        SELECT row_id, reject_reason IS NULL AS accepted, reject_reason FROM (SELECT row_id,
            CASE WHEN lon_status <> 'ok' THEN 'lon_' || lon_status
                 WHEN lat_status <> 'ok' THEN 'lat_' || lat_status
                 WHEN time_status <> 'ok' THEN 'time_' || time_status
                 WHEN time < 1700005000000 THEN 'before_start' END AS reject_reason FROM typed) r"""),
)
def accept_reject(spark, sf_dir):
    run = prepared(spark, sf_dir, start_time="1700005000")
    rejected = run.rejects().select("row_id", F.lit(False).alias("accepted"), "reject_reason")
    kept = run.records().select(
        "row_id", F.lit(True).alias("accepted"), F.lit(None).cast("string").alias("reject_reason")
    )
    return kept.unionByName(rejected)


# -- lookups ----------------------------------------------------------------------------------


def _lookup_query(kind, out_type):
    target, value = LOOKUPS[kind]
    casted = {
        "string": "v", "long": LONG.format("v"), "float": "CAST(TRY_CAST(v AS FLOAT) AS DOUBLE)",
        "double": "TRY_CAST(v AS DOUBLE)",
    }[kind]
    sql = with_inputs(
        f""", keyed AS (SELECT {NATION_KEY} AS k, {value} AS v FROM nation)
        SELECT row_id, {casted} AS {target} FROM geo_raw LEFT JOIN keyed ON lower(cell_id) = lower(k)""",
        "geo_raw",
    )

    @query(f"lookup_{kind}", sql)
    def run(spark, sf_dir):
        lookup = LookupTable("cell_id", target, kind, lookup_rows(spark, sf_dir, kind))
        raw = derived(spark, sf_dir, "geo_raw").select("row_id", "cell_id")
        return add_lookup(raw, lookup, "cell_id").select(
            "row_id", F.col(target).cast(out_type).alias(target)
        )


for _kind, _type in (("string", "string"), ("long", "bigint"), ("float", "double"), ("double", "double")):
    _lookup_query(_kind, _type)


@query(
    "lookup_case_folded",
    """SELECT c_custkey, CAST(r_regionkey AS BIGINT) AS region_id FROM customer
       LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
)
def lookup_case_folded(spark, sf_dir):
    """Upper-case names looked up in a table of mixed-case ones."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.initcap("n_name").alias("key"), F.col("r_regionkey").cast("string").alias("value"),
        F.col("n_nationkey").alias("position"),
    )
    lookup = LookupTable("place", "region_id", "long", rows)
    raw = table(spark, sf_dir, "customer").select(
        "c_custkey", F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("place")
    )
    return add_lookup(raw, lookup, "place").select("c_custkey", "region_id")


# -- time -------------------------------------------------------------------------------------

_MS = "CAST(floor(epoch_us(ts) / CAST(1000 AS DOUBLE)) AS BIGINT)"
_MALFORMED = "event_id % 31 = 0"


def _time_query(name, fmt, pattern, suffix="", zone="Z", shift_ms=0, whole_seconds=False):
    expected = f"({_MS} // 1000 * 1000)" if whole_seconds else _MS
    sql = f"""SELECT event_id, CASE WHEN {_MALFORMED} THEN NULL
              ELSE {expected} + {shift_ms} END AS millis FROM events"""

    @query(name, sql)
    def run(spark, sf_dir):
        stamp = F.col("ts").cast("timestamp_ntz")
        if pattern:
            written = F.concat(F.date_format(stamp, pattern), F.lit(suffix))
        else:
            micros = F.unix_micros(F.col("ts").cast("timestamp"))
            written = F.floor(micros / F.lit(1_000_000 if fmt == "epoch_s" else 1000)).cast("string")
        text = F.when(F.expr(_MALFORMED), "12 o'clock").otherwise(written)
        events = table(spark, sf_dir, "events").select("event_id", text.alias("text"))
        return events.selectExpr("event_id", times.to_millis("text", fmt, zone) + " AS millis")


_time_query("time_offset_ms", "spaced_offset", "yyyy-MM-dd HH:mm:ss.SSS", " -0500", shift_ms=5 * 3600 * 1000)
_time_query("time_iso_ms", "iso_offset", "yyyy-MM-dd'T'HH:mm:ss.SSS", "+02:00", shift_ms=-2 * 3600 * 1000)
_time_query(
    "time_zoned_ms", "iso_zoned", "yyyy-MM-dd'T'HH:mm:ss.SSS", "-05:00[America/New_York]",
    shift_ms=5 * 3600 * 1000,
)
_time_query(
    "time_local_ms", "iso_local", "yyyy-MM-dd'T'HH:mm:ss", zone="America/New_York",
    shift_ms=5 * 3600 * 1000, whole_seconds=True,
)
_time_query("time_epoch_s", "epoch_s", None, whole_seconds=True)
_time_query("time_epoch_ms", "epoch_ms", None)


@query(
    "time_format",
    """SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'spaced_offset' WHEN 1 THEN 'iso_offset'
       WHEN 2 THEN 'iso_zoned' WHEN 3 THEN 'epoch_s' WHEN 4 THEN 'epoch_ms' WHEN 5 THEN 'iso_local'
       END AS format FROM events""",
)
def time_format(spark, sf_dir):
    """The format of each of a mixture of texts, none for text that is not a time."""
    stamp = F.col("ts").cast("timestamp_ntz")
    iso = F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSS")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1_000_000)
    texts = [
        F.concat(F.date_format(stamp, "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" +0100")),
        F.concat(iso, F.lit("Z")),
        F.concat(iso, F.lit("+01:00[Europe/Paris]")),
        F.floor(seconds).cast("string"),
        F.floor(seconds * 1000).cast("string"),
        iso,
        F.concat(F.lit("on "), iso),
    ]
    text = F.element_at(F.array(*texts), (F.col("event_id") % 7 + 1).cast("int"))
    texts = table(spark, sf_dir, "events").select("event_id", text.alias("text"))
    return texts.selectExpr("event_id", times.format_of("text") + " AS format")


@query(
    "calendar_day",
    f"""SELECT event_id,
        strftime(ts, '%Y-%m-%d') AS written_day,
        strftime(ts - INTERVAL 5 HOUR, '%Y-%m-%d') AS new_york_day FROM events""",
)
def calendar_day(spark, sf_dir):
    """A written date keeps its own day; an epoch falls on the day in the given zone."""
    iso = F.concat(
        F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-11:00")
    )
    millis = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1000)).cast("long")
    texts = table(spark, sf_dir, "events").select(
        "event_id", iso.alias("iso"), millis.alias("millis"), millis.cast("string").alias("epoch")
    )
    return texts.selectExpr(
        "event_id",
        times.to_day("iso", times.to_millis("iso", "iso_offset"), "iso_offset") + " AS written_day",
        times.to_day("epoch", "millis", "epoch_ms", "America/New_York") + " AS new_york_day",
    )
