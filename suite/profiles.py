"""Profile, totals, days, ids, catalogue and the finished records."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.inputs import LOOKUPS, NATION_KEY, derived, lookup_rows, with_inputs
from suite.records import LAT_OK, LON_OK, LONG, TYPED, geo_options, prepared
from suite.registry import query
from trailmill.operators import catalogue as catalogues
from trailmill.operators import profile as profiles
from trailmill.operators.dictionary import build_dictionary, encode
from trailmill.options import PrepOptions
from trailmill.plans.preparation import prepare
from trailmill.sources.lookups import LookupTable

START, END = 1_700_005_000, 1_700_400_000


def over_trips(body: str) -> str:
    return with_inputs(TYPED.format("trips") + body, "trips")


def trip_options(**changes) -> PrepOptions:
    defaults = dict(
        longitude="raw_lon", latitude="raw_lat", time="raw_time", time_format="epoch_s",
        string_columns=["cell", "person", "flag"], float_columns=["price"], long_columns=["trip_id"],
    )
    return PrepOptions(**(defaults | changes))


def trips(spark, sf_dir, **changes):
    return prepare(spark, trip_options(**changes), records=derived(spark, sf_dir, "trips"))


# -- days and totals --------------------------------------------------------------------------


@query(
    "rows_per_day",
    over_trips("""
        SELECT strftime(make_timestamp(time * 1000), '%Y-%m-%d') AS day, count(*) AS n
        FROM accepted GROUP BY ALL ORDER BY day"""),
)
def rows_per_day(spark, sf_dir):
    return trips(spark, sf_dir).daily()


@query(
    "run_totals",
    over_trips(f"""
        SELECT count(*) AS total,
            count(*) FILTER (WHERE good AND time BETWEEN {START}000 AND {END}000) AS written,
            count(*) FILTER (WHERE NOT (good AND time BETWEEN {START}000 AND {END}000)) AS rejected,
            count(*) FILTER (WHERE time NOT BETWEEN {START}000 AND {END}000) AS time_gated
        FROM (SELECT *, lat IS NOT NULL AND lon IS NOT NULL AND time IS NOT NULL AS good FROM typed) t"""),
)
def run_totals(spark, sf_dir):
    return trips(spark, sf_dir, start_time=str(START), end_time=str(END)).totals()


@query(
    "reject_reasons",
    over_trips("""
        SELECT reject_reason, count(*) AS n FROM (SELECT
            CASE WHEN lon_status <> 'ok' THEN 'lon_' || lon_status
                 WHEN lat_status <> 'ok' THEN 'lat_' || lat_status
                 WHEN time_status <> 'ok' THEN 'time_' || time_status END AS reject_reason
            FROM typed) r WHERE reject_reason IS NOT NULL GROUP BY reject_reason"""),
)
def reject_reasons(spark, sf_dir):
    return trips(spark, sf_dir).reject_reasons()


# -- profile ----------------------------------------------------------------------------------

_FLOAT = "TRY_CAST({0} AS FLOAT)"
_NUMBERS = {
    "amount": ("amount", _FLOAT.format("amount"), "float"),
    "broken": ("broken", _FLOAT.format("broken"), "float"),
    "radius": ("NULLIF(NULLIF(raw_radius, ''), 'null')",
               "TRY_CAST(NULLIF(NULLIF(raw_radius, ''), 'null') AS FLOAT)", "float"),
    "visits": ("visits", LONG.format("visits"), "long"),
}
_STRINGS = {"cell_id": "NULLIF(cell_id, '')", "segment": "NULLIF(NULLIF(segment, ''), 'n/a')", "unused": "unused"}


def _profile_sql() -> str:
    parts = []
    for name, ok in (("lat", LAT_OK), ("lon", LON_OK)):
        parts.append(f"""
            SELECT '{name}' AS "column", 'double' AS type,
                count(*) FILTER (WHERE {name}_status IN ('ok', 'invalid')) AS non_null,
                count(*) FILTER (WHERE {name}_status = 'invalid') AS invalid,
                count(*) FILTER (WHERE {name}_status IN ('null', 'out_of_range')) AS nulls,
                count(*) FILTER (WHERE {name}_status = 'out_of_range') AS out_of_range,
                count(*) FILTER (WHERE {name} = 0) AS zeros,
                min({name}) AS min, max({name}) AS max, CAST(NULL AS BIGINT) AS n_distinct FROM typed""")
    parts.append("""
        SELECT 'time', 'long', count(*) FILTER (WHERE time_status IN ('ok', 'invalid')),
            count(*) FILTER (WHERE time_status = 'invalid'),
            count(*) FILTER (WHERE time_status = 'null'), 0,
            count(*) FILTER (WHERE time = 0), NULL, NULL, NULL FROM typed""")
    for name, (text, value, kind) in _NUMBERS.items():
        low, high = (f"CAST(min({value}) AS DOUBLE)", f"CAST(max({value}) AS DOUBLE)") if kind == "float" else ("NULL", "NULL")
        parts.append(f"""
            SELECT '{name}', '{kind}', count({text}),
                count(*) FILTER (WHERE {text} IS NOT NULL AND {value} IS NULL),
                count(*) - count({text}), 0, count(*) FILTER (WHERE {value} = 0),
                {low}, {high}, NULL FROM typed""")
    for name, value in _STRINGS.items():
        parts.append(f"""
            SELECT '{name}', 'string', count({value}), 0, count(*) - count({value}), 0, 0, NULL, NULL,
                count(DISTINCT {value}) FROM typed""")
    return with_inputs(
        TYPED.format("geo_raw") + ", whole AS (" + " UNION ALL ".join(parts) + ") SELECT {columns} FROM whole {where}",
        "geo_raw",
    )


_PROFILE = _profile_sql()


def _profiled(spark, sf_dir):
    return prepared(
        spark, sf_dir, radius="raw_radius", excluded=["row_id"], long_columns=["visits"],
        string_columns=["cell_id", "segment", "unused"], string_null_values=["n/a"],
    )


def _sql(columns: str, where: str = "") -> str:
    return _PROFILE.replace("{columns}", columns).replace("{where}", where)


@query("profile_counts", _sql('"column", type, non_null, invalid, nulls, out_of_range, zeros'))
def profile_counts(spark, sf_dir):
    run = _profiled(spark, sf_dir)
    return profiles.profile_counts(run.decided, run.profiled_columns).select(
        "column", "type", "non_null", "invalid", "nulls", "out_of_range", "zeros"
    )


@query("profile_minmax", _sql('"column", min, max', "WHERE type IN ('float', 'double')"))
def profile_minmax(spark, sf_dir):
    run = _profiled(spark, sf_dir)
    counts = profiles.profile_counts(run.decided, run.profiled_columns)
    return counts.where(F.col("type").isin("float", "double")).select("column", "min", "max")


@query("profile_distinct", _sql('"column", n_distinct', "WHERE type = 'string'"))
def profile_distinct(spark, sf_dir):
    run = _profiled(spark, sf_dir)
    return profiles.profile_distinct(run.decided, run.profiled_columns)


@query(
    "cardinality_warning",
    over_trips("""
        , named AS (SELECT 'cell' AS "column", cell AS v FROM typed UNION ALL
                    SELECT 'person', NULLIF(person, '') FROM typed UNION ALL SELECT 'flag', flag FROM typed)
        SELECT "column", count(DISTINCT v) AS n_distinct FROM named GROUP BY "column"
        HAVING count(DISTINCT v) > 5"""),
)
def cardinality_warning(spark, sf_dir):
    return profiles.cardinality_warnings(trips(spark, sf_dir).profile(), 5)


@query(
    "empty_columns",
    _sql(
        """"column", CASE WHEN type = 'string' THEN 'string_no_data'
           WHEN non_null = 0 THEN 'number_no_data' ELSE 'number_no_valid_data' END AS finding""",
        """WHERE (type = 'string' AND n_distinct = 0)
           OR (type IN ('float', 'double') AND non_null = invalid)""",
    ),
)
def empty_columns(spark, sf_dir):
    return profiles.empty_columns(_profiled(spark, sf_dir).profile())


def _report_sql() -> str:
    """The lines of the report, from the measures of every column."""
    measures = []
    for name in ("lat", "lon"):
        measures.append(f"""
            SELECT '{name}' AS c, 'double' AS type, count(*) FILTER (WHERE {name}_status IN ('ok', 'invalid')) AS non_null,
                count(*) FILTER (WHERE {name}_status = 'invalid') AS invalid,
                count(*) FILTER (WHERE {name}_status IN ('null', 'out_of_range')) AS nulls,
                count(*) FILTER (WHERE {name}_status = 'out_of_range') AS out_of_range,
                count(*) FILTER (WHERE {name} = 0) AS zeros, min({name}) AS low, max({name}) AS high,
                CAST(NULL AS BIGINT) AS n_distinct FROM typed""")
    measures.append("""
        SELECT 'time', 'long', count(*) FILTER (WHERE time_status IN ('ok', 'invalid')),
            count(*) FILTER (WHERE time_status = 'invalid'), count(*) FILTER (WHERE time_status = 'null'), 0,
            count(*) FILTER (WHERE time = 0), NULL, NULL, NULL FROM typed""")
    numbers = {"amount": "float", "broken": "float", "visits": "long", "row_id": "long"}
    for name, kind in numbers.items():
        text = f"CAST({name} AS VARCHAR)"
        value = _FLOAT.format(name) if kind == "float" else LONG.format(text)
        ends = f"CAST(min({value}) AS DOUBLE), CAST(max({value}) AS DOUBLE)" if kind == "float" else "NULL, NULL"
        measures.append(f"""
            SELECT '{name}', '{kind}', count({name}), count(*) FILTER (WHERE {name} IS NOT NULL AND {value} IS NULL),
                count(*) - count({name}), 0, count(*) FILTER (WHERE {value} = 0), {ends}, NULL FROM typed""")
    for name in ("cell_id", "raw_radius", "segment", "unused"):
        value = f"NULLIF({name}, '')"
        measures.append(f"""
            SELECT '{name}', 'string', count({value}), 0, count(*) - count({value}), 0, 0, NULL, NULL,
                count(DISTINCT {value}) FROM typed""")

    def shown(value: str) -> str:
        # three decimals at most, no zero before the point
        cut = f"rtrim(rtrim(printf('%.3f', {value}), '0'), '.')"
        return f"CASE WHEN {cut} IN ('0', '-0') THEN {cut} ELSE regexp_replace({cut}, '^(-?)0\\.', '\\1.') END"

    def named(title: str, where: str) -> str:
        return f"SELECT '{title}: ' || coalesce(string_agg(c, ', ' ORDER BY c), '') FROM m WHERE {where}"

    return with_inputs(
        TYPED.format("geo_raw") + ", m AS (" + " UNION ALL ".join(measures) + f"""),
        judged AS (SELECT CASE WHEN lon_status <> 'ok' THEN 'lon_' || lon_status
            WHEN lat_status <> 'ok' THEN 'lat_' || lat_status
            WHEN time_status <> 'ok' THEN 'time_' || time_status END AS reason, time FROM typed),
        lines AS (
        SELECT 'Records: ' || count(*) || ', written: ' || count(*) FILTER (WHERE reason IS NULL)
            || ', rejected: ' || count(reason) || ', outside the time bounds: 0' AS value FROM judged
        UNION ALL SELECT 'Time bounds: start none, end none'
        UNION ALL SELECT 'Rejected ' || reason || ': ' || count(*) FROM judged WHERE reason IS NOT NULL GROUP BY reason
        UNION ALL SELECT 'WARNING: ' || c || ' has ' || n_distinct || ' distinct strings, more than 5' FROM m
            WHERE n_distinct > 5
        UNION ALL SELECT c || ': non-null ' || non_null || ', invalid ' || invalid || ', null ' || nulls
            || ', out of range ' || out_of_range || ', zero ' || zeros || ', type ' || type
            || coalesce(', min ' || {shown("low")} || ', max ' || {shown("high")}, '')
            || coalesce(', distinct ' || n_distinct, '') FROM m
        UNION ALL {named("String columns without any data", "type = 'string' AND n_distinct = 0")}
        UNION ALL {named("Number columns without any data", "type IN ('float', 'double') AND non_null = 0")}
        UNION ALL {named("Number columns without any valid data",
                         "type IN ('float', 'double') AND non_null > 0 AND non_null = invalid")}
        UNION ALL SELECT strftime(make_timestamp(time * 1000), '%Y-%m-%d') || ': ' || count(*) FROM judged
            WHERE reason IS NULL GROUP BY strftime(make_timestamp(time * 1000), '%Y-%m-%d'))
        SELECT value FROM lines""",
        "geo_raw",
    )


@query("profile_report", _report_sql())
def profile_report(spark, sf_dir):
    """The report as lines of text, in order."""
    return prepared(spark, sf_dir, unique_strings=5).report()


# -- ids --------------------------------------------------------------------------------------

_FIRST = """
    , firsts AS (SELECT v, min(trip_id) AS first FROM
        (SELECT trip_id, NULLIF({0}, '') AS v FROM trips) t WHERE v IS NOT NULL GROUP BY v)
    , ids AS (SELECT v, row_number() OVER (ORDER BY first, v) AS id FROM firsts)
"""


@query("dictionary", with_inputs(_FIRST.format("person") + "SELECT v AS value, id FROM ids", "trips"))
def dictionary(spark, sf_dir):
    raw = derived(spark, sf_dir, "trips").select("trip_id", F.nullif("person", F.lit("")).alias("person"))
    return build_dictionary(raw, ["person"], ["trip_id"]).select("value", "id")


@query(
    "dictionary_replace",
    with_inputs(TYPED.format("trips") + _FIRST.format("person") + """
        SELECT trip_id, id AS person FROM accepted LEFT JOIN ids ON v = NULLIF(person, '')""", "trips"),
)
def dictionary_replace(spark, sf_dir):
    run = trips(
        spark, sf_dir, string_columns=["cell", "flag"], encoded_columns=["person"],
        first_seen_by=["trip_id"],
    )
    return run.records().select("trip_id", "person")


@query(
    "dictionary_retain",
    with_inputs(TYPED.format("trips") + _FIRST.format("cell") + """
        SELECT trip_id, cell, id AS "cell_IDs" FROM accepted LEFT JOIN ids ON v = cell""", "trips"),
)
def dictionary_retain(spark, sf_dir):
    run = trips(spark, sf_dir, retained_id_columns=["cell"], first_seen_by=["trip_id"])
    return run.records().select("trip_id", "cell", "cell_IDs")


@query(
    "dictionary_shuffled",
    with_inputs(_FIRST.format("person") + """
        SELECT trip_id, id AS person_id FROM trips LEFT JOIN ids ON v = NULLIF(person, '')""", "trips"),
)
def dictionary_shuffled(spark, sf_dir):
    """The join for dictionaries too large to broadcast: frequent values are spread."""
    raw = derived(spark, sf_dir, "trips").select("trip_id", F.nullif("person", F.lit("")).alias("person"))
    ids = build_dictionary(raw, ["person"], ["trip_id"])
    return encode(raw, ids, "person", "person_id", max_rows=0).select("trip_id", "person_id")


@query(
    "lookup_shuffled",
    with_inputs("""
        , keyed AS (SELECT 'P' || p_partkey AS k, p_name AS v FROM part)
        SELECT trip_id, v AS part_name FROM trips LEFT JOIN keyed ON lower(person) = lower(k)""", "trips"),
)
def lookup_shuffled(spark, sf_dir):
    """A lookup table too large to broadcast."""
    from suite.inputs import table
    from trailmill.operators.lookup import add_lookup

    rows = table(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("key"),
        F.col("p_name").alias("value"), F.col("p_partkey").alias("position"),
    )
    lookup = LookupTable("person", "part_name", "string", rows)
    raw = derived(spark, sf_dir, "trips").select("trip_id", "person")
    return add_lookup(raw, lookup, "person", max_rows=0).select("trip_id", "part_name")


# -- the whole run ----------------------------------------------------------------------------


@query(
    "prepared_records",
    with_inputs(TYPED.format("trips") + _FIRST.format("person") + f"""
        , keyed AS (SELECT {NATION_KEY} AS k, n_name AS v FROM nation)
        SELECT trip_id, lat, lon, time, cell, ids.id AS person,
            CAST(CASE WHEN TRY_CAST(price AS FLOAT) <> CAST(2147483647 AS FLOAT)
                 THEN TRY_CAST(price AS FLOAT) END AS DOUBLE) AS price,
            CASE WHEN flag <> 'n/a' THEN flag END AS flag, keyed.v AS nation_name
        FROM accepted LEFT JOIN ids ON ids.v = NULLIF(person, '') LEFT JOIN keyed ON cell = k
        WHERE time >= {START}000""", "trips"),
)
def prepared_records(spark, sf_dir):
    """Casts, markers, time gate, lookup and ids in one run over the large input."""
    lookup = LookupTable("cell", LOOKUPS["string"][0], "string", lookup_rows(spark, sf_dir, "string"))
    options = trip_options(
        string_columns=["cell", "flag"], encoded_columns=["person"], first_seen_by=["trip_id"],
        float_null_values=[2147483647], string_null_values=["n/a"], start_time=str(START),
    )
    run = prepare(spark, options, records=derived(spark, sf_dir, "trips"), lookups=(lookup,))
    return run.records().select(
        "trip_id", "lat", "lon", "time", "cell", "person",
        F.col("price").cast("double").alias("price"), "flag", "nation_name",
    )


@query(
    "attribute_catalogue",
    with_inputs("""
        , counted AS (
            SELECT 'amount' AS id, 'amount' AS name, NULL AS gui, count(amount) AS non_null FROM geo_raw UNION ALL
            SELECT 'cell_id', 'cell id', NULL, count(NULLIF(cell_id, '')) FROM geo_raw UNION ALL
            SELECT 'segment', 'segment', 'ID', count(NULLIF(segment, '')) FROM geo_raw UNION ALL
            SELECT 'visits', 'visits', NULL, count(visits) FROM geo_raw UNION ALL
            SELECT 'time', 'Time', 'dateTime', count(NULLIF(raw_time, '')) FROM geo_raw UNION ALL
            SELECT 'lat', 'Latitude', NULL, count(*) FILTER (WHERE raw_lat <> '' AND
                (TRY_CAST(raw_lat AS DOUBLE) IS NULL OR TRY_CAST(raw_lat AS DOUBLE) BETWEEN -90 AND 90)) FROM geo_raw UNION ALL
            SELECT 'lon', 'Longitude', NULL, count(*) FILTER (WHERE raw_lon <> '' AND
                (TRY_CAST(raw_lon AS DOUBLE) IS NULL OR TRY_CAST(raw_lon AS DOUBLE) BETWEEN -180 AND 180)) FROM geo_raw UNION ALL
            SELECT 'cell_id_IDs', 'cell id IDs', 'ID', count(NULLIF(cell_id, '')) FROM geo_raw UNION ALL
            SELECT 'trajectory_1', 'Trajectory', 'trajectory', NULL)
        SELECT id AS "attributeId", name AS "attributeName", gui AS "guiType", non_null,
            CASE WHEN id IN ('lat', 'lon') THEN 'Geographic Location'
                 WHEN id = 'trajectory_1' THEN 'trajectories' ELSE 'Generic' END AS "group",
            id = 'trajectory_1' AS hidden FROM counted""", "geo_raw"),
)
def attribute_catalogue(spark, sf_dir):
    raw = derived(spark, sf_dir, "geo_raw").drop("row_id", "raw_radius", "unused", "broken")
    options = geo_options(
        string_columns=["cell_id"], float_columns=["amount"], long_columns=["visits"],
        encoded_columns=["segment"], retained_id_columns=["cell_id"], trajectory_id="cell_id",
    )
    catalogue = prepare(spark, options, records=raw).catalogue(with_counts=True)
    return catalogue.select("attributeId", "attributeName", "guiType", "non_null", "group", "hidden")


_TOOLTIP = (
    "Refined location of the record, used by heatmapping and optionally by trajectory visualisation function\\n"
    "Geographic WGS84 coordinate in decimal degrees.\\nIn the current version equals to "
)


def _document_sql() -> str:
    """The JSON document, entry by entry, with the counts of the table."""
    def entry(*fields: str, counts: str = "") -> str:
        return "'{" + ",".join(fields) + "'" + (f" || {counts} || '" if counts else " || '") + "}'"

    def counted(text: str, distinct: bool = False, good: str = "") -> str:
        n = f"(SELECT count(*) FILTER (WHERE {good or text + ' IS NOT NULL'}) FROM geo_raw)"
        shown = f"',\"non_null\":' || {n} || ',\"nulls\":' || ((SELECT count(*) FROM geo_raw) - {n})"
        return shown + (f" || ',\"n_distinct\":' || (SELECT count(DISTINCT {text}) FROM geo_raw)" if distinct else "")

    def plain(name: str, shown: str, *more: str) -> tuple[str, ...]:
        gui = tuple(m for m in more if m)
        return (f'"attributeId":"{name}"', f'"attributeName":"{shown}"', f'"attributeTooltip":"{shown}"',
                '"group":"Generic"', *gui, '"hidden":false')

    def place(name: str, shown: str, source: str, bound: int) -> str:
        good = (f"{source} <> '' AND (TRY_CAST({source} AS DOUBLE) IS NULL"
                f" OR TRY_CAST({source} AS DOUBLE) BETWEEN -{bound} AND {bound})")
        return entry(f'"attributeId":"{name}"', f'"attributeName":"{shown}"', f'"attributeTooltip":"{_TOOLTIP}{source}"',
                     '"group":"Geographic Location"', '"unit":"degrees"', '"hidden":false',
                     counts=counted(source, good=good))

    identifier, moment = '"guiType":"ID"', '"guiType":"dateTime"'
    cell, segment = "NULLIF(cell_id, '')", "NULLIF(segment, '')"
    entries = [
        place("lat", "Latitude", "raw_lat", 90), place("lon", "Longitude", "raw_lon", 180),
        entry('"attributeId":"time"', '"attributeName":"Time"', '"attributeTooltip":"time"', '"group":"Generic"',
              moment, '"hidden":false', counts=counted("NULLIF(raw_time, '')")),
        entry(*plain("cell_id", "cell id"), counts=counted(cell, distinct=True)),
        entry(*plain("amount", "amount"), counts=counted("amount")),
        entry(*plain("visits", "visits"), counts=counted("visits")),
        entry(*plain("segment", "segment", identifier), counts=counted(segment)),
        entry(*plain("cell_id_IDs", "cell id IDs", identifier), counts=counted(cell)),
        entry('"attributeId":"trajectory_1"', '"attributeName":"Trajectory"', '"group":"trajectories"',
              '"guiType":"trajectory"', '"hidden":true', '"idField":"cell_id"', '"lonAttributeId":"lon"',
              '"latAttributeId":"lat"', '"infoAttributes":[]'),
    ]
    return with_inputs(f"SELECT '{{\"data\":[' || {" || ',' || ".join(entries)} || ']}}' AS value", "geo_raw")


@query("catalogue_document", _document_sql())
def catalogue_document(spark, sf_dir):
    """The whole catalogue as its JSON document, with the counts of the profile."""
    raw = derived(spark, sf_dir, "geo_raw").drop("row_id", "raw_radius", "unused", "broken")
    options = geo_options(
        string_columns=["cell_id"], float_columns=["amount"], long_columns=["visits"],
        encoded_columns=["segment"], retained_id_columns=["cell_id"], trajectory_id="cell_id",
    )
    return catalogues.catalogue_document(prepare(spark, options, records=raw).catalogue(with_counts=True))
