"""Inputs of the registered queries, derived from the given tables.

The tables have no coordinates and no dirty text, so both are computed from their keys, by
expressions that Spark and DuckDB evaluate alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _degrees(key: str, factor: int, steps: int, shift: int) -> str:
    return f"(({key} * {factor}) % {steps}) / CAST(100 AS DOUBLE) - {shift}"


# Location records as text, one per customer.
GEO_RAW = {
    "row_id": "c_custkey",
    "raw_lat": "CASE WHEN c_custkey % 97 = 0 THEN 'bad' WHEN c_custkey % 89 = 0 THEN ''"
    f" ELSE CAST({_degrees('c_custkey', 7919, 20001, 100)} AS STRING) END",
    "raw_lon": "CASE WHEN c_custkey % 101 = 0 THEN 'bad' WHEN c_custkey % 83 = 0 THEN ''"
    f" ELSE CAST({_degrees('c_custkey', 10473, 40001, 200)} AS STRING) END",
    "raw_time": "CASE WHEN c_custkey % 113 = 0 THEN '17' WHEN c_custkey % 127 = 0 THEN ''"
    " ELSE CAST(1700000000 + c_custkey * 37 AS STRING) END",
    "cell_id": "CASE WHEN c_custkey % 59 = 0 THEN '' ELSE CAST(c_nationkey AS STRING) END",
    "raw_radius": "CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 7 = 1 THEN 'null'"
    " WHEN c_custkey % 7 = 2 THEN '0' ELSE CAST(c_custkey % 500 AS STRING) || '.5' END",
    "amount": "CASE WHEN c_custkey % 53 = 0 THEN '2147483647' WHEN c_custkey % 61 = 0 THEN 'oops'"
    " WHEN c_custkey % 67 = 0 THEN '0' ELSE CAST(c_acctbal AS STRING) END",
    "visits": "CASE WHEN c_custkey % 43 = 0 THEN 'many' WHEN c_custkey % 47 = 0 THEN '-1'"
    " WHEN c_custkey % 71 = 0 THEN '0' ELSE CAST(c_custkey * 3 AS STRING) END",
    "segment": "CASE WHEN c_custkey % 11 = 0 THEN 'n/a' WHEN c_custkey % 13 = 0 THEN ''"
    " ELSE c_mktsegment END",
    "unused": "CAST(NULL AS STRING)",
    "broken": "'x' || CAST(c_custkey AS STRING)",
}

# Location records as text, one per line item: the large input. A third of all records shares
# one cell, one user and one coordinate.
TRIPS = {
    "trip_id": "l_orderkey * 8 + l_linenumber",
    "raw_lat": "CASE WHEN l_orderkey % 97 = 0 THEN 'bad' WHEN l_orderkey % 3 = 0 THEN '58.25'"
    f" ELSE CAST({_degrees('(l_orderkey + l_linenumber)', 7919, 20001, 100)} AS STRING) END",
    "raw_lon": "CASE WHEN l_orderkey % 101 = 0 THEN '' WHEN l_orderkey % 3 = 0 THEN '26.5'"
    f" ELSE CAST({_degrees('(l_orderkey + l_linenumber)', 10473, 40001, 200)} AS STRING) END",
    "raw_time": "CAST(1700000000 + l_orderkey * 37 + l_linenumber AS STRING)",
    "cell": "CASE WHEN l_orderkey % 3 = 0 THEN 'busy' ELSE CAST(l_suppkey AS STRING) END",
    "person": "CASE WHEN l_orderkey % 3 = 0 THEN 'crowd' WHEN l_partkey % 19 = 0 THEN ''"
    " ELSE 'p' || CAST(l_partkey AS STRING) END",
    "price": "CASE WHEN l_partkey % 53 = 0 THEN '2147483647' WHEN l_partkey % 61 = 0 THEN 'oops'"
    " ELSE CAST(l_extendedprice AS STRING) END",
    "flag": "CASE WHEN l_partkey % 17 = 0 THEN 'n/a' ELSE l_returnflag END",
}

# Sites, one per supplier.
SITES = {
    "site": "s_suppkey",
    "lat": _degrees("s_suppkey", 7919, 12001, 60),
    "lon": _degrees("s_suppkey", 10473, 34001, 170),
}

# Sites, one per customer: a third within some hundred metres, a ninth at one coordinate, the
# rest all over the world, across the date line and near the poles.
CROWDED_SITES = {
    "site": "c_custkey",
    "lat": "CASE WHEN c_custkey % 9 = 1 THEN CAST(59.437 AS DOUBLE)"
    " WHEN c_custkey % 3 = 0 THEN 58.37 + ((c_custkey * 7919) % 2003) / CAST(1000000 AS DOUBLE)"
    f" ELSE {_degrees('c_custkey', 7919, 17997, 89.98)} END",
    "lon": "CASE WHEN c_custkey % 9 = 1 THEN CAST(24.7535 AS DOUBLE)"
    " WHEN c_custkey % 3 = 0 THEN 26.71 + ((c_custkey * 10473) % 3001) / CAST(1000000 AS DOUBLE)"
    f" ELSE {_degrees('c_custkey', 10473, 36000, 180)} END",
}

# Pairs of points, one per customer, less than half way round the earth apart.
POINT_PAIRS = {
    "row_id": "c_custkey",
    "lat1": _degrees("c_custkey", 7919, 17001, 85),
    "lon1": _degrees("c_custkey", 10473, 36000, 180),
    "lat2": _degrees("c_custkey", 6151, 12001, 60),
    "lon2": f"{_degrees('c_custkey', 10473, 36000, 180)} + ((c_custkey * 31) % 9000) / CAST(100 AS DOUBLE)",
    "azimuth": _degrees("c_custkey", 3571, 36000, 180),
    "metres": "CAST((c_custkey * 6151) % 2000000 AS DOUBLE)",
}

# Lookup tables from nation: key and value as text. Each fifth key is one that no record has,
# every key is twice in the table (the later row wins), one value is not a number.
NATION_KEY = "CASE WHEN n_nationkey % 5 = 4 THEN 'other ' ELSE '' END || CAST(n_nationkey AS STRING)"
LOOKUPS = {
    "string": ("nation_name", "n_name"),
    "long": ("nation_code", "CAST(n_nationkey * 100 + n_regionkey AS STRING)"),
    "float": ("nation_share", "CASE WHEN n_nationkey = 7 THEN 'none' ELSE CAST(n_nationkey AS STRING) || '.25' END"),
    "double": ("nation_weight", "CAST(n_nationkey AS STRING) || '.125'"),
}

SOURCE_TABLE = {
    "geo_raw": ("customer", GEO_RAW),
    "trips": ("lineitem", TRIPS),
    "sites": ("supplier", SITES),
    "crowded_sites": ("customer", CROWDED_SITES),
    "point_pairs": ("customer", POINT_PAIRS),
}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = SOURCE_TABLE[name]
    return table(spark, sf_dir, source).selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])


def derived_sql(name: str) -> str:
    source, columns = SOURCE_TABLE[name]
    return f"SELECT {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM {source}"


def with_inputs(body: str, *names: str) -> str:
    """An oracle query over derived inputs."""
    ctes = ", ".join(f"{n} AS ({derived_sql(n)})" for n in names)
    return f"WITH {ctes} {body}" if not body.lstrip().startswith(",") else f"WITH {ctes}{body}"


def lookup_rows(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """(key, value, position): the keys of every nation, twice over."""
    value = LOOKUPS[kind][1]
    return table(spark, sf_dir, "nation").selectExpr(
        f"{NATION_KEY} AS key",
        f"explode(array(named_struct('v', 'overwritten', 'p', 0), named_struct('v', {value}, 'p', 1))) AS r",
    ).selectExpr("key", "r.v AS value", "r.p AS position")
