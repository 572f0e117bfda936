"""Geodesics, sites, neighbours, radii and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.inputs import derived, with_inputs
from suite.profiles import trips
from suite.records import TYPED, prepared
from suite.registry import query
from trailmill.functions.geodesic import destination, distance_m
from trailmill.operators.sites import (
    coordinates_of, distinct_sites, intersite_distance, nearest_neighbours, radius_per_site,
)

_A, _F = "6378137.0", "(1 / CAST(298.257223563 AS DOUBLE))"
_B = f"({_A} * (1 - {_F}))"
_EP2 = f"(({_A} * {_A} - {_B} * {_B}) / ({_B} * {_B}))"


def inverse_ctes(source: str, keys: str, rounds: int = 12) -> str:
    """CTEs ending in ``measured`` (keys, metres) over points lat1, lon1, lat2, lon2."""
    keep = f"{keys}, l, su1, cu1, su2, cu2"
    parts = [f"""
        , g0 AS (SELECT {keys}, l, sin(u1) AS su1, cos(u1) AS cu1, sin(u2) AS su2, cos(u2) AS cu2, l AS lam
            FROM (SELECT {keys}, radians((lon2 - lon1) - 360 * round((lon2 - lon1) / 360)) AS l,
                atan((1 - {_F}) * tan(radians(lat1))) AS u1, atan((1 - {_F}) * tan(radians(lat2))) AS u2
                FROM {source}) p)"""]
    for i in range(1, rounds + 1):
        parts.append(f"""
        , g{i} AS (SELECT {keep}, ss, cs, s, ca2, m,
            l + (1 - c) * {_F} * sa * (s + c * ss * (m + c * cs * (2 * m * m - 1))) AS lam
            FROM (SELECT *, {_F} / 16 * ca2 * (4 + {_F} * (4 - 3 * ca2)) AS c FROM
            (SELECT *, CASE WHEN ca2 = 0 THEN cs ELSE cs - 2 * su1 * su2 / ca2 END AS m FROM
            (SELECT *, 1 - sa * sa AS ca2 FROM
            (SELECT *, atan2(ss, cs) AS s,
                CASE WHEN ss = 0 THEN 0 ELSE cu1 * cu2 * sin(lam) / ss END AS sa FROM
            (SELECT *, sqrt(pow(cu2 * sin(lam), 2) + pow(cu1 * su2 - su1 * cu2 * cos(lam), 2)) AS ss,
                su1 * su2 + cu1 * cu2 * cos(lam) AS cs FROM (SELECT {keep}, lam FROM g{i - 1}) z) a) b) c) d) e)""")
    parts.append(f"""
        , measured AS (SELECT {keys}, {_B} * aa * (s - bb * ss * (m + bb / 4 * (cs * (2 * m * m - 1)
            - bb / 6 * m * (4 * ss * ss - 3) * (4 * m * m - 3)))) AS metres
            FROM (SELECT *, 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k))) AS aa,
                k / 1024 * (256 + k * (-128 + k * (74 - 47 * k))) AS bb
                FROM (SELECT *, ca2 * {_EP2} AS k FROM g{rounds}) h) i)""")
    return "".join(parts)


def direct_ctes(source: str, keys: str, rounds: int = 12) -> str:
    """CTEs ending in ``reached`` (keys, lat2, lon2) from lat1, lon1, azimuth, metres."""
    keep = f"{keys}, lon1, az, su, cu, s1, sa, ca2, aa, bb, metres"
    parts = [f"""
        , d0 AS (SELECT *, metres / ({_B} * aa) AS s FROM (
            SELECT *, 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k))) AS aa,
                k / 1024 * (256 + k * (-128 + k * (74 - 47 * k))) AS bb FROM (
            SELECT *, ca2 * {_EP2} AS k FROM (
            SELECT *, 1 - sa * sa AS ca2 FROM (
            SELECT *, atan2(su, cu * cos(az)) AS s1, cu * sin(az) AS sa FROM (
            SELECT *, sin(u1) AS su, cos(u1) AS cu FROM (
            SELECT {keys}, lon1, metres, radians(azimuth) AS az,
                atan((1 - {_F}) * tan(radians(lat1))) AS u1 FROM {source}) a) b) c) d) e) f)"""]
    for i in range(1, rounds + 1):
        parts.append(f"""
        , d{i} AS (SELECT {keep}, metres / ({_B} * aa) + bb * ss * (m + bb / 4 * (cs * (2 * m * m - 1)
            - bb / 6 * m * (4 * ss * ss - 3) * (4 * m * m - 3))) AS s
            FROM (SELECT *, sin(s) AS ss, cos(s) AS cs, cos(2 * s1 + s) AS m FROM d{i - 1}) a)""")
    parts.append(f"""
        , reached AS (SELECT {keys}, lat2, east - 360 * floor((east + 180) / 360) AS lon2 FROM (
            SELECT {keys}, lat2, lon1 + degrees(lam - (1 - c) * {_F} * sa
                * (s + c * ss * (m + c * cs * (2 * m * m - 1)))) AS east FROM (
            SELECT *, {_F} / 16 * ca2 * (4 + {_F} * (4 - 3 * ca2)) AS c,
                degrees(atan2(su * cs + cu * ss * cos(az),
                    (1 - {_F}) * sqrt(sa * sa + pow(su * ss - cu * cs * cos(az), 2)))) AS lat2,
                atan2(ss * sin(az), cu * cs - su * ss * cos(az)) AS lam
            FROM (SELECT *, sin(s) AS ss, cos(s) AS cs, cos(2 * s1 + s) AS m FROM d{rounds}) a) b) c)""")
    return "".join(parts)


@query(
    "geodesic_distance",
    with_inputs(
        inverse_ctes("point_pairs", "row_id") + " SELECT row_id, round(metres, 2) AS metres FROM measured",
        "point_pairs",
    ),
)
def geodesic_distance(spark, sf_dir):
    return derived(spark, sf_dir, "point_pairs").select(
        "row_id", F.round(distance_m("lat1", "lon1", "lat2", "lon2"), 2).alias("metres")
    )


@query(
    "geodesic_direct",
    with_inputs(
        direct_ctes("point_pairs", "row_id")
        + " SELECT row_id, round(lat2, 6) AS lat2, round(lon2, 6) AS lon2 FROM reached",
        "point_pairs",
    ),
)
def geodesic_direct(spark, sf_dir):
    return derived(spark, sf_dir, "point_pairs").select(
        "row_id", destination("lat1", "lon1", "azimuth", "metres").alias("to")
    ).select("row_id", F.round("to.lat", 6).alias("lat2"), F.round("to.lon", 6).alias("lon2"))


# -- sites ------------------------------------------------------------------------------------


@query(
    "sites_distinct",
    with_inputs(TYPED.format("trips") + """
        SELECT cell AS site, lat, lon, max(time) AS last_seen FROM accepted GROUP BY ALL""", "trips"),
)
def sites_distinct(spark, sf_dir):
    records = trips(spark, sf_dir).records().select(
        F.col("cell").alias("site"), "lat", "lon", F.lit(None).cast("float").alias("radius"), "time"
    )
    return distinct_sites(records).select("site", "lat", "lon", "last_seen")


def _nearest_sql(name: str, body: str) -> str:
    pairs = f""", pairs AS (SELECT a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2, b.n AS n
        FROM (SELECT DISTINCT lat, lon FROM {name}) a
        JOIN (SELECT lat, lon, count(*) AS n FROM {name} GROUP BY lat, lon) b
        ON a.lat <> b.lat OR a.lon <> b.lon)"""
    ranked = """, ranked AS (SELECT lat1 AS lat, lon1 AS lon, metres, n,
        row_number() OVER (PARTITION BY lat1, lon1 ORDER BY metres, lat2, lon2) AS rank FROM measured)
        , four AS (SELECT *, greatest(0, least(n, 4 - (sum(n) OVER
            (PARTITION BY lat, lon ORDER BY rank) - n))) AS used FROM ranked WHERE rank <= 4)"""
    return with_inputs(
        pairs + inverse_ctes("pairs", "lat1, lon1, lat2, lon2, n") + ranked + body, name
    )


_NEAREST_BODY = " SELECT lat, lon, CAST(rank AS INTEGER) AS rank, round(metres, 2) AS distance_m FROM four"
_RADIUS_BODY = """
    , mean AS (SELECT lat, lon, CAST(floor(sum(metres * used) / sum(used)) AS INTEGER) AS radius
        FROM four GROUP BY lat, lon)
    SELECT CAST(site AS STRING) AS site, radius AS site_radius FROM {0} JOIN mean USING (lat, lon)"""


def _sites(spark, sf_dir, name):
    return derived(spark, sf_dir, name).withColumns(
        {
            "site": F.col("site").cast("string"),
            "radius": F.lit(None).cast("float"),
            "last_seen": F.lit(0).cast("long"),
        }
    )


def _nearest(spark, sf_dir, name):
    return nearest_neighbours(coordinates_of(_sites(spark, sf_dir, name))).select(
        "lat", "lon", "rank", F.round("distance_m", 2).alias("distance_m")
    )


@query("nearest4_sites", _nearest_sql("sites", _NEAREST_BODY))
def nearest4_sites(spark, sf_dir):
    return _nearest(spark, sf_dir, "sites")


@query("nearest4_crowded", _nearest_sql("crowded_sites", _NEAREST_BODY))
def nearest4_crowded(spark, sf_dir):
    """A third of the sites within some hundred metres; crowded cubes are spread."""
    return _nearest(spark, sf_dir, "crowded_sites")


@query("intersite_radius", _nearest_sql("sites", _RADIUS_BODY.format("sites")))
def intersite_radius(spark, sf_dir):
    return radius_per_site(_sites(spark, sf_dir, "sites"))


@query("intersite_radius_crowded", _nearest_sql("crowded_sites", _RADIUS_BODY.format("crowded_sites")))
def intersite_radius_crowded(spark, sf_dir):
    """Many sites at one coordinate each count as a neighbour of the others' neighbours."""
    return radius_per_site(_sites(spark, sf_dir, "crowded_sites"))


# -- geometry ---------------------------------------------------------------------------------

_GEOMETRY = """
    CASE WHEN r > 0 THEN 'CIRCLE' WHEN r IS NOT NULL THEN 'POINT' END AS "geometryType",
    CASE WHEN r IS NOT NULL THEN lat END AS "geometryLatitude",
    CASE WHEN r IS NOT NULL THEN lon END AS "geometryLongitude",
    CAST(NULL AS DOUBLE) AS "orientationMajorAxis",
    CAST(NULL AS DOUBLE) AS "innerSemiMajorRadius", CAST(NULL AS DOUBLE) AS "innerSemiMinorRadius",
    CAST(CASE WHEN r > 0 THEN r END AS DOUBLE) AS "outerSemiMajorRadius",
    CAST(CASE WHEN r > 0 THEN r END AS DOUBLE) AS "outerSemiMinorRadius",
    CASE WHEN r > 0 THEN CAST(0 AS DOUBLE) END AS "startAngle",
    CASE WHEN r > 0 THEN CAST(360 AS DOUBLE) END AS "stopAngle"
"""


def _geometry_of(run):
    names = [c.name for c in run.columns if c.role == "geometry"]
    kinds = {c.name: c.kind for c in run.columns}
    return run.records().select(
        "row_id",
        *[F.col(n).cast("double").alias(n) if kinds[n] == "float" else F.col(n) for n in names],
    )


@query(
    "geometry_given_radius",
    with_inputs(TYPED.format("geo_raw") + f"""
        SELECT row_id, {_GEOMETRY} FROM (SELECT *,
            CAST(trunc(TRY_CAST(NULLIF(NULLIF(raw_radius, ''), 'null') AS FLOAT)) AS INTEGER) AS r
            FROM accepted) g""", "geo_raw"),
)
def geometry_given_radius(spark, sf_dir):
    return _geometry_of(
        prepared(spark, sf_dir, radius="raw_radius", string_columns=["cell_id", "segment", "unused"])
    )


_LAST_SITE = """
    , cells AS (SELECT NULLIF(cell_id, '') AS site, lat, lon, time FROM accepted WHERE cell_id <> '')
    , last AS (SELECT site, lat, lon FROM (SELECT *, row_number() OVER
        (PARTITION BY site ORDER BY time DESC, lat DESC, lon DESC) AS k FROM cells) c WHERE k = 1)
    , spots AS (SELECT lat, lon, count(DISTINCT site) AS n FROM cells GROUP BY lat, lon)
    , pairs AS (SELECT a.site, a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2, b.n
        FROM last a JOIN spots b ON a.lat <> b.lat OR a.lon <> b.lon)
"""


@query(
    "geometry_intersite",
    with_inputs(
        TYPED.format("geo_raw") + _LAST_SITE + inverse_ctes("pairs", "site, lat2, lon2, n") + f"""
        , four AS (SELECT *, greatest(0, least(n, 4 - (sum(n) OVER (PARTITION BY site ORDER BY rank) - n))) AS used
            FROM (SELECT site, metres, n, row_number() OVER
                (PARTITION BY site ORDER BY metres, lat2, lon2) AS rank FROM measured) q WHERE rank <= 4)
        , radii AS (SELECT site, CAST(floor(sum(metres * used) / sum(used)) AS INTEGER) AS r
            FROM four GROUP BY site)
        SELECT row_id, {_GEOMETRY} FROM accepted LEFT JOIN radii ON site = NULLIF(cell_id, '')""",
        "geo_raw",
    ),
)
def geometry_intersite(spark, sf_dir):
    return _geometry_of(prepared(spark, sf_dir, site_id="cell_id"))


@query(
    "geometry_randomized",
    with_inputs(TYPED.format("geo_raw") + """
        SELECT count(*) AS n, CAST(0 AS BIGINT) AS outside,
            count(*) FILTER (WHERE NULLIF(NULLIF(raw_radius, ''), 'null') IS NOT NULL) AS with_centre,
            count(*) FILTER (WHERE NULLIF(NULLIF(raw_radius, ''), 'null') IS NULL) AS unmoved,
            count(*) FILTER (WHERE TRY_CAST(raw_radius AS FLOAT) >= 1) AS circles_moved,
            TRUE AS about_half_beyond_half, CAST(0 AS BIGINT) AS points_away
        FROM accepted""", "geo_raw"),
)
def geometry_randomized(spark, sf_dir):
    """Every moved point lies within radius + 1 metres of its centre, all circles move, about half
    of them beyond half their radius; the others stay."""
    run = prepared(
        spark, sf_dir, radius="raw_radius", randomize=True, seed=11,
        string_columns=["cell_id", "segment", "unused"],
    )
    moved = run.records().withColumn(
        "off", distance_m("lat", "lon", "geometryLatitude", "geometryLongitude")
    )
    limit = F.coalesce("outerSemiMajorRadius", F.lit(0)) + 1
    return moved.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("off") > limit + 0.001).alias("outside"),
        F.count("geometryLatitude").alias("with_centre"),
        F.count_if(F.col("geometryType").isNull()).alias("unmoved"),
        F.count_if((F.col("geometryType") == "CIRCLE") & (F.col("off") > 0)).alias("circles_moved"),
        F.avg(
            F.when(F.col("geometryType") == "CIRCLE", (F.col("off") > limit / 2).cast("int"))
        ).between(0.3, 0.7).alias("about_half_beyond_half"),
        F.count_if((F.col("geometryType") == "POINT") & (F.col("off") > 1.001)).alias("points_away"),
    )


_LAST_GIVEN = """
    , cells AS (SELECT DISTINCT NULLIF(cell_id, '') AS site, lat, lon, time,
        TRY_CAST(NULLIF(NULLIF(raw_radius, ''), 'null') AS FLOAT) AS radius FROM accepted WHERE cell_id <> '')
    , last AS (SELECT site, lat, lon, radius FROM (SELECT *, row_number() OVER
        (PARTITION BY site ORDER BY time DESC) AS k FROM cells) c WHERE k = 1)
    , spots AS (SELECT lat, lon, count(*) AS n
        FROM (SELECT DISTINCT site, lat, lon, radius FROM cells) d GROUP BY lat, lon)
    , pairs AS (SELECT a.site, a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2, b.n
        FROM last a JOIN spots b ON a.lat <> b.lat OR a.lon <> b.lon)
"""


@query(
    "geometry_site_given_radius",
    with_inputs(
        TYPED.format("geo_raw") + _LAST_GIVEN + inverse_ctes("pairs", "site, lat2, lon2, n") + f"""
        , four AS (SELECT *, greatest(0, least(n, 4 - (sum(n) OVER (PARTITION BY site ORDER BY rank) - n))) AS used
            FROM (SELECT site, metres, n, row_number() OVER
                (PARTITION BY site ORDER BY metres, lat2, lon2) AS rank FROM measured) q WHERE rank <= 4)
        , means AS (SELECT site, CAST(floor(sum(metres * used) / sum(used)) AS INTEGER) AS mean
            FROM four GROUP BY site)
        , radii AS (SELECT site, COALESCE(CAST(trunc(radius) AS INTEGER), mean) AS r
            FROM last LEFT JOIN means USING (site))
        SELECT row_id, {_GEOMETRY} FROM accepted LEFT JOIN radii ON site = NULLIF(cell_id, '')""",
        "geo_raw",
    ),
)
def geometry_site_given_radius(spark, sf_dir):
    """The radius of the latest site of each identifier, derived where that one has none."""
    return _geometry_of(
        prepared(
            spark, sf_dir, site_id="cell_id", radius="raw_radius",
            string_columns=["cell_id", "segment", "unused"],
        )
    )


@query(
    "sites_tolerance",
    with_inputs(TYPED.format("geo_raw") + """
        SELECT site, arg_max(lat, time) AS lat, arg_max(lon, time) AS lon, max(time) AS last_seen
        FROM (SELECT NULLIF(cell_id, '') AS site, lat, lon, time FROM accepted) c
        WHERE site IS NOT NULL GROUP BY site, round(lat / 20.5), round(lon / 20.5)""", "geo_raw"),
)
def sites_tolerance(spark, sf_dir):
    """Sites of one identifier within a grid cell are one, at the place seen last."""
    records = prepared(spark, sf_dir).records().select(
        F.col("cell_id").alias("site"), "lat", "lon", F.lit(None).cast("float").alias("radius"), "time"
    )
    return distinct_sites(records, 20.5).select("site", "lat", "lon", "last_seen")
