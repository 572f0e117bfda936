"""Sites, their nearest neighbours and the radius of each site identifier."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmill.functions.geodesic import LONGEST, distance_bound, distance_m, with_position
from trailmill.operators.joins import left_join_unique
from trailmill.operators.numbering import numbered
from trailmill.session import written

# Fixed value: neighbours that make up the distance of a site.
NEAREST = 4

# Rows per window group in the first pass.
_RUN = 50_000
_HALF_EARTH = 6_400_000.0
_AXIS_BITS = 21
_AXES = ("x", "y", "z")
# The usual shift and mask pairs that put two free bits after each of 21.
_INTERLEAVE = (
    (32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F),
    (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249),
)


def distinct_sites(records: DataFrame, tolerance: float | None = None) -> DataFrame:
    """Distinct (site, lat, lon, radius) with ``last_seen``, the latest time.

    ``records`` has site, lat, lon, radius, time. With a tolerance, coordinates of a site in one
    cell of a grid of that width are one, and the one seen last stands for them.
    """
    exact = (
        records.where(F.col("site").isNotNull())
        .groupBy("site", "lat", "lon", "radius")
        .agg(F.max("time").alias("last_seen"))
    )
    if not tolerance:
        return exact

    def cell(c: str) -> Column:
        return F.round(F.col(c) / tolerance).alias(f"__cell_{c}")

    return (
        exact.groupBy("site", cell("lat"), cell("lon"), "radius")
        .agg(F.max(F.struct("last_seen", "lat", "lon")).alias("s"))
        .select("site", "s.lat", "s.lon", "radius", "s.last_seen")
    )


def _woven(columns: list[str]) -> str:
    x, y, z = columns
    return f"{x} | shiftleft({y}, 1) | shiftleft({z}, 2)"


def _along_curve(points: DataFrame) -> DataFrame:
    """Add the z-order of x, y, z as two longs: cells of 6 m, then of 3 micrometres."""
    side = 2 * _HALF_EARTH / (1 << _AXIS_BITS)
    scaled = points.selectExpr("*", *[f"({a} + {_HALF_EARTH}D) / {side!r}D AS __s{a}" for a in _AXES])
    cells = scaled.selectExpr(
        *points.columns,
        *[f"CAST(floor(__s{a}) AS BIGINT) AS __b{a}" for a in _AXES],
        *[f"CAST(floor((__s{a} - floor(__s{a})) * {1 << _AXIS_BITS}) AS BIGINT) AS __d{a}" for a in _AXES],
    )
    numbers = [f"__{k}{a}" for k in "bd" for a in _AXES]
    for shift, mask in _INTERLEAVE:
        cells = cells.selectExpr(
            *points.columns, *[f"({n} | shiftleft({n}, {shift})) & {mask}L AS {n}" for n in numbers]
        )
    return cells.selectExpr(
        *points.columns, f"{_woven(numbers[:3])} AS __coarse", f"{_woven(numbers[3:])} AS __fine"
    )


def _chord(left: str, right: str) -> str:
    """Straight distance; the arguments are patterns with {} for the axis."""
    squares = [f"pow({left.format(a)} - {right.format(a)}, 2)" for a in _AXES]
    return f"sqrt({' + '.join(squares)})"


def _with_reach(points: DataFrame) -> DataFrame:
    """Add ``reach``: a distance within which at least four other coordinates lie.

    Points are sorted along a space-filling curve. Four neighbours on the curve are close in
    space, in dense and in sparse regions alike, and any four others bound the fourth
    nearest. Runs of the curve are window groups of fixed size with four rows of overlap, so
    no group depends on how the points are distributed.
    """
    ordered = numbered(
        _along_curve(points), ["__coarse", "__fine", "lat", "lon"], "__at", "curve"
    ).drop("__coarse", "__fine")
    run, place = f"floor((__at - 1) / {_RUN})", f"((__at - 1) % {_RUN})"
    overlapping = ordered.selectExpr(
        "*", f"{run} AS __home",
        f"explode(array_compact(array({run}, CASE WHEN {place} < {NEAREST} THEN {run} - 1 END,"
        f" CASE WHEN {place} >= {_RUN - NEAREST} THEN {run} + 1 END))) AS __run",
    )
    near = [(shift, step) for shift in ("lag", "lead") for step in range(1, NEAREST + 1)]
    seen = overlapping.selectExpr(
        "*",
        *[
            f"{shift}(struct(x, y, z), {step}) OVER (PARTITION BY __run ORDER BY __at) AS __{shift}{step}"
            for shift, step in near
        ],
    )
    # nulls (the ends of the curve) sort last
    chords = ", ".join(_chord("{}", f"__{shift}{step}.{{}}") for shift, step in near)
    return (
        seen.where("__run = __home")
        .selectExpr(*points.columns, f"get(array_sort(array({chords})), {NEAREST - 1}) AS __fourth")
        .selectExpr(
            *points.columns, f"coalesce({distance_bound('__fourth')}, {LONGEST!r}D) AS reach"
        )
    )


def nearest_neighbours(
    coordinates: DataFrame,
    wanted: DataFrame | None = None,
) -> DataFrame:
    """The nearest other coordinates of each wanted one, exactly.

    ``coordinates`` has distinct (lat, lon) and ``copies``, the number of sites there, which
    all count as neighbours. ``wanted`` is a subset of (lat, lon), by default all. Result:
    (lat, lon, distance_m, copies), nearest first up to four coordinates per point.

    Every point gets its own search distance (see ``_with_reach``) and looks only into cubes
    of about that size, so the pairs grow with the number of points, however uneven they lie.
    A lone point beside a crowd is the one case where a cube holds many candidates; crowded
    cubes are spread over several tasks, and the four nearest are kept per task before the
    shuffle.
    """
    reached = _with_reach(with_position(coordinates, "lat", "lon"))
    points = written(
        reached.selectExpr("*", "CAST(ceil(log2(2 * reach)) AS INT) AS level"), "points"
    )
    seekers = points
    if wanted is not None:
        seekers = points.join(wanted.select("lat", "lon").distinct(), ["lat", "lon"], "left_semi")
    side = "pow(2D, level)"
    seek = seekers.selectExpr(
        "lat AS lat_a", "lon AS lon_a", "level", "reach", *[f"{a} AS {a}_a" for a in _AXES]
    )
    for a in _AXES:
        low, high = (f"CAST(floor(({a}_a {sign} reach) / {side}) AS BIGINT)" for sign in "-+")
        seek = seek.selectExpr("*", f"explode(sequence({low}, {high})) AS c{a}")
    cube = ["level", "cx", "cy", "cz"]
    seek, offered = _spread_crowds(seek, _offered(points, seek, cube), cube)
    pairs = seek.join(offered, [*cube, "__part"]).where(
        f"(lat_a <> lat_b OR lon_a <> lon_b) AND {_chord('{}_a', '{}_b')} <= reach"
    )
    measured = pairs.select(
        "lat_a", "lon_a", "lat_b", "lon_b", "copies",
        distance_m("lat_a", "lon_a", "lat_b", "lon_b").alias("distance_m"),
    )
    # Spark keeps the first four per task before it shuffles for this window
    ranked = Window.partitionBy("lat_a", "lon_a").orderBy("distance_m", "lat_b", "lon_b")
    return (
        measured.withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= NEAREST)
        .select(
            F.col("lat_a").alias("lat"), F.col("lon_a").alias("lon"), "rank", "distance_m", "copies"
        )
    )


def _offered(points: DataFrame, seek: DataFrame, cube: list[str]) -> DataFrame:
    """Every point in its cube of each size in use, as far as somebody looks into that cube.

    A semi join drops the others before they meet any seeker.
    """
    # cube sizes are powers of two between a centimetre and the earth, some thirty at most
    levels = sorted(row["level"] for row in seek.select("level").distinct().collect())
    placed = points.selectExpr(
        "lat AS lat_b", "lon AS lon_b", "copies", *[f"{a} AS {a}_b" for a in _AXES],
        f"explode(array({', '.join(map(str, levels)) or 0})) AS level",
    ).selectExpr("*", *[f"CAST(floor({a}_b / pow(2D, level)) AS BIGINT) AS c{a}" for a in _AXES])
    return placed.join(seek.select(*cube).distinct(), cube, "left_semi")


def _spread_crowds(seek: DataFrame, offered: DataFrame, cube: list[str]):
    """Split the candidates of crowded cubes into parts and send each seeker to every part.

    The work of a cube is its seekers times its candidates. Fewer cubes than tasks can hold more
    than a task's share of all work; only those are split.
    """
    tasks = int(seek.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    looked = seek.groupBy(*cube).agg(F.count(F.lit(1)).cast("double").alias("seekers"))
    held = offered.groupBy(*cube).agg(F.count(F.lit(1)).alias("held"))
    work = looked.join(held, cube).select(*cube, "held", (F.col("seekers") * F.col("held")).alias("work"))
    total = work.agg(F.sum("work").alias("work")).select(
        *[F.lit(None).cast(kind).alias(c) for c, kind in work.dtypes[:-1]], "work"
    )
    rows = work.orderBy(F.desc("work"), *cube).limit(tasks).unionByName(total).collect()
    everything = next(row["work"] for row in rows if row["level"] is None)
    split = [
        (*[row[c] for c in cube], parts)
        for row in rows
        if row["level"] is not None
        and (parts := min(row["held"], math.ceil(row["work"] * tasks / everything))) > 1
    ]
    # at most one row of five numbers per task
    parts = seek.sparkSession.createDataFrame(
        split, "level int, cx long, cy long, cz long, __parts int"
    )
    seek = seek.join(F.broadcast(parts), cube, "left").withColumn(
        "__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))
    )
    # distinct coordinates, so their hash splits any crowd
    offered = offered.join(F.broadcast(parts), cube, "left").withColumn(
        "__part",
        F.pmod(F.xxhash64("lat_b", "lon_b"), F.coalesce("__parts", F.lit(1)).cast("long")).cast("int"),
    )
    return seek.drop("__parts"), offered.drop("__parts")


def intersite_distance(neighbours: DataFrame) -> DataFrame:
    """(lat, lon, intersite_m): mean of the up to four nearest distances, whole metres."""
    before = Window.partitionBy("lat", "lon").orderBy("rank").rowsBetween(
        Window.unboundedPreceding, -1
    )
    used = F.least(
        F.col("copies"), F.greatest(F.lit(0), NEAREST - F.coalesce(F.sum("copies").over(before), F.lit(0)))
    )
    return (
        neighbours.withColumn("used", used)
        .groupBy("lat", "lon")
        .agg((F.sum(F.col("distance_m") * F.col("used")) / F.sum("used")).alias("mean"))
        .select("lat", "lon", F.floor("mean").cast("int").alias("intersite_m"))
    )


def coordinates_of(sites: DataFrame, one_per_coordinate: bool = False) -> DataFrame:
    """Distinct (lat, lon) with the number of sites there, as far as it matters."""
    copies = F.lit(1) if one_per_coordinate else F.least(F.count(F.lit(1)), F.lit(NEAREST))
    return sites.groupBy("lat", "lon").agg(copies.cast("long").alias("copies"))


def radius_per_site(
    sites: DataFrame,
    one_per_coordinate: bool = False,
    **bounds: int,
) -> DataFrame:
    """(site, site_radius): whole metres, from the site of that identifier seen last.

    Its own radius where it has one, otherwise its distance to the nearest other sites; a
    lone site gets 0.
    """
    last = sites.groupBy("site").agg(
        F.max_by(
            F.struct("radius", "lat", "lon"), F.struct("last_seen", "lat", "lon", "radius")
        ).alias("s")
    ).select("site", "s.*")
    last = written(last, "last-site")
    given = F.col("radius").try_cast("int")
    without = last.where(F.col("radius").isNull())
    if without.isEmpty():
        return last.select("site", given.alias("site_radius"))
    neighbours = nearest_neighbours(coordinates_of(sites, one_per_coordinate), without)
    distances = written(
        intersite_distance(neighbours).select(F.struct("lat", "lon").alias("at"), "intersite_m"),
        "intersite",
    )
    joined = left_join_unique(last.withColumn("at", F.struct("lat", "lon")), distances, "at", **bounds)
    return joined.select(
        "site",
        F.when(F.col("radius").isNotNull(), given)
        .otherwise(F.coalesce("intersite_m", F.lit(0)))
        .alias("site_radius"),
    )
