"""Sites of one identifier that lie within a tolerance of each other are one site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmill.operators.components import components
from trailmill.operators.sites import distinct_sites
from trailmill.session import discard, written

# Differences at the tolerance count as within it, whatever the last bit says.
_SLACK = 1 + 1e-9


def joined_sites(records: DataFrame, tolerance: float) -> DataFrame:
    """Distinct (site, lat, lon, radius) with ``last_seen``, close sites joined.

    ``records`` has site, lat, lon, radius, time. Two coordinates of an identifier are close when
    latitudes and longitudes each differ by at most ``tolerance`` degrees; chains of close
    coordinates are one site, for which its latest member stands.

    Coordinates are gathered in cells as wide as the tolerance, so all members of a cell are close
    and only cells that touch need a look. Side by side, their extremes decide. Corner to corner,
    a sweep decides: over the members in order of latitude, the nearest longitude so far. It is
    made only for cells that are not joined by then. No pairs of coordinates are formed.
    """
    width = tolerance * _SLACK

    def cell(c: str) -> Column:
        return F.floor(F.col(c) / width)

    exact = distinct_sites(records).withColumns({"i": cell("lat"), "j": cell("lon")})
    members = written(exact, "members")
    cells = written(
        members.groupBy("site", "i", "j")
        .agg(
            F.min("lat").alias("south"), F.max("lat").alias("north"),
            F.min("lon").alias("west"), F.max("lon").alias("east"),
            F.max(F.struct("last_seen", "lat", "lon", "radius")).alias("latest"),
        )
        .withColumn("node", F.monotonically_increasing_id()),
        "cells",
    )

    def beside(down: int, right: int) -> DataFrame:
        """(a, b) cells with b one row and column further; what separates them allows closeness."""
        one = cells.select("site", (F.col("i") + down).alias("i"), (F.col("j") + right).alias("j"),
                           F.col("node").alias("a"), "south", "north", "west", "east")
        two = cells.select("site", "i", "j", F.col("node").alias("b"), F.col("south").alias("south2"),
                           F.col("west").alias("west2"), F.col("east").alias("east2"))
        near = F.lit(True)
        if down:
            near = near & (F.col("south2") - F.col("north") <= width)
        if right > 0:
            near = near & (F.col("west2") - F.col("east") <= width)
        elif right < 0:
            near = near & (F.col("west") - F.col("east2") <= width)
        return one.join(two, ["site", "i", "j"]).where(near).select("a", "b", F.lit(right).alias("turn"))

    straight = written(beside(0, 1).union(beside(1, 0)).select("a", "b"), "straight")
    joined = components(straight)
    label = joined.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
    other = joined.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
    corners = written(
        beside(1, 1).union(beside(1, -1)).join(label, "a", "left").join(other, "b", "left")
        .where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b", "turn"),
        "corners",
    )
    links = straight.union(_close_corners(members, cells, corners, width))
    comps = components(links)
    named = cells.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    found = written(
        named.groupBy("site", "comp").agg(F.max("latest").alias("s"))
        .select("site", "s.lat", "s.lon", "s.radius", "s.last_seen"),
        "joined",
    )
    discard(members, cells, straight, corners)
    return found


def _close_corners(members: DataFrame, cells: DataFrame, corners: DataFrame, width: float) -> DataFrame:
    """Pairs of cells that touch at a corner and hold two close coordinates."""
    points = members.join(cells.select("site", "i", "j", "node"), ["site", "i", "j"]).select("node", "lat", "lon")
    lower = points.join(corners, F.col("node") == F.col("a")).select(
        "a", "b", (F.col("lat") + width).alias("at"), (F.col("lon") * F.col("turn")).alias("x"), F.lit(1).alias("side")
    )
    upper = points.join(corners, F.col("node") == F.col("b")).select(
        "a", "b", F.col("lat").alias("at"), (F.col("lon") * F.col("turn")).alias("x"), F.lit(0).alias("side")
    )
    so_far = Window.partitionBy("a", "b").orderBy("at", "side").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    nearest = F.min(F.when(F.col("side") == 0, F.col("x"))).over(so_far)
    swept = lower.union(upper).withColumn("nearest", nearest)
    return swept.where((F.col("side") == 1) & (F.col("nearest") <= F.col("x") + width)).select("a", "b").distinct()
